"""Robots rules of many hosts against many addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.dialect import SPARK


def _agent(x: str) -> str:
    """An agent's name without version and comment; ``*`` if blank."""
    name = SPARK.replace(f"lower(trim({x}))", r"(?<=.)[/ ].*$", "")
    return f"coalesce(nullif({name}, ''), '*')"


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, body) to (host, agent, kind, prefix): every rule of each agent of its group; an agent without prefixes has one with a null prefix.

    A group ends at a blank line and comments count for nothing, so a line of a comment
    alone is blank. Rules before any agent of their group do not count.
    """
    line = f"trim({SPARK.replace('line', '(?s)#.*', '')})"
    lines = texts.selectExpr("host", f"posexplode({SPARK.lines("coalesce(body, '')")}) as (pos, line)").selectExpr("host", "pos", f"{line} as line")
    # A host's text is one small file: its lines are put in order within the row of the host.
    said = lines.selectExpr("host", "pos", "line = '' as blank", f"lower(trim({SPARK.extract('line', '^([^:]+):', 1)})) as word", f"trim({SPARK.extract('line', '^[^:]+:(.*)$', 1)}) as value")
    rows = said.where("blank or word in ('user-agent', 'allow', 'disallow')").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("pos", "blank", "word", "value"))).alias("ls"))
    # One fold: the agents so far of the group, and what has been said of them.
    none = "cast(array() as array<string>)"
    start = f"struct({none} as agents, cast(array() as array<struct<agent: string, kind: string, prefix: string>>) as rules)"
    prefix = "case when l.value = '' then null when startswith(l.value, '/') then l.value else '/' || l.value end"
    step = f"""(s, l) -> case when l.blank then struct({none} as agents, s.rules as rules)
        when l.word = 'user-agent' then struct(case when l.value = '' then s.agents else array_append(s.agents, {_agent('l.value')}) end as agents, s.rules as rules)
        else struct(s.agents as agents, concat(s.rules, transform(s.agents, a -> struct(a as agent, l.word as kind, {prefix} as prefix))) as rules) end"""
    return rows.selectExpr("host", f"explode(aggregate(ls, {start}, {step}, s -> s.rules)) as r").selectExpr("host", "r.agent", "r.kind", "r.prefix").distinct()


def allowed(visits: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (host, agent, path): an agent's own rules or else those for all, the longest prefix of either kind, allowing wins ties.

    A path is cut to the lengths that its host's rules have, and those prefixes meet
    the rules by equality, so nothing is compared with every rule. A blank path is ``/``.
    """
    keyed = visits.withColumns({"v_path": F.expr("coalesce(nullif(trim(path), ''), '/')"), "v_agent": F.expr(_agent("coalesce(agent, '')"))})
    by_agent = rules.groupBy("host", "agent").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    by_host = by_agent.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("agent", "lengths"))).alias("agents"))
    named = keyed.join(by_host, "host", "left").selectExpr(*[f"`{c}`" for c in visits.columns], "v_path", "v_agent", "agents", "case when agents[v_agent] is not null then v_agent when agents['*'] is not null then '*' end as rule_agent")
    cut = named.selectExpr("host", "v_path", "rule_agent", "explode(filter(agents[rule_agent], n -> n <= length(v_path))) as n").distinct().selectExpr("host", "v_path", "rule_agent", "substr(v_path, 1, n) as prefix")
    met = cut.join(rules.where("prefix is not null").withColumnRenamed("agent", "rule_agent"), ["host", "rule_agent", "prefix"])
    longest = met.groupBy("host", "v_path", "rule_agent").agg(*(F.max(F.when(F.col("kind") == k, F.length("prefix"))).alias(k) for k in ("allow", "disallow")))
    judged = named.join(longest, ["host", "v_path", "rule_agent"], "left")
    return judged.selectExpr(*[f"`{c}`" for c in visits.columns], "coalesce(allow, -1) >= coalesce(disallow, -1) as allowed")
