"""Aggregates over evaluated postings, rankings, trends between runs, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

VERDICTS = ("GO", "GO_WITH_CAUTION", "NO_GO")
RANKINGS = {
    "by_score": ["score desc"],
    "by_language_ease": ["language_friction_index asc", "score desc"],
    "by_reputation": ["company_reputation_index desc", "score desc"],
    "by_composite": ["2 * score + (100 - language_friction_index) + company_reputation_index desc"],
}


def _order(strategy: str) -> list[Column]:
    out = []
    for rule in RANKINGS[strategy]:
        e, way = rule.rsplit(" ", 1)
        out.append(F.expr(e).desc() if way == "desc" else F.expr(e).asc())
    return [*out, F.col("ordinal")]


def ranked(items: DataFrame, strategy: str = "by_score", top: int = 5) -> DataFrame:
    """The best of each verdict; Spark keeps only ``top`` rows a task before it shuffles."""
    place = F.row_number().over(W.partitionBy("verdict").orderBy(*_order(strategy)))
    return items.withColumn("place", place).where(F.col("place") <= max(1, top))


def ranked_by_all(items: DataFrame, top: int = 5) -> DataFrame:
    """``ranked`` under every strategy at once: the items are computed once, a row per strategy carries its two sort keys."""
    keys = {
        "by_score": ("score", "0"),
        "by_language_ease": ("-language_friction_index", "score"),
        "by_reputation": ("company_reputation_index", "score"),
        "by_composite": ("2 * score + (100 - language_friction_index) + company_reputation_index", "0"),
    }
    each = ", ".join(f"struct('{s}' as strategy, cast({a} as int) as first_key, cast({b} as int) as second_key)" for s, (a, b) in keys.items())
    place = F.row_number().over(W.partitionBy("strategy", "verdict").orderBy(F.desc("first_key"), F.desc("second_key"), "ordinal"))
    return items.selectExpr("*", f"inline(array({each}))").withColumn("place", place).where(F.col("place") <= max(1, top))


def _aggregates() -> list[Column]:
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).cast("long").alias(v.lower())
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return [F.count("*").alias("jobs"), *[count(v) for v in VERDICTS], mean("score", "avg_score"), mean("language_friction_index", "avg_friction"), mean("company_reputation_index", "avg_reputation")]


def verdict_counts(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(*_aggregates())


def _named(items: DataFrame) -> DataFrame:
    name = F.when(F.trim(F.coalesce("company_name", F.lit(""))) == "", "Unknown Company").otherwise(F.trim("company_name"))
    return items.withColumn("shown", name).withColumn("company_key", F.lower("shown"))


def company_stats(items: DataFrame, *keys: str) -> DataFrame:
    """By company, whatever its case; the first spelling is shown, a blank name is an unknown company."""
    return _named(items).groupBy(*keys, "company_key").agg(*_aggregates(), F.min_by("shown", "ordinal").alias("company"))


def frequencies(items: DataFrame, column: str) -> DataFrame:
    """How many items show each entry of an array column."""
    return items.select(F.explode(column).alias("entry")).groupBy("entry").agg(F.count("*").alias("n"))


TREND = ("jobs", "go", "go_with_caution", "no_go", "avg_score", "avg_friction", "avg_reputation", "new", "updated", "removed")


def deltas(runs: DataFrame, scope: str, order: str, columns=TREND) -> DataFrame:
    """Each run beside the run before it in its scope."""
    before = W.partitionBy(scope).orderBy(order)
    present = [c for c in columns if c in runs.columns]
    return runs.select("*", *[(F.col(c) - F.lag(c).over(before)).alias(f"d_{c}") for c in present], *[F.lag(c).over(before).alias(f"p_{c}") for c in present])


def movers(items: DataFrame, is_current: str, top: int = 5) -> DataFrame:
    """Companies of both runs whose average score moved most; one pass over the items of both."""
    mean = lambda when: F.avg(F.when(when, F.col("score")))
    both = _named(items).groupBy("company_key").agg((mean(F.col(is_current)) - mean(~F.col(is_current))).alias("delta")).where("delta is not null")
    return both.orderBy(F.abs("delta").desc(), "company_key").limit(top).select("company_key", "delta")


# Fixed values: (code, severity, condition over a run and the run before it).
RUN_ALERTS = (
    ("NO_GO_JUMP", "CRITICAL", "d_no_go >= 3"),
    ("GO_DROP", "WARNING", "d_go <= -3"),
    ("AVG_SCORE_DROP", "WARNING", "d_avg_score <= -8.0"),
    ("LANGUAGE_FRICTION_SPIKE", "WARNING", "d_avg_friction >= 12.0"),
    ("REPUTATION_DROP", "WARNING", "d_avg_reputation <= -10.0"),
    ("UPDATED_SURGE", "INFO", "updated >= 10 and (p_updated <= 0 or updated >= 2 * p_updated)"),
)
COMPANY_ALERTS = (
    ("COMPANY_SCORE_DROP", "WARNING", "jobs >= 2 and p_jobs >= 2 and d_avg_score <= -12.0"),
    ("COMPANY_NO_GO_SPIKE", "WARNING", "no_go / jobs - p_no_go / p_jobs >= 0.4 and no_go >= 2"),
)


def alerts(compared: DataFrame, rules, keys: list[str]) -> DataFrame:
    """(keys..., severity, code) of every rule that holds; runs without a run before them raise nothing."""
    rules = [r for r in rules if "updated" not in r[2] or "updated" in compared.columns]
    found = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(s).alias("severity"), F.lit(k).alias("code"))) for k, s, c in rules]), lambda x: x.isNotNull())
    return compared.where("p_jobs is not null").select(*keys, F.explode(found).alias("a")).select(*keys, "a.*")
