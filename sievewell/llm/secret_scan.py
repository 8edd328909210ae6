"""Secret scan over a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams that every
match must contain. The index is a written table of postings (trigram, document)
for the trigrams that any rule asks for; it can be kept and searched again.
Intersecting postings gives each rule's candidate documents, and only those are
searched with the expression. A rule without mandatory trigrams searches every
document.
"""

from __future__ import annotations

from dataclasses import dataclass

import re._constants as sre
import re._parser as sre_parser
from pyspark.sql import Column, DataFrame, functions as F

from .common import of_ids, prepare, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and what a match must satisfy besides (SQL; MATCH and PATTERN stand for them)."""

    kind: str
    pattern: str
    condition: str = "true"


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]+"
BASE_RULES = (
    Rule("assign", _ASSIGN, "length(regexp_extract(MATCH, PATTERN, 2)) >= 6"),
    Rule("access", _ACCESS, "length(MATCH) >= 20"),
    # Runs are maximal, so a run of 24 or more is what is left of all runs.
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE_RULES = (
    # One class of characters, as Java recurses for each turn of a repeated group.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,500}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
_EXACT = 64  # strings that a part of an expression is expanded to at most


def _any_of(strings: set[str]) -> list[tuple[str, ...]]:
    """The trigram sets of the strings, without those that imply another one."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return sorted(tuple(sorted(x)) for x in sets if not any(y < x for y in sets))


def _strings(parsed) -> tuple[set[str] | None, list]:
    """(the finite set of lower-case strings the part matches or None, clauses that any match satisfies)."""
    runs, clauses = {""}, []

    def flush():
        if runs and all(len(s) >= 3 for s in runs):
            clauses.append(_any_of(runs))

    whole = True
    for op, arg in parsed:
        part, inner = None, []
        if op is sre.LITERAL:
            part = {chr(arg).lower()}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            part = {chr(a).lower() for _, a in arg}
        elif op is sre.SUBPATTERN:
            part, inner = _strings(arg[3])
        elif op is sre.BRANCH:
            each = [_strings(x) for x in arg[1]]
            if all(x[0] is not None for x in each):
                part = set().union(*(x[0] for x in each))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, of = arg
            one, inside = _strings(of)
            if one is not None and (low, high) == (0, 1):
                part = one | {""}
            elif low >= 1:
                inner = inside
        if part is not None and len(runs) * len(part) <= _EXACT:
            runs = {a + b for a in runs for b in part}
            continue
        flush()
        clauses.extend(inner)
        if part is not None:
            runs = set(part)
        else:
            runs = {""}
        whole = False
    if whole:
        return runs, []
    flush()
    return None, clauses


def trigram_query(pattern: str) -> list[list[tuple[str, ...]]]:
    """All of (any of (all of trigrams)) that a text with a match contains, in lower case. Empty: no query."""
    runs, clauses = _strings(sre_parser.parse(pattern))
    if runs is not None and all(len(s) >= 3 for s in runs):
        clauses = [_any_of(runs)]
    return clauses


def vocabulary(rules=RULES) -> list[str]:
    """The trigrams that any rule's query asks for: what the index holds."""
    return sorted({t for r in rules for clause in trigram_query(r.pattern) for alternative in clause for t in alternative})


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trigram_postings(docs: DataFrame, id_col: str, text_col: str, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id) of the inverted index, for the given trigrams."""
    low = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("low"))
    listed = ", ".join(map(_quoted, trigrams))
    return low.select("doc_id", F.explode(F.expr(f"filter(array({listed}), t -> contains(low, t))")).alias("trigram"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """The postings as a written table, for ``scan`` now or later. Rows without id have none."""
    prepare(docs.sparkSession)
    return written(trigram_postings(docs.where(F.col(id_col).isNotNull()), id_col, text_col, vocabulary(rules)), "secret-postings")


def candidates(postings: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose query the postings of a document satisfy; a document has at most as many postings as the vocabulary has trigrams."""
    has = postings.groupBy("doc_id").agg(F.collect_set("trigram").alias("trigrams"))
    found = []
    for r in rules:
        if query := trigram_query(r.pattern):
            holds = lambda alternative: f"size(array_except(array({', '.join(map(_quoted, alternative))}), trigrams)) = 0"
            found.append(F.when(F.expr(" and ".join(f"({' or '.join(map(holds, clause))})" for clause in query)), F.lit(r.kind)))
    return has.select("doc_id", F.array_compact(F.array(*found)).alias("kinds")).where(F.size("kinds") > 0)


_FOUND = "array<struct<start:int,place:int,end:int,kind:string,m:string>>"


def _running(array: str, step: str) -> str:
    """Running values of an array of ints, as ``step`` joins ``s`` and ``y``, block by block: an array of n takes about n * sqrt(n) cheap steps and no copy of what is already joined.

    ``transform(array(x), v -> ...)[0]`` names a value, so that it is computed once.
    """
    fold = lambda xs: f"aggregate({xs}, 0, (s, y) -> {step})"
    return f"""transform(array({array}), d -> transform(array(cast(ceil(sqrt(size(d))) as int)), w ->
        transform(array(transform(sequence(0, (size(d) - 1) div w), b -> slice(d, b * w + 1, w))), blocks ->
        transform(array(transform(blocks, x -> {fold('x')})), totals ->
        flatten(transform(blocks, (x, b) -> transform(array({fold('slice(totals, 1, b)')}), low ->
            transform(x, (z, i) -> aggregate(slice(x, 1, i + 1), low, (s, y) -> {step})))[0])))[0])[0])[0])[0]"""


def _spans(rule: Rule, order: int) -> str:
    """Leftmost non-overlapping matches in ``text``: the text split at them gives their places in code points."""
    pattern = _quoted(rule.pattern)
    condition = rule.condition.replace("MATCH", "m").replace("PATTERN", pattern)
    searched = f"array_contains(kinds, '{rule.kind}')" if trigram_query(rule.pattern) else "true"
    steps = "zip_with(slice(segments, 1, size(ms)), ms, (s, m) -> length(s) + length(m))"
    return f"""case when {searched} then transform(array(regexp_extract_all(text, {pattern}, 0)), ms -> case when size(ms) = 0 then cast(array() as {_FOUND}) else
        transform(array(split(text, {pattern}, -1)), segments -> filter(zip_with({_running(steps, 's + y')}, ms,
            (e, m) -> case when {condition} then struct(e - length(m) as start, {order} as place, e as end, '{rule.kind}' as kind, m as m) end), x -> x is not null))[0] end)[0]
        else cast(array() as {_FOUND}) end"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, carry: tuple[str, ...] = (), index: DataFrame | None = None) -> DataFrame:
    """One row (doc_id, text, found and the carried columns) per input row; ``found`` is an array of (start, place, end, kind, m) by start, then rule.

    Offsets count code points, the end is exclusive. Null texts count as empty and
    hold nothing; repeated rows each give a row; a row without id has no postings
    and is searched by every rule; rows of one id are searched by the rules that any
    of them asks for; other columns are not read; an empty table gives an empty
    result. ``index`` is what ``build_index`` gave for the same texts.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    if index is None:
        index = build_index(texts, rules=rules)
    listed = written(candidates(index, rules), "secret-candidates")
    every = F.array(*[F.lit(r.kind) for r in rules])
    both = of_ids(texts, listed, "doc_id", "left").withColumn("kinds", F.when(F.col("doc_id").isNull(), every).otherwise(F.col("kinds")))
    spans = F.expr(f"array_sort(concat({', '.join(_spans(r, i) for i, r in enumerate(rules))}))")
    return both.select("doc_id", "text", *carry, spans.alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the spans as text and as a digest."""
    joined = lambda which: F.expr(f"array_join(transform(filter(found, x -> {which}), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")
    count = lambda kind: F.expr(f"cast(size(filter(found, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(joined(f"x.place < {len(BASE_RULES)}"), 256).alias("base_sha256"), joined("true").alias("spans"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The scanned rows, without ``found``, with every found span replaced; overlapping spans are replaced together.

    The text is cut into characters once; each span that none before it reaches
    gives the characters since their ends, and a mark.
    """
    reached = _running("transform(found, x -> x.end)", "greatest(s, y)")
    kept = f"""transform(array(split(text, '')), chars -> transform(array({reached}), ends -> concat(
        array_join(transform(found, (x, i) -> transform(array(case when i = 0 then 0 else ends[i - 1] end), low ->
            case when x.start >= low then concat(array_join(slice(chars, low + 1, x.start - low), ''), {_quoted(mark)}) else '' end)[0]), ''),
        array_join(slice(chars, ends[size(ends) - 1] + 1, size(chars)), '')))[0])[0]"""
    return scanned.withColumn("text", F.expr(f"case when size(found) = 0 then text else {kept} end")).drop("found")


def _duckdb_spans(order: int, kind: str, pattern: str, condition: str) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""
    select doc_id, rid, {order} as place, '{kind}' as kind,
        (list_sum(list_transform(segs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::bigint as s, length(ms[i]) as n
    from (select doc_id, rid, ms, string_split_regex(t, {p}) as segs, unnest(range(1, len(ms) + 1)) as i
          from (select doc_id, rid, t, regexp_extract_all(t, {p}) as ms from docs) where len(ms) > 0)
    where {condition}"""


def oracle() -> str:
    """DuckDB SQL with the rows of ``digest(scan(documents))``."""
    conditions = {r.kind: r.condition.replace("MATCH", "ms[i]").replace("PATTERN", "'" + r.pattern.replace("'", "''") + "'") for r in RULES}
    parts = " union all ".join(_duckdb_spans(i, r.kind, r.pattern, conditions[r.kind]) for i, r in enumerate(RULES))
    return f"""
with docs as (select doc_id, row_number() over () as rid, coalesce(text, '') as t from documents),
spans as ({parts}),
grouped as (
    select rid, {', '.join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in BASE_RULES)},
        string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, place) filter (place < {len(BASE_RULES)}) as base,
        string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, place) as spans
    from spans group by rid)
select doc_id, {', '.join(f"coalesce(n_{r.kind}, 0)::bigint as n_{r.kind}" for r in BASE_RULES)},
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join grouped using (rid)"""
