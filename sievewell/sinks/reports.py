"""Reports of a run: JSON lines, Markdown, digest, states, trend history, alerts.

Items are rendered where they are: a report of a run is a folder of text files
written by the tasks. Only a digest, a few rows per section, is a single file.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import reports

ITEM = (
    "source_file company title location salary_range remote_policy verdict score raw_score language_friction_index company_reputation_index job_key change_status"
    " raw_score_range hard_reject_reasons positive_signals risk_signals reasoning human_reading"
).split()
_DEFAULTS = {
    "source_file": "''", "company": "''", "title": "''", "location": "''", "salary_range": "''", "remote_policy": "''", "verdict": "''", "score": "0", "raw_score": "0", "language_friction_index": "0", "company_reputation_index": "0",
    "job_key": "''", "change_status": "''", "hard_reject_reasons": "array()", "positive_signals": "array()", "risk_signals": "array()", "reasoning": "array()",
}
ITEM_SCHEMA = (
    "source_file string, company string, title string, location string, salary_range string, remote_policy string, verdict string, score int, raw_score int, language_friction_index int, company_reputation_index int,"
    " job_key string, change_status string, raw_score_range struct<min:int,max:int>, hard_reject_reasons array<string>, positive_signals array<string>, risk_signals array<string>, reasoning array<string>,"
    " human_reading struct<access_fit:string,execution_fit:string,domain_fit:string,opportunity_quality:string,interview_roi:string,summary:string,why_still_interesting:array<string>,why_waste_of_time:array<string>>"
)


def report_items(evaluated: DataFrame, score_range: tuple[int, int]) -> DataFrame:
    """Evaluated and read postings with job_key and change_status, in the order of a report's fields."""
    reading = F.struct("access_fit", "execution_fit", "domain_fit", "opportunity_quality", "interview_roi", "summary", "why_still_interesting", "why_waste_of_time").alias("human_reading")
    span = F.struct(F.lit(score_range[0]).alias("min"), F.lit(score_range[1]).alias("max")).alias("raw_score_range")
    return evaluated.withColumn("company", F.col("company_name")).select(*ITEM[:13], span, "hard_reject_reasons", "positive_signals", "risk_signals", "reasoning", reading)


def write_batch_json(items: DataFrame, path: str) -> None:
    """One JSON object per item, with null fields kept, in text files below ``path``."""
    items.select(F.to_json(F.struct(*ITEM), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_batch_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, errors): missing fields get their defaults; lines that are no JSON objects are errors."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", f"{ITEM_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("item"))
    bad = F.col("item").isNull() | F.col("item._corrupt").isNotNull()
    good = parsed.where(~bad).select("item.*").drop("_corrupt")
    whole = good.select(*[F.coalesce(F.col(c), F.expr(f"cast({_DEFAULTS[c]} as {good.schema[c].dataType.simpleString()})")).alias(c) if c in _DEFAULTS else F.col(c) for c in good.columns])
    return whole, parsed.where(bad).select(F.col("value").alias("line"), F.lit("Invalid JSON item.").alias("error"))


def _inline(column: str) -> Column:
    return F.when(F.size(column) > 0, F.array_join(column, ", ")).otherwise("none")


def item_markdown() -> Column:
    """A posting's part of a batch report."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    raw = F.format_string("%d (range %d..%d)", "raw_score", "raw_score_range.min", "raw_score_range.max")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.concat_ws(" - ", "verdict", "company", "title")),
        F.lit(""),
        line("source_file", F.col("source_file")),
        line("change_status", F.coalesce("change_status", F.lit(""))),
        line("score", F.concat(F.col("score").cast("string"), F.lit("/100"))),
        line("raw_score", raw),
        line("language_friction_index", F.concat(F.col("language_friction_index").cast("string"), F.lit("/100"))),
        line("company_reputation_index", F.concat(F.col("company_reputation_index").cast("string"), F.lit("/100"))),
        line("human_summary", F.coalesce("human_reading.summary", F.lit(""))),
        *[line(c, _inline(c)) for c in ("positive_signals", "risk_signals", "hard_reject_reasons")],
        F.lit(""),
    )


def write_batch_markdown(items: DataFrame, path: str) -> None:
    """The items' parts, in the order of their files, as text files below ``path``."""
    items.withColumn("value", item_markdown()).repartitionByRange("source_file", "job_key").sortWithinPartitions("source_file", "job_key").select("value").write.mode("overwrite").text(path)


def weekly_digest(items: DataFrame, errors: DataFrame | None = None, head: dict[str, str] | None = None, strategy: str = "by_score", top: int = 5) -> str:
    """The digest as Markdown: counts, the best of each verdict, what signals and reasons occur; a few rows are collected."""
    items = items.withColumn("ordinal", F.col("source_file"))
    counts = reports.verdict_counts(items).first()
    best = reports.ranked(items, strategy, top).orderBy("verdict", "place").collect()
    failed = errors.groupBy().count().first()[0] if errors is not None else 0
    out = ["# Weekly Digest", "", *[f"- {k}: {v}" for k, v in (head or {}).items()], "", "## Summary", "", f"- evaluated: {counts['jobs']}", f"- parsing_errors: {failed}"]
    out += [f"- {v.lower()}: {counts[v.lower()] or 0}" for v in reports.VERDICTS] + [""]
    listed = lambda xs: ", ".join(xs) if xs else "none"
    for verdict, title in zip(reports.VERDICTS, ("Top GO", "GO With Caution", "NO_GO Highlights")):
        out += [f"## {title}", ""]
        rows = [r for r in best if r["verdict"] == verdict]
        for r in rows:
            out += [f"### {r['place']}. {r['company']} - {r['title']}", "", f"- source_file: {r['source_file']}", f"- score: {r['score']}/100"]
            out += [f"- raw_score: {r['raw_score']} (range {r['raw_score_range']['min']}..{r['raw_score_range']['max']})", f"- language_friction_index: {r['language_friction_index']}/100", f"- company_reputation_index: {r['company_reputation_index']}/100"]
            out += [f"- {c}: {listed(r[c])}" for c in ("positive_signals", "risk_signals", "hard_reject_reasons")] + [f"- why: {(r['reasoning'] or [''])[0]}", ""]
        out += [] if rows else ["No entries.", ""]
    out += ["## Aggregated Signals", ""]
    for column in ("risk_signals", "hard_reject_reasons"):
        rows = reports.frequencies(items, column).orderBy(F.desc("n"), "entry").collect()
        out += [f"### {column}", "", *([f"- {r['entry']}: {r['n']}" for r in rows] or ["No entries."]), ""]
    return "\n".join(out)


def write_state(keyed: DataFrame, path: str) -> None:
    """The snapshot's state, sorted by key, over the one before."""
    state = keyed.select("job_key", "source_file", F.col("company_name").alias("company"), "title", "location", "fingerprint")
    state.repartitionByRange("job_key").sortWithinPartitions("job_key").write.mode("overwrite").parquet(path)


def append_history(history: DataFrame | None, run: DataFrame, scope: str, order: str, runs: int = 26) -> DataFrame:
    """The history with a run more, the last ones of each scope kept."""
    from ..operators.snapshots import retained

    return retained(run if history is None else history.unionByName(run, allowMissingColumns=True), scope, order, runs)


def alert_sink(kind: str):
    """What to do with (severity, code, message) rows: ``none``, ``stdout`` (all of them, a partition at a time on the driver) or ``json-file``."""
    if kind == "none":
        return lambda alerts, path=None, head=None: "No alert is sent."
    if kind == "stdout":

        def show(alerts: DataFrame, path: str | None = None, head: dict | None = None) -> str:
            shown = 0
            for r in alerts.select("severity", "code", "message").toLocalIterator():
                print(f"[{r['severity']}] {r['code']}: {r['message']}")
                shown += 1
            return f"{shown} alerts are shown."

        return show
    if kind == "json-file":

        def write(alerts: DataFrame, path: str, head: dict | None = None) -> str:
            each = F.struct("severity", "code", "message")
            alerts.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (head or {}).items()], each.alias("alert"))).alias("value")).write.mode("overwrite").text(path)
            return f"Alerts are written to {path}."

        return write
    raise ValueError(f"Unknown alert sink: {kind}")


