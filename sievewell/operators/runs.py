"""A run over a snapshot of postings as one unit: what changed, only that evaluated, state, history, alerts.

Everything that a run writes lies in a folder of its name. One rename makes it count, so
that a run that died half-way has changed nothing and is simply made again, and one
that counts already is not made twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..sinks.versioned import Versioned
from . import reports, snapshots
from .evaluation import RESULT, evaluate
from .settings import BLACKLIST, COMPANIES, Persona

#: Runs that the history keeps.
HISTORY_RUNS = 26
_POSTING = ["ordinal", "source_file", "company_name", "title", "location", "salary_range", "remote_policy", "description"]
SUMMARY = "run string, number long, evaluated long, new long, updated long, unchanged long, removed long, jobs long, go long, go_with_caution long, no_go long, avg_score double, avg_friction double, avg_reputation double"


class Runs:
    """The runs of one scope (a persona over a source) below ``home``."""

    def __init__(self, spark: SparkSession, home: str, persona: Persona, companies=COMPANIES, blacklist=BLACKLIST, keep: int = 3):
        self.spark, self.persona, self.companies, self.blacklist = spark, persona, companies, blacklist
        self.versions = Versioned(spark, home, keep)

    def _path(self, run: str, table: str) -> str:
        return f"{self.versions.path}/v-{run}/{table}"

    def table(self, name: str, run: str | None = None) -> DataFrame | None:
        """``state``, ``changes``, ``items``, ``standing``, ``history`` or ``alerts`` of a run, of the last one if none is named; null before the first."""
        run = run or self.versions.version()
        return None if run is None else self.spark.read.parquet(self._path(run, name))

    def _written(self, rows: DataFrame, run: str, table: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path(run, table))
        return self.spark.read.schema(rows.schema).parquet(self._path(run, table))

    def run(self, postings: DataFrame, name: str, incremental: bool = True) -> dict:
        """Makes the run ``name`` (letters, digits, dashes) over a whole snapshot; its summary.

        Postings have a unique ordinal. Only new and updated ones are evaluated if
        ``incremental``; the others stand as the run before has judged them. A name
        that the history has gives its stored summary and changes nothing.
        """
        if not name.replace("-", "").isalnum():
            raise ValueError("a run is named by letters, digits and dashes")
        last = self.versions.version()
        history = self.table("history", last) if last else self.spark.createDataFrame([], SUMMARY)
        if done := history.where(F.col("run") == name).first():
            return done.asDict()
        number = (history.agg(F.max("number")).first()[0] or 0) + 1

        state = self._written(snapshots.keyed(postings.select(_POSTING)), name, "state")
        before = self.table("state", last) if last else state.limit(0)
        # Counts are taken while the tables are written.
        statuses = Observation("changes")
        count = lambda s: F.coalesce(F.sum((F.col("change_status") == s).cast("long")), F.lit(0)).alias(s.lower())
        changes = self._written(snapshots.diff(state, before).observe(statuses, *map(count, ("NEW", "UPDATED", "UNCHANGED", "REMOVED"))), name, "changes")
        told = changes.where("change_status <> 'REMOVED'").select("job_key", "change_status")
        chosen = state.join(told.where("change_status <> 'UNCHANGED'") if incremental else told, "job_key")
        judged = evaluate(chosen.select(*_POSTING, "job_key", "fingerprint", "change_status"), self.persona, self.companies, self.blacklist)
        measured = Observation("items")
        means = lambda c, n: F.coalesce(F.avg(c), F.lit(0.0)).alias(n)
        verdict = lambda v: F.coalesce(F.sum((F.col("verdict") == v).cast("long")), F.lit(0)).alias(v.lower())
        items = self._written(judged.drop("description").observe(measured, F.count("*").alias("jobs"), *map(verdict, reports.VERDICTS), means("score", "avg_score"), means("language_friction_index", "avg_friction"), means("company_reputation_index", "avg_reputation")), name, "items")

        results = ["job_key", "fingerprint", "company_name", "title", *RESULT]
        standing = items.select(results)
        if incremental and last:
            kept = self.table("standing", last).join(told.where("change_status = 'UNCHANGED'").select("job_key"), "job_key", "left_semi")
            standing = standing.unionByName(kept)
        self._written(standing, name, "standing")

        row = {"run": name, "number": number, "evaluated": measured.get["jobs"], **statuses.get, **measured.get}
        mine = self.spark.createDataFrame([row], SUMMARY)
        runs = self._written(history.unionByName(mine).where(F.col("number") > number - HISTORY_RUNS), name, "history")
        compared = reports.deltas(runs.where(F.col("number") >= number - 1).withColumn("scope", F.lit(self.persona.name)), "scope", "number")
        self._written(reports.alerts(compared.where(F.col("number") == number), reports.RUN_ALERTS, ["run"]), name, "alerts")
        self.versions.switch(name)
        return mine.first().asDict()
