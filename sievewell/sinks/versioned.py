"""Tables that are replaced whole or not at all: versions in folders, and a pointer that is switched by a rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


class Versioned:
    """A Parquet table below ``path``: ``v-<name>`` folders and ``_pointers/<number>-<name>``, the highest of which counts.

    A version is written in full before its pointer appears under its final name, by a
    rename, so that a crash leaves the old version readable and the new one unseen.
    Readers that have resolved a version keep it: ``keep`` older ones stay. One writer
    at a time is assumed; of two, the one that names the next number first wins and
    the other fails.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _pointers(self) -> list[tuple[int, str]]:
        where = self._at("_pointers")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n.split("-", 1)[0].isdigit())

    def version(self) -> str | None:
        """The name of the version that counts."""
        known = self._pointers()
        return known[-1][1] if known else None

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The current version; an empty table of ``schema`` if there is none yet."""
        name = self.version()
        if name is None:
            return None if schema is None else self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/v-{name}")

    def write(self, rows: DataFrame) -> str:
        """Writes a version that does not count yet; its name."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/v-{name}")
        return name

    def switch(self, name: str) -> None:
        """Makes a written version count, and drops versions that are too old, those of crashed writers among them."""
        known = self._pointers()
        if known and known[-1][1] == name:
            return
        number = known[-1][0] + 1 if known else 1
        draft, final = self._at(f"_draft-{name}"), self._at(f"_pointers/{number:012d}-{name}")
        self._fs.mkdirs(self._at("_pointers"))
        self._fs.create(draft, True).close()
        if any(n == number for n, _ in self._pointers()) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {number} of {self.path} was written meanwhile")
        old = known[: max(0, len(known) - self.keep)]
        for n, v in old:
            self._fs.delete(self._at(f"v-{v}"), True)
            self._fs.delete(self._at(f"_pointers/{n:012d}-{v}"), False)

    def replace(self, rows: DataFrame) -> None:
        self.switch(self.write(rows))

    def merge(self, rows: DataFrame, key: str, newest: str | None = None) -> None:
        """Rows replace those of the same key; of several with one key the last by ``newest``."""
        if newest:
            rows = rows.withColumn("_turn", F.row_number().over(W.partitionBy(key).orderBy(F.desc(newest)))).where("_turn = 1").drop("_turn")
        else:
            rows = rows.dropDuplicates([key])
        old = self.read()
        if old is not None:
            # ``rows`` is read twice, and may stand for requests: its own version is written once first.
            name = self.write(rows)
            fresh = self.spark.read.parquet(f"{self.path}/v-{name}")
            rows = fresh.unionByName(old.join(fresh.select(key), key, "left_anti"), allowMissingColumns=True)
            self.replace(rows)
            self._fs.delete(self._at(f"v-{name}"), True)
        else:
            self.replace(rows)
