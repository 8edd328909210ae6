"""What the token-group join leaves on disk and what it shuffles."""

import os
import random
import time

import pytest

from sievewell.llm import token_group_join


def _shuffled(spark):
    """Sizes of the shuffle files that lie on this machine's disk, by path."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    paths = [os.path.join(at, f) for d in folders for at, _, files in os.walk(d.getPath()) for f in files if f.startswith("shuffle_") and f.endswith(".data")]
    return {p: os.path.getsize(p) for p in paths if os.path.exists(p)}


@pytest.fixture
def unbroadcast(spark):
    """Small tables are shuffled as large ones are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_steps_take_their_shuffles_with_them(unbroadcast, monkeypatch):
    spark, rng, left = unbroadcast, random.Random(8), []
    base = [[f"w{rng.randrange(5000)}" for _ in range(150)] for _ in range(100)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:70], f"x{j}", *b[71:]]) for b in base for j in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before, setting = _shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(setting) == "false"

    def components(links, known=token_group_join.connected_components):
        until = time.time() + 5
        while (size := sum(v for p, v in _shuffled(spark).items() if p not in before)) > 10_000 and time.time() < until:
            time.sleep(0.1)
        left.append(size)
        return known(links)

    monkeypatch.setattr(token_group_join, "connected_components", components)
    got = {r.doc_id: r.component_id for r in token_group_join.jaccard_components(docs).collect()}
    assert got == {i: i if i < 100 else (i - 100) // 3 for i in range(400)}
    assert left and left[0] <= 10_000  # of counts only
    assert spark.conf.get(setting) == "false"


def test_sets_that_no_pair_has_are_not_shuffled(unbroadcast, tmp_path):
    spark, rng = unbroadcast, random.Random(9)
    hashes = [sorted(rng.getrandbits(64) - 2**63 for _ in range(200)) for _ in range(1000)]
    hashes[7] = sorted([*hashes[3][:-1], 5])
    for name, rows, schema in (("sets", list(enumerate(hashes)), "node long, shingles array<long>"), ("pairs", [(3, 7), (3, 8), (990, 991)], "u long, v long")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    before = _shuffled(spark)
    links = token_group_join._linked(spark.read.parquet(f"{tmp_path}/pairs"), spark.read.parquet(f"{tmp_path}/sets"), 9, 10)
    assert [tuple(r) for r in links.select("u", "v").collect()] == [(3, 7)]
    assert sum(v for p, v in _shuffled(spark).items() if p not in before) < 100_000  # all sets are 1.6 MB
