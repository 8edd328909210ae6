"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for every operator and stage."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewell.llm import byte_bpe, packing, secret_scan
from sievewell.llm.additive_ann import nearest
from sievewell.llm.embedding_near_dup import near_duplicates
from sievewell.llm.html_text import extract, parse, subtree_hashes
from sievewell.llm.quality import score_documents
from sievewell.llm.suffix_dedup import remove_repeats
from sievewell.llm.token_group_join import jaccard_components
from sievewell.llm.toxicity import toxicity

LONG = "seldom said words and other " * 6000
_EXTRA = ", cast(1 as int) as row, 'x' as found, 0.5D as score, 'y' as n, 'z' as node, 7L as token, array(1) as x, 'q' as shard, 'u' as kinds"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "one two three four five six seven"), (4, LONG), (5, LONG), (6, "a"), (6, "another text of this id"), (None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *_EXTRA[2:].split(", "))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (6, 1, 0), (None, 1, 1), (4, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "pack": lambda d, labels: packing.pack(packing.token_pieces(d)).where("piece = 0"),
    "toxicity": toxicity,
    "secrets": lambda d, labels: secret_scan.digest(secret_scan.scan(d)),
    "redact": lambda d, labels: secret_scan.redact(secret_scan.scan(d)),
    "repeats": lambda d, labels: remove_repeats(d, passage_counts=True),
    "bpe": lambda d, labels: byte_bpe.decode(byte_bpe.encode(d)),
    "quality": score_documents,
    "jaccard": lambda d, labels: jaccard_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gives_a_row(spark, documents, labels, name):
    got = OPERATORS[name](documents, labels)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.select("doc_id").collect())
    assert ids == sorted((i is None, i or 0) for i in [1, 1, 2, 3, None, 4, 5, 6, 6, None])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table_gives_an_empty_result(documents, labels, name):
    assert OPERATORS[name](documents.where("false"), labels).count() == 0


def test_results_on_edges(spark, documents):
    rows = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard_components(documents).collect()}
    assert rows[(1, 5)] == 1 and rows[(5, 5)] == 4 and rows[(None, 5)] is None and rows[(2, 0)] == 2 and rows[(6, 1)] == 6 and rows[(6, 3)] == 6
    kept = {(r["doc_id"], r["n_bytes"]): r for r in remove_repeats(documents, passage_counts=True).collect()}
    assert kept[(4, len(LONG))]["n_removed"] == len(LONG) and kept[(5, len(LONG))]["n_passages"] == 1 and kept[(1, 33)]["n_removed"] == 0 and kept[(2, 0)]["n_spans"] == 0


def test_passages_of_over_50_words_below_400_bytes_are_told_and_stay(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    passage = " ".join(word() for _ in range(52))
    own = lambda: " ".join(word() for _ in range(80))
    docs = spark.createDataFrame([(1, f"{own()} {passage} {own()}"), (2, f"{own()} {passage} {own()}"), (3, own())], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in remove_repeats(docs, passage_counts=True).collect()}
    assert len(passage) < 400 and all(rows[i]["n_passages"] == 1 and rows[i]["n_removed"] == 0 for i in (1, 2)) and rows[3]["n_passages"] == 0


@pytest.mark.parametrize("text", ["password=abcdef12 " * 100_000, "-----BEGIN " + "A " * 100_000, "eyJ" * 100_000], ids=["matches", "header", "prefixes"])
def test_secrets_in_hostile_texts(spark, text):
    scanned = secret_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = secret_scan.digest(scanned).first()
    want = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"password=[a-z0-9]+", text))
    assert row["spans"] == want
    assert secret_scan.redact(scanned).first()["text"] == re.sub(r"password=[a-z0-9]+", "[SECRET]", text)


def test_more_rules_than_63_trigrams_and_a_kept_index(spark):
    rules = tuple(secret_scan.Rule(f"k{i}", f"key{i}word{chr(97 + i)}{chr(98 + i)}=[0-9]+") for i in range(20))
    assert len(secret_scan.vocabulary(rules)) > 63
    docs = spark.createDataFrame([(i, f"x key{i}word{chr(97 + i)}{chr(98 + i)}=42 y") for i in range(20)], "doc_id long, text string")
    index = secret_scan.build_index(docs, rules=rules)
    found = {r["doc_id"]: [f["kind"] for f in r["found"]] for r in secret_scan.scan(docs, rules=rules, index=index).collect()}
    assert found == {i: [f"k{i}"] for i in range(20)}


def test_crossover_betters_best_fit_where_a_gap_is():
    rng = np.random.default_rng(3)
    sizes = []
    for _ in range(60):
        a = int(rng.integers(778, 1003))
        b = int(rng.integers(513, (2048 - a) // 2))
        sizes += [a, b, 2048 - a - b]
    falling = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    plain = len(packing.best_fit(falling, sizes, 2048)[0])
    genome = packing.evolve(sizes, 2048, [1, 0, 0], [None])
    fill = np.bincount(genome, weights=sizes)
    assert fill.max() <= 2048 and max(genome) + 1 < plain


@pytest.mark.parametrize("size", [700, 1025, 2048, 1])
def test_packing_of_equal_sizes(spark, size):
    pieces = spark.range(50).selectExpr("id as doc_id", "0 as piece", "0L as start", f"{size}L as length", "0L as ids_crc32")
    rows = packing.pack(pieces).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("o")).collect()
    assert sum(r["k"] for r in rows) == 50 and all(r["n"] <= 2048 and r["k"] == r["o"] for r in rows)
    assert len(rows) == math.ceil(50 / (2048 // size))


@pytest.fixture(scope="module")
def vectors(spark):
    same = [1.0, 0.0, 0.0, 0.5]
    rows = [(i, same, 1) for i in range(30)] + [(30, same, 2), (31, None, 1), (32, [0.0] * 4, 1), (33, [float("nan"), 1.0, 1.0, 1.0], 1), (34, [0.0, 1.0, 0.0, 0.0], 1), (34, [0.0, 1.0, 0.0, 0.0], 1), (35, same, None), (36, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("z")).withColumn("block", F.lit(1))


def test_equal_vectors_and_invalid_ones(spark, vectors):
    rows = {r["vec_id"]: r for r in near_duplicates(vectors).collect()}
    assert len(rows) == 37 and all(rows[i]["n_links"] == 29 and rows[i]["component_id"] == 0 and rows[i]["kept"] == (i == 0) for i in range(30))
    assert all(rows[i]["n_links"] == 0 and rows[i]["component_id"] == i for i in range(30, 37))
    found = nearest(vectors, vectors.where("vec_id in (0, 31)"), k=10).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == list(range(1, 11)) and {r["query_id"] for r in found} == {0} and all(r["score"] == 0 for r in found)
    assert near_duplicates(vectors.where("false")).count() == 0 and nearest(vectors.where("false"), vectors, k=3).count() == 0


def test_templates_go_from_pages_without_telling_tags_or_classes(spark):
    box = "<div><ul><li>Start</li><li>All we sell</li></ul></div>"
    page = lambda i, extra="": f"<html><body>{box}<div><p>Text number {i} of its own.</p></div>{extra}</body></html>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(5)] + [(5, "https://other.example/1", page(9)), (6, None, None), (7, "https://h.example/7", ""), (7, "https://h.example/7", page(7))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3)).withColumn("host", F.lit("a"))
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in extract(pages).collect()}
    assert len(got) == 9 and all(got[(i, 25)] == f"Text number {i} of its own." for i in range(5)) and "All we sell" in got[(5, 43)] and got[(6, 0)] == ""
    assert extract(pages.where("false")).count() == 0


def test_deep_nesting_is_hashed_once():
    page = "<div>" * 3000 + "x" + "</div>" * 3000
    hashes = subtree_hashes(page, parse(page))
    assert len(set(hashes.values())) >= 3000


def test_stages_on_edges(spark, documents, labels, tmp_path):
    import corpus_pipeline

    columns = documents.select("doc_id", "text").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows, some in ((columns, True), (columns.where("false"), False)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, str(tmp_path))
            assert (out.count() > 0) == some, name
            if name != "packing":
                assert out.columns == columns.columns


def test_packing_joins_what_shards_leave(spark):
    """Three pieces of 600 fill a bin badly, so no round gets better: the rest of each shard must still be put together."""
    pieces = spark.range(120).selectExpr("id as doc_id", "0 as piece", "0L as start", "600L as length", "0L as ids_crc32")
    rows = packing.pack(pieces, shard_pieces=20).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("o")).collect()
    assert sum(r.k for r in rows) == 120 and all(r.n <= 2048 and r.k == r.o for r in rows)
    assert len(rows) == 40
