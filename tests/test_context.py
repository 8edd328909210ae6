"""Contexts of companies, and numbers of frequent keys."""

import random

from pyspark.sql import functions as F

from sievewell.operators.company_context import tracked_names, with_context
from sievewell.operators.evaluation import evaluate
from sievewell.operators.numbering import numbered
from sievewell.operators.settings import PERSONAS
from sievewell.sources.context_files import flattened, read_contexts
from sievewell.sources.yaml_files import ordered


def test_yaml_contexts_are_flattened():
    text = """
company_name: ' Kita '
summaries: [Ships a product, SHIPS A PRODUCT, 7, '']
sources:
- {page_title: Careers, page_description: We hire}
- not a page
links: [{title: careers}, {title: Blog}, {url: x}]
other: left out
"""
    assert flattened(text) == "Kita Ships a product Careers We hire Blog"
    assert flattened("plain words") == "plain words" and flattened(" \n") == "" and flattened("company_name: [a]\nsummaries: x") == ""


def test_first_extension_counts_and_bad_files_warn(spark, tmp_path):
    for name, text in {"a.yaml": "summaries: [one]", "a.txt": "two", "b.yml": "summaries: [three]", "b.txt": "four", "c.txt": "five: [", "d.yaml": "x: [", "d.txt": "six", "e.md": "no", "f.yaml": "", "g.yaml": "[]", "g.txt": "seven"}.items():
        (tmp_path / name).write_text(text)
    rows = {r["company"]: r for r in read_contexts(spark, f"file://{tmp_path}").collect()}
    assert {k: r["context"] for k, r in rows.items()} == {"a": "one", "b": "three", "c": "five: [", "d": "", "g": "[]"}
    assert [k for k, r in rows.items() if r["warning"]] == ["d"]


def test_the_first_company_that_fits_by_brute_force(spark):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("ab A\t") for _ in range(draw.randrange(n)))
    names, known = [text(9) for _ in range(120)] + [None, "", "zzz", "x" * 5000 + "ab"], [text(7) for _ in range(40)] + [None, " ", "y" * 3000]
    norm = lambda s: (s or "").strip("".join(map(chr, range(33)))).lower()
    want = {norm(n): min((i for i, k in enumerate(known) if norm(k) and (norm(k) in norm(n) or norm(n) in norm(k))), default=None) for n in names if norm(n)}
    got = tracked_names(spark.createDataFrame([(n,) for n in names], "company_name string"), spark.createDataFrame(list(enumerate(known)), "ordinal long, company_name string"))
    assert {r["name"]: r["ordinal"] for r in got.collect()} == {n: i for n, i in want.items() if i is not None}
    empty = spark.createDataFrame([], "ordinal long, company_name string")
    assert tracked_names(empty, got.selectExpr("ordinal", "name as company_name")).count() == 0 == tracked_names(got.selectExpr("name as company_name"), empty).count()


def test_context_decides(spark):
    columns = "company_name string, title string, salary_range string, remote_policy string, description string"
    jobs = spark.createDataFrame([("Kita KK", "Engineer", "TBD", "Hybrid", ""), (None, "Engineer", "TBD", "Hybrid", "")], columns)
    companies = spark.createDataFrame([(1, "Nami", "Nami"), (2, " Kita & Co ", "kita")], "ordinal int, company_id string, company_name string")
    told = spark.createDataFrame([("kita-co", "English-first team with a tech blog."), ("unknown", "never")], "company string, context string")
    rows = with_context(jobs, companies, told)
    assert [r["company_context"] for r in rows.orderBy(F.col("company_name").isNull()).collect()] == ["English-first team with a tech blog.", ""]
    with_it, without = (evaluate(rows, PERSONAS[0], context=c).where("company_name is not null").first()["positive_signals"] for c in ("company_context", None))
    assert set(with_it) > set(without)


def test_numbers_of_frequent_keys(spark):
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"k{i % 7}", None if i == 5 else i) for i in range(3000)]
    random.Random(1).shuffle(rows)
    got = numbered(spark.createDataFrame(rows, "key string, place int"), ("key",), "place", range_rows=50)
    want, seen = {}, {}
    for key, place in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        seen[key] = want[(key, place)] = seen.get(key, 0) + 1
    assert {(r["key"], r["place"]): r["turn"] for r in got.collect()} == want
    assert [f.name for f in got.schema] == ["key", "place", "turn"]
    assert numbered(got.select("key", "place").limit(0), ("key",), "place").count() == 0
    same = numbered(spark.range(500).selectExpr("1 as key", "id % 2 as place"), ("key",), "place", range_rows=10)
    assert sorted(r["turn"] for r in same.collect()) == list(range(1, 501))
    texts = spark.range(2000).selectExpr("sha2(cast(id as string), 256) as path")
    places = [r["path"] for r in numbered(texts, (), "path", "ordinal", range_rows=100).orderBy("ordinal").collect()]
    assert places == sorted(places)


def test_files_are_numbered_by_path(spark):
    files = spark.createDataFrame([("b", "x"), ("a", "y")], "source_file string, raw_text string")
    assert {r["source_file"]: r["ordinal"] for r in ordered(files).collect()} == {"a": 1, "b": 2}
