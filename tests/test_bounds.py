"""What a worker holds at once, and what is looked for in one pass."""

import random
import re

import pyarrow as pa

from sievewell import session
from sievewell.functions.dialect import SPARK, Marked, Worded, literals_of
from sievewell.functions.marks import Marker
from sievewell.operators import snapshots
from sievewell.operators.evaluation import evaluate
from sievewell.operators.settings import PERSONAS
from sievewell.sources import page_tree, postings


def test_facts_are_made_in_batches_of_bounded_markup():
    page = "<article><h3><a href='/jobs/1'>Platform Engineer</a></h3>" + "<p>Requirements: patience.</p>" * 4000 + "</article>"
    pages = [page] * 30 + [None, "", page * 20, "<p>x</p>"]
    rows = pa.RecordBatch.from_pydict({"page_id": list(range(len(pages))), "p_url": ["https://a.example/"] * len(pages), "p_html": pages})
    sizes = []
    for out in page_tree._facts(iter([rows])):
        held = [len(pages[i] or "") for i in out.column("page_id").to_pylist()]
        assert len(held) == 1 or sum(held) <= page_tree.BATCH_BYTES
        sizes.append(len(held))
    assert sum(sizes) == len(pages) and len(sizes) >= 4


def test_pages_come_to_workers_in_batches_of_few_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(0, 60, 1, 1).selectExpr("id as page_id", "'https://a.example/' as url", "repeat('<p>patience</p>', 35000) as html")
    page_tree.page_facts(pages)

    def sizes(batches):
        for rows in batches:
            yield pa.RecordBatch.from_pydict({"size": [rows.column("html").nbytes]})

    got = [r.size for r in pages.mapInArrow(sizes, "size long").collect()]
    assert sum(got) >= 60 * 35000 * 15 and max(got) <= session.BATCH_BYTES + 35000 * 15 + 1000


def test_marks_tell_what_searches_tell():
    rnd = random.Random(5)
    words = [("go", True), ("ab", False), ("abc", True), ("abcd", False), ("abcd", True), ("a_b", True), ("日本語", False), ("tech blog", False), ("aaaa", False), ("aaaaa", True), *((f"w{i}", True) for i in range(120))]
    texts = ["", None, "go", "日本語go", "w7", "goab", *("".join(rnd.choice("aabbcdgo_ 日本語é-w7") for _ in range(rnd.randrange(60))) for _ in range(400)), "a tech blog", "日本", "語", "w119 w63 w62"]
    want = [sum(1 << i for i, (w, whole) in enumerate(words) if (re.search(rf"(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])", t or "") if whole else w in (t or ""))) for t in texts]
    for some in (pa.array(texts), pa.array(["abcd", *texts], pa.large_string())[1:]):
        assert [sum(m << 63 * i for i, m in enumerate(row)) for row in Marker(words)(some).to_pylist()] == want
    assert Marker(words)(pa.array([], pa.string())).to_pylist() == []


def test_patterns_are_guarded_by_all_that_their_matches_hold():
    assert literals_of(r"\bjapanese\b.{0,24}\b(must|mandatory)\b") == [("japanese",), ("must", "mandatory")]
    assert literals_of(r"\bn[12]\s*(or\s*above|\+)\b") == [("n1", "n2")]
    assert literals_of(r"customers?\s(?:of ours)?[ab]{0,1}(?!not)here") == [("customer",), ("here",)]
    assert literals_of(r"one|two") == literals_of(r"(?i)three") == []


def test_words_of_texts_are_marked_not_searched_one_by_one(spark, sf_dir="/root/testdata/sf0.001"):
    d = Marked()
    assert d.any_of("txt", ("seed", "series a")).count("contains(") == 0 and Worded().any_of("txt", ("seed", "series a")).count("contains(") == 2
    plan = evaluate(postings.postings(spark, sf_dir), PERSONAS[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and plan.count("Contains(txt#") == 0


def test_postings_are_tasks_of_bounded_rows_and_customers_are_not_broadcast(spark):
    rows = spark.range(10)
    assert postings.spread(rows, "id", 7 * postings.TASK_ROWS + 1).rdd.getNumPartitions() == 8
    assert postings.spread(rows, "id", 3).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    plan = postings.postings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1


def test_keys_are_compiled_and_search_only_where_something_stands(spark):
    urls = [None, "", "a  b", "Source URL: HTTPS://a.example/X  ", "x\n  SOURCE url:\t\x0bq\u212a.example\ny", "source url: two words", "say source url: z", "SOURCE URL:\n\nlate"]
    more = ["", "Fetched at: now", "Fetched at: now\nmore\r\n\tx", "x\n  FETCHED AT:\nfetched at: b\ny  z", "a\u00a0 b\x0bc\x0cd e ", "fetched\u0000 at:"]
    names = [None, "  Kita\t\nKK ", "A B", "\u0130\u03a3  \u03a3\u00a0", "\x01a"]
    rows = [(i, f"f{i}", names[i % 5], names[(i + 1) % 5], names[(i // 5) % 5], names[i % 3], names[i % 4], None if u is None and not m else f"{u or ''}\n{m}") for i, (u, m) in enumerate((u, m) for u in urls for m in more)]
    posts = spark.createDataFrame(rows, "ordinal long, source_file string, company_name string, title string, location string, salary_range string, remote_policy string, description string")
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    got = snapshots.keyed(posts)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
    assert got.columns == [*posts.columns, "base_key", "fingerprint", "job_key"]
    want = posts.selectExpr("ordinal", *[f"{e} as {n}" for n, e in snapshots.key_expressions(SPARK).items()])
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect())
    assert "contains(k_low" in got._jdf.queryExecution().optimizedPlan().toString().lower()
