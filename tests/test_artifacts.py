"""Stored evaluations: files, mended names, sources judged again, histories."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievewell.operators import artifacts as A
from sievewell.operators.settings import PERSONAS, Company
from sievewell.sinks.versioned import Versioned
from sievewell.sources.artifact_files import COLUMNS, SCHEMA, parse_artifact, read_artifacts

TRACKED = (Company("Kita", career_url="https://jobs.kita.example/"), Company("Nami", corporate_url="https://nami.example/about"))


def artifact(path, **more):
    return tuple({"path": path, "persona": "engineer", "candidate_profile": "none", "kind": "url", "url": "", "raw_text": "", "title": "Engineer", "location": "Tokyo", "salary_range": "TBD", "remote_policy": "Hybrid", "description": "", "company_name": "Kita", **more}.get(c) for c in COLUMNS)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_files(spark, tmp_path):
    good = "persona: engineer\ngenerated_at: '2024-03-01T10:00:00Z'\nsource: {kind: url, url: 'https://a.example/role-1'}\njob_input: {title: SRE, company_name: A}\nevaluation: {verdict: GO, score: 61}\n"
    for name, text in {"a.yaml": good, "b.yaml": "source: {kind: text}", "c.yaml": "- a list", "d.yaml": "a: [", "e.txt": good, "f.yaml": "persona: p\nsource: {kind: text, raw_text: 'Title: QA'}\ngenerated_at: soon"}.items():
        (tmp_path / name).write_text(text)
    rows, errors = read_artifacts(spark, f"file://{tmp_path}")
    got = {r["path"][-6:]: r for r in rows.collect()}
    assert set(got) == {"a.yaml", "f.yaml"} and tuple(got["a.yaml"].asDict()) == COLUMNS
    a, f = got["a.yaml"], got["f.yaml"]
    assert (a["title"], a["verdict"], a["score"], a["generated_at"]) == ("SRE", "GO", 61, datetime(2024, 3, 1, 10)) and a["location"] == ""
    assert (f["raw_text"], f["verdict"], f["score"], f["generated_at"]) == ("Title: QA", None, None, None)
    told = {r["path"][-6:]: r["errors"] for r in errors.collect()}
    assert len(told["b.yaml"]) == 2 and "mapping" in told["c.yaml"][0] and "Invalid YAML" in told["d.yaml"][0]
    assert parse_artifact("persona: p\nsource: {kind: 7, url: x}", "z")[1] == ["Missing string field 'source.kind' in z"]


def test_names_are_mended(spark):
    rows = table(
        spark,
        artifact("1", company_name="Unknown Company", url="https://eu.jobs.kita.example/x-1"),
        artifact("2", company_name="Our client", url="https://nami.example/x-1"),
        artifact("3", company_name="Our client", url="https://boards.greenhouse.io/x-1", title="SRE | Umi Labs"),
        artifact("4", company_name="Mori", url="https://nami.example/x-2"),
        artifact("5", company_name="Unknown Company", kind="text", raw_text="Company: Kita"),
        artifact("6", company_name="unknown", url="https://some-tools.example/x-1"),
        artifact("7", company_name=None, url=None),
    )
    assert {r["path"]: r["company_name"] for r in A.mended_names(rows, TRACKED).collect()} == {"1": "Kita", "2": "Nami", "3": "Umi Labs", "6": "Some Tools"}


def test_sources_are_judged_once_for_each_persona(spark):
    text = "Company: Umi Labs\nTitle: Backend Engineer\nLocation: Kyoto\n"
    rows = table(
        spark,
        artifact("b.yaml", url="https://a.example/role-1", title="From b"),
        artifact("a.yaml", url="https://a.example/role-1", title="From a", persona="other"),
        artifact("c.yaml", url="https://a.example/role-1", persona=" ENGINEER "),
        artifact("d.yaml", url="https://a.example/role-1", persona="engineer_strict", candidate_profile="mid"),
        artifact("in/adhoc-1-engineer-none-text.yaml", kind="text", raw_text=text, persona="x"),
        artifact("e.yaml", kind="text", raw_text=text + "More: yes\n", persona="x"),
        artifact("f.yaml", kind="text", url=None, raw_text=None),
    )
    got = A.rerun(rows, PERSONAS[:2], folder="in/", generated_at="2024-05-01 00:00:00")
    found = {(r["raw_text"], r["persona"]): r for r in got.collect()}
    assert len(found) == 6 == got.count() and tuple(got.columns) == COLUMNS
    page = found["", "engineer"]
    assert (page["path"], page["title"], page["verdict"] is not None) == ("b.yaml", "From a", True)
    assert found["", "engineer_strict"]["path"].startswith("in/adhoc-url-engineer-strict-none-a-example-role-1-")
    named = found[text, "engineer_strict"]
    assert (named["path"], named["company_name"], named["title"], named["location"]) == ("in/adhoc-1-engineer-strict-none-text.yaml", "Umi Labs", "Backend Engineer", "Kyoto")
    assert found[text + "More: yes\n", "engineer"]["path"].startswith("in/adhoc-text-engineer-none-")
    anew = spark.createDataFrame([("https://a.example/role-1", "Mori", "Anew", "", "", "", "")], "url string, company_name string, title string, location string, salary_range string, remote_policy string, description string")
    assert {r["title"] for r in A.rerun(rows, PERSONAS[:1], fetched=anew).where("url <> ''").collect()} == {"Anew"}
    assert A.rerun(rows.limit(0), PERSONAS).count() == 0


def test_a_table_is_mended_and_judged_in_place(spark, tmp_path, monkeypatch):
    store = Versioned(spark, f"file://{tmp_path}/store")
    A.mend_names_in(store)
    A.rerun_in(store, PERSONAS)
    assert store.read() is None
    store.replace(table(spark, artifact("a.yaml", company_name="unknown", url="https://jobs.kita.example/x-1"), artifact("b.yaml", kind="text", raw_text="Title: SRE", candidate_profile="mid")))
    A.mend_names_in(store, TRACKED)
    assert [r["company_name"] for r in store.read().orderBy("path").collect()] == ["Kita", "Kita"]

    before = store.version()
    monkeypatch.setattr(Versioned, "switch", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        A.rerun_in(store, PERSONAS[:1])
    monkeypatch.undo()
    assert store.version() == before and store.read().where("verdict is not null").count() == 0
    for _ in range(2):  # the second time changes nothing but times
        A.rerun_in(store, PERSONAS[:1], generated_at="2024-05-01 00:00:00")
        rows = {r["path"]: r for r in store.read().collect()}
        assert len(rows) == 3 and rows["a.yaml"]["verdict"] and rows["b.yaml"]["verdict"] is None


def test_history(spark):
    at = lambda day: datetime(2024, 1, day)
    job = lambda url, day, title="SRE", more="": ("A", title, f"text\n  Source URL: {url}\n{more}", at(day))
    jobs = spark.createDataFrame(
        [job("https://a.example/role-1", 2), job("https://a.example/role-1", 9, " sre "), job("https://a.example/careers-page?id=1", 1), job("https://a.example/list-1", 1), job("https://a.example/list-1", 1, "QA"), job("https://a.example/jobs", 1), job("ftp://a.example/role-2", 1),
         job("https://a.example/role-3", 1, more="Fetched At: 2024-01-20T00:00:00Z"), ("A", "T", "no address", at(1)), ("A", "T", None, at(1))],
        "company_name string, title string, description string, modified_at timestamp",
    )
    stored = table(spark, *[artifact(p, url=u, verdict=v, generated_at=at(d)) for p, u, v, d in (("x", "https://a.example/role-1", "GO", 3), ("y", "https://a.example/role-1", "NO_GO", 5), ("z", "https://a.example/role-4", "GO", 30), ("w", "https://a.example/list-1", "GO", 4))], artifact("t", kind="text", raw_text="x"))
    got = [(r["url"].rsplit("/", 1)[1], r["origin"], r["generated_at"].day, r["saved_path"], r["saved_verdict"]) for r in A.url_history(jobs, stored).collect()]
    assert got == [("role-4", "ad_hoc", 30, "z", "GO"), ("role-3", "pipeline_job", 20, None, None), ("role-1", "pipeline_job", 9, "y", "NO_GO"), ("list-1", "ad_hoc", 4, "w", "GO"), ("careers-page?id=1", "pipeline_job", 1, None, None)]
    assert A.url_history(jobs, stored.limit(0)).where("saved_path is not null").count() == 0 and A.url_history(jobs.limit(0), stored).where(F.col("origin") == "ad_hoc").count() == 3
