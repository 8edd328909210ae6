"""Files in and out: YAML postings and settings, reports, states, alerts."""

import pytest
from pyspark.sql import functions as F

from sievewell.functions.dialect import SPARK
from sievewell.operators import candidate, raw_text, reading, snapshots
from sievewell.operators.evaluation import evaluate, staged
from sievewell.operators.settings import PERSONAS
from sievewell.sinks import reports
from sievewell.sources import yaml_files
from sievewell.sources.postings import postings, read_texts

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def items(spark):
    few = postings(spark, SF_DIR).where("ordinal < 120")
    judged = evaluate(few, PERSONAS[0], candidate=candidate.stages(SPARK, candidate.CANDIDATE), keep=("txt", "c_text", "c_years"))
    read = staged(judged, reading.stages(SPARK, PERSONAS[0], candidate.CANDIDATE), reading.COLUMNS)
    return reports.report_items(snapshots.keyed(read).withColumn("change_status", F.lit("NEW")), PERSONAS[0].score_range)


def test_batch_json_round_trip_and_defaults(spark, items, tmp_path):
    reports.write_batch_json(items, f"file://{tmp_path}/batch")
    back, errors = reports.read_batch_json(spark, f"file://{tmp_path}/batch")
    assert errors.isEmpty() and sorted(back.collect(), key=str) == sorted(items.collect(), key=str)
    (tmp_path / "odd").write_text('{"company": "A"}\nnot json\n')
    back, errors = reports.read_batch_json(spark, f"file://{tmp_path}/odd")
    row = back.first()
    assert (row["company"], row["title"], row["score"], row["risk_signals"]) == ("A", "", 0, []) and errors.count() == 1


def test_digest_and_markdown(spark, items, tmp_path):
    text = reports.weekly_digest(items, head={"persona": "engineer"}, top=2)
    assert f"- evaluated: {items.count()}" in text and "## Top GO" in text and "### 3." not in text
    reports.write_batch_markdown(items, f"file://{tmp_path}/md")
    parts = spark.read.text(f"file://{tmp_path}/md")
    assert parts.where("value like '### %'").count() == items.count()
    empty = reports.weekly_digest(items.limit(0))
    assert empty.count("No entries.") == 5 and "- evaluated: 0" in empty


def test_state_history_and_alerts(spark, tmp_path, capsys):
    few = snapshots.keyed(postings(spark, SF_DIR).where("ordinal < 50"))
    reports.write_state(few, f"file://{tmp_path}/state")
    assert spark.read.parquet(f"file://{tmp_path}/state").count() == few.count()
    runs = spark.createDataFrame([("all", i) for i in range(30)], "scope string, run int")
    kept = reports.append_history(runs, spark.createDataFrame([("all", 30)], "scope string, run int"), "scope", "run")
    assert sorted(r["run"] for r in kept.collect()) == list(range(5, 31))
    alerts = spark.createDataFrame([("CRITICAL", "NO_GO_JUMP", "three more")], "severity string, code string, message string")
    assert "1 alerts" in reports.alert_sink("stdout")(alerts) and "NO_GO_JUMP" in capsys.readouterr().out
    reports.alert_sink("json-file")(alerts, f"file://{tmp_path}/alerts", {"persona": "engineer"})
    assert "NO_GO_JUMP" in spark.read.text(f"file://{tmp_path}/alerts").first()[0]
    reports.alert_sink("none")(alerts)
    with pytest.raises(ValueError):
        reports.alert_sink("mail")


def test_yaml_postings_and_settings(spark, tmp_path):
    good = "job:\n" + "".join(f"  {f}: value of {f}\n" for f in yaml_files.FIELDS)
    (tmp_path / "a.yaml").write_text(good)
    (tmp_path / "b.yaml").write_text("company_name: A\ntitle: 7\nlocation: ' '\n")
    (tmp_path / "c.yaml").write_text("- a list")
    (tmp_path / "d.yaml").write_text("a: [")
    rows, errors = yaml_files.read_postings(spark, f"file://{tmp_path}")
    assert [r["title"] for r in rows.collect()] == ["value of title"]
    told = {r["source_file"][-6:]: r["errors"] for r in errors.collect()}
    assert len(told["b.yaml"]) == 5 and "mapping" in told["c.yaml"][0] and "Invalid YAML" in told["d.yaml"][0]
    yaml_files.write_postings(rows, f"file://{tmp_path}/out")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert yaml_files.parse_posting(text.split("\n---\n")[0], "x") == ({f: f"value of {f}" for f in yaml_files.FIELDS}, [])
    assert yaml_files.load_companies("companies:\n- {name: A, corporate_url: 'https://a.example/en/', profile_tags: [strong_wlb]}")[0].english_site
    persona = yaml_files.load_personas("personas:\n- {id: p, priorities: [salary], hard_no: [onsite_only], signal_weights: {onsite_bias: 9}}")[0]
    assert persona.risk_weight("onsite_bias", "hybrid_work", 2) == 9
    with pytest.raises(ValueError):
        yaml_files.load_personas("personas:\n- {id: p, signal_weights: {onsite_bias: -1}}")
    assert yaml_files.load_blacklist("blacklisted_companies:\n- {name: B}") == ["B"]


def test_raw_files_are_numbered_by_path_and_parsed(spark, tmp_path):
    (tmp_path / "b.txt").write_text("Company: Kita\nTitle: SRE\n")
    (tmp_path / "a.txt").write_text("About Nami Labs\nlooking for a senior data   SCIENTIST in Kyoto\n")
    rows = {r["ordinal"]: r for r in yaml_files.raw_postings(yaml_files.ordered(read_texts(spark, f"file://{tmp_path}"))).collect()}
    assert (rows[1]["company_name"], rows[1]["title"], rows[1]["location"]) == ("Nami Labs", "Data Scientist", "Kyoto")
    assert (rows[2]["company_name"], rows[2]["title"], rows[2]["salary_range"], len(rows[2]["warnings"])) == ("Kita", "SRE", "TBD", 3)


def test_all_six_candidate_signals_fire(spark):
    from sievewell.plans.queries import QUERIES

    row = QUERIES["candidate_fit"](spark, SF_DIR).agg(*[F.sum(F.col(c).cast("int")) for c in candidate.stages(SPARK, candidate.CANDIDATE)[-1]]).first()
    assert all(n > 0 for n in row)


@pytest.mark.parametrize("text", [None, "", "\n\n", "x" * 200_000, "about the job\n" * 3])
def test_any_raw_text_parses(spark, text):
    row = staged(spark.createDataFrame([(text,)], "raw_text string"), raw_text.stages(SPARK), raw_text.PARSED).first()
    assert row["company_name"] == "Unknown Company" and row["title"] == "Unknown Role" and row["description"]


def test_filter_on_an_evaluated_column_plans(spark):
    assert evaluate(postings(spark, SF_DIR), PERSONAS[0]).where("verdict = 'GO' and score > 50").count() > 0
