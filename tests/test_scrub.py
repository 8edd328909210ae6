"""Removal of keys and lines that tell where files lie."""

import json

from pyspark.sql import functions as F

from sievewell.operators.scrub import scrub_json, without_json_keys, without_keys, without_lines


def test_keys_go_at_any_depth(spark):
    rows = spark.sql("""select 1 as id, 'x' as source_file, 7 as `odd.name`, named_struct('batch_json', 1, 'a.b', 2, 'deep', named_struct('weekly_digest', 3)) as s,
        array(named_struct('source_file', 'x', 'k', array(map('source_file', 1, 'kept', 2)))) as l, map(1, named_struct('source_file', 1, 'v', 2)) as m, array(named_struct('source_file', 1)) as gone, cast(null as struct<source_file: int, v: int>) as none""")
    got = without_keys(rows)
    assert got.columns == ["id", "odd.name", "s", "l", "m", "none"]
    row = got.first().asDict(recursive=True)
    assert row == {"id": 1, "odd.name": 7, "s": {"a.b": 2}, "l": [{"k": [{"kept": 2}]}], "m": {1: {"v": 2}}, "none": None}
    same = rows.select("id", F.lit("t").alias("text"))
    assert without_keys(same).schema == same.schema and without_keys(rows.limit(0)).count() == 0


def test_json_and_lines(spark):
    assert json.loads(scrub_json('{"a": [{"source_file": 1, "b": {"weekly_digest": [], "c": "é"}}], "source_file": {}}')) == {"a": [{"b": {"c": "é"}}]}
    assert scrub_json("[]") == "[]" and scrub_json("7") == "7" and scrub_json('"source_file"') == '"source_file"'
    assert scrub_json('{"a": 1, "source_file": "p\\"q", }') == '{"a": 1}'
    assert scrub_json('{"n": NaN, "batch_json":"x"}') == '{"n": NaN}'
    assert scrub_json("[" * 100_000) == "[" * 100_000
    rows = spark.createDataFrame([('{"source_file":"a","b":1}', "source_file: a\n b\n\tbatch_json: c\n- source_file: x"), (None, None), ("", "")], "j string, t string")
    got = rows.select(without_json_keys()("j"), without_lines("t")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([('{"b":1}', " b"), (None, None), ("", "")], key=str)
