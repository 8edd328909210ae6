"""Queries that remove what tells of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scrub import without_json_keys, without_keys, without_lines
from .registry import query

_PAYLOAD = "named_struct('source_file', 'in/' || event_id, 'item', named_struct('batch_json', 'b', 'n', event_id), 'list', array(named_struct('source_file', 'a', 'k', user_id), null), 'tags', map('source_file', 'x', 'kind', event_type))"
_JSON = "'{\"batch_json\" : \"b\", \"kind\": \"' || event_type || '\", \"items\": [ {\"source_file\": {\"x\": 1}, \"n\": ' || event_id || '}, null]' || case when event_id % 3 = 0 then '' else '}' end"
_TEXT = "'# ' || event_type || '\\r\\n  - source_file: in/' || event_id || '\\n\\tweekly_digest: d\\nsaid source_file: ' || user_id || '\\n'"


@query("""select event_id, '{"item":{"n":' || event_id || '},"list":[{"k":' || user_id || '},null],"tags":{"kind":"' || event_type || '"}}' as payload,
    case when event_id % 3 = 0 then '{ "kind": "' || event_type || '", "items": [ {"source_file": {"x": 1}, "n": ' || event_id || '}, null]'
        else '{"kind":"' || event_type || '","items":[{"n":' || event_id || '},null]}' end as json,
    '# ' || event_type || chr(10) || 'said source_file: ' || user_id || chr(10) as text from events""")
def scrubbed_payloads(spark, sf_dir):
    """Nested payloads, JSON texts (a third of them cut off) and plain texts without keys and lines that tell of files."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"{_PAYLOAD} as payload", f"{_JSON} as json", f"{_TEXT} as text")
    clean = without_keys(rows)
    return clean.select("event_id", F.to_json("payload").alias("payload"), without_json_keys()("json").alias("json"), without_lines("text").alias("text"))
