"""Pages of the web as rows: a table of addresses is fetched host by host, beside a cache of earlier answers."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from importlib import import_module

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dialect import SPARK
from ..functions.fetching import Host, Options, Transport, http_get, unsafe
from ..functions.urls import url_expressions
from ..session import workers_import

CACHE_SCHEMA = "cache_key string, url string, status int, final_url string, body string, fetched_at timestamp"
FETCHED = "url string, host string, state string, status int, final_url string, body string, fetched_at timestamp, error string, warning string, retries int, requests int"
#: What can become of an address; ``stale``: the cached answer stands in for a failed fetch.
STATES = ("fresh", "network", "stale", "blocked", "unsafe", "failed")
TTL_MINUTES = 720


def _fetcher(transport: Transport, options: Options):
    """Rows of one host after another to their answers; a host's rows come together, so one task sets its pace."""

    def run(parts):
        host, state = None, None
        for rows in parts:
            out = []
            for r in rows.to_pylist():
                if r["host"] != host or state is None:
                    host, state = r["host"], Host(transport, options)
                before = state.requests
                row = {"url": r["url"], "host": host, "state": "failed", "status": None, "final_url": None, "body": None, "fetched_at": None, "error": None, "warning": None, "retries": 0}
                cached = {"status": r["c_status"], "final_url": r["c_final_url"], "body": r["c_body"], "fetched_at": r["c_fetched_at"]}
                if reason := unsafe(r["url"]):
                    row |= {"state": "unsafe", "error": reason}
                elif options.robots != "off" and not state.allowed(r["url"]) and options.robots == "strict":
                    row |= {"state": "blocked", "error": f"Blocked by robots.txt: {r['url']}"}
                else:
                    if options.robots == "warn" and not state.allowed(r["url"]):
                        row["warning"] = "URL may be disallowed by robots.txt, continuing due to warn mode."
                    if r["fresh"]:
                        row |= cached | {"state": "fresh"}
                    else:
                        got = state.fetch(r["url"])
                        row |= got | {"state": "network" if got["status"] is not None else "failed", "fetched_at": datetime.now(timezone.utc) if got["status"] is not None else None}
                        if (got["status"] is None or got["status"] >= 400) and cached["fetched_at"] is not None:
                            row |= cached | {"state": "stale", "error": got["error"] or f"HTTP {got['status']} while fetching URL."}
                out.append(row | {"requests": state.requests - before})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


_ARROW = pa.schema([("url", pa.string()), ("host", pa.string()), ("state", pa.string()), ("status", pa.int32()), ("final_url", pa.string()), ("body", pa.string()), ("fetched_at", pa.timestamp("us", "UTC")), ("error", pa.string()), ("warning", pa.string()), ("retries", pa.int32()), ("requests", pa.int32())])


def cache_lookup(addresses: DataFrame, cache: DataFrame | None, now, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """``addresses`` (url) with the cached answer beside each, by a hash of the address, and whether it is fresh."""
    rows = addresses.select("url").distinct().withColumn("cache_key", F.sha2("url", 256))
    if cache is None:
        cache = rows.sparkSession.createDataFrame([], CACHE_SCHEMA)
    known = cache.select("cache_key", *[F.col(c).alias(f"c_{c}") for c in ("status", "final_url", "body", "fetched_at")])
    age = F.lit(now).cast("timestamp").cast("double") - F.col("c_fetched_at").cast("double")
    return rows.join(known, "cache_key", "left").withColumn("fresh", F.coalesce(age <= max(1, ttl_minutes) * 60, F.lit(False)))


def fetch_pages(addresses: DataFrame, transport: Transport = http_get, options: Options | None = None, cache: DataFrame | None = None, now=None, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Every distinct address of ``addresses`` (url) once: url, host, state, status, final_url, body, fetched_at, error, warning, retries, requests.

    Robots rules come first, then a fresh cached answer, then the network, then a stale
    one. All addresses of a host are one task's, in order, so that its pace holds
    without a lock; other hosts go on beside it. A null address is unsafe. The result
    is not deterministic: write it before it is read twice, as ``cached_fetch`` does.
    """
    spark = workers_import(addresses.sparkSession)
    now = now or datetime.now(timezone.utc)
    named = cache_lookup(addresses.select(F.coalesce("url", F.lit("")).alias("url")), cache, now, ttl_minutes).selectExpr("*", f"coalesce(nullif({url_expressions(SPARK)['host']}, ''), lower(url)) as host")
    by_host = named.repartition("host").sortWithinPartitions("host", "url").select("host", "url", "fresh", "c_status", "c_final_url", "c_body", "c_fetched_at")
    return by_host.mapInArrow(_fetcher(transport, options or Options()), FETCHED)


def fetch_totals(fetched: DataFrame) -> DataFrame:
    """One row: fresh hits, misses, stale fallbacks, retries, requests, failures."""
    n = lambda *states: F.sum(F.col("state").isin(*states).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return fetched.agg(zero(n("fresh")).alias("fresh_cache_hits"), zero(n("network", "stale", "failed")).alias("cache_misses"), zero(n("stale")).alias("stale_cache_fallbacks"), zero(F.sum("retries")).alias("retries_used"), zero(F.sum("requests")).alias("outgoing_requests"), zero(n("failed", "unsafe", "blocked")).alias("failures"))


def new_cache_rows(fetched: DataFrame) -> DataFrame:
    """What a fetch adds to the cache: answers from the network that are no errors."""
    return fetched.where("state = 'network' and status < 400").select(F.sha2("url", 256).alias("cache_key"), "url", "status", "final_url", "body", "fetched_at")


class _Partition(InputPartition):
    def __init__(self, addresses):
        self.addresses = addresses


class _Reader(DataSourceReader):
    def __init__(self, options):
        module, _, name = options.get("transport", "sievewell.functions.fetching:http_get").partition(":")
        self.transport = (module, name)
        self.addresses = json.loads(options.get("addresses", "[]"))
        number = lambda k, d: int(options.get(k, d))
        base = Options()
        self.options = Options(options.get("useragent", base.user_agent), number("timeout_s", base.timeout_s), number("retries", base.retries), number("backoff_ms", base.backoff_ms), number("delay_ms", base.delay_ms), options.get("robots", base.robots))

    def partitions(self):
        from urllib.parse import urlsplit

        hosts: dict[str, list[str]] = {}
        for url in dict.fromkeys(self.addresses):
            try:
                host = urlsplit(url).hostname or ""
            except ValueError:
                host = ""
            hosts.setdefault(host, []).append(url)
        return [_Partition((host, urls)) for host, urls in hosts.items()] or [_Partition(("", []))]

    def read(self, partition):
        transport = getattr(import_module(self.transport[0]), self.transport[1])
        host, urls = partition.addresses
        rows = [{"host": host, "url": u, "fresh": False, "c_status": None, "c_final_url": None, "c_body": None, "c_fetched_at": None} for u in urls]
        if rows:
            yield from _fetcher(transport, self.options)([pa.RecordBatch.from_pylist(rows)])


class WebPages(DataSource):
    """``spark.read.format("web_pages")``: a few addresses, as a JSON list in the option ``addresses``; a partition per host.

    Other options: ``transport`` (module:function), ``useragent``, ``timeout_s``,
    ``retries``, ``backoff_ms``, ``delay_ms``, ``robots`` (strict, warn, off). Tables
    of addresses go through ``fetch_pages``.
    """

    @classmethod
    def name(cls):
        return "web_pages"

    def schema(self):
        return FETCHED

    def reader(self, schema):
        return _Reader(self.options)
