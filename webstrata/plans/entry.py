"""Queries of the entry points (PRJ01 to PRJ04, JON01, STT03, AGG01, AGG07, LIM02, SET01)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata import api
from webstrata.plans import logs
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]
NOW = 1_705_000_000


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", *api.RECORD).dropDuplicates(["fetch_id"])


def answered_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Logged requests answered from the cache, which holds every other fetch, or from recorded responses; by outcome, with the ages of hits (PRJ01 to PRJ04, JON01, STT03)."""
    rows = _cache(spark, folder)
    asked = table(spark, folder, "telemetry").select(F.col("entry_id").alias("request_id"), "url").dropDuplicates(["request_id"]).where("url IS NOT NULL")
    asked = asked.unionByName(asked.where("request_id % 10 = 0").select((-F.col("request_id") - 1).alias("request_id"), F.lit("https://nowhere.test/").alias("url")))
    x = api.fetch(asked, rows, rows.where("fetch_id % 2 = 0"), NOW, raw=True)
    return x.groupBy("from_cache", F.col("failure.reason").alias("reason"), F.array_join("warnings", "+").alias("warnings")).agg(F.count("*").alias("n"), F.sum("cache_age_seconds").alias("age_sum"), F.sum("word_count").alias("words"))


SQL_ANSWERED = """
WITH f AS (SELECT * FROM (SELECT DISTINCT fetch_id, url, fetched_at, ttl_expires, markdown, failure_reason FROM fetch_cache)),
h AS (SELECT * FROM f WHERE fetch_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) = 1), n AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) = 1),
a AS (SELECT DISTINCT entry_id AS id, url FROM telemetry WHERE url IS NOT NULL), q AS (SELECT * FROM a UNION ALL SELECT -id - 1, 'https://nowhere.test/' FROM a WHERE id % 10 = 0),
j AS (SELECT q.id, h.fetch_id IS NOT NULL AS from_cache, CASE WHEN h.fetch_id IS NOT NULL THEN h.failure_reason WHEN n.fetch_id IS NULL THEN 'dns_fail' ELSE n.failure_reason END AS why, CASE WHEN h.fetch_id IS NOT NULL THEN h.markdown ELSE n.markdown END AS t, 1705000000 - h.fetched_at AS age
  FROM q LEFT JOIN h ON h.url = q.url AND (h.ttl_expires >= 1705000000 OR h.ttl_expires IS NULL) LEFT JOIN n ON n.url = q.url),
w AS (SELECT *, CASE WHEN t IS NULL THEN 0 ELSE len(list_filter(regexp_split_to_array(t, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{1C}-\\x{1F}]+'), lambda x: x <> '')) END AS words FROM j),
r AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN words = 0 THEN 'empty_body' END AS reason FROM w)
SELECT from_cache, reason, CASE WHEN reason IS NULL THEN 'raw' END AS warnings, count(*) AS n, CAST(sum(age) AS BIGINT) AS age_sum, CAST(sum(CASE WHEN reason IS NULL THEN words END) AS BIGINT) AS words FROM r GROUP BY ALL
"""


def log_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All rollups of the log of a window in one table (AGG01)."""
    return api.log_stats(table(spark, folder, "telemetry"), logs.LAST_DAY, logs.DAYS)


# section: (query of the log, key, detail, measures)
SECTIONS = {
    "by_tool": ("log_by_tool", "tool", "outcome", ["n"]),
    "failures": ("log_failures", "failure_reason", None, ["n"]),
    "failure_by_domain": ("log_failure_by_domain", "domain", "failure_reason", ["n", "domain_total"]),
    "modes_used": ("log_modes_used", "mode_used", None, ["n"]),
    "cache": ("log_cache_ratio", None, None, ["cache_observations", "cache_hit_ratio"]),
    "escalation_rate": ("log_escalation_rate", "tool", None, ["escalated", "rate"]),
    "escalation_by_domain": ("log_escalation_paths", "domain", "path", ["n"]),
    "duration_ms": ("log_durations", "tool", None, ["p50", "p95", "p99", "count"]),
    "phase_percentiles": ("log_phases", "tool", "phase", ["p50", "p95", "p99", "count"]),
    "adapters": ("log_adapters", "provider", None, ["ok", "zero_result", "zero_result_rate"]),
    "answer_usage": ("log_answer_usage", "provider", None, ["calls", "input_tokens", "output_tokens", "cost_usd", "fell_back"]),
}
_WINDOW = "(SELECT DISTINCT * FROM telemetry WHERE substr(ts, 1, 10) > '2024-01-31' AND substr(ts, 1, 10) <= '2024-03-31')"


def _sections() -> str:
    parts = [f"SELECT 'log' AS section, NULL AS key, NULL AS detail, 'total_events' AS measure, count(*)::DOUBLE AS value FROM {_WINDOW} WHERE tool IS NOT NULL"]
    for section, (name, key, detail, measures) in SECTIONS.items():
        sql = logs.CATALOG[name][1].replace("(SELECT DISTINCT * FROM telemetry)", _WINDOW)
        parts += [f"SELECT '{section}', CAST({key or 'NULL'} AS VARCHAR), CAST({detail or 'NULL'} AS VARCHAR), '{m}', CAST({m} AS DOUBLE) FROM ({sql})" for m in measures]
    return " UNION ALL ".join(parts)


def mapped_sites(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of three sources under one limit, some left out (SET01, LIM02, CLS18)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id", "url", "final_url").dropDuplicates(["fetch_id"])
    log = table(spark, folder, "telemetry").select("entry_id", "url").dropDuplicates(["entry_id"])
    sources = [("final", f.select(F.col("final_url").alias("url"), F.col("fetch_id").alias("place"))), ("asked", f.select("url", F.col("fetch_id").alias("place"))), ("log", log.select("url", F.col("entry_id").alias("place")))]
    return api.map_sites(sources, 200, ["-board", "", "page=3"])


SQL_MAPPED = """
WITH f AS (SELECT DISTINCT fetch_id, url, final_url FROM fetch_cache), u AS (SELECT final_url AS url, 0 AS p, fetch_id AS s, 'final' AS source FROM f UNION ALL SELECT url, 1, fetch_id, 'asked' FROM f UNION ALL SELECT url, 2, entry_id, 'log' FROM (SELECT DISTINCT entry_id, url FROM telemetry)),
m AS (SELECT * FROM u WHERE url IS NOT NULL AND NOT contains(url, '-board') AND NOT contains(url, 'page=3') QUALIFY row_number() OVER (PARTITION BY url ORDER BY p, s) = 1), n AS (SELECT *, row_number() OVER (ORDER BY p, s, url) AS n FROM m)
SELECT CASE WHEN n <= 200 THEN url END AS url, CASE WHEN n <= 200 THEN source END AS source, CASE WHEN n > 200 THEN 'more results were left out' END AS note FROM n WHERE n <= 201
"""


def cache_size(spark: SparkSession, folder: str) -> DataFrame:
    """Entries and bytes of the cache (AGG07)."""
    return api.cache_stats(_cache(spark, folder))


SQL_SIZE = "SELECT count(DISTINCT url) AS entries, CAST(coalesce(sum(strlen(markdown)), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT fetch_id, url, markdown FROM fetch_cache)"

CATALOG: dict[str, tuple[Query, str | None]] = {
    "answered_requests": (answered_requests, SQL_ANSWERED),
    "log_summary": (log_summary, _sections()),
    "mapped_sites": (mapped_sites, SQL_MAPPED),
    "cache_size": (cache_size, SQL_SIZE),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
