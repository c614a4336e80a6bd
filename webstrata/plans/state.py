"""Queries of the cache and the keyed state machines (STT, JON01, SET05, SNK01, SRC22, AGG07)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.classify import REASON_TTL, ttl_seconds
from webstrata.functions.urls import host_of
from webstrata.operators import state as S
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]
NOW = 1_706_000_000


def _cache(spark: SparkSession, folder: str) -> DataFrame:
    once = table(spark, folder, "fetch_cache").select("fetch_id", "url", "status", "mode_used", "fetched_at", "ttl_expires").dropDuplicates(["fetch_id"])
    return S.latest(once, ["url"], ["fetched_at", "fetch_id"])


_ONCE = "SELECT DISTINCT fetch_id, url, status, mode_used, fetched_at, ttl_expires FROM fetch_cache"
_SNAP = f"SELECT * FROM ({_ONCE}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, fetch_id DESC) = 1"


def cache_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The latest fetch per address (SNK01, STT04)."""
    return _cache(spark, folder)


def cache_lookups(spark: SparkSession, folder: str) -> DataFrame:
    """Logged addresses against the cache: hit or miss, and the age of hits (JON01, STT03, PRJ03)."""
    asked = table(spark, folder, "telemetry").select("entry_id", "url").dropDuplicates(["entry_id"]).where("url IS NOT NULL")
    joined = S.cache_lookup(asked, _cache(spark, folder), NOW)
    return joined.groupBy(F.col("fetch_id").isNotNull().alias("hit")).agg(F.count("*").alias("n"), F.sum(NOW - F.col("fetched_at")).alias("age_sum"))


def cache_list(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 newest cache rows (SRC22, SRT02, LIM01)."""
    return _cache(spark, folder).orderBy(F.desc("fetched_at"), "url").limit(20).select("url", "fetched_at")


def cache_purged(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left by three kinds of purge (SET05), and the size before (AGG07)."""
    rows = _cache(spark, folder)
    site = host_of(F.col("url")) == "stykraebrei-board.test"
    parts = [("all", rows), ("expired", S.purge(rows, NOW)), ("old", S.purge(rows, NOW, 90 * 86400)), ("domain", rows.where(~site))]
    counts = [r.agg(F.count("*").alias("n")).select(F.lit(k).alias("purge"), "n") for k, r in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def ttl_by_reason(spark: SparkSession, folder: str) -> DataFrame:
    """Cache lifetime of each outcome in the log (STT02)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "failure_reason").dropDuplicates(["fetch_id"])
    return rows.groupBy("failure_reason").agg(F.count("*").alias("n")).withColumn("ttl", ttl_seconds(F.col("failure_reason")))


_TTL = " ".join(f"WHEN '{k}' THEN greatest(1, CAST(floor(900 * {v}) AS INTEGER))" for k, v in REASON_TTL.items())


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "telemetry").select("entry_id", "url", "mode_used", "outcome", "ts").dropDuplicates(["entry_id"])
    mode = F.when(F.col("entry_id") % 7 < 5, "http").otherwise("browser")
    return rows.where("url IS NOT NULL").select(host_of(F.col("url")).alias("route_key"), mode.alias("mode"), (F.col("entry_id") % 4 == 0).alias("success"), "ts", F.col("entry_id").alias("id"))


def route_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """Preferred mode per host after replaying the log (STT01)."""
    return S.strategy(_outcomes(spark, folder))


SQL_STRATEGY = """
WITH RECURSIVE o AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS k, CASE WHEN entry_id % 7 < 5 THEN 'http' ELSE 'browser' END AS mode, entry_id % 4 = 0 AS ok,
  row_number() OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#:]*)', 1)) ORDER BY ts, entry_id) AS i FROM (SELECT DISTINCT entry_id, url, ts FROM telemetry) WHERE url IS NOT NULL),
s AS (SELECT k, i, mode AS p, CASE WHEN ok THEN 1 ELSE 0 END AS sc, CASE WHEN ok THEN 0 ELSE 1 END AS fc FROM o WHERE i = 1
  UNION ALL SELECT o.k, o.i, CASE WHEN NOT o.ok AND o.mode = s.p AND s.fc + 1 >= 3 THEN CASE WHEN s.p = 'http' THEN 'browser' ELSE 'http' END ELSE s.p END, s.sc + CASE WHEN o.ok THEN 1 ELSE 0 END,
    CASE WHEN o.ok THEN 0 WHEN o.mode = s.p THEN CASE WHEN s.fc + 1 >= 3 THEN 0 ELSE s.fc + 1 END ELSE s.fc END FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1)
SELECT k AS route_key, p AS preferred_mode, sc AS success_count, fc AS failure_count FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY i DESC) = 1
"""


def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Starts of paced requests per host: the longest wait and the last start (STT06)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "url", "fetched_at").dropDuplicates(["fetch_id"])
    paced = S.rate_limited_starts(rows.select("fetch_id", host_of(F.col("url")).alias("host"), (F.col("fetched_at") % 5000).alias("t")), "host", "t", "fetch_id", 40)
    return paced.groupBy("host").agg(F.max(F.col("starts_at") - F.col("t")).alias("longest_wait"), F.max("starts_at").alias("last_start"))


SQL_RATE = """
WITH r AS (SELECT fetch_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, fetched_at % 5000 AS t FROM (SELECT DISTINCT fetch_id, url, fetched_at FROM fetch_cache)),
i AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY t, fetch_id) - 1 AS i FROM r), s AS (SELECT *, i * 40 + max(t - i * 40) OVER (PARTITION BY host ORDER BY t, fetch_id ROWS UNBOUNDED PRECEDING) AS s FROM i)
SELECT host, max(s - t) AS longest_wait, max(s) AS last_start FROM s GROUP BY host
"""


def probe_state(spark: SparkSession, folder: str) -> DataFrame:
    """Latest probe verdicts, stale ones unknown (STT05, CLS23)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "url", "status", "fetched_at").dropDuplicates(["fetch_id"])
    verdict = F.when(F.col("status") >= 500, None).otherwise(F.col("status") == 200)
    probes = rows.select(F.lit("store").alias("provider"), host_of(F.col("url")).alias("domain"), verdict.alias("is_match"), F.col("fetched_at").alias("updated_at"), F.col("fetch_id").alias("id")).where("is_match IS NOT NULL")
    return S.probe_verdicts(probes, NOW + 20 * 86400).select("provider", "domain", "is_match", "updated_at")


SQL_PROBE = f"""
WITH p AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS domain, CASE WHEN status < 500 THEN status = 200 END AS m, fetched_at, fetch_id FROM ({_ONCE}))
SELECT 'store' AS provider, domain, CASE WHEN fetched_at >= {NOW + 20 * 86400 - 30 * 86400} THEN m END AS is_match, fetched_at AS updated_at FROM p WHERE m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC, fetch_id DESC) = 1
"""


def single_flights(spark: SparkSession, folder: str) -> DataFrame:
    """Equal requests within a day share one run (STT08)."""
    rows = table(spark, folder, "telemetry").select("entry_id", "tool", "url", "ts").dropDuplicates(["entry_id"]).where("url IS NOT NULL AND ts IS NOT NULL")
    shared = S.single_flight(rows.select(F.col("entry_id").alias("id"), "tool", "url", "ts"), ["tool", "url"], F.substring("ts", 1, 10))
    return shared.select("id", "run_id", "shared_by")


SQL_FLIGHT = """
SELECT entry_id AS id, min(entry_id) OVER w AS run_id, count(*) OVER w AS shared_by FROM (SELECT DISTINCT entry_id, tool, url, ts FROM telemetry) WHERE url IS NOT NULL AND ts IS NOT NULL AND tool IS NOT NULL WINDOW w AS (PARTITION BY tool, url, substr(ts, 1, 10))
"""


def escalations(spark: SparkSession, folder: str) -> DataFrame:
    """How chains of tiers end (STT09)."""
    ids = table(spark, folder, "fetch_cache").select(F.col("fetch_id").alias("request_id")).distinct()
    tiers = F.posexplode(F.array(*map(F.lit, S.TIERS))).alias("k", "tier")
    reasons = F.array(F.lit("timeout"), F.lit("ok"), F.lit("blocked_bot"), F.lit("invalid_url"), F.lit("server_error"))
    attempts = ids.select("request_id", tiers).withColumn("reason", F.element_at(reasons, ((F.col("request_id") * 3 + F.col("k") * 2) % 5 + 1).cast("int")))
    return S.escalation(attempts).groupBy("mode_used", "reason", "tiers_tried").agg(F.count("*").alias("n"))


SQL_ESCALATION = """
WITH a AS (SELECT fetch_id, k, (['http', 'browser', 'mobile', 'archive'])[k + 1] AS tier, (['timeout', 'ok', 'blocked_bot', 'invalid_url', 'server_error'])[(fetch_id * 3 + k * 2) % 5 + 1] AS reason FROM (SELECT DISTINCT fetch_id FROM fetch_cache), range(4) r(k)),
e AS (SELECT *, coalesce(min(CASE WHEN reason IN ('ok', 'invalid_url', 'robots_disallow', 'unsupported_content_type', 'category_landing') THEN k END) OVER (PARTITION BY fetch_id), 3) AS stop FROM a)
SELECT tier AS mode_used, reason, CAST(k + 1 AS INTEGER) AS tiers_tried, count(*) AS n FROM e WHERE k = stop GROUP BY ALL
"""


def chains(spark: SparkSession, folder: str) -> DataFrame:
    """How chains of tiers end under a deadline, with plain headers tried after blocks (STT09, STT10)."""
    i = F.col("request_id")
    ids = table(spark, folder, "fetch_cache").select(F.col("fetch_id").alias("request_id")).distinct()
    reasons = F.array(*map(F.lit, ["ok", "blocked_bot", "timeout", "not_found", "blocked_captcha", "ok"]))
    x = ids.select("request_id", F.posexplode(F.array(*map(F.lit, ["http", "http_plain", "browser", "mobile", "archive"]))).alias("k", "tier")).where((F.col("tier") != "archive") | (i % 2 == 0))
    x = x.select("request_id", "tier", F.element_at(reasons, ((i + F.col("k") * (i % 5)) % 6 + 1).cast("int")).alias("reason"), ((i * 7 + F.col("k") * 3) % 14).cast("double").alias("seconds"), (i % 4).alias("words"))
    return S.chain(x, 20.0)


SQL_CHAINS = """
WITH f AS (SELECT DISTINCT fetch_id AS i FROM fetch_cache), a AS (SELECT i, k, (['ok', 'blocked_bot', 'timeout', 'not_found', 'blocked_captcha', 'ok'])[(i + k * (i % 5)) % 6 + 1] AS r, ((i * 7 + k * 3) % 14)::DOUBLE AS s FROM f, range(5) t(k)),
p AS (SELECT i, max(r) FILTER (k = 0) AS r0, max(r) FILTER (k = 1) AS r1, max(r) FILTER (k = 2) AS b, max(r) FILTER (k = 3) AS m, max(r) FILTER (k = 4) AS ar, least(max(s) FILTER (k = 0), 5) AS s0, least(max(s) FILTER (k = 1), 5) AS s1, least(max(s) FILTER (k = 2), 12) AS sb, least(max(s) FILTER (k = 3), 5) AS sm, least(max(s) FILTER (k = 4), 6) AS sa FROM a GROUP BY i),
h AS (SELECT *, r0 IN ('blocked_cloudflare', 'blocked_bot') AND 20 - s0 >= 1 AS again FROM p), g AS (SELECT *, 20 - s0 - CASE WHEN again THEN s1 ELSE 0 END AS l1, again AND r1 = 'ok' AS plain, CASE WHEN again AND r1 = 'ok' THEN 'ok' ELSE r0 END AS r FROM h),
e AS (SELECT *, r <> 'ok' AND r <> 'not_found' AND l1 < 3 AS late, (r = 'ok' AND NOT (i % 4 = 0 AND l1 >= 3)) OR r = 'not_found' OR (r NOT IN ('ok', 'not_found') AND l1 < 3) AS stop, l1 - sb AS l2 FROM g),
q AS (SELECT *, b IN ('blocked_bot', 'blocked_captcha') AS rb, b IN ('blocked_bot', 'blocked_captcha') AND l2 >= 3 AS tm FROM e), z AS (SELECT *, l2 - CASE WHEN tm THEN sm ELSE 0 END AS l3 FROM q),
w AS (SELECT *, CASE WHEN stop THEN 'http' WHEN NOT rb THEN 'browser' WHEN tm AND m NOT IN ('blocked_bot', 'blocked_captcha') THEN 'browser+mobile' WHEN l3 >= 4 AND i % 2 = 0 THEN 'wayback' ELSE 'last' END AS mode FROM z)
SELECT i AS request_id, CASE WHEN mode = 'last' THEN 'browser' ELSE mode END AS mode_used, CASE mode WHEN 'http' THEN CASE WHEN late THEN 'deadline_exceeded' ELSE r END WHEN 'browser+mobile' THEN m WHEN 'wayback' THEN ar ELSE b END AS reason,
  20 - CASE mode WHEN 'http' THEN l1 WHEN 'browser' THEN l2 WHEN 'wayback' THEN l3 - sa ELSE l3 END AS seconds, CASE WHEN NOT stop THEN 'http' END AS escalated_from, plain AND stop AS plain_headers FROM w
"""


def login_cooldowns(spark: SparkSession, folder: str) -> DataFrame:
    """Events per host that act or wait under a cooldown of a week (STT11)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "url", "fetched_at").dropDuplicates(["fetch_id"])
    x = S.cooldowns(rows.select(F.col("fetch_id").alias("id"), host_of(F.col("url")).alias("host"), F.col("fetched_at").alias("ts")), "host", 7 * 86400)
    return x.groupBy("host", "acts").agg(F.count("*").alias("n"))


SQL_COOLDOWN = f"""
WITH x AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, fetched_at - lag(fetched_at) OVER (PARTITION BY lower(regexp_extract(url, '://([^/?#:]*)', 1)) ORDER BY fetched_at, fetch_id) AS gap FROM ({_ONCE}))
SELECT host, gap IS NULL OR gap >= 604800 AS acts, count(*) AS n FROM x GROUP BY ALL
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "cache_snapshot": (cache_snapshot, _SNAP),
    "cache_lookups": (
        cache_lookups,
        f"WITH c AS ({_SNAP}), a AS (SELECT DISTINCT entry_id, url FROM telemetry WHERE url IS NOT NULL) SELECT c.fetch_id IS NOT NULL AS hit, count(*) AS n, CAST(sum({NOW} - c.fetched_at) AS BIGINT) AS age_sum FROM a LEFT JOIN (SELECT * FROM c WHERE ttl_expires >= {NOW} OR ttl_expires IS NULL) c ON a.url = c.url GROUP BY 1",
    ),
    "cache_list": (cache_list, f"WITH c AS ({_SNAP}) SELECT url, fetched_at FROM c ORDER BY fetched_at DESC, url LIMIT 20"),
    "cache_purged": (
        cache_purged,
        f"WITH c AS ({_SNAP}) SELECT 'all' AS purge, count(*) AS n FROM c UNION ALL SELECT 'expired', count(*) FROM c WHERE NOT coalesce(ttl_expires < {NOW}, false) UNION ALL SELECT 'old', count(*) FROM c WHERE NOT fetched_at < {NOW - 90 * 86400} UNION ALL SELECT 'domain', count(*) FROM c WHERE lower(regexp_extract(url, '://([^/?#:]*)', 1)) <> 'stykraebrei-board.test'",
    ),
    "ttl_by_reason": (ttl_by_reason, f"SELECT failure_reason, count(*) AS n, CASE WHEN failure_reason IS NULL THEN 86400 ELSE CASE failure_reason {_TTL} ELSE 900 END END AS ttl FROM (SELECT DISTINCT fetch_id, failure_reason FROM fetch_cache) GROUP BY failure_reason"),
    "route_strategy": (route_strategy, SQL_STRATEGY),
    "rate_limit": (rate_limit, SQL_RATE),
    "probe_state": (probe_state, SQL_PROBE),
    "single_flights": (single_flights, SQL_FLIGHT),
    "escalations": (escalations, SQL_ESCALATION),
    "chains": (chains, SQL_CHAINS),
    "login_cooldowns": (login_cooldowns, SQL_COOLDOWN),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
