"""Queries of small rules: headers, downloads, archives, budgets, events, ids, orders (CLS10, CLS20, CLS22, SRC10, SRC15, STT10, STT13, PRJ05, PRJ06, ARR02, SRT03, JON11, URL20, SNK02)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import classify as C
from webstrata.functions import text as T
from webstrata.functions import values as V
from webstrata.operators import archive as A
from webstrata.operators import events as E
from webstrata.operators import merge as M
from webstrata.operators import state as S
from webstrata.session import table
from webstrata.sources import readers as I
from webstrata.sources import writers as O

Query = Callable[[SparkSession, str], DataFrame]


def _fetches(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", *columns).dropDuplicates(["fetch_id"])


def _events(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "telemetry").select("entry_id", *columns).dropDuplicates(["entry_id"])


def _pick(values: list, by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def response_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Waits and lengths out of headers in any letter case (CLS10)."""
    n = F.col("word_count").cast("string")
    headers = F.create_map(_pick(["Retry-After", "RETRY-AFTER", "X-Other"], "fetch_id"), F.concat(F.lit(" "), n), F.lit("content-Length"), F.when(F.col("fetch_id") % 4 == 0, F.concat(n, F.lit("b"))).otherwise(n))
    rows = _fetches(spark, folder, "word_count").where("word_count IS NOT NULL")
    return rows.select("fetch_id", C.retry_after(headers).alias("retry_after"), C.content_length(headers).alias("content_length"))


SQL_HEADERS = """
SELECT DISTINCT fetch_id, CASE WHEN fetch_id % 3 < 2 THEN CAST(word_count AS BIGINT) END AS retry_after, CASE WHEN fetch_id % 4 > 0 THEN CAST(word_count AS BIGINT) END AS content_length FROM fetch_cache WHERE word_count IS NOT NULL
"""


def document_downloads(spark: SparkSession, folder: str) -> DataFrame:
    """Which downloads are no documents, and why (SRC15)."""
    body = F.encode(F.concat(_pick(["%PDF-1.7 ", "<html>", "Just a moment... "], "fetch_id"), F.coalesce("title", F.lit(""))), "UTF-8")
    rows = _fetches(spark, folder, "title", "status")
    return rows.select("fetch_id", C.document_failure(F.col("status"), body, F.lit(True)).alias("failure"))


SQL_DOWNLOADS = """
WITH f AS (SELECT DISTINCT fetch_id, coalesce(status, 0) AS s, coalesce(title, '') AS t FROM fetch_cache), k AS (SELECT *, fetch_id % 3 AS k FROM f)
SELECT fetch_id, CASE WHEN s BETWEEN 200 AND 299 THEN CASE k WHEN 0 THEN NULL WHEN 1 THEN 'unsupported_content_type' ELSE 'blocked_cloudflare' END
  WHEN s = 0 THEN 'dns_fail' WHEN s IN (404, 410) THEN 'not_found' WHEN s = 401 THEN CASE WHEN k = 2 THEN 'blocked_cloudflare' ELSE 'login_required' END WHEN s = 403 THEN 'blocked_cloudflare' WHEN s = 429 AND k = 2 THEN 'blocked_cloudflare'
  WHEN s BETWEEN 300 AND 399 AND k = 2 THEN 'blocked_cloudflare' ELSE 'server_error' END AS failure FROM k
"""


def archive_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshots out of answers to two variants of each address (SRC10, SRC12)."""
    url = F.concat(F.lit("http://web.archive.org/web/2024010"), (F.col("fetch_id") % 9).cast("string"), F.lit("000000/"), F.col("url"))
    closest = F.struct((F.col("fetch_id") % 5 != 0).alias("available"), F.when(F.col("fetch_id") % 7 == 0, "404").otherwise("200").alias("status"), url.alias("url"))
    body = F.to_json(F.struct(F.struct(closest.alias("closest")).alias("archived_snapshots")))
    first = F.struct(F.when(F.col("fetch_id") % 2 == 0, 503).otherwise(200).alias("status"), F.when(F.col("fetch_id") % 3 == 0, '{"archived_snapshots": {}}').otherwise(body).alias("body"))
    second = F.struct(F.lit(200).alias("status"), body.alias("body"))
    return _fetches(spark, folder, "url").select("fetch_id", A.first_snapshot(F.array(first, second)).alias("snapshot"))


SQL_SNAPSHOTS = """
SELECT DISTINCT fetch_id, CASE WHEN fetch_id % 5 <> 0 AND fetch_id % 7 <> 0 AND (fetch_id % 2 = 0 OR fetch_id % 3 <> 0) THEN 'https://web.archive.org/web/2024010' || fetch_id % 9 || '000000if_/' || url END AS snapshot FROM fetch_cache
"""


def auth_walls(spark: SparkSession, folder: str) -> DataFrame:
    """Task pages that only ask to log in (CLS20)."""
    html = F.concat(F.lit("<title> "), _pick(["Login", "Task", "x"], "fetch_id"), F.lit("\n</title>"), _pick(["", "", "", "You shall NOT pass", "id='phabricator-login'"], "fetch_id"), F.coalesce("title", F.lit("")))
    return _fetches(spark, folder, "title").select("fetch_id", C.is_auth_wall(html).alias("wall"))


SQL_WALLS = "SELECT DISTINCT fetch_id, fetch_id % 3 = 0 OR fetch_id % 5 >= 3 AS wall FROM fetch_cache"


def old_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Outcomes of events with and without one (CLS22)."""
    x = _events(spark, folder, "outcome", "failure_reason")
    error = F.when(F.col("entry_id") % 6 == 0, "ValueError: x").when(F.col("entry_id") % 6 == 1, "")
    return x.select("entry_id", C.infer_outcome(F.col("outcome"), error, F.col("failure_reason"), F.col("entry_id") % 4 == 0).alias("outcome"))


SQL_OUTCOMES = """
SELECT DISTINCT entry_id, coalesce(outcome, CASE WHEN entry_id % 6 = 0 THEN 'exception' WHEN failure_reason <> '' THEN 'fail' WHEN entry_id % 4 = 0 THEN 'empty' ELSE 'ok' END) AS outcome FROM telemetry
"""


def tier_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Whether and how long each tier may run with what is left of the deadline (STT10)."""
    left = (30000 - F.coalesce("duration_ms", F.lit(0)) % 30000) / 1000
    rows = _events(spark, folder, "duration_ms").select("entry_id", left.alias("left"), F.explode(F.array(*map(F.lit, S.TIERS))).alias("tier"))
    return rows.select("entry_id", "tier", S.tier_budget(F.col("tier"), F.col("left")).alias("b")).select("entry_id", "tier", "b.may_run", "b.seconds")


SQL_BUDGETS = """
WITH t(tier, cap, floor) AS (VALUES ('http', 5.0, 0.0), ('browser', 12.0, 3.0), ('mobile', 5.0, 3.0), ('archive', 6.0, 4.0)), e AS (SELECT DISTINCT entry_id, (30000 - coalesce(duration_ms, 0) % 30000)::DOUBLE / 1000 AS rest FROM telemetry)
SELECT entry_id, tier, rest >= floor AS may_run, CASE WHEN tier = 'http' THEN greatest(least(rest, cap), 1.0) ELSE least(rest, cap) END::DOUBLE AS seconds FROM e, t
"""


def list_ages(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a list last written at each fetch's time is due (STT13)."""
    return _fetches(spark, folder, "fetched_at").select("fetch_id", S.needs_refresh(F.lit(1_705_000_000) - F.col("fetched_at")).alias("due"))


SQL_AGES = "SELECT DISTINCT fetch_id, coalesce(1705000000 - fetched_at > 604800, true) AS due FROM fetch_cache"


def logged_fetches(spark: SparkSession, folder: str) -> DataFrame:
    """Events made of results with their timings (PRJ05, PRJ06)."""
    x = _events(spark, folder, "url", "mode_used", "failure_reason", "provider", "from_cache", "network_ms", "parse_ms", "result_count", "escalated_from", "duration_ms")
    phases = F.when(~F.coalesce("from_cache", F.lit(False)), F.struct("network_ms", "parse_ms", F.lit(None).cast("long").alias("cache_write_ms"), F.lit(1).cast("long").alias("attempts"), "escalated_from"))
    rows = x.select(
        "entry_id", F.col("url").alias("url_requested"), "from_cache", "mode_used", F.when(F.col("failure_reason").isNotNull(), F.struct(F.col("failure_reason").alias("reason"))).alias("failure"),
        F.struct("provider", F.lit("page").alias("page_type"), "result_count").alias("quality"), phases.alias("phases"), F.lit(0.0).alias("began"), (F.coalesce("duration_ms", F.lit(0)) + 0.5).alias("ended_ms"),
    ).withColumn("ended", F.col("ended_ms") / 1000)
    events = E.fetch_events(E.stamp_phases(rows, "began", "ended", "phases"))
    keep = ["outcome", "failure_reason", "from_cache", "mode_used", "duration_ms", "network_ms", "cache_write_ms", "attempts", "escalated_from", "provider", "page_type"]
    return events.groupBy(*keep).agg(F.count("*").alias("n"), F.sum("result_count").alias("results"))


SQL_LOGGED = """
WITH e AS (SELECT * FROM (SELECT DISTINCT entry_id, mode_used, failure_reason, provider, coalesce(from_cache, false) AS from_cache, network_ms, result_count, escalated_from, coalesce(duration_ms, 0) AS duration_ms FROM telemetry))
SELECT CASE WHEN failure_reason IS NULL THEN 'ok' ELSE 'fail' END AS outcome, failure_reason, from_cache, mode_used, duration_ms, CASE WHEN NOT from_cache THEN coalesce(network_ms, 0) END AS network_ms, CASE WHEN NOT from_cache THEN 0 END AS cache_write_ms,
  CASE WHEN NOT from_cache THEN 1 END AS attempts, CASE WHEN NOT from_cache THEN escalated_from END AS escalated_from, nullif(provider, '') AS provider, CASE WHEN provider <> '' THEN 'page' END AS page_type, count(*) AS n, CAST(sum(CASE WHEN provider <> '' THEN result_count END) AS BIGINT) AS results FROM e GROUP BY ALL
"""


def hidden_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events and messages of texts with planted hidden payloads (PRJ05, TXT20)."""
    tags = "".join(chr(0xE0000 + ord(c)) for c in "go on")
    d = table(spark, folder, "documents").select("doc_id", "url", F.concat(F.coalesce("title", F.lit("")), F.lit(tags + "\U000e0021"), F.lit("​‌" * 8)).alias("t")).withColumn("p", T.payloads(F.col("t")))
    events = E.payload_events(d.withColumn("key", F.col("doc_id").cast("string")), "fetch", "key", "p")
    message = E.payload_message(F.transform("payloads", lambda p: p["kind"]), F.col("payload_count"))
    return events.select(F.col("url").cast("long").alias("doc_id"), "payload_count", F.get("payloads", F.lit(0))["text"].alias("first"), F.get("payloads", F.lit(1))["text"].alias("second"), message.alias("message"))


SQL_HIDDEN = "SELECT doc_id, 2 AS payload_count, 'go on!' AS first, repeat('\\u200b\\u200c', 8) AS second, 'hidden text found: 2 (tag_block, zero_width)' AS message FROM documents"


def answer_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events of answers with their usage (PRJ05)."""
    x = _events(spark, folder, "provider", "input_tokens", "output_tokens", "cost_usd", "fell_back")
    usage = F.struct("input_tokens", "output_tokens", F.lit(None).cast("long").alias("cache_read_input_tokens"), "cost_usd")
    return E.answer_events(x.select("provider", usage.alias("usage"), "fell_back")).groupBy("tool", "provider", "fell_back").agg(F.sum("input_tokens").alias("input_tokens"), F.count("cache_read_input_tokens").alias("cached"))


SQL_ANSWERS = "SELECT 'answer' AS tool, provider, fell_back, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(0 AS BIGINT) AS cached FROM (SELECT DISTINCT entry_id, provider, fell_back, input_tokens FROM telemetry) GROUP BY ALL"


def compact_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records without their empty values, as JSON (ARR02)."""
    d = table(spark, folder, "documents").select("doc_id", F.struct("doc_id", F.when(F.col("doc_id") % 2 == 0, "").otherwise("x").alias("a"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("y"))).alias("b"), F.struct(F.when(F.col("doc_id") % 5 > 0, 1).alias("d")).alias("c")).alias("r"))
    return d.select("doc_id", V.compact(F.col("r"), d.schema["r"].dataType).alias("json"))


SQL_COMPACT = """
SELECT doc_id, '{"doc_id":' || doc_id || CASE WHEN doc_id % 2 = 1 THEN ',"a":"x"' ELSE '' END || CASE WHEN doc_id % 3 > 0 THEN ',"b":["y"]' ELSE '' END || CASE WHEN doc_id % 5 > 0 THEN ',"c":{"d":1}' ELSE '' END || '}' AS json FROM documents
"""


def pretty_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records as JSON spread over lines (SNK02)."""
    return O.as_json(table(spark, folder, "sites").select("host", "site_name"), pretty=True)


SQL_PRETTY = "SELECT '{' || chr(10) || '  \"host\" : \"' || host || '\",' || chr(10) || '  \"site_name\" : \"' || site_name || '\"' || chr(10) || '}' AS json FROM sites"


def common_modes(spark: SparkSession, folder: str) -> DataFrame:
    """Modes by how often they were used, ties by the first use (SRT03)."""
    return M.most_common(_events(spark, folder, "mode_used"), "mode_used", "entry_id")


SQL_COMMON = "SELECT mode_used, count(*) AS n, min(entry_id) AS first_seen FROM (SELECT DISTINCT entry_id, mode_used FROM telemetry) WHERE mode_used IS NOT NULL GROUP BY mode_used ORDER BY n DESC, first_seen"


def wanted_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The variant an address asks for, else the first (JON11)."""
    key = F.col("p_partkey").cast("string")
    made = lambda i: F.struct(F.concat(F.lit(f"a{i}-"), key).alias("id"), F.concat(F.lit(f"s{i}-"), key).alias("sku"), F.lit(i).alias("n"))
    wanted = F.concat(_pick(["a2-", "s3-", "none-"], "p_partkey"), key)
    return table(spark, folder, "part").select("p_partkey", M.requested_variant(F.array(made(1), made(2), made(3)), wanted, ["id", "sku"])["n"].alias("n"))


SQL_WANTED = "SELECT p_partkey, CAST((CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 1 END) AS INTEGER) AS n FROM part"


def scholar_ids(spark: SparkSession, folder: str) -> DataFrame:
    """ORCID, PII and PMC numbers out of addresses (URL20)."""
    n = F.lpad(F.col("response_id").cast("string"), 4, "0")
    c = table(spark, folder, "crossref").select("response_id").distinct()
    path = _pick(["/science/article/pii/", "/retrieve/", "/science/article/abs/pii/x"], "response_id")
    return c.select(
        "response_id",
        V.orcid(F.concat(F.lit("https://orcid.org/0000-0001-"), n, F.lit("-123x"))).alias("orcid"),
        V.pii(F.concat(path, F.lit("s0140-67362"), n, F.lit("x"))).alias("pii"),
        V.pmcid(F.concat(F.lit("/articles/pmc"), n, F.lit("/"))).alias("pmcid"),
    )


SQL_IDS = """
WITH c AS (SELECT DISTINCT response_id, lpad(CAST(response_id AS VARCHAR), 4, '0') AS n FROM crossref)
SELECT response_id, '0000-0001-' || n || '-123X' AS orcid, CASE WHEN response_id % 3 < 2 THEN 'S0140-67362' || n || 'X' END AS pii, n AS pmcid FROM c
"""


def thin_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of converted documents with next to no text, and the document with better readings put in (SRC13)."""
    d = _fetches(spark, folder, "title").select("fetch_id", F.split(F.concat(F.coalesce("title", F.lit("")), F.lit("\f  x \fa long page of many letters\f")), "\f").alias("pages"))
    read = F.create_map(F.lit(2), F.lit("read again"), F.lit(3), F.lit("short"))
    return d.select("fetch_id", F.array_join(I.thin_pages(F.col("pages")), ",").alias("thin"), F.get(I.with_read_pages(F.col("pages"), read), F.lit(1)).alias("second"), F.get(I.with_read_pages(F.col("pages"), read), F.lit(2)).alias("third"))


SQL_THIN = """
SELECT DISTINCT fetch_id, CASE WHEN length(trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g'))) < 16 THEN '1,2,4' ELSE '2,4' END AS thin, 'read again' AS second, 'a long page of many letters' AS third FROM fetch_cache
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "response_headers": (response_headers, SQL_HEADERS),
    "document_downloads": (document_downloads, SQL_DOWNLOADS),
    "archive_snapshots": (archive_snapshots, SQL_SNAPSHOTS),
    "auth_walls": (auth_walls, SQL_WALLS),
    "old_outcomes": (old_outcomes, SQL_OUTCOMES),
    "tier_budgets": (tier_budgets, SQL_BUDGETS),
    "list_ages": (list_ages, SQL_AGES),
    "logged_fetches": (logged_fetches, SQL_LOGGED),
    "hidden_events": (hidden_events, SQL_HIDDEN),
    "answer_log": (answer_log, SQL_ANSWERS),
    "compact_records": (compact_records, SQL_COMPACT),
    "pretty_records": (pretty_records, SQL_PRETTY),
    "common_modes": (common_modes, SQL_COMMON),
    "wanted_variants": (wanted_variants, SQL_WANTED),
    "scholar_ids": (scholar_ids, SQL_IDS),
    "thin_pages": (thin_pages, SQL_THIN),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
