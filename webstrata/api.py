"""The engine's entry points, each taking and returning DataFrames.

``fetch`` answers requests from the cache or from recorded responses, ``extract`` finds passages, ``map_sites``
lists addresses, ``cache_*`` keep the cache, ``log_stats`` sums up the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import classify as C
from webstrata.functions.urls import normalize_url
from webstrata.operators import logstats as L
from webstrata.operators import merge as M
from webstrata.operators import rank as R
from webstrata.operators import state as S
from webstrata.operators.domains import purge_domain
from webstrata.operators.envelope import envelopes
from webstrata.operators.routing import excluded

RECORD = [
    "url", "final_url", "canonical_url", "status", "mode_used", "fetched_at", "ttl_expires", "content_type", "title", "byline", "published", "modified", "language", "site_name", "image", "markdown", "failure_reason",
]


def normalize(rows: DataFrame, url: str = "url", name: str = "normalized") -> DataFrame:
    """``rows`` with the canonical form of ``url``."""
    return rows.withColumn(name, normalize_url(F.col(url)))


def classify(responses: DataFrame, name: str = "reason") -> DataFrame:
    """``responses`` (status, html) with their outcome."""
    return responses.withColumn(name, C.classify(F.col("status"), F.col("html")))


def _latest_by_address(rows: DataFrame) -> DataFrame:
    keyed = rows.select(normalize_url(F.col("url")).alias("_key"), "fetch_id", *RECORD).where("_key IS NOT NULL")
    return S.latest(keyed, ["_key"], ["fetched_at", "fetch_id"]).drop("fetch_id")


def fetch(requests: DataFrame, responses: DataFrame, cache: DataFrame, now: int, raw: bool = False) -> DataFrame:
    """One record per request (request_id, url): from the cache where it has the address unexpired, else from
    the latest recorded response, else a failure.  ``responses`` and ``cache`` have the columns ``RECORD`` and
    ``fetch_id``.  A cached record has its age and no timings; ``raw`` adds its warning to successes."""
    asked = requests.select(F.col("request_id"), F.col("url").alias("_asked"), normalize_url(F.col("url")).alias("_key"))
    held = S.latest(cache.select(normalize_url(F.col("url")).alias("_key"), "fetch_id", *RECORD).where("_key IS NOT NULL"), ["_key"], ["fetched_at", "fetch_id"]).drop("fetch_id")
    fresh = held.where((F.col("ttl_expires") >= now) | F.col("ttl_expires").isNull()).select("_key", F.struct(*RECORD).alias("_hit"))
    recorded = _latest_by_address(responses).select("_key", F.struct(*RECORD).alias("_new"))
    both = asked.join(fresh, "_key", "left").join(recorded, "_key", "left").withColumn("_r", F.coalesce("_hit", "_new"))
    rows = both.select(
        F.col("request_id").alias("fetch_id"), F.col("_asked").alias("url"), *[F.col(f"_r.{c}").alias(c) for c in RECORD if c not in ("url", "failure_reason")],
        F.when(F.col("_r").isNull(), "dns_fail").otherwise(F.col("_r.failure_reason")).alias("failure_reason"), F.col("_hit").isNotNull().alias("from_cache"), F.col("_asked"),
    )
    made = envelopes(rows, now).withColumnRenamed("fetch_id", "request_id")
    out = made.join(rows.select(F.col("fetch_id").alias("request_id"), "from_cache").distinct(), "request_id")
    warnings = F.when(F.col("failure").isNull(), F.array(F.lit("raw")) if raw else F.array().cast("array<string>"))
    return out.withColumns({"cache_age_seconds": F.when(F.col("from_cache"), F.col("cache_age_seconds")), "warnings": warnings})


def extract(pages: DataFrame, query: str, top: int = 5, around: int = 400, page_id: str = "fetch_id", text: str = "markdown") -> DataFrame:
    """(page_id, rank, score, offset, context): the best passages of each page."""
    return R.extract_passages(pages, page_id, text, R.tokenize(query), top, around).withColumnRenamed("doc_id", page_id)


def map_sites(sources: list[tuple[str, DataFrame]], limit: int, exclude: list[str] | None = None) -> DataFrame:
    """(url, source, note): addresses of the sources in their order, each once under the first source that has
    it, at most ``limit``, and a last row that says so if there were more.  Sources have (url, place)."""
    rows = None
    for priority, (name, df) in enumerate(sources):
        x = df.select("url", F.lit(priority).alias("priority"), F.col("place").cast("long").alias("seq"), F.lit(name).alias("source"))
        rows = x if rows is None else rows.unionByName(x)
    merged = M.first_source_wins(rows, "url", "priority", "seq").where(~excluded(F.col("url"), [p for p in exclude or [] if p]))
    return M.limited_with_notice(merged, [F.col("priority"), F.col("seq"), F.col("url")], limit, ["url", "source"])


def cache_list(cache: DataFrame, limit: int) -> DataFrame:
    return S.latest(cache, ["url"], ["fetched_at", "fetch_id"]).orderBy(F.desc("fetched_at"), "url").limit(limit)


def cache_purge(cache: DataFrame, now: int, older_than: int | None = None, domain: str | None = None) -> DataFrame:
    """What is left of the cache: by domain, by age, or by expiry."""
    return purge_domain(cache, "url", domain) if domain is not None else S.purge(cache, now, older_than)


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries and their size as text, in bytes."""
    return cache.agg(F.countDistinct("url").alias("entries"), F.coalesce(F.sum(F.octet_length("markdown")), F.lit(0)).alias("bytes"))


def log_stats(events: DataFrame, last_day: str, days: int = 1) -> DataFrame:
    """(section, key, detail, measure, value): all rollups of the log of the last days in one table (AGG01)."""
    window = L.since(events, last_day, days)

    def long(df: DataFrame, section: str, key: str | None = None, detail: str | None = None) -> DataFrame:
        keys = [c for c in (key, detail) if c]
        measures = [c for c in df.columns if c not in keys]
        x = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures])
        x = x.unpivot(keys, measures, "measure", "value") if keys else x.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures])).alias("m")).select("m.*")
        of = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
        return x.select(F.lit(section).alias("section"), of(key).alias("key"), of(detail).alias("detail"), "measure", "value")

    parts = [
        long(L.events_once(window, []).agg(F.count("*").alias("total_events")), "log"),
        long(L.by_tool(window), "by_tool", "tool", "outcome"),
        long(L.failures(window), "failures", "failure_reason"),
        long(L.failure_by_domain(window), "failure_by_domain", "domain", "failure_reason"),
        long(L.modes_used(window), "modes_used", "mode_used"),
        long(L.cache_ratio(window), "cache"),
        long(L.escalation_rate(window), "escalation_rate", "tool"),
        long(L.escalation_paths(window), "escalation_by_domain", "domain", "path"),
        long(L.durations(window), "duration_ms", "tool"),
        long(L.phases(window), "phase_percentiles", "tool", "phase"),
        long(L.adapters(window), "adapters", "provider"),
        long(L.answer_usage(window), "answer_usage", "provider"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
