"""The one result record of a fetch: success or failure, never both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.classify import ttl_seconds
from webstrata.functions.text import payload_digest, payloads, token_estimate, word_count

REFRESHABLE = ["blocked_captcha", "blocked_cloudflare"]


def failure_of(reason: Column, markdown: Column) -> Column:
    """The failure record, or null for a success.  Hidden payloads fail a success and leave only their
    digests; a success without words fails as empty."""
    hidden = payloads(markdown)
    why = F.when(reason.isNotNull(), reason).when(F.size(hidden) > 0, "prompt_smuggling").when(word_count(markdown) == 0, "empty_body")
    return F.when(
        why.isNotNull(),
        F.struct(
            why.alias("reason"),
            F.when(why.isin(*REFRESHABLE), "refresh").alias("hint"),
            F.when(why == "prompt_smuggling", F.array_sort(F.transform(hidden, payload_digest))).alias("payload_sha256"),
        ),
    )


def envelopes(fetches: DataFrame, now: int) -> DataFrame:
    """One row per fetch, redelivered ones once; ``now`` in epoch seconds is a parameter, so that ages
    and expiry can be reproduced.  Content columns are null on a failure."""
    once = fetches.select(
        "fetch_id", "url", "final_url", "canonical_url", "status", "mode_used", "fetched_at", "ttl_expires", "content_type", "title", "byline",
        "published", "modified", "language", "site_name", "image", "markdown", "failure_reason",
    ).dropDuplicates(["fetch_id"])
    x = once.withColumn("failure", failure_of(F.col("failure_reason"), F.col("markdown")))
    ok = F.col("failure").isNull()
    kept = {c: F.when(ok, F.col(c)) for c in ("title", "byline", "published", "modified", "language", "site_name", "image")}
    return x.select(
        "fetch_id",
        F.col("url").alias("url_requested"),
        F.coalesce("final_url", "url").alias("url_final"),
        F.coalesce("canonical_url", "final_url", "url").alias("url_canonical"),
        F.col("status").alias("http_status"),
        "mode_used",
        "fetched_at",
        (F.lit(now) - F.col("fetched_at")).alias("cache_age_seconds"),
        F.coalesce(F.col("ttl_expires") < now, F.lit(False)).alias("expired"),
        ttl_seconds(F.col("failure.reason")).alias("ttl_seconds"),
        "content_type",
        *[c.alias(name) for name, c in kept.items()],
        F.when(ok, word_count(F.col("markdown"))).alias("word_count"),
        F.when(ok, token_estimate(F.col("markdown"))).alias("token_count_estimate"),
        F.when(ok, F.col("markdown")).alias("markdown"),
        "failure",
    )


def metadata_view(rows: DataFrame) -> DataFrame:
    """Envelopes without their text."""
    return rows.drop("markdown")
