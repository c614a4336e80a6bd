"""Log events out of results, and timings on results.

Every event has a tool and an outcome; what a result does not carry is null and left out when written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASE_COLUMNS = ["network_ms", "parse_ms", "cache_write_ms", "attempts"]
FETCH_FIELDS = ["mode_used", "http_status", "word_count", "cache_age_seconds", "duration_ms", *PHASE_COLUMNS, "escalated_from"]


def stamp_phases(rows: DataFrame, started: str, ended: str, phases: str) -> DataFrame:
    """Results with their duration and, where ``phases`` (a struct of network_ms, parse_ms, cache_write_ms,
    attempts, escalated_from) is not null, every phase even if it is 0 (PRJ06).  Without phases, as for a
    cache hit, only the duration is stamped.  Times are in seconds."""
    x = rows.withColumn("duration_ms", F.floor((F.col(ended) - F.col(started)) * 1000).cast("long"))
    p = F.col(phases)
    for name in PHASE_COLUMNS:
        x = x.withColumn(name, F.when(p.isNotNull(), F.coalesce(p[name], F.lit(0))))
    return x.withColumn("escalated_from", p["escalated_from"])


def fetch_events(envelopes: DataFrame, tool: str = "fetch") -> DataFrame:
    """One event per result of a fetch (PRJ05): its address, mode, timings, and for page records their
    provider, page type and number of results.  ``envelopes`` has ``url_requested``, ``from_cache``,
    ``failure`` (a struct with ``reason``, null for a success), ``quality`` (a struct with ``provider``,
    ``page_type`` and ``result_count``) and any of the other fields; absent ones are null."""
    have = set(envelopes.columns)
    fields = [(F.col(c) if c in have else F.lit(None)).cast("string" if c in ("mode_used", "escalated_from") else "long").alias(c) for c in FETCH_FIELDS]
    q = F.col("quality")
    by = q["provider"].isNotNull() & (q["provider"] != "")
    return envelopes.select(
        F.lit(tool).alias("tool"),
        F.when(F.col("failure").isNotNull(), "fail").otherwise("ok").alias("outcome"),
        F.col("failure.reason").alias("failure_reason"),
        F.col("url_requested").alias("url"),
        F.coalesce("from_cache", F.lit(False)).alias("from_cache"),
        *fields,
        *[F.when(by, q[c]).alias(c) for c in ("provider", "page_type", "result_count")],
    )


def answer_events(answers: DataFrame) -> DataFrame:
    """One event per answer (PRJ05): provider, tokens and cost out of its ``usage`` struct."""
    u = F.col("usage")
    names = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cost_usd"]
    return answers.select(F.lit("answer").alias("tool"), F.lit("ok").alias("outcome"), "provider", *[u[n].alias(n) for n in names], "fell_back")


def exception_events(errors: DataFrame, tool: str) -> DataFrame:
    """One event per error (PRJ05): its type and message as one text."""
    return errors.select(F.lit(tool).alias("tool"), F.lit("exception").alias("outcome"), F.concat_ws(": ", "type", "message").alias("exception"))


MESSAGE_CAP = 512  # a fixed value: longer escaped payloads are cut


def escaped(text: Column) -> Column:
    """``text`` as printable ASCII, all else as ``\\uXXXX`` in UTF-16 units, at most ``MESSAGE_CAP``
    characters (TXT20)."""
    units = F.regexp_extract_all(F.lower(F.hex(F.encode(text, "UTF-16BE"))), F.lit("(.{4})"), F.lit(1))
    one = lambda u: F.when((u >= "0020") & (u <= "007e"), F.char(F.conv(u, 16, 10).cast("int"))).otherwise(F.concat(F.lit("\\u"), u))
    return F.substring(F.array_join(F.transform(units, one), ""), 1, MESSAGE_CAP)


def payload_events(rows: DataFrame, tool: str, url: str, payloads: str, action: str = "withheld") -> DataFrame:
    """One event per text with hidden payloads (PRJ05), with their escaped content.  ``payloads`` is the
    array of ``functions.text.payloads``."""
    found = F.transform(payloads, lambda p: F.struct(p["kind"].alias("kind"), escaped(F.coalesce(p["decoded"], p["raw"])).alias("text")))
    return rows.where(F.size(payloads) > 0).select(
        F.lit(tool).alias("tool"), F.lit("smuggling").alias("outcome"), F.lit(action).alias("action"), F.col(url).alias("url"), F.size(payloads).alias("payload_count"), found.alias("payloads")
    )


def payload_message(kinds: Column, count: Column) -> Column:
    """What a result says in place of text with hidden payloads (TXT20)."""
    return F.concat(F.lit("hidden text found: "), count.cast("string"), F.lit(" ("), F.array_join(F.sort_array(F.array_distinct(kinds)), ", "), F.lit(")"))
