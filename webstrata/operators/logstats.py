"""Rollups of the event log.  Redelivered events count once; null tools are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions.classify import infer_outcome
from webstrata.functions.urls import host_of

FETCH_TOOLS = ["fetch", "fetch_many"]
PHASES = ["network_ms", "parse_ms", "cache_write_ms"]


def events_once(events: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every event with its outcome: stated, or inferred from its exception, failure reason
    and empty passages, where the log has them."""
    older = [c for c in ("exception", "empty_passages") if c in events.columns]
    absent = F.lit(None)
    inferred = infer_outcome(
        F.col("outcome"), F.col("exception") if "exception" in older else absent.cast("string"), F.col("failure_reason"), F.col("empty_passages") if "empty_passages" in older else absent.cast("boolean")
    )
    need = list(dict.fromkeys(["entry_id", "tool", "outcome", "failure_reason", *older, *columns]))
    return events.select(need).dropDuplicates(["entry_id"]).where("tool IS NOT NULL").withColumn("outcome", inferred)


def since(events: DataFrame, last_day: str, days: int) -> DataFrame:
    """Events of the last ``days`` days up to ``last_day``; at least one day."""
    day = F.substring("ts", 1, 10)
    return events.where((day > F.date_sub(F.lit(last_day).cast("date"), max(1, days)).cast("string")) & (day <= last_day))


def nearest_rank(counted: DataFrame, keys: list[str], value: str, count: str, ps: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place round(p (n - 1)) of the sorted values, half to even.

    Works on value counts: running sums over distinct values stand for the sorted list, so that no
    group is gathered into one array."""
    from pyspark.sql import Window as W

    upto = W.partitionBy(*keys).orderBy(value)
    whole = W.partitionBy(*keys)
    x = counted.withColumns({"_hi": F.sum(count).over(upto), "_n": F.sum(count).over(whole)}).withColumn("_lo", F.col("_hi") - F.col(count))

    def at(p: float) -> Column:
        place = F.rint(F.lit(p) * (F.col("_n") - 1))
        return F.max(F.when((place >= F.col("_lo")) & (place < F.col("_hi")), F.col(value))).alias(f"p{round(p * 100)}")

    return x.groupBy(*keys).agg(*[at(p) for p in ps], F.max("_n").alias("count"))


def by_tool(events: DataFrame) -> DataFrame:
    return events_once(events, []).groupBy("tool", "outcome").agg(F.count("*").alias("n"))


def failures(events: DataFrame) -> DataFrame:
    x = events_once(events, []).where("outcome = 'fail' AND failure_reason IS NOT NULL")
    return x.groupBy("failure_reason").agg(F.count("*").alias("n"))


def failure_by_domain(events: DataFrame) -> DataFrame:
    """Failures of fetches per host and reason, with the host's total."""
    x = events_once(events, ["url"]).where("outcome = 'fail' AND failure_reason IS NOT NULL").where(F.col("tool").isin(*FETCH_TOOLS))
    per = x.select(host_of(F.col("url")).alias("domain"), "failure_reason").where("domain <> ''").groupBy("domain", "failure_reason").agg(F.count("*").alias("n"))
    totals = per.groupBy("domain").agg(F.sum("n").alias("domain_total"))
    return per.join(totals, "domain")


def modes_used(events: DataFrame) -> DataFrame:
    x = events_once(events, ["mode_used"]).where(F.col("tool").isin(*FETCH_TOOLS) & (F.col("outcome") == "ok") & F.col("mode_used").isNotNull())
    return x.groupBy("mode_used").agg(F.count("*").alias("n"))


def cache_ratio(events: DataFrame) -> DataFrame:
    x = events_once(events, ["from_cache"]).where(F.col("tool").isin(*FETCH_TOOLS) & (F.col("outcome") == "ok"))
    hits = F.count_if(F.col("from_cache"))
    n = F.count("*")
    return x.agg(n.alias("cache_observations"), F.round(F.when(n > 0, hits / n).otherwise(0.0), 4).alias("cache_hit_ratio"))


def escalation_rate(events: DataFrame) -> DataFrame:
    """Share of good fetches that escalated, per tool; tools without any are left out."""
    x = events_once(events, ["escalated_from"]).where(F.col("tool").isin(*FETCH_TOOLS) & (F.col("outcome") == "ok"))
    escalated = F.count("escalated_from")
    return x.groupBy("tool").agg(escalated.alias("escalated"), F.round(escalated / F.count("*"), 4).alias("rate")).where("escalated > 0")


def escalation_paths(events: DataFrame) -> DataFrame:
    x = events_once(events, ["escalated_from", "mode_used", "url"]).where(F.col("tool").isin(*FETCH_TOOLS) & (F.col("outcome") == "ok") & F.col("escalated_from").isNotNull())
    path = F.concat_ws("→", "escalated_from", F.coalesce("mode_used", F.lit("None")))
    return x.groupBy(host_of(F.col("url")).alias("domain"), path.alias("path")).agg(F.count("*").alias("n")).where("domain <> ''")


def durations(events: DataFrame) -> DataFrame:
    x = events_once(events, ["duration_ms"]).where("outcome IN ('ok', 'empty') AND duration_ms IS NOT NULL")
    counted = x.groupBy("tool", F.col("duration_ms").cast("long").alias("ms")).agg(F.count("*").alias("c"))
    return nearest_rank(counted, ["tool"], "ms", "c", [0.5, 0.95, 0.99])


def phases(events: DataFrame) -> DataFrame:
    x = events_once(events, PHASES).where("outcome = 'ok'")
    long = x.unpivot(["tool"], PHASES, "phase", "ms").where("ms IS NOT NULL")
    counted = long.groupBy("tool", "phase", F.col("ms").cast("long").alias("ms")).agg(F.count("*").alias("c"))
    return nearest_rank(counted, ["tool", "phase"], "ms", "c", [0.5, 0.95, 0.99])


def adapters(events: DataFrame) -> DataFrame:
    x = events_once(events, ["provider", "result_count"]).where(F.col("tool").isin(*FETCH_TOOLS) & (F.col("outcome") == "ok") & F.col("provider").isNotNull())
    zero = F.count_if(F.col("result_count") == 0)
    return x.groupBy("provider").agg(F.count("*").alias("ok"), zero.alias("zero_result"), F.round(zero / F.count("*"), 4).alias("zero_result_rate"))


def answer_usage(events: DataFrame) -> DataFrame:
    """Calls, tokens and cost per provider of answers; cost is summed as decimal, in any order alike."""
    x = events_once(events, ["provider", "input_tokens", "output_tokens", "cost_usd", "fell_back"]).where("tool = 'answer' AND outcome = 'ok' AND provider IS NOT NULL")
    return x.groupBy("provider").agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0)).cast("double").alias("cost_usd"),
        F.count_if(F.col("fell_back")).alias("fell_back"),
    )


def tool_rollup(events: DataFrame) -> DataFrame:
    """Counts per tool and outcome with all their subtotals."""
    x = events_once(events, [])
    return x.rollup("tool", "outcome").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
