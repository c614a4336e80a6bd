"""Queries of the event log (LOG01 to LOG12, AGG01, AGG02)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import logstats as L
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]

_E = """e AS (SELECT * EXCLUDE (outcome), coalesce(outcome, CASE WHEN failure_reason IS NOT NULL AND failure_reason <> '' THEN 'fail' ELSE 'ok' END) AS outcome
  FROM (SELECT DISTINCT * FROM telemetry) WHERE tool IS NOT NULL)"""
_FETCH = "tool IN ('fetch', 'fetch_many')"
_HOST = "lower(regexp_extract(url, '://([^/?#:]*)', 1))"


def _ranks(keys: str, source: str) -> str:
    at = lambda p: f"list_sort(list(ms))[CAST(round_even({p} * (count(*) - 1), 0) AS BIGINT) + 1]"
    return f"SELECT {keys}, {at(0.5)} AS p50, {at(0.95)} AS p95, {at(0.99)} AS p99, count(*) AS count FROM {source} GROUP BY {keys}"


def _on(operator: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return operator(table(spark, folder, "telemetry"))

    run.__doc__ = operator.__doc__
    return run


LAST_DAY, DAYS = "2024-03-31", 60


def log_window(spark: SparkSession, folder: str) -> DataFrame:
    """Events per tool in a window of days (LOG12, SRC21)."""
    events = L.since(table(spark, folder, "telemetry"), LAST_DAY, DAYS)
    return L.events_once(events, []).groupBy("tool").agg(F.count("*").alias("n")).withColumn("since", F.date_sub(F.lit(LAST_DAY).cast("date"), DAYS - 1).cast("string"))


CATALOG: dict[str, tuple[Query, str | None]] = {
    "log_by_tool": (_on(L.by_tool), f"WITH {_E} SELECT tool, outcome, count(*) AS n FROM e GROUP BY tool, outcome"),
    "log_failures": (_on(L.failures), f"WITH {_E} SELECT failure_reason, count(*) AS n FROM e WHERE outcome = 'fail' AND failure_reason IS NOT NULL GROUP BY failure_reason"),
    "log_failure_by_domain": (
        _on(L.failure_by_domain),
        f"WITH {_E}, d AS (SELECT {_HOST} AS domain, failure_reason, count(*) AS n FROM e WHERE outcome = 'fail' AND failure_reason IS NOT NULL AND {_FETCH} AND url IS NOT NULL GROUP BY ALL) SELECT domain, failure_reason, n, CAST(sum(n) OVER (PARTITION BY domain) AS BIGINT) AS domain_total FROM d WHERE domain <> ''",
    ),
    "log_modes_used": (_on(L.modes_used), f"WITH {_E} SELECT mode_used, count(*) AS n FROM e WHERE {_FETCH} AND outcome = 'ok' AND mode_used IS NOT NULL GROUP BY mode_used"),
    "log_cache_ratio": (
        _on(L.cache_ratio),
        f"WITH {_E} SELECT count(*) AS cache_observations, CASE WHEN count(*) > 0 THEN round(count_if(from_cache)::DOUBLE / count(*), 4) ELSE 0.0 END AS cache_hit_ratio FROM e WHERE {_FETCH} AND outcome = 'ok'",
    ),
    "log_escalation_rate": (
        _on(L.escalation_rate),
        f"WITH {_E} SELECT tool, count(escalated_from) AS escalated, round(count(escalated_from)::DOUBLE / count(*), 4) AS rate FROM e WHERE {_FETCH} AND outcome = 'ok' GROUP BY tool HAVING count(escalated_from) > 0",
    ),
    "log_escalation_paths": (
        _on(L.escalation_paths),
        f"WITH {_E} SELECT {_HOST} AS domain, escalated_from || '→' || coalesce(mode_used, 'None') AS path, count(*) AS n FROM e WHERE {_FETCH} AND outcome = 'ok' AND escalated_from IS NOT NULL AND {_HOST} <> '' GROUP BY ALL",
    ),
    "log_durations": (_on(L.durations), f"WITH {_E}, d AS (SELECT tool, CAST(duration_ms AS BIGINT) AS ms FROM e WHERE outcome IN ('ok', 'empty') AND duration_ms IS NOT NULL) {_ranks('tool', 'd')}"),
    "log_phases": (
        _on(L.phases),
        f"WITH {_E}, d AS (SELECT tool, phase, ms FROM (SELECT tool, network_ms, parse_ms, cache_write_ms FROM e WHERE outcome = 'ok') UNPIVOT (ms FOR phase IN (network_ms, parse_ms, cache_write_ms))) {_ranks('tool, phase', 'd')}",
    ),
    "log_adapters": (
        _on(L.adapters),
        f"WITH {_E} SELECT provider, count(*) AS ok, coalesce(count_if(result_count = 0), 0) AS zero_result, round(coalesce(count_if(result_count = 0), 0)::DOUBLE / count(*), 4) AS zero_result_rate FROM e WHERE {_FETCH} AND outcome = 'ok' AND provider IS NOT NULL GROUP BY provider",
    ),
    "log_answer_usage": (
        _on(L.answer_usage),
        f"WITH {_E} SELECT provider, count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(CAST(cost_usd AS DECIMAL(18, 6))), 0) AS DOUBLE) AS cost_usd, CAST(coalesce(count_if(fell_back), 0) AS BIGINT) AS fell_back FROM e WHERE tool = 'answer' AND outcome = 'ok' AND provider IS NOT NULL GROUP BY provider",
    ),
    "log_tool_rollup": (_on(L.tool_rollup), f"WITH {_E} SELECT tool, outcome, count(*) AS n, CAST(grouping_id(tool, outcome) AS BIGINT) AS level FROM e GROUP BY ROLLUP (tool, outcome)"),
    "log_window": (
        log_window,
        f"WITH {_E} SELECT tool, count(*) AS n, '2024-02-01' AS since FROM e WHERE substr(ts, 1, 10) > '2024-01-31' AND substr(ts, 1, 10) <= '2024-03-31' GROUP BY tool",
    ),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
