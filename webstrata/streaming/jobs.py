"""The state machines as streams: each job takes and returns a streaming DataFrame.

Event time is ``ts``; a watermark bounds the state that windows and single flights keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STRATEGY_SCHEMA = "route_key STRING, preferred_mode STRING, success_count LONG, failure_count LONG"


def bump(state: tuple[str | None, int, int], mode: str, success: bool) -> tuple[str | None, int, int]:
    """One outcome folded into (preferred mode, successes, failures in a row)."""
    preferred, good, bad = state
    preferred = preferred or mode
    if success:
        return preferred, good + 1, 0
    if mode != preferred:
        return preferred, good, bad
    return (("browser" if preferred == "http" else "http"), good, 0) if bad >= 2 else (preferred, good, bad + 1)


def route_strategies(outcomes: DataFrame) -> DataFrame:
    """Preferred mode per route, updated with each batch (STT01); columns route_key, mode, success, ts, id."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"])
        for mode, success in zip(rows["mode"], rows["success"]):
            at = bump(tuple(at), mode, bool(success))
        state.update(at)
        yield pd.DataFrame([[key[0], *at]], columns=["route_key", "preferred_mode", "success_count", "failure_count"])

    return outcomes.groupBy("route_key").applyInPandasWithState(
        update, STRATEGY_SCHEMA, "preferred STRING, successes LONG, failures LONG", "update", GroupStateTimeout.NoTimeout
    )


def single_flights(requests: DataFrame, keys: list[str], within: str = "30 seconds") -> DataFrame:
    """The first of equal requests within the watermark (STT08)."""
    return requests.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def outcome_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per tool and outcome in windows of ``size``; events later than ``late`` are left out."""
    kept = events.withWatermark("ts", late)
    counted = kept.groupBy(F.window("ts", size), "tool", "outcome").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "tool", "outcome", "n")


def append_events(events: DataFrame, folder: str, checkpoint: str):  # noqa: ANN201
    """Append a stream of events to a log partitioned by day (SNK04), each event once."""
    stamped = events.withColumn("day", F.to_date("ts").cast("string"))
    return stamped.writeStream.format("json").partitionBy("day").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
