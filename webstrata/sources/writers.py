"""Sinks: JSON lines, markdown files, event logs, consolidated lists, cache snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "\n---\n\n"


def json_lines(rows: DataFrame, folder: str) -> None:
    """One object per row; null fields are left out."""
    rows.write.mode("overwrite").json(folder)


def as_json(rows: DataFrame, name: str = "json", pretty: bool = False) -> DataFrame:
    """Each row as one JSON text, on one line or spread over several; other letters than ASCII stay."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true", "pretty": str(pretty).lower()}).alias(name))


def joined_markdown(rows: DataFrame, group: str, place: str, markdown: str) -> DataFrame:
    """The texts of each group in order of place, each closed by a line end, joined by a rule.

    The joined text is the result, so a group has to fit in one row."""
    closed = F.concat(F.regexp_replace(markdown, r"\n+$", ""), F.lit("\n"))
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), closed.alias("t"))))
    return rows.where(F.col(markdown).isNotNull()).groupBy(group).agg(F.array_join(F.transform(parts, lambda x: x["t"]), SEPARATOR).alias("markdown"))


def append_events(events: DataFrame, folder: str, now: Column) -> None:
    """Append events to a log partitioned by day; a missing time becomes ``now``."""
    stamped = events.withColumn("ts", F.coalesce("ts", now)).withColumn("day", F.substring("ts", 1, 10))
    stamped.write.mode("append").partitionBy("day").json(folder)


def consolidated_list(domains: DataFrame, folder: str) -> None:
    """Sorted domains, one per line, in range-partitioned files whose order is that of their names."""
    domains.select("domain").distinct().orderBy("domain").write.mode("overwrite").text(folder)


def merge_snapshot(snapshot: DataFrame, changes: DataFrame, keys: list[str], order: list[str], folder: str) -> DataFrame:
    """The snapshot with newer rows of ``changes``, written to a new ``folder`` and read back (SNK01)."""
    from webstrata.operators.state import latest

    latest(snapshot.unionByName(changes, allowMissingColumns=True), keys, order).write.mode("overwrite").parquet(folder)
    return snapshot.sparkSession.read.parquet(folder)
