"""Merging of records and lists: first source wins, outliers go, groups keep their best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_source_wins(rows: DataFrame, key: str, priority: str, place: str) -> DataFrame:
    """One row per key, of the source with the lowest priority, its earliest place (SET01, SET02).
    A combined minimum over structs keeps hot keys small before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, priority, place)]
    first = F.min_by(F.struct(priority, place, *rest), F.struct(priority, place))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first.alias("_f")).select(key, "_f.*")


def limited_with_notice(rows: DataFrame, order: list[Column], limit: int, columns: list[str]) -> DataFrame:
    """At most ``limit`` rows; one row more, all null but ``note``, where there were more (LIM02)."""
    head = rows.orderBy(*order).limit(limit + 1)
    numbered = head.withColumn("_n", F.row_number().over(W.orderBy(*order)))  # limit + 1 rows at most
    over = F.col("_n") > limit
    return numbered.select(*[F.when(~over, F.col(c)).alias(c) for c in columns], F.when(over, "more results were left out").alias("note"))


def renumbered(rows: DataFrame, group: list[str], order: list[Column], name: str = "position") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))


def exclusive_quantile(counted: DataFrame, keys: list[str], value: str, count: str, ps: dict[str, float]) -> DataFrame:
    """Quantiles by the (n + 1) p rule with interpolation, out of value counts; no group is gathered."""
    upto = W.partitionBy(*keys).orderBy(value)
    x = counted.withColumns({"_hi": F.sum(count).over(upto), "_n": F.sum(count).over(W.partitionBy(*keys))}).withColumn("_lo", F.col("_hi") - F.col(count))

    def at(p: float) -> tuple[Column, Column, Column]:
        # whole-number arithmetic, as p is in quarters
        quarter = round(4 * p)
        j = F.least(F.greatest(F.floor((F.col("_n") + 1) * quarter / 4), F.lit(1)), F.col("_n") - 1)
        delta = (F.col("_n") + 1) * quarter - j * 4
        low = F.max(F.when((j - 1 >= F.col("_lo")) & (j - 1 < F.col("_hi")), F.col(value)))
        high = F.max(F.when((j >= F.col("_lo")) & (j < F.col("_hi")), F.col(value)))
        return low, high, F.max(delta)

    out = []
    for name, p in ps.items():
        low, high, delta = at(p)
        out.append(((low * (4 - delta) + high * delta) / 4).alias(name))
    return x.groupBy(*keys).agg(*out, F.max("_n").alias("n"))


def without_outliers(rows: DataFrame, keys: list[str], value: str, least: int = 8, fence: float = 1.5) -> DataFrame:
    """Rows within Tukey's fences of their group; groups under ``least`` rows or without spread stay whole
    (AGG04).  Null values stay out of the quartiles and in the result."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    q = exclusive_quantile(counted, keys, value, "_c", {"_q1": 0.25, "_q3": 0.75})
    iqr = F.col("_q3") - F.col("_q1")
    inside = F.col(value).between(F.col("_q1") - fence * iqr, F.col("_q3") + fence * iqr)
    kept = (F.coalesce(F.col("n"), F.lit(0)) < least) | (iqr <= 0) | F.coalesce(inside, F.lit(True))
    return rows.join(q, keys, "left").where(kept).drop("_q1", "_q3", "n")


def grouped_offers(offers: DataFrame, key: Column, max_sellers: int | None = None) -> DataFrame:
    """Offers of one product together (AGG03): distinct (store, price) sellers by price, price range,
    first place and the first stated rating, of equal places the lower one."""
    x = offers.withColumn("_k", key)
    sellers = x.select("_k", "store", "price").where("price IS NOT NULL").distinct()
    if max_sellers is not None:
        sellers = renumbered(sellers, ["_k"], [F.col("price"), F.col("store")], "_r").where(F.col("_r") <= max_sellers).drop("_r")
    listed = sellers.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("price", "store"))).alias("sellers"))
    summary = x.groupBy("_k").agg(
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.min("position").alias("position"),
        F.min_by("rating", F.when(F.col("rating").isNotNull(), F.struct("position", "rating"))).alias("rating"),
    )
    return summary.join(listed, "_k", "left").withColumnRenamed("_k", "product_key")


def title_key(title: Column) -> Column:
    """Lower case, single blanks, no closing punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(title), r"\s+", " ")), r"[\s.,;:!?-]+$", "")


def without_intervals(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, key: str, width: int = 60) -> DataFrame:
    """Points in no interval ``start <= at < end`` of the same key (JON06).  Both sides meet on buckets of
    ``width``, an equi-join; an interval is repeated only in the buckets it covers."""
    buckets = intervals.where(F.col(end) > F.col(start)).select(
        key, start, end, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1e-9) / width))).alias("_b")
    )
    marked = points.withColumn("_b", F.floor(F.col(at) / width))
    on = (marked[key] == buckets[key]) & (marked["_b"] == buckets["_b"]) & (marked[at] >= buckets[start]) & (marked[at] < buckets[end])
    return marked.join(buckets, on, "left_anti").drop("_b")


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """The entry with the longest prefix of each text (JON04), by an equi-join on the text's own
    prefixes of the lengths that occur in the list, as many as the list has different lengths: at most the
    length of an address, whatever the list's size."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().orderBy(F.desc(F.length(prefix))).collect()]
    cut = F.array(*[F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    distinct = rows.select(text).distinct()
    tried = distinct.select(text, F.explode(F.array_compact(cut)).alias("_p"))
    found = tried.join(prefixes.select(F.col(prefix).alias("_p"), *columns), "_p").groupBy(text).agg(F.max_by(F.struct("_p", *columns), F.length("_p")).alias("_m"))
    return rows.join(found.select(text, "_m.*").withColumnRenamed("_p", "matched_prefix"), text, "left")


def most_common(rows: DataFrame, key: str, place: str) -> DataFrame:
    """(key, n, first_seen) by number, ties by first place (SRT03)."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(place).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def requested_variant(variants: Column, wanted: Column, fields: list[str]) -> Column:
    """The first variant one of whose ``fields`` is the one wanted, else the first of all (JON11)."""
    hits = F.filter(variants, lambda v: F.array_contains(F.array(*[v[f] for f in fields]), wanted))
    return F.coalesce(F.get(hits, F.lit(0)), F.get(variants, F.lit(0)))
