"""Keyed state of the pipeline, as batch folds over ordered events.

Ties in time are ordered by the event's id, so every result is determined.  Keys held by very many
events are folded from counted runs, per-day maps or running windows, never from one gathered array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAILURES_TO_FLIP = 3


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key: an upsert log's snapshot.  A two-phase maximum over structs is combined
    before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    packed = F.struct(*order, *rest)
    return rows.groupBy(*keys).agg(F.max_by(packed, F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: int) -> DataFrame:
    """Requests with the cached row of their address that has not expired, or nulls (JON01, STT03)."""
    fresh = cache.where((F.col("ttl_expires") >= now) | F.col("ttl_expires").isNull())
    return requests.join(fresh, "url", "left")


def purge(cache: DataFrame, now: int, older_than: int | None = None) -> DataFrame:
    """What a purge leaves: rows not expired, or not older than ``older_than`` seconds (SET05)."""
    gone = F.col("fetched_at") < now - older_than if older_than is not None else F.col("ttl_expires") < now
    return cache.where(~F.coalesce(gone, F.lit(False)))


BLOCK_SECONDS = 3600


def carried(rows: DataFrame, key: str, block: str, values: dict[str, Column], carry: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, block, one column per value): what all earlier blocks of a key come to.  ``values`` sum a block
    up, ``carry`` joins the sums of blocks.  Rows of a key never meet in one task; its blocks' sums do."""
    before = W.partitionBy(key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(key, block).agg(*[c.alias(n) for n, c in values.items()])
    return sums.select(key, block, *[carry[n](F.col(n)).over(before).alias(n) for n in values])


def joined_carried(rows: DataFrame, side: DataFrame, key: str, block: str) -> DataFrame:
    """``rows`` with the columns of ``carried``; rows without key or time stay, as a group of their own."""
    renamed = side.withColumnsRenamed({key: "_key", block: "_block"})
    on = rows[key].eqNullSafe(renamed["_key"]) & rows[block].eqNullSafe(renamed["_block"])
    return rows.join(renamed, on).drop("_key", "_block")


def rate_limited_starts(requests: DataFrame, key: str, arrival: str, tie: str, gap: float, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Start of each request when starts of one key are ``gap`` apart (STT06): the i-th start is
    i gap + the running maximum of (arrival - j gap).  Both run within blocks of time, from what the
    blocks before come to."""
    x = requests.withColumn("_b", F.floor(F.col(arrival) / block_seconds))
    w = W.partitionBy(key, "_b").orderBy(arrival, tie)
    x = x.withColumn("_r", F.row_number().over(w) - 1).withColumn("_lead", F.col(arrival) - F.col("_r") * gap)
    base = carried(x, key, "_b", {"_base": F.count("*")}, {"_base": F.sum})
    x = joined_carried(x, base, key, "_b").withColumn("_base", F.coalesce("_base", F.lit(0)))
    x = x.withColumn("_lead", F.col("_lead") - F.col("_base") * gap)
    earlier = carried(x, key, "_b", {"_most": F.max("_lead")}, {"_most": F.max})
    running = F.max("_lead").over(w.rowsBetween(W.unboundedPreceding, 0))
    x = joined_carried(x, earlier, key, "_b").withColumn("_run", running)
    starts = (F.col("_base") + F.col("_r")) * gap + F.greatest("_run", "_most")
    return x.select(*requests.columns, starts.alias("starts_at"))


TIERS = ["http", "browser", "mobile", "archive"]


def strategy(outcomes: DataFrame, modes: list[str] = TIERS) -> DataFrame:
    """Preferred mode per route after all outcomes (STT01): a success adds one and clears failures; a
    failure of the preferred mode counts, and the third in a row flips between http and browser.

    The fold depends on order, yet its state is one of few: a preferred mode of ``modes`` and 0 to 2
    failures.  Each day of a route is folded from every state it may begin in, and the days' maps are
    chained after, so that no task holds a route's whole history."""
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    dated = outcomes.withColumn("_day", day)
    order = W.partitionBy("route_key", "_day").orderBy("ts", "id")
    same = (F.lag("mode").over(order) == F.col("mode")) & (F.lag("success").over(order) == F.col("success"))
    marked = dated.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    keys = ["route_key", "_day"]
    runs = numbered.groupBy(*keys, "_run").agg(F.first("mode").alias("mode"), F.first("success").alias("success"), F.count("*").alias("n"))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_run", "mode", "success", "n"))).alias("runs"))

    def state(preferred: str | None, failed: int) -> Column:
        return F.struct(F.lit(preferred).cast("string").alias("preferred"), F.lit(0).cast("long").alias("successes"), F.lit(failed).cast("long").alias("failures"))

    starts = [(None, 0), *((m, k) for m in modes for k in range(FAILURES_TO_FLIP))]
    names = F.array(*[F.lit(f"{m}|{k}") for m, k in starts])
    ends = F.transform(F.array(*[state(m, k) for m, k in starts]), lambda s: F.aggregate("runs", s, _fold))
    days = listed.select(*keys, F.map_from_arrays(names, ends).alias("ends"))
    chained = days.groupBy("route_key").agg(F.array_sort(F.collect_list(F.struct("_day", F.map_entries("ends").alias("ends")))).alias("days"))

    def step(s: Column, d: Column) -> Column:
        name = F.concat_ws("|", F.coalesce(s["preferred"], F.lit("None")), s["failures"].cast("string"))
        end = F.get(F.filter(d["ends"], lambda e: e["key"] == name), F.lit(0))["value"]
        return F.struct(end["preferred"].alias("preferred"), (s["successes"] + end["successes"]).alias("successes"), end["failures"].alias("failures"))

    return chained.select("route_key", F.aggregate("days", state(None, 0), step).alias("s")).select(
        "route_key", F.col("s.preferred").alias("preferred_mode"), F.col("s.successes").alias("success_count"), F.col("s.failures").alias("failure_count")
    )


def _fold(s: Column, r: Column) -> Column:
    preferred = F.coalesce(s["preferred"], r["mode"])
    total = s["failures"] + r["n"]
    flips = F.floor(total / FAILURES_TO_FLIP)
    # a flip ends the run's mode being preferred: its further failures are not counted
    flipped = F.when(preferred == "http", "browser").otherwise("http")
    failed = F.when(
        preferred == r["mode"],
        F.struct(
            F.when(flips > 0, flipped).otherwise(preferred).alias("preferred"),
            s["successes"].alias("successes"),
            F.when(flips > 0, _after_flip(flipped, r["mode"], total)).otherwise(total).alias("failures"),
        ),
    ).otherwise(F.struct(preferred.alias("preferred"), s["successes"].alias("successes"), s["failures"].alias("failures")))
    succeeded = F.struct(preferred.alias("preferred"), (s["successes"] + r["n"]).alias("successes"), F.lit(0).cast("long").alias("failures"))
    return F.when(r["success"], succeeded).otherwise(failed)


def _after_flip(flipped: Column, mode: Column, total: Column) -> Column:
    """Failures counted after a flip: none, as the run's mode is no longer the preferred one, unless
    the flip leads back to it (modes other than http and browser flip to http)."""
    return F.when(flipped == mode, total % FAILURES_TO_FLIP).otherwise(F.lit(0).cast("long"))


def probe_verdicts(probes: DataFrame, now: int, max_age: int = 30 * 86400) -> DataFrame:
    """Latest verdict per provider and domain, null once older than ``max_age`` seconds (STT05)."""
    x = latest(probes, ["provider", "domain"], ["updated_at", "id"])
    return x.withColumn("is_match", F.when(F.col("updated_at") >= now - max_age, F.col("is_match")))


def single_flight(requests: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Requests of one key in one time bucket share the first one's run (STT08)."""
    x = requests.withColumn("_b", bucket)
    runs = x.groupBy(*keys, "_b").agg(F.min("id").alias("run_id"), F.count("*").alias("shared_by"))
    return x.join(runs, [*keys, "_b"]).drop("_b")


FINAL = ["invalid_url", "robots_disallow", "unsupported_content_type", "category_landing"]


def escalation(attempts: DataFrame) -> DataFrame:
    """The attempt that ends each request's chain of tiers (STT09): the first that is ok or final, else
    the last; with how many tiers were tried."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")), F.lit(len(TIERS) + 1))
    stops = F.col("reason").isin("ok", *FINAL)
    x = attempts.withColumns({"_rank": rank, "_stop": stops})
    best = F.min(F.when(F.col("_stop"), F.col("_rank"))).over(W.partitionBy("request_id"))
    last = F.max("_rank").over(W.partitionBy("request_id"))
    ended = x.withColumn("_end", F.coalesce(best, last)).where("_rank = _end")
    return ended.select("request_id", F.col("tier").alias("mode_used"), "reason", F.col("_rank").cast("int").alias("tiers_tried"))


def cooldowns(events: DataFrame, key: str, seconds: int, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Whether an event may act, given the gap to the one before of its key (STT11).  The one before the
    first of a block of time is the last of the blocks before."""
    x = events.withColumn("_b", F.floor(F.col("ts") / block_seconds))
    last = carried(x, key, "_b", {"_last": F.max("ts")}, {"_last": F.max})
    w = W.partitionBy(key, "_b").orderBy("ts", "id")
    x = joined_carried(x, last, key, "_b").withColumn("_before", F.coalesce(F.lag("ts").over(w), F.col("_last")))
    gap = F.col("ts") - F.col("_before")
    return x.select(*events.columns, (gap.isNull() | (gap >= seconds)).alias("acts"))


# Seconds a tier may take, and that have to be left for it to be tried.
TIER_CAPS = {"http": 5.0, "browser": 12.0, "mobile": 5.0, "archive": 6.0}
TIER_FLOORS = {"http": 0.0, "browser": 3.0, "mobile": 3.0, "archive": 4.0}
HTTP_FLOOR = 1.0
RECOVERABLE = ["blocked_bot", "blocked_captcha", "blocked_cloudflare"]


def tier_budget(tier: Column, remaining: Column) -> Column:
    """(may_run, seconds) of a tier with ``remaining`` seconds of the whole deadline (STT10): null for an
    unknown tier; a plain request gets a second at least."""
    of = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for p in values.items() for x in p]), tier)
    seconds = F.when(of(TIER_CAPS).isNotNull() & remaining.isNotNull(), F.least(remaining, of(TIER_CAPS)))
    return F.struct((remaining >= of(TIER_FLOORS)).alias("may_run"), F.when((tier == "http") & seconds.isNotNull(), F.greatest(seconds, F.lit(HTTP_FLOOR))).otherwise(seconds).alias("seconds"))


def needs_refresh(age_seconds: Column, days: int = 7) -> Column:
    """Whether a consolidated list is missing (null) or older than ``days`` (STT13)."""
    return F.coalesce(age_seconds > days * 86400, F.lit(True))


# Blocks that plain headers may clear, and seconds that a plain request needs.
RETRIED = ["blocked_cloudflare", "blocked_bot"]
PLAIN_SECONDS = 1.0
SETTLED = ["not_found", "unsupported_content_type"]


def chain(attempts: DataFrame, deadline: float = 30.0, snapshots: bool = True) -> DataFrame:
    """How each request's chain of tiers ends (STT09, STT10): (request_id, mode_used, reason, seconds,
    escalated_from, plain_headers).

    ``attempts`` holds what a tier would answer: (request_id, tier, reason, seconds, words), with the tiers of
    ``TIERS`` and ``http_plain``, the plain request with fewer headers.  A tier takes its cap at most.  A
    block on the first request is tried again with plain headers; a success without words goes on to the
    browser, as any failure does that is not settled, while there is time; a block in the browser goes on to
    mobile and the archive, and stands if they do not help."""
    names = [*TIERS, "http_plain"]
    x = attempts.where(F.col("tier").isin(*names)).groupBy("request_id").agg(*[F.max(F.when(F.col("tier") == t, F.struct("reason", "seconds", "words"))).alias(t) for t in names])
    took = lambda t: F.when(F.col(f"{t}.seconds").isNotNull(), F.least(F.col(f"{t}.seconds"), F.lit(TIER_CAPS[t.split("_")[0]]))).otherwise(0.0)
    x = x.withColumn("left", F.lit(deadline) - took("http"))
    again = F.col("http.reason").isin(*RETRIED) & (F.col("left") >= PLAIN_SECONDS) & F.col("http_plain").isNotNull()
    x = x.withColumn("again", F.coalesce(again, F.lit(False)))
    x = x.withColumn("left", F.col("left") - F.when(F.col("again"), took("http_plain")).otherwise(0.0)).withColumn("plain", F.col("again") & (F.col("http_plain.reason") == "ok"))
    x = x.withColumns({"r": F.when(F.col("plain"), "ok").otherwise(F.col("http.reason")), "w": F.when(F.col("plain"), F.col("http_plain.words")).otherwise(F.col("http.words"))})
    timely = F.col("left") >= TIER_FLOORS["browser"]
    empty = (F.col("r") == "ok") & (F.col("w") == 0) & timely
    late = (F.col("r") != "ok") & ~F.col("r").isin(*SETTLED) & ~timely
    ends = F.col("http").isNotNull() & (((F.col("r") == "ok") & ~empty) | F.col("r").isin(*SETTLED) | late)
    x = x.withColumns({"end_http": F.coalesce(ends, F.lit(False)), "late": F.coalesce(late, F.lit(False)), "b": F.coalesce("browser.reason", F.lit("browser_unavailable"))})
    x = x.withColumn("left_b", F.col("left") - took("browser"))
    mobile = (F.col("left_b") >= TIER_FLOORS["mobile"]) & F.col("mobile").isNotNull() & F.col("b").isin(*RECOVERABLE)
    x = x.withColumn("m", F.coalesce(mobile, F.lit(False))).withColumn("left_m", F.col("left_b") - F.when(F.col("m"), took("mobile")).otherwise(0.0))
    stored = F.lit(snapshots) & (F.col("left_m") >= TIER_FLOORS["archive"]) & F.col("archive").isNotNull()
    end = (
        F.when(F.col("end_http"), F.struct(F.lit("http").alias("mode"), F.when(F.col("late"), "deadline_exceeded").otherwise(F.col("r")).alias("reason"), F.col("left").alias("left")))
        .when(~F.col("b").isin(*RECOVERABLE), F.struct(F.lit("browser").alias("mode"), F.col("b").alias("reason"), F.col("left_b").alias("left")))
        .when(F.col("m") & ~F.col("mobile.reason").isin(*RECOVERABLE), F.struct(F.lit("browser+mobile").alias("mode"), F.col("mobile.reason").alias("reason"), F.col("left_m").alias("left")))
        .when(stored, F.struct(F.lit("wayback").alias("mode"), F.col("archive.reason").alias("reason"), (F.col("left_m") - took("archive")).alias("left")))
        .otherwise(F.struct(F.lit("browser").alias("mode"), F.col("b").alias("reason"), F.col("left_m").alias("left")))
    )
    x = x.withColumn("end", end)
    from_http = F.col("http").isNotNull() & ~F.col("end_http")
    return x.select("request_id", F.col("end.mode").alias("mode_used"), F.col("end.reason").alias("reason"), F.round(F.lit(deadline) - F.col("end.left"), 3).alias("seconds"), F.when(from_http, "http").alias("escalated_from"), (F.col("plain") & F.col("end_http")).alias("plain_headers"))
