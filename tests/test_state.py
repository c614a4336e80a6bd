import random

from pyspark.sql import functions as F

from webstrata.operators import routing as G
from webstrata.operators import state as S
from webstrata.streaming.jobs import bump


def test_strategy_against_replay(spark):
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(4)}", rng.choice(["http", "http", "browser", "mobile"]), rng.random() < 0.3, f"2024-01-0{rng.randrange(1, 7)}T00:00:0{rng.randrange(9)}", i) for i in range(600)]
    got = {r.route_key: (r.preferred_mode, r.success_count, r.failure_count) for r in S.strategy(spark.createDataFrame(rows, "route_key STRING, mode STRING, success BOOLEAN, ts STRING, id LONG")).collect()}
    want = {}
    for route, mode, success, _, _ in sorted(rows, key=lambda r: (r[3], r[4])):
        want[route] = bump(want.get(route, (None, 0, 0)), mode, success)
    assert got == want
    assert S.strategy(spark.createDataFrame([], "route_key STRING, mode STRING, success BOOLEAN, ts STRING, id LONG")).count() == 0


def test_strategy_flips_after_three(spark):
    rows = [("a", "http", False, "2024-01-01", i) for i in range(3)]
    got = S.strategy(spark.createDataFrame(rows, "route_key STRING, mode STRING, success BOOLEAN, ts STRING, id LONG")).first()
    assert tuple(got) == ("a", "browser", 0, 0)


def test_rate_limit_against_replay(spark):
    rng = random.Random(5)
    rows = [(f"h{rng.randrange(3)}", rng.randrange(100), i) for i in range(200)]
    df = spark.createDataFrame(rows, "h STRING, t LONG, id LONG")
    got = {r.id: r.starts_at for r in S.rate_limited_starts(df, "h", "t", "id", 4).collect()}
    free, want = {}, {}
    for h, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = max(t, free.get(h, 0))
        free[h] = want[i] + 4
    assert got == want


def test_latest_and_purge(spark):
    rows = [("a", 1, 5, None), ("a", 2, 9, 10), ("b", 1, 3, 4), (None, 1, 1, 1)]
    df = spark.createDataFrame(rows, "url STRING, id LONG, fetched_at LONG, ttl_expires LONG")
    last = S.latest(df, ["url"], ["fetched_at", "id"])
    assert sorted(((r.url or "", r.id) for r in last.collect())) == [("", 1), ("a", 2), ("b", 1)]
    assert sorted(r.fetched_at for r in S.purge(df, 5).collect()) == [5, 9]
    hits = S.cache_lookup(spark.createDataFrame([("a",), ("c",)], "url STRING"), last, 10).collect()
    assert {r.url: r.id for r in hits} == {"a": 2, "c": None}


def test_escalation_ends(spark):
    rows = [(1, "http", "timeout"), (1, "browser", "ok"), (1, "archive", "ok"), (2, "http", "invalid_url"), (2, "browser", "ok"), (3, "http", "timeout"), (3, "mobile", "blocked_bot")]
    got = {r.request_id: (r.mode_used, r.reason, r.tiers_tried) for r in S.escalation(spark.createDataFrame(rows, "request_id LONG, tier STRING, reason STRING")).collect()}
    assert got == {1: ("browser", "ok", 2), 2: ("http", "invalid_url", 1), 3: ("mobile", "blocked_bot", 3)}


def test_blocks_of_time_change_nothing(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 400, 3)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id LONG, host STRING, ts LONG")
    for width in (7, 60, 10**6):
        got = {r.id: r.starts_at for r in S.rate_limited_starts(df, "host", "ts", "id", 5, width).collect()}
        want = {}
        for host in ("a", "b", None):
            at = None
            for i, _, t in sorted((r for r in rows if r[1] == host and r[2] is not None), key=lambda r: (r[2], r[0])):
                at = t if at is None else max(t, at + 5)
                want[i] = at
        assert len(got) == 300 and {i: x for i, x in got.items() if x is not None and i in want} == want
        acts = {r.id: r.acts for r in S.cooldowns(df, "host", 4, width).collect()}
        for host in ("a", "b", None):
            mine = sorted((r for r in rows if r[1] == host and r[2] is not None), key=lambda r: (r[2], r[0]))
            for one, before in zip(mine, [None, *mine]):
                assert acts[one[0]] == (before is None or one[2] - before[2] >= 4)
        runs = {r.id: r.in_flight for r in G.in_flight(df.where("ts IS NOT NULL").withColumn("d", F.lit(9)), "host", "ts", "d", width).collect()}
        busy = {}
        for i, h, t in (r for r in rows if r[2] is not None):
            busy.setdefault((h, t), []).append(runs[i])
        for (h, t), seen in busy.items():
            assert max(seen) == sum(h2 == h and t2 is not None and t2 <= t < t2 + 9 for _, h2, t2 in rows)
