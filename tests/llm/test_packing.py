import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from webstrata.llm import packing as P

CONTAINERS = "container_kind STRING, capacity_tokens INT"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.dictionaries(st.integers(1, 80), st.integers(0, 40), max_size=12))
def test_plans_hold_everything(capacity, histogram):
    histogram = {s: n for s, n in histogram.items() if s <= capacity}
    groups = P.plan_containers(histogram, capacity)
    held: dict[int, int] = {}
    for g in groups:
        assert sum(s * m for s, m in g.content.items()) == capacity - g.left and g.left >= 0 and g.count > 0
        for s, m in g.content.items():
            held[s] = held.get(s, 0) + m * g.count
    assert held == {s: n for s, n in histogram.items() if n}


def test_fill_is_close_to_the_bound():
    rng = random.Random(1)
    histogram: dict[int, int] = {}
    for _ in range(5000):
        s = min(512, int(rng.lognormvariate(5, 0.8)) + 1)
        histogram[s] = histogram.get(s, 0) + 1
    used = sum(g.count for g in P.plan_containers(histogram, 512))
    least = -(-sum(s * n for s, n in histogram.items()) // 512)
    assert used <= 1.03 * least


def test_nnls_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((5, 3)), rng.random(5)
        x = P.nnls(a, b)
        assert (x >= 0).all()
        best = min(np.linalg.norm(a @ np.array([i, j, k]) - b) for i in np.linspace(0, 2, 21) for j in np.linspace(0, 2, 21) for k in np.linspace(0, 2, 21))
        assert np.linalg.norm(a @ x - b) <= best + 1e-9


def test_pack(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, 1, 3, 3, 3, 7, 10, 11, 25])) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id LONG, n_tokens LONG")
    kinds = spark.createDataFrame([("s", 10), ("l", 24), ("none", 0)], CONTAINERS)
    rows = P.pack(df, kinds).collect()
    want = dict(sizes)
    for kind, capacity in (("s", 10), ("l", 24)):
        mine = [r for r in rows if r.container_kind == kind]
        load: dict[int, int] = {}
        got: dict[int, list] = {}
        for r in mine:
            load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
            got.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        assert max(load.values()) <= capacity and sorted(load) == list(range(max(load) + 1))
        for doc, n in want.items():
            parts = sorted(got[doc])
            assert sum(k for _, k in parts) == n and [s for s, _ in parts] == [capacity * i for i in range(len(parts))]
            assert len(parts) == max(1, -(-n // capacity))
    assert {r.container_kind for r in rows} == {"s", "l"}
    joined = P.plan_packing(df, kinds, plan_bytes=0, rank_part=7)
    again = P.plan_packing(df, kinds, rank_part=7).pieces.collect()
    assert sorted(map(tuple, joined.pieces.collect())) == sorted(map(tuple, again))
    for kind in ("s", "l"):
        assert joined.containers[kind] == 1 + max(r.container_id for r in rows if r.container_kind == kind)
        assert 0 < joined.from_patterns[kind] <= joined.containers[kind]
    checks = P.fill_checks(df, kinds).collect()
    assert sorted(map(tuple, checks)) == [("l", 400, 0, 0, 0), ("s", 400, 0, 0, 0)]
    assert {r.container_kind for r in P.fill_report(df, kinds).collect()} == {"s", "l"}
    assert P.pack(df.limit(0), kinds).count() == 0 and P.pack(df, kinds.limit(0)).count() == 0
