import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from webstrata.operators import merge as M
from webstrata.operators import rank as R


def okapi(corpus, query):
    n = len(corpus)
    avg = sum(map(len, corpus)) / n
    df = {t: sum(t in d for d in corpus) for d in corpus for t in d}
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query) for d in corpus]


def test_bm25_against_brute_force(spark):
    rng = random.Random(1)
    words = list("abcdefgh")
    docs = {d: [[rng.choice(words) for _ in range(rng.randrange(1, 9))] for _ in range(6)] for d in range(5)}
    query = ["a", "b", "b", "zz"]
    df = spark.createDataFrame([(d, k, t) for d, ps in docs.items() for k, t in enumerate(ps)], "doc_id LONG, passage_no INT, tokens ARRAY<STRING>")
    got = {(r.doc_id, r.passage_no): r.score for r in R.bm25(df, query).collect()}
    for d, ps in docs.items():
        for k, score in enumerate(okapi(ps, query)):
            if set(ps[k]) & set(query):
                assert got.pop((d, k)) == pytest.approx(score)
    assert not got


def test_passages():
    text = "  First paragraph, long enough to count here.  \n\nshort\n\n" + "One sentence of some length. " * 30
    found = R.passages(text)
    assert all(text[o : o + len(p)] == p and len(p) >= 30 for p, o in found)
    assert found[0] == ("First paragraph, long enough to count here.", 2)
    assert len(found) > 5
    assert R.passages(None) == R.passages("") == []
    assert R.passages("日本語のとても短い文章です") == [("日本語のとても短い文章です", 0)]


def test_tokenize():
    assert R.tokenize("Água DO Straße") == ["agua", "do", "strasse"]
    assert R.tokenize("日本語 x") == ["日本", "本語", "x"]


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(250)] + [(900, None), (901, []), (1000, [0.0] * 5)]
    df = spark.createDataFrame(rows, "id LONG, v ARRAY<DOUBLE>")
    got = {}
    for r in R.nearest(df, "id", "v", F.col("id") % 100 == 0, 3, block=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    vec = {i: v for i, v in rows if v and any(v)}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.hypot(*a) / math.hypot(*b)

    for q in (0, 100, 200):
        best = sorted((i for i in vec if i != q), key=lambda i: -cos(vec[q], vec[i]))[:3]
        assert [v for _, v in sorted(got[q])] == best
    assert set(got) == {0, 100, 200}


def test_quartiles_and_outliers(spark):
    rng = random.Random(4)
    groups = {g: [rng.randrange(50) for _ in range(n)] + [10_000] for g, n in (("a", 9), ("b", 30), ("c", 3))}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs] + [("a", None)], "g STRING, x LONG")
    counted = df.where("x IS NOT NULL").groupBy("g", "x").agg(F.count("*").alias("c"))
    for r in M.exclusive_quantile(counted, ["g"], "x", "c", {"q1": 0.25, "q3": 0.75}).collect():
        q1, _, q3 = statistics.quantiles(groups[r.g], n=4)
        assert (r.q1, r.q3) == (q1, q3)
    kept = M.without_outliers(df, ["g"], "x").collect()
    assert {r.g for r in kept if r.x == 10_000} == {"c"}
    assert any(r.x is None for r in kept)


def test_intervals_against_brute_force(spark):
    rng = random.Random(6)
    points = [(rng.choice("ab"), rng.uniform(0, 500), i) for i in range(200)]
    spans = [(rng.choice("ab"), s, s + rng.uniform(-5, 150)) for s in (rng.uniform(0, 500) for _ in range(12))]
    p = spark.createDataFrame(points, "k STRING, t DOUBLE, id INT")
    s = spark.createDataFrame(spans, "k STRING, s DOUBLE, e DOUBLE")
    got = sorted(r.id for r in M.without_intervals(p, "t", s, "s", "e", "k").collect())
    assert got == [i for k, t, i in points if not any(k == a and b <= t < c for a, b, c in spans)]


def test_first_source_and_notice(spark):
    rows = [("u", 1, 5, "x"), ("u", 0, 9, "y"), ("v", 2, 1, "z"), (None, 0, 0, "n")]
    df = spark.createDataFrame(rows, "url STRING, p INT, s INT, source STRING")
    merged = M.first_source_wins(df, "url", "p", "s")
    assert sorted((r.url, r.source) for r in merged.collect()) == [("u", "y"), ("v", "z")]
    limited = M.limited_with_notice(merged, [F.col("p")], 1, ["url"]).collect()
    assert [(r.url, r.note is None) for r in limited] == [("u", True), (None, False)]


def test_longest_prefix(spark):
    rows = spark.createDataFrame([("abc/d",), ("ab",), ("x",), (None,)], "t STRING")
    seeds = spark.createDataFrame([("a", 1), ("abc", 2), ("abd", 3)], "p STRING, tier INT")
    got = {r.t: r.tier for r in M.longest_prefix(rows, "t", seeds, "p", ["tier"]).collect()}
    assert got == {"abc/d": 2, "ab": 1, "x": None, None: None}


def test_extract_in_one_pass_is_the_plan(spark):
    rng = random.Random(4)
    words = "battery ships spare cable river stone the with light über 東京都".split()
    texts = ["\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 30))) + "." for _ in range(rng.randrange(0, 9))) for _ in range(30)] + [None, "", "  "]
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id LONG, text STRING")
    query = R.tokenize("the battery ships with a spare cable")
    cut = R.segment(df.dropDuplicates(["doc_id"]), "doc_id", "text")
    best = R.top_passages(R.bm25(cut, query), 3).join(cut.select("doc_id", "passage_no", "offset", F.length("passage").alias("size")), ["doc_id", "passage_no"]).join(df.distinct(), "doc_id")
    want = best.select("doc_id", "rank", "score", "offset", R.context(F.col("text"), F.col("offset"), F.col("size"), 20).alias("context")).collect()
    got = R.extract_passages(df, "doc_id", "text", query, 3, 20).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 40
    assert R.extract_passages(df.limit(0), "doc_id", "text", query, 3, 20).count() == 0


def test_index_recall_and_odd_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.6 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(300)] + [(3000, None), (3001, []), (3002, [0.0] * 16), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>")
    ask = F.col("id") % 100 == 0
    exact, found = (f(df, "vec_id", "embedding", ask, 5) for f in (R.nearest, R.nearest_indexed))
    x = R.recall(found.where("vec_id IS NOT NULL"), exact.where("vec_id IS NOT NULL")).first()
    assert x.recall >= 0.9 and x.n_queries == 18
    assert R.nearest_indexed(df.limit(0), "vec_id", "embedding", ask, 5).count() == 0
