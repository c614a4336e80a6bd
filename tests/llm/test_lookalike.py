import unicodedata
from collections import Counter

from tests.llm.data import FETCH, fetch_rows, odd_fetches
from webstrata.llm import lookalike as L

SAME = [
    ("Análisis del X", "Análisis d​el X"),
    ("Krosa FR-22", "Krosa FR‑22"),
    ("ABC: 12", "ＡＢＣ：　12"),
    ("pace", "расе"),
    ("final flow", "ﬁnal ﬂow"),
    ("naïve", "naïve"),
    ("é", "е́"),
    ("a b", " a \n  b "),
    ("й", "й"),
    ("soft", "so­ft"),
]
DIFFERENT = [("TR-83", "TR-8³"), ("a", "á"), ("a", "A"), ("a.", "a"), ("a-b", "a–b"), ("l", "I"), ("½", "1/2"), ("x", "xy")]


def rewriter(texts):
    return L.Rewriter(L.lookalike_rules(Counter(map(ord, "".join(texts)))))


def test_same_and_different():
    rewrite = rewriter([x for p in SAME + DIFFERENT for x in p])
    for a, b in SAME:
        assert rewrite(a) == rewrite(b), (a, b)
    for a, b in DIFFERENT:
        assert rewrite(a) != rewrite(b), (a, b)
    for a, b in SAME + DIFFERENT:
        assert rewrite(rewrite(a)) == rewrite(a) and rewrite(rewrite(b)) == rewrite(b)


def test_frequency_chooses():
    counts = Counter({ord("a"): 5, ord("а"): 9})
    assert L.lookalike_rules(counts) == {"a": "а"}
    assert L.lookalike_rules(Counter({ord("a"): 9, ord("а"): 5})) == {"а": "a"}


def brute(rows, field):
    rewrite = rewriter([r[i] for r in rows for i in (2, 3) if r[i]])
    pairs = set()
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and a[0] < b[0] and a[field] is not None and b[field] is not None and a[field] != b[field] and rewrite(a[field]) == rewrite(b[field]):
                pairs.add((a[0], b[0]))
    return pairs


def test_pairs_against_brute_force(spark):
    texts = [x for p in SAME for x in p] + ["", " ", None]
    rows = fetch_rows([(i, None, texts[i % len(texts)], texts[(i * 7 + 1) % len(texts)], None, None, None) for i in range(40)])
    df = spark.createDataFrame(rows + rows[:5], FETCH)
    got = L.lookalike_pairs(df).collect()
    assert len(got) == len(set(got))
    for name, field in (("title", 2), ("markdown", 3)):
        assert {(r.fetch_id_a, r.fetch_id_b) for r in got if r.field == name} == brute(rows, field)
    classes = L.lookalike_classes(df).collect()
    assert len({(r.field, r.fetch_id) for r in classes}) == len(classes)
    for r in classes:
        assert r.n_links == sum(r.fetch_id in (p.fetch_id_a, p.fetch_id_b) for p in got if p.field == r.field)
    assert sum(r.n_links for r in classes) == 2 * len(got)


def test_odd_input(spark):
    df = odd_fetches(spark)
    assert {(r.field, r.fetch_id_a, r.fetch_id_b) for r in L.lookalike_pairs(df).collect()} == {("title", 2, 3), ("markdown", 2, 3)}
    forms = {r.fetch_id: r.title for r in L.canonical_forms(df).collect()}
    assert forms[1] is None and forms[2] == "" and forms[3] == "" and len(forms[5]) == 5000
    assert L.lookalike_pairs(df.limit(0)).count() == 0


def test_rules_keep_composed_text_composed():
    rewrite = rewriter(["é" * 3, "é", "ｅ"])
    assert rewrite("é") == "é" and unicodedata.normalize("NFC", rewrite("ｅ́")) == "é"
