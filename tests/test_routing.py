import json

from pyspark.sql import functions as F

from webstrata.functions import trees
from webstrata.functions import urls as U
from webstrata.operators import payloads as P
from webstrata.operators import routing as R
from webstrata.operators import search as S


def column(spark, function, values):
    df = spark.createDataFrame([(v,) for v in values], "x STRING")
    return [r[0] for r in df.select(function(F.col("x"))).collect()]


def test_services(spark):
    urls = ["https://youtu.be/x", "https://en.wikipedia.org/wiki/A", "https://en.wikipedia.org/", "https://github.com/a/b", "https://github.com/a", "https://npmjs.com/package/@a/b", "nonsense", "", None]
    assert column(spark, R.service_of, urls) == ["youtube", "wikimedia", None, "github", None, "npm", None, None, None]


def test_forge_claims(spark):
    urls = ["https://g.test/a/b/c/-/issues/5", "https://g.test/a/b/-/tree/x", "https://g.test/a/b", "https://g.test/a", "ftp://g.test/a/b", None]
    got = column(spark, R.forge_claim, urls)
    assert [tuple(x) if x else None for x in got] == [("issue", "a/b/c", "5"), None, ("project", "a/b", None), None, None, None]


def test_header_precedence(spark):
    rows = spark.createDataFrame([(1, "https://a.x.com/p", "k"), (2, "https://b.x.com/p", "k"), (3, "https://c.y.com", "l"), (4, "https://d.z.com", "m"), (5, None, None)], "id INT, url STRING, route_key STRING")
    pair = "host STRING, profile STRING"
    rules = spark.createDataFrame([("a.x.com", "exact"), ("x.com", "domain")], pair)
    learned = spark.createDataFrame([("k", "never"), ("l", "learned")], "route_key STRING, profile STRING")
    seeds = spark.createDataFrame([("y.com", "no"), ("z.com", "seed")], pair)
    got = {r.id: r.profile for r in R.header_profiles(rows, "url", rules, learned, seeds).collect()}
    assert got == {1: "exact", 2: "domain", 3: "learned", 4: "seed", 5: "browser"}


def test_in_flight_against_brute_force(spark):
    rows = [(i, "ab"[i % 2], i * 7 % 23, i % 5 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id INT, k STRING, t INT, d INT")
    most = {}
    for r in R.in_flight(df, "k", "t", "d").collect():
        most[r.k, r.t] = max(most.get((r.k, r.t), 0), r.in_flight)
    for i, k, t, _ in rows:
        assert most[k, t] == sum(a == k and b <= t < b + c for _, a, b, c in rows)


def test_location_and_related(spark):
    rows = spark.createDataFrame([("p", "sp", "SP"), ("p", "sp", "rj"), ("p", "sp", "rj"), ("q", "sp", "sp"), ("q", "sp", None), ("r", "sp", None)], "page STRING, w STRING, uf STRING")
    assert {r.page: r.ignored for r in R.location_ignored(rows, "page", "w", "uf").collect()} == {"p": True, "q": False, "r": False}
    related = spark.createDataFrame([("t", "Sub Tasks:", 2, "b"), ("t", "sub tasks", 1, "a"), ("t", "--", 3, "c"), ("t", None, 4, "d")], "task STRING, label STRING, place INT, title STRING")
    got = R.related_by_label(related, "task", "label", "place", ["title"]).collect()
    assert [(r.key, [i.title for i in r["items"]]) for r in got] == [("sub_tasks", ["a", "b"])]


def test_search(spark):
    assert column(spark, S.canonical_region, [" PT-br ", "de-de", None]) == ["br-pt", "de-de", None]
    labels = ["Kettle. Preço atual: R$ 99,90. Era R$ 120,00. De Shop.", "Kettle. R$ 99. From Shop", "something", None]
    got = column(spark, S.offer_label, labels)
    assert [(x.title, x.price, x.was, x.store) for x in got] == [("Kettle", 99.9, 120.0, "Shop"), ("Kettle", 99.0, None, "Shop"), (None, None, None, None), (None, None, None, None)]
    history = json.dumps([{"timestamp": "2024-01-01", "deal": {"price": {"amount": 5}}}, {"timestamp": "2024-02-01", "deal": None}, {"timestamp": "2024-03-01", "deal": {"price": {"amount": 4}}}])
    got = column(spark, lambda x: S.price_history(x, 2), [history, "{", None])
    assert [[h.price for h in x] if x else x for x in got] == [[4.0, 5.0], None, None]
    claims = column(spark, S.paper_claim, ["https://doi.org/10.1000/AB.c", "https://arxiv.org/abs/2401.01234v2", "https://x.test/pmc123/", "https://x.test", None])
    assert [tuple(c) if c else None for c in claims] == [("doi", "10.1000/ab.c"), ("arxiv", "2401.01234"), ("pmcid", "PMC123"), None, None]


def test_json_records(spark):
    repo = json.dumps({"full_name": "a/b", "stargazers_count": 3, "license": {"spdx_id": "NOASSERTION", "name": "Other"}, "topics": ["x"]})
    got = column(spark, P.repository_record, [repo, "{}", "{", None])
    assert (got[0].license, got[0].stars, got[0].topics, got[0].archived) == ("Other", 3, ["x"], False) and got[1:] == [None] * 3
    notes = json.dumps([{"body": "a"}, {"body": "s", "system": True}, {"body": "b"}, {"body": None}])
    assert [[n.body for n in x] for x in column(spark, lambda x: P.thread_notes(x, 5), [notes, '{"message": 1}', None])] == [["a", "b"], [], []]
    assert column(spark, P.rating_histogram, ['{"fiveStarNum": 2, "oneStarNum": "x"}', None]) == [{5: 2}, {}]


def test_page_state_and_articles(spark):
    page = '<script id="__NEXT_DATA__">{"a": {"ads": [1]}, "b": [{"ads": [1, 2]}]}</script>'
    assert column(spark, trees.record_texts, [page, "<p>", "", None]) == [["1", "2"], None, None, None]
    article = json.dumps({"sections": [{"type": "section", "name": "N", "has_parts": [{"type": "paragraph", "value": "p"}, {"type": "section", "name": "M", "has_parts": [{"type": "list_item", "value": "i"}]}]}]})
    assert column(spark, trees.article_markdown, [article, "[]", "x", None]) == ["## N\n\np\n\n### M\n\n- i", None, None, None]


def test_shop_addresses(spark):
    assert column(spark, U.clean_image_url, ["//i.test/a.jpg_80x80.jpg", "https://i.test/a._SX3_.png", "", None]) == ["https://i.test/a.jpg", "https://i.test/a.png", None, None]
    assert column(spark, U.shopping_search_url, ["https://google.com/shopping?q=a+b&hl=pt", "https://google.com/shopping", None]) == ["https://google.com/search?q=a+b&udm=28&hl=pt", "https://google.com/shopping", None]
    assert column(spark, U.strip_html, ["a<br>b <i>c</i>", None]) == ["a\nb c", None]
