from pyspark.sql import functions as F

from webstrata import api
from webstrata.operators import catalogs as C
from webstrata.operators import claims as Q
from webstrata.operators import events as E
from webstrata.operators import media as M
from webstrata.operators import scholar as P
from webstrata.operators import state as S


def values(spark, function, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(function(*[F.col(c) for c in df.columns])).collect()]


def test_caption_choice(spark):
    cases = [
        ((["live_chat"], None), None),
        ((["live_chat", "fr", "en-orig"], ["en"]), ("en-orig", False)),
        ((["fr", "de"], ["en"]), ("fr", False)),
        (([], ["de", "pt-orig", "en"]), ("pt-orig", True)),
        ((None, ["de", "en"]), ("en", True)),
        ((None, ["de"]), ("de", True)),
        ((None, None), None),
    ]
    got = values(spark, M.caption_choice, [c for c, _ in cases], "s ARRAY<STRING>, a ARRAY<STRING>")
    assert [x and tuple(x) for x in got] == [w for _, w in cases]


def test_no_captions_and_nulls(spark):
    schema = "d STRING, c ARRAY<STRUCT<start_time: DOUBLE, title: STRING>>"
    got = values(spark, M.without_captions, [(" x ", [(61.0, "One"), (None, "Two"), (3.0, "")]), (None, None), ("", [])], schema)
    assert got == ["x\n\n## Chapters\n- 1:01 One\n- Two", None, None]


def test_label_kinds(spark):
    base = "Fone X.  Preço atual: R$ 1.299,00. Custava R$ 1.500,00. Avaliado com 4,8 de 5. 2,5 mil avaliações. Loja Boa e mais"
    labels = [base, f"PROMOÇÃO{base}", f"{base}. Usado. x", f"Preço no exterior: {base}", "short", "", None]
    assert values(spark, C.label_kind, [(x,) for x in labels], "l STRING") == ["offer", "offer", "used", "international", "other", "other", "other"]
    got = values(spark, C.label_offer, [(labels[1],), (labels[4],)], "l STRING")
    assert (got[0].title, got[0].price, got[0].was, got[0].rating, got[0].reviews, got[0].store, got[0].other_stores, got[0].badges) == ("Fone X", 1299.0, 1500.0, 4.8, 2500, "Loja Boa", True, ["promo"]) and got[1] is None


def test_claims_of_odd_addresses(spark):
    rows = [(None,), ("",), ("no address",), ("https://[bad",), ("http://youtu.be/",), ("https://doi.org/",), ("ftp://arxiv.org/abs/1",)]
    assert [x and x.service for x in values(spark, Q.claim, rows, "u STRING")] == [None, None, None, None, "youtube", None, None]


def test_damaged_answers_are_no_source(spark):
    rows = [("10.1234/a", "{cut", "1"), ("10.1234/a", '{"message": {"title": ["T"], "author": [{"name": "G"}, {}]}}', "0"), (None, "{}", "1"), ("nothing", "{}", "1")]
    answers = P.answers_by_doi({"crossref": spark.createDataFrame(rows[1:], "doi STRING, body STRING, at STRING"), "unpaywall": spark.createDataFrame(rows[:1], "doi STRING, body STRING, at STRING")})
    got = P.full_text(P.merged_papers(answers)).collect()
    assert [(r.doi, r.title, r.sources_used, [a.name for a in r.authors], r.full_text_url, r.oa_status) for r in got] == [("10.1234/a", "T", ["crossref"], ["G"], None, "closed")]
    assert P.merged_papers(answers.limit(0)).count() == 0


def test_escaped_payloads(spark):
    assert values(spark, E.escaped, [("a\tß😀",), ("",), (None,), ("x" * 600,)], "t STRING") == ["a\\u0009\\u00df\\ud83d\\ude00", "", None, "x" * 512]


def test_chain_keeps_the_block_it_could_not_clear(spark):
    rows = [(1, "http", "blocked_bot", 1.0, 0), (1, "http_plain", "blocked_bot", 1.0, 0), (1, "browser", "blocked_captcha", 2.0, 0), (1, "mobile", "blocked_bot", 2.0, 0), (2, "http", "ok", 9.0, 5), (3, "http", "timeout", 4.0, 0), (4, "browser", "ok", 3.0, 7)]
    df = spark.createDataFrame(rows, "request_id LONG, tier STRING, reason STRING, seconds DOUBLE, words INT")
    got = {r.request_id: (r.mode_used, r.reason, r.seconds, r.escalated_from, r.plain_headers) for r in S.chain(df).collect()}
    assert got == {1: ("browser", "blocked_captcha", 6.0, "http", False), 2: ("http", "ok", 5.0, None, False), 3: ("browser", "browser_unavailable", 4.0, "http", False), 4: ("browser", "ok", 3.0, None, False)}


def test_fetch_answers_every_request_once(spark):
    names = ["fetch_id", *api.RECORD]
    schema = ", ".join(f"{n} {'LONG' if n in ('fetch_id', 'fetched_at', 'ttl_expires') else 'INT' if n == 'status' else 'STRING'}" for n in names)

    def row(i, url, at, expires, text):
        given = {"fetch_id": i, "url": url, "fetched_at": at, "ttl_expires": expires, "markdown": text, "status": 200}
        return tuple(given.get(n) for n in names)

    cache = spark.createDataFrame([row(1, "https://a.test/x?utm_source=1", 10, 99, "old words"), row(2, "https://b.test/", 10, 11, "gone")], schema)
    new = spark.createDataFrame([row(3, "https://b.test/", 50, None, "three new words"), row(4, None, 1, 1, None)], schema)
    asked = spark.createDataFrame([(1, "https://A.test/x#top"), (2, "https://b.test/"), (3, "https://c.test"), (4, None), (5, "https://a.test/x")], "request_id LONG, url STRING")
    got = {r.request_id: (r.from_cache, r.failure and r.failure.reason, r.word_count, r.cache_age_seconds) for r in api.fetch(asked, new, cache, 60).collect()}
    assert got == {1: (True, None, 2, 50), 2: (False, None, 3, None), 3: (False, "dns_fail", None, None), 4: (False, "dns_fail", None, None), 5: (True, None, 2, 50)}
