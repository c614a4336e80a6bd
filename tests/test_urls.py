from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.operators import domains as D

NORMAL = [
    ("HTTP://Example.COM:80/a/", "http://example.com/a"),
    ("example.com", "http://example.com"),
    ("https://example.com/?b=2&a=1&a=0#x", "https://example.com/?a=1&a=0&b=2"),
    ("https://example.com/x?utm_source=a&mtm_x=1&fbclid=2&k", "https://example.com/x?k"),
    ("https://example.com/x?k=&amp=1&output=amp&output=json", "https://example.com/x?k=&output=json"),
    ("https://example.com/amp/foo/amp", "https://example.com/foo"),
    ("https://example.com/amphibian/x", "https://example.com/amphibian/x"),
    ("https://user:pw@example.com:8443/x//", "https://user:pw@example.com:8443/x"),
    ("https://www.olx.com.br/x?page=home&o=2", "https://www.olx.com.br/x?o=2"),
    ("https://youtu.be/abc_-1?t=5", "https://youtube.com/watch?t=5&v=abc_-1"),
    ("https://l.facebook.com/l.php?u=https%3A%2F%2Fexample.com%2Fa%2Bb", "https://example.com/a+b"),
    ("https://www.google.com/url?q=notaurl", "https://www.google.com/url?q=notaurl"),
    ("http://pt.m.wikipedia.org/wiki/s%C3%A3o%20paulo", "https://pt.wikipedia.org/wiki/S%C3%A3o_paulo"),
    ("https://en.wikipedia.org/w/index.php?title=Foo&oldid=3", "https://en.wikipedia.org/w/index.php?oldid=3&title=Foo"),
    ("", ""),
]


def test_normalize(spark):
    df = spark.createDataFrame(NORMAL, "raw STRING, want STRING").withColumn("got", U.normalize_url(F.col("raw")))
    assert [(r.raw, r.got) for r in df.collect()] == NORMAL


def test_normalize_is_idempotent_and_keeps_null(spark):
    df = spark.createDataFrame([(a,) for a, _ in NORMAL] + [(None,)], "raw STRING")
    once = df.select(U.normalize_url(F.col("raw")).alias("u"))
    rows = once.select("u", U.normalize_url(F.col("u")).alias("v")).collect()
    assert all(r.u == r.v for r in rows) and rows[-1].u is None


def test_domains_and_route_keys(spark):
    table = [
        ("https://www.a.example.co.uk/x", "example.co.uk", "example.co.uk/x"),
        ("https://sub.example.com", "example.com", "example.com"),
        ("http://localhost:80/Item-12/x", "localhost", "localhost/*"),
        ("https://www.host.test/rent/sp/x", "host.test", "host.test/rent/*"),
        ("https://a.b.kawasaki.jp", "a.b.kawasaki.jp", "a.b.kawasaki.jp"),
        ("https://x.city.kawasaki.jp", "city.kawasaki.jp", "city.kawasaki.jp"),
        ("https://a.b.c.ck/", "b.c.ck", "b.c.ck"),
        ("https://x.www.ck/", "www.ck", "www.ck"),
        ("https://co.uk/", "co.uk", "co.uk"),
        ("https://10.0.0.1/x", "10.0.0.1", "10.0.0.1/x"),
        ("https://me.github.io/x", "github.io", "github.io/x"),
        ("https://a.bücher.公司.cn/", "bücher.公司.cn", "bücher.公司.cn"),
        ("", "", ""),
        (None, None, None),
    ]
    df = spark.createDataFrame(table, "u STRING, d STRING, k STRING")
    got = D.with_registered_domain(D.with_route_key(df.select("u"), "u", "k"), "u", "d").select("u", "d", "k").collect()
    assert sorted(map(tuple, got), key=str) == sorted(table, key=str)


def test_suffix_rules(tmp_path, spark):
    rules = ["// ===BEGIN ICANN DOMAINS===", "com", "*.zz", "!ok.zz", "// ===END ICANN DOMAINS===", "// ===BEGIN PRIVATE DOMAINS===", "mine.com"]
    assert D.parse_rules(rules) == [("com", 1, True, False, False), ("ok.zz", 2, False, False, True), ("zz", 1, False, True, False)]
    (tmp_path / "list.txt").write_text("\n".join(rules))
    own = D.suffix_rules(spark, f"file://{tmp_path}/list.txt")
    df = spark.createDataFrame([("http://a.mine.com",), ("http://a.b.zz",), ("http://x.ok.zz",)], "u STRING")
    assert [r.d for r in D.with_registered_domain(df, "u", "d", own).collect()] == ["mine.com", "a.b.zz", "ok.zz"]


def test_third_party_and_purge(spark):
    rows = spark.createDataFrame([(1, "https://ads.t.com/x", "https://p.com"), (2, "https://ads.t.com/x", "https://www.t.com"), (3, None, "https://p.com")], "id INT, r STRING, p STRING")
    listed = spark.createDataFrame([("T.com",)], "domain STRING")
    assert [(r.id, r.blocked) for r in D.third_party_blocked(rows, "r", "p", listed).orderBy("id").collect()] == [(1, True), (2, False), (3, False)]
    assert [r.id for r in D.purge_domain(rows, "r", "www.t.com").collect()] == [3]


def test_blocked_hosts(spark):
    from webstrata.operators.membership import blocked_hosts

    rows = spark.createDataFrame([(1, "a.b.bad.com"), (2, "bad.com"), (3, "notbad.com"), (4, None)], "id INT, host STRING")
    listed = spark.createDataFrame([("BAD.com",), ("com.bad",)], "domain STRING")
    assert sorted(r.id for r in blocked_hosts(rows, listed).collect()) == [1, 2]
    assert blocked_hosts(rows, listed.limit(0)).count() == 0
