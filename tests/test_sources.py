from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.operators import payloads as P
from webstrata.sources import readers as I
from webstrata.sources import writers as O


def test_event_log(spark, tmp_path):
    (tmp_path / "2024-01-02.jsonl").write_text('{"tool":"fetch","duration_ms":3}\n\nbroken{\n{"tool":"search"}\n')
    (tmp_path / "2024-01-01.jsonl").write_text('{"tool":"old"}\n')
    (tmp_path / "2023-12-31.jsonl").write_text('{"tool":"older"}\n')
    assert sorted(r.tool for r in I.event_log(spark, str(tmp_path), "2024-01-02", 2).collect()) == ["fetch", "old", "search"]


def test_sitemaps(spark):
    bodies = [
        ("i", "<sitemapindex><sitemap><loc>a</loc></sitemap><sitemap><loc> i </loc></sitemap></sitemapindex>"),
        ("a", "<?xml?><urlset><url><loc>u?a=1&amp;b=2</loc><lastmod>x</lastmod></url><url><loc>v</loc></url><url></url></urlset>"),
        ("b", "<urlset><url><loc>cut"),
    ]
    df = spark.createDataFrame(bodies, "url STRING, body STRING")
    roots = spark.createDataFrame([("i",), ("b",), ("missing",)], "url STRING")
    assert sorted((r.loc, r.lastmod) for r in I.sitemap_walk(df, roots).collect()) == [("u?a=1&b=2", "x"), ("v", None)]


def test_crawl(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source STRING, target STRING")
    got = {r.url: r.step for r in I.crawl(links, spark.createDataFrame([("a",)], "url STRING"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_blocklist(spark, tmp_path):
    (tmp_path / "l.txt").write_text("0.0.0.0 ads.example # x\n*://*.bad.org/*\n||track.net^\nplain.io\n# note\n127.0.0.1 localhost\n\n!!\n")
    assert sorted(r.domain for r in I.blocklist(spark, [str(tmp_path / "l.txt")]).collect()) == ["ads.example", "bad.org", "plain.io", "track.net"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "g", "b\n\n"), (0, "g", "a"), (2, "h", None)], "p INT, g STRING, m STRING")
    assert [(r.g, r.markdown) for r in O.joined_markdown(rows, "g", "p", "m").collect()] == [("g", "a\n\n---\n\nb\n")]
    O.json_lines(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    events = spark.createDataFrame([("t", None), ("u", "2024-01-05T00:00:00Z")], "tool STRING, ts STRING")
    O.append_events(events, str(tmp_path / "e"), F.lit("2024-02-01T00:00:00Z"))
    O.append_events(events, str(tmp_path / "e"), F.lit("2024-02-01T00:00:00Z"))
    assert {str(r.day): r["count"] for r in spark.read.json(str(tmp_path / "e")).groupBy("day").count().collect()} == {"2024-01-05": 2, "2024-02-01": 2}
    O.consolidated_list(spark.createDataFrame([("b",), ("a",), ("b",)], "domain STRING"), str(tmp_path / "d"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "d")).collect()) == ["a", "b"]
    base = spark.createDataFrame([("k", 1, "old"), ("l", 1, "kept")], "k STRING, at INT, v STRING")
    new = spark.createDataFrame([("k", 2, "new")], "k STRING, at INT, v STRING")
    assert sorted((r.k, r.v) for r in O.merge_snapshot(base, new, ["k"], ["at"], str(tmp_path / "s")).collect()) == [("k", "new"), ("l", "kept")]


def test_html(spark):
    page = '<html lang="en"><head><title>T &amp; U</title><base href="https://h.test/d/"><meta property="og:title" content="OG"></head><body><nav>menu</nav><h2>Head</h2><p>One <b>bold</b> <a href="x">link</a><ul><li>a<li>b</ul><pre>x  y</pre><script>no()</script><p>unclosed'
    rows = spark.createDataFrame([(page, "https://z.test"), ("", None), (None, None)], "html STRING, url STRING")
    got = rows.select(H.html_to_markdown("html").alias("m"), H.page_links("html", "url").alias("l")).collect()
    m = got[0].m
    assert (m.title, m.language) == ("OG", "en") and got[0].l == ["https://h.test/d/x"]
    assert "## Head" in m.markdown and "**bold**" in m.markdown and "- a" in m.markdown and "x  y" in m.markdown
    assert "menu" not in m.markdown and "no()" not in m.markdown
    assert got[1].m.markdown == "" and got[2].l == []


def test_linked_objects_and_cues(spark):
    page = '<script type="application/ld+json">[{"@type":"A"},{"@type":"Product","name":"n","brand":"b"}]</script><script type="application/ld+json">nope</script>'
    r = spark.createDataFrame([(page,), (None,), ("",)], "h STRING").select(P.product_fields(P.of_type(P.linked_objects(F.col("h")), "Product")).alias("f")).collect()
    assert (r[0].f.name, r[0].f.brand) == ("n", "b") and r[1].f.name is None and r[2].f.name is None
    vtt = "WEBVTT\n\n00:01.000 --> 00:02.000\na\n\n00:02.000 --> 00:03.000\na\n\n00:03.000 --> 00:04.000\n<i>t</i>\n\n00:04.000 --> 00:05.000\nb c\n"
    cues = spark.createDataFrame([(vtt,)], "v STRING").select(P.cue_lines(F.col("v")).alias("c")).first().c
    assert [(c.start, c.text) for c in cues] == [(1.0, "a"), (4.0, "b c")]


def test_deep_sitemaps_and_what_was_not_read(spark):
    index = "<sitemapindex><sitemap><loc>{}</loc></sitemap></sitemapindex>"
    bodies = [(f"i{k}", index.format(f"i{k + 1}")) for k in range(7)] + [("i7", "<urlset><url><loc>https://a.test/deep</loc></url></urlset>"), ("x", index.format("missing"))]
    df = spark.createDataFrame(bodies, "url STRING, body STRING")
    roots = spark.createDataFrame([("i0",), ("x",)], "url STRING")
    assert [r.loc for r in I.sitemap_walk(df, roots).collect()] == ["https://a.test/deep"]
    assert {r.url for r in I.unread_sitemaps(df, roots).collect()} == {"missing"}
    assert I.sitemap_walk(df, roots, depth=3).count() == 0
    assert {r.url for r in I.unread_sitemaps(df, roots, depth=3).collect()} == {"i3", "missing"}


def test_thin_pages(spark):
    df = spark.createDataFrame([(["a page with many letters", " x ", "", None],), (None,)], "p ARRAY<STRING>")
    got = df.select(I.thin_pages(F.col("p")).alias("t")).collect()
    assert [r.t for r in got] == [[2, 3], None]
