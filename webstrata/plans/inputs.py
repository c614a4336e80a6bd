"""Queries of sources, sinks and page readers (SRC, SNK, TXT01, TXT19, TXT21, URL15, LOG sources)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import text as T
from webstrata.operators import rank as R
from webstrata.sources import readers as I
from webstrata.sources import writers as O
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def event_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Events read back from JSON lines, every seventh line cut off (SRC21)."""
    rows = table(spark, folder, "telemetry").select("entry_id", "tool", "outcome", "duration_ms", "url", "ts").dropDuplicates(["entry_id"])
    line = F.to_json(F.struct("tool", "outcome", "duration_ms", "url", "ts"))
    line = F.when(F.col("entry_id") % 7 == 0, F.substr(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    read = rows.select("entry_id", I.event_lines(line).alias("e")).where("e IS NOT NULL")
    return read.select("entry_id", "e.tool", "e.outcome", "e.duration_ms", "e.ts")


SQL_EVENTS = "SELECT DISTINCT entry_id, tool, outcome, CAST(duration_ms AS BIGINT) AS duration_ms, ts FROM telemetry WHERE entry_id % 7 <> 0"


def _sitemaps(spark: SparkSession, folder: str) -> DataFrame:
    """A sitemap per host, and one index of them all."""
    f = table(spark, folder, "fetch_cache").select("fetch_id", "url").dropDuplicates(["url"])
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-0"), (F.col("fetch_id") % 9 + 1).cast("string"), F.lit("</lastmod></url>"))
    hosts = f.groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("x"))
    maps = hosts.select(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("url"), F.concat(F.lit("<urlset>"), "x", F.lit("</urlset>")).alias("body"))
    child = F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap>"))
    index = maps.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.sort_array(F.collect_list(child)), ""), F.lit("</sitemapindex>")).alias("body"))
    return maps.unionByName(index.select(F.lit("https://index.example/sitemap.xml").alias("url"), "body"))


def sitemap_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses found by walking a sitemap index (SRC18)."""
    roots = spark.createDataFrame([("https://index.example/sitemap.xml",)], "url STRING")
    return I.sitemap_walk(_sitemaps(spark, folder), roots).groupBy("loc").agg(F.count("*").alias("n"))


SQL_SITEMAP = "SELECT url AS loc, 1 AS n FROM (SELECT DISTINCT url FROM fetch_cache)"


def feed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Links out of feeds of two formats (SRC19)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id", "url").dropDuplicates(["fetch_id"])
    rss = F.concat(F.lit("<rss><channel><link>x</link><item><title>a</title><link> "), "url", F.lit(" </link></item></channel></rss>"))
    atom = F.concat(F.lit('<feed><link href="x"/><entry><link rel="alternate" href="'), "url", F.lit('"/></entry></feed>'))
    return f.select("fetch_id", F.explode(I.feed_links(F.when(F.col("fetch_id") % 2 == 0, rss).otherwise(atom))).alias("link"))


SQL_FEED = "SELECT DISTINCT fetch_id, url AS link FROM fetch_cache"


def crawl_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Pages reached in three steps over links between fetches (SRC20)."""
    ids = table(spark, folder, "fetch_cache").select("fetch_id").distinct()
    targets = F.array((F.col("fetch_id") * 2 + 1).cast("string"), (F.col("fetch_id") * 3 % 401).cast("string"))
    links = ids.select(F.col("fetch_id").cast("string").alias("source"), F.explode(targets).alias("target"))
    return I.crawl(links, spark.createDataFrame([("1",)], "url STRING"), 3)


SQL_CRAWL = """
WITH RECURSIVE l AS (SELECT DISTINCT fetch_id AS s, unnest([fetch_id * 2 + 1, fetch_id * 3 % 401]) AS t FROM fetch_cache),
r AS (SELECT CAST(1 AS BIGINT) AS u, 0 AS step UNION SELECT l.t, step + 1 FROM r JOIN l ON l.s = r.u WHERE step < 3)
SELECT CAST(u AS VARCHAR) AS url, min(step) AS step FROM r GROUP BY u
"""


def crawl_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a budget of four pages to visit (SRC20)."""
    ids = table(spark, folder, "fetch_cache").select("fetch_id").distinct()
    links = ids.where("fetch_id BETWEEN 1 AND 60").select(F.col("fetch_id").cast("string").alias("source"), F.explode(F.array((F.col("fetch_id") * 2).cast("string"), (F.col("fetch_id") * 2 + 1).cast("string"))).alias("target"))
    return I.crawl(links, spark.createDataFrame([("1",)], "url STRING"), 9, pages=4)


# 1 leads to 2 and 3, both are visited, then 4 of the four they lead to
SQL_BUDGET = "SELECT url, CAST(step AS INTEGER) AS step FROM (VALUES ('1', 0), ('2', 1), ('3', 1), ('4', 2), ('5', 2), ('6', 2), ('7', 2), ('8', 3), ('9', 3)) t(url, step)"


def block_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Domains out of list lines of three formats (SRC25, SNK06)."""
    s = table(spark, folder, "sites").select(F.explode(F.array(F.concat(F.lit("0.0.0.0 "), "host", F.lit(" # ad")), F.concat(F.lit("*://*."), F.col("site_name"), F.lit("/*")), F.concat("host", F.lit("  ")), F.lit("# note"), F.lit("127.0.0.1 localhost"))).alias("line"))
    return s.select(I.blocklist_domain(F.col("line")).alias("domain")).where("domain IS NOT NULL").distinct()


SQL_BLOCK = "SELECT DISTINCT host AS domain FROM sites UNION SELECT DISTINCT lower(site_name) FROM sites"


def llms_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Which recorded bodies would serve as llms.txt, and their pages (SRC13, SRC17)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id", "status", "markdown").dropDuplicates(["fetch_id"])
    body = F.when(F.col("fetch_id") % 5 == 0, F.concat(F.lit(" <!DOCTYPE html>"), F.coalesce("markdown", F.lit("")))).otherwise(F.col("markdown"))
    paged = F.concat(body, F.lit("\f"), F.lit("two\f"))
    return f.select("fetch_id", F.coalesce(I.is_llms_text(F.col("status"), body), F.lit(False)).alias("usable"), F.size(I.document_pages(paged)).alias("pages"))


SQL_LLMS = """
WITH f AS (SELECT DISTINCT fetch_id, status, markdown FROM fetch_cache), b AS (SELECT *, CASE WHEN fetch_id % 5 = 0 THEN ' <!DOCTYPE html>' || coalesce(markdown, '') ELSE markdown END AS body FROM f)
SELECT fetch_id, coalesce(status = 200 AND fetch_id % 5 <> 0 AND strlen(body) BETWEEN 1 AND 524288 AND trim(body, ' ') <> '', false) AS usable, CASE WHEN body IS NULL THEN NULL ELSE 2 END AS pages FROM b
"""


def site_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each site joined in order, as its length and digest (SNK03)."""
    d = table(spark, folder, "documents").select("doc_id", "source", F.col("text").alias("t"))
    joined = O.joined_markdown(d, "source", "doc_id", "t")
    return joined.select("source", F.length("markdown").alias("chars"), F.sha2("markdown", 256).alias("sha256"))


SQL_DIGEST = """
WITH d AS (SELECT doc_id, source, regexp_replace(text, '\\n+$', '') || chr(10) AS t FROM documents WHERE text IS NOT NULL), j AS (SELECT source, string_agg(t, chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS m FROM d GROUP BY source)
SELECT source, length(m) AS chars, sha256(m) AS sha256 FROM j
"""


def _page_html(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "url", "html_gz", "markdown").dropDuplicates(["fetch_id"])
    paragraphs = F.array_join(F.transform(F.split(F.coalesce("markdown", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>"))), "")
    head = F.lit('<html lang="xx"><head><title>A page</title><meta name="author" content="Someone"></head><body><nav><a href="/menu">m</a></nav><main><h1>Top</h1><a href="../a?b=1">x</a>')
    return rows.select("fetch_id", "url", F.concat(head, paragraphs, F.lit("</main></body></html>")).alias("html"))


def page_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Readable text and metadata of pages made from the texts (TXT01, TXT02), with their links (URL15)."""
    p = _page_html(spark, folder).select("fetch_id", H.html_to_markdown("html").alias("m"), H.page_links("html", "url").alias("links"))
    return p.select("fetch_id", "m.title", "m.byline", "m.language", F.size("links").alias("n_links"), F.length("m.markdown").alias("chars"), T.confidence(T.word_count(F.col("m.markdown"))).alias("confidence"))


def folded_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of all passages, by frequency (TXT21, SEG01)."""
    cut = R.segment(table(spark, folder, "documents"), "doc_id", "text")
    return cut.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def nested_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Hidden payloads planted in nested quality records (TXT19)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id").distinct()
    hidden = F.lit("​‌" * 9)
    record = F.to_json(F.struct(F.array(F.struct(F.when(F.col("fetch_id") % 3 == 0, hidden).otherwise("plain").alias("title"))).alias("products")))
    return f.select("fetch_id", F.explode(H.scan_structure(record)).alias("p")).select("fetch_id", "p.path", "p.kind", "p.chars")


SQL_NESTED = "SELECT DISTINCT fetch_id, 'quality.products[0].title' AS path, 'zero_width' AS kind, 18 AS chars FROM fetch_cache WHERE fetch_id % 3 = 0"

CATALOG: dict[str, tuple[Query, str | None]] = {
    "event_scan": (event_scan, SQL_EVENTS),
    "sitemap_urls": (sitemap_urls, SQL_SITEMAP),
    "feed_items": (feed_items, SQL_FEED),
    "crawl_steps": (crawl_steps, SQL_CRAWL),
    "crawl_budget": (crawl_budget, SQL_BUDGET),
    "block_domains": (block_domains, SQL_BLOCK),
    "llms_texts": (llms_texts, SQL_LLMS),
    "site_digest": (site_digest, SQL_DIGEST),
    "page_markdown": (page_markdown, None),
    "folded_tokens": (folded_tokens, None),
    "nested_payloads": (nested_payloads, SQL_NESTED),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
