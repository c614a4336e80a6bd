"""Queries of routing, header profiles, loads, warnings and forge records (CLS16 to CLS24, JON05, JON08, JON09, STT07, SET03, AGG06, ADP14, ADP16, ADP17, URL16 to URL21, TXT22, TXT26)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.operators import claims as Q
from webstrata.operators import payloads as P
from webstrata.operators import routing as R
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _fetches(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", *columns).dropDuplicates(["fetch_id"])


# Addresses with the source and kind of page that they are.
ADDRESSES = [
    ("https://m.youtube.com/watch?v=abc", "youtube", "video"), ("https://www.youtube.com/@name/videos", "youtube", "channel"), ("https://www.youtube.com/results?search_query=x", "youtube", "search"), ("https://youtube.com/feed", "youtube", "other"),
    ("https://pt.wikipedia.org/wiki/A", "wikimedia", "article"), ("https://github.com/a/b", "github", "repository"), ("https://github.com/topics/b", None, None), ("https://github.com/a", None, None), ("https://doi.org/10.1234/x", "scholar", "doi"),
    ("https://www.sciencedirect.com/science/article/pii/S0140673620301839", "scholar", "pii"), ("https://pubmed.ncbi.nlm.nih.gov/123/", "scholar", "pmid"), ("https://europepmc.org/articles/PMC12", "scholar", "pmcid"), ("https://arxiv.org/abs/2401.1", "scholar", "arxiv"),
    ("https://google.com/search?q=a&udm=28", "google_shopping", "shopping"), ("https://google.com/search?q=a", None, None), ("https://www.vivareal.com.br/imovel/x", "realestate", "detail"), ("https://sp.olx.com.br/x/imoveis", "olx", "realestate"), ("https://olx.com.br/x", None, None),
    ("https://produto.mercadolivre.com.br/MLB-1", "mercadolivre", "product"), ("https://lista.mercadolivre.com.br/x", "mercadolivre", "search"), ("https://pt.aliexpress.com/item/5.html", "aliexpress", "product"), ("https://shopee.com.br/a-i.1.2", "shopee", "product"), ("https://shopee.com.br/a", None, None),
    ("https://www.petlove.com.br/racao/p", "petlove", "product"), ("https://www.petlove.com.br/busca?q=x", "petlove", "search"), ("https://www.amazon.com.br/x/dp/B0CFPL6CFY", "amazon", "product"), ("https://www.amazon.com/s?k=x", "amazon", "search"), ("https://aws.amazon.com/s?k=x", None, None),
    ("https://store.steampowered.com/app/5", "steam", "app"), ("https://store.steampowered.com/search?term=x", "steam", "search"), ("https://npmjs.com/package/@a/x/v/1", "npm", "package"), ("https://phabricator.wikimedia.org/T5", "phabricator", "task"), ("https://phabricator.wikimedia.org/maniphest/?x=1", "phabricator", "search"),
    ("https://a.myshopify.com/products/x", "shopify", "product"), ("https://a.myshopify.com/pages/x", None, None), ("https://gitlab.com/a/b/-/issues/5", "gitlab", "issue"), ("https://gitlab.com/explore/b", None, None), ("https://git.test/a/b", None, None),
]


def services(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that claim addresses, the kind of page, and whether an unknown host is worth asking (CLS16, CLS17)."""
    made = F.element_at(F.array(*[F.lit(a) for a, *_ in ADDRESSES]), (F.col("fetch_id") % len(ADDRESSES) + 1).cast("int"))
    rows = _fetches(spark, folder, "url").select("fetch_id", F.posexplode(F.array(made, "url")).alias("k", "url"))
    x = rows.select("fetch_id", "k", Q.claim(F.col("url"), wiki_access=True).alias("c"), Q.is_forge_candidate(F.col("url")).alias("ask_forge"))
    return x.select("fetch_id", "k", "c.service", "c.kind", "ask_forge")


SQL_SERVICES = f"""
WITH f AS (SELECT DISTINCT fetch_id, url FROM fetch_cache), a(i, url, service, kind) AS (VALUES {", ".join(f"({i}, '{u}', {'NULL' if s is None else repr(s)}, {'NULL' if k is None else repr(k)})" for i, (u, s, k) in enumerate(ADDRESSES))})
SELECT fetch_id, 0 AS k, service, kind, a.url IN ('https://gitlab.com/a/b/-/issues/5', 'https://git.test/a/b') AS ask_forge FROM f JOIN a ON i = fetch_id % {len(ADDRESSES)} UNION ALL SELECT fetch_id, 1, NULL, NULL, false FROM f
"""


def forge_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Issues, merge requests and projects claimed by shape (CLS17)."""
    n = F.col("fetch_id").cast("string")
    url = F.concat(F.lit("https://forge.example/team/app"), F.when(F.col("fetch_id") % 4 == 0, F.concat(F.lit("/-/issues/"), n)).when(F.col("fetch_id") % 4 == 1, F.concat(F.lit("/-/merge_requests/"), n)).when(F.col("fetch_id") % 4 == 2, "/-/tree/main").otherwise(""))
    return _fetches(spark, folder).select("fetch_id", R.forge_claim(url).alias("c")).select("fetch_id", "c.kind", "c.project", "c.number")


SQL_FORGE = "SELECT DISTINCT fetch_id, (['issue', 'merge_request', NULL, 'project'])[fetch_id % 4 + 1] AS kind, CASE WHEN fetch_id % 4 <> 2 THEN 'team/app' END AS project, CASE WHEN fetch_id % 4 < 2 THEN CAST(fetch_id AS VARCHAR) END AS number FROM fetch_cache"


def header_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Header profiles by precedence of rules, learning and seeds (JON05)."""
    rows = _fetches(spark, folder, "url").withColumn("route_key", U.host_of(F.col("url")))
    s = table(spark, folder, "sites")
    rules = s.where("category = 'news'").select("host", F.lit("honest").alias("profile"))
    learned = s.where("category IN ('news', 'forum')").select(F.col("host").alias("route_key"), F.lit("learned").alias("profile"))
    seeds = s.where("category IN ('wiki', 'forum')").select("host", F.lit("seeded").alias("profile"))
    return R.header_profiles(rows, "url", rules, learned, seeds).groupBy("profile").agg(F.count("*").alias("n"))


SQL_HEADERS = """
WITH f AS (SELECT DISTINCT fetch_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM fetch_cache)
SELECT CASE category WHEN 'news' THEN 'honest' WHEN 'forum' THEN 'learned' WHEN 'wiki' THEN 'seeded' ELSE 'browser' END AS profile, count(*) AS n FROM f LEFT JOIN sites USING (host) GROUP BY 1
"""


def locations(spark: SparkSession, folder: str) -> DataFrame:
    """Sites whose listings lie mostly elsewhere (CLS19)."""
    rows = _fetches(spark, folder, "site_name", "language").where("site_name IS NOT NULL")
    x = rows.select("site_name", F.lit("EN").alias("wanted"), F.nullif(F.substring("language", 1, 2), F.lit("")).alias("state"))
    return R.location_ignored(x, "site_name", "wanted", "state").select("site_name", "ignored")


SQL_LOCATIONS = """
SELECT site_name, count(nullif(substr(language, 1, 2), '')) > 0 AND count_if(lower(substr(language, 1, 2)) = 'en') * 2 < count(nullif(substr(language, 1, 2), '')) AS ignored FROM (SELECT DISTINCT fetch_id, site_name, language FROM fetch_cache) WHERE site_name IS NOT NULL GROUP BY site_name
"""


def loads(spark: SparkSession, folder: str) -> DataFrame:
    """The most requests of a host at once (STT07)."""
    rows = _fetches(spark, folder, "url").select("fetch_id", U.host_of(F.col("url")).alias("host"), (F.col("fetch_id") * 13 % 997).alias("t"), F.lit(60).alias("d"))
    return R.in_flight(rows, "host", "t", "d").groupBy("host").agg(F.max("in_flight").alias("most"))


SQL_LOADS = """
WITH r AS (SELECT DISTINCT fetch_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, fetch_id * 13 % 997 AS t FROM fetch_cache)
SELECT host, CAST(max(n) AS INTEGER) AS most FROM (SELECT a.host, a.fetch_id, count(*) AS n FROM r a JOIN r b ON a.host = b.host AND b.t <= a.t AND b.t + 60 > a.t GROUP BY ALL) GROUP BY host
"""


def fetch_warnings(spark: SparkSession, folder: str) -> DataFrame:
    """Warnings of fetches by name (CLS24, TXT07)."""
    x = _fetches(spark, folder, "markdown", "published", "status")
    flags = {"short_content": F.length("markdown") < 200, "no_date": F.col("published").isNull(), "error_status": F.col("status") >= 400}
    return x.select(F.explode(R.warnings_of(flags)).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


SQL_WARNINGS = """
WITH f AS (SELECT DISTINCT fetch_id, markdown, published, status FROM fetch_cache)
SELECT 'short_content' AS warning, count(*) AS n FROM f WHERE length(markdown) < 200 UNION ALL SELECT 'no_date', count(*) FROM f WHERE published IS NULL UNION ALL SELECT 'error_status', count(*) FROM f WHERE status >= 400
"""


def related_handles(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches of a site by the slug of their label (SET03)."""
    rows = _fetches(spark, folder, "site_name", "title").where("site_name IS NOT NULL").withColumn("label", F.concat(F.col("site_name"), F.lit(" / "), (F.col("fetch_id") % 3).cast("string"), F.lit(":")))
    got = R.related_by_label(rows, "site_name", "label", "fetch_id", ["title"])
    return got.select("site_name", "key", F.size("items").alias("n"), F.get("items", F.lit(0))["fetch_id"].alias("first_id"))


SQL_RELATED = """
WITH f AS (SELECT DISTINCT fetch_id, site_name FROM fetch_cache WHERE site_name IS NOT NULL)
SELECT site_name, regexp_replace(regexp_replace(lower(site_name || ' / ' || fetch_id % 3 || ':'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, CAST(count(*) AS INTEGER) AS n, min(fetch_id) AS first_id FROM f GROUP BY ALL
"""


def forge_records(spark: SparkSession, folder: str) -> DataFrame:
    """Threads with their notes out of JSON bodies (ADP14, JON09)."""
    rows = _fetches(spark, folder, "title")
    body = F.when(F.col("fetch_id") % 5 == 0, "{bad").otherwise(F.to_json(F.struct(F.col("fetch_id").alias("iid"), F.col("title"), F.lit("opened").alias("state"), F.array(F.lit("a"), F.lit("b")).alias("labels"))))
    notes = F.to_json(F.array(F.struct(F.lit("one").alias("body"), F.lit(False).alias("system")), F.struct(F.lit("sys").alias("body"), F.lit(True).alias("system")), F.struct(F.lit(" ").alias("body"), F.lit(False).alias("system"))))
    x = rows.select("fetch_id", P.thread_record(body).alias("t"), P.thread_notes(F.when(F.col("fetch_id") % 2 == 0, notes).otherwise('{"message": "401"}'), 5).alias("notes"))
    return x.select("fetch_id", F.col("t").isNotNull().alias("parsed"), "t.iid", "t.state", F.array_join("t.labels", "+").alias("labels"), F.size("notes").alias("n_notes"))


SQL_FORGE_RECORDS = """
WITH f AS (SELECT DISTINCT fetch_id, title FROM fetch_cache), p AS (SELECT fetch_id, fetch_id % 5 <> 0 AND trim(coalesce(title, '')) <> '' AS ok FROM f)
SELECT fetch_id, ok AS parsed, CASE WHEN ok THEN fetch_id END AS iid, CASE WHEN ok THEN 'opened' END AS state, CASE WHEN ok THEN 'a+b' END AS labels, CASE WHEN fetch_id % 2 = 0 THEN 1 ELSE 0 END AS n_notes FROM p
"""


def code_records(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories and packages out of JSON bodies, joined by name (ADP16, ADP17, JON09)."""
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    repo = F.to_json(F.struct(F.col("p_name").alias("full_name"), F.col("p_size").alias("stargazers_count"), F.struct(F.lit("NOASSERTION").alias("spdx_id"), F.col("p_brand").alias("name")).alias("license"), F.lit(True).alias("archived")))
    package = F.concat(F.lit('{"name": "'), "p_name", F.lit('", "dist-tags": {"latest": "1.1"}, "repository": {"url": "git+https://h/x.git"}, "license": "MIT", "versions": {"1.0": {}, "1.1": {"dependencies": {"b": "1", "a": "2"}}}}'))
    x = p.select("p_partkey", P.repository_record(repo).alias("r"), P.package_record(package, F.when(F.col("p_partkey") % 2 == 0, "1.0").when(F.col("p_partkey") % 3 == 0, "9")).alias("k"))
    return x.select("p_partkey", "r.stars", "r.license", "r.archived", "k.version", F.col("k.license").alias("package_license"), "k.repository", F.array_join("k.dependencies", ",").alias("dependencies"), "k.version_count")


SQL_CODE = """
WITH p AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 2 = 0 THEN '1.0' WHEN p_partkey % 3 = 0 THEN NULL ELSE '1.1' END AS v FROM part)
SELECT p_partkey, CAST(p_size AS BIGINT) AS stars, p_brand AS license, true AS archived, v AS version, CASE WHEN v IS NOT NULL THEN 'MIT' END AS package_license, CASE WHEN v IS NOT NULL THEN 'https://h/x' END AS repository, CASE v WHEN '1.0' THEN '' WHEN '1.1' THEN 'a,b' END AS dependencies, CASE WHEN v IS NOT NULL THEN 2 END AS version_count FROM p
"""


def histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Stars to counts out of rating statistics (AGG06)."""
    p = table(spark, folder, "part").select("p_partkey", "p_size")
    s = F.to_json(F.struct(F.col("p_size").alias("fiveStarNum"), F.col("p_partkey").alias("oneStarNum"), F.lit("x").alias("threeStarNum")))
    return p.select("p_partkey", F.explode(P.rating_histogram(s)).alias("star", "n"))


SQL_HISTOGRAMS = "SELECT p_partkey, 5 AS star, CAST(p_size AS BIGINT) AS n FROM part UNION ALL SELECT p_partkey, 1, p_partkey FROM part"


def shop_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Product, image, search and channel addresses cleaned (URL16 to URL18, URL21)."""
    n = F.col("fetch_id").cast("string")
    host = F.concat(F.lit("https://"), U.host_of(F.col("url")))
    return _fetches(spark, folder, "url").select(
        "fetch_id",
        U.clean_product_url(F.concat(F.lit("/p/"), n, F.lit("?_pos=1&variant="), n, F.lit("&_sid=a#x")), host).alias("product"),
        U.clean_image_url(F.concat(F.lit("//img.example/"), n, F.lit(".jpg_480x480q75.jpg_.avif"))).alias("image"),
        U.clean_image_url(F.concat(F.lit("https://img.example/"), n, F.lit("._AC_SX300_.jpg"))).alias("sized"),
        U.shopping_search_url(F.concat(F.lit("https://www.google.com/shopping?q=red+shoe"), n, F.lit("&gl=br&tbm=x"))).alias("search"),
        U.channel_listing_url(F.concat(F.lit("https://youtube.com/@c"), n, F.when(F.col("fetch_id") % 2 == 0, "/streams?x=1").otherwise("/"))).alias("channel"),
    )


SQL_SHOP = """
WITH f AS (SELECT DISTINCT fetch_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host FROM fetch_cache)
SELECT fetch_id, 'https://' || host || '/p/' || fetch_id || '?variant=' || fetch_id AS product, 'https://img.example/' || fetch_id || '.jpg' AS image, 'https://img.example/' || fetch_id || '.jpg' AS sized,
  'https://www.google.com/search?q=red+shoe' || fetch_id || '&udm=28&gl=br' AS search, 'https://youtube.com/@c' || fetch_id || CASE WHEN fetch_id % 2 = 0 THEN '/streams' ELSE '/videos' END AS channel FROM f
"""


def folded_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as folded words, and fragments without tags (TXT22, TXT26)."""
    return _fetches(spark, folder, "title").where("title IS NOT NULL").select(
        "fetch_id", F.array_join(U.fold_accents(F.regexp_replace("title", r"[^\x20-\x7EÀ-ÿ]", "")), " ").alias("words"), U.strip_html(F.concat(F.lit("<p>a  <b>b</b><br/> c"), F.col("fetch_id").cast("string"), F.lit("</p>"))).alias("stripped")
    )


SQL_FOLDED = r"""
SELECT DISTINCT fetch_id, array_to_string(regexp_extract_all(regexp_replace(translate(lower(regexp_replace(title, '[^\x20-\x7E\x{C0}-\x{FF}]', '', 'g')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\x00-\x7F]', '', 'g'), '[a-z0-9]+'), ' ') AS words, 'a b' || chr(10) || 'c' || fetch_id AS stripped FROM fetch_cache WHERE title IS NOT NULL
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "services": (services, SQL_SERVICES),
    "forge_claims": (forge_claims, SQL_FORGE),
    "header_profiles": (header_profiles, SQL_HEADERS),
    "locations": (locations, SQL_LOCATIONS),
    "loads": (loads, SQL_LOADS),
    "fetch_warnings": (fetch_warnings, SQL_WARNINGS),
    "related_handles": (related_handles, SQL_RELATED),
    "forge_records": (forge_records, SQL_FORGE_RECORDS),
    "code_records": (code_records, SQL_CODE),
    "histograms": (histograms, SQL_HISTOGRAMS),
    "shop_addresses": (shop_addresses, SQL_SHOP),
    "folded_titles": (folded_titles, SQL_FOLDED),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
