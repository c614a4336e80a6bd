"""Queries of search results and listing payloads (SRC01, SRC04, SRC05, ADP06, ADP09, ADP13, ADP18 to ADP20, ADP22, SRT01, ARR04)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import search as S
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of sites in canonical form with their parameters (SRC04, SRC05)."""
    s = table(spark, folder, "sites").select("host", F.concat(F.lit(" "), "default_language", F.when(F.col("default_language") == "pt", "-BR ").when(F.col("default_language") == "en", "-GB").otherwise("-xx")).alias("raw"))
    c = s.select("host", S.canonical_region(F.col("raw")).alias("region"))
    return c.select("host", "region", S.region_params(F.col("region")).alias("p")).select("host", "region", "p.country", "p.language")


SQL_REGIONS = """
SELECT host, CASE default_language WHEN 'pt' THEN 'br-pt' WHEN 'en' THEN 'uk-en' ELSE default_language || '-xx' END AS region, CASE default_language WHEN 'pt' THEN 'BR' WHEN 'en' THEN 'GB' ELSE CASE WHEN upper(default_language) IN ('ES', 'FR', 'DE', 'IT', 'RU') THEN upper(default_language) ELSE 'ALL' END END AS country,
  CASE default_language WHEN 'pt' THEN 'pt' WHEN 'en' THEN 'en' ELSE 'xx' END AS language FROM sites
"""


def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight usable results per site (SRC01, SRC02)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id", "url", "site_name").dropDuplicates(["fetch_id"]).where("site_name IS NOT NULL")
    url = F.when(F.col("fetch_id") % 5 == 0, "https://duckduckgo.com/y.js?ad=1").when(F.col("fetch_id") % 7 == 0, " ").otherwise(F.col("url"))
    return S.kept_results(f.select("site_name", "fetch_id", url.alias("url")), "site_name", "fetch_id", 8).select("site_name", "rank", "fetch_id", "url")


SQL_RESULTS = """
WITH f AS (SELECT DISTINCT fetch_id, url, site_name FROM fetch_cache WHERE site_name IS NOT NULL AND fetch_id % 5 <> 0 AND fetch_id % 7 <> 0)
SELECT site_name, CAST(row_number() OVER (PARTITION BY site_name ORDER BY fetch_id) AS INTEGER) AS rank, fetch_id, url FROM f QUALIFY row_number() OVER (PARTITION BY site_name ORDER BY fetch_id) <= 8
"""


def shopping_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Offers read off labels (ADP06)."""
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    price = F.concat(F.lit("R$ 1."), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit(",50"))
    label = F.concat("p_name", F.lit(". Preço atual: "), price, F.when(F.col("p_partkey") % 2 == 0, ". Era R$ 4.000,00").otherwise(""), F.lit(". De "), "p_brand", F.lit("."))
    return p.select("p_partkey", S.offer_label(F.when(F.col("p_partkey") % 9 == 0, "other text").otherwise(label)).alias("o")).select("p_partkey", "o.*")


SQL_LABELS = """
WITH p AS (SELECT p_partkey, p_name, p_brand, p_partkey % 9 <> 0 AS ok, CAST(1000.5 + p_partkey % 1000 AS DOUBLE) AS price FROM part)
SELECT p_partkey, CASE WHEN ok THEN p_name END AS title, CASE WHEN ok THEN price END AS price, CASE WHEN ok AND p_partkey % 2 = 0 THEN CAST(4000 AS DOUBLE) END AS was, CASE WHEN ok AND p_partkey % 2 = 0 THEN round_even((4000.0::DOUBLE - price) / 4000.0::DOUBLE * 100, 1) END AS discount, CASE WHEN ok THEN p_brand END AS store FROM p
"""


def store_products(spark: SparkSession, folder: str) -> DataFrame:
    """Store products out of JSON (ADP09, ARR04, AGG05)."""
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("long").alias("s"))
    variant = lambda i: F.struct(F.lit(i).alias("id"), (F.col("s") * 100 + 10 * i).alias("price"), (F.col("s") * 100 + 500 * (i % 2)).alias("compare_at_price"), (F.col("p_partkey") % 3 == i).alias("available"))
    body = F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("handle"), F.lit("").alias("vendor"), F.array(variant(2), variant(1)).alias("variants")))
    return p.select("p_partkey", S.store_product(F.when(F.col("p_partkey") % 8 == 0, "[]").otherwise(body)).alias("p")).where("p IS NOT NULL").select("p_partkey", "p.*")


SQL_STORE = """
SELECT p_partkey, p_name AS title, p_brand AS handle, NULL AS brand, CAST(p_size * 100 + 10 AS DOUBLE) / 100 AS price, CAST(p_size * 100 + 500 AS DOUBLE) / 100 AS list_price, p_partkey % 3 IN (1, 2) AS in_stock, 2 AS n_variants FROM part WHERE p_partkey % 8 <> 0
"""


def price_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The three newest deals of price logs (ADP13, SRT01, LIM01)."""
    o = table(spark, folder, "orders").select("o_custkey", F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.when(F.col("o_orderkey") % 4 > 0, F.struct(F.struct(F.round("o_totalprice", 2).alias("amount")).alias("price"), F.lit(1).alias("cut"))).alias("deal")).alias("x"))
    bodies = o.groupBy("o_custkey").agg(F.to_json(F.collect_list("x")).alias("body"))
    return bodies.select("o_custkey", F.posexplode(S.price_history(F.col("body"), 3)).alias("place", "h")).select("o_custkey", "place", "h.ts", "h.price")


SQL_PRICE_LOGS = """
SELECT o_custkey, CAST(row_number() OVER w - 1 AS INTEGER) AS place, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 4 > 0 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, round(o_totalprice, 2) DESC) QUALIFY row_number() OVER w <= 3
"""


def video_listings(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of channel listings as numbered lines (ADP20, ADP22)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id").distinct()
    entry = lambda i: F.struct(F.concat(F.lit("v"), (F.col("fetch_id") + i).cast("string")).alias("id"), F.lit(f"T{i}").alias("title"), (F.col("fetch_id") * i).cast("double").alias("duration"), F.lit("20240105").alias("upload_date"))
    rows = S.video_rows(F.to_json(F.struct(F.array(entry(1), entry(70)).alias("entries"))), 5)
    return f.select("fetch_id", S.numbered_lines(rows, "title", "length").alias("markdown"))


SQL_VIDEOS = """
WITH f AS (SELECT DISTINCT fetch_id AS i FROM fetch_cache), c AS (SELECT i, i AS a, i * 70 AS b FROM f), t AS (SELECT i, CASE WHEN a >= 3600 THEN format('{}:{:02d}:{:02d}', a // 3600, a % 3600 // 60, a % 60) ELSE format('{}:{:02d}', a // 60, a % 60) END AS x, CASE WHEN b >= 3600 THEN format('{}:{:02d}:{:02d}', b // 3600, b % 3600 // 60, b % 60) ELSE format('{}:{:02d}', b // 60, b % 60) END AS y FROM c)
SELECT i AS fetch_id, '1. T1 – ' || x || chr(10) || '2. T70 – ' || y AS markdown FROM t
"""


def paper_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds and ids of scholarly addresses (ADP19, URL20)."""
    c = table(spark, folder, "crossref").select("response_id", "request_url").dropDuplicates(["response_id"])
    n = F.lpad(F.col("response_id").cast("string"), 5, "0")
    made = F.when(F.col("response_id") % 4 == 0, F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/9"), n, F.lit("/"))).when(F.col("response_id") % 4 == 1, F.concat(F.lit("https://x.example/articles/pmc"), n)).when(F.col("response_id") % 4 == 2, F.concat(F.lit("https://arxiv.org/abs/2401."), n)).otherwise(F.col("request_url"))
    return c.select("response_id", S.paper_claim(made).alias("c")).select("response_id", "c.kind", "c.id")


SQL_CLAIMS = """
WITH c AS (SELECT DISTINCT response_id, request_url, lpad(CAST(response_id AS VARCHAR), 5, '0') AS n, nullif(lower(regexp_extract(request_url, '10\\.\\d{4,9}/[^\\s"''<>]+', 0)), '') AS d FROM crossref)
SELECT response_id, CASE response_id % 4 WHEN 0 THEN 'pmid' WHEN 1 THEN 'pmcid' WHEN 2 THEN 'arxiv' ELSE CASE WHEN d IS NOT NULL THEN 'doi' END END AS kind, CASE response_id % 4 WHEN 0 THEN '9' || n WHEN 1 THEN 'PMC' || n WHEN 2 THEN '2401.' || n ELSE d END AS id FROM c
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "regions": (regions, SQL_REGIONS),
    "search_results": (search_results, SQL_RESULTS),
    "shopping_labels": (shopping_labels, SQL_LABELS),
    "store_products": (store_products, SQL_STORE),
    "price_logs": (price_logs, SQL_PRICE_LOGS),
    "video_listings": (video_listings, SQL_VIDEOS),
    "paper_claims": (paper_claims, SQL_CLAIMS),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
