"""Queries of value functions and payload parsers (NUM, DAT, ARR, JSN, ADP, TXT23, TXT24, TXT27)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import values as V
from webstrata.operators import payloads as P
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def money(spark: SparkSession, folder: str) -> DataFrame:
    """Prices written in several ways, read back, and labels made of them (NUM01 to NUM10)."""
    p = table(spark, folder, "part").select("p_partkey", F.round("p_retailprice", 2).alias("price"))
    body = F.translate(F.format_number("price", 2), ",.", ".,")
    return p.select(
        "p_partkey",
        V.brl_number(F.concat(F.lit("R$ "), body)).alias("brl"),
        V.brl_int(F.concat(F.lit("R$ "), body)).alias("brl_whole"),
        V.usd_number(F.concat(F.lit("$"), F.format_number("price", 2))).alias("usd"),
        V.usd_number(F.concat(F.lit("€"), body)).alias("foreign"),
        V.dot_price(F.concat(F.lit("EUR "), F.col("price").cast("decimal(18,2)").cast("string"))).alias("dotted"),
        V.first_int(F.concat(F.col("p_partkey").cast("string"), F.lit(" m²"))).alias("area"),
        V.magnitude_count(F.concat(F.lit("+"), (F.col("p_partkey") % 90).cast("string"), F.lit(" mil vendidos"))).alias("sold"),
        V.rating(F.concat((F.col("p_partkey") % 70 / 10).cast("decimal(3,1)").cast("string"), F.lit(" stars"))).alias("rating"),
        V.discount_percent(F.col("price") / 2, F.col("price")).alias("discount"),
        V.brl_label(F.col("price")).alias("label"),
    )


SQL_MONEY = """
WITH p AS (SELECT p_partkey, round(p_retailprice, 2) AS price FROM part), f AS (SELECT *, translate(format('{:,.2f}', price), ',.', '.,') AS body FROM p)
SELECT p_partkey, price AS brl, CAST(floor(price) AS BIGINT) AS brl_whole, price AS usd, CAST(NULL AS DOUBLE) AS "foreign", price AS dotted, p_partkey AS area, (p_partkey % 90) * 1000 AS sold,
  CASE WHEN p_partkey % 70 / 10.0 <= 5 THEN CAST(p_partkey % 70 / 10.0 AS DOUBLE) END AS rating, CAST(50.0 AS DOUBLE) AS discount, 'R$ ' || CASE WHEN price = floor(price) THEN replace(format('{:,}', CAST(price AS BIGINT)), ',', '.') ELSE body END AS label FROM f
"""


def dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates and durations in several shapes (DAT01 to DAT03)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "fetched_at").dropDuplicates(["fetch_id"])
    day = V.epoch_date(F.col("fetched_at"))
    unit = F.element_at(F.array(*map(F.lit, ["ms", "s", "m", "h", "d", ""])), (F.col("fetch_id") % 6 + 1).cast("int"))
    return rows.select(
        "fetch_id",
        day.alias("epoch_date"),
        V.compact_date(F.regexp_replace(day, "-", "")).alias("compact"),
        V.iso_prefix(F.concat(day, F.lit("T10:00:00Z"))).alias("iso"),
        V.date_parts(F.array(F.year(day.cast("date")), F.month(day.cast("date")), F.lit(None).cast("int"))).alias("parts"),
        V.duration_seconds(F.concat((F.col("fetch_id") % 50).cast("string"), unit)).alias("duration"),
        V.clock(F.col("fetch_id") * 37 - 5).alias("clock"),
    )


SQL_DATES = """
WITH f AS (SELECT fetch_id, strftime(make_timestamp(fetched_at * 1000000), '%Y-%m-%d') AS d FROM (SELECT DISTINCT fetch_id, fetched_at FROM fetch_cache))
SELECT fetch_id, d AS epoch_date, d AS compact, d AS iso, substr(d, 1, 7) AS parts, (fetch_id % 50) * CAST(([0.001, 1.0, 60.0, 3600.0, 86400.0, 1.0])[fetch_id % 6 + 1] AS DOUBLE) AS duration,
  CASE WHEN fetch_id * 37 - 5 >= 0 THEN CASE WHEN (fetch_id * 37 - 5) // 3600 > 0 THEN format('{}:{:02d}:{:02d}', (fetch_id * 37 - 5) // 3600, (fetch_id * 37 - 5) % 3600 // 60, (fetch_id * 37 - 5) % 60) ELSE format('{}:{:02d}', (fetch_id * 37 - 5) // 60, (fetch_id * 37 - 5) % 60) END END AS clock FROM f
"""


def small_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """First distinct strings, breadcrumbs, cheapest variants and named attributes (ARR, JSN05, JSN06, AGG05)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", "title", "site_name").dropDuplicates(["fetch_id"])
    words = F.split(F.coalesce("title", F.lit("")), " ")
    variants = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(F.when((F.col("fetch_id") + i) % 3 > 0, (F.col("fetch_id") * 7 + i * 13) % 101).alias("price"), i.alias("id")))
    pairs = F.array(F.struct(F.lit("Color").alias("name"), F.lit("red").alias("value")), F.struct(F.lit("color").alias("name"), F.lit("blue").alias("value")), F.struct(F.lit("Size").alias("name"), F.col("fetch_id").cast("string").alias("value")))
    return rows.select(
        "fetch_id",
        F.array_join(V.first_distinct(words, 3), "|").alias("first_words"),
        V.first_filled(F.lit(""), F.col("site_name"), F.lit("none")).alias("filled"),
        P.breadcrumb(F.array(F.lit("Home"), F.lit("A"), F.col("site_name"), F.lit("tail"))).alias("path"),
        V.cheapest(variants, "price")["id"].alias("cheapest_id"),
        F.array_min(F.transform(variants, lambda v: v["price"])).alias("price_min"),
        F.try_element_at(P.attributes(pairs), F.lit("color")).alias("color"),
    )


SQL_ARRAYS = """
WITH f AS (SELECT DISTINCT fetch_id, title, site_name FROM fetch_cache), w AS (SELECT *, list_filter(list_transform(string_split(coalesce(title, ''), ' '), lambda x: trim(x)), lambda x: x <> '') AS l,
  list_filter(list_transform([1, 2, 3, 4], lambda i: {'p': CASE WHEN (fetch_id + i) % 3 > 0 THEN (fetch_id * 7 + i * 13) % 101 END, 'i': i}), lambda v: v.p IS NOT NULL) AS v FROM f)
SELECT fetch_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: list_position(l, x)))[1:3], lambda i: l[i]), '|') AS first_words, coalesce(nullif(site_name, ''), 'none') AS filled,
  CASE WHEN site_name IS NULL THEN 'A' ELSE 'A > ' || site_name END AS path, list_sort(v)[1].i AS cheapest_id, list_sort(v)[1].p AS price_min, 'red' AS color FROM w
"""


def app_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Apps out of recorded bodies (ADP12)."""
    rows = table(spark, folder, "appdetails").select("response_id", "body").dropDuplicates(["response_id"])
    return P.app_records(rows).select("response_id", "app_id", "outcome", "name", "type", "is_free", "currency", "price", "list_price", "discount", "developers", "genres", "score", "coming_soon")


SQL_APPS = """
WITH b AS (SELECT DISTINCT response_id, body FROM appdetails WHERE json_valid(body) AND json_type(body) = 'OBJECT'), k AS (SELECT response_id, body, unnest(json_keys(body)) AS app_id FROM b),
a AS (SELECT response_id, app_id, json_extract(body, '$."' || app_id || '"') AS a FROM k), d AS (SELECT response_id, app_id, CAST(json_extract_string(a, '$.success') AS BOOLEAN) AS ok, CASE WHEN json_type(a, '$.data') = 'OBJECT' THEN json_extract(a, '$.data') END AS d FROM a),
x AS (SELECT *, CAST(json_extract_string(d, '$.price_overview.final') AS BIGINT) AS f, CAST(json_extract_string(d, '$.price_overview.initial') AS BIGINT) AS i FROM d)
SELECT response_id, app_id, CASE WHEN ok AND json_extract_string(d, '$.name') IS NOT NULL THEN 'ok' WHEN NOT coalesce(ok, false) THEN 'not_found' ELSE 'parse_failed' END AS outcome, json_extract_string(d, '$.name') AS name, json_extract_string(d, '$.type') AS type,
  CAST(json_extract_string(d, '$.is_free') AS BOOLEAN) AS is_free, json_extract_string(d, '$.price_overview.currency') AS currency, round(f / 100.0, 2) AS price, CASE WHEN i > f THEN round(i / 100.0, 2) END AS list_price,
  CASE WHEN i > f AND f > 0 THEN round_even((i - f)::DOUBLE / i * 100, 1) END AS discount,
  array_to_string(CAST(json_extract(d, '$.developers') AS VARCHAR[])[1:2], '; ') AS developers, array_to_string(list_transform(CAST(json_extract(d, '$.genres') AS JSON[]), lambda g: g ->> '$.description')[1:3], '; ') AS genres,
  CAST(json_extract_string(d, '$.metacritic.score') AS INTEGER) AS score, CAST(json_extract_string(d, '$.release_date.coming_soon') AS BOOLEAN) AS coming_soon FROM x
"""


def paper_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Papers out of recorded answers (ADP18)."""
    return P.paper_records(table(spark, folder, "crossref").select("response_id", "message").dropDuplicates(["response_id"]))


SQL_PAPERS = """
WITH c AS (SELECT DISTINCT response_id, message AS m FROM crossref), x AS (SELECT *, list_filter(list_transform(m.author, lambda a: coalesce(nullif(trim(concat_ws(' ', a.given, a.family)), ''), a.name)), lambda x: x IS NOT NULL) AS au,
  list_filter(list_transform(m.license, lambda l, i: {'r': CASE l."content-version" WHEN 'vor' THEN 1 WHEN 'am' THEN 2 WHEN 'tdm' THEN 3 ELSE 9 END, 'i': i, 'u': l.URL}), lambda l: l.u IS NOT NULL) AS li, list_filter(m.issued."date-parts"[1], lambda d: d IS NOT NULL) AS dp FROM c)
SELECT response_id, m IS NOT NULL AS parsed, lower(m.DOI) AS doi, nullif(m.title[1], '') AS title, nullif(m."container-title"[1], '') AS journal, array_to_string(au[1:3], '; ') AS authors, CAST(len(au) AS INTEGER) AS n_authors,
  nullif(array_to_string(list_transform(dp, lambda d, i: CASE WHEN i = 1 THEN CAST(d AS VARCHAR) ELSE lpad(CAST(d AS VARCHAR), 2, '0') END), '-'), '') AS issued, list_sort(li)[1].u AS license FROM x
"""


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of caption files made from documents (TXT23, TXT24)."""
    line = F.regexp_replace(F.coalesce("text", F.lit("x")), r"[\s<>-]+", " ")
    body = F.concat(F.lit("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nfirst "), line, F.lit("\n\n00:00:02.500 --> 00:00:03.000\nfirst "), line, F.lit("\n\n01:00:03.250 --> 01:00:04.000\n<c>tagged</c>\n\n01:00:05.250 --> 01:00:06.000\nlast\nline\n"))
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(P.cue_lines(body)).alias("cue", "c"))
    return rows.select("doc_id", "cue", "c.start", "c.text")


SQL_CAPTIONS = """
WITH d AS (SELECT doc_id, trim(regexp_replace('first ' || regexp_replace(coalesce(text, 'x'), '[\\s<>-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, 0 AS cue, CAST(1.0 AS DOUBLE) AS start, t AS text FROM d UNION ALL SELECT doc_id, 1, 3605.25, 'last line' FROM d
"""


def inverted_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts rebuilt from an index of words and places (TXT27)."""
    t = table(spark, folder, "fetch_cache").select("fetch_id", "title").dropDuplicates(["fetch_id"]).where("title IS NOT NULL AND title <> ''")
    words = t.select("fetch_id", F.posexplode(F.split("title", " ")).alias("place", "word"))
    index = words.groupBy("fetch_id", "word").agg(F.array_sort(F.collect_list("place")).alias("places")).groupBy("fetch_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("index"))
    return index.select("fetch_id", P.title_words(F.col("index")).alias("text"))


SQL_INVERTED = "SELECT DISTINCT fetch_id, title AS text FROM fetch_cache WHERE title IS NOT NULL AND title <> ''"


def linked_data(spark: SparkSession, folder: str) -> DataFrame:
    """Product objects of pages made from parts (JSN01 to JSN03, ADP07)."""
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    product = F.to_json(
        F.struct(
            F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"),
            F.struct(F.col("p_retailprice").alias("price"), F.lit("https://schema.org/UsedCondition").alias("itemCondition"), F.when(F.col("p_partkey") % 2 == 0, "InStock").otherwise("OutOfStock").alias("availability")).alias("offers"),
            F.struct(F.lit("4.9").alias("ratingValue"), F.col("p_partkey").cast("string").alias("ratingCount")).alias("aggregateRating"),
        )
    )
    page = F.concat(F.lit('<html><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph": [{"@type": "Site"}, '), product, F.lit("]}</script></html>"))
    return p.select("p_partkey", P.product_fields(P.of_type(P.linked_objects(page), "Product")).alias("f")).select("p_partkey", "f.*")


SQL_LINKED = "SELECT p_partkey, p_name AS name, p_brand AS brand, p_retailprice AS price, 'used' AS condition, p_partkey % 2 = 0 AS in_stock, CAST(4.9 AS DOUBLE) AS rating, p_partkey AS ratings FROM part"

CATALOG: dict[str, tuple[Query, str | None]] = {
    "money": (money, SQL_MONEY),
    "dates": (dates, SQL_DATES),
    "small_arrays": (small_arrays, SQL_ARRAYS),
    "app_rows": (app_rows, SQL_APPS),
    "paper_rows": (paper_rows, SQL_PAPERS),
    "captions": (captions, SQL_CAPTIONS),
    "inverted_text": (inverted_text, SQL_INVERTED),
    "linked_data": (linked_data, SQL_LINKED),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
