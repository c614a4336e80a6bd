"""Queries of records in page state, structured articles, and whole quality records (JSN04, JSN05, ADP10, ADP21, TXT16, TXT25, TXT28)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import classify as C
from webstrata.functions import text as T
from webstrata.functions import trees
from webstrata.functions import values as V
from webstrata.functions.urls import host_of
from webstrata.operators.membership import blocked_hosts
from webstrata.operators.signals import text_signals
from webstrata.plans.pages import _WS, SQL_TEXT_SIGNALS, SQL_VISIBLE
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def state_records(spark: SparkSession, folder: str) -> DataFrame:
    """Listings out of page state of three shapes, with typed fields (JSN04, JSN05, ADP10)."""
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    ads = F.to_json(F.array(F.struct(F.col("p_partkey").alias("listId"), F.col("p_name").alias("subject"), F.concat(F.lit("R$ "), "p_size", F.lit(".000")).alias("price")), F.struct(F.lit(0).cast("long").alias("listId"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("price"))))
    state = F.concat(F.lit('{"props": {"few": {"ads": []}, "page": {"ads": '), ads, F.lit("}}}"))
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script>"))
    escaped = F.replace(F.replace(ads, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    flight = F.concat(F.lit('<script>self.__next_f.push([1,"x:{\\"ads\\":"])</script><script>self.__next_f.push([1,"'), escaped, F.lit('}"])</script>'))
    attribute = F.concat(F.lit('<div data-json="'), F.replace(state, F.lit('"'), F.lit("&quot;")), F.lit('"></div>'))
    html = F.when(F.col("p_partkey") % 4 == 0, script).when(F.col("p_partkey") % 4 == 1, flight).when(F.col("p_partkey") % 4 == 2, attribute).otherwise("<p>none</p>")
    rows = p.select("p_partkey", F.explode(trees.record_texts(html)).alias("ad"))
    get = lambda k: F.get_json_object("ad", f"$.{k}")
    return rows.select("p_partkey", get("listId").cast("long").alias("list_id"), get("subject").alias("subject"), V.brl_int(get("price")).alias("price"))


SQL_STATE = """
SELECT p_partkey, p_partkey AS list_id, p_name AS subject, CAST(p_size * 1000 AS BIGINT) AS price FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey, 0, NULL, NULL FROM part WHERE p_partkey % 4 < 3
"""


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Structured articles as markdown (TXT28, ADP21)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id").distinct()
    n = F.col("fetch_id").cast("string")
    body = F.concat(
        F.lit('{"sections": [{"type": "section", "name": "S'), n, F.lit('", "has_parts": [{"type": "paragraph", "value": " text "}, {"type": "list_item", "value": "a"}, {"type": "list_item", "value": "b"}, {"type": "paragraph", "table_references": [{"identifier": "t"}]}]}], "tables": [{"identifier": "t", "headers": [[{"value": "h"}]], "rows": [[{"value": "'), n, F.lit('"}]]}]}'),
    )
    return f.select("fetch_id", trees.article_markdown(F.when(F.col("fetch_id") % 6 == 0, "{").otherwise(body)).alias("markdown"))


SQL_ARTICLES = """
SELECT DISTINCT fetch_id, CASE WHEN fetch_id % 6 > 0 THEN '## S' || fetch_id || chr(10) || chr(10) || 'text' || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || '| h |' || chr(10) || '| --- |' || chr(10) || '| ' || fetch_id || ' |' END AS markdown FROM fetch_cache
"""


def comments(spark: SparkSession, folder: str) -> DataFrame:
    """Comments as markdown (TXT25)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id").distinct()
    html = F.concat(F.lit("<p>see <a href='/T1'>T"), F.col("fetch_id").cast("string"), F.lit("</a> <b>now</b></p><ul><li>x</li><li>y</li></ul><blockquote>q</blockquote>"))
    return f.select("fetch_id", trees.remarkup(html).alias("markdown"))


SQL_COMMENTS = "SELECT DISTINCT fetch_id, 'see [T' || fetch_id || '](/T1) **now**' || chr(10) || chr(10) || '- x' || chr(10) || '- y' || chr(10) || chr(10) || '> q' AS markdown FROM fetch_cache"


def quality_records(spark: SparkSession, folder: str) -> DataFrame:
    """Block list, paywall vendor, signals and score of each document; its page is the text within a frame (TXT16)."""
    d = table(spark, folder, "documents").select("doc_id", "text", "url", "title", "added_at")
    listed = table(spark, folder, "sites").where("category = 'classifieds'").select(F.col("host").alias("domain"))
    flagged = blocked_hosts(d.select("doc_id", host_of(F.col("url")).alias("host")), listed).select("doc_id", F.lit(True).alias("flag"))
    vendor = F.element_at(F.array(F.lit("piano.io"), F.lit(""), F.lit("qiota.com")), (F.col("doc_id") % 3 + 1).cast("int"))
    page = F.concat(F.lit("<nav>"), F.repeat(F.lit("menu "), (F.col("doc_id") % 50).cast("int")), F.lit('</nav><script src="'), vendor, F.lit('"></script>'), F.coalesce("text", F.lit("")))
    d = d.withColumns({"boilerplate": T.boilerplate_ratio(F.col("text"), C.visible_text(page)), "paywall_vendor": C.paywall_vendor(page)})
    x = text_signals(d.select("doc_id", "text"), "doc_id", "text").drop("text").join(d, "doc_id").join(flagged, "doc_id", "left")
    names = ("slop_vocab_ratio", "slop_phrase_count", "sentence_length_cv")
    score = T.slop_score({c: F.col(c) for c in names}, F.col("boilerplate"), F.coalesce(F.col("title") != "", F.lit(False)), F.col("added_at").isNotNull(), T.word_count(F.col("text")))
    return x.select("doc_id", F.coalesce("flag", F.lit(False)).alias("domain_flagged"), F.col("paywall_vendor").isNotNull().alias("paywalled"), "paywall_vendor", "boilerplate", score.alias("slop_score"))


SQL_QUALITY = f"""
WITH s AS ({SQL_TEXT_SIGNALS}), d AS (SELECT doc_id, coalesce(text, '') AS t, title, added_at, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host,
  coalesce(len(list_filter(regexp_split_to_array(text, '{_WS}'), lambda x: x <> '')), 0) AS n, '<nav>' || repeat('menu ', doc_id % 50) || '</nav><script src=""></script>' || coalesce(text, '') AS html FROM documents),
v AS (SELECT *, {SQL_VISIBLE} AS shown FROM d), b AS (SELECT *, round_even(greatest(0.0, least(1.0, 1 - length(t)::DOUBLE / greatest(length(shown), 1))), 4) AS boilerplate FROM v)
SELECT doc_id, coalesce(host IN (SELECT host FROM sites WHERE category = 'classifieds'), false) AS domain_flagged, doc_id % 3 <> 1 AS paywalled, (['piano.io', NULL, 'qiota.com'])[doc_id % 3 + 1] AS paywall_vendor, boilerplate,
  round_even(least(1.0, least(1.0, slop_vocab_ratio * 30) * 0.06 + least(1.0, slop_phrase_count / 3.0) * 0.06 + greatest(0.0, 1 - sentence_length_cv / 0.25) * 0.03 + least(1.0, boilerplate / 0.5) * 0.35
  + CASE WHEN n < 50 THEN 0.25 WHEN n < 150 THEN 0.15 WHEN n < 400 THEN 0.08 ELSE 0.0 END + CASE WHEN added_at IS NOT NULL THEN 0.0 ELSE 0.15 END + CASE WHEN title <> '' THEN 0.0 ELSE 0.1 END), 4) AS slop_score FROM b JOIN s USING (doc_id)
""".replace("replace(text, chr(10), chr(10) || chr(10)) AS t", "text AS t")


def quality_flags(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of the quality records that do not depend on signals (TXT16, CLS11, CLS13)."""
    return quality_records(spark, folder).drop("slop_score")


SQL_FLAGS = f"SELECT * EXCLUDE (slop_score) FROM ({SQL_QUALITY})"

CATALOG: dict[str, tuple[Query, str | None]] = {
    "state_records": (state_records, SQL_STATE),
    "articles": (articles, SQL_ARTICLES),
    "comments": (comments, SQL_COMMENTS),
    "quality_flags": (quality_flags, SQL_FLAGS),
    "quality_records": (quality_records, SQL_QUALITY),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
