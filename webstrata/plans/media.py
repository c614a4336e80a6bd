"""Queries of videos, stores' and registries' answers, shopping labels and relevance (ADP06, ADP07, ADP09 to ADP14, ADP16, ADP17, ADP20, CLS18, CLS23, CLS25, RNK04, SRC01, SRC02, JON08, JON09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import catalogs as C
from webstrata.operators import media as M
from webstrata.operators import rank as R
from webstrata.operators import render as N
from webstrata.operators import routing as G
from webstrata.operators import scholar as P
from webstrata.operators import search as S
from webstrata.operators import shops as O
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0").alias("c"))


def _fetches(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "fetch_cache").select("fetch_id", *columns).dropDuplicates(["fetch_id"])


def video_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Transcripts with sponsored spans cut, or descriptions and chapters in their place (ADP20, CLS25, TXT23, TXT24, JON06)."""
    f = _fetches(spark, folder, "title").withColumn("t", F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[\s<>-]+", " ")))
    i = F.col("fetch_id")
    cue = lambda at, text: _text(f"00:00:{at:02d}.000 --> 00:00:{at + 1:02d}.000\n", text, "\n\n")
    vtt = F.concat(F.lit("WEBVTT\n\n"), cue(1, _text("hello ", F.col("t"))), cue(5, "buy this"), cue(9, "bye"), cue(11, "bye"))
    videos = f.select(
        i.cast("string").alias("video_id"), F.when(i % 3 == 0, F.array(F.lit("live_chat"))).otherwise(F.array(F.lit("de"), F.lit("en"))).alias("subtitles"), F.when(i % 6 == 3, F.array(F.lit("fr"), F.lit("pt-orig"))).alias("automatic"),
        vtt.alias("vtt"), F.when(i % 5 > 0, F.array(F.array(F.lit(4.0), F.lit(6.0)), F.array(F.lit(1.0)))).alias("spans"), F.when(i % 4 == 0, "").otherwise(F.col("t")).alias("description"),
        F.when(i % 8 > 0, F.array(F.struct(F.lit(3700.0).alias("start_time"), F.lit("Two").alias("title")), F.struct(F.lit(1.0).alias("start_time"), F.lit("").alias("title")))).alias("chapters"), i.cast("double").alias("duration"),
    )
    return M.transcripts(videos).select("video_id", "outcome", "markdown", "language", F.array_join("warnings", "+").alias("warnings"), "duration_seconds")


SQL_VIDEO_TEXTS = """
WITH f AS (SELECT DISTINCT fetch_id AS i, trim(regexp_replace(coalesce(title, ''), '[\\s<>-]+', ' ', 'g')) AS t FROM fetch_cache),
x AS (SELECT *, i % 3 > 0 OR i % 6 = 3 AS track, trim(regexp_replace('hello ' || t, '\\s+', ' ', 'g')) || CASE WHEN i % 5 > 0 THEN '' ELSE ' buy this' END || ' bye' AS said,
  nullif(array_to_string(list_filter([CASE WHEN i % 4 > 0 THEN t ELSE '' END, CASE WHEN i % 8 > 0 THEN '## Chapters' || chr(10) || '- 1:01:40 Two' ELSE '' END], lambda p: p <> ''), chr(10) || chr(10)), '') AS other FROM f)
SELECT CAST(i AS VARCHAR) AS video_id, CASE WHEN track OR other IS NOT NULL THEN 'ok' ELSE 'unsupported_content_type' END AS outcome, CASE WHEN track THEN said ELSE other END AS markdown, CASE WHEN i % 3 > 0 THEN 'en' WHEN i % 6 = 3 THEN 'pt-orig' END AS language,
  CASE WHEN track THEN CASE WHEN i % 5 = 0 THEN 'sponsorblock_unavailable' ELSE '' END WHEN other IS NOT NULL THEN 'no_captions' END AS warnings, CAST(i AS INTEGER) AS duration_seconds FROM x
"""


def video_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Lists of videos as markdown (ADP22)."""
    i = F.col("fetch_id")
    video = lambda k: F.struct(F.when(i % 2 == 0, f"V{k}").alias("title"), (i * k).alias("duration_seconds"), (i * 1000).alias("view_count"), F.when(i % 3 == 0, f"u{k}").alias("url"))
    videos = F.when(i % 7 == 0, F.array().cast("array<struct<title: string, duration_seconds: bigint, view_count: bigint, url: string>>")).otherwise(F.array(video(1), video(2)))
    return _fetches(spark, folder).select("fetch_id", M.video_markdown(F.lit("channel"), F.when(i % 5 > 0, "Name"), videos).alias("markdown"))


SQL_VIDEO_PAGES = """
WITH f AS (SELECT DISTINCT fetch_id AS i FROM fetch_cache), v AS (SELECT i, k, CASE WHEN i * k >= 3600 THEN format('{}:{:02d}:{:02d}', i * k // 3600, i * k % 3600 // 60, i * k % 60) ELSE format('{}:{:02d}', i * k // 60, i * k % 60) END AS clock FROM f, (VALUES (1), (2)) k(k)),
l AS (SELECT i, string_agg(k || '. ' || CASE WHEN i % 2 = 0 THEN 'V' || k ELSE '(untitled)' END || ' — ' || clock || ' — ' || format('{:,}', i * 1000) || ' views' || CASE WHEN i % 3 = 0 THEN chr(10) || '   u' || k ELSE '' END, chr(10) ORDER BY k) AS t FROM v GROUP BY i)
SELECT i AS fetch_id, '# ' || CASE WHEN i % 5 > 0 THEN 'Name' ELSE 'YouTube channel' END || chr(10) || chr(10) || CASE WHEN i % 7 = 0 THEN '_No videos found._' ELSE t END AS markdown FROM l
"""


def store_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Products of stores' product, collection and suggest answers, and the cart's currency (ADP09, ARR04)."""
    k = F.col("p_partkey")
    product = lambda price: _text('{"id": ', k, ', "title": " ', F.col("p_name"), '", "handle": "h', k, '", "vendor": "', F.col("p_brand"), '", ', price, '"variants": [{"id": 1, "price": "', F.col("p_size"), ".", F.col("c"), '", "compare_at_price": "99.00", "available": false}, {"id": 2, "price": "60.00"}]}')
    body = F.when(k % 4 == 0, _text('{"product": ', product(F.lit("")), "}")).when(k % 4 == 1, _text('{"products": [', product(F.lit("")), ', {"title": ""}]}')).when(k % 4 == 2, _text('{"resources": {"results": {"products": [', product(F.lit('"price": "12.50", "url": "/p?_pos=1&a=2#x", "available": true, ')), "]}}}")).otherwise('{"products": {}}')
    kind = F.element_at(F.array(*map(F.lit, ["product", "collection", "suggest", "collection"])), (k % 4 + 1).cast("int"))
    x = _parts(spark, folder).select("p_partkey", C.store_answer(body, kind, F.lit("https://s.test")).alias("f"), C.cart_currency(F.when(k % 2 == 0, '{"currency": "EUR"}').otherwise("{")).alias("currency"))
    return x.select("p_partkey", "f.outcome", "currency", F.explode_outer("f.items").alias("o")).select("p_partkey", "outcome", "currency", "o.title", "o.url", "o.price", "o.list_price", "o.in_stock", "o.n_variants")


SQL_STORE_ANSWERS = """
WITH p AS (SELECT *, p_partkey % 4 < 3 AS ok, p_partkey % 4 = 2 AS s, CAST(p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) AS v FROM part)
SELECT p_partkey, CASE WHEN ok THEN 'ok' ELSE 'parse_failed' END AS outcome, CASE WHEN p_partkey % 2 = 0 THEN 'EUR' END AS currency, CASE WHEN ok THEN p_name END AS title, CASE WHEN s THEN 'https://s.test/p?a=2' WHEN ok THEN 'https://s.test/products/h' || p_partkey END AS url,
  CASE WHEN s THEN 12.5 WHEN ok THEN v END::DOUBLE AS price, CASE WHEN ok AND NOT s THEN 99.0 END::DOUBLE AS list_price, CASE WHEN ok THEN s END AS in_stock, CASE WHEN ok THEN 2 END AS n_variants FROM p
"""


def game_searches(spark: SparkSession, folder: str) -> DataFrame:
    """Games of search answers (ADP12)."""
    k = F.col("p_partkey")
    item = _text('{"type": "app", "id": ', k, ', "name": "', F.col("p_name"), '", "price": {"currency": "USD", "final": ', F.col("p_size"), '50}, "metascore": "', F.col("c"), '", "platforms": {"windows": true, "mac": false, "linux": true}}')
    body = F.when(k % 5 == 0, '{"total": 0}').when(k % 7 == 0, '{"items": []}').otherwise(_text('{"items": [{"name": "no id"}, ', item, "]}"))
    x = _parts(spark, folder).select("p_partkey", C.game_search(body).alias("f"))
    return x.select("p_partkey", "f.outcome", F.explode_outer("f.items").alias("g")).select("p_partkey", "outcome", "g.position", "g.app_id", "g.price", "g.score", F.array_join("g.platforms", "+").alias("platforms"))


SQL_GAMES = """
WITH p AS (SELECT *, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'parse_failed' WHEN p_partkey % 7 = 0 THEN 'no_results' ELSE 'ok' END AS outcome, CASE WHEN k THEN 1 END AS position, CASE WHEN k THEN CAST(p_partkey AS VARCHAR) END AS app_id, CASE WHEN k THEN p_size + 0.5::DOUBLE END AS price,
  CASE WHEN k THEN CAST(p_partkey % 100 AS INTEGER) END AS score, CASE WHEN k THEN 'windows+linux' END AS platforms FROM p
"""


def enriched_games(spark: SparkSession, folder: str) -> DataFrame:
    """Games with reviews, players and lowest price, each where another service has it (JON08, ADP13)."""
    apps = table(spark, folder, "appdetails").select("response_id", "body").dropDuplicates(["response_id"])
    names = C.app_records(apps).select("app_id").distinct()
    n = F.length("app_id") + F.substring("app_id", -1, 1).cast("int")
    reviews = names.where(n % 2 == 0).select("app_id", _text('{"query_summary": {"review_score_desc": "Good", "total_reviews": ', n, "}}").alias("body"))
    players = names.select("app_id", _text('{"response": {"player_count": ', n, ', "result": ', n % 3, "}}").alias("body"))
    lows = names.where(n % 5 > 0).select("app_id", _text('[{"lows": [{"price": {"amount": ', n, '.499, "currency": "USD"}, "timestamp": "2024-05-06T00:00:00Z"}]}]').alias("body"))
    x = C.enriched_apps(apps, reviews, players, lows)
    return x.select("response_id", "app_id", "name", F.col("reviews.total_reviews").alias("total_reviews"), F.col("reviews.review_score_desc").alias("verdict"), "players", F.col("historical_low.price").alias("low"), F.col("historical_low.date").alias("low_date"))


SQL_ENRICHED = """
WITH b AS (SELECT DISTINCT response_id, body FROM appdetails WHERE json_valid(body) AND json_type(body) = 'OBJECT'), a AS (SELECT response_id, unnest(json_keys(body)) AS app_id, body FROM b),
x AS (SELECT response_id, app_id, json_extract_string(body, '$."' || app_id || '".data.name') AS name, length(app_id) + CAST(app_id[-1] AS INTEGER) AS n FROM a)
SELECT response_id, app_id, name, CASE WHEN n % 2 = 0 THEN n END AS total_reviews, CASE WHEN n % 2 = 0 THEN 'Good' END AS verdict, CASE WHEN n % 3 = 1 THEN n END AS players, CASE WHEN n % 5 > 0 THEN n + 0.5::DOUBLE END AS low, CASE WHEN n % 5 > 0 THEN '2024-05-06' END AS low_date FROM x
"""


def forge_projects(spark: SparkSession, folder: str) -> DataFrame:
    """Projects of a forge, READMEs with absolute links, downloads of packages (ADP14, ADP16, ADP17, JON09)."""
    i = F.col("fetch_id")
    body = F.when(i % 4 == 0, '{"message": "404"}').otherwise(_text('{"id": ', i, ', "path_with_namespace": "a/b', i, '", "star_count": ', i * 2, ', "tag_list": ["x"], "license": {"name": "MIT"}, "archived": false}'))
    readme = _text(" See [x](docs/a", i, ".md), [y](#top), [z](https://z.test) and ![p](./p.png) ")
    x = _fetches(spark, folder).select("fetch_id", C.project_record(body).alias("p"), C.absolute_readme(readme, _text("o/r", i), F.when(i % 2 == 0, "main")).alias("readme"), C.weekly_downloads(F.when(i % 3 == 0, 404).otherwise(200), _text('{"downloads": ', i, "}")).alias("downloads"))
    return x.select("fetch_id", "p.path", "p.stars", F.array_join("p.topics", ",").alias("topics"), "p.license", "p.archived", "readme", "downloads")


SQL_PROJECTS = """
WITH f AS (SELECT DISTINCT fetch_id AS i FROM fetch_cache), g AS (SELECT i, i % 4 > 0 AS k, 'https://github.com/o/r' || i || '/blob/' || CASE WHEN i % 2 = 0 THEN 'main' ELSE 'HEAD' END || '/' AS base FROM f)
SELECT i AS fetch_id, CASE WHEN k THEN 'a/b' || i END AS path, CASE WHEN k THEN i * 2 END AS stars, CASE WHEN k THEN 'x' END AS topics, CASE WHEN k THEN 'MIT' END AS license, CASE WHEN k THEN false END AS archived,
  'See [x](' || base || 'docs/a' || i || '.md), [y](#top), [z](https://z.test) and ![p](' || base || './p.png)' AS readme, CASE WHEN i % 3 > 0 THEN i END AS downloads FROM g
"""


def shopping_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Offers left of each shopping page, and labels left out by reason (ADP06, AGG04, AGG08)."""
    k = F.col("p_partkey")
    price = F.when(k % 50 == 0, "9.999,00").otherwise(_text("1.0", F.col("c"), ",00"))
    label = _text(F.when(k % 9 == 0, "PROMOÇÃO").otherwise(""), F.col("p_name"), ".  Preço atual: R$ ", price, ". Custava R$ 2.000,00. Avaliado com 4,", k % 10, " de 5. 2 mil avaliações. ", F.col("p_brand"), " e mais")
    label = F.when(k % 11 == 0, F.concat(label, F.lit(". Usado. x"))).when(k % 13 == 0, F.concat(F.lit("Preço no exterior: "), label)).when(k % 17 == 0, "short").otherwise(label)
    rows = _parts(spark, folder).select("p_brand", "p_partkey", label.alias("label"))
    offers, counts = C.page_offers(rows, "p_brand", "p_partkey", "label")
    kept = offers.select("p_brand", F.lit("offer").alias("what"), "p_partkey", "title", "price", "was", "discount", "rating", "reviews", "store", "other_stores", F.array_join("badges", ",").alias("badges"))
    left = counts.select("p_brand", F.col("reason").alias("what"), F.col("n").alias("p_partkey"))
    return kept.unionByName(left, allowMissingColumns=True)


SQL_SHOPPING = """
WITH p AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 'used' WHEN p_partkey % 13 = 0 THEN 'international' WHEN p_partkey % 17 = 0 THEN 'other' ELSE 'offer' END AS kind, CASE WHEN p_partkey % 50 = 0 THEN 9999 ELSE 1000 + p_partkey % 100 END AS price FROM part),
o AS (SELECT * FROM p WHERE kind = 'offer'), s AS (SELECT p_brand, list_sort(list(price)) AS v, count(*) AS n FROM o GROUP BY p_brand),
q AS (SELECT p_brand, n, ((v[(n + 1) // 4]) * (4 - ((n + 1) - 4 * ((n + 1) // 4))) + v[(n + 1) // 4 + 1] * ((n + 1) - 4 * ((n + 1) // 4))) / 4.0 AS q1,
  ((v[(n + 1) * 3 // 4]) * (4 - ((n + 1) * 3 - 4 * ((n + 1) * 3 // 4))) + v[(n + 1) * 3 // 4 + 1] * ((n + 1) * 3 - 4 * ((n + 1) * 3 // 4))) / 4.0 AS q3 FROM s WHERE n >= 8),
k AS (SELECT o.*, q.n IS NULL OR q3 - q1 <= 0 OR price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM o LEFT JOIN q USING (p_brand))
SELECT p_brand, 'offer' AS what, p_partkey, p_name AS title, price::DOUBLE AS price, CASE WHEN price < 2000 THEN 2000::DOUBLE END AS was, CASE WHEN price < 2000 THEN round_even((2000 - price) / 2000.0::DOUBLE * 100, 1) END AS discount, (4 + (p_partkey % 10) / 10.0)::DOUBLE AS rating, CAST(2000 AS BIGINT) AS reviews, p_brand AS store, true AS other_stores,
  CASE WHEN p_partkey % 9 = 0 THEN 'promo' ELSE '' END AS badges FROM k WHERE inside
UNION ALL SELECT p_brand, kind, count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE kind IN ('used', 'international') GROUP BY p_brand, kind
UNION ALL SELECT p_brand, 'outlier', count(*), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE NOT inside GROUP BY p_brand
"""


def marketplace_items(spark: SparkSession, folder: str) -> DataFrame:
    """Products with their sellers, and shells that hold none (ADP07)."""
    k = F.col("p_partkey")
    item = _text('<script type="application/ld+json">{"@type": "Product", "name": "', F.col("p_name"), '", "offers": {"price": "', F.col("p_size"), '.50", "seller": {"name": "', F.when(k % 3 > 0, F.col("p_brand")).otherwise(""), '", "aggregateRating": {"ratingValue": 4.5, "ratingCount": ', k, "}}}}</script>")
    html = F.when(k % 5 == 0, '<script type="application/ld+json">{"@type": "WebSite"}</script>').when(k % 7 == 0, "<p>").otherwise(item)
    x = _parts(spark, folder).select("p_partkey", C.marketplace_item(html).alias("f"))
    return x.select("p_partkey", "f.outcome", "f.logged_out", "f.item.name", "f.item.price", F.col("f.seller.name").alias("seller"), F.col("f.seller.ratings").alias("seller_ratings"))


SQL_MARKETPLACE = """
WITH p AS (SELECT *, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN k THEN 'ok' ELSE 'parse_failed' END AS outcome, p_partkey % 5 = 0 AS logged_out, CASE WHEN k THEN p_name END AS name, CASE WHEN k THEN p_size + 0.5::DOUBLE END AS price, CASE WHEN k AND p_partkey % 3 > 0 THEN p_brand END AS seller, CASE WHEN k AND p_partkey % 3 > 0 THEN p_partkey END AS seller_ratings FROM p
"""


def category_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """Landing pages that list nothing (ADP10)."""
    paths = ["/imoveis", "/imoveis/estado-sp", "/imoveis/venda", "/autos-e-pecas/estado-sp/x", "/", "/other"]
    url = F.concat(F.element_at(F.array(F.lit("https://www.olx.com.br"), F.lit("https://sp.olx.com.br")), (F.col("fetch_id") % 2 + 1).cast("int")), F.element_at(F.array(*map(F.lit, paths)), (F.col("fetch_id") % 6 + 1).cast("int")))
    return _fetches(spark, folder).select("fetch_id", C.is_category_hub(url).alias("hub"))


SQL_HUBS = "SELECT DISTINCT fetch_id, fetch_id % 2 = 0 AND fetch_id % 6 IN (0, 1) AS hub FROM fetch_cache"


def estates(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms, area and place read off names and descriptions of estates (ADP11)."""
    k = F.col("p_partkey")
    name = _text("Apartamento com ", k % 4, " vagas em ", F.col("p_brand"), ", Campinas - SP")
    text = _text("Tem ", k % 5 + 1, " dormitórios, ", k % 3, " total de banheiros", F.when(k % 2 == 0, _text(" e ", k % 7, " garagens")).otherwise(""), ", área construída ", F.col("p_size"), " m²")
    return _parts(spark, folder).select("p_partkey", C.estate_details(name, text).alias("e")).select("p_partkey", "e.*")


SQL_ESTATES = """
SELECT p_partkey, CAST(p_partkey % 5 + 1 AS INTEGER) AS bedrooms, CAST(p_partkey % 3 AS INTEGER) AS bathrooms, CAST(p_partkey % 4 AS INTEGER) AS parking, CAST(p_size AS BIGINT) AS area, p_brand AS neighborhood, 'Campinas' AS city FROM part
"""


def search_requests(spark: SparkSession, folder: str) -> DataFrame:
    """What search services are asked for (SRC01, SRC02, SRC04, SRC05)."""
    i = F.col("fetch_id")
    x = S.search_request(F.col("title"), (i % 30).cast("int"), F.element_at(F.array(F.lit(" PT-BR"), F.lit("uk-en"), F.lit("xx-yy")), (i % 3 + 1).cast("int")), F.element_at(F.array(F.lit("d"), F.lit("2024-01-01to2024-02-01"), F.lit(None).cast("string")), (i % 3 + 1).cast("int")), F.when(i % 2 == 0, "a.test"))
    return _fetches(spark, folder, "title").select("fetch_id", x.alias("r")).select("fetch_id", "r.*")


SQL_REQUESTS = """
SELECT DISTINCT fetch_id, CASE WHEN fetch_id % 2 = 0 THEN 'site:a.test ' || title ELSE title END AS text, CAST(fetch_id % 30 + 5 AS INTEGER) AS rows, CAST(least(fetch_id % 30, 20) AS INTEGER) AS count, (['pd', '2024-01-01to2024-02-01', NULL])[fetch_id % 3 + 1] AS freshness,
  (['BR', 'GB', 'ALL'])[fetch_id % 3 + 1] AS country, (['pt', 'en', 'yy'])[fetch_id % 3 + 1] AS language FROM fetch_cache
"""


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on unknown hosts (CLS23)."""
    i = F.col("fetch_id")
    body = F.element_at(F.array(F.lit('{"id": 1, "product": {"a": 1}}'), F.lit('{"product": {}}'), F.lit("<html>"), F.lit("[]")), (i % 4 + 1).cast("int"))
    status = F.when(i % 3 == 0, 503).otherwise(200)
    return _fetches(spark, folder).select("fetch_id", G.store_probe(i % 5 > 0, status, body, "$.product").alias("store"), G.forge_probe(i % 5 > 0, status, body, "$.id").alias("forge"))


SQL_PROBES = """
SELECT DISTINCT fetch_id, CASE WHEN fetch_id % 5 > 0 THEN fetch_id % 3 > 0 AND fetch_id % 4 = 0 END AS store, CASE WHEN fetch_id % 5 > 0 AND fetch_id % 3 > 0 THEN CASE fetch_id % 4 WHEN 0 THEN true WHEN 2 THEN false END END AS forge FROM fetch_cache
"""


def listing_relevance(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of each brand by words of a query in their names, BM25 and place; off-query ones last (RNK04)."""
    words = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), F.lit(0))
    p = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    x = R.listing_relevance(p, "p_brand", "p_partkey", words, ["red", "blue", "steel", "1"])
    return x.select("p_brand", "position", "p_partkey", "coverage", "off_query")


SQL_RELEVANCE = """
WITH t AS (SELECT p_partkey, p_brand, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS w FROM part), c AS (SELECT p_brand, count(*) AS n, avg(len(w)) AS avgdl FROM t GROUP BY p_brand),
d AS (SELECT p_brand, term, count(*) AS df FROM (SELECT p_brand, unnest(list_distinct(w)) AS term FROM t) GROUP BY ALL), i AS (SELECT p_brand, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d JOIN c USING (p_brand)),
f AS (SELECT p_brand, avg(idf) * 0.25 AS floor FROM i GROUP BY p_brand), h AS (SELECT p_brand, p_partkey, len(w) AS dl, unnest(list_filter(w, lambda x: x IN ('red', 'blue', 'steel', '1'))) AS term FROM t),
k AS (SELECT p_brand, p_partkey, dl, term, count(*) AS f FROM h GROUP BY ALL), s AS (SELECT k.p_brand, p_partkey, sum(CASE WHEN idf < 0 THEN floor ELSE idf END * k.f * 2.5 / (k.f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS coverage
  FROM k JOIN i ON i.p_brand = k.p_brand AND i.term = k.term JOIN f ON f.p_brand = k.p_brand GROUP BY ALL),
r AS (SELECT t.p_brand, t.p_partkey, coalesce(coverage, 0) AS coverage, coalesce(score, 0.0) AS score FROM t LEFT JOIN s USING (p_brand, p_partkey))
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY coverage DESC, round(score, 9) DESC, p_partkey) AS INTEGER) AS position, p_partkey, CAST(coverage AS INTEGER) AS coverage, coverage < 1 AS off_query FROM r
"""

def offer_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of each part as a list (ADP22)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    item = O.offer(title=F.when(k % 5 > 0, F.col("p_name")), price=F.when(k % 7 > 0, size * 100 + 0.5), list_price=F.when(k % 2 == 0, size * 200), currency=F.lit("BRL"), brand=F.when(k % 3 == 0, F.col("p_brand")), rating=F.when(k % 4 == 0, 4.5), ratings=F.when(k % 8 == 0, k), free_shipping=k % 9 == 0)
    items = F.when(k % 11 == 0, F.array().cast(f"array<struct<{', '.join(f'{n}: {t}' for n, t in O.FIELDS.items())}>>")).otherwise(F.array(item, item))
    return _parts(spark, folder).select("p_partkey", N.offers_markdown(items, F.lit("Shop")).alias("markdown"))


SQL_OFFER_PAGES = """
WITH p AS (SELECT *, translate(format('{:,.2f}', p_size * 100 + 0.5), ',.', '.,') AS price, translate(format('{:,}', p_size * 200), ',', '.') AS old FROM part),
l AS (SELECT p_partkey, '. **' || CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '?' END || '** — ' || CASE WHEN p_partkey % 7 > 0 THEN 'R$ ' || price ELSE 'Sob consulta' END AS head,
  array_to_string(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'de R$ ' || old END, CASE WHEN p_partkey % 4 = 0 THEN '4.5/5' || CASE WHEN p_partkey % 8 = 0 THEN ' (' || p_partkey || ')' ELSE '' END END, CASE WHEN p_partkey % 3 = 0 THEN p_brand END, CASE WHEN p_partkey % 9 = 0 THEN 'frete grátis' END], lambda x: x IS NOT NULL), ' · ') AS more FROM p),
t AS (SELECT p_partkey, head || CASE WHEN more <> '' THEN ' — ' || more ELSE '' END AS t FROM l)
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '# Shop' || chr(10) || chr(10) || 'Nenhum produto encontrado.' ELSE '2 produtos' || chr(10) || chr(10) || '1' || t || chr(10) || '2' || t END AS markdown FROM t
"""


def paper_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of all services as pages (ADP22)."""
    from webstrata.plans.ranking import _answers

    x = P.full_text(P.merged_papers(_answers(spark, folder), 3))
    return x.select("doi", N.paper_markdown(F.when(F.length("doi") % 2 == 0, " Body ")).alias("markdown"))


def _paper_sql() -> str:
    from webstrata.plans.ranking import SQL_STAR

    return f"""
WITH x AS ({SQL_STAR}), m AS (SELECT DISTINCT response_id, message FROM crossref WHERE message.DOI IS NOT NULL), c AS (SELECT lower(message.DOI) AS doi, message AS m FROM m QUALIFY row_number() OVER (PARTITION BY lower(message.DOI) ORDER BY response_id DESC) = 1),
y AS (SELECT x.*, nullif(trim(c.m."container-title"[1]), '') AS venue, list_filter(c.m.issued."date-parts"[1], lambda d: d IS NOT NULL)[1] AS year, list_filter(list_transform(c.m.author, lambda a: coalesce(nullif(trim(concat_ws(' ', nullif(trim(a.given), ''), nullif(trim(a.family), ''))), ''), nullif(trim(a.name), ''))), lambda a: a IS NOT NULL)[1:3] AS names FROM x LEFT JOIN c USING (doi))
SELECT doi, array_to_string(list_filter(['# ' || title, nullif(array_to_string(coalesce(names, []), ', ') || CASE WHEN author_count > 12 THEN ', … (+' || (author_count - 12) || ')' ELSE '' END, ''), nullif(concat_ws(' · ', venue, year, publisher), ''),
  concat_ws(' · ', CASE WHEN is_oa THEN '🔓 open access' || CASE WHEN oa_status <> 'closed' THEN ' (' || oa_status || ')' ELSE '' END ELSE '🔒 paywalled' END, 'cited by ' || format('{{:,}}', cited_by_count)), '**DOI:** [' || doi || '](https://doi.org/' || doi || ')',
  '**TL;DR:** ' || tldr, '## Abstract' || chr(10) || chr(10) || abstract, CASE WHEN length(doi) % 2 = 0 THEN '## Full text' || chr(10) || chr(10) || 'Body' END], lambda p: p IS NOT NULL), chr(10) || chr(10)) AS markdown FROM y
"""


def game_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Games with what other services know, as pages (ADP22); the pages' heads and facts on players and prices."""
    apps = table(spark, folder, "appdetails").select("response_id", "body").dropDuplicates(["response_id"])
    names = C.app_records(apps).select("app_id").distinct()
    n = F.length("app_id") * 1000
    players = names.select("app_id", _text('{"response": {"player_count": ', n, ', "result": 1}}').alias("body"))
    lows = names.select("app_id", _text('[{"lows": [{"price": {"amount": 3.5, "currency": "USD"}}]}]').alias("body"))
    none = names.limit(0).select("app_id", F.lit("").alias("body"))
    x = C.enriched_apps(apps, none, players, lows)
    page = N.game_markdown()
    return x.select("response_id", "app_id", F.regexp_extract(page, "^# (.*) — ", 1).alias("head"), F.regexp_extract(page, r"([\d,]+) playing now · (all-time low [A-Z]+ [\d.]+)", 1).alias("players"), F.regexp_extract(page, r"(all-time low [A-Z]+ [\d.]+)", 1).alias("low"))


SQL_GAME_PAGES = """
WITH b AS (SELECT DISTINCT response_id, body FROM appdetails WHERE json_valid(body) AND json_type(body) = 'OBJECT'), a AS (SELECT response_id, unnest(json_keys(body)) AS app_id, body FROM b)
SELECT response_id, app_id, coalesce(json_extract_string(body, '$."' || app_id || '".data.name'), '?') AS head, format('{:,}', length(app_id) * 1000) AS players, 'all-time low USD 3.50' AS low FROM a
"""


def article_records(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and quality fields of structured articles (ADP21)."""
    i = F.col("fetch_id")
    body = F.when(i % 6 == 0, "{cut").otherwise(_text('{"name": "N', i, '", "description": "', F.when(i % 2 == 0, "d").otherwise(""), '", "abstract": "a", "in_language": {"identifier": "en"}, "main_entity": {"identifier": "Q', i, '"}, "version": {"maintenance_tags": {"x": ', i % 3, '}, "scores": {}}, "infoboxes": [{"n": ', i, "}]}"))
    return _fetches(spark, folder).select("fetch_id", N.article_fields(body).alias("a")).select("fetch_id", "a.title", "a.language", "a.description", "a.wikidata", "a.maintenance_tags", "a.scores", "a.infoboxes")


SQL_ARTICLES = """
WITH f AS (SELECT DISTINCT fetch_id AS i, fetch_id % 6 > 0 AS k FROM fetch_cache)
SELECT i AS fetch_id, CASE WHEN k THEN 'N' || i END AS title, CASE WHEN k THEN 'en' END AS language, CASE WHEN k THEN CASE WHEN i % 2 = 0 THEN 'd' ELSE 'a' END END AS description, CASE WHEN k THEN 'Q' || i END AS wikidata, CASE WHEN k THEN '{"x":' || i % 3 || '}' END AS maintenance_tags,
  CAST(NULL AS VARCHAR) AS scores, CASE WHEN k THEN '[{"n":' || i || '}]' END AS infoboxes FROM f
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "video_texts": (video_texts, SQL_VIDEO_TEXTS),
    "video_pages": (video_pages, SQL_VIDEO_PAGES),
    "store_answers": (store_answers, SQL_STORE_ANSWERS),
    "game_searches": (game_searches, SQL_GAMES),
    "enriched_games": (enriched_games, SQL_ENRICHED),
    "forge_projects": (forge_projects, SQL_PROJECTS),
    "shopping_pages": (shopping_pages, SQL_SHOPPING),
    "marketplace_items": (marketplace_items, SQL_MARKETPLACE),
    "category_hubs": (category_hubs, SQL_HUBS),
    "estates": (estates, SQL_ESTATES),
    "search_requests": (search_requests, SQL_REQUESTS),
    "probes": (probes, SQL_PROBES),
    "listing_relevance": (listing_relevance, SQL_RELEVANCE),
    "offer_pages": (offer_pages, SQL_OFFER_PAGES),
    "paper_pages": (paper_pages, _paper_sql()),
    "game_pages": (game_pages, SQL_GAME_PAGES),
    "article_records": (article_records, SQL_ARTICLES),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
