"""Queries of page layouts: offers of four shops, tasks, keywords (ADP01 to ADP05, ADP08, ADP15, SET02), over pages made of parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import shops as S
from webstrata.operators import tasks as K
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size", F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0").alias("c"))


def _spread(rows: DataFrame) -> DataFrame:
    """Narrow rows over all cores before pages are made of them: a small file holds many, read by one task."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "p_partkey")


def _columns() -> list[Column]:
    return [F.col(x) for x in ("p_partkey", "p_name", "p_brand", "p_size", "c")]


EMPTY, LOST = "<ul class='{}'></ul>", "<p>Please wait</p>"


def market_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of marketplace listings: linked ones, cards with paid placements, none (ADP01)."""
    key, name, brand, size, c = _columns()
    linked = _text('<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "', name, '", "brand": {"name": "', brand, '"}, "offers": {"url": "https://p.test/MLB-', key, '", "price": ', size, '.5, "priceCurrency": "BRL", "availability": "https://schema.org/OutOfStock"}}, {"@type": "Product"}]}</script>')
    card = lambda url: _text("<div class='poly-card x'><a class=poly-component__title href='", *url, "#frag'>", name, "</a><div class='poly-price__current'><span class=andes-money-amount><span class=andes-money-amount__fraction>1.", F.lpad(size.cast("string"), 3, "0"), "</span><span class=andes-money-amount__cents>", c, "</span></span></div><s class='andes-money-amount andes-money-amount--previous'><span class=andes-money-amount__fraction>1.020</span></s></div>")
    cards = F.concat(card(["https://click1.mercadolivre.com.br/ad"]), card(["https://p.test/MLB", key]))
    html = F.when(key % 4 == 0, linked).when(key % 4 == 3, LOST).otherwise(cards)
    rows = S.parse_pages(_parts(spark, folder).withColumn("html", html), "market_listing")
    return rows.select("p_partkey", "found.outcome", F.posexplode_outer("found.items").alias("place", "o")).select("p_partkey", "outcome", "place", "o.title", "o.url", "o.id", "o.price", "o.list_price", "o.brand", "o.in_stock")


SQL_MARKET = """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN p_partkey % 4 < 3 THEN 0 END AS place, CASE WHEN p_partkey % 4 < 3 THEN p_name END AS title,
  CASE p_partkey % 4 WHEN 0 THEN 'https://p.test/MLB-' || p_partkey WHEN 3 THEN NULL ELSE 'https://p.test/MLB' || p_partkey END AS url, CASE WHEN p_partkey % 4 < 3 THEN 'MLB' || p_partkey END AS id,
  CASE p_partkey % 4 WHEN 0 THEN p_size + 0.5 WHEN 3 THEN NULL ELSE 1000 + p_size + (p_partkey % 100) / 100.0 END::DOUBLE AS price, CASE WHEN p_partkey % 4 IN (1, 2) AND 1000 + p_size + (p_partkey % 100) / 100.0 < 1020 THEN 1020.0 END::DOUBLE AS list_price,
  CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 4 = 0 THEN false END AS in_stock FROM part
"""


def market_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of product pages with variants and what only the page shows (ADP02, JON11)."""
    key, name, brand, size, c = _columns()
    variant = lambda i: _text('{"@type": "Product", "name": "', name, f' {i}", "productID": "MLB', key, f'{i}", "offers": {{"price": {i}, "availability": "InStock"}}}}')
    group = _text('<script type="application/ld+json">{"@type": "ProductGroup", "brand": "', brand, '", "aggregateRating": {"ratingValue": 4.5, "reviewCount": 7}, "hasVariant": [', variant(1), ", ", variant(2), "]}</script>")
    page = F.concat(group, _text("<span class=ui-pdp-subtitle>Novo  |  +", c, " mil vendidos</span><table><tr class=andes-table__row><th>Marca<td>", brand, "</table>"))
    ended = "<link rel='canonical' href='https://lista.mercadolivre.com.br/x'>"
    html = F.when(key % 5 == 0, ended).when(key % 5 == 1, LOST).otherwise(page)
    rows = _spread(_parts(spark, folder)).select("p_partkey", html.alias("html"), _text("https://p.test/p/MLB", key, (key % 3 + 1)).alias("url"))
    x = S.parse_pages(rows, "market_product")
    return x.select("p_partkey", "found.outcome", "found.item.title", "found.item.brand", "found.item.price", "found.item.rating", "found.item.ratings", "found.item.sold", F.try_element_at("found.specs", F.lit("Marca")).alias("made_by"))


SQL_ITEMS = """
WITH p AS (SELECT *, p_partkey % 5 > 1 AS k, CASE WHEN p_partkey % 3 = 1 THEN 2 ELSE 1 END AS v FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'not_found' WHEN 1 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN k THEN p_name || ' ' || v END AS title, CASE WHEN k THEN p_brand END AS brand, CASE WHEN k THEN v::DOUBLE END AS price, CASE WHEN k THEN 4.5::DOUBLE END AS rating,
  CASE WHEN k THEN 7 END AS ratings, CASE WHEN k THEN (p_partkey % 100) * 1000 END AS sold, CASE WHEN k THEN p_brand END AS made_by FROM p
"""


def store_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of a store's result pages in two countries, an item listed twice counted once (ADP04, SET02)."""
    key, name, brand, size, c = _columns()
    us = key % 2 == 0
    asin = F.lpad(key.cast("string"), 10, "B")
    money = F.when(us, _text("$1,", F.lpad(size.cast("string"), 3, "0"), ".", c)).otherwise(_text("R$ 1.", F.lpad(size.cast("string"), 3, "0"), ",", c))
    old = F.when(us, _text("BRL 9,000.00")).otherwise(_text("R$ 1.020,00"))
    card = _text("<div data-component-type='s-search-result' data-asin='", asin, "'><h2 aria-label='t'>", name, "</h2><span class='a-price a-text-price'><span class=a-offscreen>", old, "</span></span><span class=a-price><span class=a-offscreen>", money, "</span></span><i class=a-icon-alt>4,", (key % 10), " de 5</i><a aria-label='", (key % 9 + 1), ".", F.lpad(size.cast("string"), 3, "0"), " ratings'></a></div>")
    html = F.when(key % 5 == 0, EMPTY.format("s-main-slot")).when(key % 7 == 0, LOST).otherwise(F.concat(card, card))
    rows = _parts(spark, folder).select("p_partkey", html.alias("html"), F.when(us, "https://www.amazon.com/s?k=x").otherwise("https://www.amazon.com.br/s?k=x").alias("url"))
    x = S.parse_pages(rows, "store_listing")
    return x.select("p_partkey", "found.outcome", F.explode_outer("found.items").alias("o")).select("p_partkey", "outcome", "o.title", "o.url", "o.price", "o.list_price", "o.currency", "o.rating", "o.ratings")


SQL_STORE_OFFERS = """
WITH p AS (SELECT *, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS k, p_partkey % 2 = 0 AS us, 1000 + p_size + (p_partkey % 100) / 100.0 AS price FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no_results' WHEN p_partkey % 7 = 0 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN k THEN p_name END AS title,
  CASE WHEN k THEN CASE WHEN us THEN 'https://www.amazon.com/dp/' ELSE 'https://www.amazon.com.br/dp/' END || lpad(CAST(p_partkey AS VARCHAR), 10, 'B') END AS url, CASE WHEN k THEN price::DOUBLE END AS price, CASE WHEN k AND NOT us AND price < 1020 THEN 1020.0::DOUBLE END AS list_price,
  CASE WHEN k THEN CASE WHEN us THEN 'USD' ELSE 'BRL' END END AS currency, CASE WHEN k THEN (4 + (p_partkey % 10) / 10.0)::DOUBLE END AS rating, CASE WHEN k THEN (p_partkey % 9 + 1) * 1000 + p_size END AS ratings FROM p
"""


def store_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a store's product pages: stock, brand, features, specifications (ADP04)."""
    key, name, brand, size, c = _columns()
    stock = F.element_at(F.array(F.lit("Em estoque"), F.lit("Indisponível."), F.lit("Only 3 left")), (key % 3 + 1).cast("int"))
    page = _text("<span id=productTitle>\n ", name, " </span><div id=apex_desktop><span class='a-price x'><span class=a-price-symbol>R$</span><span class=a-price-whole>", size, ",</span><span class=a-price-fraction>", c, "</span></span></div><a id=bylineInfo>Visite a loja ", brand, "</a><div id=availability> <b>", stock, "</b></div><div id=feature-bullets><ul><li><span class=a-list-item>", name, "</span><li><span class=a-list-item>two</span></ul></div><table id=productDetails_techSpec_section_1><tr><th>Cor: <td>", brand, "</tr></table>")
    rows = _spread(_parts(spark, folder)).select("p_partkey", F.when(key % 6 == 0, LOST).otherwise(page).alias("html"), _text("https://www.amazon.com.br/x/dp/", F.lpad(key.cast("string"), 10, "A"), "/ref=y").alias("url"))
    x = S.parse_pages(rows, "store_product")
    return x.select("p_partkey", "found.outcome", "found.item.title", "found.item.id", "found.item.price", "found.item.brand", "found.item.in_stock", F.size("found.features").alias("n_features"), F.try_element_at("found.specs", F.lit("Cor")).alias("color"))


SQL_STORE_ITEMS = """
WITH p AS (SELECT *, p_partkey % 6 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN k THEN 'ok' ELSE 'parse_failed' END AS outcome, CASE WHEN k THEN p_name END AS title, CASE WHEN k THEN lpad(CAST(p_partkey AS VARCHAR), 10, 'A') END AS id, CASE WHEN k THEN CAST(p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS price, CASE WHEN k THEN p_brand END AS brand,
  CASE WHEN k THEN CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS in_stock, CASE WHEN k THEN 2 ELSE NULL END AS n_features, CASE WHEN k THEN p_brand END AS color FROM p
"""


def bazaar_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of a bazaar's result pages, read around their item links (ADP05, SET02)."""
    key, name, brand, size, c = _columns()
    card = lambda n: _text("<div class='card-out-wrapper z'><a href='//b.test/item/", key, f"{n}.html'><h3>", name, f" {n}</h3></a><span style='decimal_point:1'>R$</span><span style='decimal_point:2'>", size, "</span><span style='decimal_point:3'>,", c, "</span><s style='line-through'>R$99,00</s><span>4.", (key % 10), "</span><span>", c, " mil+ vendidos</span><i>-", size, "%</i></div>")
    html = F.when(key % 5 == 0, EMPTY.format("search-item")).when(key % 7 == 0, LOST).otherwise(F.concat(card(1), card(1), card(2)))
    x = S.parse_pages(_parts(spark, folder).select("p_partkey", html.alias("html"), F.lit("https://b.test/w").alias("url")), "bazaar_listing")
    return x.select("p_partkey", "found.outcome", F.posexplode_outer("found.items").alias("place", "o")).select("p_partkey", "outcome", "place", "o.title", "o.url", "o.price", "o.rating", "o.sold", "o.discount")


SQL_BAZAAR = """
WITH p AS (SELECT *, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS k FROM part), n AS (SELECT *, unnest(CASE WHEN k THEN [1, 2] ELSE [0] END) AS n FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no_results' WHEN p_partkey % 7 = 0 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN k THEN n - 1 END AS place, CASE WHEN k THEN p_name || ' ' || n END AS title, CASE WHEN k THEN 'https://b.test/item/' || p_partkey || n || '.html' END AS url,
  CASE WHEN k THEN CAST(p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS price, CASE WHEN k THEN (4 + (p_partkey % 10) / 10.0)::DOUBLE END AS rating, CASE WHEN k THEN (p_partkey % 100) * 1000 END AS sold, CASE WHEN k THEN p_size END AS discount FROM n
"""


def bazaar_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of a bazaar with the recorded answers of its review service (ADP05, JON09, AGG06)."""
    key, name, brand, size, c = _columns()
    reviews = _text('{"data": {"productEvaluationStatistic": {"evarageStar": 4.', (key % 10), ', "totalNum": ', key, ', "fiveStarNum": ', size, '}, "evaViewList": [{"buyerFeedback": " ok ", "buyerEval": 80}, {"buyerFeedback": ""}]}}')
    url = F.when(key % 6 == 0, "https://b.test/store").otherwise(_text("https://b.test/item/", key, ".html"))
    rows = _parts(spark, folder).select("p_partkey", _text("<meta property='og:title' content='", name, "'><h1>AliExpress</h1>").alias("html"), url.alias("url"), F.when(key % 4 == 0, "{cut").otherwise(reviews).alias("reviews"))
    x = S.parse_pages(rows, "bazaar_product")
    return x.select("p_partkey", "found.outcome", "found.item.title", "found.item.rating", "found.item.ratings", F.try_element_at("found.histogram", F.lit(5)).alias("five"), F.get("found.reviews", F.lit(0))["stars"].alias("stars"), F.size("found.reviews").alias("n_reviews"))


SQL_BAZAAR_ITEMS = """
WITH p AS (SELECT *, p_partkey % 6 > 0 AS k, p_partkey % 4 > 0 AS r FROM part)
SELECT p_partkey, CASE WHEN k THEN 'ok' ELSE 'parse_failed' END AS outcome, CASE WHEN k THEN p_name END AS title, CASE WHEN k AND r THEN (4 + (p_partkey % 10) / 10.0)::DOUBLE END AS rating, CASE WHEN k AND r THEN p_partkey END AS ratings, CASE WHEN r THEN p_size END AS five, CASE WHEN r THEN 4.0::DOUBLE END AS stars, CASE WHEN r THEN 1 END AS n_reviews FROM p
"""


def pet_offers(spark: SparkSession, folder: str) -> DataFrame:
    """Offers of linked result lists, with the size of the catalogue (ADP08)."""
    key, name, brand, size, c = _columns()
    item = _text('{"@type": "Product", "name": "', name, '", "url": "/', key, '", "sku": "', key, '", "brand": {"name": "', brand, '"}, "offers": {"price": "', size, ".", c, '", "availability": "InStock"}}')
    listed = lambda inside: _text('<script type="application/ld+json">{"@type": "ItemList", "description": "com ', size, ' produtos", "itemListElement": [', *inside, "]}</script>")
    html = F.when(key % 5 == 0, listed([])).when(key % 7 == 0, LOST).otherwise(listed([item, ', {"@type": "Thing"}']))
    x = S.parse_pages(_parts(spark, folder).select("p_partkey", html.alias("html")), "pet_listing")
    return x.select("p_partkey", "found.outcome", "found.total", F.explode_outer("found.items").alias("o")).select("p_partkey", "outcome", "total", "o.title", "o.id", "o.price", "o.brand", "o.in_stock")


SQL_PETS = """
WITH p AS (SELECT *, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no_results' WHEN p_partkey % 7 = 0 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN p_partkey % 5 = 0 OR k THEN p_size END AS total, CASE WHEN k THEN p_name END AS title, CASE WHEN k THEN CAST(p_partkey AS VARCHAR) END AS id,
  CASE WHEN k THEN CAST(p_size || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') AS DOUBLE) END AS price, CASE WHEN k THEN p_brand END AS brand, CASE WHEN k THEN true END AS in_stock FROM p
"""


def pet_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items with variants, reviews, categories and the price the page shows struck out (ADP08, AGG05, JSN06)."""
    key, name, brand, size, c = _columns()
    variant = lambda p: _text('{"@type": "Product", "name": "v", "offers": {"price": "', p, '.50", "priceCurrency": "BRL", "availability": "OutOfStock"}}')
    group = _text('<script type="application/ld+json">[{"@type": "ProductGroup", "name": "', name, '", "productGroupID": ', key, ', "aggregateRating": {"ratingValue": 4.798, "reviewCount": 3}, "review": [{"author": "ana", "description": "<p>good</p>"}], "hasVariant": [', variant(size), ", ", variant(size + 1), ']}, {"@type": "BreadcrumbList", "itemListElement": [{"name": "Home"}, {"item": {"name": "', brand, '"}}, {"name": "Food"}]}]</script>')
    page = F.concat(group, _text("<div class=bottom-ctas-bar__single-price>R$ 99,90 R$", size, ",50</div>"))
    x = S.parse_pages(_spread(_parts(spark, folder)).select("p_partkey", F.when(key % 6 == 0, LOST).otherwise(page).alias("html"), F.lit("https://p.test/x/p").alias("url")), "pet_product")
    return x.select("p_partkey", "found.outcome", "found.item.id", "found.item.price", "found.price_max", "found.item.list_price", "found.item.in_stock", "found.item.rating", "found.category", F.get("found.reviews", F.lit(0))["text"].alias("review"), "found.n_variants")


SQL_PET_ITEMS = """
WITH p AS (SELECT *, p_partkey % 6 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN k THEN 'ok' ELSE 'parse_failed' END AS outcome, CASE WHEN k THEN CAST(p_partkey AS VARCHAR) END AS id, CASE WHEN k THEN p_size + 0.5::DOUBLE END AS price, CASE WHEN k THEN p_size + 1.5::DOUBLE END AS price_max, CASE WHEN k THEN 99.9::DOUBLE END AS list_price, CASE WHEN k THEN false END AS in_stock,
  CASE WHEN k THEN 4.8::DOUBLE END AS rating, CASE WHEN k THEN p_brand || ' > Food' END AS category, CASE WHEN k THEN 'good' END AS review, CASE WHEN k THEN 2 ELSE 0 END AS n_variants FROM p
"""


def tracker_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task pages of a tracker with panels, comments and related tasks (ADP15, CLS20, SET03)."""
    key, name, brand, size, c = _columns()
    state = F.when(key % 2 == 0, "Closed, Resolved").otherwise("Open, High")
    page = _text("<meta property='og:title' content='T", key, " ", name, "'><div class=phui-header-subheader><span class=phui-tag-view>", state, "</span></div><div class=phui-curtain-panel><div class=phui-curtain-panel-header>Authored By</div><div class=phui-curtain-panel-body><a class=phui-link-person>", brand, "</a></div></div><div class=phui-timeline-shell><a class=phui-link-person>bo</a><div data-sigil='transaction-comment'><div class=phabricator-remarkup><p>Size <b>", size, "</b></p></div></div></div><dl class=phui-property-list-properties><dt>Mentioned In</dt><dd><a class='phui-handle'>T1</a></dd></dl>")
    html = F.when(key % 6 == 0, "<title>Login</title>").when(key % 7 == 0, LOST).otherwise(page)
    x = K.task_pages(_parts(spark, folder).select("p_partkey", html.alias("html")))
    body = F.col("found.body")
    return x.select("p_partkey", "found.outcome", "found.id", "found.title", "found.status", "found.priority", body["author"].alias("author"), F.get(body["comments"], F.lit(0))["text"].alias("comment"), F.get(body["related"], F.lit(0))["label"].alias("related"))


SQL_TASKS = """
WITH p AS (SELECT *, p_partkey % 6 > 0 AND p_partkey % 7 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'login_required' WHEN p_partkey % 7 = 0 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN k THEN p_partkey END AS id, CASE WHEN k THEN p_name END AS title, CASE WHEN k THEN CASE WHEN p_partkey % 2 = 0 THEN 'Resolved' ELSE 'Open' END END AS status,
  CASE WHEN k AND p_partkey % 2 = 1 THEN 'High' END AS priority, CASE WHEN k THEN p_brand END AS author, CASE WHEN k THEN 'Size **' || p_size || '**' END AS comment, CASE WHEN k THEN 'Mentioned In' END AS related FROM p
"""


def tracker_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Result lists of a tracker, other objects left out, each task once (ADP15)."""
    key, name, brand, size, c = _columns()
    item = _text("<li class=phui-oi><a class=phui-oi-link href='/T", key, "' title='T", key, ": ", name, "'>x</a><i class=phui-oi-attribute>· Stalled</i></li>")
    whole = lambda *inside: _text("<ul class='phui-oi-list-view'>", *inside, "</ul>")
    html = F.when(key % 5 == 0, whole("")).when(key % 7 == 0, LOST).otherwise(whole(item, item, "<li class=phui-oi><a class=phui-oi-link href='/D1'>d</a></li>"))
    x = K.task_lists(_parts(spark, folder).select("p_partkey", html.alias("html")))
    return x.select("p_partkey", "found.outcome", F.explode_outer("found.items").alias("t")).select("p_partkey", "outcome", "t.id", "t.title", "t.status")


SQL_LISTS = """
WITH p AS (SELECT *, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS k FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no_results' WHEN p_partkey % 7 = 0 THEN 'parse_failed' ELSE 'ok' END AS outcome, CASE WHEN k THEN p_partkey END AS id, CASE WHEN k THEN p_name END AS title, CASE WHEN k THEN 'Stalled' END AS status FROM p
"""


def listing_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """The words that listing addresses search for (ADP03)."""
    key, name, brand, size, c = _columns()
    slug = F.replace(name, F.lit(" "), F.lit("-"))
    url = F.when(key % 3 == 0, _text("https://lista.mercadolivre.com.br/", slug, "_Desde_49")).when(key % 3 == 1, _text("https://x.test/?a=1&q=", F.replace(name, F.lit(" "), F.lit("+")))).otherwise(_text("https://www.mercadolivre.com.br/", slug))
    return _parts(spark, folder).select("p_partkey", S.listing_keyword(url).alias("keyword"))


SQL_KEYWORDS = "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS keyword FROM part"

CATALOG: dict[str, tuple[Query, str | None]] = {
    "market_offers": (market_offers, SQL_MARKET),
    "market_items": (market_items, SQL_ITEMS),
    "store_offers": (store_offers, SQL_STORE_OFFERS),
    "store_items": (store_items, SQL_STORE_ITEMS),
    "bazaar_offers": (bazaar_offers, SQL_BAZAAR),
    "bazaar_items": (bazaar_items, SQL_BAZAAR_ITEMS),
    "pet_offers": (pet_offers, SQL_PETS),
    "pet_items": (pet_items, SQL_PET_ITEMS),
    "tracker_tasks": (tracker_tasks, SQL_TASKS),
    "tracker_lists": (tracker_lists, SQL_LISTS),
    "listing_keywords": (listing_keywords, SQL_KEYWORDS),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
