"""Offers out of shop pages, in one form for all shops.

``parse_pages`` reads pages by the layout of their kind and then applies that kind's column function to what
was read.  ``listing`` kinds give (outcome, items) of a result page, ``product`` kinds of one item's page: the
outcome is ``parse_failed`` where what makes the page one of its kind is missing, ``no_results`` where it is
there and empty, else ``ok``.  Pages with linked data are read off that, others off their layout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import values as V
from webstrata.functions.dom import Layout, page_items
from webstrata.functions.urls import clean_image_url, host_of, let, part, unquote
from webstrata.operators.payloads import linked_objects, rating_histogram

FIELDS = {
    "title": "STRING", "url": "STRING", "id": "STRING", "price": "DOUBLE", "list_price": "DOUBLE", "currency": "STRING", "brand": "STRING", "rating": "DOUBLE", "ratings": "LONG", "seller": "STRING",
    "image": "STRING", "in_stock": "BOOLEAN", "sold": "LONG", "discount": "INT", "installments": "STRING", "free_shipping": "BOOLEAN", "sponsored": "BOOLEAN",
}


def offer(**given: Column) -> Column:
    """An offer of the given fields, others null."""
    return F.struct(*[given.get(n, F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


def answer(parsed: Column, items: Column) -> Column:
    """(outcome, items) with their places from 1."""
    outcome = F.when(~F.coalesce(parsed, F.lit(False)), "parse_failed").when(F.size(items) > 0, "ok").otherwise("no_results")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", items).alias("items"))


def _raw(item: Column, name: str) -> Column:
    return F.try_element_at(item, F.lit(name))


def _once(use: Callable[..., Column], **values: Column) -> Column:
    """``use`` of the values, each worked out once however often it is mentioned."""
    return let(F.struct(*[v.alias(n) for n, v in values.items()]), lambda s: use(**{n: s[n] for n in values}))


def _filled(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def _json(o: Column, *paths: str) -> Column:
    return F.coalesce(*[_filled(F.trim(F.get_json_object(o, p))) for p in paths])


def _stock(text: Column) -> Column:
    return F.lower(text).contains("instock")


def _brand(o: Column) -> Column:
    plain = _json(o, "$.brand")
    return F.coalesce(_json(o, "$.brand.name"), F.when(~F.coalesce(plain, F.lit("")).startswith("{"), plain))


def of_types(objects: Column, kind: str) -> Column:
    return F.filter(objects, lambda o: F.get_json_object(o, "$.@type") == kind)


# --- Listings and items of a marketplace with linked data, else rendered cards

AD_CLICKS = "click1.mercadolivre.com.br"  # a fixed value: links of this host are paid placements
CARD_PRICE = ".poly-price__current .andes-money-amount"
MARKET_CARDS = Layout(
    anchors="div.poly-card",
    card="div.poly-card",
    fields={
        "title": ("a.poly-component__title", "text"),
        "url": ("a.poly-component__title", "@href"),
        "whole": (f"{CARD_PRICE} .andes-money-amount__fraction", "text"),
        "cents": (f"{CARD_PRICE} .andes-money-amount__cents", "text"),
        "old": (".andes-money-amount--previous .andes-money-amount__fraction", "text"),
        "old_cents": (".andes-money-amount--previous .andes-money-amount__cents", "text"),
        "seller": (".poly-component__seller", "text"),
        "shipping": (".poly-component__shipping-v2", "text"),
        "image": ("img.poly-component__picture", "@src"),
    },
)
MARKET_PAGE = Layout(
    anchors="*",
    card=None,
    fields={
        "subtitle": (".ui-pdp-subtitle", "text"),
        "installments": (".ui-pdp-price__subtitles", "text"),
        "seller": ("[class*=seller__header__title]", "text"),
        "old": (".ui-pdp-price s .andes-money-amount__fraction", "text"),
        "canonical": ("link[rel=canonical]", "@href"),
        "specs": (".andes-table__row", "pairs th|td"),
    },
)

def market_id(*texts: Column) -> Column:
    """The first item number among texts."""
    found = [F.nullif(F.upper(F.regexp_extract(t, r"(?i)MLB-?([A-Z]?\d+)", 1)), F.lit("")) for t in texts]
    return F.concat(F.lit("MLB"), F.coalesce(*found))


def _linked_offer(o: Column) -> Column:
    url = _json(o, "$.offers.url", "$.url")
    return offer(
        title=_json(o, "$.name"), url=url, id=market_id(url, _json(o, "$.sku"), _json(o, "$.productID")), price=V.dot_price(_json(o, "$.offers.price")), currency=_json(o, "$.offers.priceCurrency"), brand=_brand(o),
        rating=V.rating(_json(o, "$.aggregateRating.ratingValue")), ratings=_json(o, "$.aggregateRating.ratingCount", "$.aggregateRating.reviewCount").try_cast("long"), image=_plain(_json(o, "$.image")), in_stock=_stock(_json(o, "$.offers.availability")),
        free_shipping=_json(o, "$.offers.shippingDetails.shippingRate.value", "$.offers.shippingDetails[0].shippingRate.value").try_cast("double") == 0,
    )


def _plain(x: Column) -> Column:
    """A text that is no list or record."""
    return F.when(~x.rlike(r"^[\[{]"), x)


def market_listing(page: Column, html: Column) -> Column:
    """Offers of a result page (ADP01): its linked products, else its cards; paid placements left out."""
    linked = F.filter(of_types(linked_objects(html), "Product"), lambda o: _json(o, "$.offers.url").isNotNull() & _json(o, "$.name").isNotNull())
    money = lambda c, whole, cents: V.brl_number(F.concat(_raw(c, whole), F.lit(","), F.coalesce(_raw(c, cents), F.lit("0"))))

    def card(c: Column) -> Column:
        url = F.substring_index(_raw(c, "url"), "#", 1)
        free = F.when(F.lower(_raw(c, "shipping")).contains("grátis"), True)
        image = F.when(_raw(c, "image").startswith("http"), _raw(c, "image"))
        price = money(c, "whole", "cents")
        return offer(title=_raw(c, "title"), url=url, id=market_id(url), price=price, list_price=V.list_price(price, money(c, "old", "old_cents")), currency=F.lit("BRL"), seller=_raw(c, "seller"), free_shipping=free, image=image)

    shown = F.filter(page["items"], lambda c: _raw(c, "title").isNotNull() & (_raw(c, "url") != "") & (host_of(_raw(c, "url")) != AD_CLICKS))
    return F.when(F.size(linked) > 0, answer(F.lit(True), F.transform(linked, _linked_offer))).otherwise(answer(page["parsed"], F.transform(shown, card)))


def market_product(page: Column, html: Column, url: Column) -> Column:
    """The item of a product page (ADP02, JON11): its linked product, or the variant asked for of a group, with
    what only the page shows; a page that leads to a listing is one whose offer has ended."""
    return let(linked_objects(html), lambda objects: _once(lambda **found: _market_variant(F.get(page["items"], F.lit(0)), url, **found), **_market_parts(objects, url)))


def _market_parts(objects: Column, url: Column) -> dict[str, Column]:
    """The single product and the group with variants among a page's objects, and the number asked for."""
    group = F.filter(of_types(objects, "ProductGroup"), lambda o: F.get_json_object(o, "$.hasVariant[0]").isNotNull())
    return {"single": F.get(of_types(objects, "Product"), F.lit(0)), "group": F.get(group, F.lit(0)), "wanted": market_id(url)}


def _market_variant(extras: Column, url: Column, single: Column, group: Column, wanted: Column) -> Column:
    def chosen(variants: Column) -> Column:
        hits = F.filter(variants, lambda v: (market_id(_json(v, "$.productID")) == wanted) | (market_id(_json(v, "$.url")) == wanted) | (market_id(_json(v, "$.sku")) == wanted))
        item = F.coalesce(single, F.get(hits, F.lit(0)), F.get(variants, F.lit(0)))
        return let(item, lambda item: _market_item(extras, url, single, group, variants, item))

    return let(F.from_json(F.get_json_object(group, "$.hasVariant"), "array<string>"), chosen)


def _market_item(extras: Column, url: Column, single: Column, group: Column, variants: Column, item: Column) -> Column:
    o = _linked_offer(item)

    def read(price: Column, final: Column, old: Column, sold: Column) -> Column:
        found = offer(
            title=o["title"], url=final, id=F.coalesce(F.when(single.isNotNull(), market_id(_json(item, "$.sku"))), market_id(_json(item, "$.productID")), market_id(final)), price=price,
            list_price=V.list_price(price, old), currency=o["currency"], brand=F.coalesce(o["brand"], _brand(group)), rating=F.coalesce(o["rating"], V.rating(_json(group, "$.aggregateRating.ratingValue"))),
            ratings=F.coalesce(_json(item, "$.aggregateRating.reviewCount").try_cast("long"), o["ratings"], _json(group, "$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount").try_cast("long")), seller=_raw(extras, "seller"), image=F.coalesce(o["image"], _json(item, "$.image[0]")), in_stock=o["in_stock"],
            sold=V.magnitude_count(sold), installments=_raw(extras, "installments"), free_shipping=o["free_shipping"],
        )
        ended = host_of(_raw(extras, "canonical")).startswith("lista.")
        outcome = F.when(item.isNotNull(), "ok").when(F.coalesce(ended, F.lit(False)), "not_found").otherwise("parse_failed")
        return F.struct(outcome.alias("outcome"), F.when(item.isNotNull(), found).alias("item"), F.from_json(_raw(extras, "specs"), "map<string, string>").alias("specs"), F.size(F.coalesce(variants, F.array().cast("array<string>"))).alias("n_variants"))

    sold = _filled(F.regexp_extract(_raw(extras, "subtitle"), r"(?i)([\d.,]+\s*(?:mil|mi)?)\s*vendido", 1))
    return _once(read, price=o["price"], final=F.coalesce(_json(item, "$.offers.url"), url), old=V.brl_number(_raw(extras, "old")), sold=sold)


def listing_keyword(url: Column) -> Column:
    """The words a listing address searches for (ADP03): the first path part of the list host up to its
    filters, else the query's ``q`` or ``as_word``; null for others."""
    segments = F.filter(F.split(part(url, "path"), "/"), lambda s: s != "")
    slug = F.substring_index(F.get(segments, F.lit(0)), "_", 1)
    words = F.trim(F.regexp_replace(unquote(slug), "[-+]", " "))
    by_path = F.when(host_of(url).startswith("lista."), F.nullif(words, F.lit("")))
    tokens = F.split(part(url, "query"), "&")
    of = lambda name: F.nullif(F.trim(unquote(F.replace(F.substr(F.get(F.filter(tokens, lambda t: t.startswith(f"{name}=")), F.lit(0)), F.lit(len(name) + 2)), F.lit("+"), F.lit(" ")))), F.lit(""))
    return F.coalesce(by_path, of("q"), of("as_word"))


# --- A store in two countries, read off its layout

PRICE, OLD_PRICE = ".a-price:not(.a-text-price)", ".a-price.a-text-price"


def _prices(scope: str, name: str, selector: str) -> dict[str, tuple[str, str]]:
    at = lambda tail: " || ".join(f"{s} {selector}{tail}".strip() for s in scope.split("||"))
    return {name: (at(" .a-offscreen"), "text"), f"{name}_sign": (at(" .a-price-symbol"), "text"), f"{name}_whole": (at(" .a-price-whole"), "text"), f"{name}_part": (at(" .a-price-fraction"), "text")}


STORE_CARDS = Layout(
    anchors='[data-component-type="s-search-results"], .s-main-slot, .s-result-list',
    card='div[data-component-type="s-search-result"]',
    key="id",
    fields={
        "id": ("", "here@data-asin"),
        "title": ("h2[aria-label] || h2 a span || h2 span || h2", "text"),
        **_prices("", "price", PRICE),
        **_prices("", "old", OLD_PRICE),
        "rating": (".a-icon-alt", "text"),
        "labels": ("[aria-label]", "all@aria-label"),
        "image": ("img.s-image", "@src"),
        "sponsored": ('[class*="sponsored-label"], [data-component-type="sp-sponsored-result"]', "present"),
    },
)
BLOCKS = "#corePriceDisplay_desktop_feature_div || #corePrice_feature_div || #apex_desktop || #price_inside_buybox || "
STORE_PAGE = Layout(
    anchors="#productTitle",
    card=None,
    fields={
        "title": ("#productTitle", "text"),
        "id": ("input#ASIN, input#ASIN_NO_DP", "@value"),
        **_prices(BLOCKS, "price", PRICE),
        **_prices(BLOCKS, "old", OLD_PRICE),
        "rating": ("#acrPopover", "@title"),
        "rating_text": ("#acrPopover || span[data-hook=rating-out-of-text]", "text"),
        "ratings": ("#acrCustomerReviewText", "text"),
        "brand": ("#bylineInfo", "text"),
        "stock": ("#availability", "text"),
        "features": ("#feature-bullets .a-list-item", "texts"),
        "image": ("#landingImage", "@data-old-hires"),
        "image_src": ("#landingImage || #imgTagWrapperId img", "@src"),
        "specs": ("#productDetails_techSpec_section_1 tr, #productDetails_detailBullets_sections1 tr, .prodDetTable tr", "pairs th|td"),
        "anchor": ("#productTitle", "present"),
    },
)
# What a store says of stock; the negative ones are asked first, as one holds the other.
NO_STOCK = ["indisponível", "esgotado", "fora de estoque", "currently unavailable", "out of stock"]
IN_STOCK = ["em estoque", "disponível", "in stock"]


def _store_money(item: Column, name: str, base: Column) -> Column:
    """An amount in the store's own currency; its hidden text, else its visible parts put together."""
    parts = F.concat(F.coalesce(_raw(item, f"{name}_sign"), F.lit("")), _raw(item, f"{name}_whole"), F.coalesce(_raw(item, f"{name}_part"), F.lit("")))
    text = F.coalesce(_raw(item, name), parts)
    return F.when(_is_us(base), V.usd_number(F.when(text.rlike(r"^\d"), F.concat(F.lit("$"), text)).otherwise(text))).otherwise(V.brl_number(text))


def _is_us(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^(?:www|m)\.", "") == "amazon.com"


def _store_url(asin: Column, base: Column) -> Column:
    return F.concat(F.lit("https://"), F.coalesce(F.nullif(host_of(base), F.lit("")), F.lit("www.amazon.com.br")), F.lit("/dp/"), asin)


def _grouped_count(text: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(text, r"\d[\d.,]*", 0), r"\D", ""), F.lit("")).try_cast("long")


def _rating(text: Column) -> Column:
    return V.rating(F.nullif(F.regexp_extract(text, r"\d(?:[.,]\d)?", 0), F.lit("")))


def _currency(base: Column) -> Column:
    return F.when(_is_us(base), "USD").otherwise("BRL")


def store_listing(page: Column, url: Column) -> Column:
    """Offers of a result page (ADP04, SET02), each item once."""

    def card(c: Column) -> Column:
        price = _store_money(c, "price", url)
        counts = F.filter(F.split(_raw(c, "labels"), "\n"), lambda x: x.rlike(r"(?i)^\s*[\d.,]+\s+(?:classifica|avalia|rating|review)"))
        return offer(
            title=_raw(c, "title"), url=_store_url(_raw(c, "id"), url), id=_raw(c, "id"), price=price, list_price=V.list_price(price, _store_money(c, "old", url)), currency=_currency(url),
            rating=_rating(_raw(c, "rating")), ratings=_grouped_count(F.get(counts, F.lit(0))), image=clean_image_url(_raw(c, "image")), sponsored=F.when(_raw(c, "sponsored").isNotNull(), True),
        )

    return answer(page["parsed"], F.transform(page["items"], card))


def store_product(page: Column, url: Column) -> Column:
    """The item of a product page (ADP04), with its features and specifications."""
    c = F.get(page["items"], F.lit(0))
    asin = F.coalesce(F.nullif(F.regexp_extract(part(url, "path"), r"/(?:dp|gp/product|gp/aw/d|product)/([A-Z0-9]{10})(?:/|$)", 1), F.lit("")), _raw(c, "id"))
    price = _store_money(c, "price", url)
    low = F.lower(_raw(c, "stock"))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    brand = F.regexp_replace(_raw(c, "brand"), r"(?i)^(?:marca:|brand:|visite a loja\s*|visit the\s*|loja:)\s*", "")
    item = offer(
        title=_raw(c, "title"), url=F.coalesce(_store_url(asin, url), url), id=asin, price=price, list_price=V.list_price(price, _store_money(c, "old", url)), currency=_currency(url), brand=F.nullif(F.trim(F.regexp_replace(brand, r"(?i)\s+(?:loja|store)$", "")), F.lit("")),
        rating=_rating(F.coalesce(_raw(c, "rating"), _raw(c, "rating_text"))), ratings=_grouped_count(_raw(c, "ratings")), image=clean_image_url(F.coalesce(_raw(c, "image"), _raw(c, "image_src"))), in_stock=F.when(says(NO_STOCK), False).when(says(IN_STOCK), True),
    )
    there = page["parsed"] & _raw(c, "anchor").isNotNull()
    features = F.slice(F.split(_raw(c, "features"), "\n"), 1, 20)
    return F.struct(F.when(there, "ok").otherwise("parse_failed").alias("outcome"), F.when(there, item).alias("item"), features.alias("features"), F.from_json(_raw(c, "specs"), "map<string, string>").alias("specs"))


# --- A bazaar whose cards hang around item links

BAZAAR_CARDS = Layout(
    anchors='a[href*="/item/"], [class*="card-out-wrapper"], [class*="search-item"]',
    card='a[href*="/item/"]',
    key="url_key",
    within="[class*=card-out-wrapper]",
    seed={"url_key": "href", "own_title": "title"},
    fields={
        "title": ("h3", "text"),
        "wrapped": ("[title]", "@title"),
        "price": ('[style*="decimal_point"]:not([style*="line-through"])', "glued"),
        "old": ('[style*="line-through"]', "text"),
        "spans": ("span", "texts"),
        "whole": ("*", "texts"),
        "installments": ('[title*="juros"], [title*="parcela"]', "@title"),
        "image": ('img[src*="aliexpress-media"] || img', "@src"),
    },
)
BAZAAR_PAGE = Layout(
    anchors="*",
    card=None,
    fields={
        "og": ('meta[property="og:title"]', "@content"),
        "heading": ('h1[class*="title"] || [class*="product-title"] || h1', "text"),
        "description": ('meta[name="description"]', "@content"),
        "image": ('meta[property="og:image"]', "@content"),
        "price": ('[style*="decimal_point"]:not([style*="line-through"])', "glued"),
    },
)

def bazaar_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?i)/item/(\d+)\.html", 1), F.lit(""))


def _joined(base: Column, href: Column) -> Column:
    return F.when(href.rlike("^https?://"), href).when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(F.concat(F.regexp_extract(base, "^(https?://[^/?#]+)", 1), href))


def bazaar_listing(page: Column, url: Column) -> Column:
    """Offers of a result page (ADP05, SET02): the cards around item links, each item once."""
    known = F.filter(page["items"], lambda c: bazaar_id(_raw(c, "url_key")).isNotNull())
    ids = F.transform(known, lambda c: bazaar_id(_raw(c, "url_key")))
    once = F.filter(F.transform(known, lambda c, i: F.when(F.array_position(ids, bazaar_id(_raw(c, "url_key"))) == i + 1, c)), lambda c: c.isNotNull())

    def card(c: Column) -> Column:
        marks = F.filter(F.split(_raw(c, "spans"), "\n"), lambda s: s.rlike(r"^[0-5][.,]\d$"))
        sold = F.nullif(F.regexp_extract(_raw(c, "whole"), r"(?i)([\d.,]+\s*(?:mil|mi)?)\+?\s*vendido", 1), F.lit(""))
        cut = F.nullif(F.regexp_extract(_raw(c, "whole"), r"-\s*(\d+)\s*%", 1), F.lit("")).try_cast("int")
        return offer(
            title=F.coalesce(_raw(c, "title"), _raw(c, "wrapped"), _raw(c, "own_title")), url=_joined(url, _raw(c, "url_key")), id=bazaar_id(_raw(c, "url_key")), price=V.brl_number(_raw(c, "price")), list_price=V.brl_number(_raw(c, "old")),
            currency=F.lit("BRL"), rating=V.rating(F.get(marks, F.lit(0))), image=clean_image_url(_joined(url, _raw(c, "image"))), sold=V.magnitude_count(sold), discount=cut, installments=_raw(c, "installments"),
        )

    return answer(page["parsed"], F.transform(once, card))


REVIEWS = "struct<productEvaluationStatistic: string, evaViewList: array<struct<buyerTranslationFeedback: string, buyerFeedback: string, buyerEval: double, buyerCountry: string, evalDate: string>>>"


def bazaar_product(page: Column, url: Column, reviews: Column, most: int = 6) -> Column:
    """The item of a product page (ADP05, JON09): its number from the address, its ratings from the recorded
    answer of the review service, the rest as far as the page shows it.  An address without a number is no
    item."""
    c = F.get(page["items"], F.lit(0))
    plain = F.when(~F.lower(_raw(c, "heading")).isin("aliexpress", "você também vai gostar"), _raw(c, "heading"))
    body = F.when(F.try_parse_json(reviews).isNotNull(), reviews)
    data = F.from_json(F.get_json_object(body, "$.data"), REVIEWS)
    stat = data["productEvaluationStatistic"]
    said = F.transform(data["evaViewList"], lambda r: F.struct(F.nullif(F.trim(F.coalesce(r["buyerTranslationFeedback"], r["buyerFeedback"])), F.lit("")).alias("text"), F.round(r["buyerEval"] / 20, 1).alias("stars"), r["buyerCountry"].alias("country"), r["evalDate"].alias("date")))
    kept = F.slice(F.filter(said, lambda r: r["text"].isNotNull() | r["stars"].isNotNull()), 1, most)
    item = offer(
        title=F.coalesce(_raw(c, "og"), plain), url=url, id=bazaar_id(url), price=V.brl_number(_raw(c, "price")), currency=F.lit("BRL"), rating=_json(stat, "$.evarageStar").try_cast("double"),
        ratings=_json(stat, "$.totalNum").try_cast("long"), image=clean_image_url(_joined(url, _raw(c, "image"))),
    )
    there = bazaar_id(url).isNotNull()
    return F.struct(F.when(there, "ok").otherwise("parse_failed").alias("outcome"), F.when(there, item).alias("item"), rating_histogram(stat).alias("histogram"), kept.alias("reviews"))


# --- A pet shop with linked lists and groups of variants

PET_PAGE = Layout(
    anchors="*",
    card=None,
    fields={"specs": (".properties__list", "pairs .properties__list__name|.properties__list__value"), "bar": (".bottom-ctas-bar__single-price", "text"), "details": ("section.product-details", "text")},
)

def _pet_offer(o: Column) -> Column:
    return offer(
        title=_json(o, "$.name"), url=_json(o, "$.url", "$.offers.url"), id=_json(o, "$.sku"), price=V.dot_price(_json(o, "$.offers.price")), currency=_json(o, "$.offers.priceCurrency"), brand=_brand(o),
        image=_plain(_json(o, "$.image")), in_stock=_stock(_json(o, "$.offers.availability")),
    )


def pet_listing(page: Column, html: Column) -> Column:
    """(outcome, items, total) of a result page (ADP08): the products of its list, else single ones."""
    objects = linked_objects(html)
    listed = F.get(of_types(objects, "ItemList"), F.lit(0))
    single = of_types(objects, "Product")
    inside = of_types(F.coalesce(F.from_json(F.get_json_object(listed, "$.itemListElement"), "array<string>"), F.array().cast("array<string>")), "Product")
    raw = F.when(F.size(inside) > 0, inside).otherwise(single)
    good = F.filter(raw, lambda o: _json(o, "$.name").isNotNull() & _json(o, "$.offers.url", "$.url").isNotNull())
    total = F.coalesce(_json(listed, "$.numberOfItems").try_cast("long"), F.nullif(F.regexp_extract(_json(listed, "$.description"), r"(\d+)\s+produto", 1), F.lit("")).try_cast("long"))
    found = answer(listed.isNotNull() | (F.size(single) > 0), F.transform(good, _pet_offer))
    return F.struct(found["outcome"].alias("outcome"), found["items"].alias("items"), total.alias("total"))


def pet_product(page: Column, html: Column, url: Column, most_reviews: int = 5) -> Column:
    """The item of a product page (ADP08, AGG05): the lowest and highest price of its variants, whether one is
    in stock, its reviews, the path of its categories, and the list price the page shows."""
    return let(linked_objects(html), lambda objects: _once(lambda **found: _pet_item(F.get(page["items"], F.lit(0)), url, most_reviews, **found), **_pet_parts(objects)))


def _pet_parts(objects: Column) -> dict[str, Column]:
    """The group, the single product and the names of the categories among a page's objects."""
    first = lambda kind: F.get(of_types(objects, kind), F.lit(0))
    crumbs = F.from_json(F.get_json_object(first("BreadcrumbList"), "$.itemListElement"), "array<string>")
    return {"group": first("ProductGroup"), "single": first("Product"), "names": F.filter(F.transform(crumbs, lambda e: _json(e, "$.item.name", "$.name")), lambda n: n.isNotNull())}


def _pet_item(c: Column, url: Column, most_reviews: int, group: Column, single: Column, names: Column) -> Column:
    variants = F.transform(F.from_json(F.get_json_object(group, "$.hasVariant"), "array<string>"), _pet_offer)
    shown = F.filter(F.transform(F.regexp_extract_all(_raw(c, "bar"), F.lit(r"R\$\s*([\d.]+\s*(?:,\s*\d+)?)"), F.lit(1)), V.brl_number), lambda p: p.isNotNull())
    path = F.when(F.lower(F.get(names, F.lit(0))) == "home", F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0)))).otherwise(names)

    def read(o: Column, variants: Column, shown: Column) -> Column:
        prices = F.filter(F.transform(variants, lambda v: v["price"]), lambda p: p.isNotNull())
        own = _pet_offer(o)
        low = F.when(group.isNotNull(), F.array_min(prices)).otherwise(own["price"])
        dear = F.when((F.size(shown) >= 2) & (F.array_max(shown) > F.array_min(shown)), F.array_max(shown))
        said = F.from_json(F.get_json_object(o, "$.review"), "array<string>")
        text = lambda r: _filled(F.trim(F.regexp_replace(F.regexp_replace(_json(r, "$.description"), "<[^>]+>", " "), r"\s+", " ")))
        reviews = F.transform(F.slice(said, 1, most_reviews), lambda r: F.struct(F.coalesce(_json(r, "$.author.name"), _plain(_json(r, "$.author"))).alias("author"), _json(r, "$.reviewRating.ratingValue").try_cast("double").alias("rating"), _json(r, "$.name").alias("title"), text(r).alias("text")))
        item = offer(
            title=_json(o, "$.name"), url=F.coalesce(_json(o, "$.url"), F.when(group.isNull(), _json(o, "$.offers.url")), url), id=_json(o, "$.productGroupID", "$.productID", "$.sku"), price=low, list_price=dear, brand=_brand(o),
            currency=F.coalesce(F.get(F.filter(F.transform(variants, lambda v: v["currency"]), lambda x: x.isNotNull()), F.lit(0)), own["currency"]), rating=F.round(_json(o, "$.aggregateRating.ratingValue").try_cast("double"), 2),
            ratings=_json(o, "$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount").try_cast("long"), image=F.coalesce(F.get(F.filter(F.transform(variants, lambda v: v["image"]), lambda x: x.isNotNull()), F.lit(0)), own["image"]),
            in_stock=F.when(group.isNotNull(), F.exists(variants, lambda v: F.coalesce(v["in_stock"], F.lit(False)))).otherwise(own["in_stock"]),
        )
        there = o.isNotNull()
        return F.struct(
            F.when(there, "ok").otherwise("parse_failed").alias("outcome"), F.when(there, item).alias("item"), F.when(F.array_max(prices) != F.array_min(prices), F.array_max(prices)).alias("price_max"),
            _filled(F.array_join(path, " > ")).alias("category"), reviews.alias("reviews"), F.from_json(_raw(c, "specs"), "map<string, string>").alias("specs"), F.size(F.coalesce(variants, F.array().cast(f"array<struct<{', '.join(f'{k}: {v}' for k, v in FIELDS.items())}>>"))).alias("n_variants"),
        )

    return _once(read, o=F.coalesce(group, single), variants=variants, shown=shown)


PARSERS = {
    "market_listing": (MARKET_CARDS, market_listing, ("html",)),
    "market_product": (MARKET_PAGE, market_product, ("html", "url")),
    "store_listing": (STORE_CARDS, store_listing, ("url",)),
    "store_product": (STORE_PAGE, store_product, ("url",)),
    "bazaar_listing": (BAZAAR_CARDS, bazaar_listing, ("url",)),
    "bazaar_product": (BAZAAR_PAGE, bazaar_product, ("url", "reviews")),
    "pet_listing": (PET_PAGE, pet_listing, ("html",)),
    "pet_product": (PET_PAGE, pet_product, ("html", "url")),
}


def parse_pages(rows: DataFrame, kind: str, name: str = "found") -> DataFrame:
    """``rows`` (``html``, and ``url`` or ``reviews`` where the kind needs them) with what their pages hold."""
    layout, parser, needs = PARSERS[kind]
    read = rows.withColumn("_page", page_items(layout)(F.col("html")))
    return read.withColumn(name, parser(F.col("_page"), *[F.col(n) for n in needs])).drop("_page")
