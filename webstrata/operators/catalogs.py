"""Records out of stores' and registries' JSON answers, and their side answers joined on (ADP06, ADP07, ADP09, ADP10, ADP11, ADP12, ADP13, ADP14, ADP16, ADP17, JON08, JON09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import values as V
from webstrata.functions.urls import clean_product_url, host_of, part
from webstrata.operators.merge import without_outliers
from webstrata.operators.payloads import app_records, linked_objects, of_type, product_fields


def _valid(body: Column) -> Column:
    return F.when(F.try_parse_json(body).isNotNull(), body)


_VARIANT = "array<struct<id: bigint, title: string, sku: string, price: string, compare_at_price: string, available: boolean>>"
_CARD = f"struct<id: bigint, title: string, handle: string, url: string, vendor: string, type: string, product_type: string, price: string, compare_at_price: string, available: boolean, variants: {_VARIANT}>"


def _card(p: Column, origin: Column) -> Column:
    """A product of a store's answer whose prices are decimal texts."""
    priced = F.filter(F.transform(p["variants"], lambda v: F.struct(V.dot_price(v["price"]).alias("price"), V.dot_price(v["compare_at_price"]).alias("was"))), lambda v: v["price"].isNotNull())
    own = V.dot_price(p["price"])
    price = F.coalesce(own, F.array_min(priced)["price"])
    was = F.when(own.isNotNull(), V.dot_price(p["compare_at_price"])).otherwise(F.array_min(priced)["was"])
    by_handle = F.concat(origin, F.lit("/products/"), F.nullif(p["handle"], F.lit("")))
    return F.struct(
        F.trim(p["title"]).alias("title"), F.coalesce(clean_product_url(F.nullif(p["url"], F.lit("")), origin), by_handle).alias("url"), p["id"].cast("string").alias("id"), price.alias("price"), V.list_price(price, was).alias("list_price"),
        p["vendor"].alias("brand"), F.coalesce(F.nullif(p["type"], F.lit("")), p["product_type"]).alias("type"), F.coalesce(p["available"], F.when(F.size(p["variants"]) > 0, F.exists(p["variants"], lambda v: F.coalesce(v["available"], F.lit(False))))).alias("in_stock"),
        F.size(p["variants"]).alias("n_variants"),
    )


def store_answer(body: Column, kind: Column, origin: Column) -> Column:
    """(outcome, items) of a store's product, collection or suggest answer (ADP09)."""
    text = _valid(body)
    one = F.from_json(F.get_json_object(text, "$.product"), _CARD)
    single = F.when(one["id"].isNotNull() | one["variants"].isNotNull(), F.array(one))
    at = F.when(kind == "collection", F.get_json_object(text, "$.products")).when(kind == "suggest", F.get_json_object(text, "$.resources.results.products"))
    listed = F.from_json(F.when(at.startswith("["), at), f"array<{_CARD}>")
    found = F.when(kind == "product", single).otherwise(listed)
    items = F.transform(F.filter(found, lambda p: F.trim(p["title"]) != ""), lambda p: _card(p, origin))
    outcome = F.when(found.isNull(), "parse_failed").when(F.size(items) > 0, "ok").otherwise("no_results")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", items).alias("items"))


def cart_currency(body: Column) -> Column:
    """The currency a store's cart names, or null (ADP09)."""
    return F.nullif(F.get_json_object(_valid(body), "$.currency"), F.lit(""))


def game_search(body: Column) -> Column:
    """(outcome, items) of a game store's search answer (ADP12)."""
    listed = F.get_json_object(_valid(body), "$.items")
    raw = F.from_json(listed, "array<struct<type: string, id: bigint, name: string, price: struct<currency: string, final: bigint>, metascore: string, platforms: struct<windows: boolean, mac: boolean, linux: boolean>>>")
    kept = F.filter(raw, lambda i: i["id"].isNotNull() & (F.trim(i["name"]) != ""))
    systems = lambda p: F.array_compact(F.array(*[F.when(p[n], n) for n in ("windows", "mac", "linux")]))
    items = F.transform(kept, lambda i, k: F.struct((k + 1).alias("position"), i["id"].cast("string").alias("app_id"), F.trim(i["name"]).alias("title"), i["type"].alias("type"), V.cents(i["price"]["final"]).alias("price"), i["price"]["currency"].alias("currency"), i["metascore"].try_cast("int").alias("score"), systems(i["platforms"]).alias("platforms")))
    outcome = F.when(~F.coalesce(listed.startswith("["), F.lit(False)), "parse_failed").when(F.size(items) > 0, "ok").otherwise("no_results")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", items).alias("items"))


def review_summary(body: Column) -> Column:
    """Verdict and totals of a game's review answer (ADP12)."""
    s = F.from_json(F.get_json_object(_valid(body), "$.query_summary"), "struct<review_score: int, review_score_desc: string, total_positive: bigint, total_negative: bigint, total_reviews: bigint>")
    return F.when(s["total_reviews"].isNotNull() | s["review_score_desc"].isNotNull(), s)


def player_count(body: Column) -> Column:
    r = F.from_json(F.get_json_object(_valid(body), "$.response"), "struct<player_count: bigint, result: int>")
    return F.when(r["result"] == 1, r["player_count"])


_DEAL = "struct<price: struct<amount: double, currency: string>, regular: struct<amount: double>, cut: int, timestamp: string>"


def historical_low(body: Column) -> Column:
    """The lowest deal of a price service's answer (ADP13), or null."""
    d = F.from_json(F.get_json_object(_valid(body), "$[0].lows[0]"), _DEAL)
    return F.when(
        d["price"]["amount"].isNotNull(),
        F.struct(F.round(d["price"]["amount"], 2).alias("price"), d["price"]["currency"].alias("currency"), d["cut"].alias("cut"), F.round(d["regular"]["amount"], 2).alias("regular_price"), F.substring(d["timestamp"], 1, 10).alias("date")),
    )


def enriched_apps(apps: DataFrame, reviews: DataFrame, players: DataFrame, lows: DataFrame) -> DataFrame:
    """Game records with the reviews, players and lowest price that other services know (JON08): each side is
    joined where it has the app, and its absence costs nothing.  ``apps`` are recorded answers, the others
    (app_id, body) with one row per app."""
    x = app_records(apps)
    for side, name, read in ((reviews, "reviews", review_summary), (players, "players", player_count), (lows, "historical_low", historical_low)):
        x = x.join(side.select("app_id", read(F.col("body")).alias(name)), "app_id", "left")
    return x


def project_record(body: Column) -> Column:
    """A project of a forge (ADP14), or null where the body is none."""
    get = lambda p: F.nullif(F.trim(F.get_json_object(_valid(body), p)), F.lit(""))
    topics = F.from_json(F.coalesce(get("$.topics"), get("$.tag_list")), "array<string>")
    return F.when(
        get("$.id").isNotNull() & get("$.path_with_namespace").isNotNull(),
        F.struct(
            get("$.id").try_cast("long").alias("id"), get("$.path_with_namespace").alias("path"), get("$.description").alias("description"), get("$.default_branch").alias("default_branch"), get("$.visibility").alias("visibility"),
            get("$.star_count").try_cast("long").alias("stars"), get("$.open_issues_count").try_cast("long").alias("open_issues"), topics.alias("topics"), get("$.license.name").alias("license"), get("$.archived").try_cast("boolean").alias("archived"),
        ),
    )


def absolute_readme(readme: Column, full_name: Column, branch: Column) -> Column:
    """A README whose relative links lead to the repository's files (ADP16); addresses, anchors and rooted
    paths stay."""
    marked = F.regexp_replace(F.trim(readme), r"(\]\()(?![a-zA-Z][a-zA-Z0-9+.-]*:|#|/)([^)\s]+)", "$1\u0001$2")
    return F.replace(marked, F.lit("\u0001"), F.concat(F.lit("https://github.com/"), full_name, F.lit("/blob/"), F.coalesce(F.nullif(branch, F.lit("")), F.lit("HEAD")), F.lit("/")))


def weekly_downloads(status: Column, body: Column) -> Column:
    """The count of a registry's download answer, null unless it succeeded (ADP17, JON09)."""
    return F.when(status == 200, F.get_json_object(_valid(body), "$.downloads").try_cast("long"))


# Marks of promotions in shopping labels, and label parts that are no store.
BADGES = {"PROMOÇÃO": "promo", "REDUÇÃO NO PREÇO": "price_drop", "PREÇO BAIXO": "low_price"}
NO_STORE = ["R$", "Preço atual", "parcelas", "Avaliado", "avaliações", "Devolução", "Custava", *BADGES]
ABROAD, STORE_CHARS = "Preço no exterior:", 80
USED = r"\.\s*(?:Usado|Recondicionado)\."


def label_kind(label: Column) -> Column:
    """offer, used, international or other: what a shopping label is of (ADP06)."""
    shaped = label.rlike(r"(?s)^.+?\.\s{2,}") & label.rlike(r"R\$\s*[\d.,]+")
    return F.when(label.rlike(USED), "used").when(label.contains(ABROAD), "international").when(shaped, "offer").otherwise("other")


def label_offer(label: Column) -> Column:
    """Title, price, former price, rating, reviews, store and badges of a label of the kind offer (ADP06)."""
    title = F.trim(F.regexp_extract(label, r"(?s)^(.+?)\.\s{2,}", 1))
    for badge in BADGES:
        title = F.when(title.startswith(badge), F.trim(F.substr(title, F.lit(len(badge) + 1)))).otherwise(title)
    number = lambda pattern: V.brl_number(F.nullif(F.regexp_replace(F.regexp_extract(label, pattern, 1), r"[.,]+$", ""), F.lit("")))
    price, was = number(r"(?:Preço atual: )?R\$\s*([\d.,]+)"), number(r"Custava R\$\s*([\d.,]+)")
    segments = F.filter(F.transform(F.split(label, r"\.\s+"), lambda s: F.regexp_replace(F.trim(s), r"\.+$", "")), lambda s: s != "")
    free = F.filter(segments, lambda s: ~F.exists(F.array(*map(F.lit, NO_STORE)), lambda m: F.contains(s, m)) & (s != title))
    stores = F.filter(F.transform(free, lambda s: F.struct(F.trim(F.regexp_replace(s, r"\s+e mais$", "")).alias("name"), s.contains(" e mais").alias("more"))), lambda s: (s["name"] != "") & (F.length(s["name"]) < STORE_CHARS))
    reviews = F.nullif(F.regexp_extract(label, r"([\d.,]+\s*(?:mil)?)\s*avaliações", 1), F.lit(""))
    return F.when(
        (label_kind(label) == "offer") & (title != "") & price.isNotNull(),
        F.struct(
            title.alias("title"), price.alias("price"), V.list_price(price, was).alias("was"), V.discount_percent(price, was).alias("discount"), V.rating(F.nullif(F.regexp_extract(label, r"Avaliado com (\d[,.]\d)\s+de\s+5", 1), F.lit(""))).alias("rating"),
            V.magnitude_count(reviews).alias("reviews"), F.get(stores, F.lit(0))["name"].alias("store"), F.get(stores, F.lit(0))["more"].alias("other_stores"), F.array_compact(F.array(*[F.when(label.contains(k), v) for k, v in BADGES.items()])).alias("badges"),
        ),
    )


def page_offers(labels: DataFrame, page: str, place: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(offers, counts) of result pages (ADP06, AGG04, AGG08): offers of each page in order, outliers out, and
    how many labels were left out for which reason, zeros omitted."""
    x = labels.select(page, place, label_kind(F.col(label)).alias("kind"), label_offer(F.col(label)).alias("o"))
    offers = x.where("o IS NOT NULL").select(page, place, "o.*")
    kept = without_outliers(offers, [page], "price")
    other = x.where(F.col("kind").isin("used", "international")).groupBy(page, F.col("kind").alias("reason")).agg(F.count("*").alias("n"))
    sizes = offers.groupBy(page).agg(F.count("*").alias("all")).join(kept.groupBy(page).agg(F.count("*").alias("kept")), page, "left")
    outliers = sizes.select(page, F.lit("outlier").alias("reason"), (F.col("all") - F.coalesce("kept", F.lit(0))).alias("n")).where("n > 0")
    return kept, other.unionByName(outliers)


def marketplace_item(html: Column) -> Column:
    """The product of a marketplace page with its seller (ADP07).  A page with the site's own record only is
    the shell that unknown visitors get."""
    objects = linked_objects(html)
    item = of_type(objects, "Product")
    seller = F.get_json_object(item, "$.offers.seller")
    name = F.nullif(F.trim(F.get_json_object(seller, "$.name")), F.lit(""))
    of_seller = F.when(name.isNotNull(), F.struct(name.alias("name"), F.get_json_object(seller, "$.aggregateRating.ratingValue").try_cast("double").alias("rating"), F.get_json_object(seller, "$.aggregateRating.ratingCount").try_cast("long").alias("ratings")))
    shell = item.isNull() & of_type(objects, "WebSite").isNotNull()
    return F.struct(F.when(item.isNotNull(), "ok").otherwise("parse_failed").alias("outcome"), shell.alias("logged_out"), F.when(item.isNotNull(), product_fields(item)).alias("item"), of_seller.alias("seller"))


# The first path parts of a classifieds site's two verticals.
VERTICALS = ["imoveis", "autos-e-pecas"]


def is_category_hub(url: Column) -> Column:
    """Whether an address is a vertical's landing page, which lists nothing (ADP10): the vertical alone, or
    with a state."""
    segments = F.filter(F.split(F.lower(part(url, "path")), "/"), lambda s: s != "")
    rest = F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1)))
    alone = (F.size(rest) == 0) | ((F.size(rest) == 1) & F.get(rest, F.lit(0)).rlike(r"^estado-[a-z]{2}$"))
    return F.coalesce(host_of(url).isin("www.olx.com.br", "olx.com.br") & F.get(segments, F.lit(0)).isin(*VERTICALS) & alone, F.lit(False))


def estate_details(name: Column, description: Column) -> Column:
    """Rooms, baths, parking, area, quarter and city read off an estate's name and description (ADP11)."""
    grab = lambda text, pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return F.struct(
        grab(description, r"(?i)(\d+)\s*dormit").try_cast("int").alias("bedrooms"), grab(description, r"(?i)(\d+)\s*(?:total de\s*)?banheiro").try_cast("int").alias("bathrooms"),
        F.coalesce(grab(description, r"(?i)(\d+)\s*(?:garagem|vaga)"), grab(name, r"(?i)(\d+)\s*vaga")).try_cast("int").alias("parking"), V.first_int(grab(description, r"(?i)constru[ií]da\s*([\d.,]+)")).alias("area"),
        grab(name, r"\bem ([^,]+),").alias("neighborhood"), grab(name, r",\s*([^,\-]+?)\s*-\s*[A-Z]{2}").alias("city"),
    )
