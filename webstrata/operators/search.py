"""Result lists of search backends, and records read off their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.functions import values as V

# Language and country spellings that search backends expect.
REGION_ALIASES = {"pt-br": "br-pt", "en-us": "us-en", "en-gb": "uk-en"}
COUNTRY_ALIASES = {"uk": "GB"}
COUNTRIES = "AR AU AT BE BR CA CL DK FI FR DE GR HK IN ID IT JP KR MY MX NL NZ NO CN PL PT PH RU SA ZA ES SE CH TW TR GB US".split()
AD_HOSTS = r"^https?://(?:[^/]*\.)?(?:duckduckgo\.com/y\.js|googleadservices\.com|doubleclick\.net)"


def canonical_region(region: Column) -> Column:
    """Trimmed, lower case, country before language (SRC04)."""
    bare = F.lower(F.trim(region))
    out = bare
    for a, b in REGION_ALIASES.items():
        out = F.when(bare == a, b).otherwise(out)
    return out


def region_params(region: Column) -> Column:
    """(country, language) of a canonical region; an unknown country is ``ALL`` (SRC05)."""
    country = F.upper(F.substring_index(region, "-", 1))
    for a, b in COUNTRY_ALIASES.items():
        country = F.when(country == a.upper(), b).otherwise(country)
    language = F.when(region.contains("-"), F.substring_index(region, "-", -1))
    return F.struct(F.when(country.isin(*COUNTRIES), country).otherwise("ALL").alias("country"), language.alias("language"))


def kept_results(rows: DataFrame, query: str, place: str, most: int) -> DataFrame:
    """The first ``most`` results of each query that have an address and are no ad (SRC01), renumbered."""
    clean = rows.where(F.col("url").isNotNull() & (F.trim("url") != "") & ~F.col("url").rlike(AD_HOSTS) & ~F.col("url").startswith(AD_LINK))
    w = W.partitionBy(query).orderBy(place)
    return clean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


LABEL = r"(?i)^(.*?)\.?\s+(?:Preço atual:\s*|Current price:\s*)?(R\$\s?[\d.]+(?:,\d{2})?)(?:\.\s*(?:Era|Was)\s*(R\$\s?[\d.]+(?:,\d{2})?))?\.\s*(?:De|From)\s+(.+?)\.?$"


def offer_label(label: Column) -> Column:
    """Title, price, former price, discount and store read off a shopping label (ADP06); null fields
    where the label has another shape."""
    title, price, was, store = (F.nullif(F.trim(F.regexp_extract(label, LABEL, i)), F.lit("")) for i in range(1, 5))
    now, before = V.brl_number(price), V.brl_number(was)
    return F.struct(title.alias("title"), now.alias("price"), V.list_price(now, before).alias("was"), V.discount_percent(now, before).alias("discount"), store.alias("store"))


def price_history(body: Column, most: int) -> Column:
    """(ts, price) of a price log in JSON, newest first, entries without a deal dropped (ADP13, SRT01)."""
    items = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "array<struct<timestamp: string, deal: struct<price: struct<amount: double>, cut: int>>>")
    kept = F.filter(items, lambda x: x["deal"].isNotNull())
    placed = F.transform(kept, lambda x: F.struct(x["timestamp"].alias("ts"), x["deal"]["price"]["amount"].alias("price"), x["deal"]["cut"].alias("cut")))
    return F.slice(F.sort_array(placed, asc=False), 1, most)


STORE = "struct<title: string, handle: string, vendor: string, type: string, available: boolean, price_min: bigint, variants: array<struct<id: bigint, price: bigint, compare_at_price: bigint, available: boolean>>>"


def store_product(body: Column) -> Column:
    """A product of a store's JSON (ADP09): prices in cents, list price of the cheapest variant (ARR04)."""
    p = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), STORE)
    best = V.cheapest(p["variants"], "price")
    price = V.cents(F.coalesce(best["price"], p["price_min"]))
    return F.when(
        p["title"].isNotNull() & p["handle"].isNotNull(),
        F.struct(
            p["title"].alias("title"), p["handle"].alias("handle"), F.nullif(p["vendor"], F.lit("")).alias("brand"), price.alias("price"),
            V.list_price(price, V.cents(best["compare_at_price"])).alias("list_price"),
            F.coalesce(F.exists(p["variants"], lambda v: v["available"]), p["available"]).alias("in_stock"), F.size(p["variants"]).alias("n_variants"),
        ),
    )


def video_rows(body: Column, most: int) -> Column:
    """Entries of a channel listing in JSON (ADP20): id, title, length as a clock, date."""
    entries = F.from_json(F.get_json_object(F.when(F.try_parse_json(body).isNotNull(), body), "$.entries"), "array<struct<id: string, title: string, duration: double, upload_date: string>>")
    kept = F.filter(entries, lambda e: e["id"].isNotNull())
    return F.slice(F.transform(kept, lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"), V.clock(e["duration"]).alias("length"), V.compact_date(e["upload_date"]).alias("date"))), 1, most)


def numbered_lines(items: Column, title: str, detail: str) -> Column:
    """Records as numbered markdown lines (ADP22); nulls leave no trace."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(x[title], F.lit("?")), F.coalesce(F.concat(F.lit(" – "), x[detail].cast("string")), F.lit("")))
    return F.array_join(F.transform(items, line), "\n")


def paper_claim(url: Column) -> Column:
    """(kind, id) of a scholarly address (ADP19, URL20): DOI, PubMed, PMC, arXiv; null for others."""
    d = V.doi(url)
    pmid = F.regexp_extract(url, r"^https?://pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1)
    pmc = F.upper(F.regexp_extract(url, r"(?i)/(PMC\d+)", 1))
    arxiv = F.regexp_extract(url, r"^https?://arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,5})", 1)
    kind = F.when(pmid != "", "pmid").when(pmc != "", "pmcid").when(arxiv != "", "arxiv").when(d.isNotNull(), "doi")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "doi", d).when(kind == "pmid", pmid).when(kind == "pmcid", pmc).otherwise(arxiv).alias("id")))


# What a search service takes: at most so many rows, and its names of periods; rows asked for in
# excess where ads are dropped; the start of ad links.
MOST_ROWS, EXTRA_ROWS = 20, 5
PERIODS = {"d": "pd", "w": "pw", "m": "pm", "y": "py"}
AD_LINK = "https://www.bing.com/aclick?"


def search_request(query: Column, most: Column, region: Column, period: Column, site: Column) -> Column:
    """(text, rows, count, freshness, country, language) to ask search services with (SRC01, SRC02): a site
    goes before the words, ``rows`` allows for ads, ``count`` is bounded, an unknown period goes as it is."""
    names = F.create_map(*[F.lit(x) for p in PERIODS.items() for x in p])
    params = region_params(canonical_region(region))
    return F.struct(
        F.when(F.coalesce(site, F.lit("")) != "", F.concat(F.lit("site:"), site, F.lit(" "), query)).otherwise(query).alias("text"), (most + EXTRA_ROWS).alias("rows"), F.least(most, F.lit(MOST_ROWS)).alias("count"),
        F.coalesce(F.try_element_at(names, period), period).alias("freshness"), params["country"].alias("country"), params["language"].alias("language"),
    )
