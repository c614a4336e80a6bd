"""Records out of JSON payloads: one input row, any number of records.

Every parser keeps the difference between a payload of the wrong shape (``parsed`` false) and one that
is right but empty.  Damaged JSON is never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import values as V

APP = "success BOOLEAN, data STRUCT<type: STRING, name: STRING, is_free: BOOLEAN, short_description: STRING, developers: ARRAY<STRING>, price_overview: STRUCT<currency: STRING, initial: LONG, final: LONG>, platforms: STRUCT<windows: BOOLEAN, mac: BOOLEAN, linux: BOOLEAN>, metacritic: STRUCT<score: INT>, genres: ARRAY<STRUCT<description: STRING>>, release_date: STRUCT<coming_soon: BOOLEAN, date: STRING>>"


def app_records(rows: DataFrame, body: str = "body") -> DataFrame:
    """One record per app of each body (ADP12): outcome, prices in units, flags and lists."""
    whole = F.try_parse_json(body)
    apps = F.from_json(F.when(whole.isNotNull(), F.col(body)), f"MAP<STRING, STRUCT<{APP.replace(' BOOLEAN', ': BOOLEAN', 1).replace(' STRUCT', ': STRUCT', 1)}>>")
    x = rows.select("response_id", F.explode(apps).alias("app_id", "app"))
    d = F.col("app.data")
    return x.select(
        "response_id",
        "app_id",
        F.when(F.col("app.success") & d["name"].isNotNull(), "ok").when(~F.coalesce("app.success", F.lit(False)), "not_found").otherwise("parse_failed").alias("outcome"),
        d["name"].alias("name"),
        d["type"].alias("type"),
        d["is_free"].alias("is_free"),
        d["price_overview"]["currency"].alias("currency"),
        V.cents(d["price_overview"]["final"]).alias("price"),
        V.list_price(V.cents(d["price_overview"]["final"]), V.cents(d["price_overview"]["initial"])).alias("list_price"),
        V.discount_percent(d["price_overview"]["final"].cast("double"), d["price_overview"]["initial"].cast("double")).alias("discount"),
        F.array_join(V.first_distinct(d["developers"], 2), "; ").alias("developers"),
        F.array_join(V.first_distinct(F.transform(d["genres"], lambda g: g["description"]), 3), "; ").alias("genres"),
        d["metacritic"]["score"].alias("score"),
        d["release_date"]["coming_soon"].alias("coming_soon"),
    )


def paper_records(rows: DataFrame) -> DataFrame:
    """Fields of each Crossref answer (ADP18): first title, authors, date, licence of the best version."""
    m = F.col("message")
    name = lambda a: F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"])
    authors = F.filter(F.transform(m["author"], name), lambda x: x.isNotNull())
    order = F.array(F.lit("vor"), F.lit("am"), F.lit("tdm"))
    licences = F.filter(m["license"], lambda x: x["URL"].isNotNull())
    ranked = F.transform(licences, lambda x, i: F.struct(F.when(F.array_position(order, x["content-version"]) > 0, F.array_position(order, x["content-version"])).otherwise(9).alias("r"), i.alias("i"), x["URL"].alias("url")))
    return rows.select(
        "response_id",
        m.isNotNull().alias("parsed"),
        F.lower(m["DOI"]).alias("doi"),
        V.first_filled(F.get(m["title"], F.lit(0))).alias("title"),
        V.first_filled(F.get(m["container-title"], F.lit(0))).alias("journal"),
        F.array_join(F.slice(authors, 1, 3), "; ").alias("authors"),
        F.size(authors).alias("n_authors"),
        V.date_parts(F.get(m["issued"]["date-parts"], F.lit(0))).alias("issued"),
        F.array_min(ranked)["url"].alias("license"),
    )


def title_words(inverted: Column) -> Column:
    """Text of an inverted index ``{word: [places]}`` (TXT27), in order of place."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def cue_lines(vtt: Column) -> Column:
    """(start, text) of each cue of a caption file (TXT23, TXT24): cues with inline tags dropped, a line
    that repeats the one before left out."""
    blocks = F.split(F.replace(vtt, F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")
    timed = F.filter(blocks, lambda b: b.contains("-->") & ~b.rlike(r"(?s)-->[^\n]*\n.*<[^>]+>"))
    clock = r"(?:(\d+):)?(\d{2}):(\d{2}\.\d{3})\s+-->"
    cues = F.transform(
        timed,
        lambda b: F.struct(
            (F.coalesce(F.nullif(F.regexp_extract(b, clock, 1), F.lit("")).try_cast("double"), F.lit(0.0)) * 3600 + F.regexp_extract(b, clock, 2).try_cast("double") * 60 + F.regexp_extract(b, clock, 3).try_cast("double")).alias("start"),
            F.trim(F.regexp_replace(F.regexp_extract(b, r"(?s)-->[^\n]*\n(.*)", 1), r"\s+", " ")).alias("text"),
        ),
    )
    kept = F.filter(cues, lambda c: c["text"] != "")
    return F.filter(F.transform(kept, lambda c, i: F.when((i == 0) | (F.get(kept, i - 1)["text"] != c["text"]), c)), lambda c: c.isNotNull())


def attributes(pairs: Column) -> Column:
    """A list of (name, value) pairs as a map of lower-case names, the first value of a name winning (JSN05)."""
    named = F.filter(pairs, lambda p: p["name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda p: F.lower(p["name"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(named, lambda p: F.lower(p["name"]) == n), F.lit(0))["value"]))


def breadcrumb(names: Column, home: str = "Home") -> Column:
    """Names joined by `` > ``, the start page and the last name dropped (JSN06)."""
    kept = F.filter(names, lambda x: x.isNotNull() & (x != home))
    return F.array_join(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), " > ")


OBJECTS = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'


def linked_objects(html: Column) -> Column:
    """JSON-LD objects of a page as strings (JSN01): lists and ``@graph`` flattened, bad JSON skipped."""
    bodies = F.regexp_extract_all(html, F.lit(OBJECTS), F.lit(1))

    def items(text: Column) -> Column:
        v = F.try_parse_json(text)
        listed = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>")
        graph = F.from_json(F.get_json_object(text, "$.@graph"), "array<string>")
        return F.when(v.isNull(), F.array().cast("array<string>")).when(listed.isNotNull(), listed).when(graph.isNotNull(), graph).otherwise(F.array(text))

    return F.flatten(F.transform(bodies, items))


def of_type(objects: Column, kind: str) -> Column:
    """The first object of a schema.org type, or null (JSN02)."""
    return F.get(F.filter(objects, lambda o: F.get_json_object(o, "$.@type") == kind), F.lit(0))


def product_fields(o: Column) -> Column:
    """Name, brand, price, condition, stock and rating of a Product object (JSN03)."""
    get = lambda p: F.get_json_object(o, p)
    brand = F.coalesce(get("$.brand.name"), F.when(~F.coalesce(get("$.brand"), F.lit("")).startswith("{"), get("$.brand")))
    condition = F.lower(get("$.offers.itemCondition"))
    stock = F.lower(get("$.offers.availability"))
    return F.struct(
        get("$.name").alias("name"),
        F.nullif(F.trim(brand), F.lit("")).alias("brand"),
        F.coalesce(get("$.offers.price"), get("$.offers.lowPrice")).try_cast("double").alias("price"),
        F.when(condition.contains("new"), "new").when(condition.contains("refurb"), "refurbished").when(condition.contains("used") | condition.contains("damaged"), "used").alias("condition"),
        F.when(stock.contains("outofstock"), False).when(stock.contains("instock"), True).alias("in_stock"),
        get("$.aggregateRating.ratingValue").try_cast("double").alias("rating"),
        get("$.aggregateRating.ratingCount").try_cast("long").alias("ratings"),
    )


def repository_record(body: Column) -> Column:
    """A code repository (ADP16), or null where the body is none."""
    get = lambda p: F.get_json_object(body, p)
    spdx = get("$.license.spdx_id")
    return F.when(
        F.try_parse_json(body).isNotNull() & get("$.full_name").isNotNull(),
        F.struct(
            get("$.full_name").alias("full_name"),
            F.nullif(get("$.description"), F.lit("")).alias("description"),
            get("$.stargazers_count").try_cast("long").alias("stars"),
            F.when(F.coalesce(spdx, F.lit("")).isin("", "NOASSERTION"), get("$.license.name")).otherwise(spdx).alias("license"),
            F.from_json(get("$.topics"), "array<string>").alias("topics"),
            F.coalesce(get("$.archived").try_cast("boolean"), F.lit(False)).alias("archived"),
        ),
    )


def thread_record(body: Column) -> Column:
    """An issue or merge request of a forge (ADP14), or null where the body is none."""
    get = lambda p: F.nullif(F.trim(F.get_json_object(body, p)), F.lit(""))
    return F.when(
        F.try_parse_json(body).isNotNull() & get("$.iid").isNotNull() & get("$.title").isNotNull(),
        F.struct(
            get("$.iid").try_cast("long").alias("iid"), get("$.title").alias("title"), get("$.state").alias("state"), get("$.author.username").alias("author"),
            F.from_json(get("$.labels"), "array<string>").alias("labels"), get("$.source_branch").alias("source_branch"), get("$.target_branch").alias("target_branch"),
        ),
    )


def thread_notes(body: Column, limit: int) -> Column:
    """The first comments of a thread, system notes and empty ones left out; none for other bodies."""
    notes = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), "array<struct<body: string, system: boolean, created_at: string, author: struct<username: string>>>")
    kept = F.filter(notes, lambda n: ~F.coalesce(n["system"], F.lit(False)) & (F.trim(F.coalesce(n["body"], F.lit(""))) != ""))
    return F.coalesce(F.slice(kept, 1, limit), F.array().cast(kept_type()))


def kept_type() -> str:
    return "array<struct<body: string, system: boolean, created_at: string, author: struct<username: string>>>"


def package_record(body: Column, version: Column) -> Column:
    """A package of a registry document (ADP17) at ``version``, the latest where it is null; null for an
    unknown version or another body."""
    get = lambda p: F.get_json_object(body, p)
    versions = F.from_json(get("$.versions"), "map<string, struct<description: string, license: string, repository: string, dependencies: map<string, string>, deprecated: string>>")
    chosen = F.coalesce(version, get('$["dist-tags"].latest'), get("$['dist-tags'].latest"))
    info = F.try_element_at(versions, chosen)
    return F.when(
        get("$.name").isNotNull() & info.isNotNull(),
        F.struct(
            get("$.name").alias("name"),
            chosen.alias("version"),
            F.coalesce(info["description"], get("$.description")).alias("description"),
            F.coalesce(info["license"], get("$.license.type"), get("$.license")).alias("license"),
            V.repository_url(F.coalesce(get("$.repository.url"), get("$.repository"))).alias("repository"),
            F.coalesce(F.array_sort(F.map_keys(info["dependencies"])), F.array().cast("array<string>")).alias("dependencies"),
            F.size(versions).alias("version_count"),
            info["deprecated"].alias("deprecated"),
        ),
    )


STARS = {5: "fiveStarNum", 4: "fourStarNum", 3: "threeStarNum", 2: "twoStarNum", 1: "oneStarNum"}


def rating_histogram(statistic: Column) -> Column:
    """Stars to counts of a rating statistic in JSON (AGG06); stars without a number are left out."""
    counts = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object(statistic, f"$.{name}").try_cast("long").alias("value")) for k, name in STARS.items()])
    return F.map_from_entries(F.filter(counts, lambda x: x["value"].isNotNull()))
