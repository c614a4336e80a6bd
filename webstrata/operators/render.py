"""Records as markdown (ADP22), and the quality fields of articles (ADP21).  Parts that are null leave no trace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions import values as V


def _joined(glue: str, *parts: Column) -> Column:
    """The parts that are given, joined; null where none is."""
    return F.nullif(F.concat_ws(glue, *parts), F.lit(""))


def _number(x: Column) -> Column:
    """A number as short as it can be written."""
    return F.regexp_replace(x.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")


def _blocks(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def price_label(price: Column, currency: Column) -> Column:
    """A price with its currency; Brazilian and unknown ones as they are written there."""
    return F.when((currency == "BRL") | price.isNull() | currency.isNull(), V.brl_label(price)).when(currency == "USD", F.concat(F.lit("$"), F.format_number(price, 2))).otherwise(F.concat_ws(" ", currency, F.format_number(price, 2)))


def offers_markdown(items: Column, name: Column, counted: bool = True) -> Column:
    """Offers (``operators.shops``) as a numbered list."""
    def line(p: Column, i: Column) -> Column:
        rating = F.concat(_number(p["rating"]), F.lit("/5"), F.coalesce(F.concat(F.lit(" ("), p["ratings"].cast("string"), F.lit(")")), F.lit("")))
        extras = _joined(
            " · ", F.when(p["list_price"].isNotNull(), F.concat(F.lit("de "), price_label(p["list_price"], p["currency"]))), rating, p["brand"], p["seller"], F.concat(p["sold"].cast("string"), F.lit(" vendidos")), F.when(p["free_shipping"], "frete grátis"),
        )
        head = F.concat((i + 1).cast("string"), F.lit(". **"), F.coalesce(p["title"], F.lit("?")), F.lit("** — "), price_label(p["price"], p["currency"]))
        return F.concat_ws(" — ", head, extras)

    listed = F.array_join(F.transform(items, line), "\n")
    count = F.concat(F.size(items).cast("string"), F.lit(" produtos\n\n")) if counted else F.lit("")
    return F.when(F.size(items) > 0, F.concat(count, listed)).otherwise(F.concat(F.lit("# "), name, F.lit("\n\nNenhum produto encontrado.")))


def groups_markdown(groups: Column, query: Column) -> Column:
    """Groups of offers (title, price_min, price_max, sellers, rating, reviews) as a numbered list."""
    money = lambda x: F.concat(F.lit("R$ "), F.translate(F.format_number(x, 2), ",.", "*,"))
    plain = lambda x: F.replace(money(x), F.lit("*"), F.lit(""))

    def line(g: Column, i: Column) -> Column:
        names = F.filter(F.transform(g["sellers"], lambda s: s["store"]), lambda s: s != "")
        sellers = F.when(F.size(names) > 0, F.concat(F.size(g["sellers"]).cast("string"), F.lit(" sellers: "), F.array_join(names, ", ")))
        rating = F.concat(_number(g["rating"]), F.lit("/5"), F.coalesce(F.concat(F.lit(" ("), g["reviews"].cast("string"), F.lit(" product reviews)")), F.lit("")))
        return F.concat_ws(" — ", F.concat((i + 1).cast("string"), F.lit(". **"), g["title"], F.lit("**")), F.concat(F.lit("from "), plain(g["price_min"])), F.when(g["price_max"] > g["price_min"], F.concat(F.lit("up to "), plain(g["price_max"]))), sellers, rating)

    head = F.concat(F.lit("# Google Shopping"), F.coalesce(F.concat(F.lit(": "), F.nullif(query, F.lit(""))), F.lit("")))
    listed = F.concat(head, F.lit("\n\n"), F.size(groups).cast("string"), F.lit(" products (Google order)\n\n"), F.array_join(F.transform(groups, line), "\n"))
    return F.when(F.size(groups) > 0, listed).otherwise(F.concat(head, F.lit("\n\nNo products found.")))


AUTHORS_SHOWN, TOPICS_SHOWN = 12, 6


def paper_markdown(full_text: Column) -> Column:
    """A paper (the columns of ``operators.scholar.full_text``) as a page."""
    names = F.filter(F.transform("authors", lambda a: a["name"]), lambda n: n.isNotNull())
    more = F.coalesce("author_count", F.size(names)) - AUTHORS_SHOWN
    authors = F.nullif(F.concat(F.array_join(F.slice(names, 1, AUTHORS_SHOWN), ", "), F.when(more > 0, F.concat(F.lit(", … (+"), more.cast("string"), F.lit(")"))).otherwise("")), F.lit(""))
    cite = F.concat(F.col("container"), F.coalesce(F.concat(F.lit(" "), "volume"), F.lit("")), F.coalesce(F.concat(F.lit("("), "issue", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(":"), "pages"), F.lit("")))
    facts = _joined(" · ", cite, F.col("year").cast("string"), F.col("publisher"))
    access = F.when(F.col("is_oa"), F.concat(F.lit("🔓 open access"), F.when(F.coalesce(F.col("oa_status") != "closed", F.lit(False)), F.concat(F.lit(" ("), "oa_status", F.lit(")"))).otherwise(""))).otherwise("🔒 paywalled")
    status = F.concat_ws(" · ", access, F.concat(F.lit("cited by "), F.format_number("cited_by_count", 0)), F.when(F.col("is_retracted"), "⚠️ RETRACTED"))
    doi = F.concat(F.lit("**DOI:** ["), "doi", F.lit("]("), "url", F.lit(")"))
    topics = F.when(F.size("topics") > 0, F.concat(F.lit("**Topics:** "), F.array_join(F.slice("topics", 1, TOPICS_SHOWN), ", ")))
    return _blocks(
        F.concat(F.lit("# "), "title"), authors, facts, status, doi, topics, F.concat(F.lit("**TL;DR:** "), "tldr"), F.concat(F.lit("## Abstract\n\n"), "abstract"), F.concat(F.lit("## Full text\n\n"), F.nullif(F.trim(full_text), F.lit("")))
    )


def game_markdown() -> Column:
    """A game (the columns of ``operators.catalogs.enriched_apps``) as a page."""
    money = F.when(F.col("is_free"), "Free").otherwise(F.coalesce(F.concat_ws(" ", "currency", F.format_number("price", 2)), F.lit("Price unavailable")))
    cut = F.when(F.col("list_price").isNotNull(), F.concat(F.lit("-"), _number(F.col("discount")), F.lit("% (was "), "currency", F.lit(" "), F.format_number("list_price", 2), F.lit(")")))
    verdict = F.concat(F.col("reviews.review_score_desc"), F.coalesce(F.concat(F.lit(" ("), F.format_number("reviews.total_reviews", 0), F.lit(" reviews)")), F.lit("")))
    low = F.concat(F.lit("all-time low "), F.col("historical_low.currency"), F.lit(" "), F.format_number("historical_low.price", 2), F.coalesce(F.concat(F.lit(" ("), F.col("historical_low.date"), F.lit(")")), F.lit("")))
    facts = _joined(" · ", cut, F.concat(F.lit("Metacritic "), F.col("score").cast("string")), verdict, F.concat(F.format_number("players", 0), F.lit(" playing now")), low, F.nullif(F.regexp_replace("genres", "; ", ", "), F.lit("")))
    return _blocks(F.concat(F.lit("# "), F.coalesce("name", F.lit("?")), F.lit(" — "), money), facts)


ARTICLE = (
    "name STRING, description STRING, abstract STRING, date_created STRING, date_modified STRING, in_language STRUCT<identifier: STRING>, main_entity STRUCT<identifier: STRING>, "
    "version STRUCT<maintenance_tags: STRING, scores: STRING>, infoboxes STRING"
)


def article_fields(body: Column) -> Column:
    """Title, dates, language and quality of a structured article in JSON (ADP21): its description or abstract,
    entity, maintenance tags, scores and info boxes, the last three as JSON texts; null for no article."""
    a = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), ARTICLE)
    full = lambda x: F.when(~x.isin("", "{}", "[]", "null"), x)
    return F.when(
        a["name"].isNotNull(),
        F.struct(
            a["name"].alias("title"), a["date_created"].alias("published"), a["date_modified"].alias("modified"), a["in_language"]["identifier"].alias("language"), V.first_filled(a["description"], a["abstract"]).alias("description"),
            a["main_entity"]["identifier"].alias("wikidata"), full(a["version"]["maintenance_tags"]).alias("maintenance_tags"), full(a["version"]["scores"]).alias("scores"), full(a["infoboxes"]).alias("infoboxes"),
        ),
    )
