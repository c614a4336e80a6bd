"""Papers out of the answers of five scholarly services, merged on their DOI.

Each service's answer, as JSON, gives a fragment: named columns that are null where it does not say.  A
damaged answer, or one of another shape, gives a fragment of nulls and does not count as a source.  The
merge takes each field from the first service of that field's order that fills it; empty texts and empty
lists fill nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import values as V
from webstrata.operators.payloads import title_words

Fragment = dict[str, Column]
SERVICES = ["crossref", "openalex", "unpaywall", "semantic_scholar", "europepmc"]
_LOCATION = "STRUCT<host_type: STRING, version: STRING, pdf_url: STRING, url_for_pdf: STRING, landing_page_url: STRING, url: STRING, license: STRING, is_oa: BOOLEAN, repository_institution: STRING, source: STRUCT<type: STRING, display_name: STRING, issn: ARRAY<STRING>>>"
ANSWERS = {
    "crossref": """message STRUCT<DOI: STRING, title: ARRAY<STRING>, `container-title`: ARRAY<STRING>, publisher: STRING, type: STRING, ISSN: ARRAY<STRING>, volume: STRING, issue: STRING, page: STRING,
        language: STRING, abstract: STRING, `reference-count`: LONG, `is-referenced-by-count`: LONG, `alternative-id`: ARRAY<STRING>, issued: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>, published: STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>,
        license: ARRAY<STRUCT<URL: STRING>>, author: ARRAY<STRUCT<given: STRING, family: STRING, name: STRING, sequence: STRING, ORCID: STRING, affiliation: ARRAY<STRUCT<name: STRING>>>>>""",
    "openalex": f"""id STRING, doi STRING, title STRING, display_name STRING, type STRING, publication_date STRING, publication_year INT, language STRING, abstract_inverted_index MAP<STRING, ARRAY<INT>>, cited_by_count LONG,
        referenced_works_count LONG, is_retracted BOOLEAN, topics ARRAY<STRUCT<display_name: STRING>>, mesh ARRAY<STRUCT<descriptor_name: STRING>>, open_access STRUCT<is_oa: BOOLEAN, oa_status: STRING>,
        ids STRUCT<pmid: STRING, pmcid: STRING, mag: STRING>, primary_location {_LOCATION}, best_oa_location {_LOCATION}, locations ARRAY<{_LOCATION}>,
        authorships ARRAY<STRUCT<author_position: STRING, author: STRUCT<display_name: STRING, orcid: STRING>, institutions: ARRAY<STRUCT<display_name: STRING>>>>""",
    "unpaywall": f"doi STRING, title STRING, journal_name STRING, publisher STRING, year INT, genre STRING, is_oa BOOLEAN, oa_status STRING, best_oa_location {_LOCATION}, oa_locations ARRAY<{_LOCATION}>",
    "semantic_scholar": """paperId STRING, title STRING, venue STRING, year INT, abstract STRING, publicationTypes ARRAY<STRING>, openAccessPdf STRUCT<url: STRING>, tldr STRUCT<text: STRING>,
        externalIds STRUCT<DOI: STRING, PubMed: STRING, PubMedCentral: STRING, ArXiv: STRING, CorpusId: LONG>""",
    "europepmc": """resultList STRUCT<result: ARRAY<STRUCT<doi: STRING, pmid: STRING, pmcid: STRING, title: STRING, journalTitle: STRING, abstractText: STRING, isOpenAccess: STRING, inEPMC: STRING, hasPDF: STRING>>>""",
}


def clean(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _last(text: Column) -> Column:
    return F.substring_index(F.rtrim(clean(text), F.lit("/")), "/", -1)


def _ids(pairs: dict[str, Column]) -> Column:
    """A map of the ids that are given."""
    entries = F.array_compact(F.array(*[F.when(clean(x).isNotNull(), F.struct(F.lit(k), clean(x))) for k, x in pairs.items()]))
    return F.map_from_entries(entries)


def _without(new: Column, have: Column) -> Column:
    return F.map_filter(new, lambda k, _: ~F.map_contains_key(have, k))


def _named(values: Column, field: str) -> Column:
    return F.filter(F.transform(values, lambda v: clean(v[field])), lambda x: x.isNotNull())


def location(x: Column) -> Column:
    """A place of an open copy in one form, null where nothing is said."""
    fields = {
        "host_type": V.first_filled(clean(x["host_type"]), clean(x["source"]["type"])),
        "version": clean(x["version"]),
        "pdf_url": V.first_filled(clean(x["pdf_url"]), clean(x["url_for_pdf"])),
        "landing_url": V.first_filled(clean(x["landing_page_url"]), clean(x["url"])),
        "source": V.first_filled(clean(x["source"]["display_name"]), clean(x["repository_institution"])),
        "is_oa": x["is_oa"],
    }
    known = F.coalesce(*[c.cast("string") for c in fields.values()])
    return F.when(known.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def _locations(xs: Column) -> Column:
    return F.filter(F.transform(xs, location), lambda x: x.isNotNull())


def _author(name: Column, orcid: Column, affiliation: Column) -> Column:
    return F.struct(name.alias("name"), V.orcid(orcid).alias("orcid"), affiliation.alias("affiliation"))


def _authors(xs: Column) -> Column:
    return F.filter(xs, lambda a: a["name"].isNotNull())


def crossref_fragment(x: Column) -> Fragment:
    m = x["message"]
    written = lambda a: V.first_filled(clean(F.concat_ws(" ", clean(a["given"]), clean(a["family"]))), clean(a["name"]))
    parts = F.coalesce(F.get(m["issued"]["date-parts"], F.lit(0)), F.get(m["published"]["date-parts"], F.lit(0)))
    piis = F.filter(F.transform(m["alternative-id"], F.upper), lambda a: a.rlike("^[SB][0-9X-]{9,}$"))
    return {
        "said": m.isNotNull(),
        "title": clean(F.get(m["title"], F.lit(0))),
        "authors": _authors(F.transform(m["author"], lambda a: _author(written(a), a["ORCID"], _named(a["affiliation"], "name")))),
        "container": clean(F.get(m["container-title"], F.lit(0))),
        "publisher": clean(m["publisher"]),
        "type": clean(m["type"]),
        "issn": m["ISSN"],
        "volume": clean(m["volume"]),
        "issue": clean(m["issue"]),
        "pages": clean(m["page"]),
        "published": V.date_parts(parts),
        "year": F.get(F.filter(parts, lambda p: p.isNotNull()), F.lit(0)),
        "language": clean(m["language"]),
        "abstract": clean(F.regexp_replace(F.regexp_replace(m["abstract"], "<[^>]+>", " "), r"\s+", " ")),
        "reference_count": m["reference-count"],
        "cited_by_count": m["is-referenced-by-count"],
        "license": clean(F.get(m["license"], F.lit(0))["URL"]),
        "pii": F.get(piis, F.lit(0)),
    }


def openalex_fragment(x: Column) -> Fragment:
    source = x["primary_location"]["source"]
    ids = {"pmid": _last(x["ids"]["pmid"]), "pmcid": _last(x["ids"]["pmcid"]), "mag": x["ids"]["mag"], "openalex": _last(x["id"])}
    return {
        "said": clean(x["id"]).isNotNull(),
        "title": V.first_filled(clean(x["title"]), clean(x["display_name"])),
        "authors": _authors(F.transform(x["authorships"], lambda a: _author(clean(a["author"]["display_name"]), a["author"]["orcid"], _named(a["institutions"], "display_name")))),
        "container": clean(source["display_name"]),
        "type": clean(x["type"]),
        "issn": source["issn"],
        "published": clean(x["publication_date"]),
        "year": x["publication_year"],
        "language": clean(x["language"]),
        "abstract": clean(F.when(F.size(x["abstract_inverted_index"]) > 0, title_words(x["abstract_inverted_index"]))),
        "cited_by_count": x["cited_by_count"],
        "reference_count": x["referenced_works_count"],
        "is_retracted": x["is_retracted"],
        "topics": _named(x["topics"], "display_name"),
        "mesh": _named(x["mesh"], "descriptor_name"),
        "is_oa": x["open_access"]["is_oa"],
        "oa_status": clean(x["open_access"]["oa_status"]),
        "best_oa": location(x["best_oa_location"]),
        "oa_locations": _locations(x["locations"]),
        "ids": _ids(ids),
    }


def unpaywall_fragment(x: Column) -> Fragment:
    return {
        "said": clean(x["doi"]).isNotNull(),
        "title": clean(x["title"]),
        "container": clean(x["journal_name"]),
        "publisher": clean(x["publisher"]),
        "year": x["year"],
        "type": clean(x["genre"]),
        "is_oa": x["is_oa"],
        "oa_status": clean(x["oa_status"]),
        "best_oa": location(x["best_oa_location"]),
        "oa_locations": _locations(x["oa_locations"]),
        "license": clean(x["best_oa_location"]["license"]),
    }


def semantic_scholar_fragment(x: Column) -> Fragment:
    e = x["externalIds"]
    ids = {"pmid": e["PubMed"], "pmcid": e["PubMedCentral"], "arxiv": e["ArXiv"], "corpus_id": e["CorpusId"].cast("string"), "s2": x["paperId"]}
    return {
        "said": clean(x["paperId"]).isNotNull(),
        "title": clean(x["title"]),
        "container": clean(x["venue"]),
        "year": x["year"],
        "type": F.lower(F.get(x["publicationTypes"], F.lit(0))),
        "abstract": clean(x["abstract"]),
        "tldr": clean(x["tldr"]["text"]),
        "s2_oa_pdf": clean(x["openAccessPdf"]["url"]),
        "ids": _ids(ids),
    }


def europepmc_fragment(x: Column) -> Fragment:
    r = F.get(x["resultList"]["result"], F.lit(0))
    return {
        "said": r.isNotNull(),
        "title": clean(r["title"]),
        "container": clean(r["journalTitle"]),
        "abstract": clean(r["abstractText"]),
        "is_oa": r["isOpenAccess"] == "Y",
        "in_epmc": F.coalesce(r["inEPMC"] == "Y", F.lit(False)),
        "has_pdf": F.coalesce(r["hasPDF"] == "Y", F.lit(False)),
        "ids": _ids({"pmid": r["pmid"], "pmcid": F.regexp_replace(r["pmcid"], "(?i)^PMC", "")}),
    }


FRAGMENTS = {
    "crossref": crossref_fragment, "openalex": openalex_fragment, "unpaywall": unpaywall_fragment, "semantic_scholar": semantic_scholar_fragment, "europepmc": europepmc_fragment,
}
# The order in which services are asked for a field.
PRECEDENCE = {
    "title": "crossref openalex semantic_scholar europepmc unpaywall",
    "authors": "crossref openalex",
    "container": "crossref openalex semantic_scholar unpaywall europepmc",
    "publisher": "crossref unpaywall",
    "type": "crossref openalex semantic_scholar",
    "issn": "crossref openalex",
    "volume": "crossref",
    "issue": "crossref",
    "pages": "crossref",
    "published": "crossref openalex",
    "year": "crossref openalex semantic_scholar unpaywall",
    "language": "openalex crossref",
    "abstract": "semantic_scholar openalex europepmc crossref",
    "tldr": "semantic_scholar",
    "is_oa": "unpaywall openalex",
    "oa_status": "unpaywall openalex",
    "best_oa": "unpaywall openalex",
    "oa_locations": "unpaywall openalex",
    "s2_oa_pdf": "semantic_scholar",
    "license": "crossref unpaywall",
    "cited_by_count": "openalex crossref",
    "reference_count": "crossref openalex",
    "is_retracted": "openalex",
    "topics": "openalex",
    "mesh": "openalex",
    "pii": "crossref",
}
LISTS = ["authors", "issn", "oa_locations", "topics", "mesh"]
ID_ORDER = ["crossref", "openalex", "semantic_scholar", "europepmc"]


def answers_by_doi(sources: dict[str, DataFrame]) -> DataFrame:
    """(doi, one column per service): the latest answer of each service per DOI.  ``sources`` have (doi,
    body, at).  One grouping over all answers stands for four full joins; it is combined before the
    shuffle."""
    rows = None
    for name, df in sources.items():
        x = df.select(V.doi(F.col("doi")).alias("doi"), "at", F.lit(name).alias("service"), "body").where("doi IS NOT NULL")
        rows = x if rows is None else rows.unionByName(x)
    latest = [F.max_by(F.when(F.col("service") == s, F.col("body")), F.when(F.col("service") == s, F.col("at"))).alias(s) for s in SERVICES]
    return rows.groupBy("doi").agg(*latest)


def merged_papers(answers: DataFrame, max_authors: int = 50) -> DataFrame:
    """One paper per row of ``answers_by_doi`` by field precedence (JON07, SET04); rows no service has a
    title for are left out."""
    parsed = answers.select("doi", *[F.from_json(F.when(F.try_parse_json(s).isNotNull(), F.col(s)), ANSWERS[s]).alias(s) for s in SERVICES])
    found = {s: FRAGMENTS[s](F.col(s)) for s in SERVICES}

    def filled(name: str, x: Column) -> Column:
        return F.when(F.size(x) > 0, x) if name in LISTS else x

    fields = {f: F.coalesce(*[filled(f, found[s][f]) for s in order.split()]) for f, order in PRECEDENCE.items()}
    x = parsed.select(
        "doi",
        *[c.alias(f) for f, c in fields.items()],
        *[found["europepmc"][f].alias(f) for f in ("in_epmc", "has_pdf")],
        *[found[s]["abstract"].alias(f"_abstract_{s}") for s in PRECEDENCE["abstract"].split()],
        F.array_compact(F.array(*[F.when(F.coalesce(found[s]["said"], F.lit(False)), s) for s in SERVICES])).alias("sources_used"),
        *[(found[s]["ids"] if "ids" in found[s] else F.map_from_entries(F.array().cast("array<struct<k: string, v: string>>"))).alias(f"_ids_{s}") for s in ID_ORDER],
    ).where("title IS NOT NULL")
    ids = F.map_from_entries(F.array(F.struct(F.lit("doi"), F.col("doi"))))
    for s in ID_ORDER:  # the first service to give an id decides
        known = F.coalesce(F.col(f"_ids_{s}"), F.map_from_entries(F.array().cast("array<struct<k: string, v: string>>")))
        ids = F.map_concat(ids, _without(known, ids))
    source = F.coalesce(*[F.when(F.col(f"_abstract_{s}").isNotNull(), s) for s in PRECEDENCE["abstract"].split()])
    is_oa = F.coalesce("is_oa", F.lit(False))
    return x.select(
        "doi", F.concat(F.lit("https://doi.org/"), "doi").alias("url"), "pii", ids.alias("ids"), "title", F.slice(F.coalesce("authors", F.array().cast(x.schema["authors"].dataType)), 1, max_authors).alias("authors"),
        F.nullif(F.size(F.coalesce("authors", F.array().cast(x.schema["authors"].dataType))), F.lit(0)).alias("author_count"), "container", "publisher", "type", "issn", "volume", "issue", "pages", "published", "year",
        "language", "abstract", source.alias("abstract_source"), "tldr", is_oa.alias("is_oa"), F.coalesce("oa_status", F.when(~is_oa, "closed")).alias("oa_status"), "best_oa", "oa_locations", "s2_oa_pdf",
        "in_epmc", "has_pdf", "license", "cited_by_count", "reference_count", F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"), "topics", "mesh", "sources_used",
    )


def full_text(papers: DataFrame) -> DataFrame:
    """Papers with the place to read them in full and who names it (ADP19): a rendered article, the best
    open copy, any other copy, the copy a search service knows; null where there is none."""
    pmcid = F.try_element_at("ids", F.lit("pmcid"))
    rendered = F.when(F.coalesce(F.col("in_epmc") & F.col("has_pdf"), F.lit(False)) & pmcid.isNotNull(), F.concat(F.lit("https://europepmc.org/articles/PMC"), pmcid, F.lit("?pdf=render")))
    any_copy = F.get(F.filter("oa_locations", lambda x: x["pdf_url"].isNotNull()), F.lit(0))["pdf_url"]
    options = [(rendered, "europepmc"), (F.col("best_oa.pdf_url"), "unpaywall"), (any_copy, "repository"), (F.col("s2_oa_pdf"), "semantic_scholar")]
    return papers.withColumns({"full_text_url": F.coalesce(*[u for u, _ in options]), "full_text_source": F.coalesce(*[F.when(u.isNotNull(), n) for u, n in options])})


def resolved_doi(kind: Column, ident: Column, body: Column) -> Column:
    """The DOI of an id of any kind, with the recorded answer of the service that knows it (ADP19): plain
    DOIs and preprint numbers need none."""
    answer = F.when(F.try_parse_json(body).isNotNull(), body)
    pii = F.get_json_object(answer, "$.message.items[0].DOI")
    return (
        F.when(kind == "doi", V.doi(ident))
        .when(kind == "arxiv", V.doi(F.concat(F.lit("10.48550/arXiv."), ident)))
        .when(kind == "pii", V.doi(pii))
        .when(kind == "pmid", V.doi(F.get_json_object(answer, "$.doi")))
        .when(kind == "pmcid", V.doi(F.get_json_object(answer, "$.resultList.result[0].doi")))
    )


def paper_warnings(papers: DataFrame, asked_by_pii: Column, read: Column) -> DataFrame:
    """Papers with the names of what is amiss (CLS24): retracted, without an abstract, found by an item
    number, closed, or with a full text that could not be read."""
    flags = {
        "retracted": F.col("is_retracted"), "no_abstract": F.col("abstract").isNull(), "resolved_via_pii": asked_by_pii, "paywalled": ~F.col("is_oa") & F.col("full_text_url").isNull(), "full_text_unavailable": F.col("full_text_url").isNotNull() & ~read,
    }
    return papers.withColumn("warnings", F.array_compact(F.array(*[F.when(c, name) for name, c in flags.items()])))
