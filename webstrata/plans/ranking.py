"""Queries of passages, ranking, merging and aggregation (SEG, RNK, AGG, SET, JON, LIM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.operators import merge as M
from webstrata.operators import rank as R
from webstrata.operators import scholar as P
from webstrata.operators.routing import excluded
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERY = "the battery ships with a spare cable"


def passage_top(spark: SparkSession, folder: str) -> DataFrame:
    """The best three passages of every fetched text with their context (SEG01, SEG02, RNK01, RNK02, RNK05)."""
    return R.extract_passages(table(spark, folder, "fetch_cache"), "fetch_id", "markdown", R.tokenize(QUERY), 3, 400)


def passage_bm25(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 over the lines of each document, best two (RNK01, RNK02)."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("passage_no", "line")).where("length(line) >= 30")
    tokens = lines.select("doc_id", "passage_no", F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9]+"), F.lit(0)).alias("tokens"))
    return R.top_passages(R.bm25(tokens, QUERY.split()), 2).select("doc_id", "passage_no", "rank", "score", "shared")


_Q = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(QUERY.split())) + "]"
SQL_BM25 = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS passage_no FROM documents),
p AS (SELECT doc_id, passage_no, regexp_extract_all(lower(line), '[a-z0-9]+') AS tokens FROM l WHERE length(line) >= 30),
c AS (SELECT doc_id, count(*) AS n, avg(len(tokens)) AS avgdl FROM p GROUP BY doc_id),
d AS (SELECT doc_id, term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM p) GROUP BY ALL),
w AS (SELECT d.doc_id, term, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d JOIN c USING (doc_id)),
f AS (SELECT doc_id, avg(idf) * 0.25 AS floor FROM w GROUP BY doc_id),
h AS (SELECT doc_id, passage_no, dl, term, count(*) AS f FROM (SELECT doc_id, passage_no, len(tokens) AS dl, unnest(list_filter(tokens, lambda t: list_contains({_Q}, t))) AS term FROM p) GROUP BY ALL),
s AS (SELECT h.doc_id, passage_no, sum(CASE WHEN idf < 0 THEN floor ELSE idf END * h.f * 2.5 / (h.f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS shared
  FROM h JOIN w ON h.doc_id = w.doc_id AND h.term = w.term JOIN f ON f.doc_id = h.doc_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, shared DESC, passage_no) AS rank FROM s)
SELECT doc_id, CAST(passage_no AS INTEGER) AS passage_no, CAST(rank AS INTEGER) AS rank, round(greatest(score, 0.0), 4) AS score, shared FROM r WHERE rank <= 2
"""


def vector_top(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every row whose id is divisible by 100 (RNK03)."""
    return R.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, 5)


SQL_VECTORS = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM e),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v, b.v) / (a.l * b.l) AS s FROM n a JOIN n b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM p WHERE s > 0)
SELECT query_id, vec_id, round(s, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
"""


def vector_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same through an index of cells (RNK03)."""
    return R.nearest_indexed(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("id") % 100 == 0, 5)


def vector_recall(spark: SparkSession, folder: str) -> DataFrame:
    """The share of the exact neighbours that the index finds, and whether it is 0.9 or more."""
    x = R.recall(vector_indexed(spark, folder), vector_top(spark, folder))
    return x.select("n_queries", "n_exact", (F.col("recall") >= 0.9).alias("good"))


SQL_RECALL = f"SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, true AS good FROM ({SQL_VECTORS})"


def map_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of four sources as one list, the first source winning, some left out (SET01, CLS18)."""
    f = table(spark, folder, "fetch_cache").select("fetch_id", "url", "final_url", "canonical_url").dropDuplicates(["fetch_id"])
    named = [("canonical_url", 0), ("url", 1), ("final_url", 2)]
    rows = [f.select(F.col(c).alias("url"), F.lit(p).alias("priority"), F.col("fetch_id").alias("seq"), F.lit(c).alias("source")) for c, p in named]
    logged = table(spark, folder, "telemetry").select("entry_id", "url").dropDuplicates(["entry_id"]).select("url", F.lit(3).alias("priority"), F.col("entry_id").alias("seq"), F.lit("log").alias("source"))
    merged = M.first_source_wins(rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(logged), "url", "priority", "seq")
    return merged.where(~excluded(F.col("url"), ["-board", "page=3"]))


SQL_MAP = """
WITH f AS (SELECT DISTINCT fetch_id, url, final_url, canonical_url FROM fetch_cache), u AS (SELECT canonical_url AS url, 0 AS priority, fetch_id AS seq, 'canonical_url' AS source FROM f UNION ALL SELECT url, 1, fetch_id, 'url' FROM f
  UNION ALL SELECT final_url, 2, fetch_id, 'final_url' FROM f UNION ALL SELECT url, 3, entry_id, 'log' FROM (SELECT DISTINCT entry_id, url FROM telemetry))
SELECT url, priority, seq, source FROM u WHERE url IS NOT NULL AND NOT contains(url, '-board') AND NOT contains(url, 'page=3') QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority, seq) = 1
"""


def map_limited(spark: SparkSession, folder: str) -> DataFrame:
    """The first 25 of the merged list, and a notice that there were more (LIM02)."""
    return M.limited_with_notice(map_merge(spark, folder), [F.col("priority"), F.col("seq"), F.col("url")], 25, ["url", "source"])


SQL_LIMITED = f"WITH m AS ({SQL_MAP}), n AS (SELECT *, row_number() OVER (ORDER BY priority, seq, url) AS n FROM m) SELECT CASE WHEN n <= 25 THEN url END AS url, CASE WHEN n <= 25 THEN source END AS source, CASE WHEN n > 25 THEN 'more results were left out' END AS note FROM n WHERE n <= 26"


def offer_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Prices of one part by many suppliers grouped as offers (AGG03, TXT29)."""
    l = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber")  # noqa: E741
    p = table(spark, folder, "part").select("p_partkey", F.concat(F.initcap("p_name"), F.lit(" !")).alias("title"))
    offers = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        "title", F.col("l_suppkey").alias("store"), F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).alias("rating"),
    )
    grouped = M.grouped_offers(offers, M.title_key(F.col("title")))
    return grouped.select("product_key", "price_min", "price_max", "position", "rating", F.size("sellers").alias("n_sellers"), F.get("sellers", F.lit(0))["store"].alias("cheapest_store"))


SQL_OFFERS = """
WITH o AS (SELECT regexp_replace(trim(regexp_replace(lower(p_name || ' !'), '\\s+', ' ', 'g')), '[\\s.,;:!?-]+$', '') AS k, l_suppkey AS store, round(l_extendedprice / l_quantity, 2) AS price, l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_linenumber > 2 THEN l_quantity END AS rating
  FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT k, min(struct_pack(price := price, store := store)).store AS cheapest_store, count(*) AS n_sellers FROM (SELECT DISTINCT k, price, store FROM o WHERE price IS NOT NULL) GROUP BY k)
SELECT o.k AS product_key, min(price) AS price_min, max(price) AS price_max, min(position) AS position, arg_min(rating, struct_pack(p := position, r := rating)) FILTER (rating IS NOT NULL) AS rating, CAST(any_value(n_sellers) AS INTEGER) AS n_sellers, any_value(cheapest_store) AS cheapest_store FROM o JOIN s ON s.k = o.k GROUP BY o.k
"""


def price_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per brand inside the fences, and dropped ones (AGG04, AGG08)."""
    p = table(spark, folder, "part").select("p_partkey", "p_brand", F.pow(F.col("p_size").cast("double"), 3).cast("long").alias("price"))
    kept = M.without_outliers(p, ["p_brand"], "price", fence=0.5).groupBy("p_brand").agg(F.count("*").alias("kept"), F.max("price").alias("highest"))
    return kept.join(p.groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand").select("p_brand", "kept", "highest", (F.col("n") - F.col("kept")).alias("dropped"))


SQL_OUTLIERS = """
WITH p AS (SELECT p_brand, CAST(p_size AS BIGINT) ** 3 AS price FROM part), s AS (SELECT p_brand, list_sort(list(price)) AS v, count(*) AS n FROM p GROUP BY p_brand),
q AS (SELECT p_brand, n, ((v[(n + 1) // 4]) * (4 - ((n + 1) - 4 * ((n + 1) // 4))) + v[(n + 1) // 4 + 1] * ((n + 1) - 4 * ((n + 1) // 4))) / 4.0 AS q1,
  ((v[(n + 1) * 3 // 4]) * (4 - ((n + 1) * 3 - 4 * ((n + 1) * 3 // 4))) + v[(n + 1) * 3 // 4 + 1] * ((n + 1) * 3 - 4 * ((n + 1) * 3 // 4))) / 4.0 AS q3 FROM s WHERE n >= 8)
SELECT p.p_brand, count_if(q.n IS NULL OR q3 - q1 <= 0 OR price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1)) AS kept, CAST(max(CASE WHEN q.n IS NULL OR q3 - q1 <= 0 OR price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1) THEN price END) AS BIGINT) AS highest,
  count_if(NOT (q.n IS NULL OR q3 - q1 <= 0 OR price BETWEEN q1 - 0.5 * (q3 - q1) AND q3 + 0.5 * (q3 - q1))) AS dropped FROM p LEFT JOIN q USING (p_brand) GROUP BY p.p_brand
"""


def sponsor_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Events outside all of their user's blocked spans (JON06)."""
    e = table(spark, folder, "events").select("event_id", "user_id", (F.col("event_id") % 3600).cast("double").alias("t"))
    spans = table(spark, folder, "events").select("user_id", (F.col("event_id") % 3500).cast("double").alias("s")).dropDuplicates(["user_id", "s"])
    spans = spans.select("user_id", "s", (F.col("s") + 90).alias("e"))
    return M.without_intervals(e, "t", spans, "s", "e", "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


SQL_SPONSOR = """
WITH e AS (SELECT event_id, user_id, CAST(event_id % 3600 AS DOUBLE) AS t FROM events), s AS (SELECT DISTINCT user_id, CAST(event_id % 3500 AS DOUBLE) AS s FROM events)
SELECT user_id, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.t >= s.s AND e.t < s.s + 90) GROUP BY user_id
"""


def seed_routes(spark: SparkSession, folder: str) -> DataFrame:
    """The longest seed prefix of each address's route, with its tier (JON04)."""
    rows = table(spark, folder, "fetch_cache").select("fetch_id", F.regexp_replace("url", "^https://", "").alias("route")).dropDuplicates(["fetch_id"])
    hosts = table(spark, folder, "sites").select("host")
    seeds = hosts.select(F.col("host").alias("prefix"), F.lit("http").alias("tier")).unionByName(hosts.select(F.concat("host", F.lit("/re")), F.lit("browser")).toDF("prefix", "tier"))
    return M.longest_prefix(rows, "route", seeds, "prefix", ["tier"]).select("fetch_id", "matched_prefix", "tier")


SQL_SEEDS = """
WITH r AS (SELECT DISTINCT fetch_id, regexp_replace(url, '^https://', '') AS route FROM fetch_cache), s AS (SELECT host AS prefix, 'http' AS tier FROM sites UNION ALL SELECT host || '/re', 'browser' FROM sites)
SELECT fetch_id, prefix AS matched_prefix, tier FROM r LEFT JOIN s ON starts_with(route, prefix) QUALIFY row_number() OVER (PARTITION BY fetch_id ORDER BY length(prefix) DESC) = 1
"""


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of five services per DOI: two as recorded, three made of them."""
    c = table(spark, folder, "crossref").select("response_id", "message").dropDuplicates(["response_id"]).where("message.DOI IS NOT NULL")
    e = table(spark, folder, "europepmc").select("response_id", "resultList").dropDuplicates(["response_id"]).select("response_id", F.posexplode("resultList.result").alias("k", "r")).where("r.doi IS NOT NULL")
    doi, n = F.col("message.DOI"), F.length("message.DOI")
    at = F.format_string("%010d", "response_id")
    made = lambda body, keep: c.where(keep).select(doi.alias("doi"), F.to_json(body).alias("body"), at.alias("at"))
    copy = F.struct(F.lit("repository").alias("host_type"), F.concat(F.lit("https://pdf.example/"), doi).alias("pdf_url"), F.lit("cc-by").alias("license"))
    openalex = F.struct(F.concat(F.lit("https://openalex.org/W"), n.cast("string")).alias("id"), F.lit("From the third").alias("title"), (n * 3).alias("cited_by_count"), F.create_map(F.lit("two"), F.array(F.lit(1)), F.lit("one"), F.array(F.lit(0))).alias("abstract_inverted_index"), F.struct(F.lit("https://x/pmid/77").alias("pmid")).alias("ids"), F.struct((n % 2 == 0).alias("is_oa"), F.lit("green").alias("oa_status")).alias("open_access"))
    unpaywall = F.struct(doi.alias("doi"), F.lit("A publisher").alias("publisher"), F.lit(True).alias("is_oa"), copy.alias("best_oa_location"))
    s2 = F.struct(F.lit("s2id").alias("paperId"), F.when(n % 4 == 0, "An abstract").otherwise("").alias("abstract"), F.struct(F.lit("Short").alias("text")).alias("tldr"), F.struct(F.lit("https://s2.example/x.pdf").alias("url")).alias("openAccessPdf"), F.struct(F.lit("88").alias("PubMed")).alias("externalIds"))
    return P.answers_by_doi({
        "crossref": c.select(doi.alias("doi"), F.to_json(F.struct("message")).alias("body"), at.alias("at")),
        "europepmc": e.select(F.col("r.doi").alias("doi"), F.to_json(F.struct(F.struct(F.array("r").alias("result")).alias("resultList"))).alias("body"), F.concat(at, F.format_string("%06d", "k")).alias("at")),
        "openalex": made(openalex, n % 3 == 0), "unpaywall": made(unpaywall, n % 5 == 0), "semantic_scholar": made(s2, n % 2 == 0),
    })


def star_join(spark: SparkSession, folder: str) -> DataFrame:
    """Papers of five services merged on DOI with precedence per field (JON07, SET04, ADP18, ADP19, CLS24)."""
    x = P.full_text(P.merged_papers(_answers(spark, folder), 3))
    x = P.paper_warnings(x, F.lit(False), F.length("doi") % 3 > 0)
    pmid = F.try_element_at("ids", F.lit("pmid"))
    first = F.get("authors", F.lit(0))["name"]
    return x.select(
        "doi", "title", "publisher", "cited_by_count", "abstract", "abstract_source", "tldr", "is_oa", "oa_status", pmid.alias("pmid"), first.alias("first_author"), "author_count", "published", "license", "full_text_url", "full_text_source",
        F.array_join("sources_used", "+").alias("sources_used"), F.array_join("warnings", "+").alias("warnings"),
    )


SQL_STAR = """
WITH m AS (SELECT DISTINCT response_id, message FROM crossref WHERE message.DOI IS NOT NULL), c AS (SELECT lower(message.DOI) AS doi, message AS m, length(message.DOI) AS n FROM m QUALIFY row_number() OVER (PARTITION BY lower(message.DOI) ORDER BY response_id DESC) = 1),
r AS (SELECT response_id, unnest(resultList.result) AS r, generate_subscripts(resultList.result, 1) AS k FROM (SELECT DISTINCT response_id, resultList FROM europepmc)),
e AS (SELECT lower(r.doi) AS doi, r FROM r WHERE r.doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lower(r.doi) ORDER BY response_id DESC, k DESC) = 1),
j AS (SELECT coalesce(c.doi, e.doi) AS doi, c.doi IS NOT NULL AS hc, e.doi IS NOT NULL AS he, coalesce(n % 3 = 0, false) AS ho, coalesce(n % 5 = 0, false) AS hu, coalesce(n % 2 = 0, false) AS hs, n, m, r FROM c FULL JOIN e ON c.doi = e.doi),
a AS (SELECT *, list_filter(list_transform(m.author, lambda x: coalesce(nullif(trim(concat_ws(' ', nullif(trim(x.given), ''), nullif(trim(x.family), ''))), ''), nullif(trim(x.name), ''))), lambda x: x IS NOT NULL) AS names, nullif(trim(r.abstractText), '') AS ea,
  list_filter(m.issued."date-parts"[1], lambda x: x IS NOT NULL) AS dp FROM j),
t AS (SELECT *, coalesce(nullif(trim(m.title[1]), ''), CASE WHEN ho THEN 'From the third' END, nullif(trim(r.title), '')) AS title FROM a)
SELECT doi, title, coalesce(nullif(trim(m.publisher), ''), CASE WHEN hu THEN 'A publisher' END) AS publisher, coalesce(CASE WHEN ho THEN n * 3 END, m."is-referenced-by-count") AS cited_by_count,
  CASE WHEN hs AND n % 4 = 0 THEN 'An abstract' WHEN ho THEN 'one two' ELSE ea END AS abstract, CASE WHEN hs AND n % 4 = 0 THEN 'semantic_scholar' WHEN ho THEN 'openalex' WHEN ea IS NOT NULL THEN 'europepmc' END AS abstract_source,
  CASE WHEN hs THEN 'Short' END AS tldr, hu OR (ho AND n % 2 = 0) AS is_oa, CASE WHEN ho THEN 'green' WHEN NOT hu THEN 'closed' END AS oa_status, CASE WHEN ho THEN '77' WHEN hs THEN '88' ELSE nullif(trim(r.pmid), '') END AS pmid,
  names[1] AS first_author, CAST(nullif(len(names), 0) AS INTEGER) AS author_count, nullif(array_to_string(list_transform(dp, lambda x, i: CASE WHEN i = 1 THEN CAST(x AS VARCHAR) ELSE lpad(CAST(x AS VARCHAR), 2, '0') END), '-'), '') AS published,
  coalesce(nullif(trim(m.license[1].URL), ''), CASE WHEN hu THEN 'cc-by' END) AS license, CASE WHEN hu THEN 'https://pdf.example/' || m.DOI WHEN hs THEN 'https://s2.example/x.pdf' END AS full_text_url, CASE WHEN hu THEN 'unpaywall' WHEN hs THEN 'semantic_scholar' END AS full_text_source,
  array_to_string(list_filter([CASE WHEN NOT (hs AND n % 4 = 0) AND NOT ho AND ea IS NULL THEN 'no_abstract' END, CASE WHEN NOT hu AND NOT (ho AND n % 2 = 0) AND NOT hs THEN 'paywalled' END, CASE WHEN (hu OR hs) AND length(doi) % 3 = 0 THEN 'full_text_unavailable' END], lambda x: x IS NOT NULL), '+') AS warnings,
  array_to_string(list_filter([CASE WHEN hc THEN 'crossref' END, CASE WHEN ho THEN 'openalex' END, CASE WHEN hu THEN 'unpaywall' END, CASE WHEN hs THEN 'semantic_scholar' END, CASE WHEN he THEN 'europepmc' END], lambda x: x IS NOT NULL), '+') AS sources_used FROM t WHERE title IS NOT NULL
"""


def resolved_ids(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs of papers named by five kinds of ids, out of recorded answers (ADP19)."""
    c = table(spark, folder, "crossref").select("response_id", "message").dropDuplicates(["response_id"]).select("response_id", F.col("message.DOI").alias("d"))
    kind = F.element_at(F.array(*map(F.lit, ["doi", "arxiv", "pii", "pmid", "pmcid"])), (F.col("response_id") % 5 + 1).cast("int"))
    ident = F.when(kind == "doi", F.concat(F.lit("https://doi.org/"), "d", F.lit("."))).otherwise(F.concat(F.lit("2401.1"), F.col("response_id").cast("string")))
    pii = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("d").alias("DOI"))).alias("items")).alias("message")))
    pmc = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("d").alias("doi"))).alias("result")).alias("resultList")))
    body = F.when(kind == "pii", pii).when(kind == "pmcid", pmc).otherwise(F.to_json(F.struct(F.col("d").alias("doi"))))
    return c.select("response_id", P.resolved_doi(kind, ident, body).alias("doi"))


SQL_RESOLVED = "SELECT DISTINCT response_id, CASE WHEN response_id % 5 = 1 THEN '10.48550/arxiv.2401.1' || response_id ELSE lower(message.DOI) END AS doi FROM crossref"

CATALOG: dict[str, tuple[Query, str | None]] = {
    "passage_top": (passage_top, None),
    "passage_bm25": (passage_bm25, SQL_BM25),
    "vector_top": (vector_top, SQL_VECTORS),
    "vector_indexed": (vector_indexed, None),
    "vector_recall": (vector_recall, SQL_RECALL),
    "map_merge": (map_merge, SQL_MAP),
    "map_limited": (map_limited, SQL_LIMITED),
    "offer_groups": (offer_groups, SQL_OFFERS),
    "price_outliers": (price_outliers, SQL_OUTLIERS),
    "sponsor_cut": (sponsor_cut, SQL_SPONSOR),
    "seed_routes": (seed_routes, SQL_SEEDS),
    "star_join": (star_join, SQL_STAR),
    "resolved_ids": (resolved_ids, SQL_RESOLVED),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
