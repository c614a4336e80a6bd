"""Queries of the URL functions, over the addresses of the fetch log and variants made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.functions import values as V
from webstrata.operators import domains as D
from webstrata.operators.archive import slash_variants, unwrapped_snapshot
from webstrata.operators.membership import blocked_hosts
from webstrata.session import table

Query = Callable[[SparkSession, str], DataFrame]


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Each fetch's address once."""
    return table(spark, folder, "fetch_cache").select("fetch_id", "url").dropDuplicates(["fetch_id"])


SQL_ADDRESSES = "SELECT DISTINCT fetch_id, url FROM fetch_cache"


def _decorated() -> "F.Column":
    mark = F.when(F.col("url").contains("?"), "&").otherwise("?")
    noisy = F.concat(F.replace("url", F.lit("https://"), F.lit(" HTTPS://WWW.")), F.lit(""))
    return F.concat(noisy, mark, F.lit("utm_source=x&b=2&a=1&a=0&flag&fbclid=9&amp=1&output=amp#top "))


SQL_DECORATED = "replace(url, 'https://', ' HTTPS://WWW.') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x&b=2&a=1&a=0&flag&fbclid=9&amp=1&output=amp#top '"


def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical addresses of decorated variants (URL01 to URL05)."""
    return addresses(spark, folder).select("fetch_id", U.normalize_url(_decorated()).alias("normalized"))


_KEYS = ", ".join(f"'{k}'" for k in U.TRACKING_KEYS)
SQL_NORMALIZE = f"""
WITH a AS ({SQL_ADDRESSES}), r AS (SELECT fetch_id, trim({SQL_DECORATED}) AS raw FROM a),
p AS (SELECT fetch_id, lower(regexp_extract(raw, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(raw, '://([^/?#]*)', 1)) AS host,
  regexp_extract(raw, '://[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(raw, '\\?([^#]*)', 1), '&') AS tokens FROM r),
q AS (SELECT *, list_transform(list_sort(list_transform(list_filter(tokens, lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({_KEYS}) AND NOT starts_with(x, 'utm_')
    AND NOT starts_with(x, 'mtm_') AND NOT (split_part(x, '=', 1) = 'amp' AND lower(split_part(x, '=', 2)) IN ('', '1', 'true', 'amp')) AND NOT (split_part(x, '=', 1) = 'output' AND lower(split_part(x, '=', 2)) = 'amp')),
    lambda x, i: {{'k': split_part(x, '=', 1), 'i': i, 'x': x}})), lambda t: t.x) AS kept FROM p)
SELECT fetch_id, scheme || '://' || host || CASE WHEN path <> '/' AND ends_with(path, '/') THEN CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END ELSE path END
  || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normalized FROM q
"""


def url_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """How often each query key occurs in decorated addresses, and whether it is tracking (URL02)."""
    keys = F.explode(F.split(U.part(F.trim(_decorated()), "query"), "&"))
    rows = addresses(spark, folder).select(keys.alias("token")).select(F.substring_index("token", "=", 1).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("tracking", U.is_tracking(F.col("key")))


SQL_TRACKING = f"""
WITH t AS (SELECT split_part(unnest(string_split(regexp_extract(trim({SQL_DECORATED}), '\\?([^#]*)', 1), '&')), '=', 1) AS key FROM ({SQL_ADDRESSES}))
SELECT key, count(*) AS n, key IN ({_KEYS}) OR starts_with(key, 'utm_') OR starts_with(key, 'mtm_') AS tracking FROM t GROUP BY key
"""


def url_host_tracking(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are tracking on one family of hosts only (URL03)."""
    hosts = F.explode(F.array(F.lit("lista.mercadolivre.com.br"), F.lit("www.olx.com.br"), F.lit("shop.example")))
    pairs = addresses(spark, folder).select("fetch_id", hosts.alias("host"), F.explode(F.array(F.lit("sid"), F.lit("page"))).alias("key"))
    return pairs.groupBy("host", "key").agg(F.sum(U.host_tracking(F.col("host"), F.col("key")).cast("int")).alias("n_dropped"))


SQL_HOST_TRACKING = f"""
SELECT host, key, CAST(sum(CASE WHEN (host = 'lista.mercadolivre.com.br' AND key = 'sid') OR (host = 'www.olx.com.br' AND key = 'page') THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped
FROM ({SQL_ADDRESSES}), (VALUES ('lista.mercadolivre.com.br'), ('www.olx.com.br'), ('shop.example')) h(host), (VALUES ('sid'), ('page')) k(key) GROUP BY host, key
"""


def url_amp(spark: SparkSession, folder: str) -> DataFrame:
    """AMP segments of paths taken out (URL05)."""
    path = F.concat(F.lit("/amp"), U.part(F.col("url"), "path"), F.lit("/amp"))
    return addresses(spark, folder).select("fetch_id", U.strip_amp_path(path).alias("path"))


SQL_AMP = f"""
SELECT fetch_id, '/' || array_to_string(list_filter(string_split(substr('/amp' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) || '/amp', 2), '/'), lambda x: x <> 'amp'), '/') AS path FROM ({SQL_ADDRESSES})
"""


def _video(i: "F.Column") -> "F.Column":
    key = F.concat(F.lit("id"), F.col("fetch_id").cast("string"))
    return (
        F.when(i == 0, F.concat(F.lit("https://youtu.be/"), key))
        .when(i == 1, F.concat(F.lit("https://m.youtube.com/watch?list=a&v="), key))
        .when(i == 2, F.concat(F.lit("http://www.youtube.com.br/shorts/"), key, F.lit("?x=1")))
        .otherwise(F.concat(F.lit("https://music.youtube.com/playlist?list="), key))
    )


def url_video(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of a video's address folded to one (URL06)."""
    return addresses(spark, folder).select("fetch_id", U.canonical_video(_video(F.col("fetch_id") % 4)).alias("canonical"))


SQL_VIDEO = f"""
SELECT fetch_id, CASE fetch_id % 4 WHEN 0 THEN 'https://youtube.com/watch?v=id' || fetch_id WHEN 1 THEN 'https://youtube.com/watch?v=id' || fetch_id || '&list=a'
  WHEN 2 THEN 'https://youtube.com/watch?v=id' || fetch_id || '&x=1' ELSE 'https://youtube.com/playlist?list=id' || fetch_id END AS canonical FROM ({SQL_ADDRESSES})
"""


def url_wiki(spark: SparkSession, folder: str) -> DataFrame:
    """Wiki addresses folded (URL07): mobile hosts, blanks in titles, plain index views."""
    n = F.col("fetch_id").cast("string")
    raw = F.when(F.col("fetch_id") % 2 == 0, F.concat(F.lit("http://EN.m.wikipedia.org/wiki/the%20page%20"), n, F.lit("#top"))).otherwise(
        F.concat(F.lit("https://de.wikipedia.org/w/index.php?title=some+page_"), n)
    )
    return addresses(spark, folder).select("fetch_id", U.canonical_wiki(raw).alias("canonical"))


SQL_WIKI = f"""
SELECT fetch_id, CASE WHEN fetch_id % 2 = 0 THEN 'https://en.wikipedia.org/wiki/The_page_' || fetch_id ELSE 'https://de.wikipedia.org/wiki/Some_page_' || fetch_id END AS canonical FROM ({SQL_ADDRESSES})
"""


def url_unwrap(spark: SparkSession, folder: str) -> DataFrame:
    """Link wrappers, nested twice, undone (URL08 to URL10)."""
    inner = F.concat(F.lit("https://www.google.com/url?sa=t&q="), U.quote(F.col("url")))
    outer = F.concat(F.lit("https://l.facebook.com/l.php?u="), U.quote(inner))
    return addresses(spark, folder).select("fetch_id", U.unwrap(outer).alias("target"))


SQL_UNWRAP = f"SELECT fetch_id, url AS target FROM ({SQL_ADDRESSES})"


SUFFIXES = ["", ".com", ".co.uk", ".com.br", ".kawasaki.jp", ".city.kawasaki.jp", ".ck", ".www.ck"]


def url_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Registered domains and route keys, hosts under several kinds of suffix rule, with how many fetches share them (URL11 to URL14)."""
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("fetch_id") % len(SUFFIXES) + 1).cast("int"))
    moved = F.concat(F.regexp_extract("url", "^([^/]*//[^/?#]*)", 1), suffix, F.regexp_extract("url", "^[^/]*//[^/?#]*(.*)$", 1))
    rows = D.with_registered_domain(addresses(spark, folder).select(moved.alias("u")), "u")
    return rows.select("domain", D.route_key_of(F.col("domain"), F.col("u")).alias("route_key")).groupBy("domain", "route_key").agg(F.count("*").alias("n"))


SQL_DOMAINS = f"""
WITH h AS (SELECT fetch_id % 8 AS k, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS host, list_filter(string_split(lower(regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '/'), lambda x: x <> '') AS s FROM ({SQL_ADDRESSES})),
r AS (SELECT s, CASE k WHEN 0 THEN regexp_replace(host, '^www\\.', '') WHEN 1 THEN split_part(host, '.', -1) || '.com' WHEN 2 THEN split_part(host, '.', -1) || '.co.uk' WHEN 3 THEN split_part(host, '.', -1) || '.com.br'
  WHEN 4 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) || '.kawasaki.jp' WHEN 5 THEN 'city.kawasaki.jp' WHEN 6 THEN split_part(host, '.', -2) || '.' || split_part(host, '.', -1) || '.ck' ELSE 'www.ck' END AS domain FROM h)
SELECT domain, CASE WHEN len(s) = 0 THEN domain WHEN regexp_matches(s[1], '[0-9]') OR length(s[1]) > 24 THEN domain || '/*' WHEN len(s) = 1 THEN domain || '/' || s[1]
  ELSE domain || '/' || s[1] || '/*' END AS route_key, count(*) AS n FROM r GROUP BY ALL
"""


def url_third_party(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that pages make to listed hosts of other domains (CLS12)."""
    page = F.concat(F.lit("https://www.site"), (F.col("fetch_id") % 5).cast("string"), F.lit(".co.uk/x"))
    asked = F.concat(F.lit("https://cdn.site"), (F.col("fetch_id") % 3).cast("string"), F.lit(".co.uk/y"))
    listed = spark.createDataFrame([("site1.co.uk",), ("CDN.site2.co.uk",)], "domain STRING")
    rows = addresses(spark, folder).select("fetch_id", page.alias("page"), asked.alias("asked"))
    return D.third_party_blocked(rows, "asked", "page", listed).select("fetch_id", "blocked")


SQL_THIRD_PARTY = f"SELECT fetch_id, fetch_id % 3 IN (1, 2) AND fetch_id % 3 <> fetch_id % 5 AS blocked FROM ({SQL_ADDRESSES})"


def domain_purged(spark: SparkSession, folder: str) -> DataFrame:
    """What a purge by domain leaves of the cache and of the probes (SET05)."""
    rows = addresses(spark, folder).select("fetch_id", F.concat(F.lit("https://a.b"), (F.col("fetch_id") % 4).cast("string"), F.lit(".com.br/")).alias("url"))
    probes = rows.select("fetch_id", F.concat(F.lit("git.b"), (F.col("fetch_id") % 4).cast("string"), F.lit(".com.br")).alias("domain"))
    left = D.purge_domain(rows, "url", "http://www.b2.com.br/any").select("fetch_id", F.lit("entry").alias("kind"))
    return left.unionByName(D.purge_probes(probes, "b2.com.br").select("fetch_id", F.lit("probe").alias("kind")))


SQL_PURGED = f"SELECT fetch_id, kind FROM ({SQL_ADDRESSES}), (VALUES ('entry'), ('probe')) k(kind) WHERE fetch_id % 4 <> 2"


def url_slash_variants(spark: SparkSession, folder: str) -> DataFrame:
    """An address and its form with the closing slash toggled (SRC11), with the snapshot mark (SRC12)."""
    variants = slash_variants(F.col("url"))
    snapshot = F.concat(F.lit("http://web.archive.org/web/20240101000000/"), F.col("v"))
    rows = addresses(spark, folder).select("fetch_id", F.posexplode(variants).alias("variant", "v"))
    return rows.select("fetch_id", "variant", unwrapped_snapshot(snapshot).alias("snapshot"))


SQL_SLASH = f"""
WITH p AS (SELECT fetch_id, url, regexp_extract(url, '^[^?]*', 0) AS head, regexp_extract(url, '\\?.*$', 0) AS tail FROM ({SQL_ADDRESSES})),
v AS (SELECT fetch_id, 0 AS variant, url AS v FROM p UNION ALL SELECT fetch_id, 1, CASE WHEN ends_with(head, '/') THEN rtrim(head, '/') ELSE head || '/' END || tail FROM p WHERE regexp_matches(head, '://[^/]+/.+'))
SELECT fetch_id, CAST(variant AS INTEGER) AS variant, 'https://web.archive.org/web/20240101000000if_/' || v AS snapshot FROM v
"""


def url_dois(spark: SparkSession, folder: str) -> DataFrame:
    """DOIs found in request addresses (URL20)."""
    rows = table(spark, folder, "crossref").select("response_id", "request_url").dropDuplicates(["response_id"])
    return rows.select("response_id", V.doi(F.concat("request_url", F.lit(".)"))).alias("doi"))


SQL_DOIS = r"""
SELECT DISTINCT response_id, nullif(lower(regexp_replace(regexp_extract(request_url || '.)', '10\.\d{4,9}/[^\s"''<>]+', 0), '[.,;:)\]]+$', '')), '') AS doi FROM crossref
"""


def url_repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Repository addresses of four schemes as one (URL19)."""
    slug = F.concat(U.host_of(F.col("url")), F.lit("/"), F.col("fetch_id").cast("string"), F.lit(".git"))
    forms = F.element_at(F.array(F.lit("git+https://"), F.lit("git://"), F.lit("ssh://git@"), F.lit("https://")), (F.col("fetch_id") % 4 + 1).cast("int"))
    return addresses(spark, folder).select("fetch_id", V.repository_url(F.concat(forms, slug)).alias("repository"))


SQL_REPOSITORIES = f"SELECT fetch_id, 'https://' || lower(regexp_extract(url, '://([^/?#:]*)', 1)) || '/' || fetch_id AS repository FROM ({SQL_ADDRESSES})"


def url_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Fetches of blocked hosts: a host or one of its parents is listed (CLS11, JON02)."""
    sites = table(spark, folder, "sites").where("category IN ('forum', 'news')")
    listed = sites.select(F.col("host").alias("domain"))
    rows = addresses(spark, folder).select("fetch_id", F.concat(F.lit("cdn.img."), U.host_of(F.col("url"))).alias("host"))
    return blocked_hosts(rows, listed).select("fetch_id")


SQL_BLOCKED = f"""
SELECT fetch_id FROM ({SQL_ADDRESSES}) WHERE lower(regexp_extract(url, '://([^/?#:]*)', 1)) IN (SELECT host FROM sites WHERE category IN ('forum', 'news'))
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "url_normalize": (url_normalize, SQL_NORMALIZE),
    "url_tracking": (url_tracking, SQL_TRACKING),
    "url_host_tracking": (url_host_tracking, SQL_HOST_TRACKING),
    "url_amp": (url_amp, SQL_AMP),
    "url_video": (url_video, SQL_VIDEO),
    "url_wiki": (url_wiki, SQL_WIKI),
    "url_unwrap": (url_unwrap, SQL_UNWRAP),
    "url_domains": (url_domains, SQL_DOMAINS),
    "url_third_party": (url_third_party, SQL_THIRD_PARTY),
    "domain_purged": (domain_purged, SQL_PURGED),
    "url_slash_variants": (url_slash_variants, SQL_SLASH),
    "url_dois": (url_dois, SQL_DOIS),
    "url_repositories": (url_repositories, SQL_REPOSITORIES),
    "url_blocked": (url_blocked, SQL_BLOCKED),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in CATALOG.items() if sql}
