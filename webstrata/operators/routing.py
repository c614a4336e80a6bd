"""Which parser claims an address, which headers a route takes, and how busy a host is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.functions.urls import WIKI_PROJECTS, host_of, part
from webstrata.operators.domains import with_registered_domain
from webstrata.operators.state import BLOCK_SECONDS, carried, joined_carried

# Services in the order they are asked, with the hosts and paths they claim.
SERVICES = [
    ("youtube", r"^(?:[a-z0-9-]+\.)*(?:youtube\.com|youtube-nocookie\.com)(?:\.[a-z]{2,})?$|^(?:www\.)?youtu\.be$", ""),
    ("wikimedia", rf"^(?:[a-z0-9-]+\.)+(?:{WIKI_PROJECTS})\.org$", r"^/(?:wiki/.|w/index\.php)"),
    ("github", r"^(?:www\.)?github\.com$", r"^/[^/]+/[^/]+/?$"),
    ("scholar", r"^(?:dx\.)?doi\.org$|(?:^|\.)ncbi\.nlm\.nih\.gov$|^europepmc\.org$|^api\.crossworks\.example$", ""),
    ("google_shopping", r"^(?:www\.)?google\.[a-z.]+$", r"^/(?:shopping|search)"),
    ("olx", r"(?:^|\.)olx\.com\.br$", r"(?i)/(?:imoveis|autos-e-pecas)(?:/|$)"),
    ("mercadolivre", r"(?:^|\.)mercadoli(?:vre|bre)\.com(?:\.[a-z]{2})?$", ""),
    ("aliexpress", r"(?:^|\.)aliexpress\.(?:com|us)$", ""),
    ("shopee", r"(?:^|\.)shopee\.com\.br$", ""),
    ("petlove", r"(?:^|\.)petlove\.com\.br$", ""),
    ("amazon", r"(?:^|\.)amazon\.(?:com|com\.br)$", ""),
    ("steam", r"^store\.steampowered\.com$", r"^/(?:app/\d+|search)"),
    ("npm", r"^(?:www\.)?npmjs\.com$", r"^/package/."),
]


def service_of(url: Column) -> Column:
    """The first service that claims an address, or null (CLS16, CLS17)."""
    host, path = host_of(url), part(url, "path")
    out = F.lit(None).cast("string")
    for name, hosts, paths in reversed(SERVICES):
        claims = host.rlike(hosts) & path.rlike(paths) if paths else host.rlike(hosts)
        out = F.when(claims, name).otherwise(out)
    return out


def forge_claim(url: Column) -> Column:
    """(kind, project, number) of a forge address, or null: issues, merge requests, bare projects."""
    path = part(url, "path")
    threads = r"^/(.+?)/-/(issues|merge_requests)/(\d+)"
    bare = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = F.when(path.rlike(threads), F.when(F.regexp_extract(path, threads, 2) == "issues", "issue").otherwise("merge_request")).when(
        ~path.contains("/-/") & (F.size(bare) >= 2), "project"
    )
    project = F.when(kind == "project", F.array_join(bare, "/")).otherwise(F.regexp_extract(path, threads, 1))
    return F.when(kind.isNotNull() & url.rlike("^https?://"), F.struct(kind.alias("kind"), project.alias("project"), F.nullif(F.regexp_extract(path, threads, 3), F.lit("")).alias("number")))


def header_profiles(rows: DataFrame, url: str, rules: DataFrame, learned: DataFrame, seeds: DataFrame, default: str = "browser") -> DataFrame:
    """The header profile of each address (JON05): a rule for its host, one for its domain, the profile
    learned for its route, a seed for host or domain, else ``default``.  ``rules`` and ``seeds`` have
    (host, profile), ``learned`` (route_key, profile), all with unique keys."""
    x = with_registered_domain(rows, url, "_domain").withColumn("_host", host_of(F.col(url)))
    # rules and seeds are told apart by tables, so that host and domain each meet one table only
    both = rules.select("host", F.col("profile").alias("rule")).join(seeds.select("host", F.col("profile").alias("seed")), "host", "full_outer")
    for at in ("host", "domain"):
        side = both.select(F.col("host").alias("_key"), F.struct("rule", "seed").alias(f"_by_{at}"))
        x = x.join(side, x[f"_{at}"] == side["_key"], "left").drop("_key")
    side = learned.select(F.col("route_key").alias("_key"), F.col("profile").alias("_learned"))
    x = x.join(side, x["route_key"] == side["_key"], "left").drop("_key")
    picked = F.coalesce("_by_host.rule", "_by_domain.rule", "_learned", "_by_host.seed", "_by_domain.seed", F.lit(default)).alias("profile")
    return x.select(*rows.columns, picked)


def location_ignored(listings: DataFrame, group: str, wanted: str, state: str) -> DataFrame:
    """(group, ignored): whether under half of a page's listings lie in the state asked for (CLS19)."""
    inside = F.count_if(F.lower(state) == F.lower(wanted))
    return listings.groupBy(group, wanted).agg(F.coalesce((F.count(state) > 0) & (inside * 2 < F.count(state)), F.lit(False)).alias("ignored"))


def in_flight(requests: DataFrame, key: str, start: str, seconds: str, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """How many requests of a key run when each one starts, itself included (STT07): starts minus ends
    before it, by sums that run within blocks of time from those of the blocks before."""
    begins = requests.select(key, F.col(start).alias("_t"), F.lit(1).alias("_d"), F.lit(1).alias("_o"), F.struct(*requests.columns).alias("_r"))
    ends = requests.select(key, (F.col(start) + F.col(seconds)).alias("_t"), F.lit(-1).alias("_d"), F.lit(0).alias("_o"), F.lit(None).cast(begins.schema["_r"].dataType).alias("_r"))
    both = begins.unionByName(ends).withColumn("_b", F.floor(F.col("_t") / block_seconds))
    before = carried(both, key, "_b", {"_before": F.sum("_d")}, {"_before": F.sum})
    w = W.partitionBy(key, "_b").orderBy("_t", "_o", F.xxhash64("_r")).rowsBetween(W.unboundedPreceding, 0)
    x = joined_carried(both, before, key, "_b").withColumn("running", F.sum("_d").over(w) + F.coalesce("_before", F.lit(0)))
    return x.where("_r IS NOT NULL").select("_r.*", F.col("running").cast("int").alias("in_flight"))


def warnings_of(flags: dict[str, Column]) -> Column:
    """The names of the flags that hold, in order (CLS24)."""
    return F.array_compact(F.array(*[F.when(c, name) for name, c in flags.items()]))


def related_by_label(rows: DataFrame, group: str, label: str, place: str, columns: list[str]) -> DataFrame:
    """(group, key, items): rows of each label, its text as a slug, in order of place (SET03)."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    items = F.array_sort(F.collect_list(F.struct(place, *columns)))
    return rows.where(slug != "").groupBy(group, slug.alias("key")).agg(items.alias("items"))


def excluded(url: Column, patterns: list[str]) -> Column:
    """Whether an address holds one of the patterns, in their letter case (CLS18)."""
    return F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(url, p)) if patterns else F.lit(False)


def store_probe(reached: Column, status: Column, body: Column, anchor: str) -> Column:
    """Whether an unknown host is a store, or null where that is not known (CLS23): a host that was not
    reached is unknown; an answer without the product or with an empty one says no; a product says yes."""
    found = F.get_json_object(F.when(F.try_parse_json(body).isNotNull(), body), anchor)
    return F.when(reached, (status == 200) & F.coalesce(~found.isin("", "{}", "[]"), F.lit(False)))


def forge_probe(reached: Column, status: Column, body: Column, anchor: str) -> Column:
    """Whether an unknown host is a forge (CLS23): unreached and failing ones are unknown, as is JSON of
    another shape; other text says no, a record says yes."""
    parsed = F.try_parse_json(body).isNotNull()
    record = F.get_json_object(F.when(parsed, body), anchor).isNotNull()
    return F.when(~reached | (status >= 500), F.lit(None).cast("boolean")).when(~F.coalesce(parsed, F.lit(False)), False).when(record, True)
