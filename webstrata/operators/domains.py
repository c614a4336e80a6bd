"""Registered domains by the public suffix list, and the route keys made of them.

The list is a table of rules.  By default it is read from the copy that ships with Spark's own jars; a
path to a newer one may be given.  It has some thousands of short rules, whose number is checked before
they are broadcast; a host's own suffixes are looked up one by one, nothing is exploded or shuffled.

Hosts without a listed suffix, addresses of numbers, and hosts that are a suffix themselves stay whole,
less ``www.``.  Null stays null, and an empty address has an empty domain.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import host_of, is_variable_segment, part, with_scheme

RESOURCE = "mozilla/public-suffix-list.txt"
BEGIN, END = "===BEGIN ICANN DOMAINS===", "===END ICANN DOMAINS==="
MOST_LABELS = 5
MOST_RULES = 100_000


def parse_rules(lines: Iterable[str]) -> list[tuple[str, int, bool, bool, bool]]:
    """(key, labels of the key, plain, wildcard, exception) of a suffix list's lines, the section of private
    domains left out.  Rules in other scripts are also given in their ASCII form."""
    flags: dict[str, list[bool]] = {}
    inside = True
    for line in lines:
        rule = line.strip()
        if rule.startswith("//"):
            inside = inside and END not in rule or BEGIN in rule
        elif rule and inside:
            kind = 2 if rule[0] == "!" else 1 if rule.startswith("*.") else 0
            key = rule.split()[0].lstrip("!").removeprefix("*.").lower()
            for name in {key, key if key.isascii() else key.encode("idna").decode()}:
                flags.setdefault(name, [False] * 3)[kind] = True
    return [(key, key.count(".") + 1, *kinds) for key, kinds in sorted(flags.items())]


def suffix_rules(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The rules of the list at ``path``, or of the one on Spark's own class path."""
    if path is not None:
        lines = [r.value for r in spark.read.text(path).limit(MOST_RULES).collect()]
    else:
        stream = spark._jvm.java.lang.ClassLoader.getSystemResourceAsStream(RESOURCE)
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    rules = parse_rules(lines)
    if len(rules) >= MOST_RULES:
        raise ValueError("too many suffix rules to send to every task")
    return spark.createDataFrame(rules, "key STRING, labels INT, plain BOOLEAN, wildcard BOOLEAN, exception BOOLEAN")


def with_registered_domain(rows: DataFrame, url: str, name: str = "domain", rules: DataFrame | None = None) -> DataFrame:
    """``rows`` with the registered domain of ``url``: the label below the longest suffix, with it (URL11)."""
    rules = suffix_rules(rows.sparkSession) if rules is None else rules
    x = rows.withColumn("_host", F.regexp_replace(host_of(F.col(url)), r"\.$", "")).withColumn("_labels", F.split("_host", r"\."))
    n = F.size("_labels")
    sizes = []
    for k in range(1, MOST_LABELS + 1):
        x = x.withColumn(f"_s{k}", F.when(n >= k, F.array_join(F.slice("_labels", -k, k), ".")))
    for k in range(1, MOST_LABELS + 1):
        side = rules.where(F.col("labels") == k).select(F.col("key").alias(f"_k{k}"), *(F.col(c).alias(f"_{c}{k}") for c in ("plain", "wildcard", "exception")))
        x = x.join(F.broadcast(side), F.col(f"_s{k}") == F.col(f"_k{k}"), "left")
        sizes.append(F.when(F.col(f"_exception{k}"), 100 + k - 1).when(F.col(f"_wildcard{k}") & (n > k), k + 1).when(F.col(f"_plain{k}"), k).otherwise(0))
    longest = F.greatest(*sizes)
    size = F.when(longest >= 100, longest - 100).otherwise(longest)  # an exception prevails over all others
    domain = F.when((size > 0) & (n > size), F.array_join(F.slice("_labels", -size - 1, size + 1), ".")).otherwise(F.regexp_replace("_host", r"^www\.", ""))
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(F.col(url) == "", "").otherwise(domain).alias(name))


def route_key_of(domain: Column, url: Column) -> Column:
    """Domain and first path segment; deeper paths and item-like segments become ``*`` (URL13)."""
    segments = F.filter(F.split(F.lower(part(with_scheme(url), "path")), "/"), lambda x: x != "")
    first = F.get(segments, F.lit(0))
    return (
        F.when(domain == "", "")
        .when(F.size(segments) == 0, domain)
        .when(is_variable_segment(first), F.concat(domain, F.lit("/*")))
        .when(F.size(segments) == 1, F.concat(domain, F.lit("/"), first))
        .otherwise(F.concat(domain, F.lit("/"), first, F.lit("/*")))
    )


def with_route_key(rows: DataFrame, url: str, name: str = "route_key", rules: DataFrame | None = None) -> DataFrame:
    keyed = with_registered_domain(rows, url, "_domain", rules)
    return keyed.withColumn(name, route_key_of(F.col("_domain"), F.col(url))).drop("_domain")


def third_party_blocked(requests: DataFrame, request_url: str, page_url: str, listed: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``blocked``: whether the host asked, or a parent of it, is listed and belongs to
    another domain than the page (CLS12).  ``listed`` has (domain)."""
    rules = suffix_rules(requests.sparkSession) if rules is None else rules
    x = with_registered_domain(with_registered_domain(requests, request_url, "_asked", rules), page_url, "_page", rules)
    x = x.withColumn("_host", host_of(F.col(request_url)))
    labels = F.split("_host", r"\.")
    hosts = x.select("_host").where("_host <> ''").distinct()
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))), lambda k: F.array_join(F.slice(labels, -F.least(k, F.size(labels)), F.least(k, F.size(labels))), "."))
    tried = hosts.select("_host", F.explode(F.array_distinct(parents)).alias("_parent"))
    hits = tried.join(listed.select(F.lower("domain").alias("_parent")).distinct(), "_parent").select("_host", F.lit(True).alias("_hit")).distinct()
    blocked = F.coalesce("_hit", F.lit(False)) & ~F.col("_asked").eqNullSafe(F.col("_page"))
    return x.join(hits, "_host", "left").select(*[F.col(f"`{c}`") for c in requests.columns], blocked.alias("blocked"))


def purge_domain(cache: DataFrame, url: str, domain: str, rules: DataFrame | None = None) -> DataFrame:
    """What a purge of a domain leaves (SET05): rows of other registered domains.  ``domain`` may be any
    address or host of it."""
    spark = cache.sparkSession
    rules = suffix_rules(spark) if rules is None else rules
    target = with_registered_domain(spark.createDataFrame([(domain,)], "u STRING"), "u", "d", rules).first().d
    return with_registered_domain(cache, url, "_domain", rules).where(~F.coalesce((F.col("_domain") == target) & F.lit(target != ""), F.lit(False))).drop("_domain")


def purge_probes(probes: DataFrame, domain: str) -> DataFrame:
    """Probe verdicts without those of a registered domain and of hosts under it (SET05)."""
    return probes.where((F.col("domain") != domain) & ~F.col("domain").endswith(f".{domain}"))
