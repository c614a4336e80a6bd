"""Membership of hosts in lists, by suffix, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def suffixes(host: Column, least: int = 2) -> Column:
    """The host and its parents, down to ``least`` labels."""
    labels = F.split(F.lower(host), r"\.")
    n = F.size(labels)
    return F.when(n < least, F.array(F.lower(host))).otherwise(
        F.transform(F.sequence(F.lit(1), n - (least - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    )


def blocked_hosts(rows: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain") -> DataFrame:
    """The rows whose host or one of its parents is in ``domains``.

    Distinct hosts are matched, by an equi-join on their suffixes, and joined back: a host that very many
    rows share costs one match.  Null hosts are never blocked; an empty list blocks none."""
    hosts = rows.select(host).where(F.col(host).isNotNull()).distinct()
    listed = domains.select(F.lower(domain).alias("suffix")).distinct()
    hit = hosts.select(host, F.explode(suffixes(F.col(host))).alias("suffix")).join(listed, "suffix", "left_semi").select(host).distinct()
    return rows.join(hit, host, "left_semi")
