"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SAMPLE_CHARS = 200_000


def bounded_sample(df: DataFrame, key: str, bound: int, text: str = "markdown") -> DataFrame:
    """About ``bound`` rows with text and no more, chosen by the hash of ``key``: the same rows in any order
    and partitioning.  Rows are thinned where they are read, so that tasks return a share of the bound.
    Models are not fitted to texts of more than ``SAMPLE_CHARS`` characters, so that the whole sample has a
    bound; all texts are judged."""
    df = df.where(F.length(text).between(1, SAMPLE_CHARS))
    n = df.count()
    share = 1.0 if n <= bound else bound / n
    scale = 1_000_000
    kept = df.where(F.pmod(F.xxhash64(key), F.lit(scale)) < int(share * scale) + 1) if share < 1 else df
    return kept.limit(bound)
