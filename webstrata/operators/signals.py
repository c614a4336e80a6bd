"""Text signals of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import text as T


def text_signals(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, six signals) of every row; neutral values for null texts and those under 200
    characters.  Words are split once per row, in a projection of their own."""
    enough = F.col("_t").isNotNull() & (F.length("_t") >= T.SHORT_TEXT)
    neutral = F.struct(
        F.lit(0.0).alias("slop_vocab_ratio"), F.lit(0).alias("slop_phrase_count"), F.lit(0.5).alias("sentence_length_cv"),
        F.lit(0.0).alias("em_dash_density"), F.lit(0.0).alias("transition_start_ratio"),
    )
    split = rows.select(F.col(key), F.col(text).alias("_t")).withColumn("_w", F.when(enough, T.words_of(F.col("_t"))))
    found = split.select(key, F.col("_t").alias(text), F.when(enough, T.word_signals(F.col("_t"), F.col("_w"))).otherwise(neutral).alias("_s"), T.mattr("_w").alias("_m"))
    return found.select(key, text, "_s.*", F.when(F.col(text).isNotNull() & (F.length(text) >= T.SHORT_TEXT), T.half_even(F.col("_m"))).otherwise(1.0).alias("type_token_ratio"))
