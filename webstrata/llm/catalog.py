"""Queries on text for training data, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.abuse import abusive_documents, rated_agreement, score_documents, source_rates
from webstrata.llm.chrome import chrome_lines, main_bodies
from webstrata.llm.language import COMMON, FILLER, label_faults, language_segments
from webstrata.llm.linekinds import label_shares, text_statistics, unreadable_records
from webstrata.llm.lookalike import canonical_forms, lookalike_classes, lookalike_pairs
from webstrata.llm.packing import fill_checks, fill_report, pack
from webstrata.llm.residue import held_out_report, residue_records, score_residue
from webstrata.llm.tokens import count_tokens, decode_corpus, encode_corpus
from webstrata.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return chrome_lines(table(spark, folder, "fetch_cache"))


def p1_main_body(spark: SparkSession, folder: str) -> DataFrame:
    return main_bodies(table(spark, folder, "fetch_cache"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_pairs(table(spark, folder, "fetch_cache"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike_classes(table(spark, folder, "fetch_cache"))


def p2_forms(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_forms(table(spark, folder, "fetch_cache")).dropDuplicates(["fetch_id"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue_records(table(spark, folder, "fetch_cache"))


def p4_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_residue(table(spark, folder, "fetch_cache")).distinct()


def p4_held_out_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Precision and recall of the classifier on hosts and wordings left out of its fit."""
    report = held_out_report(table(spark, folder, "fetch_cache"))
    return spark.createDataFrame(sorted(report.items()), "measure STRING, value DOUBLE")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return label_faults(table(spark, folder, "fetch_cache"))


def p5_segments(spark: SparkSession, folder: str) -> DataFrame:
    return language_segments(table(spark, folder, "fetch_cache")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return unreadable_records(table(spark, folder, "fetch_cache"))


def p6_label_shares(spark: SparkSession, folder: str) -> DataFrame:
    return label_shares(table(spark, folder, "fetch_cache")).distinct()


def p6_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return text_statistics(table(spark, folder, "fetch_cache"))


_P6_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted({w for lang, words in COMMON.items() if lang != FILLER for w in words.split() if len(w) > 1}))
SQL_P6_STATISTICS = f"""
WITH f AS (SELECT DISTINCT fetch_id, markdown AS t, word_count, quality_json FROM fetch_cache),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}''’-]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ') <> '') AS l FROM f)
SELECT fetch_id, len(w) AS words, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 4) WHEN t IS NOT NULL THEN 0.0 END AS mean_word_length,
  CASE WHEN length(t) > 0 THEN round(len(regexp_extract_all(t, '[^\\p{{L}}\\p{{N}}\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]'))::DOUBLE / length(t), 4) WHEN t IS NOT NULL THEN 0.0 END AS symbol_ratio,
  CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…]["''”»)*_]*\\s*$')))::DOUBLE / len(l), 4) WHEN t IS NOT NULL THEN 0.0 END AS ending_share,
  CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: x IN ({_P6_COMMON})))::DOUBLE / len(w), 4) WHEN t IS NOT NULL THEN 0.0 END AS common_share, word_count AS recorded_words, coalesce(json_valid(quality_json), false) AS quality_is_json FROM w
"""


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p8_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the texts that each document's ids spell."""
    return decode_corpus(encode_corpus(table(spark, folder, "documents"))).select("doc_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("sha256"))


SQL_P8_ROUND_TRIP = "SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(coalesce(text, '')) AS sha256 FROM documents"


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(count_tokens(table(spark, folder, "documents")), table(spark, folder, "containers"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    return fill_report(count_tokens(table(spark, folder, "documents")), table(spark, folder, "containers"))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    return fill_checks(count_tokens(table(spark, folder, "documents")), table(spark, folder, "containers"))


SQL_P9_CHECKS = """
SELECT container_kind, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS split_wrongly, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS overfull FROM containers
"""


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return abusive_documents(table(spark, folder, "documents"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    return score_documents(table(spark, folder, "documents"))


def p10_source_rates(spark: SparkSession, folder: str) -> DataFrame:
    return source_rates(table(spark, folder, "documents"))


def p10_rated(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts beside the human ratings, per source."""
    return rated_agreement(table(spark, folder, "documents"), table(spark, folder, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, q in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"p6_statistics": SQL_P6_STATISTICS, "p8_round_trip": SQL_P8_ROUND_TRIP, "p9_checks": SQL_P9_CHECKS}
