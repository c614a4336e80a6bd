"""Videos out of recorded metadata and caption files: transcripts, or what stands in for them (ADP20, CLS25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import values as V
from webstrata.functions.text import token_estimate, word_count
from webstrata.operators.payloads import cue_lines

# Tracks that hold no captions, and languages asked for first.
NO_CAPTIONS = ["live_chat", "rechat"]
FIRST_LANGUAGES = ["en", "en-orig"]
CHAPTERS = "array<struct<start_time: double, title: string>>"


def caption_choice(subtitles: Column, automatic: Column) -> Column:
    """(language, automatic) of the track to take, out of the languages of both kinds in their order: written
    ones first (English, then any), then automatic ones (the original, English, any); null for none."""
    written = F.filter(F.coalesce(subtitles, F.array().cast("array<string>")), lambda x: ~x.isin(*NO_CAPTIONS))
    made = F.coalesce(automatic, F.array().cast("array<string>"))
    english = F.filter(F.array(*map(F.lit, FIRST_LANGUAGES)), lambda x: F.array_contains(written, x))
    original = F.filter(made, lambda x: x.endswith("-orig"))
    by_hand = F.coalesce(F.get(english, F.lit(0)), F.get(written, F.lit(0)))
    by_machine = F.coalesce(F.get(original, F.lit(0)), F.when(F.array_contains(made, "en"), "en"), F.get(made, F.lit(0)))
    language = F.coalesce(by_hand, by_machine)
    return F.when(language.isNotNull(), F.struct(language.alias("language"), by_hand.isNull().alias("automatic")))


def chapter_list(chapters: Column) -> Column:
    """Chapters as a markdown list under a heading; empty where there are none."""
    kept = F.filter(chapters, lambda c: c["title"] != "")
    lines = F.transform(kept, lambda c: F.concat(F.lit("- "), F.coalesce(F.concat(V.clock(c["start_time"]), F.lit(" ")), F.lit("")), c["title"]))
    return F.when(F.size(lines) > 0, F.concat(F.lit("## Chapters\n"), F.array_join(lines, "\n"))).otherwise("")


def without_captions(description: Column, chapters: Column) -> Column:
    """What stands in for a transcript: the description and the chapters; null where there is neither."""
    said = F.filter(F.array(F.trim(F.coalesce(description, F.lit(""))), chapter_list(F.coalesce(chapters, F.array().cast(CHAPTERS)))), lambda x: x != "")
    return F.nullif(F.array_join(said, "\n\n"), F.lit(""))


def spoken(cues: Column, spans: Column) -> Column:
    """The text of cues that start in none of the spans (arrays of start and end), a line like the one before
    it left out.  Spans of other lengths are none."""
    blocked = F.filter(F.coalesce(spans, F.array().cast("array<array<double>>")), lambda s: F.size(s) == 2)
    kept = F.filter(cues, lambda c: ~F.exists(blocked, lambda s: (s[0] <= c["start"]) & (c["start"] < s[1])))
    texts = F.transform(kept, lambda c: c["text"])
    return F.array_join(F.filter(texts, lambda t, i: (i == 0) | (F.get(texts, i - 1) != t)), " ")


def transcripts(videos: DataFrame) -> DataFrame:
    """One record per video.  ``videos`` has ``video_id``, ``subtitles`` and ``automatic`` (languages in
    order), ``vtt`` (the file of the chosen track), ``spans`` (null where the span service did not answer),
    ``description``, ``chapters`` (start_time, title) and ``duration``."""
    x = videos.withColumn("track", caption_choice(F.col("subtitles"), F.col("automatic")))
    text = F.nullif(spoken(cue_lines(F.col("vtt")), F.col("spans")), F.lit(""))
    x = x.withColumn("markdown", F.when(F.col("track").isNotNull(), text).otherwise(without_captions(F.col("description"), F.col("chapters"))))
    warnings = F.array_compact(F.array(F.when(F.col("track").isNull(), "no_captions"), F.when(F.col("track").isNotNull() & F.col("spans").isNull(), "sponsorblock_unavailable")))
    ok = F.col("markdown").isNotNull()
    return x.select(
        "video_id", F.when(ok, "ok").otherwise("unsupported_content_type").alias("outcome"), "markdown", F.col("track.language").alias("language"), F.when(ok, warnings).alias("warnings"),
        F.when(ok, word_count(F.col("markdown"))).alias("word_count"), F.when(ok, token_estimate(F.col("markdown"))).alias("token_count_estimate"), F.col("duration").cast("int").alias("duration_seconds"),
    )


def video_markdown(kind: Column, name: Column, videos: Column) -> Column:
    """A list of videos (title, duration_seconds, view_count, url) under its name (ADP22)."""
    bits = lambda v: F.concat_ws(" — ", F.coalesce(F.nullif(v["title"], F.lit("")), F.lit("(untitled)")), V.clock(v["duration_seconds"].cast("double")), F.concat(F.format_number(v["view_count"], 0), F.lit(" views")))
    lines = F.transform(videos, lambda v, i: F.concat((i + 1).cast("string"), F.lit(". "), bits(v), F.coalesce(F.concat(F.lit("\n   "), v["url"]), F.lit(""))))
    body = F.when(F.size(videos) > 0, F.array_join(lines, "\n")).otherwise("_No videos found._")
    return F.concat(F.lit("# "), F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("YouTube "), kind)), F.lit("\n\n"), body)
