"""Text measures on built-in expressions.  Null text counts as empty where a number is asked for."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.urls import let

# Words, phrases and openings that mark generated text.
SLOP_WORDS = (
    "delve delving delved utilize utilizing utilized utilization facilitate facilitating facilitated elucidate elucidating elucidated embark embarking embarked "
    "endeavor endeavors endeavour encompass encompasses encompassing multifaceted tapestry testament paradigm synergy synergies holistic catalyze catalyzing "
    "juxtapose juxtaposition nuanced myriad plethora pivotal groundbreaking cutting-edge game-changer game-changing spearhead spearheading underscores "
    "underscoring leveraging leveraged streamline streamlining streamlined overarching cornerstone cornerstones aforementioned henceforth noteworthy commendable "
    "meticulous meticulously intricate intricacies aligns aligning resonates resonate resonating bustling moreover furthermore nevertheless nonetheless harnessing "
    "harness harnessed bolster bolstering bolstered fostering fostered captivating captivated interplay wholesome reinvigorate"
).split()
SLOP_PHRASES = [
    "it's important to note", "it is important to note", "it's worth noting", "it is worth noting", "in today's world", "in today's fast-paced", "in the realm of", "in the landscape of",
    "dive into", "diving into", "deep dive", "let's delve", "let's explore", "not just a", "isn't just about", "is not just about", "at its core", "at the end of the day", "in conclusion",
    "stands as a testament", "serves as a testament", "it's crucial to", "it is crucial to", "navigating the", "navigate the complexities", "the intricacies of", "a comprehensive guide",
    "the ultimate guide", "everything you need to know", "here's what you need to know", "here is what you need to know", "whether you're a", "look no further", "unlock the power",
    "unlock the potential", "unlock the secrets", "elevate your", "take it to the next level", "revolutionize your", "transform your", "game-changing", "ever-evolving", "ever-changing",
    "in this article, we", "in this blog post", "without further ado", "buckle up", "in an era where", "in a world where",
]
TRANSITIONS = (
    "additionally furthermore moreover consequently subsequently nevertheless nonetheless conversely specifically importantly significantly ultimately "
    "essentially fundamentally interestingly remarkably notably meanwhile"
).split()
SHORT_TEXT, MATTR_WINDOW = 200, 50
CJK = "\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{AC00}-\\x{D7AF}"


def half_even(x: Column, places: int = 4) -> Column:
    """Rounded as binary floating point is: the scaled value goes to the nearest whole number, ties to
    the even one.  ``bround`` works on the shortest decimal form and sees ties where there are none."""
    scale = float(10**places)
    return F.rint(x * scale) / scale


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))


def cjk_word_count(text: Column) -> Column:
    """Every CJK character is a word; the rest is counted between white space."""
    text = F.coalesce(text, F.lit(""))
    return F.length(text) - F.length(F.regexp_replace(text, f"[{CJK}]", "")) + word_count(F.regexp_replace(text, f"[{CJK}]", " "))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def confidence(words: Column) -> Column:
    return half_even(F.least(words / 800.0, F.lit(1.0)))


def boilerplate_ratio(markdown: Column, visible: Column) -> Column:
    """The share of the visible text that the main text lacks, within 0 and 1."""
    share = 1 - F.length(F.coalesce(markdown, F.lit(""))) / F.greatest(F.length(F.coalesce(visible, F.lit(""))), F.lit(1))
    return half_even(F.greatest(F.lit(0.0), F.least(share, F.lit(1.0))))


def words_of(text: Column) -> Column:
    """Lower-case words of Latin letters, with inner hyphens and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-z][a-z'-]*[a-z]\b|\b[a-z]\b"), F.lit(0))


def slop_vocab_ratio(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 0, F.size(F.filter(words, lambda w: w.isin(*SLOP_WORDS))) / n).otherwise(0.0)


def slop_phrase_count(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [low.contains(p).cast("int") for p in SLOP_PHRASES])


def sentence_length_cv(text: Column) -> Column:
    """Deviation of words per sentence over their mean; 0.5 below five sentences."""
    # the end of the text closes a match, so that an unterminated tail is read once, and then dropped
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]+(?:[.!?]+|\z)"), F.lit(0)), lambda s: s.rlike(r"[.!?]\z"))
    return let(F.transform(found, lambda s: word_count(s).cast("double")), _variation)


def _variation(counts: Column) -> Column:
    n = F.size(counts)
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
    mean = total / n
    variance = F.greatest(squares / n - mean * mean, F.lit(0.0))
    return F.when((n < 5) | (total == 0), 0.5).otherwise(F.sqrt(variance) / mean)


def em_dash_density(text: Column, n_words: Column) -> Column:
    dashes = F.size(F.regexp_extract_all(text, F.lit("—|---?"), F.lit(0)))
    return F.when(n_words > 0, dashes / n_words).otherwise(0.0)


def transition_ratio(text: Column) -> Column:
    """Share of paragraphs that open with a transition word; 0 below three paragraphs."""
    first = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_extract(p, r"(?U)^\s*(\S+)", 1))
    opened = F.transform(F.filter(first, lambda p: p != ""), lambda p: F.regexp_replace(F.lower(p), r"[.,;:]+$", ""))
    share = lambda x: F.size(F.filter(x, lambda w: w.isin(*TRANSITIONS))) / F.size(x)
    return let(opened, lambda x: F.when(F.size(x) < 3, 0.0).otherwise(share(x)))


@F.pandas_udf(T.DoubleType())
def _mattr(words: pd.Series) -> pd.Series:
    def one(text: np.ndarray | None) -> float:
        n = 0 if text is None else len(text)
        if n < MATTR_WINDOW:
            return len(set(text)) / n if n else 1.0
        # a word counts in the windows that hold it and not its occurrence before
        order = np.argsort(text, kind="stable")
        before = np.full(n, -1)
        same = text[order[1:]] == text[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        place = np.arange(n)
        opened = np.maximum(before + 1, place - MATTR_WINDOW + 1)
        change = np.bincount(np.maximum(opened, 0), minlength=n + 1) - np.bincount(place + 1, minlength=n + 1)
        ratios = np.cumsum(change)[: n - MATTR_WINDOW + 1] / MATTR_WINDOW
        return float(np.cumsum(ratios)[-1] / len(ratios))

    return words.map(one)


def mattr(words: Column) -> Column:
    """Distinct words per sliding window, averaged; plain ratio of a text shorter than one window, 1 for
    none.  Only 64-bit hashes of the words leave the JVM; all windows are counted at once, and their ratios
    added in order, as their sum decides the last digit."""
    return _mattr(F.transform(words, lambda w: F.xxhash64(w)))


def word_signals(text: Column, words: Column) -> Column:
    """Five of the six text signals, from a text and its words."""
    return F.struct(
        half_even(slop_vocab_ratio(words)).alias("slop_vocab_ratio"),
        slop_phrase_count(text).alias("slop_phrase_count"),
        half_even(sentence_length_cv(text)).alias("sentence_length_cv"),
        half_even(em_dash_density(text, F.size(words))).alias("em_dash_density"),
        half_even(transition_ratio(text)).alias("transition_start_ratio"),
    )


def slop_score(s: Column | dict[str, Column], boilerplate: Column, has_byline: Column, has_date: Column, n_words: Column) -> Column:
    """One score from signals and metadata, higher being worse."""
    thin = F.when(n_words < 50, 0.25).when(n_words < 150, 0.15).when(n_words < 400, 0.08).otherwise(0.0)
    total = (
        F.least(F.lit(1.0), s["slop_vocab_ratio"] * 30) * 0.06
        + F.least(F.lit(1.0), s["slop_phrase_count"] / 3) * 0.06
        + F.greatest(F.lit(0.0), 1 - s["sentence_length_cv"] / 0.25) * 0.03
        + F.least(F.lit(1.0), boilerplate / 0.5) * 0.35
        + thin
        + F.when(has_date, 0.0).otherwise(0.15)
        + F.when(has_byline, 0.0).otherwise(0.10)
    )
    return half_even(F.least(F.lit(1.0), total))


# Hidden payloads: kind to its run pattern and the least number of distinct characters.
PAYLOADS = {
    "tag_block": ("[\\x{E0000}-\\x{E007F}]{6,}", 1),
    "variation_selector": ("[\\x{FE00}-\\x{FE0F}\\x{E0100}-\\x{E01EF}]{6,}", 3),
    "zero_width": ("[\\x{200B}-\\x{200F}\\x{2060}-\\x{2064}\\x{FEFF}]{16,}", 2),
}
_TAGS = "".join(chr(0xE0000 + i) for i in range(128))
_ASCII = "".join(map(chr, range(128)))


def decode_tags(run: Column) -> Column:
    """The ASCII text that a run of tag characters spells."""
    return F.translate(run, _TAGS[1:], _ASCII[1:])


def payloads(text: Column) -> Column:
    """Array of (kind, raw, decoded) hidden runs that can carry a message; empty for null."""
    text = F.coalesce(text, F.lit(""))

    def printable(run: Column) -> Column:
        return F.length(F.regexp_replace(decode_tags(run), r"[^ -~\n\t]", "")) >= 0.9 * F.length(run)

    def varied(least: int) -> Callable[[Column], Column]:
        return lambda run: F.size(F.array_distinct(F.split(run, ""))) >= least

    def record(kind: str) -> Callable[[Column], Column]:
        decoded = decode_tags if kind == "tag_block" else lambda _: F.lit(None).cast("string")
        return lambda run: F.struct(F.lit(kind).alias("kind"), run.alias("raw"), decoded(run).alias("decoded"))

    found = []
    for kind, (pattern, least) in PAYLOADS.items():
        runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        kept = F.filter(runs, printable if kind == "tag_block" else varied(least))
        found.append(F.transform(kept, record(kind)))
    return F.concat(*found)


def payload_digest(payload: Column) -> Column:
    return F.sha2(F.coalesce(payload["decoded"], payload["raw"]), 256)


def redact(text: Column) -> Column:
    """``text`` without its runs of hidden characters."""
    return reduce(lambda t, p: F.regexp_replace(t, p[0], ""), PAYLOADS.values(), text)
