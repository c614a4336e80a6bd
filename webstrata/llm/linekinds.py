"""Prose, lists, tables and junk: a hidden Markov model over the lines of each text.

Every line has a code of statistics (length, marks, ends, digits, symbols, vowels, common words ...);
a state emits each of them independently, and states tend to last.  Emissions start from stated values
and are re-estimated on a bounded sample by Viterbi training, the stated values counting as many
lines.  The best path labels each line; label shares by characters describe the document.

Null, empty and blank texts have no lines, and shares of 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.chrome import EVIDENCE_COLUMNS, _merge_rows, by_page, judge_page, judged_html, wording_evidence
from webstrata.llm.language import COMMON, FILLER
from webstrata.llm.pages import STAT_BITS, markdown_lines, markdown_pieces
from webstrata.llm.residue import Judge, fit_classifier
from webstrata.llm.sampling import bounded_sample

STATES = ("prose", "list", "table", "junk")
SAMPLE_RECORDS = 2000
TRAINING_ROUNDS, PRIOR_LINES = 3, 400

# Stated values: the chance that a line of the state has the statistic.
#              prose   list   table  junk
EMISSION = {
    "bullet": (0.020, 0.600, 0.005, 0.010),
    "columns": (0.005, 0.010, 0.930, 0.060),
    "ends": (0.850, 0.010, 0.005, 0.050),
    "long": (0.700, 0.060, 0.040, 0.250),
    "digits": (0.010, 0.300, 0.600, 0.200),
    "symbols": (0.004, 0.030, 0.250, 0.250),
    "unbroken": (0.002, 0.002, 0.002, 0.550),
    "no_vowels": (0.001, 0.003, 0.010, 0.450),
    "short": (0.100, 0.930, 0.700, 0.450),
    "garbled": (0.001, 0.001, 0.001, 0.250),
    "fenced": (0.060, 0.002, 0.002, 0.010),
    "items": (0.004, 0.120, 0.020, 0.010),
    "linked": (0.020, 0.250, 0.005, 0.002),
    "rule": (0.010, 0.005, 0.050, 0.010),
    "uncommon": (0.002, 0.020, 0.010, 0.450),
    "repeats": (0.010, 0.010, 0.010, 0.200),
}
START = (0.55, 0.2, 0.15, 0.1)
STAY = 0.9


class LineModel:
    """The Markov model; a code's emissions are worked out once."""

    def __init__(self, emission: np.ndarray | None = None) -> None:
        p = np.array([EMISSION[b] for b in STAT_BITS]) if emission is None else emission
        self.on, self.off = np.log(p), np.log1p(-p)
        self.start = [math.log(x) for x in START]
        move = math.log((1 - STAY) / (len(STATES) - 1))
        self.moves = [[math.log(STAY) if a == b else move for b in range(len(STATES))] for a in range(len(STATES))]
        self.codes: dict[int, list[float]] = {}

    def emit(self, code: int) -> list[float]:
        if code not in self.codes:
            has = np.array([code >> i & 1 for i in range(len(STAT_BITS))], bool)[:, None]
            self.codes[code] = np.where(has, self.on, self.off).sum(axis=0).tolist()
        return self.codes[code]

    def states(self, codes: list[int]) -> list[int]:
        """The most probable state of each line."""
        if not codes:
            return []
        n = range(len(STATES))
        score = [self.start[s] + e for s, e in zip(n, self.emit(codes[0]))]
        back = []
        stay, move = self.moves[0][0], self.moves[0][1]
        for code in codes[1:]:
            best = max(n, key=score.__getitem__)
            lead = score[best] + move
            emit = self.emit(code)
            from_ = [s if score[s] + stay >= lead else best for s in n]
            score = [max(score[s] + stay, lead) + emit[s] for s in n]
            back.append(from_)
        at = max(n, key=score.__getitem__)
        path = [at]
        for from_ in reversed(back):
            at = from_[at]
            path.append(at)
        return path[::-1]


def line_codes(markdown: str | None, known: dict[str, tuple]) -> list[tuple[int, int]]:
    """(code, size) of each line that is not blank; headings count as prose around them."""
    return [(stats, size) for _, _, _, _, size, stats in markdown_pieces(markdown or "", known)]


def train_model(texts: list[str]) -> np.ndarray:
    """Emissions after Viterbi training on ``texts``, held to the stated ones by ``PRIOR_LINES``."""
    known: dict[str, tuple] = {}
    pages = [[c for c, _ in line_codes(t, known)] for t in texts]
    prior = np.array([EMISSION[b] for b in STAT_BITS])
    emission = prior
    for _ in range(TRAINING_ROUNDS):
        model = LineModel(emission)
        ones, total = prior * PRIOR_LINES, np.full(len(STATES), float(PRIOR_LINES))
        counts: Counter[tuple[int, int]] = Counter()
        for page in pages:
            counts.update(zip(page, model.states(page)))
        for (code, state), n in counts.items():
            total[state] += n
            for i in range(len(STAT_BITS)):
                if code >> i & 1:
                    ones[i, state] += n
        emission = np.clip(ones / total, 1e-4, 1 - 1e-4)
    return emission


def fit_lines(fetches: DataFrame, sample_records: int = SAMPLE_RECORDS) -> np.ndarray:
    """Emissions fitted to at most ``sample_records`` texts, chosen by the hash of their id."""
    sample = bounded_sample(fetches, "fetch_id", sample_records).select("markdown")
    return train_model([r.markdown for r in sample.collect()])


def shares(lines: list[tuple[int, int]], model: LineModel) -> tuple[list[int], int]:
    """Characters per state, and in all."""
    chars = [0] * len(STATES)
    for state, (_, size) in zip(model.states([c for c, _ in lines]), lines):
        chars[state] += size
    return chars, sum(chars)


def label_shares(fetches: DataFrame) -> DataFrame:
    """(fetch_id, n_lines, share of each label by characters) of every row's whole markdown."""
    sent = fetches.sparkSession.sparkContext.broadcast(fit_lines(fetches))  # a small fixed matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = LineModel(sent.value), {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                lines = line_codes(text, known)
                chars, total = shares(lines, model)
                out.append((len(lines), *(round(c / total, 4) if total else 0.0 for c in chars)))
            columns = list(zip(*out)) or [()] * (1 + len(STATES))
            arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.float64()) for c in columns[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["fetch_id", "n_lines", *(f"{s}_share" for s in STATES)])

    schema = "fetch_id LONG, n_lines INT, " + ", ".join(f"{s}_share DOUBLE" for s in STATES)
    return fetches.select(F.col("fetch_id").cast("long"), "markdown").mapInArrow(run, schema)


def text_statistics(fetches: DataFrame) -> DataFrame:
    """Counts and ratios of each markdown on built-in expressions, beside the recorded ones; null texts
    give nulls, empty ones zeros."""
    common = sorted({w for lang, words in COMMON.items() if lang != FILLER for w in words.split() if len(w) > 1})
    text = F.col("markdown")
    words = F.filter(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}'’-]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    x = fetches.select("fetch_id", "markdown", F.col("word_count").alias("recorded_words"), "quality_json").withColumns({"w": words, "l": lines})
    n = F.size("w")
    of = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(0.0), 4)
    total = F.aggregate("w", F.lit(0), lambda a, w: a + F.length(w))
    ending = F.size(F.filter("l", lambda y: y.rlike(r"[.!?…][\"'”»)*_]*\s*$")))
    return x.select(
        "fetch_id",
        F.when(text.isNotNull(), n).alias("words"),
        F.when(text.isNotNull(), of(total, n)).alias("mean_word_length"),
        F.when(text.isNotNull(), of(F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", "")), F.length(text))).alias("symbol_ratio"),
        F.when(text.isNotNull(), of(ending, F.size("l"))).alias("ending_share"),
        F.when(text.isNotNull(), of(F.size(F.filter("w", lambda w: w.isin(*common))), n)).alias("common_share"),
        "recorded_words",
        F.try_parse_json("quality_json").isNotNull().alias("quality_is_json"),
    ).dropDuplicates(["fetch_id"])  # the narrow result is shuffled, not the texts


def _kind(rows: list[list], model: LineModel) -> Iterator[tuple]:
    """The label of most characters of one page's main body, unless that is prose."""
    lines = _merge_rows(rows)
    chrome = judge_page([[b, k, s, z] for _, b, k, s, z, _ in lines])
    main = [(stats, size) for (_, _, _, _, size, stats), c in zip(lines, chrome) if not c]
    chars, total = shares(main, model)
    for state, n in zip(STATES, chars):
        if state != "prose" and 2 * n > total:
            yield (state,)


def unreadable_records(fetches: DataFrame) -> DataFrame:
    """(fetch_id, kind): records whose main body is mostly list, table or junk; residue left out.

    The main body of every record is judged, its chrome being known from the HTML of all pages; the
    classifier of residue reads the few records found."""
    context = fetches.sparkSession.sparkContext
    emission = context.broadcast(fit_lines(fetches))
    weights = context.broadcast(fit_classifier(fetches))

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(weights.value)
        for batch in batches:
            kept = pa.array([not judge.record(*x)[1] for x in zip(*(c.to_pylist() for c in batch.columns[2:]))], pa.bool_())
            yield batch.select([0, 1]).filter(kept)

    model = LineModel(emission.value)
    rows = markdown_lines(fetches).join(wording_evidence(judged_html(fetches)), "wording", "left")
    found = by_page(rows, EVIDENCE_COLUMNS, lambda rows: _kind(rows, model), "fetch_id LONG, kind STRING").distinct()
    texts = fetches.select(F.col("fetch_id").cast("long").alias("id"), "markdown", "title", "failure_reason")
    labelled = found.join(texts, F.col("fetch_id").eqNullSafe(F.col("id"))).select("fetch_id", "kind", "markdown", "title", "failure_reason")
    return labelled.mapInArrow(content, "fetch_id LONG, kind STRING").distinct()
