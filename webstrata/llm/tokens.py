"""Byte-level BPE of a whole corpus through a lexicon of its frequent words.

Words are counted over all documents; the frequent ones are compiled, with their ids, into a minimal
acyclic transducer which every worker maps into memory; any other word is merged exactly.  Results do
not depend on what the lexicon holds.  Null and empty texts have an empty list of ids.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import sys
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.llm.lexicon import Lexicon, compile_lexicon
from webstrata.session import write_shared

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
LEXICON_WORDS = 50_000
KEPT_WORDS = 300_000
SLICE_CHARS = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _ranges(kind: str) -> str:
    """The code points of a general category's first letter, as the inside of a character class."""
    inside = [unicodedata.category(chr(c))[0] == kind for c in range(sys.maxunicode + 1)]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in edges.reshape(-1, 2))


_PATTERN: list[re.Pattern[str]] = []


def word_pattern() -> re.Pattern[str]:
    """The tokenizer's split pattern; its letter and number classes are spelled out for ``re``."""
    if not _PATTERN:
        letters, numbers = _ranges("L"), _ranges("N")
        _PATTERN.append(re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+"))
    return _PATTERN[0]


_SPACE_RUN = re.compile(r" \s| $")
_AT_WORD = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """``text`` cut before every space that leads a word; no token crosses such a cut, and the space
    belongs to the piece after it.  The first piece has no leading space."""
    return _AT_WORD.split(text) if _SPACE_RUN.search(text) else text.split(" ")


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte-pair merging, lowest rank first and leftmost among equals, in n log n."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n < 48:
        parts = [word[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
            if best == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]
    end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged into another
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if before[i] >= 0:
            p = before[i]
            if (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Rows(dict):
    """Piece to its row in the encoder's table; a missing piece is encoded when first asked for."""

    def __init__(self, encoder: Encoder, lead: str) -> None:
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> int:
        row = self[piece] = self.encoder.add(self.lead + piece)
        return row


class Encoder:
    """Encodes many texts at once: every distinct piece is encoded once and its ids are gathered."""

    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None = None) -> None:
        self.ranks, self.lexicon, self.split = ranks, lexicon, word_pattern().findall
        self.clear()

    def clear(self) -> None:
        self.first, self.later = _Rows(self, ""), _Rows(self, " ")
        self.ids: list[int] = []
        self.starts: list[int] = [0]

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        found = self.lexicon.get(raw) if self.lexicon is not None else None
        return merge(raw, self.ranks) if found is None else found

    def add(self, piece: str) -> int:
        for word in self.split(piece):
            self.ids.extend(self.word(word))
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all pieces in order, and where each text's rows end."""
        if len(self.starts) > KEPT_WORDS:
            self.clear()
        out: list[int] = []
        ends = []
        later = self.later.__getitem__
        for text in texts:
            if text:
                cut = pieces(text)
                out.append(self.first[cut[0]])
                out.extend(map(later, islice(cut, 1, None)))
            ends.append(len(out))
        return np.array(out, np.int64), np.array(ends, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the offsets of each text's list."""
        rows, ends = self.rows(texts)
        starts = np.array(self.starts, np.int64)
        begin, length = starts[rows], starts[rows + 1] - starts[rows]
        to = np.concatenate([[0], np.cumsum(length)])
        at = np.repeat(begin - to[:-1], length) + np.arange(to[-1])
        return np.array(self.ids, np.int32)[at], np.concatenate([[0], to[ends]])

    def count(self, texts: list[str | None]) -> np.ndarray:
        rows, ends = self.rows(texts)
        starts = np.array(self.starts, np.int64)
        to = np.concatenate([[0], np.cumsum(starts[rows + 1] - starts[rows])])
        return np.diff(np.concatenate([[0], to[ends]]))


def text_slices(batch: pa.RecordBatch, column: int, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``chars`` of text, a longer text alone: memory stays bounded."""
    size = np.asarray(pc.coalesce(pc.utf8_length(batch.column(column)), 0)).astype(np.int64)
    group = np.cumsum(size) // chars
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, the words of the tokenizer's split pattern; counted within a task
    before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: Counter[str] = Counter()
        later: Counter[str] = Counter()
        split = word_pattern().findall

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for counts, lead in ((first, ""), (later, " ")):
                for piece, n in counts.items():
                    for word in split(lead + piece):
                        words[word] += n
                counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    cut = pieces(value)
                    first[cut[0]] += 1
                    later.update(islice(cut, 1, None))
                if len(first) + len(later) > KEPT_WORDS:
                    yield flush()
        yield flush()

    return documents.select(text).mapInArrow(run, "word STRING, n LONG").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, ranks: dict[bytes, int], text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the ``words`` most frequent words of the corpus and send the file to the executors;
    its name is returned.  The bound on ``words`` bounds what the driver receives; counts are over
    all documents."""
    top = word_counts(documents, text).where("n > 1").orderBy(F.desc("n"), "word").limit(words).select("word")
    frequent = [r.word for r in top.toLocalIterator()]
    compiled = compile_lexicon((w.encode(), merge(w.encode(), ranks)) for w in frequent)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    documents.sparkSession.sparkContext.addFile(write_shared(documents.sparkSession, name, compiled))
    return name


def tokenizer_ranks(spark: SparkSession, directory: str = TOKENIZERS, name: str = BYTE_BPE):  # noqa: ANN201
    """The tokenizer's merge ranks, broadcast: a public file of fixed size, about a megabyte."""
    return spark.sparkContext.broadcast(load_ranks(os.path.join(directory, name)))


def encode_corpus(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", directory: str = TOKENIZERS, lexicon_words: int = LEXICON_WORDS
) -> DataFrame:
    """(doc_id, ids) of every row.  Tasks read, encode and emit; no text is shuffled."""
    ranks = tokenizer_ranks(documents.sparkSession, directory)
    name = build_lexicon(documents, ranks.value, text, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, Lexicon(SparkFiles.get(name)))
        for whole in batches:
            for batch in text_slices(whole, 1):
                ids, offsets = encoder.encode(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id LONG, ids ARRAY<INT>")


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", directory: str = TOKENIZERS) -> DataFrame:
    """(doc_id, n_tokens) of every row, 0 for null and empty texts."""
    ranks = tokenizer_ranks(documents.sparkSession, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for whole in batches:
            for batch in text_slices(whole, 1):
                n = encoder.count(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("long"), text).mapInArrow(run, "doc_id LONG, n_tokens LONG")


def decode_corpus(encoded: DataFrame, directory: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the inverse of ``encode_corpus``; no ids give an empty text."""
    ranks = tokenizer_ranks(encoded.sparkSession, directory)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {i: b for b, i in ranks.value.items()}.__getitem__
        for batch in batches:
            texts = [b"".join(map(piece, ids or ())).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.large_string()).cast(pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id LONG, text STRING")
