"""Abusive, hateful and sexual content, scored by terms in their context.

Every distinct token of the corpus is intersected, once per worker, with a trie of lexicon terms under
a Levenshtein automaton, so that misspelled and masked spellings are caught; digits and signs used as
letters, dots or blanks between letters, stretched letters, invisible characters and look-alike letters
are undone first.  Terms found in one sentence add up by language and kind; words that address someone
or name a group raise the score, and reporting, medical, technical and playful words lower it.

What stands between quotation marks is a report if a word of reporting stands within ``WINDOW`` words of
the marks; it is scored apart from what surrounds it, and counts for the share ``QUOTED``.

Null, empty and blank texts score 0.  Repeated documents each get their own row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.abuse_lexicon import LEXICON, REPORTING
from webstrata.llm.abuse_words import ORDINARY
from webstrata.llm.language import COMMON
from webstrata.llm.lookalike import HOMOGLYPHS, INVISIBLE
from webstrata.llm.tokens import text_slices

KINDS = ("abusive", "hateful", "sexual")
THRESHOLDS = {"abusive": 1.2, "hateful": 1.2, "sexual": 1.3}
FUZZY_FROM, FUZZY_TWO_FROM = 4, 11
FUZZY_SHARE = 0.6
KEPT_TOKENS = 200_000
WINDOW, QUOTED = 8, 0.3

_TO_LATIN = str.maketrans({c: latin for latin, others in (x.split(":") for x in HOMOGLYPHS.split()) for c in others})
_TO_CYRILLIC = str.maketrans(dict(zip("AaBCcEeHKMOoPpTXxyi", "АаВСсЕеНКМОоРрТХхуі")))
_DROP = re.compile(f"[{re.escape(INVISIBLE)}]+")
_LEET = str.maketrans("0134578$@!", "oieastbsai")
_LEET_L = str.maketrans("0134578$@!", "oleastbsal")
_STRETCH = re.compile(r"(.)\1{2,}")
_TOKEN = re.compile(r"[^\W_]+(?:[*$@!'’.-]+[^\W_]+)*[*$@]*|[*$@][^\W_][\w*$@]*")
_SINGLES = re.compile(r"(?<!\w)(?:[^\W_] ){3,}[^\W_](?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”»)]*\s+|\n+")
_QUOTE_MARKS = re.compile(r"[“”„«»\"‘]")
_QUOTE = re.compile(r"“[^“”]+”|„[^„“”]+[“”]|«[^«»]+»|»[^«»]+«|\"[^\"]+\"|‘[^‘’]+’(?!\w)")
_WORD = re.compile(r"[^\W\d_]+")
_REPORTING = frozenset(REPORTING.split())
_LETTERS = re.compile(r"[^\W\d_]")
_CYRILLIC = re.compile(r"[а-яё]", re.I)


class Trie:
    """Terms as a trie of dicts; a node's ``""`` entry holds the term that ends there."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for term in terms:
            at = self.root
            for c in term:
                at = at.setdefault(c, {})
            at[""] = term

    def near(self, token: str, edits: int, swaps: bool = False) -> list[str]:
        """The terms closest to ``token`` within ``edits``; ``*`` stands for any letter.  The product
        of the trie and the token's Levenshtein automaton is walked, the automaton's states being bit
        sets of reached positions per number of edits.  With ``swaps``, two neighbouring letters in
        the wrong order are one edit.  The first letter has to agree."""
        n = len(token)
        masks: dict[str, int] = defaultdict(int)
        stars = 0
        for i, c in enumerate(token):
            if c == "*":
                stars |= 1 << i
            else:
                masks[c] |= 1 << i
        first = [self.root[token[0]]] if token[0] in self.root else list(self.root.values()) if token[0] == "*" else []
        end, best, found = 1 << n, edits, []
        start = tuple(((1 << (j + 1)) - 1) << 1 & ((1 << (n + 1)) - 1) for j in range(edits + 1))
        none = (0,) * (edits + 1)
        stack = [(node, start, none, 0) for node in first]
        while stack:
            node, rows, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (cost := next((j for j in range(best + 1) if rows[j] & end), None)) is not None:
                        found = [child] if cost < best or not found else [*found, child]
                        best = cost
                    continue
                own = masks.get(c, 0)
                hit = own | stars
                swap = own & last >> 1
                new = [(rows[0] & hit) << 1]
                for j in range(1, edits + 1):
                    new.append(((rows[j] & hit) << 1) | rows[j - 1] | (rows[j - 1] << 1) | (new[j - 1] << 1) | (before[j - 1] & swap) << 2)
                if any(new[: best + 1]):
                    stack.append((child, tuple(new), rows if swaps else none, own))
        return found


def load_lexicon(text: str = LEXICON) -> dict[str, list[tuple[str, str, float]]]:
    """Term to its (language, role, weight) entries."""
    terms: dict[str, list[tuple[str, str, float]]] = defaultdict(list)
    for line in text.strip().splitlines():
        head, words = line.split(":", 1)
        lang, role = head.split()
        for word in words.split():
            term, _, weight = word.partition("=")
            terms[term].append((lang, role, float(weight or 1)))
    return dict(terms)


def ordinary_words(text: str = ORDINARY) -> frozenset[str]:
    """Words that are never taken as misspelled terms."""
    return frozenset(text.split()) | {w for words in COMMON.values() for w in words.split()}


class Scorer:
    """Scores texts; what a token stands for is worked out once."""

    def __init__(self, lexicon: dict[str, list[tuple[str, str, float]]] | None = None) -> None:
        self.terms = lexicon or load_lexicon()
        self.trie = Trie([t for t in self.terms if len(t) >= 4])
        self.known: dict[str, list[tuple[str, str, float]]] = {}
        self.ordinary = ordinary_words()
        self.chunks = _Chunks(self)

    def spellings(self, token: str) -> Iterator[str]:
        """Ways to read a token, plainest first."""
        token = token.lower()
        yield token
        bare = token.replace("’", "'")
        if "." in bare or "-" in bare or "'" in bare:
            joined = re.sub(r"[.'-]", "", bare)
            if len(joined) * 2 - 1 <= len(bare) + 1:
                bare = joined
                yield bare
            else:
                yield bare.rsplit("'", 1)[-1]
        letters = _LETTERS.findall(bare)
        if letters and any(c.isdigit() or c in "$@!" for c in bare):
            yield bare.rstrip("!").translate(_LEET)
            yield bare.rstrip("!").translate(_LEET_L)
        if _STRETCH.search(bare):
            yield _STRETCH.sub(r"\1", bare)
            yield _STRETCH.sub(r"\1\1", bare)

    def weights(self, token: str) -> list[tuple[str, str, float]]:
        """(language, role, weight) entries of the terms a token stands for.  A spelling that is near a
        term but not equal to it counts for less; a masked one counts for each term it may hide."""
        if token in self.known:
            return self.known[token]
        found, share = [], 1.0
        for way in self.spellings(token):
            if way in self.terms:
                found = [way]
                break
        else:
            for way in self.spellings(token):
                n = len(way)
                if "*" in way:
                    found = self.trie.near(way, 0) if n >= 4 and way[0] != "*" else []
                elif n >= FUZZY_FROM and way.isalpha():
                    if way in self.ordinary:
                        break
                    found = self.trie.near(way, 2 if n >= FUZZY_TWO_FROM else 1, swaps=True)
                    share = FUZZY_SHARE
                if found:
                    break
        best: dict[tuple[str, str], float] = {}
        for term in found:
            for lang, role, weight in self.terms[term]:
                best[lang, role] = max(best.get((lang, role), 0.0), weight * share)
        if len(self.known) > KEPT_TOKENS:
            self.known.clear()
        out = self.known[token] = [(lang, role, weight) for (lang, role), weight in best.items()]
        return out

    def plain(self, text: str) -> str:
        """``text`` without invisible characters, and letters of one script within a word."""
        if not text.isascii():
            text = unicodedata.normalize("NFKC", _DROP.sub("", text))
            if _CYRILLIC.search(text) or re.search(r"[Α-Ωο]", text):
                text = re.sub(r"[^\W\d_]+", _one_script, text)
        if _SINGLES.search(text):
            text = _SINGLES.sub(lambda m: m.group(0).replace(" ", ""), text)
        return text

    def sentence(self, text: str) -> dict[str, float]:
        """Score per kind of one plain sentence."""
        sums: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        seen = set()
        for chunk in text.split():
            for token, weights in self.chunks[chunk]:
                if token not in seen:
                    seen.add(token)
                    for lang, role, weight in weights:
                        sums[lang][role] += weight
        best = dict.fromkeys(KINDS, 0.0)
        for lang in sums:
            x = sums[lang]
            excuse = x["ex"] * 1.2
            address = 0.5 if x["to"] else 0.0
            named = 0.2 if x["ab"] >= 1 else 0.0
            group = x["gr"]
            scores = {
                "abusive": x["ab"] + (address or named) - excuse - (0.6 if group >= 1 and not address else 0) - (0.5 * x["sx"] if x["sx"] > 1.2 else 0),
                "hateful": x["ht"] + (0.5 if group >= 1 else 0.0) - excuse if x["ht"] >= 0.7 else 0.0,
                "sexual": x["sx"] - excuse,
            }
            for kind, score in scores.items():
                best[kind] = max(best[kind], score)
        return best

    def text(self, text: str | None) -> tuple[float, float, float]:
        """The highest score of each kind among sentences; one without any term scores 0."""
        best = [0.0, 0.0, 0.0]
        if text:
            terms = self.chunks.__getitem__
            for part, share in said_parts(self.plain(text)):
                for sentence in _SENTENCE.split(part):
                    if any(map(terms, sentence.split())):
                        scores = self.sentence(sentence)
                        best = [max(b, share * scores[k]) for b, k in zip(best, KINDS)]
        return tuple(round(b, 4) for b in best)

    def terms_of(self, chunk: str) -> tuple[tuple[str, list[tuple[str, str, float]]], ...]:
        """(token, weights) of the tokens of a white-space delimited plain chunk that stand for terms."""
        tokens = [t.rstrip("!") for t in _TOKEN.findall(chunk)]
        return tuple((t.lower(), weights) for t in tokens if (weights := self.weights(t)))

    def texts(self, texts: list[str | None]) -> list[tuple[float, float, float]]:
        """Scores of many texts."""
        if len(self.chunks) > KEPT_TOKENS:
            self.chunks.clear()
        return [self.text(text) for text in texts]


def said_parts(text: str) -> Iterator[tuple[str, float]]:
    """(part, share): the text's own words, and reported ones apart from them."""
    if not _QUOTE_MARKS.search(text):
        yield text, 1.0
        return
    for line in text.split("\n"):
        own, at = [], 0
        for m in _QUOTE.finditer(line) if _QUOTE_MARKS.search(line) else ():
            around = _WORD.findall(line[at : m.start()].lower())[-WINDOW:] + _WORD.findall(line[m.end() :].lower())[:WINDOW]
            if not _REPORTING.isdisjoint(around):
                own.append(line[at : m.start()])
                at = m.end()
                yield m.group(0)[1:-1], QUOTED
        yield " ".join([*own, line[at:]]) if own else line, 1.0


class _Chunks(dict):
    def __init__(self, scorer: Scorer) -> None:
        super().__init__()
        self.scorer = scorer

    def __missing__(self, chunk: str) -> tuple:
        terms = self[chunk] = self.scorer.terms_of(chunk)
        return terms


def _one_script(m: re.Match[str]) -> str:
    """A word written in letters of two scripts, brought to the script of its unmistakable letters."""
    word = m.group(0)
    if word.isascii():
        return word
    latin = word.translate(_TO_LATIN)
    if latin.isascii() or not _CYRILLIC.search(latin):
        if not re.search(r"[A-Za-zÀ-ÿ]", word):  # wholly in the other script: leave real words alone
            return word
        return latin
    return word.translate(_TO_CYRILLIC) if re.search(r"[A-Za-z]", word) else word


def score_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str | None = None) -> DataFrame:
    """(doc_id, abusive, hateful, sexual): scores of every row, nothing shuffled; ``keep`` names a text
    column that is carried along."""
    kept = [keep] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer()
        for whole in batches:
            for batch in text_slices(whole, 1):
                scores = np.array(scorer.texts(batch.column(1).to_pylist()), np.float64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(scores[:, i]) for i in range(3)), *batch.columns[2:]], names=["doc_id", *KINDS, *kept]
                )

    schema = ", ".join(["doc_id LONG", *(f"{k} DOUBLE" for k in KINDS), *(f"`{k}` STRING" for k in kept)])
    return documents.select(F.col(doc_id).cast("long"), text, *kept).mapInArrow(run, schema)


def abusive_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of every document whose score reaches the kind's threshold."""
    hits = F.array_compact(F.array(*[F.when(F.col(k) >= THRESHOLDS[k], F.lit(k)) for k in KINDS]))
    return score_documents(documents).select("doc_id", F.explode(hits).alias("kind"))


def source_rates(documents: DataFrame) -> DataFrame:
    """(source, n_documents, and the share of each kind); null sources form one group."""
    scored = score_documents(documents, keep="source")
    shares = [F.avg((F.col(k) >= THRESHOLDS[k]).cast("double")).alias(f"{k}_share") for k in KINDS]
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), *shares)


def rated_agreement(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, n_rated, both, only_rated, only_scored): per source, how the verdict on rated documents
    compares with the quick human ratings (``toxic`` 0 or 1).  Ratings that are missing do not count."""
    rated = labels.where("toxic IS NOT NULL").select(F.col("doc_id").alias("rated"), (F.col("toxic") == 1).alias("toxic")).dropDuplicates(["rated"])
    found = reduce(lambda a, b: a | b, [F.col(k) >= THRESHOLDS[k] for k in KINDS]).alias("found")
    x = score_documents(documents, keep="source").select("doc_id", "source", found).join(rated, F.col("doc_id") == F.col("rated"))
    return x.groupBy("source").agg(
        F.count("*").alias("n_rated"),
        F.count_if(F.col("found") & F.col("toxic")).alias("both"),
        F.count_if(~F.col("found") & F.col("toxic")).alias("only_rated"),
        F.count_if(F.col("found") & ~F.col("toxic")).alias("only_scored"),
    )
