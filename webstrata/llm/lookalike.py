"""One consistent form for text that looks the same.

Code points, and strings of them, are joined into look-alike classes by union-find: a character with
its canonical parts, its other widths, its no-break forms, its ligature parts, and letters of other
scripts drawn alike; invisible format characters join the empty string.  The member that is most
frequent in the corpus stands for its class, and a multi-pattern automaton rewrites all others, the
longest match first.  A run of blanks becomes one space, outer blanks go.

What a reader can tell apart stays: case, accents, punctuation, superscripts.  Null stays null; an
empty or blank text becomes empty.

A form is made for comparing, not for reading: letters of a whole word of another script that are drawn
alike go to the more frequent script with the rest.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.session import materialize

# Letters of other scripts that are drawn as the Latin letter before the colon.
HOMOGLYPHS = """
A:АΑ B:ВΒ C:С E:ЕΕ F:Ϝ H:НΗ I:ІΙӀ J:Ј K:КΚ M:МΜ N:Ν O:ОΟ P:РΡ Q:Ԛ S:Ѕ T:ТΤ V:Ѵ W:Ԝ X:ХΧ Y:ҮΥ Z:Ζ
a:а c:сϲ d:ԁ e:е h:һ i:і j:јϳ l:ӏ o:оο p:р q:ԛ s:ѕ v:ѵ w:ԝ x:х y:у
"""
# Dashes drawn as a hyphen.
HYPHENS = "-‐‑"
INVISIBLE = "​‌‍⁠⁡⁢⁣⁤﻿­᠎͏"
_SAME_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<small>", "<vertical>"}
_BLANKS = re.compile(r"\s+")


class Classes:
    """Union-find over strings; a single code point is a string of one."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _parts(c: str) -> str | None:
    """The string ``c`` is drawn as by its own entry in the character database, or None."""
    if c in INVISIBLE:
        return ""
    if unicodedata.category(c) == "Zs":
        return " " if c != " " else None
    if c in HYPHENS:
        return "-" if c != "-" else None
    found = unicodedata.decomposition(c).split()
    if not found:
        return None
    tag = found.pop(0) if found[0].startswith("<") else ""
    ligature = tag == "<compat>" and "LIGATURE" in unicodedata.name(c, "")
    if tag and tag not in _SAME_TAGS and not ligature:
        return None
    return "".join(chr(int(x, 16)) for x in found)


def lookalike_rules(counts: dict[int, int]) -> dict[str, str]:
    """Member string to representative, for the code points that occur (``counts`` over the corpus)."""
    classes = Classes()
    alike = {c: latin for latin, others in (x.split(":") for x in HOMOGLYPHS.split()) for c in others}
    present = {chr(c) for c in counts}
    for c in present:
        if c in alike:
            classes.union(c, alike[c])
    # letters first, so that strings can be spelled by the letters' classes
    spelled: dict[str, str] = {}

    def spell(c: str) -> str:
        if c not in spelled:
            parts = _parts(c)
            spelled[c] = classes.find(c) if parts is None else "".join(map(spell, unicodedata.normalize("NFD", parts)))
        return spelled[c]

    for c in present:
        classes.union(c, spell(c))
    members: dict[str, set[str]] = defaultdict(set)
    for c in present:
        members[classes.find(c)].add(c)
    letters = {root: m for root, m in members.items()}
    for root in list(members):
        written = next((spell(c) for c in members[root]), root)
        if len(written) > 1:  # every way to write the string by members of its letters' classes
            ways = [""]
            for x in written:
                ways = [w + m for w in ways for m in sorted({x, *letters.get(classes.find(x), ())}) if len(m) == 1]
            members[root].update(ways)
    rules = {}
    for root, found in members.items():
        if root == "" or "" in found or classes.find("") == root:
            rules.update(dict.fromkeys((m for m in found if m), ""))
            continue

        def weight(m: str) -> tuple[bool, int, str]:
            return (len(m) == 1, min(counts.get(ord(x), 0) for x in m), m)

        best = max(found, key=weight)
        rules.update((m, best) for m in found if m != best)
    return rules


class Rewriter:
    """Greedy leftmost-longest rewriting of class members by their representative."""

    def __init__(self, rules: dict[str, str]) -> None:
        self.automaton = ahocorasick.Automaton()
        for member, best in rules.items():
            self.automaton.add_word(member, (len(member), best))
        self.empty = not rules
        if rules:
            self.automaton.make_automaton()
        self.plain = all(not m.isascii() for m in rules)

    def __call__(self, text: str) -> str:
        if not self.empty and not (self.plain and text.isascii()):
            out, at = [], 0
            for end, (size, best) in self.automaton.iter_long(text):
                start = end - size + 1
                if start > at:
                    out.append(text[at:start])
                out.append(best)
                at = end + 1
            if at:
                out.append(text[at:])
                text = "".join(out)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)  # the order of several marks
        return _BLANKS.sub(" ", text).strip()


def code_point_counts(df: DataFrame, columns: list[str]) -> dict[int, int]:
    """How often each code point occurs in all of ``columns``; at most one row per code point of
    Unicode reaches the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for batch in batches:
            for column in batch.columns:
                values = [x for x in column.to_pylist() if x]
                for i in range(0, len(values), 256):
                    points = np.frombuffer("".join(values[i : i + 256]).encode("utf-32-le", "surrogatepass"), np.uint32)
                    seen = np.bincount(points)
                    total[: len(seen)] += seen
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["cp", "n"])

    rows = df.select(*columns).mapInArrow(run, "cp INT, n LONG").groupBy("cp").agg(F.sum("n").alias("n")).collect()
    return {r.cp: r.n for r in rows}


def canonical_forms(fetches: DataFrame, columns: list[str] = ("title", "markdown"), record_id: str = "fetch_id") -> DataFrame:
    """``record_id`` and each of ``columns`` in its one form; a row per row of the input."""
    columns = list(columns)
    rules = lookalike_rules(code_point_counts(fetches, columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = Rewriter(rules)
        for batch in batches:
            out = [pa.array([None if x is None else rewrite(x) for x in c.to_pylist()], pa.string()) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[record_id, *columns])

    schema = f"{record_id} LONG, " + ", ".join(f"{c} STRING" for c in columns)
    return fetches.select(F.col(record_id).cast("long"), *columns).mapInArrow(run, schema)


def form_keys(fetches: DataFrame, columns: list[str] = ("title", "markdown")) -> DataFrame:
    """(field, fetch_id, raw, form): 128-bit digests of each non-null text and of its one form.  Only
    digests leave the task that read the text."""
    columns = list(columns)
    rules = lookalike_rules(code_point_counts(fetches, columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite, digest = Rewriter(rules), xxhash.xxh3_128_digest
        for batch in batches:
            ids = batch.column(0)
            for name, column in zip(columns, batch.columns[1:]):
                texts = column.to_pylist()
                keep = [i for i, x in enumerate(texts) if x is not None]
                raw = [digest(texts[i].encode()) for i in keep]
                form = [digest(rewrite(texts[i]).encode()) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(keep), pa.string()), ids.take(pa.array(keep, pa.int64())), pa.array(raw, pa.binary()), pa.array(form, pa.binary())],
                    names=["field", "fetch_id", "raw", "form"],
                )

    return fetches.select(F.col("fetch_id").cast("long"), *columns).mapInArrow(run, "field STRING, fetch_id LONG, raw BINARY, form BINARY")


def lookalike_members(fetches: DataFrame, columns: list[str] = ("title", "markdown")) -> DataFrame:
    """The rows of ``form_keys`` whose form is written in at least two ways, redelivered rows once."""
    keys = materialize(form_keys(fetches, columns), "forms")
    several = keys.groupBy("field", "form").agg(F.min("raw").alias("a"), F.max("raw").alias("b")).where("a <> b").select("field", "form")
    return materialize(keys.where("fetch_id IS NOT NULL").join(several, ["field", "form"], "left_semi").distinct(), "members")


def lookalike_classes(fetches: DataFrame, columns: list[str] = ("title", "markdown")) -> DataFrame:
    """(field, class_id, way, fetch_id, n_links): one row per text that differs by character from another
    one that reads the same.  ``class_id`` and ``way`` are digests of the form and of the text as written;
    ``n_links`` is the number of fetches of the class written in another way, so that the sum over all
    rows is twice the number of pairs.  Linear in the fetches, whatever they share."""
    members = lookalike_members(fetches, columns)
    ways = members.groupBy("field", "form", "raw").agg(F.count("*").alias("n"))
    sizes = ways.groupBy("field", "form").agg(F.sum("n").alias("all"))
    others = ways.join(sizes, ["field", "form"]).select("field", "form", "raw", (F.col("all") - F.col("n")).alias("n_links"))
    rows = members.join(others, ["field", "form", "raw"])
    return rows.select("field", F.lower(F.hex("form")).alias("class_id"), F.lower(F.hex("raw")).alias("way"), "fetch_id", "n_links")


def lookalike_pairs(fetches: DataFrame, columns: list[str] = ("title", "markdown")) -> DataFrame:
    """(field, fetch_id_a, fetch_id_b), a < b: texts that differ by character but read the same, out of
    their classes.

    Ways of writing are paired first, and expanded to their fetches after: equal texts never meet.  A
    way shared by very many fetches is split by adaptive skew handling in either expansion.  The output
    has a row per pair, as its columns demand; ``lookalike_classes`` is the linear form."""
    members = materialize(lookalike_classes(fetches, columns).drop("n_links"), "members")
    ways = members.select("field", "class_id", "way").distinct()
    pairs = ways.join(ways.withColumnRenamed("way", "other"), ["field", "class_id"]).where("way < other")
    left = pairs.join(members.withColumnRenamed("fetch_id", "x"), ["field", "class_id", "way"]).drop("way")
    right = members.select("field", "class_id", F.col("way").alias("other"), F.col("fetch_id").alias("y"))
    both = left.join(right, ["field", "class_id", "other"])
    return both.select("field", F.least("x", "y").alias("fetch_id_a"), F.greatest("x", "y").alias("fetch_id_b"))
