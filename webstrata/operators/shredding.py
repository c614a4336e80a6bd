"""Columnar shredding of nested records, and flat tables rebuilt from the level sequences.

Each leaf path of a nested column becomes three flat sequences: repetition levels (at which repeated
ancestor the entry starts anew), definition levels (how many optional or repeated nodes on the path
are present) and values.  A table per repeated ancestor comes back from the levels alone: the place
of an element is a running count of its repetition level, reset wherever an outer one restarts.

All work is on Arrow buffers of one batch; a record never leaves its batch, so nothing is shuffled.
Defined results: a null or empty list leaves one entry whose definition level stops above the
element, which gives no child row; a null element keeps its place but gives no row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS_SCHEMA = "record_id LONG, path STRING, seq LONG, rep INT, def INT, max_def INT, value STRING"


@dataclass
class Levels:
    """One leaf's sequences over a batch; ``row`` is the record's place in the batch."""

    row: np.ndarray
    rep: np.ndarray
    definition: np.ndarray
    max_def: int
    values: pa.Array

    def present(self) -> np.ndarray:
        return self.definition == self.max_def

    def place(self, level: int) -> np.ndarray:
        """1-based place of each entry's ancestor at repetition ``level`` within its parent."""
        starts = np.cumsum(self.rep <= level)
        outer = np.where(self.rep < level, np.arange(len(self.rep)), 0)
        return starts - starts[np.maximum.accumulate(outer)] + 1 if len(starts) else starts


def shred_column(column: pa.Array, path: list[str]) -> Levels:
    """Sequences of the leaf at ``path``; every list on the way is entered."""
    n = len(column)
    row, rep, depth = np.arange(n), np.zeros(n, np.int32), np.zeros(n, np.int32)
    at = np.arange(n)  # place in ``column`` of each entry, -1 once a node above is absent
    steps, level, max_def = list(path), 0, 0
    while True:
        max_def += 1
        valid = np.asarray(column.is_valid()) if len(column) else np.zeros(0, bool)
        here = at >= 0
        here[here] = valid[at[here]]
        depth = depth + here
        at = np.where(here, at, -1)
        if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
            level += 1
            max_def += 1
            offsets = np.asarray(column.offsets).astype(np.int64)
            size = np.zeros(len(at), np.int64)
            size[here] = offsets[at[here] + 1] - offsets[at[here]]
            copies = np.maximum(size, 1)
            first = np.cumsum(copies) - copies
            inner = np.arange(copies.sum()) - np.repeat(first, copies)
            filled = np.repeat(size > 0, copies)
            begin = np.zeros(len(at), np.int64)
            begin[here] = offsets[at[here]]
            at = np.where(filled, np.repeat(begin, copies) + inner, -1)
            row, depth = np.repeat(row, copies), np.repeat(depth, copies) + filled
            rep = np.where(inner > 0, level, np.repeat(rep, copies)).astype(np.int32)
            column = column.values
        elif pa.types.is_struct(column.type):
            if not steps:
                raise ValueError("the path ends above a leaf")
            column = column.field(steps.pop(0))
        else:
            if steps:
                raise ValueError(f"no field {steps[0]!r} below a leaf")
            take = pa.array(np.where(at >= 0, at, 0), mask=at < 0)
            return Levels(row, rep, depth, max_def, column.take(take))


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One array whose buffers start at zero, so that child arrays can be addressed directly."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return pa.concat_arrays([*chunks, pa.array([], column.type)])


def shred(df: DataFrame, record_id: str, column: str, paths: list[list[str]]) -> DataFrame:
    """The level table of ``paths`` below ``column``: one row per entry, ``seq`` from 0 within a
    record and path.  An empty table gives an empty table; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nested = batch.column(0), _whole(batch.column(1))
            for path in paths:
                x = shred_column(nested, path)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(x.row)),
                        pa.array([".".join(path)] * len(x.row), pa.string()),
                        pa.array(_sequence(x), pa.int64()),
                        pa.array(x.rep, pa.int32()),
                        pa.array(x.definition, pa.int32()),
                        pa.array(np.full(len(x.row), x.max_def), pa.int32()),
                        x.values.cast(pa.string()),
                    ],
                    names=["record_id", "path", "seq", "rep", "def", "max_def", "value"],
                )

    return df.select(F.col(record_id).cast("long"), F.col(column)).mapInArrow(run, LEVELS_SCHEMA)


def _sequence(x: Levels) -> np.ndarray:
    starts = np.where(x.rep == 0, np.arange(len(x.rep)), 0)
    return np.arange(len(x.rep)) - np.maximum.accumulate(starts) if len(starts) else starts


def child_rows(
    df: DataFrame, name: str, record_id: str, column: str, key: list[str], child: list[str], child_level: int
) -> DataFrame:
    """The child table of the repeated ancestor at ``child_level`` on the way to ``child``.

    ``key`` is a leaf at or above the parent of that ancestor: its value links a child to its parent.
    ``parent_pos`` is the parent's own place (1 where the parent is the record)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nested = _whole(batch.column(1))
            keys, kids = shred_column(nested, key), shred_column(nested, child)
            at = np.cumsum(kids.rep < child_level) - 1  # a key entry for each parent, in order
            keep = np.flatnonzero(kids.present())
            parent = kids.place(child_level - 1) if child_level > 1 else np.ones(len(kids.rep), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * len(keep), pa.string()),
                    batch.column(0).take(pa.array(kids.row[keep])),
                    pa.array(parent[keep], pa.int64()),
                    keys.values.take(pa.array(at[keep])).cast(pa.string()),
                    pa.array(kids.place(child_level)[keep], pa.int64()),
                    kids.values.take(pa.array(keep)).cast(pa.string()),
                ],
                names=["child_table", "response_id", "parent_pos", "item_key", "child_pos", "child"],
            )

    schema = "child_table STRING, response_id LONG, parent_pos LONG, item_key STRING, child_pos LONG, child STRING"
    return df.select(F.col(record_id).cast("long"), F.col(column)).mapInArrow(run, schema)


def author_names(text: Column) -> Column:
    """The names of one author string, in order: cut at semicolons where it has one, else at commas;
    outer blanks and a closing dot removed.  "et al" and empty pieces keep a place as null."""
    pieces = F.when(text.contains(";"), F.split(text, ";")).otherwise(F.split(text, ","))
    bare = F.transform(pieces, lambda x: F.regexp_replace(x, r"(?U)^\s+|[\s.]+$", ""))
    return F.transform(bare, lambda x: F.when(~F.lower(x).isin("", "et al", "et al."), x))


_APPS = pa.list_(pa.struct([("app", pa.string()), ("dlc", pa.list_(pa.string()))]))


def _strict(_: str) -> None:
    raise ValueError("not a JSON constant")


def _as_text(x: object) -> str | None:
    if x is None or isinstance(x, (dict, list)):
        return None
    return x if isinstance(x, str) else json.dumps(x)


def parse_app_body(body: str | None) -> list[dict] | None:
    """``[{app, dlc}]`` of one body; None where it is null, no JSON, or no object."""
    try:
        found = json.loads(body, parse_constant=_strict, parse_float=str) if body else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(found, dict):
        return None
    out = []
    for app, node in found.items():
        data = node.get("data") if isinstance(node, dict) else None
        dlc = data.get("dlc") if isinstance(data, dict) else None
        out.append({"app": app, "dlc": [_as_text(x) for x in dlc] if isinstance(dlc, list) else None})
    return out


def parse_app_bodies(df: DataFrame) -> DataFrame:
    """``response_id`` and the nested ``apps`` of each JSON body (damaged bodies give null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apps = [parse_app_body(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(apps, _APPS)], names=["response_id", "apps"])

    schema = "response_id LONG, apps ARRAY<STRUCT<app: STRING, dlc: ARRAY<STRING>>>"
    return df.select(F.col("response_id").cast("long"), "body").mapInArrow(run, schema)


def linked_children(crossref: DataFrame, europepmc: DataFrame, appdetails: DataFrame) -> DataFrame:
    """Licences, authors and add-ons as one table of children linked to their records.

    Redelivered responses count once: equal children at equal places of one response collapse, which
    moves only the narrow child rows.  Extra columns of the inputs are not read."""
    licences = crossref.select(
        "response_id",
        F.when(
            F.col("message").isNotNull(),
            F.struct(
                F.col("message.DOI").alias("key"),
                F.transform("message.license", lambda x: x["URL"]).alias("child"),
            ),
        ).alias("item"),
    )
    authors = europepmc.select(
        "response_id",
        F.transform(
            "resultList.result",
            lambda x: F.struct(x["id"].alias("key"), author_names(x["authorString"]).alias("child")),
        ).alias("item"),
    )
    apps = parse_app_bodies(appdetails)
    rows = (
        child_rows(licences, "license", "response_id", "item", ["key"], ["child"], 1)
        .unionByName(child_rows(authors, "author", "response_id", "item", ["key"], ["child"], 2))
        .unionByName(child_rows(apps, "dlc", "response_id", "apps", ["app"], ["dlc"], 2))
    )
    return rows.distinct().drop("parent_pos")
