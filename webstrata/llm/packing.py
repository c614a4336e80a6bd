"""Filling containers of fixed capacity: patterns of few lengths, fitted to the length histogram.

Lengths are counted exactly.  In coarse units, all patterns of up to four lengths that fill a container
are enumerated and their repeat counts fitted to the histogram by non-negative least squares, rounded
down and drawn from the exact lengths; what remains is packed best fit first, longest first, also into
the gaps the patterns left.  The plan only speaks of lengths and counts, so its size depends on the
capacity, not on the number of items; items find their place by their rank among equal lengths.  A length
shared by many items is ranked in parts of about ``RANK_PART``; items that fill a container are each one.

No item is split unless it exceeds the capacity; such an item gives full pieces and one remainder.
Items of length 0 take no space and go to container 0.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.session import materialize

UNITS = 48
PATTERN_LENGTHS = 4
RANK_PART = 50_000
PLAN_BYTES = 64 << 20  # a plan up to this size is sent to the tasks, a larger one is joined as a table
RANK_BLOCK = 4096


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min ||ax - b|| over x >= 0, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[passive] = -np.inf
        enter = int(np.argmax(gradient))
        if gradient[enter] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        passive[enter] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def unit_patterns(units: int, most: int) -> list[tuple[int, ...]]:
    """Multisets of up to ``most`` lengths, in units, that sum to ``units``."""
    out: list[tuple[int, ...]] = [(units,)]
    for n in range(2, most + 1):
        for head in combinations_with_replacement(range(1, units), n - 1):
            last = units - sum(head)
            if last >= head[-1]:
                out.append((*head, last))
    return out


@dataclass
class Group:
    """``count`` containers of equal content: a multiset of lengths."""

    content: Counter[int]
    count: int
    left: int
    pattern: bool = False


def plan_containers(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Groups of equal containers that hold every length of the histogram (lengths 1 to capacity)."""
    supply = {s: n for s, n in histogram.items() if n > 0 and s > 0}
    if any(s > capacity for s in supply):
        raise ValueError("split items above the capacity first")
    groups: list[Group] = []
    units = min(UNITS, capacity)
    of_unit: dict[int, list[int]] = defaultdict(list)
    for s in sorted(supply):
        of_unit[-(-s * units // capacity)].append(s)
    present = np.array([sum(supply[s] for s in of_unit[u]) if u in of_unit else 0 for u in range(1, units + 1)], float)
    patterns = [p for p in unit_patterns(units, PATTERN_LENGTHS) if all(present[u - 1] for u in p)]
    if patterns:
        a = np.zeros((units, len(patterns)))
        for j, p in enumerate(patterns):
            for u in p:
                a[u - 1, j] += 1
        weight = np.arange(1, units + 1) / units  # long items are the hard ones to place
        fitted = nnls(a * weight[:, None], present * weight)
        for j in np.argsort(-fitted):
            if (repeats := int(fitted[j])) > 0:
                groups.extend(_draw(patterns[j], repeats, of_unit, supply, capacity))
    _best_fit(groups, supply, capacity)
    return groups


def _draw(pattern: tuple[int, ...], repeats: int, of_unit: dict[int, list[int]], supply: dict[int, int], capacity: int) -> Iterator[Group]:
    """Up to ``repeats`` containers of a unit pattern, filled with the longest exact lengths left."""
    need = Counter(pattern)
    have = {u: sum(supply.get(s, 0) for s in of_unit[u]) for u in need}
    repeats = min([repeats, *(have[u] // m for u, m in need.items())])
    runs = []  # per place in the pattern: lengths with how many containers in a row take them
    for u in pattern:
        run, missing = [], repeats
        for s in reversed(of_unit[u]):
            if missing and (n := min(missing, supply.get(s, 0))):
                run.append([s, n])
                supply[s] -= n
                missing -= n
        runs.append(run)
    while repeats > 0:
        n = min(run[0][1] for run in runs)
        content = Counter(run[0][0] for run in runs)
        yield Group(content, n, capacity - sum(s * m for s, m in content.items()), True)
        for run in runs:
            run[0][1] -= n
            if not run[0][1]:
                run.pop(0)
        repeats -= n


def _best_fit(groups: list[Group], supply: dict[int, int], capacity: int) -> None:
    """Place what is left, longest first, each into the fullest container that can take it."""
    by_left: dict[int, list[Group]] = defaultdict(list)
    for g in groups:
        by_left[g.left].append(g)
    keys = sorted(k for k in by_left if k)

    def add(g: Group) -> None:
        groups.append(g)
        if g.left:
            if not by_left[g.left]:
                insort(keys, g.left)
            by_left[g.left].append(g)

    for s in sorted(supply, reverse=True):
        n = supply[s]
        while n:
            i = bisect_left(keys, s)
            if i == len(keys):
                each = min(capacity // s, n)
                fill = Group(Counter({s: each}), n // each, capacity - s * each)
                n -= fill.count * each
                add(fill)
                continue
            g = by_left[keys[i]].pop()
            if not by_left[keys[i]]:
                keys.pop(i)
            each = min(g.left // s, n)
            took = min(g.count, n // each)
            if took < g.count:
                rest = Group(g.content, g.count - took, g.left, g.pattern)
                add(rest)
            g.content, g.count, g.left = g.content + Counter({s: each}), took, g.left - s * each
            n -= took * each
            if g.left:
                if not by_left[g.left]:
                    insort(keys, g.left)
                by_left[g.left].append(g)


def slots(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, items per container, first container, rank after the last) ordered by
    length and rank."""
    used: Counter[int] = Counter()
    rows, container = [], 0
    for g in groups:
        for s, each in g.content.items():
            rows.append((s, used[s], each, container, used[s] + each * g.count))
            used[s] += each * g.count
        container += g.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces_of(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Each item once per container kind; one above the capacity in full pieces and a remainder."""
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).distinct()
    rows = [(r.container_kind, r.capacity) for r in kinds.collect()]  # the table of kinds is fixed and tiny
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in rows]))
    if not rows:
        kind = F.explode(F.from_json(F.lit("[]"), "array<struct<container_kind: string, capacity: long>>"))
    last = F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0))
    return (
        sizes.select("doc_id", "n_tokens", kind.alias("k"))
        .select("doc_id", "n_tokens", "k.*")
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select(
            "container_kind", "capacity", "doc_id", "piece",
            (F.col("piece") * F.col("capacity")).alias("start_token"),
            F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("size"),
        )
    )


@dataclass
class Packing:
    """Where every piece goes, and how many containers of each kind a fitted pattern filled."""

    pieces: DataFrame
    containers: dict[str, int]
    from_patterns: dict[str, int]


PLACED = "container_kind STRING, container_id LONG, doc_id LONG, piece LONG, start_token LONG, n_tokens LONG"


def plan_packing(sizes: DataFrame, containers: DataFrame, plan_bytes: int = PLAN_BYTES, rank_part: int = RANK_PART) -> Packing:
    """The packing of every item into containers of every kind.

    The histogram sent to the driver has at most one row per length up to the capacity."""
    spark = sizes.sparkSession
    parts = materialize(pieces_of(sizes, containers), "pieces")
    keys = ["container_kind", "size"]
    counted = parts.groupBy("container_kind", "capacity", "size").agg(F.count("*").alias("n")).collect()
    histograms: dict[tuple[str, int], dict[int, int]] = defaultdict(dict)
    for r in counted:
        histograms[r.container_kind, r.capacity][r["size"]] = r.n
    groups = {kind: plan_containers(h, capacity) for (kind, capacity), h in histograms.items()}
    plans = {kind: slots(g) for kind, g in groups.items()}

    salts = spark.createDataFrame([(r.container_kind, r["size"], -(-r.n // rank_part)) for r in counted], "container_kind STRING, size LONG, salts LONG")
    salted = parts.join(F.broadcast(salts), keys).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    shares = salted.groupBy(*keys, "salt").agg(F.count("*").alias("n"))
    before = W.partitionBy(*keys).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = shares.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy(*keys, "salt").orderBy("doc_id", "piece")
    ranked = (
        salted.withColumn("r", F.row_number().over(within) - 1)
        .join(base, [*keys, "salt"])
        .select("container_kind", (F.col("base") + F.col("r")).alias("rank"), "doc_id", "piece", "start_token", "size")
    )
    small = sum(p.nbytes for p in plans.values()) <= plan_bytes
    placed = _place_by_copy(ranked, plans) if small else _place_by_join(ranked, plans)
    return Packing(placed, {k: sum(g.count for g in v) for k, v in groups.items()}, {k: sum(g.count for g in v if g.pattern) for k, v in groups.items()})


def _place_by_copy(ranked: DataFrame, plans: dict[str, np.ndarray]) -> DataFrame:
    sent = ranked.sparkSession.sparkContext.broadcast(plans)  # its size is checked by the caller

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch.column(0).to_pylist(), object)
            rank, size = (np.asarray(batch.column(i)) for i in (1, 5))
            out = np.zeros(len(kinds), np.int64)
            for kind in set(kinds.tolist()):
                mine = np.flatnonzero((kinds == kind) & (size > 0))
                plan = sent.value[kind]
                if not len(mine):
                    continue
                span = int(max(plan[:, 1].max(), rank[mine].max())) + 1
                slot = plan[np.searchsorted(plan[:, 0] * span + plan[:, 1], size[mine] * span + rank[mine], "right") - 1]
                out[mine] = slot[:, 3] + (rank[mine] - slot[:, 1]) // slot[:, 2]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out), batch.column(2), batch.column(3), batch.column(4), batch.column(5)],
                names=["container_kind", "container_id", "doc_id", "piece", "start_token", "n_tokens"],
            )

    return ranked.mapInArrow(place, PLACED)


def _place_by_join(ranked: DataFrame, plans: dict[str, np.ndarray]) -> DataFrame:
    """The same by a range join: slots are cut at blocks of ranks, so that each item meets those of one
    block only."""
    rows = [(kind, *map(int, row)) for kind, plan in plans.items() for row in plan]
    plan = ranked.sparkSession.createDataFrame(rows, "container_kind STRING, size LONG, first LONG, each LONG, container LONG, `end` LONG")
    block = lambda c: F.floor(c / RANK_BLOCK)
    plan = plan.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("end") - 1))))
    found = ranked.withColumn("block", block(F.col("rank"))).join(plan, ["container_kind", "size", "block"], "left")
    found = found.where("size = 0 OR (rank >= first AND rank < `end`)")
    at = F.when(F.col("size") == 0, 0).otherwise(F.col("container") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    return found.select("container_kind", at.cast("long").alias("container_id"), "doc_id", "piece", "start_token", F.col("size").alias("n_tokens"))


def pack(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start_token, n_tokens): every item in containers of
    every kind.  ``sizes`` has unique ``doc_id`` and ``n_tokens``; an empty table gives an empty result."""
    return plan_packing(sizes, containers).pieces


def fill_report(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens held, the share of the space that is filled, and the share of the
    containers that began as a fitted pattern rather than by best fit."""
    packing = plan_packing(sizes, containers)
    used = packing.pieces.groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    patterns = sizes.sparkSession.createDataFrame([(k, n / max(1, packing.containers[k])) for k, n in packing.from_patterns.items()], "container_kind STRING, pattern_share DOUBLE")
    share = F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    return used.join(containers.select("container_kind", "capacity_tokens"), "container_kind").withColumn("filled", share).join(patterns, "container_kind")


def fill_checks(sizes: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind, what has to hold of a packing: documents placed, and how many containers hold too much,
    documents are split without need, have a gap or overlap, or have another number of tokens."""
    packed = materialize(pack(sizes, containers), "packed").join(containers.select("container_kind", "capacity_tokens").distinct(), "container_kind")
    loads = packed.where("n_tokens > 0").groupBy("container_kind", "container_id").agg((F.sum("n_tokens") > F.max("capacity_tokens")).alias("over"))
    loads = loads.groupBy("container_kind").agg(F.count_if("over").alias("overfull"))
    docs = packed.groupBy("container_kind", "doc_id").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("held"), F.max(F.col("start_token") + F.col("n_tokens")).alias("reach"), F.max("capacity_tokens").alias("capacity")
    )
    docs = docs.join(sizes, "doc_id")
    checks = docs.groupBy("container_kind").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("pieces") != F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")), F.lit(1))).alias("split_wrongly"),
        F.count_if((F.col("held") != F.col("n_tokens")) | (F.col("reach") != F.col("n_tokens"))).alias("gaps"),
    )
    return checks.join(loads, "container_kind", "left").select("container_kind", "documents", "split_wrongly", "gaps", F.coalesce("overfull", F.lit(0).cast("long")).alias("overfull"))
