"""Main content of pages by site style trees.

The pages of a host are merged into one tree of container paths.  What a container itself shows has
content importance: a wording on n of the m pages that have the container has entropy log_m n, so
repeated menu entries carry next to nothing and unique sentences everything; the mean of one minus
entropy over its text, weighted by length.  Its presentation, the sequence of its children on a page,
has importance by the entropy of the l presentations seen, believed by 1 - 0.9^l; content of little
importance gains from a presentation that varies.  Importance is carried up: a branch has that of all
text below it, each presentation on the way adding its share.

A piece of text is chrome if its container is of low importance, or if a branch it stands in is of very
low importance: such a branch goes with all below it.  The fewer pages of a host have a container, the
more what is known of it over all hosts counts.

Markdown has no tree.  Its lines are matched, by wording, with text whose branch is known from HTML;
unmatched lines follow known chrome of the block they stand in that outweighs them; everything else is
main body.

Defined results: null, empty and damaged fields have no chrome and no main body; a page all of whose
text is chrome by the tree (an error page, a stub) keeps its most important container; redelivered
fetches and pieces repeated in a page count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.llm.pages import html_pages, markdown_lines
from webstrata.session import materialize

IMPORTANCE = 0.85
BRANCH_IMPORTANCE = 0.3
STYLE_DECAY = 0.9
PRIOR_PAGES = 50  # pages of a host that weigh as much as all hosts together
FOLLOW = 4  # an unknown line follows known chrome of its block of at least a quarter of its length


def content_importance(features: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with ``w`` (text, by length) and ``wl`` (text times log of its pages), from the number
    ``n`` of pages and length ``w`` of each wording.  With m pages, importance is 1 - wl / (w log m)."""
    return features.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.log("n")).alias("wl"))


def style_importance(styles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the number ``m`` of pages and ``a``, the believed importance of presentation."""
    x = styles.groupBy(*keys).agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * F.log("n")).alias("nl"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("nl") / (F.col("m") * F.log("m"))).otherwise(1.0)
    return x.select(*keys, "m", (entropy * (1 - F.pow(F.lit(STYLE_DECAY), F.col("l")))).alias("a"))


def style_tree(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """(host, path, m, importance, branch) of every container path of every host: ``importance`` of what
    the container itself shows, ``branch`` the least importance of a branch it stands in.

    ``pages`` has each fetch once, ``layouts`` the chain of paths from the root to each.  Wordings and
    presentations are counted per host, and over all hosts from those counts; all is summed before it is
    joined, and what is joined has one row per path of a host."""
    nodes = pages.select("host", F.inline("nodes"))
    pieces = nodes.select("host", "path", F.inline("pieces")).where("NOT again")
    features = materialize(pieces.groupBy("host", "path", "wording").agg(F.count("*").alias("n"), F.sum("size").alias("w")), "features")
    styles = nodes.groupBy("host", "path", "style").agg(F.count("*").alias("n"))
    everywhere = features.groupBy("path", "wording").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    shapes = materialize(styles, "styles")
    by_host = style_importance(shapes, ["host", "path"]).join(content_importance(features, ["host", "path"]), ["host", "path"], "left")
    overall = style_importance(shapes.groupBy("path", "style").agg(F.sum("n").alias("n")), ["path"]).join(content_importance(everywhere, ["path"]), "path", "left")
    overall = overall.select("path", *(F.col(c).alias(f"{c}_all") for c in ("m", "a", "w", "wl")))

    def content(m: str, w: str, wl: str) -> Column:
        return 1 - F.col(wl) / (F.col(w) * F.log(F.greatest(F.col(m), F.lit(2))))

    def smoothed(own: Column, general: Column) -> Column:
        return (F.col("m") * own + PRIOR_PAGES * general) / (F.col("m") + PRIOR_PAGES)

    shown = smoothed(content("m", "w", "wl"), content("m_all", "w_all", "wl_all"))
    x = by_host.join(overall, "path").select("host", "path", "m", "w", smoothed(F.col("a"), F.col("a_all")).alias("a"), shown.alias("content"))
    tree = materialize(x, "tree")
    # the way of each container that shows text up to the root, with the presentations on it
    up = tree.where("w > 0").join(layouts, "path").select("host", "path", "w", "content", F.posexplode("chain").alias("depth", "ancestor"))
    presented = tree.select("host", F.col("path").alias("ancestor"), "a")
    rising = up.join(presented, ["host", "ancestor"]).groupBy("host", "path").agg(
        F.max("w").alias("w"), F.max("content").alias("content"), F.array_sort(F.collect_list(F.struct("depth", "ancestor", "a"))).alias("way")
    )
    # what is unimportant about the text, less what each presentation from it up to the ancestor adds
    dull = F.col("w") * (1 - F.col("content"))
    share = F.aggregate(F.slice("way", F.col("depth") + 1, F.size("way")), F.lit(1.0), lambda p, x: p * (1 - x["a"]))
    ways = materialize(rising, "ways")
    at = ways.select("host", "path", "w", "way", dull.alias("dull"), F.posexplode("way").alias("depth", "at"))
    branches = at.select("host", F.col("at.ancestor").alias("ancestor"), "w", (F.col("dull") * share).alias("dull"))
    branches = branches.groupBy("host", "ancestor").agg((1 - F.sum("dull") / F.sum("w")).alias("branch"))
    lowest = at.select("host", "path", F.col("at.ancestor").alias("ancestor")).join(branches, ["host", "ancestor"]).groupBy("host", "path").agg(F.min("branch").alias("branch"))
    lifted = 1 - (1 - F.col("content")) * (1 - F.col("a"))
    return tree.where("w > 0").join(lowest, ["host", "path"]).select("host", "path", "m", lifted.alias("importance"), "branch")


def judge_html(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """(fetch_id, line_no, wording, chrome) of each piece of ``pages``.  A page all of whose text is chrome
    keeps its most important container.

    The join with the tree is followed by a shuffle on another key, so that a host with very many pages
    is split by adaptive skew handling."""
    shown = pages.select("fetch_id", "host", F.inline("nodes")).where("size(pieces) > 0").select("fetch_id", "host", "path", "pieces")
    judged = shown.join(tree.select("host", "path", "importance", "branch"), ["host", "path"])
    low = (F.col("importance") < IMPORTANCE) | (F.col("branch") < BRANCH_IMPORTANCE)
    page = W.partitionBy("fetch_id")
    judged = judged.withColumn("low", low).withColumns({"all_low": F.min("low").over(page), "best": F.max("importance").over(page)})
    chrome = F.col("low") & ~(F.col("all_low") & (F.col("importance") == F.col("best")))
    return judged.select("fetch_id", chrome.alias("chrome"), F.inline("pieces")).select("fetch_id", "line_no", "wording", "chrome")


def wording_evidence(judged: DataFrame) -> DataFrame:
    """(wording, chrome_share, seen): how often a wording stood in chrome, over all HTML."""
    return judged.groupBy("wording").agg(F.avg(F.col("chrome").cast("double")).alias("chrome_share"), F.count("*").alias("seen"))


def judge_page(lines: list[list]) -> np.ndarray:
    """Which lines of one markdown page are chrome.

    ``lines``: (block, kind, chrome share or None, size) in order.  Known lines follow their evidence.
    A block led by known chrome, or whose known lines are mostly chrome, takes along its unknown lines that
    its known chrome outweighs."""
    n = len(lines)
    out = np.zeros(n, bool)
    blocks: dict[int, list[int]] = {}
    for i, (block, kind, share, _) in enumerate(lines):
        blocks.setdefault(block, []).append(i)
        out[i] = kind != "code" and share is not None and share > 0.5
    for members in blocks.values():
        known = [i for i in members if lines[i][2] is not None]
        chrome = [i for i in known if out[i]]
        if not chrome:
            continue
        led = out[members[0]]
        if led or len(chrome) > 0.5 * len(known):
            weight = FOLLOW * sum(lines[i][3] for i in chrome)
            for i in members:
                _, kind, share, size = lines[i]
                if share is None and size <= weight and kind not in ("code", "quote", "row", "heading"):
                    out[i] = True
    return out


def by_page(rows: DataFrame, columns: list[str], judge: Callable[[list[list]], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``judge`` over each page's rows in order; rows arrive sorted, so that a page is a run of
    equal ids, and no page is held but the one at hand."""
    names = ["fetch_id", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, page, out = None, [], []
        target = [x.split() for x in schema.split(", ")]
        types = {"LONG": pa.int64(), "INT": pa.int32(), "STRING": pa.string(), "BOOLEAN": pa.bool_(), "DOUBLE": pa.float64()}

        def emit() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(target)
            return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, target)], names=[n for n, _ in target])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != at:
                    if page:
                        out.extend((at, *x) for x in judge(page))
                        if len(out) > 50_000:
                            yield emit()
                            out = []
                    at, page = row[0], []
                page.append(list(row[1:]))
        if page:
            out.extend((at, *x) for x in judge(page))
        yield emit()

    spread = rows.select(*names).repartition("fetch_id").sortWithinPartitions(*names[:3])
    return spread.mapInArrow(run, schema)


def _merge_rows(rows: list[list]) -> list[list]:
    """One entry per line from its pieces: (line, block, kind, share, size, stats)."""
    lines: dict[int, dict] = {}
    for line, _, block, kind, share, seen, size, stats in rows:
        x = lines.setdefault(line, {"block": block, "kind": kind, "size": size, "stats": stats, "own": None, "parts": []})
        if kind == "heading":
            x["kind"], x["own"] = kind, share
        elif kind == "whole":
            x["own"] = share
        else:
            x["parts"].append((share, seen))
            if x["kind"] == "whole":
                x["kind"] = kind
    out = []
    for line in sorted(lines):
        x = lines[line]
        known = [p for p, _ in x["parts"] if p is not None]
        share = sum(known) / len(known) if known and 2 * len(known) >= len(x["parts"]) else None
        if x["own"] is not None:
            share = x["own"]
        out.append([line, x["block"], "text" if x["kind"] == "plain heading" else x["kind"], share, x["size"], x["stats"]])
    return out


MAIN_SCHEMA = "fetch_id LONG, line_no INT, block INT, kind STRING, size INT, stats INT, chrome BOOLEAN"


def _judge_rows(rows: list[list]) -> Iterator[tuple]:
    lines = _merge_rows(rows)
    chrome = judge_page([[b, k, s, z] for _, b, k, s, z, _ in lines])
    for (line, block, kind, _, size, stats), c in zip(lines, chrome):
        yield line, block, kind, size, stats, bool(c)


def judged_html(fetches: DataFrame) -> DataFrame:
    """Pieces of HTML with their verdict; each page is read once."""
    read = materialize(html_pages(fetches), "html")
    layouts = read.select(F.inline("layouts")).dropDuplicates(["path"])
    pages = materialize(read.select("fetch_id", "host", "nodes").dropDuplicates(["fetch_id"]), "pages")
    return judge_html(pages, materialize(style_tree(pages, layouts), "judged-tree"))


EVIDENCE_COLUMNS = ["line_no", "wording", "block", "kind", "chrome_share", "seen", "size", "stats"]


def judge_markdown(lines: DataFrame, judged: DataFrame) -> DataFrame:
    """Markdown lines with their verdict (``MAIN_SCHEMA``), by the evidence of judged HTML."""
    return by_page(lines.join(wording_evidence(judged), "wording", "left"), EVIDENCE_COLUMNS, _judge_rows, MAIN_SCHEMA)


def judged_lines(fetches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chrome of both fields: judged HTML pieces and markdown lines."""
    judged = materialize(judged_html(fetches), "judged")
    return judged, judge_markdown(markdown_lines(fetches, stats=False), judged)


def chrome_lines(fetches: DataFrame) -> DataFrame:
    """(field, fetch_id, line_no) of each line of ``markdown`` or unpacked ``html_gz`` that shows text,
    none of which belongs to the main body."""
    judged, markdown = judged_lines(fetches)
    html = judged.groupBy("fetch_id", "line_no").agg(F.bool_and("chrome").alias("chrome")).where("chrome")
    found = html.select(F.lit("html_gz").alias("field"), "fetch_id", F.col("line_no").cast("long"))
    return found.unionByName(
        markdown.where("chrome").select(F.lit("markdown").alias("field"), "fetch_id", F.col("line_no").cast("long"))
    )


def main_bodies(fetches: DataFrame) -> DataFrame:
    """(fetch_id, main_body): each fetch's markdown without its chrome lines; null stays null."""
    _, markdown = judged_lines(fetches)
    drop = markdown.where("chrome").groupBy("fetch_id").agg(F.collect_set("line_no").alias("drop"))
    texts = fetches.select("fetch_id", "markdown").dropDuplicates(["fetch_id"])
    kept = F.filter(F.split("markdown", "\n"), lambda x, i: ~F.array_contains("drop", i + 1))
    return texts.join(drop, "fetch_id", "left").select(
        "fetch_id", F.when(F.col("drop").isNull(), F.col("markdown")).otherwise(F.array_join(kept, "\n")).alias("main_body")
    )
