"""Recorded inputs as DataFrames: event logs, sitemaps, feeds, block lists, plain texts, documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.session import materialize

EVENT_SCHEMA = (
    "tool STRING, outcome STRING, mode_used STRING, failure_reason STRING, provider STRING, from_cache BOOLEAN, duration_ms LONG, network_ms LONG, parse_ms LONG, "
    "cache_write_ms LONG, escalated_from STRING, result_count LONG, url STRING, input_tokens LONG, output_tokens LONG, cost_usd DOUBLE, fell_back BOOLEAN, ts STRING"
)


def event_log(spark: SparkSession, folder: str, last_day: str, days: int = 1) -> DataFrame:
    """Events of the daily JSON-line files of the last ``days`` days; malformed and blank lines are dropped.

    Files are named by their day; a glob of the wanted names keeps all others unread."""
    from datetime import date, timedelta

    last = date.fromisoformat(last_day)
    names = ",".join((last - timedelta(days=k)).isoformat() for k in range(max(1, days)))
    reader = spark.read.schema(EVENT_SCHEMA).option("mode", "DROPMALFORMED").option("pathGlobFilter", f"{{{names}}}.jsonl")
    return reader.json(folder)


def event_lines(lines: Column) -> Column:
    """An event out of one JSON line, or null where it is malformed."""
    return F.when(F.try_parse_json(lines).isNotNull(), F.from_json(lines, EVENT_SCHEMA))


def sitemap_entries(body: Column) -> Column:
    """(loc, lastmod) of a sitemap's addresses; an index or damaged body has none."""
    well_formed = body.rlike(r"(?s)<urlset\b.*</urlset>\s*$")
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))
    field = lambda b, tag: F.nullif(F.trim(F.regexp_extract(b, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    entries = F.transform(blocks, lambda b: F.struct(_unescape(field(b, "loc")).alias("loc"), field(b, "lastmod").alias("lastmod")))
    return F.when(well_formed, F.filter(entries, lambda e: e["loc"].isNotNull())).otherwise(F.array().cast("array<struct<loc: string, lastmod: string>>"))


def sitemap_children(body: Column) -> Column:
    """Addresses of the sitemaps that an index lists."""
    blocks = F.regexp_extract_all(body, F.lit(r"(?s)<sitemap>.*?<loc>\s*(.*?)\s*</loc>.*?</sitemap>"), F.lit(1))
    return F.transform(blocks, _unescape)


def feed_links(body: Column) -> Column:
    """Links of RSS items and Atom entries."""
    rss = F.regexp_extract_all(body, F.lit(r"(?s)<item\b.*?<link>\s*(.*?)\s*</link>.*?</item>"), F.lit(1))
    atom = F.regexp_extract_all(body, F.lit(r"""(?s)<entry\b.*?<link[^>]*href=["']([^"']*)["'].*?</entry>"""), F.lit(1))
    return F.transform(F.concat(rss, atom), _unescape)


def _unescape(x: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def sitemap_walk(bodies: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """All (loc, lastmod) below ``roots`` (url): indexes are followed to the end, or ``depth`` levels, each
    sitemap read once; ``bodies`` has (url, body).  Sitemaps without a recorded body, and those below the
    last level, are counted by ``unread_sitemaps``."""
    return _walk(bodies, roots, depth)[0]


def unread_sitemaps(bodies: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """(url) of the sitemaps that a walk met but did not read."""
    return _walk(bodies, roots, depth)[1]


def _walk(bodies: DataFrame, roots: DataFrame, depth: int | None) -> tuple[DataFrame, DataFrame]:
    frontier, seen, found, level_no = roots.select("url").distinct(), None, None, 0
    while depth is None or level_no < depth:
        level_no += 1
        level = materialize(bodies.join(frontier, "url", "left_semi"), "sitemaps")
        rows = level.select(F.explode(sitemap_entries(F.col("body"))).alias("e")).select("e.*")
        found = rows if found is None else found.unionByName(rows)
        seen = frontier if seen is None else seen.unionByName(frontier)
        children = level.select(F.explode(sitemap_children(F.col("body"))).alias("url")).distinct()
        frontier = materialize(children.join(seen, "url", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
    unread = seen.join(bodies.select("url"), "url", "left_anti").unionByName(frontier)
    return found.distinct(), unread.distinct()


def crawl(links: DataFrame, roots: DataFrame, steps: int, allow: Callable[[Column], Column] | None = None, pages: int | None = None) -> DataFrame:
    """(url, step) of pages reached from ``roots`` (url) over ``links`` (source, target), each at its
    first step (SRC20).  A step is one join; what it reached first is written out and added to the rest.
    ``pages`` is a budget of pages to visit: once spent, addresses are still listed but no more followed."""
    visited = 0
    reached = frontier = materialize(roots.select("url").distinct().withColumn("step", F.lit(0)), "reached")
    for step in range(1, steps + 1):
        if pages is not None:
            if visited >= pages:
                break
            frontier = frontier.orderBy("url").limit(pages - visited)  # the feature asked for, in a fixed order
            visited += frontier.count()
        out = links.join(frontier.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).distinct()
        if allow is not None:
            out = out.where(allow(F.col("url")))
        frontier = materialize(out.join(reached, "url", "left_anti").withColumn("step", F.lit(step)), "frontier")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def blocklist_domain(line: Column) -> Column:
    """The domain of one line of a plain, hosts or match-pattern list; null for comments and others."""
    bare = F.trim(F.regexp_replace(line, r"\s*#.*$", ""))
    hosts = F.regexp_extract(bare, r"^(?:0\.0\.0\.0|127\.0\.0\.1|::1?)\s+(\S+)", 1)
    pattern = F.regexp_extract(bare, r"^\*://(?:\*\.)?([^/*]+)/\*$", 1)
    plain = F.regexp_extract(bare, r"^(?:\|\|)?((?:[\w-]+\.)+[a-zA-Z]{2,})\^?$", 1)
    found = F.lower(F.coalesce(F.nullif(hosts, F.lit("")), F.nullif(pattern, F.lit("")), F.nullif(plain, F.lit(""))))
    return F.when(~found.isin("localhost", "localhost.localdomain", "broadcasthost", "local"), found)


def blocklist(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Distinct domains of list files of any of the formats (SRC25)."""
    lines = spark.read.text(paths)
    return lines.select(blocklist_domain(F.col("value")).alias("domain")).where("domain IS NOT NULL").distinct()


def whole_texts(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content) of plain-text files, one row per file (SRC16)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("content"))


THIN_PAGE, MOST_THIN = 16, 50  # fixed values: letters below which a page counts as an image, and how many are read again


def document_pages(text: Column) -> Column:
    """Pages of a converted document, cut at form feeds (SRC13); a closing empty page is dropped."""
    return F.split(F.regexp_replace(text, r"\f$", ""), r"\f")


def thin_pages(pages: Column) -> Column:
    """Numbers, from 1, of the pages with next to no text, which are to be read as images (SRC13)."""
    numbered = F.transform(pages, lambda p, i: F.when(F.length(F.trim(F.regexp_replace(p, r"\s+", " "))) < THIN_PAGE, i + 1))
    return F.slice(F.array_compact(numbered), 1, MOST_THIN)


def with_read_pages(pages: Column, read: Column) -> Column:
    """``pages`` with the texts of ``read`` (a map of page number to text) where those are longer (SRC13)."""
    return F.transform(pages, lambda p, i: F.when(F.length(F.try_element_at(read, i + 1)) > F.length(F.trim(p)), F.try_element_at(read, i + 1)).otherwise(p))


LLMS_BYTES = 512 * 1024


def is_llms_text(status: Column, body: Column) -> Column:
    """Whether a recorded body is a usable llms.txt (SRC17): found, not empty, not large, no HTML."""
    head = F.lower(F.regexp_replace(F.substring(body, 1, 300), r"^\s+", ""))
    fits = F.octet_length(body).between(1, LLMS_BYTES) & (F.trim(body) != "")
    return (status == 200) & fits & ~(head.startswith("<!doctype") | head.startswith("<html"))
