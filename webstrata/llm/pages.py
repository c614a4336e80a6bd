"""Pages as lines: what each line of a page's HTML and markdown shows, and where it stands.

One pass over a page emits digests and numbers only.  HTML gives one row per page: its containers, each
with a digest of its path in the page's tree, one of its presentation (the sequence of its child
elements) and the pieces of text it shows.  Markdown gives a row per piece of text: the line it stands
on, a digest of its wording with names and numbers masked, its length, and a code of line statistics.
Everything later works on these rows; the text is read once.
"""

from __future__ import annotations

import gzip
import re
import unicodedata
import zlib
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm.language import COMMON, FILLER
from webstrata.llm.lookalike import HOMOGLYPHS, INVISIBLE

MARKDOWN_SCHEMA = "fetch_id LONG, line_no INT, block INT, kind STRING, wording LONG, size INT, stats INT"
PIECE = "STRUCT<line_no: INT, wording: LONG, size: INT, again: BOOLEAN>"
HTML_SCHEMA = (
    f"fetch_id LONG, host STRING, nodes ARRAY<STRUCT<path: LONG, style: LONG, pieces: ARRAY<{PIECE}>>>, "
    "layouts ARRAY<STRUCT<path: LONG, chain: ARRAY<LONG>>>"
)

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?-->|<![^>]*>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"<(script|style|template|head|title)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_CONTAINERS = set("div section nav aside header footer main article ul ol form dialog menu".split())
_INLINE = set("a abbr b bdi bdo br cite code em font i img kbd mark q s small span strong sub sup time u wbr".split())
_VOID = set("br img hr input meta link source wbr area base col embed track".split())
_DIGITS = re.compile(r"\d+")
_ROOT = "body"
_FOLD = str.maketrans({c: latin for latin, others in (x.split(":") for x in HOMOGLYPHS.split()) for c in others} | dict.fromkeys(INVISIBLE))
_FOLDED = re.compile(f"[{''.join(map(chr, _FOLD))}]")
# The masks of a wording, as the Arrow kernels' regular expressions; inner words with a capital are names.
_MASKS = [(r"\pN+", "0"), (r"\s+", " "), (r" \S*\p{Lu}\S*(?: \S*\p{Lu}\S*)*", " N"), (r"^[^\pL\pN]+|[^\pL\pN]+$", "")]

HEADING_MARK = 0x5DEECE66D  # tells a heading's wording from the same plain text


def fold(text: str) -> str:
    """``text`` with one form of each character and of letters drawn alike."""
    if _FOLDED.search(text):
        text = text.translate(_FOLD)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
        if _FOLDED.search(text):
            text = text.translate(_FOLD)
    return text


def wordings(texts: list[str]) -> list[int]:
    """Digests of texts' wordings: look-alikes folded, numbers and inner capitalised words masked."""
    folded = [t if t.isascii() else fold(t) for t in texts]
    x = pa.array([t.strip() for t in folded], pa.large_string())
    for pattern, to in _MASKS:
        x = pc.replace_substring_regex(x, pattern, to)
    masked = pc.utf8_lower(x).to_pylist()
    return [xxhash.xxh3_64_intdigest(m or t) - (1 << 63) for m, t in zip(masked, folded)]


def wording(text: str) -> int:
    return wordings([text])[0]


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def unpack(packed: bytes | None) -> str | None:
    """The page of a gzip body; None unless it unpacks whole to UTF-8."""
    if not packed:
        return None
    try:
        return gzip.decompress(packed).decode("utf-8")
    except (OSError, EOFError, zlib.error, UnicodeDecodeError):
        return None


def read_html(html: str) -> tuple[list[tuple[int, str, str, str]], dict[str, list[str]], dict[str, str | None]]:
    """(pieces, children, parents) of a page's body.  Pieces are (line, container path, leaf tag, text) of
    what is shown, in order; ``children`` holds the elements that follow one another in each container,
    runs of one kind as one and inline marks apart; ``parents`` the container around each.

    Elements with a class, id or role, and sectioning or list elements, are containers; other elements
    belong to the container around them.  Comments, scripts, styles and the head show nothing."""

    def blank(m: re.Match[str]) -> str:
        return "\n" * m.group(0).count("\n")

    html = _HIDDEN.sub(blank, html)
    pieces: list[tuple[int, str, str, str]] = []
    children: dict[str, list[str]] = {_ROOT: []}
    parents: dict[str, str | None] = {_ROOT: None}
    line, path, leaf = 1, _ROOT, ""
    own = children[_ROOT]
    stack: list[tuple[str, str, str]] = []
    at = 0
    for m in _TAG.finditer(html):
        start = m.start()
        if start > at:
            text = html[at:start]
            if not text.isspace():
                for i, part in enumerate(text.split("\n")):
                    if part and not part.isspace():
                        pieces.append((line + i, path, leaf, unescape(part).strip() if "&" in part else part.strip()))
            line += text.count("\n")
        at = m.end()
        line += html.count("\n", start, at)
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    path, leaf = stack[k][1], stack[k][2]
                    own = children[path]
                    del stack[k:]
                    break
        elif tag not in _VOID and tag not in ("html", "body"):
            attributes = m.group(3)
            stack.append((tag, path, leaf))
            names = ""
            if attributes and "=" in attributes:
                names = "".join(f"[{a.lower()}={_DIGITS.sub('0', b or c or d)}]" for a, b, c, d in _NAMED.findall(attributes))
            if names or tag in _CONTAINERS:
                if not own or own[-1] != tag + names:
                    own.append(tag + names)
                inner = f"{path}/{tag}{names}"
                if inner not in parents:
                    parents[inner], children[inner] = path, []
                path, own = inner, children[inner]
            elif tag not in _INLINE and (not own or own[-1] != tag):
                own.append(tag)
            leaf = tag
            if attributes.endswith("/"):
                _, path, leaf = stack.pop()
                own = children[path]
    for i, part in enumerate(html[at:].split("\n")):
        if part and not part.isspace():
            pieces.append((line + i, path, leaf, unescape(part).strip()))
    return pieces, children, parents


_FENCE = re.compile(r"^\s*(?:```|~~~)")
_HEADING = re.compile(r"^\s*#{1,6}\s+")
_BULLET = re.compile(r"^\s*(?:[*+•‣–-]|\d{1,3}[.)])\s+")
_EMPHASIS = re.compile(r"^(\*\*|__|\*|_)(.+)\1$")
_LINK = re.compile(r"\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)")
_JOINTS = re.compile(r"\s+[|·•›»>/]\s+|\s{2,}|\t")
_JOINT_MARKS = ("  ", "\t", "|", ">", "/")  # of plain ASCII texts, only those with one of these can be split
_COLUMNS = re.compile(r"\S(?: {2,}|\t)\S")
_SENTENCE = re.compile(r"[.!?…。](?:[\"'”»)\]*_]*)(?=\s|$)")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_CSV = re.compile(r"(?:^|(?<=,))[^,\s]*(?:\s[^,\s]+)?(?=,(?=\S))")
_MOJIBAKE = re.compile(r"[ÃÂâ][\x80-\xBF€™œž˜Ÿ½¼š¤£§©ª¨]|�|[€™œ½¼ÃÂâ]{2}")

# Bits of a markdown line's statistics code.
STAT_BITS = "bullet columns ends long digits symbols unbroken no_vowels short garbled fenced items linked rule uncommon repeats".split()
BULLET, COLUMNS, ENDS, LONG, DIGITS, SYMBOLS, UNBROKEN, NO_VOWELS, SHORT, GARBLED, FENCED, ITEMS, LINKED, RULE, UNCOMMON, REPEATS = (1 << i for i in range(16))
_COMMON = frozenset(w for lang, words in COMMON.items() if lang != FILLER for w in words.split())


def line_stats(line: str, fenced: bool) -> int:
    """The statistics of one markdown line that tell prose, lists, tables and junk apart."""
    linked = "](" in line
    bare = (_LINK.sub(r"\1", line) if linked else line).strip()
    n = len(bare) or 1
    tokens = bare.split()
    code = FENCED if fenced else 0
    if _BULLET.match(line):
        code |= BULLET
    if bare.count("|") >= 2 or "\t" in bare or bare.count(" ; ") >= 2 or ("  " in bare and len(_COLUMNS.findall(bare)) >= 2) or (bare.count(",") >= 3 and len(_CSV.findall(bare)) >= 3):
        code |= COLUMNS
    elif (semis := bare.count("; ")) >= 2 and n <= 45 * (semis + 1):
        code |= ITEMS
    if len(tokens) >= 4 and _SENTENCE.search(bare[-6:]):
        code |= ENDS
    if n >= 90 and not code & ITEMS:
        code |= LONG
    digits = sum(map(bare.count, "0123456789"))
    if digits >= 0.14 * n:
        code |= DIGITS
    letters = len(_NO_LETTERS.sub("", bare))
    if n - letters - digits - (len(tokens) - 1) >= 0.28 * n:
        code |= SYMBOLS
    if max(map(len, tokens), default=0) >= 30 and "://" not in bare:
        code |= UNBROKEN
    if letters >= 12 and sum(map(bare.count, "aeiouyAEIOUYáéíóúäöüàèâêôãõаеиоуыэюяёАЕИОУЭЮЯ")) < 0.22 * letters:
        code |= NO_VOWELS
    if (len(tokens) <= 8 and not code & ENDS) or code & ITEMS:  # a line of several short items
        code |= SHORT
    if not bare.isascii() and any(c in bare for c in "ÃÂâ�€") and len(_MOJIBAKE.findall(bare)) >= max(2, 0.02 * n):
        code |= GARBLED
    if linked and len(bare) <= 90:
        code |= LINKED
    if len(tokens) >= 8 and not code & (COLUMNS | ITEMS):
        low = [t.strip(".,;:!?\"'()«»“”*>") for t in bare.lower().split()]
        if sum(map(_COMMON.__contains__, low)) < 0.1 * len(low):
            code |= UNCOMMON
        if len(set(low)) < 0.5 * len(low):
            code |= REPEATS
    if not letters and not digits and set(bare) <= set("-=|:+*_ "):
        code |= RULE
    return code


def read_line(line: str, stats: bool = True) -> tuple[str, list[str], int, int]:
    """(kind, texts, size, stats) of a markdown line outside code; the whole text and, if it is made of
    several entries, each of them.  Statistics are 0 where they are not asked for."""
    bare = line.strip()
    kind, text = "text", bare
    if m := _HEADING.match(line):
        kind, text = "heading", line[m.end() :]
    elif m := _BULLET.match(line):
        kind, text = "item", line[m.end() :]
    elif bare.startswith(">"):
        kind, text = "quote", bare.lstrip("> ")
    elif bare.startswith("|"):
        kind = "row"
    if m := _EMPHASIS.match(text.strip()):
        text = m.group(2)
    if "](" in text:
        text = _LINK.sub(r"  \1  ", text)
    text = text.strip()
    if any(c in text for c in _JOINT_MARKS) or not text.isascii():
        texts = [t for t in (x.strip() for x in _JOINTS.split(text)) if t and t not in "|·•›»"]
    else:
        texts = [text] if text else []
    return kind, [text, *texts] if len(texts) > 1 else texts or [bare], len(bare), line_stats(line, False) if stats else 0


def markdown_pieces(markdown: str, known: dict[str, tuple], stats: bool = True) -> Iterator[tuple[int, int, str, list[str], int, int]]:
    """(line, block, kind, texts, size, stats) of each line that is not blank.  Blocks are runs of
    lines without a blank one; a line of several menu entries gives several texts.  ``known`` keeps
    what short lines gave, as sites repeat them."""
    block, fenced, open_block = 0, False, False
    for number, line in enumerate(markdown.split("\n"), 1):
        if not line or line.isspace():
            open_block = False
            continue
        if not open_block:
            block, open_block = block + 1, True
        if _FENCE.match(line):
            fenced = not fenced
            yield number, block, "code", [], len(line.strip()), FENCED
        elif fenced:
            yield number, block, "code", [], len(line.strip()), line_stats(line, True) if stats else 0
        elif len(line) > 120:
            yield number, block, *read_line(line, stats)
        else:
            if (found := known.get(line)) is None:
                if len(known) > 100_000:
                    known.clear()
                found = known[line] = read_line(line, stats)
            yield number, block, *found


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_HEADINGS = frozenset(("h1", "h2", "h3", "h4"))


class LineReader:
    """Digests of wordings, paths and presentations; each is worked out once, and those of a batch's new
    texts together."""

    def __init__(self) -> None:
        self.paths: dict[str, int] = {}
        self.styles: dict[str, int] = {}
        self.known: dict[str, int] = {"": 0}
        self.short: dict[str, tuple] = {}

    def wordings(self, texts: list[str]) -> list[int]:
        """Wordings of texts, 0 of an empty one.  Short ones are kept, as sites repeat them."""
        known = self.known
        new = list({t for t in texts if t not in known})
        found = dict(zip(new, wordings(new)))
        out = [known[t] if t in known else found[t] for t in texts]
        if len(known) > 200_000:
            known.clear()
            known[""] = 0
        known.update((t, w) for t, w in found.items() if len(t) <= 160)
        for kept in (self.paths, self.styles):
            if len(kept) > 200_000:
                kept.clear()
        return out

    def path(self, path: str, parents: dict[str, str | None], new: list[tuple[int, list[int]]]) -> int:
        """Digest of a path; one not met before goes to ``new`` with the digests from the root to it."""
        if (p := self.paths.get(path)) is None:
            p = self.paths[path] = digest(path)
            chain, at = [], path
            while at is not None:
                chain.append(digest(at))
                at = parents[at]
            new.append((p, chain[::-1]))
        return p

    def style(self, children: list[str]) -> int:
        text = " ".join(children)
        if (s := self.styles.get(text)) is None:
            s = self.styles[text] = digest(text)
        return s


def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _structs(columns: list[list], types: list[pa.DataType], names: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _html_batch(reader: LineReader, rows: Iterator[tuple[int, str | None, bytes | None]]) -> pa.RecordBatch:
    """Rows of ``HTML_SCHEMA`` as flat columns and the lengths of the lists over them."""
    ids, hosts, sizes = [], [], ([], [], [], [])  # nodes, pieces, layouts, links per owner
    paths, styles, lines, texts, heads, lengths, again = [], [], [], [], [], [], []
    layouts: list[list] = [[], []]
    for fetch_id, url, packed in rows:
        page = unpack(packed)
        if not page:
            continue
        found, children, parents = read_html(page)
        new: list[tuple[int, list[int]]] = []
        shown: dict[str, list] = {path: [] for path in children}
        for piece in found:
            shown[piece[1]].append(piece)
        for path, items in shown.items():
            paths.append(reader.path(path, parents, new))
            styles.append(reader.style(children[path]))
            sizes[1].append(len(items))
            seen = set()
            for line, _, leaf, text in items:
                head = leaf in _HEADINGS
                lines.append(line)
                texts.append(text)
                heads.append(head)
                lengths.append(len(text))
                again.append((text, head) in seen)
                seen.add((text, head))
        ids.append(fetch_id)
        hosts.append(_host(url))
        sizes[0].append(len(shown))
        sizes[2].append(len(new))
        for p, chain in new:
            layouts[0].append(p)
            layouts[1].extend(chain)
            sizes[3].append(len(chain))
    words = reader.wordings(texts)
    words = [w ^ HEADING_MARK if h else w for w, h in zip(words, heads)]
    shown_by = _lists(sizes[1], _structs([lines, words, lengths, again], [pa.int32(), pa.int64(), pa.int32(), pa.bool_()], ["line_no", "wording", "size", "again"]))
    containers = pa.StructArray.from_arrays([pa.array(paths, pa.int64()), pa.array(styles, pa.int64()), shown_by], names=["path", "style", "pieces"])
    chains = pa.StructArray.from_arrays([pa.array(layouts[0], pa.int64()), _lists(sizes[3], pa.array(layouts[1], pa.int64()))], names=["path", "chain"])
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), _lists(sizes[0], containers), _lists(sizes[2], chains)],
        names=["fetch_id", "host", "nodes", "layouts"],
    )


def html_pages(fetches: DataFrame) -> DataFrame:
    """A row of ``HTML_SCHEMA`` per fetch whose ``html_gz`` unpacks whole; ``again`` marks what a container
    of the page has shown before.  ``layouts`` are the paths a task met first on this page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                yield _html_batch(reader, zip(*(c.to_pylist() for c in batch.slice(start, 512).columns)))

    return fetches.select(F.col("fetch_id").cast("long"), "url", "html_gz").where("html_gz IS NOT NULL").mapInArrow(run, HTML_SCHEMA)


MARKDOWN_NAMES = [x.split()[0] for x in MARKDOWN_SCHEMA.split(", ")]
MARKDOWN_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int32()]


def _markdown_batch(reader: LineReader, rows: Iterator[tuple[int, str]], stats: bool) -> pa.RecordBatch:
    out: list[tuple] = []
    texts: list[str] = []
    for fetch_id, markdown in rows:
        for line, block, kind, found, size, code in markdown_pieces(markdown, reader.short, stats):
            if kind == "heading":
                out.append((fetch_id, line, block, kind, HEADING_MARK, size, code))
                texts.append(found[0])
                kind = "plain heading"
            elif len(found) > 1:
                out.append((fetch_id, line, block, "whole", 0, size, code))
                texts.append(found[0])
            for piece in found[len(found) > 1 :] or [""]:
                out.append((fetch_id, line, block, kind, 0, size, code))
                texts.append(piece)
    columns = list(zip(*out)) or [()] * len(MARKDOWN_NAMES)
    columns[4] = [w ^ mark for w, mark in zip(reader.wordings(texts), columns[4])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, MARKDOWN_TYPES)], names=MARKDOWN_NAMES)


def markdown_lines(fetches: DataFrame, stats: bool = True) -> DataFrame:
    """Rows of ``MARKDOWN_SCHEMA`` of every fetch; null, empty and blank texts give none.  Headings come
    twice, with their wording as a heading and as plain text; lines of several entries with that of the
    whole line and those of the entries.  Line statistics are worked out where they are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = LineReader()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                yield _markdown_batch(reader, zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns)), stats)

    return fetches.select(F.col("fetch_id").cast("long"), "markdown").where("markdown IS NOT NULL").mapInArrow(run, MARKDOWN_SCHEMA)
