"""Records in page scripts and structured articles: Arrow functions that never fail.

Null, empty and damaged input gives null.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NEXT = re.compile(r'(?is)<script[^>]*id=["\']__NEXT_DATA__["\'][^>]*>(.*?)</script>')
_FLIGHT = re.compile(r'(?s)self\.__next_f\.push\(\s*\[\s*1\s*,\s*("(?:[^"\\]|\\.)*")\s*\]\s*\)')
_ATTRIBUTE = re.compile(r"""(?is)\bdata-json=(?:"([^"]*)"|'([^']*)')""")


def _lists(value: object, name: str) -> list[list]:
    found = []
    pending = [value]
    while pending:
        at = pending.pop()
        if isinstance(at, dict):
            if isinstance(at.get(name), list):
                found.append(at[name])
            pending.extend(at.values())
        elif isinstance(at, list):
            pending.extend(at)
    return found


def page_records(html: str | None, name: str = "ads") -> list | None:
    """The longest list called ``name`` in a page's data: its script of state, the pieces of a streamed
    state joined, or a data attribute."""
    if not html:
        return None
    from html import unescape

    candidates: list[list] = []
    for text in _NEXT.findall(html):
        try:
            candidates += _lists(json.loads(text), name)
        except (ValueError, RecursionError):
            pass
    pieces = []
    for text in _FLIGHT.findall(html):
        try:
            pieces.append(json.loads(text))
        except ValueError:
            pass
    stream, decoder = "".join(pieces), json.JSONDecoder()
    for m in re.finditer(rf'"{re.escape(name)}"\s*:\s*(?=\[)', stream):
        try:
            candidates.append(decoder.raw_decode(stream, m.end())[0])
        except (ValueError, RecursionError):
            pass
    for a, b in _ATTRIBUTE.findall(html):
        try:
            candidates += _lists(json.loads(unescape(a or b)), name)
        except (ValueError, RecursionError):
            pass
    return max(candidates, key=len, default=None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def record_texts(html: pd.Series) -> pd.Series:
    """Each record of a page's state as JSON text (JSN04)."""
    return html.map(lambda x: None if (r := page_records(x)) is None else [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in r])


def article_text(article: object, depth: int = 1) -> str:
    """Markdown of a structured article: sections, paragraphs, lists and tables, six levels deep."""
    if not isinstance(article, dict) or depth > 6:
        return ""
    tables = {t.get("identifier"): t for t in article.get("tables") or [] if isinstance(t, dict)}
    out: list[str] = []

    def cells(row: object) -> str:
        return "| " + " | ".join(str((c or {}).get("value", "")) if isinstance(c, dict) else "" for c in row or []) + " |"

    def walk(part: object, level: int) -> None:
        if not isinstance(part, dict) or level > 6:
            return
        kind, value = part.get("type"), part.get("value")
        if kind == "section":
            if part.get("name"):
                out.append("#" * min(level + 1, 6) + " " + str(part["name"]))
        elif kind == "list_item":
            out.append("- " + str(value or ""))
        elif isinstance(value, str) and value.strip():
            out.append(value.strip())
        for ref in part.get("table_references") or []:
            t = tables.get((ref or {}).get("identifier"))
            if t:
                rows = [cells(r) for r in [*(t.get("headers") or []), *(t.get("rows") or [])]]
                if rows:
                    out.append("\n".join([rows[0], "|" + " --- |" * (rows[0].count("|") - 1), *rows[1:]]))
        for child in part.get("has_parts") or []:
            walk(child, level + (kind == "section"))

    for section in article.get("sections") or []:
        walk(section, depth)
    return re.sub(r"(?m)^(- .*)\n\n(?=- )", r"\1\n", "\n\n".join(out))


@F.pandas_udf(T.StringType())
def article_markdown(body: pd.Series) -> pd.Series:
    """Markdown of structured articles in JSON (TXT28, ADP21)."""

    def one(text: str | None) -> str | None:
        try:
            found = json.loads(text) if text else None
        except (ValueError, RecursionError):
            return None
        return article_text(found) if isinstance(found, dict) else None

    return body.map(one)


@F.pandas_udf(T.StringType())
def remarkup(html: pd.Series) -> pd.Series:
    """Markdown of a comment's HTML (TXT25): links, lists, code, quotes, headings."""
    from webstrata.functions.html import _tidy, read_page

    return html.map(lambda x: None if x is None else _tidy(read_page(x).out))
