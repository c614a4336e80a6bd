"""Records out of page layouts: a page's tree, selectors over it, and layouts that name fields by selector.

A layout says what makes a page one of its kind (``anchors``), what repeats (``card``), and where the
fields of a card stand.  Only raw texts leave the tree; numbers and the rest are read off them by column
functions.  A page without any anchor is not parsed; one with an anchor and no card is parsed and empty.
Null and damaged pages are not parsed.

Selectors: tags, ``#id``, ``.class``, ``[name]``, ``[name=v]``, ``[name*=v]``, ``[name^=v]``, ``:not(...)`` of
one of these, descendants by blanks, alternatives by commas; a ``||`` tries the next selector where one
gives no value.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SELF_CLOSING = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}


class _Page:
    """All elements in order, and the places of those with a tag, ``#id``, ``.class`` or ``[attribute``."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}

    def close(self) -> None:
        places = defaultdict(list)
        for node in self.nodes:
            places[node.tag].append(node.place)
            for name, value in node.attributes.items():
                places[f"[{name}"].append(node.place)
                if name == "id":
                    places[f"#{value}"].append(node.place)
                elif name == "class":
                    for x in dict.fromkeys(value.split()):
                        places[f".{x}"].append(node.place)
        for node in reversed(self.nodes):
            node.end = max(node.end, node.place + 1)
            node.parent.end = max(node.parent.end, node.end)
        self.places = dict(places)


@dataclass
class Node:
    """``place`` and ``end``: the elements below stand from behind the one to before the other."""

    tag: str
    attributes: dict[str, str]
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)
    page: _Page = field(default_factory=_Page, repr=False, compare=False)
    place: int = -1
    end: int = 0

    def pieces(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                yield at
            elif at.tag not in ("script", "style"):
                stack.extend(reversed(at.children))

    def text(self, glue: str = " ") -> str:
        return " ".join(glue.join(x.strip() for x in self.pieces() if x.strip()).split())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.at.tag in SELF_CLOSING.get(tag, ()) and self.at.parent is not None:
            self.at = self.at.parent
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._add(tag, attrs)

    def _add(self, tag: str, attrs: list[tuple[str, str | None]]) -> Node:
        page = self.root.page
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, page=page, place=len(page.nodes))
        page.nodes.append(node)
        self.at.children.append(node)
        return node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def build(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.root.page.close()
    return builder.root


Test = Callable[[Node], bool]
_SIMPLE = re.compile(r"(?P<tag>^[a-zA-Z][\w-]*|^\*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w:-]+)(?:(?P<op>[*^]?=)[\"']?(?P<value>[^\]\"']*)[\"']?)?\]|:not\((?P<no>[^)]*)\)")


def _simple(text: str) -> tuple[Test, str | None]:
    """The test of an element, and under which name a page has the places of all that may pass."""
    tests: list[Test] = []
    keys: dict[str, str] = {}
    for m in _SIMPLE.finditer(text):
        g = m.groupdict()
        if g["tag"] and g["tag"] != "*":
            tests.append(lambda n, t=g["tag"].lower(): n.tag == t)
            keys["tag"] = g["tag"].lower()
        elif g["id"]:
            tests.append(lambda n, v=g["id"]: n.attributes.get("id") == v)
            keys["id"] = f"#{g['id']}"
        elif g["cls"]:
            tests.append(lambda n, v=g["cls"]: v in n.attributes.get("class", "").split())
            keys["cls"] = f".{g['cls']}"
        elif g["no"]:
            tests.append(lambda n, t=_simple(g["no"])[0]: not t(n))
        elif g["name"]:
            name, op, value = g["name"].lower(), g["op"], g["value"]
            if op in (None, "=") or value:  # else one without the attribute passes too
                keys["name"] = f"[{name}"
            if op is None:
                tests.append(lambda n, a=name: a in n.attributes)
            elif op == "=":
                tests.append(lambda n, a=name, v=value: n.attributes.get(a) == v)
            elif op == "*=":
                tests.append(lambda n, a=name, v=value: v in n.attributes.get(a, ""))
            else:
                tests.append(lambda n, a=name, v=value: n.attributes.get(a, "").startswith(v))
    key = next((keys[k] for k in ("id", "cls", "name", "tag") if k in keys), None)
    return (tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)), key


@cache
def compiled(selector: str) -> list[tuple[list[Test], list[str | None]]]:
    chains = [[_simple(part) for part in alternative.split()] for alternative in re.split(r",(?![^\[(]*[\])])", selector)]
    return [([test for test, _ in chain], [key for _, key in chain]) for chain in chains]


def _fits(node: Node, chain: list[Test], top: Node) -> bool:
    if not chain[-1](node):
        return False
    k, at = len(chain) - 2, node.parent
    while k >= 0:
        if at is None or at is top:
            return False
        if chain[k](at):
            k -= 1
        at = at.parent
    return True


def select(top: Node, selector: str) -> Iterator[Node]:
    nodes, places = top.page.nodes, top.page.places
    chains, found = [], []
    for chain, keys in compiled(selector):
        if all(key is None or key in places for key in keys):
            at = range(len(nodes)) if keys[-1] is None else places[keys[-1]]
            chains.append(chain)
            found.append(at[bisect_left(at, top.place + 1) : bisect_left(at, top.end)])
    for place in found[0] if len(found) == 1 else sorted({p for at in found for p in at}):
        node = nodes[place]
        if any(_fits(node, chain, top) for chain in chains):
            yield node


def first(top: Node, selector: str) -> Node | None:
    return next(select(top, selector), None)


def _pairs(top: Node, rows: str, key: str, value: str) -> str | None:
    """Names and values of a table's rows as JSON, the first value of a name winning."""
    found: dict[str, str] = {}
    for row in select(top, rows):
        k, v = first(row, key), first(row, value)
        if k is not None and v is not None and (name := k.text().rstrip(": ")) and (text := v.text()):
            found.setdefault(name, text)
    return json.dumps(found, ensure_ascii=False) if found else None


@cache
def _ways(selector: str) -> list[tuple[str, list[frozenset[str]]]]:
    """The selectors to try, with what a page has to have for one of its alternatives to match."""
    return [(one, [frozenset(k for k in keys if k) for _, keys in compiled(one)]) for one in map(str.strip, selector.split("||"))]


def read_field(top: Node, selector: str, what: str) -> str | None:
    """``text`` of the first match, ``@name`` an attribute of it, ``glued`` texts of all matches without
    blanks, ``texts`` or ``all@name`` those of all on lines, ``here@name`` of the card itself, ``present``, or
    ``pairs key|value`` of the rows selected."""
    if what.startswith("here@"):
        return top.attributes.get(what[5:], "").strip() or None
    there = top.page.places.keys()
    for one, needs in _ways(selector):
        if not any([there >= need for need in needs]):
            continue
        if what.startswith("pairs "):
            value = _pairs(top, one, *what[6:].split("|"))
        elif what == "glued":
            value = "".join(n.text("") for n in select(top, one))
        elif what == "texts":
            value = "\n".join(dict.fromkeys(t for n in select(top, one) if (t := n.text())))
        elif what.startswith("all@"):
            value = "\n".join(dict.fromkeys(t for n in select(top, one) if (t := n.attributes.get(what[4:], "").strip())))
        else:
            node = first(top, one)
            value = None if node is None else "true" if what == "present" else node.text() if what == "text" else node.attributes.get(what[1:], "").strip()
        if value:
            return value
    return None


@dataclass(frozen=True)
class Layout:
    """``fields``: name to (selector, what).  With ``within``, a card is the closest element around each
    match of ``card`` that fits it, ``climb`` levels up at most, and ``seed`` fields are read off the match
    itself.  Of cards with equal ``key`` the first counts; those without one are left out."""

    anchors: str
    card: str | None
    fields: dict[str, tuple[str, str]]
    key: str | None = None
    within: str | None = None
    climb: int = 6
    seed: dict[str, str] = field(default_factory=dict)

    def read(self, html: str | None) -> dict:
        if not html:
            return {"parsed": False, "items": []}
        top = build(html)
        cards = [top] if self.card is None else list(select(top, self.card))
        if not (cards if self.card else []) and first(top, self.anchors) is None:
            return {"parsed": False, "items": []}
        items, seen = [], set()
        for match in cards:
            card = self._around(match)
            item = {k: v for k, (selector, what) in self.fields.items() if (v := read_field(card, selector, what)) is not None}
            item |= {k: v for k, name in self.seed.items() if (v := match.attributes.get(name, "").strip())}
            if self.key is not None:
                name = item.get(self.key)
                if name is None or name in seen:
                    continue
                seen.add(name)
            items.append(item)
        return {"parsed": True, "items": items}

    def _around(self, node: Node) -> Node:
        if self.within is None:
            return node
        at, test = node, compiled(self.within)[0][0][-1]
        for _ in range(self.climb):
            if at.parent is None or not at.parent.tag:
                break
            at = at.parent
            if test(at):
                break
        return at


ITEMS = T.StructType([T.StructField("parsed", T.BooleanType()), T.StructField("items", T.ArrayType(T.MapType(T.StringType(), T.StringType())))])


def page_items(layout: Layout) -> Callable:
    """(parsed, items) of a page by a layout, an item being a map of field to raw text."""

    @F.pandas_udf(ITEMS)
    def run(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([layout.read(x) for x in html], columns=["parsed", "items"])

    return run.asNondeterministic()  # read once, not wherever a field of it is used
