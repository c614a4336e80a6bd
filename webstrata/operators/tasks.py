"""Task pages and task lists of a project tracker (ADP15).

A page that only asks to log in is ``login_required``, one without its title or list ``parse_failed``, a list
without tasks ``no_results``.  What is no task in a mixed list is left out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.functions.classify import is_auth_wall
from webstrata.functions.dom import Layout, Node, build, first, page_items, select
from webstrata.functions.html import fragment_markdown
from webstrata.functions.urls import part

# Closed states that a task's head names after "Closed", and words of states in lists.
CLOSED = ["Resolved", "Invalid", "Declined", "Wontfix", "Spite", "Duplicate"]
STATES = ["open", "closed", "resolved", "invalid", "declined", "wontfix", "stalled", "duplicate", "spite", "in progress"]

LIST = Layout(
    anchors="ul.phui-oi-list-view",
    card="ul.phui-oi-list-view li.phui-oi",
    key="href",
    fields={
        "href": ("a.phui-oi-link", "@href"),
        "title": ("a.phui-oi-link", "@title"),
        "text": ("a.phui-oi-link", "text"),
        "attributes": (".phui-oi-attribute", "texts"),
        "snippet": (".phui-source-fragment", "text"),
    },
)
HEAD = Layout(anchors="*", card=None, fields={"og": ('meta[property="og:title"]', "@content"), "header": (".phui-header-header", "text"), "state": (".phui-header-subheader .phui-tag-view", "text")})

_TEXT = T.StringType()
_LINKS = T.ArrayType(T.StructType([T.StructField("name", _TEXT), T.StructField("url", _TEXT)]))
_COMMENTS = T.ArrayType(T.StructType([T.StructField(n, _TEXT) for n in ("id", "author", "at", "text")]))
_RELATED = T.ArrayType(T.StructType([T.StructField("label", _TEXT), T.StructField("title", _TEXT), T.StructField("url", _TEXT), T.StructField("closed", T.BooleanType())]))
BODY = T.StructType([
    T.StructField("author", _TEXT), T.StructField("assignee", _TEXT), T.StructField("tags", _LINKS), T.StructField("subscribers", T.ArrayType(_TEXT)), T.StructField("description", _TEXT),
    T.StructField("comments", _COMMENTS), T.StructField("related", _RELATED),
])


def _text(top: Node, selector: str) -> str | None:
    node = first(top, selector)
    return (node.text() or None) if node is not None else None


def _panels(top: Node) -> dict:
    out: dict = {"author": None, "assignee": None, "tags": [], "subscribers": []}
    for panel in select(top, ".phui-curtain-panel"):
        head, body = (_text(panel, ".phui-curtain-panel-header") or "").lower(), first(panel, ".phui-curtain-panel-body")
        if body is None:
            continue
        people = list(dict.fromkeys(t for n in select(body, ".phui-link-person") if (t := n.text())))
        if head == "authored by":
            out["author"] = people[0] if people else None
        elif head == "assigned to" and first(body, ".phui-curtain-object-ref-list-view-empty") is None:
            out["assignee"] = people[0] if people else None
        elif "tags" in head:
            for tag in select(body, ".phabricator-handle-tag-list-item .phui-tag-view"):
                if name := _text(tag, ".phui-tag-core") or tag.text():
                    out["tags"].append({"name": name, "url": tag.attributes.get("href") or None})
        elif head == "subscribers":
            out["subscribers"] = people
    return out


def _next(node: Node, tag: str) -> Node | None:
    """The next element of the same parent, if it is a ``tag`` before another of the node's own kind."""
    after = False
    for other in node.parent.children if node.parent else []:
        if other is node:
            after = True
        elif after and isinstance(other, Node):
            if other.tag == tag:
                return other
    return None


def read_task(html: str | None, most: int) -> dict | None:
    if not html:
        return None
    top = build(html)
    box = first(top, ".phui-property-list-text-content .phabricator-remarkup")
    comments, related = [], []
    for shell in select(top, ".phui-timeline-shell"):
        said = first(shell, '[data-sigil="transaction-comment"]')
        if said is None or len(comments) >= most:
            continue
        anchor, body = first(shell, ".phabricator-anchor-view"), first(said, ".phabricator-remarkup")
        comments.append({"id": anchor.attributes.get("id") if anchor else None, "author": _text(shell, ".phui-link-person"), "at": _text(shell, ".print-only"), "text": (fragment_markdown(body) or None) if body else None})
    for label in select(top, ".phui-property-list-properties dt"):
        side = _next(label, "dd")
        for a in select(side, "a.phui-handle") if side else ():
            if title := a.text():
                related.append({"label": label.text(), "title": title, "url": a.attributes.get("href") or None, "closed": "handle-status-closed" in a.attributes.get("class", "").split()})
    return {**_panels(top), "description": (fragment_markdown(box) or None) if box else None, "comments": comments, "related": related}


def task_body(most_comments: int):  # noqa: ANN201
    @F.pandas_udf(BODY)
    def run(html: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(BODY.names)
        return pd.DataFrame([read_task(x, most_comments) or empty for x in html], columns=BODY.names)

    return run.asNondeterministic()  # read once, not wherever a field of it is used


def task_claim(url: Column) -> Column:
    """(kind, key) of an address: a task by its number, a list by the address itself, or null."""
    path = part(url, "path")
    number = F.regexp_extract(path, r"^/T(\d+)/?$", 1)
    first_part = F.get(F.filter(F.split(path, "/"), lambda s: s != ""), F.lit(0))
    kind = F.when(number != "", "task").when(first_part.isin("search", "maniphest"), "search")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind == "task", number).otherwise(url).alias("key")))


def task_pages(rows: DataFrame, most_comments: int = 50, name: str = "found") -> DataFrame:
    """``rows`` (``html``) with (outcome, id, title, status, priority, body) of their task pages.  A closed
    task's state folds its resolution in and has no priority."""
    x = rows.withColumns({"_head": page_items(HEAD)(F.col("html")), "_body": task_body(most_comments)(F.col("html"))})
    head = F.get(F.col("_head")["items"], F.lit(0))
    og = F.trim(F.try_element_at(head, F.lit("og")))
    number = F.nullif(F.regexp_extract(og, r"(?s)^T(\d+)\b", 1), F.lit(""))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract(og, r"(?s)^T\d+\b\s*(.*)$", 1)), F.lit("")), F.try_element_at(head, F.lit("header")))
    states = F.filter(F.transform(F.split(F.try_element_at(head, F.lit("state")), ","), lambda x: F.trim(x)), lambda x: x != "")
    a, b = F.get(states, F.lit(0)), F.get(states, F.lit(1))
    closed = F.coalesce((a == "Closed") & b.isin(*CLOSED), F.lit(False))
    outcome = F.when(number.isNotNull(), "ok").when(is_auth_wall(F.col("html")), "login_required").otherwise("parse_failed")
    found = F.struct(
        outcome.alias("outcome"), number.try_cast("long").alias("id"), F.when(number.isNotNull(), title).alias("title"), F.when(closed, b).otherwise(a).alias("status"), F.when(~closed, b).alias("priority"),
        F.when(number.isNotNull(), F.col("_body")).alias("body"),
    )
    return x.withColumn(name, found).drop("_head", "_body")


def task_lists(rows: DataFrame, name: str = "found") -> DataFrame:
    """``rows`` (``html``) with (outcome, items) of their result pages, each task once."""
    x = rows.withColumn("_page", page_items(LIST)(F.col("html")))
    page = F.col("_page")
    of = lambda c, n: F.try_element_at(c, F.lit(n))
    tasks = F.filter(page["items"], lambda c: of(c, "href").rlike(r"^/T\d+$"))

    def item(c: Column) -> Column:
        number = F.regexp_extract(of(c, "href"), r"^/T(\d+)$", 1)
        states = F.filter(F.transform(F.split(of(c, "attributes"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^[·\s]+", ""))), lambda x: F.lower(x).isin(*STATES))
        title = F.nullif(F.trim(F.regexp_replace(F.coalesce(of(c, "title"), of(c, "text")), r"^T\d+:\s*", "")), F.lit(""))
        return F.struct(number.cast("long").alias("id"), title.alias("title"), F.get(states, F.lit(0)).alias("status"), of(c, "snippet").alias("snippet"))

    outcome = F.when(page["parsed"], F.when(F.size(tasks) > 0, "ok").otherwise("no_results")).when(is_auth_wall(F.col("html")), "login_required").otherwise("parse_failed")
    return x.withColumn(name, F.struct(outcome.alias("outcome"), F.when(outcome == "ok", F.transform(tasks, item)).alias("items"))).drop("_page")
