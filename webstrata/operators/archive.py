"""Snapshots of a web archive, out of recorded answers of its availability service."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webstrata.functions.urls import part

# Fixed value: the address that snapshots of the archive begin with.
SNAPSHOTS = "https://web.archive.org/web/"
ANSWER = "archived_snapshots STRUCT<closest: STRUCT<available: BOOLEAN, status: STRING, url: STRING>>"


def slash_variants(url: Column) -> Column:
    """An address and its form with the closing slash toggled; a bare host has one form (SRC11)."""
    path = part(url, "path")
    head, tail = F.regexp_extract(url, r"^[^?]*", 0), F.regexp_extract(url, r"\?.*$", 0)
    toggled = F.concat(F.when(path.endswith("/"), F.rtrim(head, F.lit("/"))).otherwise(F.concat(head, F.lit("/"))), tail)
    return F.when(path.isin("", "/"), F.array(url)).otherwise(F.array(url, toggled))


def unwrapped_snapshot(url: Column) -> Column:
    """A snapshot's address for the page as it was: https, and ``if_`` after a time stamp that carries no
    mark yet (SRC12).  Other addresses stay."""
    secure = F.regexp_replace(url, r"^http://(web\.archive\.org/)", "https://$1")
    return F.regexp_replace(secure, r"^(https://web\.archive\.org/web/[0-9]+)/", "$1if_/")


def snapshot(body: Column) -> Column:
    """The snapshot that an answer offers, if it is there and was stored as a success; else null (SRC10)."""
    closest = F.from_json(F.when(F.try_parse_json(body).isNotNull(), body), ANSWER)["archived_snapshots"]["closest"]
    usable = closest["available"] & closest["status"].startswith("2") & (closest["url"] != "")
    return F.when(usable, unwrapped_snapshot(closest["url"]))


def first_snapshot(answers: Column) -> Column:
    """The snapshot out of the answers to an address's variants, in order (SRC10): each has (status, body).
    One that failed lets the next be asked; one that succeeded decides, even without a snapshot."""
    good = F.filter(answers, lambda a: (a["status"] == 200) & F.try_parse_json(a["body"]).isNotNull())
    return snapshot(F.get(good, F.lit(0))["body"])
