"""Numbers, money, dates, durations and small arrays out of text.  What cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def brl_number(text: Column) -> Column:
    """Money with dots between thousands and a decimal comma."""
    kept = F.regexp_replace(text, r"[^\d.,]", "")
    return F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def first_int(text: Column) -> Column:
    """The first whole number, dots between thousands dropped."""
    return F.nullif(F.regexp_extract(F.replace(text, F.lit("."), F.lit("")), r"\d+", 0), F.lit("")).try_cast("long")


def brl_int(text: Column) -> Column:
    whole = F.substring_index(F.regexp_replace(text, r"[^\d,]", ""), ",", 1)
    return F.nullif(whole, F.lit("")).try_cast("long")


def usd_number(text: Column) -> Column:
    """A dollar amount and nothing else; other currencies are null."""
    bare = F.trim(text)
    return F.when(bare.rlike(r"^(?:US)?\$\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?$|^(?:US)?\$\s?\d+(?:\.\d+)?$"), F.regexp_replace(bare, r"[^\d.]", "").try_cast("double"))


def dot_price(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"[^\d.]", ""), F.lit("")).try_cast("double")


def cents(amount: Column) -> Column:
    return F.round(amount / 100, 2)


def magnitude_count(text: Column) -> Column:
    """Counts written with ``mil`` for thousands or ``mi`` for millions."""
    digits = F.regexp_extract(F.lower(text), r"([\d.,]+)\s*(mil|mi)?\b", 1)
    unit = F.regexp_extract(F.lower(text), r"([\d.,]+)\s*(mil|mi)?\b", 2)
    scaled = F.replace(digits, F.lit(","), F.lit(".")).try_cast("double") * F.when(unit == "mil", 1000).otherwise(1_000_000)
    return F.when(unit != "", F.round(scaled).cast("long")).otherwise(first_int(F.nullif(digits, F.lit(""))))


def rating(text: Column) -> Column:
    value = F.replace(F.regexp_extract(text, r"\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value.between(0, 5), value)


def discount_percent(price: Column, was: Column) -> Column:
    return F.when((was > price) & (price > 0), F.bround((was - price) / was * 100, 1))


def list_price(price: Column, was: Column) -> Column:
    """The former price, only where it is higher."""
    return F.when(was > price, was)


def brl_label(price: Column) -> Column:
    body = F.translate(F.format_number(price, 2), ",.", ".,")
    whole = F.translate(F.format_number(price, 0), ",", ".")
    return F.when(price.isNull(), "Sob consulta").otherwise(F.concat(F.lit("R$ "), F.when(price == F.floor(price), whole).otherwise(body)))


def usd_label(price: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(price, 2))


def epoch_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def compact_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{8}$"), F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def iso_prefix(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))


def date_parts(parts: Column) -> Column:
    """``[year, month, day]``, as far as given, joined by hyphens; null for none."""
    known = F.filter(parts, lambda x: x.isNotNull())
    written = F.transform(known, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")))
    return F.nullif(F.array_join(written, "-"), F.lit(""))


def duration_seconds(text: Column) -> Column:
    """Seconds of ``15s``, ``1m``, ``1500ms``, ``2h``, ``7d``; a bare number is seconds."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*$", 1).try_cast("double")
    unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*(ms|s|m|h|d)?\s*$", 2)
    return number * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).when(unit == "d", 86400.0).otherwise(1.0)


def clock(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS``; null for negative and missing values."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(s >= 0, F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r)))


def first_distinct(texts: Column, n: int) -> Column:
    """The first ``n`` distinct trimmed strings that are not empty."""
    kept = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.slice(F.array_distinct(kept), 1, n)


def first_filled(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in texts])


def cheapest(variants: Column, price: str) -> Column:
    """The variant with the lowest price, ties by the rest of its fields."""
    priced = F.filter(variants, lambda v: v[price].isNotNull())
    return F.array_min(F.transform(priced, lambda v: F.struct(v[price].alias("price"), v.alias("variant"))))["variant"]


def doi(text: Column) -> Column:
    """The DOI within a text, lower case, without closing punctuation."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract(text, r"""10\.\d{4,9}/[^\s"'<>]+""", 0), r"[.,;:)\]]+$", "")), F.lit(""))


def repository_url(text: Column) -> Column:
    """Repository addresses of any scheme as plain https, without ``.git``."""
    x = F.regexp_replace(F.trim(text), r"^git\+", "")
    x = F.regexp_replace(x, r"^(?:git|ssh|http)://(?:[^@/]+@)?", "https://")
    x = F.regexp_replace(x, r"^(?:[\w.-]+@)([\w.-]+):", "https://$1/")
    return F.regexp_replace(x, r"\.git$", "")


def orcid(text: Column) -> Column:
    """The ORCID within a text, without its address (URL20)."""
    return F.nullif(F.upper(F.regexp_extract(text, r"(?i)(\d{4}-\d{4}-\d{4}-\d{3}[\dX])", 1)), F.lit(""))


_PII = r"^[SB][0-9X-]{9,}$"


def pii(path: Column) -> Column:
    """The publisher item id of an article path: what follows ``pii``, else a last segment of its form
    (URL20)."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    at = F.array_position(F.transform(segments, F.lower), "pii").cast("int")
    named = F.upper(F.get(segments, at))
    last = F.upper(F.element_at(F.concat(F.array(F.lit("")), segments), -1))
    found = F.when((at > 0) & (at < F.size(segments)), named).otherwise(last)
    return F.when(found.rlike(_PII), found)


def pmcid(path: Column) -> Column:
    """The number of a path's ``PMC`` segment, without the letters (URL20)."""
    hits = F.filter(F.split(path, "/"), lambda s: s.rlike(r"(?i)^PMC[0-9]+$"))
    return F.substr(F.get(hits, F.lit(0)), F.lit(4))


def compact(row: Column, schema: T.StructType) -> Column:
    """A struct as JSON text without null and empty values: texts, lists, maps and records (ARR02)."""
    kept = []
    for field in schema.fields:
        x = row[field.name]
        if isinstance(field.dataType, T.StringType):
            x = F.nullif(x, F.lit(""))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
            x = F.when(F.size(x) > 0, x)
        elif isinstance(field.dataType, T.StructType):
            x = F.when(F.to_json(x) != "{}", x)
        kept.append(x.alias(field.name))
    return F.to_json(F.struct(*kept))
