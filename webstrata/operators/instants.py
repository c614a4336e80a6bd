"""Timestamps of many formats and zones, brought to one UTC instant through a value dictionary.

Raw strings are reduced to distinct (string, zone, day order) values; each value is parsed once, by
built-in expressions; the dictionary is a table that later runs read and extend by the values it lacks;
the instants are joined back to the rows.  Local times follow the zone's rules of that day: a time that
occurs twice is the earlier instant, one that never occurs is read with the offset before the change.

A value that states no valid calendar date (also null, empty and blank ones) has no instant.  A site
without a known zone counts as UTC with the month first.
"""

from __future__ import annotations

import hashlib
import inspect
from functools import reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions.urls import host_of
from webstrata.session import shared_dir

# Month names, January to December, of each language.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "pt": "janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "it": "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre",
    "ru": "января февраля марта апреля мая июня июля августа сентября октября ноября декабря",
    "ru nominative": "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь",
}
# Further spellings.
MORE_MONTHS = {"setiembre": 9, "sept": 9, "jänner": 1, "marco": 3, "fevrier": 2, "aout": 8, "decembre": 12, "maerz": 3}


def month_numbers() -> dict[str, int]:
    """Names, and their first three and four letters where all languages agree on the month."""
    full = {name: i for names in MONTHS.values() for i, name in enumerate(names.split(), 1)} | MORE_MONTHS
    short: dict[str, set[int]] = {}
    for name, number in full.items():
        for size in (3, 4):
            short.setdefault(name[:size], set()).add(number)
    return {k: min(v) for k, v in short.items() if len(v) == 1} | full


_ZONE = r"(?:\s*(z|utc|gmt|[+-]\d{1,2}(?::?\d{2})?)?\s*(?:\[?([a-z]+(?:/[a-z_+\-0-9]+)+)\]?|\(?[a-z]{2,5}\)?)?)"
_CLOCK = r"(\d{1,2})[:h.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9}))?)?\s*(?:uhr\b)?\s*(?:([ap])\.?m\b\.?)?"
_TO_CLOCK = r"(?:\s*[,t]\s*|\s+)(?:(?:um|alle|ore|às|as|à|a\s+las|at|в|,|-|·)\s+)*"
_WEEKDAY = r"(?:[\p{L}]+\.?\s*,\s*)?"
_END = r"\s*(?:г\.?|года)?"
_TIME = rf"(?:{_TO_CLOCK}{_CLOCK})?{_ZONE}$"
# Which groups hold year, month and day; the clock follows: hour, minute, second, fraction, half, offset, zone.
FORMS = {
    "iso": (rf"(?iU)^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}", "ymd"),
    "numeric": (rf"(?iU)^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}", "site"),
    "day month": (
        rf"(?iU)^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th|er|º|°|\.)?[\s-]+(?:de\s+|di\s+)?(\p{{L}}+)\.?[\s,-]+(?:de\s+|di\s+|del\s+)?(\d{{4}}){_END}{_TIME}",
        "dmy",
    ),
    "month day": (rf"(?iU)^{_WEEKDAY}(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}}){_TIME}", "mdy"),
}
_COMPACT = rf"(?iU)^(\d{{4}})(\d{{2}})(\d{{2}})(?:t?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?)?{_ZONE}$"
_EPOCH = r"^(\d{9,10}|\d{13}|\d{16}|\d{19})(?:\.(\d{1,6})\d*)?$"


def _number(x: Column) -> Column:
    return F.when(x != "", x).try_cast("int")


def _instant(y: Column, m: Column, d: Column, clock: list[Column], site_zone: Column) -> Column:
    """Microseconds of a date and the clock's parts (hour, minute, second, fraction, half, offset, zone)."""
    hour, minute, second, fraction, half, offset, zone = clock
    h = F.coalesce(_number(hour), F.lit(0))
    half = F.lower(half)
    h12 = F.when((h >= 1) & (h <= 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    h = F.when(half == "", h).otherwise(h12)
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0")
    sec = F.concat(F.lpad(F.when(second == "", "0").otherwise(second), 2, "0"), F.lit("."), micros).try_cast("decimal(16,6)")
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    hours = F.when(F.length(digits).isin(1, 3), F.concat(F.lit("0"), digits)).otherwise(digits)
    signed = F.concat(F.substring(offset, 1, 1), F.substring(hours, 1, 2), F.lit(":"), F.rpad(F.substring(hours, 3, 2), 2, "0"))
    at = (
        F.when(F.lower(offset).isin("z", "utc", "gmt"), F.lit("UTC"))
        .when((digits != "") & (F.substring(hours, 1, 2) <= "18"), signed)
        .when(zone.isin(*sorted(available_timezones())), zone)
        .otherwise(site_zone)
    )
    return F.unix_micros(F.try_make_timestamp(y, m, d, h, F.coalesce(_number(minute), F.lit(0)), sec, at))


def parse_instant(raw: Column, site_zone: Column, day_first: Column) -> Column:
    """Microseconds since 1970 UTC that ``raw`` states, or null."""
    text = F.regexp_replace(F.regexp_replace(raw, r"[​‌‍⁠﻿]", ""), r"(?U)^\s+|\s+$", "")
    names = month_numbers()
    months = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    zone = F.coalesce(site_zone, F.lit("UTC"))
    found = []
    for pattern, order in FORMS.values():
        g = [F.regexp_extract(text, pattern, i) for i in range(1, 11)]
        if order == "ymd":
            y, m, d = (_number(x) for x in g[:3])
        elif order == "site":
            y = _number(g[2])
            first, second = _number(g[0]), _number(g[1])
            order_known = F.coalesce(day_first, F.lit(False))
            m, d = F.when(order_known, second).otherwise(first), F.when(order_known, first).otherwise(second)
        else:
            y, d = _number(g[2]), _number(g["dm".index(order[0])])
            m = F.try_element_at(months, F.lower(g["md".index(order[0])]))
        found.append(F.when(g[2] != "", _instant(y, m, d, g[3:], zone)))
    g = [F.regexp_extract(text, _COMPACT, i) for i in range(1, 10)]
    clock = [*g[3:7], F.lit(""), g[7], g[8]]
    compact = F.when((g[2] != "") & ~text.rlike(r"^\d{9,}$"), _instant(*(_number(x) for x in g[:3]), clock, zone))
    ticks, part = F.regexp_extract(text, _EPOCH, 1), F.regexp_extract(text, _EPOCH, 2)
    n = F.when(ticks != "", ticks).try_cast("decimal(20,0)").try_cast("long")
    epoch = (
        F.when(F.length(ticks) <= 10, n * 1_000_000 + F.coalesce(_number(F.when(part != "", F.rpad(part, 6, "0"))), F.lit(0)))
        .when(F.length(ticks) == 13, n * 1000)
        .when(F.length(ticks) == 16, n)
        .otherwise(F.floor(n / 1000))
    )
    return reduce(lambda a, b: F.coalesce(a, b), [*found, compact, epoch])


KEYS = ["raw", "zone", "day_first"]


def rules_version() -> str:
    """Changes whenever this module does: instants kept under other rules are not taken."""
    return hashlib.sha256(inspect.getsource(inspect.getmodule(rules_version)).encode()).hexdigest()[:16]


def dictionary_folder(spark: SparkSession, name: str = "instants") -> str:
    """Where the shared folder keeps the dictionary of these rules."""
    return f"{shared_dir(spark)}/webstrata-{name}-{rules_version()}"


def kept_dictionary(spark: SparkSession, folder: str) -> DataFrame | None:
    """The dictionary kept in ``folder``, or None.  Values that two runs added at the same time are taken
    once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("raw STRING, zone STRING, day_first BOOLEAN, utc_us LONG").parquet(folder).dropDuplicates(KEYS)


def extend_dictionary(values: DataFrame, folder: str) -> DataFrame:
    """The dictionary kept in ``folder``, after the values it lacks were parsed and added to it.  ``values``
    has non-null ``raw``, ``zone`` and ``day_first``."""
    spark = values.sparkSession
    distinct, known = values.select(*KEYS).distinct(), kept_dictionary(spark, folder)
    new = distinct if known is None else distinct.join(known, KEYS, "left_anti")
    # the values are few and narrow beside the work of parsing one: spread them over all cores
    parsed = new.repartition(2 * spark.sparkContext.defaultParallelism).withColumn("utc_us", parse_instant(F.col("raw"), F.col("zone"), F.col("day_first")))
    parsed.write.mode("append").parquet(folder)
    return kept_dictionary(spark, folder)


def record_instants(fetches: DataFrame, sites: DataFrame, folder: str | None = None) -> DataFrame:
    """(fetch_id, field, utc_us) of every ``published`` and ``modified`` with a valid date.

    ``folder`` keeps the dictionary from run to run; by default the one of the shared folder.  Redelivered
    fetches count once.  ``sites`` has one row per host and is joined without a forced broadcast; a value
    shared by very many rows is one dictionary row, and the join back splits it by adaptive skew
    handling."""
    narrow = fetches.select("fetch_id", host_of(F.col("url")).alias("host"), "published", "modified").dropDuplicates(["fetch_id"])
    rows = (
        narrow.select("fetch_id", "host", F.explode(F.create_map(F.lit("published"), "published", F.lit("modified"), "modified")).alias("field", "raw"))
        .where("raw IS NOT NULL")
        .join(sites.select("host", F.col("time_zone").alias("zone"), "day_first"), "host", "left")
        .select("fetch_id", "field", "raw", F.coalesce("zone", F.lit("UTC")).alias("zone"), F.coalesce("day_first", F.lit(False)).alias("day_first"))
    )
    dictionary = extend_dictionary(rows, folder or dictionary_folder(fetches.sparkSession)).where("utc_us IS NOT NULL")
    return rows.join(dictionary, KEYS).select("fetch_id", "field", "utc_us")
