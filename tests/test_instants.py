from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from webstrata.operators.instants import parse_instant, record_instants


def micros(x):
    return int((x - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


CASES = [
    ("2023-01-22T21:28:43Z", "Europe/Rome", True, "2023-01-22T21:28:43+00:00"),
    ("20230327T035354Z", "UTC", True, "2023-03-27T03:53:54+00:00"),
    ("2023-07-04T22:48:21.481139", "America/New_York", False, "2023-07-05T02:48:21.481139+00:00"),
    ("2023-12-28 18:53:16.853785+11", "UTC", True, "2023-12-28T07:53:16.853785+00:00"),
    ("2023-11-20T04:04:32-03:00", "UTC", True, "2023-11-20T07:04:32+00:00"),
    ("2023-11-01T23:36:27.813-0500", "UTC", True, "2023-11-02T04:36:27.813+00:00"),
    ("1698195237", "UTC", True, "2023-10-25T00:53:57+00:00"),
    ("1676420893435", "UTC", True, "2023-02-15T00:28:13.435+00:00"),
    ("04-12-2022 16:44:43", "Europe/Berlin", True, "2022-12-04T15:44:43+00:00"),
    ("04/12/2022 16:44", "America/Chicago", False, "2022-04-12T21:44:00+00:00"),
    ("6/12/2023 06:49:23 PM", "America/New_York", False, "2023-06-12T22:49:23+00:00"),
    ("12/24/2023 12:00:00 AM", "America/New_York", False, "2023-12-24T05:00:00+00:00"),
    ("22 maggio 2023", "Europe/Rome", True, "2023-05-21T22:00:00+00:00"),
    ("September 18, 2023 8:51 PM CDT", "America/Chicago", False, "2023-09-19T01:51:00+00:00"),
    ("Tue, 12 Sep 2023 22:02:32 GMT", "America/New_York", False, "2023-09-12T22:02:32+00:00"),
    ("Wed, 27 Sep 2023 16:09:54 +0200", "UTC", True, "2023-09-27T14:09:54+00:00"),
    ("29 de diciembre de 2023, 09:30", "America/Bogota", True, "2023-12-29T14:30:00+00:00"),
    ("15 janvier 2024 à 21h07", "Europe/Paris", True, "2024-01-15T20:07:00+00:00"),
    ("30. November 2023, 08:52 Uhr", "Europe/Berlin", True, "2023-11-30T07:52:00+00:00"),
    ("18 июня 2024 г., 12:04", "Europe/Moscow", True, "2024-06-18T09:04:00+00:00"),
    ("24 de abril de 2024 às 10h09", "America/Sao_Paulo", True, "2024-04-24T13:09:00+00:00"),
    ("2023-08-04T19:45:23[Europe/Rome]", "UTC", True, "2023-08-04T17:45:23+00:00"),
    ("2023-09-02T05:35:05 America/Chicago", "UTC", True, "2023-09-02T10:35:05+00:00"),
    ("2023/12/01 18:02", "UTC", True, "2023-12-01T18:02:00+00:00"),
    # an hour that comes twice: the earlier; one that never comes: the offset before
    ("2023-11-05T01:30:00", "America/New_York", False, "2023-11-05T05:30:00+00:00"),
    ("2023-03-12T02:30:00", "America/New_York", False, "2023-03-12T07:30:00+00:00"),
    ("2018-11-04", "America/Sao_Paulo", True, "2018-11-04T03:00:00+00:00"),
    ("2024-02-29", "UTC", True, "2024-02-29T00:00:00+00:00"),
]
NONE = ["2023-02-30", "31/31/2023", "0000-00-00", "soon", "n/a", "-", "", "  ", None, "2023-13-01", "2023-01-01T25:00:00", "12345678901", "32 May 2023", "13:45"]


def test_formats(spark):
    rows = [(raw, zone, first, micros(datetime.fromisoformat(want))) for raw, zone, first, want in CASES] + [(x, "UTC", True, None) for x in NONE]
    df = spark.createDataFrame(rows, "raw STRING, zone STRING, day_first BOOLEAN, want LONG")
    got = df.select("raw", "want", parse_instant(F.col("raw"), F.col("zone"), F.col("day_first")).alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == [(r.raw, r.want) for r in got]


def test_local_times_against_the_zone_database(spark):
    """Every half hour around two changes a year, by brute force over both readings of a local time."""
    rows = []
    for zone in ("Europe/Lisbon", "Australia/Sydney", "America/Chicago"):
        z = ZoneInfo(zone)
        for day in ("2023-03-12", "2023-03-26", "2023-04-02", "2023-10-01", "2023-10-29", "2023-11-05"):
            for k in range(12):
                local = datetime.fromisoformat(day) + timedelta(minutes=30 * k)
                readings = [local.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1)]
                # fold 0 is the offset before a change, in gaps as in overlaps
                rows.append((local.isoformat(), zone, micros(readings[0])))
    df = spark.createDataFrame(rows, "raw STRING, zone STRING, want LONG")
    got = df.select("raw", "zone", "want", parse_instant(F.col("raw"), F.col("zone"), F.lit(True)).alias("got")).collect()
    assert [(r.raw, r.zone, r.got) for r in got] == [(r.raw, r.zone, r.want) for r in got]


FETCH = "fetch_id LONG, url STRING, published STRING, modified STRING, zone STRING, raw STRING"
SITES = "host STRING, time_zone STRING, day_first BOOLEAN"


def test_records(spark):
    rows = [(1, "https://a.test/x", "2023-01-01", "bad", "z", "r")] * 2 + [(2, "https://b.test", None, "01/02/2023 00:00", None, None), (3, None, "2023-01-01", None, None, None), (None, None, None, None, None, None)]
    fetches = spark.createDataFrame(rows, FETCH)
    sites = spark.createDataFrame([("a.test", "Europe/Paris", True), ("b.test", "UTC", False)], SITES)
    got = {(r.fetch_id, r.field): r.utc_us for r in record_instants(fetches, sites).collect()}
    assert got == {
        (1, "published"): micros(datetime(2022, 12, 31, 23, tzinfo=timezone.utc)),
        (2, "modified"): micros(datetime(2023, 1, 2, tzinfo=timezone.utc)),
        (3, "published"): micros(datetime(2023, 1, 1, tzinfo=timezone.utc)),
    }
    assert record_instants(fetches.limit(0), sites).count() == 0


def test_kept_dictionary(spark, tmp_path):
    rows = [(1, "https://a.test/x", "2023-01-01", "bad", "z", "r"), (2, "https://b.test", None, "2023-01-01", None, None)]
    fetches = spark.createDataFrame(rows, FETCH)
    sites = spark.createDataFrame([("a.test", "Europe/Paris", True), ("b.test", "UTC", False)], SITES)
    folder = f"file://{tmp_path}/kept"
    first = record_instants(fetches, sites, folder).collect()
    kept = spark.read.parquet(folder)
    assert kept.count() == 3
    # a second run parses nothing anew, and takes what is kept
    assert sorted(record_instants(fetches, sites, folder).collect()) == sorted(first)
    assert spark.read.parquet(folder).count() == 3
    spark.createDataFrame([("01/05/2023", "Europe/Paris", True, 7)], kept.schema).write.mode("append").parquet(folder)
    more = spark.createDataFrame([(3, "https://a.test/y", "01/05/2023", "02/05/2023", None, None)], FETCH)
    got = {r.field: r.utc_us for r in record_instants(more, sites, folder).collect()}
    assert got["published"] == 7 and got["modified"] == micros(datetime(2023, 5, 1, 22, tzinfo=timezone.utc))
    # values added twice, by two runs at a time, give no row twice
    spark.read.parquet(folder).where("raw = '2023-01-01'").toPandas().pipe(spark.createDataFrame, kept.schema).write.mode("append").parquet(folder)
    assert len(record_instants(fetches, sites, folder).collect()) == len(first)
