from pyspark.sql import functions as F

from webstrata.functions import values as V


def check(spark, function, pairs):
    df = spark.createDataFrame([(a,) for a, _ in pairs] + [(None,)], "x STRING")
    assert [r[0] for r in df.select(function(F.col("x"))).collect()] == [b for _, b in pairs] + [None]


def test_numbers(spark):
    check(spark, V.brl_number, [("R$ 3.899", 3899.0), ("357,90", 357.9), ("R$ 1 . 544 , 99", 1544.99), ("Sob consulta", None)])
    check(spark, V.brl_int, [("R$ 1.278,00", 1278), ("x", None)])
    check(spark, V.first_int, [("32m²", 32), ("1.200", 1200), ("-", None)])
    check(spark, V.usd_number, [("$1,234.50", 1234.5), ("€5", None), ("$7", 7.0)])
    check(spark, V.magnitude_count, [("+5 mil vendidos", 5000), ("1,2 mi", 1_200_000), ("37 sold", 37)])
    check(spark, V.rating, [("4,8 de 5", 4.8), ("9 stars", None)])
    check(spark, V.duration_seconds, [("15s", 15.0), ("1500ms", 1.5), ("7d", 604800.0), ("3", 3.0), ("x", None)])
    check(spark, V.doi, [("https://doi.org/10.1000/ABC.1).", "10.1000/abc.1"), ("none", None)])
    check(spark, V.repository_url, [("git+https://h/a/b.git", "https://h/a/b"), ("git@h.com:a/b.git", "https://h.com/a/b"), ("ssh://git@h/a", "https://h/a")])


def test_clock_and_parts(spark):
    df = spark.createDataFrame([(3661, [2020, 3, 5]), (59, [2020]), (-1, []), (None, None)], "s LONG, p ARRAY<INT>")
    got = [tuple(r) for r in df.select(V.clock(F.col("s")), V.date_parts(F.col("p"))).collect()]
    assert got == [("1:01:01", "2020-03-05"), ("0:59", "2020"), (None, None), (None, None)]


def test_arrays(spark):
    df = spark.createDataFrame([([" a", "a", None, "", "b", "c"],)], "x ARRAY<STRING>")
    assert df.select(V.first_distinct(F.col("x"), 2)).first()[0] == ["a", "b"]
