from webstrata.streaming import jobs as J


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_strategies(spark, tmp_path):
    rows = [("a", "http", False, f"2024-01-01 00:00:0{i}", i) for i in range(3)] + [("b", "http", True, "2024-01-01 00:00:09", 9)]
    schema = "route_key STRING, mode STRING, success BOOLEAN, ts STRING, id LONG"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = drain(J.route_strategies(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "strategies", "update")
    assert {r.route_key: (r.preferred_mode, r.success_count, r.failure_count) for r in out.collect()} == {"a": ("browser", 0, 0), "b": ("http", 1, 0)}


def test_single_flight_windows_and_sink(spark, tmp_path):
    rows = [("fetch", "ok", "u", "2024-01-01T00:00:00"), ("fetch", "ok", "u", "2024-01-01T00:00:05"), ("fetch", "fail", "v", "2024-01-01T01:00:05")]
    schema = "tool STRING, outcome STRING, url STRING, ts TIMESTAMP"
    df = spark.createDataFrame(rows, "tool STRING, outcome STRING, url STRING, ts STRING").selectExpr("tool", "outcome", "url", "cast(ts as timestamp) ts")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert drain(J.single_flights(stream(), ["tool", "url"]), "flights", "append").count() == 2
    assert sorted(r.n for r in drain(J.outcome_windows(stream()), "windows", "update").collect()) == [1, 2]
    q = J.append_events(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.json(str(tmp_path / "out")).count() == 3
