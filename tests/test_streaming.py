from pyspark.sql import functions as F

from covertile.streaming import sessions


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def stream(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_tumbling_matches_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "value")
    got = run(spark, sessions.tumbling(stream(spark, events, tmp_path / "e"), "ts", "1 hour", "1 hour", ["user_id"], "value"), "tumble")
    want = {(r["user_id"], r["h"]): r["n"] for r in events.groupBy("user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h")).agg(F.count("*").alias("n")).collect()}
    rows = got.collect()
    assert rows and all(want[r["user_id"], r["start"]] == r["n"] for r in rows)


def test_gap_sessions_match_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("ts", "user_id", "value")
    got = run(spark, sessions.gap_sessions(stream(spark, events, tmp_path / "g"), "ts", "30 minutes", "10 minutes", ["user_id"], "value"), "gaps")
    batch = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    want = {(r["user_id"], r["w"]["start"]): r["n"] for r in batch.collect()}
    rows = got.collect()
    assert len(want) - len(rows) <= 5 and all(want[r["user_id"], r["start"]] == r["n"] for r in rows)


def windows(spark, rows):
    return spark.createDataFrame(rows, "sample string, chrom string, start long, end long, depth double, cn int, change double, time timestamp")


def test_aberrant_sessions_match_batch(spark, sf, tmp_path):
    """All runs, the last one of every key included, with no row behind them."""
    from datetime import datetime, timedelta

    from covertile.operators.copynumber import aberrant_runs
    from covertile.plans import catalog

    begin = datetime(2024, 1, 1)
    changes = [0.0, -1.0, -1.2, -1.0, 0.0, 0.9, 0.8, 0.7]
    rows = [(s, "c", k * 1000, k * 1000 + 1000, 1.0, 1, c, begin + timedelta(seconds=k)) for s in "ab" for k, c in enumerate(changes)]
    df = windows(spark, rows)
    got = run(spark, sessions.aberrant_sessions(stream(spark, df.coalesce(1), tmp_path / "a"), late="0 seconds", idle_ms=0), "aberrant")
    want = sorted((r["sample"], r["start"], r["end"], r["n"]) for r in aberrant_runs(df).collect())
    assert sorted((r["sample"], r["start"], r["end"], r["n"]) for r in got.collect()) == want == [("a", 2000, 8000, 4), ("b", 2000, 8000, 4)]
    # the query's own windows, one batch
    states = catalog._states(spark, sf).withColumn("time", F.timestamp_seconds("start"))
    got = run(spark, sessions.aberrant_sessions(stream(spark, states.coalesce(1), tmp_path / "q"), late="0 seconds", idle_ms=0, gap=200), "aberrant_query")
    # a run's windows near the ordinary state are in its extent on the stream and out of it in the batch form
    batch = {(r["sample"], r["chrom"]) for r in catalog.QUERIES["aberrant_runs"](spark, sf).collect()}
    assert {(r["sample"], r["chrom"]) for r in got.collect()} >= batch


def test_timers_delete_the_state_of_finished_keys(spark, tmp_path):
    from datetime import datetime, timedelta

    begin = datetime(2024, 1, 1)
    first = [("a", "c", k * 1000, k * 1000 + 1000, 1.0, 1, 0.9, begin + timedelta(seconds=k)) for k in range(3)]
    later = [("b", "c", k * 1000, k * 1000 + 1000, 1.0, 1, 0.0, begin + timedelta(hours=3, seconds=k)) for k in range(2)]
    path = tmp_path / "t"
    windows(spark, first).coalesce(1).write.parquet(str(path))
    source = spark.readStream.schema(windows(spark, first).schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    q = sessions.aberrant_sessions(source, late="0 seconds").writeStream.format("memory").queryName("timers").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        q.processAllAvailable()
        assert spark.table("timers").count() == 0  # a is open, its timer an hour away
        windows(spark, later).coalesce(1).write.mode("append").parquet(str(path))
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("timers").collect()] == [("a", "c", 0, 3000, 3)]
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # b alone
    finally:
        q.stop()
