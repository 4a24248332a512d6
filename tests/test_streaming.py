"""Streams against their batch forms."""

import datetime as dt

from pyspark.sql import functions as F

from quillspark.operators.metrics import breaker_states
from quillspark.sources.library import Library
from quillspark.streaming import flows


def drained(df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def test_outbox(spark, data, tmp_path):
    events = Library(spark, data).events_v.drop("value").withColumn("created_at", F.col("created_at").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = flows.event_stream(spark, str(tmp_path / "in"), files_per_batch=1)
    flows.dispatch(stream, flows.jobs_to_parquet(str(tmp_path / "out")), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "job")
    want = flows.dispatched(events).where("job IS NOT NULL").select("id", "job")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_watchdog(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, "in_progress", 0), (2, "in_progress", 0), (2, "succeeded", 5), (3, "in_progress", 50), (9, "succeeded", 100)]
    for i, (page, state, minute) in enumerate(rows):
        spark.createDataFrame([(page, state, t0 + dt.timedelta(minutes=minute))], "page_id long, state string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("page_id long, state string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = drained(flows.watchdog(stream), "silent", "append")
    assert {r["page_id"] for r in got.collect()} >= {1} and not {2, 9} & {r["page_id"] for r in got.collect()}


def test_rate_limits(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).alias("key"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drained(flows.rate_limits(stream, "1 day", 5), "limits", "complete")
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "key").count()
    assert sorted((r["window_start"], r["key"], r["n"]) for r in got.collect()) == sorted((r["w"]["start"], r["key"], r["count"]) for r in want.collect())


def test_breakers_as_in_batch(spark, data, tmp_path):
    calls = spark.read.parquet(f"{data}/events.parquet").select((F.col("user_id") % 4).alias("key"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("id"), (F.col("value") > 60).alias("ok"))
    calls.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).parquet(str(tmp_path / "in"))
    got = {r["key"]: (r["state"], r["n_refused"]) for r in drained(flows.breakers(stream, cooling=3600.0), "breakers", "update").collect()}
    want = {r["key"]: (r["state"], r["n_refused"]) for r in breaker_states(calls, cooling=3600).collect()}
    assert got == want


def test_daily_usage_as_in_batch(spark, data, tmp_path):
    from quillspark.operators.metrics import daily_quota

    events = spark.read.parquet(f"{data}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    users = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, "reader").when(F.col("id") % 3 == 1, "editor").otherwise("admin").alias("role"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(flows.daily_usage(stream, users, late="1000 days"), "usage", "complete")
    usage = events.groupBy("user_id", F.to_date("ts").alias("usage_date")).agg(F.count("*").alias("cnt"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, daily_quota(usage, users).collect()))
    assert got.count() > 100


def test_sessions_end_after_a_gap(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m)) for m in (0, 10, 39, 80)] + [(2, t0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in"))
    got = drained(flows.sessions(stream), "sessions", "complete")
    assert sorted((r["user_id"], r["n"]) for r in got.collect()) == [(1, 1), (1, 3), (2, 1)]
