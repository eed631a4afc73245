import datetime as dt
import random

from pyspark.sql import functions as F

from quantloom.operators import records
from quantloom.streaming import events, latest


def test_streams_give_the_batch_results(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    landed = str(tmp_path / "landed")
    batch.unionByName(batch.limit(50)).repartition(1).write.parquet(landed)
    stream = events.record_stream(spark, landed, batch.schema)

    def run(df, name):
        events.run_to_end(df, str(tmp_path / name), str(tmp_path / f"{name}-state"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / name))

    assert run(events.first_of_each(stream), "first").count() == batch.count()
    daily = run(events.windowed_activity(stream, ("event_type",), late="1 hour"), "daily")
    whole = batch.unionByName(batch.limit(50)).groupBy(F.window("ts", "1 day").alias("w"), "event_type").count()
    closed = daily.agg(F.max("window_end")).first()[0]
    assert daily.agg(F.sum("n")).first()[0] == whole.where(F.col("w.end") <= F.lit(closed)).agg(F.sum("count")).first()[0]
    assert run(events.sessions(stream, ("user_id",)), "sessions").where("session_end <= session_start").count() == 0


def test_late_corrections_give_the_batch_result(spark, tmp_path):
    rng = random.Random(8)
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice(["x", "y"]), at(rng.choice([rng.randint(0, 500), 100, 400])), k, float(k)) for k in range(300)]
    rows += [("a", "x", None, 300, 1.0), ("b", "y", at(3), None, 1.0)]
    schema = "instrument_id string, event_type string, available_at timestamp, seq long, value double"
    landed = tmp_path / "landed"
    files = [rows[k::7] for k in range(7)]
    rng.shuffle(files)
    for k, some in enumerate(files):  # out of order, one file a batch
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(landed / f"part={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landed)).drop("part")
    key = ("instrument_id", "event_type")
    found = latest.last_of_each(stream, key)
    for _ in range(2):  # a restart goes on from its state and adds nothing
        events.run_to_end(found, str(tmp_path / "out"), str(tmp_path / "state"))
    updates = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    batch = records.one_of_each(spark.createDataFrame(rows, schema).where("available_at IS NOT NULL AND seq IS NOT NULL"), key, F.struct("available_at", "seq"))
    assert sorted(map(str, latest.settled(updates, key).select(batch.columns).collect())) == sorted(map(str, batch.collect()))
    corrections = updates.where("corrects").count()
    assert corrections > 0 and updates.count() == corrections + updates.where("revision = 1").count() and updates.where("revision = 1").count() == 8
