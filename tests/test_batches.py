"""Batches and heartbeats on streams, with a query that dies between writing and committing."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.streaming import batches, events

SCHEMA = "n long, ts timestamp"


def put(spark, folder, name, rows):
    """One file, so one micro-batch."""
    spark.createDataFrame(rows, "n long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def play(spark, folder, frame, out, checkpoint, fail_at=None):
    def store(batch, epoch):
        events.store_epoch(batch, epoch, out)
        if fail_at == epoch:
            raise RuntimeError("killed after the write")

    query = frame.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    except Exception:
        if fail_at is None:
            raise


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


@pytest.mark.parametrize("fail_at", [None, 1])
def test_batches_close_by_size_or_time_and_survive_a_crash(spark, tmp_path, fail_at):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = {"a": [(k, f"2024-01-01 00:00:{k:02d}") for k in range(7)] + [(5, "2024-01-01 00:00:05")], "b": [(100 + k, "2024-01-01 00:05:00") for k in range(2)], "c": [(200, "2024-01-01 01:00:00")], "d": [(300, "2024-01-01 03:00:00")]}
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name, rows in files.items():
            put(spark, folder, name, rows)
            frame = batches.batched(stream(spark, folder), ["n", "ts"], "ts", 4, 60.0, lanes=1)
            if name == "b" and fail_at is not None:
                play(spark, folder, frame, out, str(tmp_path / "ck"), fail_at)
                frame = batches.batched(stream(spark, folder), ["n", "ts"], "ts", 4, 60.0, lanes=1)
            play(spark, folder, frame, out, str(tmp_path / "ck"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = defaultdict(list)
    for r in spark.read.parquet(out).collect():
        got[r["batch"], r["closed_by"]].append((r["place"], json.loads(r["body"])["n"]))
    numbers = {k: sorted(n for _, n in v) for k, v in got.items()}
    assert numbers[0, "size"] == [0, 1, 2, 3] and numbers[1, "time"] == [4, 5, 6] and numbers[2, "time"] == [100, 101]
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in got.values())
    stored = [n for v in numbers.values() for n in v]
    # Nothing is lost or stored twice; the last record may still wait.
    assert len(stored) == len(set(stored)) and set(stored) | {300} == {*range(7), 100, 101, 200, 300}


def test_heartbeats_expire(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name, rows in {"a": [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:02")], "b": [(2, "2024-01-01 00:10:00")], "c": [(2, "2024-01-01 00:20:00")]}.items():
            put(spark, folder, name, rows)
            beats = stream(spark, folder).withColumn("ms", F.col("n") * 100.0 + F.second("ts"))
            play(spark, folder, batches.heartbeats(beats, "n", "ts", "ms", 60.0), str(tmp_path / "out"), str(tmp_path / "ck"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    seen = sorted((r["member"], str(r["at"]), round(r["average"], 6), r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert (1, "2024-01-01 00:00:02", 100.6, "ACTIVE") in seen and (1, "2024-01-01 00:00:02", 100.6, "OFFLINE") in seen
    assert (2, "2024-01-01 00:00:01", 201.0, "ACTIVE") in seen


def test_registry_of_a_table(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00"), ("a", "2024-01-01 00:30:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    assert {r.member: r.status for r in batches.registry(df, "k", "t", "10 MINUTES").collect()} == {"a": "OFFLINE", "b": "ACTIVE"}
