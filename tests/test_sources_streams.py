import json

import pytest
from pyspark.sql import functions as F

from graphloom.graphview import table
from graphloom.sources import graph_json
from graphloom.streaming import events as streams


def test_graph_json_both_spellings(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"nodes": [{"id": "x", "type": "T"}, {"id": "y", "entity_type": "U", "label": "Y"}], "links": [{"source": "x", "target": "y"}, {"source": "x"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"nodes": [], "edges": [{"source": "p", "target": "q", "relationship": "R", "weight": 2.5}]}))
    nodes, edges = graph_json.read_graph(spark, str(tmp_path))
    assert sorted((r["id"], r["label"], r["entity_type"]) for r in nodes.collect()) == [("x", "x", "T"), ("y", "Y", "U")]
    assert sorted((r["src"], r["dst"], r["relationship"], r["weight"]) for r in edges.collect()) == [("p", "q", "R", 2.5), ("x", "y", "RELATED_TO", 1.0)]


def test_records_skip_broken_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert sorted(r["a"] for r in graph_json.read_records(spark, str(tmp_path / "r.jsonl"), "a INT").collect()) == [1, 2]


def test_refuse_shrink(spark):
    with pytest.raises(ValueError):
        graph_json.refuse_shrink(spark.range(20), spark.range(3))
    graph_json.refuse_shrink(spark.range(20), spark.range(15))


def test_tumbling_counts_equal_batch(spark, sf, tmp_path):
    batch = table(spark, sf, "events")
    batch.select("event_id", "event_type", batch.ts.cast("timestamp").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id LONG, event_type STRING, ts TIMESTAMP").parquet(str(tmp_path / "in"))
    q = streams.tumbling_counts(stream, "event_type", "ts", "1 day", "0 seconds").writeStream.format("memory").queryName("days").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = streams.tumbling_counts(spark.read.parquet(str(tmp_path / "in")), "event_type", "ts", "1 day", "0 seconds")
    assert sorted(map(tuple, spark.table("days").collect())) == sorted(map(tuple, want.collect()))


def test_batches_are_stored_once_and_paths_are_distinct(spark, tmp_path):
    path = str(tmp_path / "kept")
    first = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    streams.append_once(first, path, ["k"])
    streams.append_once(spark.createDataFrame([(2, "b"), (3, "c")], "k long, v string"), path, ["k"])
    streams.append_once(first.limit(0), path, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert streams.changed_paths(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "p string"), "p") == ["a", "b"]


def test_first_sight_and_limits_on_a_stream(spark, tmp_path):
    rows = [(k % 2, f"2024-01-01 00:0{k}:00") for k in range(6)]
    spark.createDataFrame(rows, "k long, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    for name, frame in (("first", streams.first_sight(stream, ["k"], "ts", "1 hour")), ("over", streams.over_limit(stream, "k", "ts", "1 hour", "0 seconds", 2)), ("seen", streams.visible(stream.withColumn("kind", F.lit("x")), "k", 0, ["x"]))):
        frame.writeStream.format("memory").queryName(name).outputMode("append" if name != "over" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("first").count() == 2 and spark.table("over").count() == 2 and spark.table("seen").count() == 3


def test_refuse_loss(spark):
    for a, b in ((49, 1), (50, 49), (100, 99), (1000, 990), (50, 60)):
        graph_json.refuse_loss(spark.range(a), spark.range(b))
    for a, b in ((50, 48), (1000, 989), (60, 0)):
        with pytest.raises(ValueError):
            graph_json.refuse_loss(spark.range(a), spark.range(b))
