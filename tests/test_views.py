"""Views and extraction on small tables with nulls, ties and empty input."""

from pyspark.sql import functions as F

from graphloom.operators import extracts, views


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_dedup_keeps_the_first_and_the_longest_text(spark):
    nodes = spark.createDataFrame([("a", "x"), ("b", "longer"), ("c", None), ("d", "alone")], "id string, description string")
    edges = spark.createDataFrame([("b", "d", "R"), ("a", "d", "R"), ("a", "b", "R")], "src string, dst string, relationship string")
    canonical = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", None)], "id string, canonical string")
    kept, moved = views.deduplicated(nodes, edges, canonical)
    assert rows(kept) == [("a", "longer"), ("c", None), ("d", "alone")] and rows(moved) == [("a", "d", "R")]


def test_view_takes_neighbours_up_to_twice_the_limit(spark):
    nodes = spark.createDataFrame([(x, "T" if x in "ab" else "U") for x in "abcdef"], "id string, entity_type string")
    edges = spark.createDataFrame([("a", "c"), ("a", "d"), ("a", "e"), ("b", "c")], "src string, dst string")
    assert rows(views.selected_view(nodes, edges, None, ["T"], 1)) == [("a", 3, True), ("c", 2, False)]
    scores = spark.createDataFrame([("f", 9.0), ("b", 1.0)], "id string, score double")
    assert rows(views.selected_view(nodes, edges, scores, None, 1, neighbors=False)) == [("f", 0, True)]


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select("id", (F.col("id") % 10).alias("v"), (F.col("id") % 2).alias("g"))
    got = extracts.bootstrap_interval(df, F.col("g"), "v", "id", 200).collect()
    assert len(got) == 2 and all(r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.5 for r in got)


def test_manifests_and_endpoints_skip_what_is_not_json(spark):
    df = spark.createDataFrame([("p", '{"dependencies": {"a": "1"}}'), ("q", "no"), ("r", None), ("s", '{"paths": {"/x": {"get": {}, "servers": []}}}')], "path string, text string")
    assert rows(extracts.manifest_edges(df, "path", "text")) == [("p", "dep:a", "DEPENDS_ON", "1")]
    assert rows(extracts.endpoints(df, "path", "text")) == [("GET /x", "GET", "/x")]


def test_streaks_forgive_the_last_day(spark):
    days = [("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-03"), ("c", "2024-01-01"), ("c", "2024-01-03"), ("c", "2024-01-02"), ("d", "2024-01-01")]
    df = spark.createDataFrame(days, "k string, d string").withColumn("d", F.to_date("d"))
    assert rows(extracts.streaks(df, "k", "d")) == [("a", 2, 2), ("b", 1, 1), ("c", 3, 3), ("d", 0, 1)]


def test_samples_are_the_same_on_every_run(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a, b = (rows(views.sampled(df.repartition(n), "k", 10, 42)) for n in (1, 7))
    assert a == b and len(a) == 10 and rows(views.sampled(df, "k", 10, 43)) != a
