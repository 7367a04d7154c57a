"""Linking, reports, chunks and guards on small frames made by hand."""

import datetime as dt

from pyspark.sql import functions as F

from graphloom import plans
from graphloom.graphview import table
from graphloom.operators import linking, relations, reports, texts
from graphloom.streaming import guards


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_name_variants(spark):
    df = spark.createDataFrame([("userProfileView",), ("user_profile.py",), ("x",), (None,)], "n string").select("n", linking.name_variants(F.col("n")).alias("v"))
    got = {r["n"]: r["v"] for r in df.collect()}
    assert {"userprofileview", "user_profile_view", "userProfileView", "UserProfileView", "user-profile-view", "user profile view"} == set(got["userProfileView"])
    assert {"user_profile.py", "user_profile", "userProfile", "UserProfile", "user-profile", "user profile", "userprofile"} == set(got["user_profile.py"])
    assert got["x"] == [] and not got[None]


def test_unify_copies_and_reference_thresholds(spark, sf, tmp_path):
    df = spark.createDataFrame([("c1", "a b", "code"), ("c2", "a b", "code"), ("d1", "a b", "doc"), ("n", None, "code"), ("m", None, "code")], "id string, label string, source_type string")
    assert rows(linking.copies(df)) == [("c1", "c2")]
    known = plans.queries()
    parts = table(spark, sf, "part").count()
    whole = known["entity_unify"](spark, sf)
    named = whole.select("primary").union(whole.select("secondary")).distinct()
    assert named.count() == 2 * parts
    spark.createDataFrame([(2, "one two three"), (3, "two three four five")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = known["bridge_token_overlap"](spark, str(tmp_path)).collect()
    assert {(r["left_id"], r["right_id"], r["score"], r["links"]) for r in found if r["kind"] == "pair"} == {(2, 3, 0.4, 1)}
    assert {(r["kind"], r["left_id"], r["right_id"]) for r in found if r["kind"] != "pair"} == {("left member", 2, 2), ("right member", 3, 3)}
    left = spark.createDataFrame([(1, "Same Name"), (2, "one two three")], "id int, text string")
    right = spark.createDataFrame([(3, "same_name"), (4, "two three four five")], "id int, text string")
    exact = linking.exact_bridge(left, right, linking.normalised(F.col("text")))
    assert rows(relations.class_pairs(relations.token_classes(linking.unmatched(left, exact)), relations.token_classes(right), 0.35)) == [(2, 4, 0.4, 1)]


def test_unify_takes_other_sources_alone(spark):
    df = spark.createDataFrame([("c1", "user_profile", "code"), ("d1", "User Profile", "doc"), ("d2", "user profile", "doc"), ("z", "other", "doc"), ("n", None, "code")], "id string, label string, source_type string")
    found = rows(linking.unify(df, {"code": 1, "doc": 2}))
    assert [f[:2] for f in found] == [("c1", "d1"), ("c1", "d2")]
    assert all(f[2] == 1.0 for f in found)
    assert rows(linking.unify(df.limit(0), {"code": 1})) == []


def test_contradictions(spark):
    facts = [("Port", "code", "number", "80"), (" port", "doc", "number", "8080"), ("port", "doc", "number", "80.0"), ("port", "doc", "kind", "TCP"), ("port", "code", "kind", "tcp"), ("ab", "code", "k", "1"), ("ab", "doc", "k", "2"), ("port", "code", "note", None), ("port", "doc", "note", "x")]
    df = spark.createDataFrame(facts, "label string, source_type string, key string, value string")
    assert rows(linking.contradictions(df), "label", "key", "value_a", "value_b", "type") == [("port", "number", "80", "8080", "numeric_mismatch")]


def test_resolve_prefers_the_first_way(spark):
    refs = spark.createDataFrame([("a",), ("m.a",), ("old",), ("none",), ("m.b",), (None,)], "ref string")
    known = spark.createDataFrame([("a",), ("a",), ("m.b",), ("b",)], "id string")
    alias = spark.createDataFrame([("old", "b"), ("a", "z")], "alias string, id string")
    got = rows(linking.resolve(refs, "ref", known, alias, r"m\."), "ref", "target", "how")
    assert got == sorted([("a", "a", "direct"), ("m.a", "a", "prefix"), ("old", "b", "alias"), ("none", None, "unresolved"), ("m.b", "m.b", "direct"), (None, None, "unresolved")], key=repr)


def test_merge_and_rewire(spark):
    df = spark.createDataFrame([("x", 2, "doc", "long text"), ("x", 1, None, "text"), ("y", 1, None, None)], "id string, rank int, label string, description string")
    assert rows(linking.merge_records(df, "id", "rank", ["label"], ["description"])) == [("x", "doc", "long text", 2), ("y", None, None, 1)]
    edges = spark.createDataFrame([("a", "b", "R"), ("b", "c", "R"), ("a", "c", "R"), ("c", "c", "R")], "src string, dst string, relationship string")
    assert rows(linking.rewire(edges, spark.createDataFrame([("b", "a")], "id string, keeper string"))) == [("a", "c", "R"), ("c", "c", "R")]


def test_canonical_null_keeps_itself(spark):
    df = spark.createDataFrame([(3, "A "), (1, "a"), (2, None), (4, "")], "id int, text string")
    assert rows(linking.canonical_keepers(df, F.lower(F.trim("text")), "id"), "id", "keeper") == [(1, 1), (2, 2), (3, 1), (4, 4)]


def test_validation(spark):
    nodes = spark.createDataFrame([("n", "T", "x"), ("m", "T", None), ("o", "U", None)], "id string, entity_type string, label string")
    assert rows(linking.validate(nodes, [("T", "required", F.col("label").isNotNull()), ("T", "pattern", F.col("label").rlike("^y"))])) == [("m", "pattern"), ("m", "required"), ("n", "pattern")]
    edges = spark.createDataFrame([("n", "o", "R"), ("o", "n", "R"), ("n", "gone", "Q"), ("o", "o", "Q")], "src string, dst string, relationship string")
    assert rows(linking.validate_edges(edges, nodes, {"R": (["T"], ["U"])}), "src", "dst", "problem") == [("n", "gone", "missing_target"), ("o", "n", "source_type")]


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(linking.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, -1.0, None, None]


def test_risk_and_coverage(spark):
    df = spark.createDataFrame([(15, 40, 10, 50), (0, 0, 0, 0), (15, 0, 5, 0)], "consumers int, functions int, dependencies int, edges int")
    assert rows(reports.module_risk(df, {"consumers": (0.5, 15.0), "functions": (0.25, 40.0), "dependencies": (0.0, 10.0), "edges": (0.25, 50.0)}, [(0.75, "CRITICAL"), (0.5, "HIGH")], "LOW"), "risk_score", "risk_level") == [(0.0, "LOW"), (0.5, "HIGH"), (1.0, "CRITICAL")]
    assert rows(reports.coverage(spark.createDataFrame([], "a int"), F.col("a") > 0, F.col("a") > 0)) == [(0, 100.0, 100.0, "HEALTHY")]


def test_drift_stale_conflicts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "g string, v double")
    assert rows(reports.drift(df, "g", "v", 2.0, 0.0, 2.0), "g", "drift", "alert") == [("a", None, False), ("b", None, False)]
    assert rows(reports.drift(df, "g", "v", 2.0, 3.5, 2.0), "g", "drift", "alert") == [("a", 0.0, False), ("b", 2.0, True)]
    old = spark.createDataFrame([("x", 1, None), ("y", 2, 5), ("z", 3, 5)], "k string, m int, s int")
    new = spark.createDataFrame([("x", 1, None), ("y", 2, 6), ("w", 0, 0)], "k string, m int, s int")
    assert rows(reports.stale(old, new, "k", ["m", "s"])) == [("w", "new"), ("y", "changed"), ("z", "removed")]
    local = spark.createDataFrame([("a", "modified"), ("b", "modified"), ("c", "deleted")], "k string, change string")
    remote = spark.createDataFrame([("a", "modified"), ("b", "deleted"), ("c", "modified")], "k string, change string")
    assert rows(reports.delta_conflicts(local, remote, "k")) == [("a", "both_modified"), ("b", "deleted_remotely")]


def test_chunks_cover_the_text(spark):
    long = " ".join(f"word{k}" for k in range(900)) + ". " + "x" * 4000
    df = spark.createDataFrame([(1, "short\n\nnext"), (2, None), (3, " \n\n "), (4, long), (5, "A one. B two.\n\n\n" + "c" * 120)], "id int, text string")
    got: dict = {}
    for r in texts.chunk(df, "id", least=10, most=200, overlap=0).orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got[1] == ["short\n\nnext"] and set(got) == {1, 4, 5}
    assert all(len(c) <= 200 for c in got[4])
    assert "".join("".join(got[4]).split()) == "".join(long.split())
    assert got[5] == ["A one. B two.", "c" * 120]
    lapped = [r["chunk"] for r in texts.chunk(df.filter("id = 5"), "id", least=10, most=200, overlap=4).orderBy("position").collect()]
    assert lapped == ["A one. B two.", "two. " + "c" * 120]


def stream(spark, path, data, schema):
    for k, part in enumerate(data):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{path}/in/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def collect(spark, df, path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {r["n"]: r["allowed"] for r in spark.table(name).collect()}


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_token_bucket_over_batches(spark, tmp_path):
    data = [[("a", 1, at(0)), ("a", 2, at(0)), ("a", 3, at(0)), ("b", 4, at(0))], [("a", 5, at(1)), ("a", 6, at(1)), ("a", 7, at(100)), ("a", 8, at(100))]]
    df = guards.token_bucket(stream(spark, tmp_path, data, "client string, n int, ts timestamp"), "client", "ts", "n", rate=1.0, capacity=2.0, delay="1 hour")
    assert collect(spark, df, tmp_path, "bucket") == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True}


def test_circuit_breaker_cools_down(spark, tmp_path):
    data = [[("a", 1, at(0), True), ("a", 2, at(1), True), ("a", 3, at(2), False)], [("a", 4, at(5), True), ("a", 5, at(12), True), ("a", 6, at(13), False), ("a", 7, at(14), True)]]
    df = guards.circuit_breaker(stream(spark, tmp_path, data, "client string, n int, ts timestamp, failed boolean"), "client", "ts", "n", "failed", failures=2, cooldown=10.0, delay="1 hour")
    assert collect(spark, df, tmp_path, "breaker") == {1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True}
