"""Document links, selection, answers and writes on small tables with nulls, ties and empty input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom import plans
from graphloom.operators import answers, calibration, changes, documents, selection, traverse
from graphloom.sources import graph_json


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def test_mentions_take_id_before_label_and_ignore_case(spark):
    docs = spark.createDataFrame([(1, "uses AuthService and src/a.py"), (2, None), (3, ""), (4, "authorise" * 2000), (5, "x")], "doc_id long, text string")
    code = spark.createDataFrame([("src/a.py", "Other"), ("n1", "authservice"), ("n2", "auth"), ("n3", "ab"), ("n4", None)], "id string, label string")
    assert rows(documents.mentions(docs, code)) == [(1, "n1", "label"), (1, "n2", "label"), (1, "src/a.py", "id"), (4, "n2", "label")]
    assert documents.mentions(docs.limit(0), code).count() == 0


def test_fuzzy_mentions_against_all_pairs(spark):
    texts = {1: "a b c d e f", 2: "b c", 3: "z", 4: None, 5: "a a a b"}
    labels = {"p": "a b", "q": "b c x", "r": "x y", "s": None, "t": "a b c d e f g h"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    code = spark.createDataFrame(list(labels.items()), "id string, label string")
    want = []
    for d, t in texts.items():
        for c, n in labels.items():
            x, y = set((t or "").split()), set((n or "").split())
            if x and y and len(x & y) / min(len(x), len(y)) >= 0.6:
                want.append((d, c, round(len(x & y) / min(len(x), len(y)), 6)))
    assert rows(documents.fuzzy_mentions(docs, code, 0.6)) == sorted(want, key=repr)


def test_vector_connect_takes_any_number_of_new_nodes(spark):
    frame = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "id long, embedding array<float>")
    none = spark.createDataFrame([], "src long, dst long")
    assert [r["dst"] for r in documents.vector_connect(frame.filter("id = 4"), frame, none, 0.9).collect()] == [3, 2]
    known = spark.createDataFrame([(4, 3)], "src long, dst long")
    assert [r["dst"] for r in documents.vector_connect(frame.filter("id = 4"), frame, known, 0.9, limit=1).collect()] == [2]
    many = spark.range(12_000).select((F.col("id") + 100).alias("id"), F.array(F.lit(1.0), F.cos(F.col("id"))).alias("embedding"))
    few = frame.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    want = sum((1 + k * c) / math.sqrt((1 + k * k) * (1 + c * c)) >= 0.9 for c in map(math.cos, range(12_000)) for k in range(5))
    assert documents.vector_connect(many, few, none, 0.9, limit=10**6).count() == want > 5000


def test_markdown_sections(spark):
    text = "before\n# One\nbody\n## Two ##\n```\n# not a heading\n```\n# Three\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "k long, text string")
    got = [(r["k"], r["seq"], r["level"], r["title"], r["path"], r["body"]) for r in documents.markdown_sections(docs, "k", "text").orderBy("k", "seq").collect()]
    assert got == [(1, 0, 0, None, [], "before"), (1, 1, 1, "One", ["One"], "body"), (1, 2, 2, "Two", ["One", "Two"], "```\n# not a heading\n```"), (1, 3, 1, "Three", ["Three"], "")]


def test_named_files_asks_for_the_path_of_common_names(spark):
    nodes = spark.createDataFrame([(f"p{k}/__init__.py::f",) for k in range(14)] + [("a/api.py::g",), ("a/read_api.py::h",), ("noext",)], "id string")
    edges = spark.createDataFrame([("a/api.py::g", "noext")], "src string, dst string")
    assert rows(selection.named_files(nodes, edges, "look at api.py")) == [("a/api.py::g", True), ("noext", False)]
    assert rows(selection.named_files(nodes, edges, "fix p3/__init__.py now")) == [("p3/__init__.py::f", True)]
    assert selection.named_files(nodes, edges, "fix __init__.py").count() == 0 and selection.named_files(nodes, edges, "").count() == 0


def test_format_checks_and_shapes_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "A"), (2, "([])", "A"), (3, ")(", None)], "k long, text string, kind string")
    assert rows(selection.format_checks(df, "k", "text")) == [(1, "empty"), (2, ""), (3, "round")]
    assert rows(selection.shape_gate(df, "k", "kind", "text", {"A": {"required": ["x"], "least_words": 1}})) == [(1, 2, 0.6), (2, 1, 0.6), (3, 0, 1.0)]


def test_agreement_counts_pairs_in_classes(spark):
    df = spark.createDataFrame([("t", "a", 1, "x y"), ("t", "a", 2, "y x"), ("t", "b", 1, "x y"), ("t", "c", 1, "z"), ("u", "a", 1, "x"), ("v", "a", 1, None)], "k string, node string, o int, content string")
    assert rows(answers.agreement(df, "k", "o")) == [("t", 3, round(1 / 3, 6)), ("u", 1, None)]


def test_platt_and_isotonic(spark):
    pairs = spark.createDataFrame([(c / 10, int(k < c)) for c in range(1, 10) for k in range(10)], "confidence double, correct int")
    a, b = answers.platt(pairs)
    assert a == pytest.approx(1, abs=1e-6) and b == pytest.approx(0, abs=1e-6)
    falling = spark.createDataFrame([(0.1, 1), (0.2, 0), (0.3, 1)], "confidence double, correct int")
    assert rows(calibration.isotonic(falling)) == [(0.1, 0.5), (0.2, 0.5), (0.3, 1.0)]
    assert calibration.isotonic(falling.limit(0)).count() == 0


def test_capped_sums_leave_refused_records_out(spark):
    df = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00", 6.0), ("a", 2, "2024-01-01 00:00:10", 6.0), ("a", 3, "2024-01-01 00:00:20", 4.0), ("a", 4, "2024-01-01 00:02:00", 9.0), ("b", 5, "2024-01-01 00:00:00", 11.0)], "who string, n long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    got = rows(changes.capped_sums(df, "who", "ts", "n", "v", 60.0, 10.0))
    assert got == [("a", 1, 6.0, False), ("a", 2, 12.0, True), ("a", 3, 10.0, False), ("a", 4, 9.0, False), ("b", 5, 11.0, True)]


def test_ingest_edges_and_rows(spark):
    nodes, edges = graph_json.from_rows(spark, [{"id": "a", "metadata": {"x": 1, "y": 2}, "x": 3}, {"id": "b", "type": "T"}], [{"source": "a", "target": "b"}, {"source": "a", "target": None}])
    assert rows(nodes, "id", "entity_type", F.col("properties")["x"]) == [("a", "Entity", "3"), ("b", "T", None)]
    assert rows(changes.ingest_edges(edges.drop("properties"), edges.drop("properties").withColumn("weight", F.lit(5.0)))) == [("a", "b", "RELATED_TO", 1.0)]
    with pytest.raises(ValueError):
        graph_json.refuse_shrink(nodes, nodes, spark.range(200), spark.range(150))
    graph_json.refuse_shrink(nodes, nodes, spark.range(200), spark.range(190))


def plain_pagerank(ids, edges, rounds, d=0.85):
    out = {i: {b for a, b in edges if a == i and b in ids} for i in ids}
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(rounds):
        lost = sum(rank[i] for i in ids if not out[i])
        rank = {i: (1 - d) / len(ids) + d * (lost / len(ids) + sum(rank[j] / len(out[j]) for j in ids if i in out[j])) for i in ids}
    return rank


def test_pagerank_against_plain_and_its_plan(spark):
    ids, edges = list("abcdef"), [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "c"), ("e", "e"), ("a", "gone"), ("a", "b")]
    frame = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    for rounds in (0, 1, 7):
        got = dict(rows(traverse.pagerank(nodes, frame, rounds=rounds)))
        want = plain_pagerank(ids, edges, rounds)
        assert got == pytest.approx(want)
    joins = [traverse.pagerank(nodes, frame, rounds=n)._jdf.queryExecution().optimizedPlan().toString().count("Join") for n in (1, 4)]
    assert joins[0] == joins[1]


def test_mentions_in_one_pass_equal_those_by_joins(spark):
    rng = random.Random(3)
    texts = [(k, "".join(rng.choice("abAB é\u0130ñ_1") for _ in range(rng.randrange(0, 400)))) for k in range(60)] + [(60, None), (61, "abc"), (62, "")]
    named = [(f"{''.join(rng.choice('abé') for _ in range(rng.randrange(2, 5)))}{k % 3}", "".join(rng.choice("ab ñ") for _ in range(rng.randrange(1, 11)))) for k in range(80)] + [("zzz", "abc"), ("abc", None)]
    docs, code = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(named, "id string, label string")
    got = rows(documents.mentions(docs, code))
    assert got and got == rows(documents.mentions(docs, code, terms=5))
    assert documents.mentions(docs, code)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_fuzzy_mentions_with_frequent_words_against_plain(spark):
    rng = random.Random(4)
    vocabulary = ["the"] * 20 + [f"w{k}" for k in range(30)]
    texts = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 8, 40))))) for k in range(60)] + [(7, "the w1 w2"), (90, None)]
    named = [(f"n{k}", " ".join(rng.choice([*vocabulary, f"own{k}"]) for _ in range(rng.randrange(1, 7)))) for k in range(40)]
    want = []
    for d in {d for d, _ in texts}:
        best = []
        for x in (set(t.split()) for i, t in texts if i == d and t):
            for c, label in named:
                y = set(label.split())
                score = round(len(x & y) / min(len(x), len(y)), 6)
                if score >= 0.6:
                    best.append((-score, c))
        want += [(d, c, -s) for s, c in sorted(best)[:50]]
    got = documents.fuzzy_mentions(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(named, "id string, label string"), 0.6)
    assert rows(got) == sorted(want, key=repr)


def test_markdown_batches_are_bounded_by_bytes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(3).select(F.col("id").alias("k"), F.lit("# a\nx\n## b\ny").alias("text"))
    assert documents.markdown_sections(docs, "k", "text").count() == 6
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 8 << 20


def test_neighborhoods_of_twins_and_hubs(spark):
    rng = random.Random(5)
    pairs = [("h", f"l{k}") for k in range(60)] + [("h", "r"), ("r", "r"), ("s", "s"), ("t", "s")] + [(f"v{rng.randrange(25)}", f"v{rng.randrange(25)}") for _ in range(30)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame(pairs, "src string, dst string")
    for hops in (1, 2, 3):
        want = {}
        for x in near:
            seen = at = near[x]
            for _ in range(hops - 1):
                at = {z for y in at for z in near[y]}
                seen = seen | at
            if seen - {x}:
                want[x] = sorted(seen - {x})
        for light in (1, 16):
            assert {r.id: r.members for r in traverse.neighborhoods(edges, hops, light).collect()} == want
            assert dict(rows(traverse.neighborhood_sizes(edges, hops, light))) == {k: len(v) for k, v in want.items()}


def test_counting_the_leaves_of_a_hub_lists_no_pairs(spark):
    edges = spark.range(200_000).select(F.concat(F.lit("l"), "id").alias("src"), F.lit("h").alias("dst"))
    found = traverse.neighborhood_sizes(edges, 2).groupBy("n").count().collect()
    assert [tuple(r) for r in found] == [(200_000, 200_001)]


def test_equal_confidence_goes_by_node_then_content(spark):
    said = spark.createDataFrame([("t", "n", 0.9, "b"), ("t", "n", 0.9, "a"), ("t", "m", None, "c"), ("t", "o", 0.9, "A"), ("u", None, 0.5, "x"), ("u", "z", 0.5, "y")], "topic string, node string, confidence double, content string")
    assert rows(answers.most_confident(said.repartition(3), "topic")) == [("t", "n", "a"), ("u", "z", "y")]


def test_committed_batch_takes_ids_below_a_million(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 3, 999_999, 1_000_002, 10**9 + 2)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = plans.queries()["committed_batch"](spark, str(tmp_path))
    assert sorted(r.record for r in got.collect() if r.batch == "b2") == [0, 3, 999_999]


def test_shortest_path_names_nodes_and_relations(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("c", "b", "S"), ("a", "x", "R"), ("x", "c", "Q"), ("c", "d", "T"), ("c", "d", "A")], "src string, dst string, relationship string")
    assert [tuple(r) for r in traverse.shortest_path(edges, "a", "d", 6).collect()] == [(["a", "b", "c", "d"], ["R", "S", "A"], 3)]
    assert traverse.shortest_path(edges, "a", "d", 2).count() == 0 and traverse.shortest_path(edges, "a", "nowhere", 6).count() == 0
    assert [tuple(r) for r in traverse.shortest_path(edges, "a", "a", 6).collect()] == [(["a"], [], 0)]


def test_message_fanout_keeps_the_best(spark):
    messages = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "round int, node string, content string")
    edges = spark.createDataFrame([("a", "c"), ("c", "b"), ("b", "b")], "src string, dst string")
    scores = spark.createDataFrame([("a", 0.1), ("b", 0.9)], "id string, score double")
    assert rows(traverse.message_fanout(messages, edges, scores, 2, 1), "receiver", "node", "place") == [("b", "b", 1), ("c", "b", 1)]


def test_pagerank_rounds_leave_out_nodes_that_nobody_points_at(spark):
    edges = spark.range(5000).select(F.concat(F.lit("l"), "id").alias("src"), F.concat(F.lit("h"), F.col("id") % 3).alias("dst")).union(spark.createDataFrame([("h0", "h1"), ("l0", "h1"), ("l1", "gone")], "src string, dst string"))
    ids = [f"l{k}" for k in range(60)] + ["h0", "h1", "h2"]
    few = edges.filter("src LIKE 'h%' OR CAST(substr(src, 2) AS INT) < 60")
    got = dict(rows(traverse.pagerank(spark.createDataFrame([(i,) for i in ids], "id string"), few, rounds=6)))
    assert got == pytest.approx(plain_pagerank(ids, [tuple(r) for r in few.collect()], 6))


def test_shortest_path_is_the_smallest_of_all(spark):
    rng = random.Random(8)
    for _ in range(3):
        pairs = [(f"n{rng.randrange(16)}", f"n{rng.randrange(16)}", rng.choice(["R", "S", None])) for _ in range(28)]
        near = {}
        for a, b, _r in pairs:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        paths, seen = [["n0"]], {"n0"}
        while paths and not any(p[-1] == "n1" for p in paths):
            paths = [[*p, y] for p in paths for y in near.get(p[-1], ()) if y not in seen]
            seen |= {p[-1] for p in paths}
        want = [min(p for p in paths if p[-1] == "n1")] if paths else []
        got = traverse.shortest_path(spark.createDataFrame(pairs, "src string, dst string, relationship string"), "n0", "n1", 12).collect()
        assert [r.nodes for r in got] == want
        for r in got:
            for a, b, kind in zip(r.nodes, r.nodes[1:], r.relations):
                assert kind == min((k for x, y, k in pairs if {x, y} == {a, b} and k), default=None)


def test_entry_has_its_query(spark):
    assert "blast_radius" in plans.queries()
