"""Search, fusion and alignment on small tables, against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import relations, retrieval


def test_project_links_with_a_very_common_type_and_label(spark):
    rng = random.Random(3)
    sides = []
    for mark in "ab":
        rows = [(f"{mark}{i}", rng.choice(["x", "x", "x", "y", f"l{i}"]), rng.choice(["T", "T", "U", "MODULE"])) for i in range(120)]
        sides.append(rows + [(f"{mark}n", None, None)])
    for k in (1, 3, 40, 5000):
        got = [tuple(r) for r in retrieval.project_links(*(spark.createDataFrame(s, "id string, label string, entity_type string") for s in sides), k).collect()]
        want = []
        for i, label, kind in sides[0]:
            for j, other, other_kind in sides[1]:
                if None in (label, other):
                    continue
                if label == other:
                    want.append((i, label, j, "SAME_NAME"))
                elif kind == other_kind != "MODULE":
                    want.append((i, label, j, "SAME_TYPE"))
        assert got == sorted(want, key=lambda r: (r[3], r[1], r[0], r[2]))[:k]


def test_scope_that_matches_nothing_keeps_everything(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert retrieval.scoped(rows, F.col("t") == "z").count() == 2
    assert [r.id for r in retrieval.scoped(rows, F.col("t") == "a").collect()] == [1]
    assert retrieval.scoped(rows.filter("id > 5"), F.col("t") == "a").count() == 0


def test_moving_average_equals_the_fold(spark):
    values = [(k, i, random.Random(i * 7 + k).random()) for k in range(3) for i in range(50)]
    got = {r.k: (r.average, r.n) for r in retrieval.smoothed(spark.createDataFrame(values, "k int, i int, v double"), "k", ["i"], "v").collect()}
    for k in range(3):
        own = [v for key, _, v in values if key == k]
        average = own[0]
        for v in own[1:]:
            average = 0.3 * v + 0.7 * average
        assert math.isclose(got[k][0], average, rel_tol=1e-9) and got[k][1] == 50


def test_imports_resolve_in_order(spark):
    files = spark.createDataFrame([("pkg/core/graph.py",), ("pkg/io/__init__.py",), ("pkg/d.py",), ("web/app.ts",), ("zzz/graph.py",)], "path string")
    wanted = {1: ("pkg/core/graph.py", "pkg/core/graph.py"), 2: ("pkg.core.graph", "pkg/core/graph.py"), 3: ("pkg.io", "pkg/io/__init__.py"), 4: ("other.graph", "pkg/core/graph.py"), 5: ("d", None), 6: ("web.app", "web/app.ts"), 7: ("numpy", None), 8: (None, None), 9: ("graph", "pkg/core/graph.py")}
    imports = spark.createDataFrame([(k, t) for k, (t, _) in wanted.items()], "import_id int, target string")
    assert {r.import_id: r.target for r in retrieval.resolve_imports(imports, files).collect()} == {k: t for k, (_, t) in wanted.items()}


def test_look_alikes(spark):
    cases = {"openai": None, "openai-python": "openai", "my_openai": "openai", "open-ai": "openai", "opemai": "openai", "opemal": "openai", "openais": "openai", "unrelated": None, "": None, "@me/openaj": "openai", "abd": None, None: None}
    rows = spark.createDataFrame([(c,) for c in cases], "n string").withColumn("like", retrieval.look_alike(F.col("n"), ["abc", "openai"]))
    assert {r.n: r.like for r in rows.collect()} == cases


def fused(hits, authority, threshold, least_share):
    out = []
    for q in {h[0] for h in hits}:
        rows = []
        for kg in {h[1] for h in hits if h[0] == q}:
            own = sorted(([*h[:6], h[6] or 0.0] for h in hits if h[:2] == (q, kg)), key=lambda h: (-h[6], h[2]))
            mean, sd = np.mean([h[6] for h in own]), np.std([h[6] for h in own])
            rows += [[h, ((h[6] - mean) / (sd if sd >= 1e-8 else 1.0) + 1 / (60 + k)) * authority.get(kg, 1.0)] for k, h in enumerate(own)]
        kept = []
        for h, score in sorted(rows, key=lambda r: (-r[1], r[0][1], r[0][2])):
            def alike(other):
                return other[1] != h[1] and h[5] is not None and other[5] is not None and np.dot(h[5], other[5]) / np.linalg.norm(h[5]) / np.linalg.norm(other[5]) >= threshold
            if not any(alike(o) for o, _ in kept):
                kept.append((h, score))
        final = []
        for h, score in kept:
            share = sum(o[1] == h[1] for o, _ in kept) / len(kept)
            conflict = len({o[1] for o, _ in kept if (o[3], o[4][:50]) == (h[3], h[4][:50])}) > 1
            final.append((h[1], h[2], score * min(least_share / (share + 1e-8), 2.0) if share < least_share else score, conflict))
        final.sort(key=lambda r: (-r[2], r[0], r[1]))
        out += [(q, kg, node, round(score, 8), conflict, k) for k, (kg, node, score, conflict) in enumerate(final)]
    return sorted(out)


def test_fusion_equals_a_plain_version(spark):
    rng = random.Random(11)
    hits = [(q, f"kg{rng.choice([0, 0, 0, 0, 1, 1, 2])}", f"n{i}", rng.choice("AB"), rng.choice("xy") * 60, [rng.gauss(0, 1) for _ in range(4)] if i % 9 else None, rng.random() if i % 13 else None) for q in range(3) for i in range(40)]
    frame = spark.createDataFrame(hits, "query_id int, kg_id string, node_id string, node_type string, description string, embedding array<double>, score double")
    got = sorted((r.query_id, r.kg_id, r.node_id, round(r.score, 8), r.conflict, r.rank) for r in retrieval.fuse(frame, {"kg1": 1.5}, 0.9, 0.3).collect())
    assert got == fused(hits, {"kg1": 1.5}, 0.9, 0.3)
    assert retrieval.fuse(frame.filter("query_id > 9"), {}, 0.9).count() == 0


def test_fusion_keeps_hits_beyond_the_best_hundred(spark):
    rng = random.Random(12)
    hits = [(0, f"kg{i % 2}", f"n{i:03d}", "A", "x" * 60, [rng.gauss(0, 1) for _ in range(8)], rng.random()) for i in range(320)]
    frame = spark.createDataFrame(hits, "query_id int, kg_id string, node_id string, node_type string, description string, embedding array<double>, score double")
    got = sorted((r.query_id, r.kg_id, r.node_id, round(r.score, 8), r.conflict, r.rank) for r in retrieval.fuse(frame, {"kg1": 1.5}, 0.9).collect())
    assert len(got) > 200 and got == fused(hits, {"kg1": 1.5}, 0.9, 0.1)
    ranks = relations.reciprocal_ranks(frame, "kg_id", "node_id", "score")
    assert ranks.count() == 320


def test_alignment(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 6))
    turn, _ = np.linalg.qr(rng.normal(size=(6, 6)))

    def pairs(x, y):
        rows = [(u.tolist(), v.tolist()) for u, v in zip(x, y)] + [(None, [1.0] * 6), ([float("nan")] * 6, [1.0] * 6), ([1.0], [2.0])]
        return spark.createDataFrame(rows, "a array<double>, b array<double>")

    assert np.allclose(retrieval.rotation(pairs(a, a @ turn.T), 6), turn)
    drift = np.outer(rng.normal(size=200), np.eye(6)[0])
    for b, name in ((a + 5.0, "systematic_shift"), (a + drift, "domain_drift"), (a + rng.normal(size=a.shape), "random_noise"), (a[:4] + 1, "insufficient_data")):
        row = retrieval.diagnose(pairs(a[: len(b)], b), 6).first()
        assert row.diagnosis == name and row.pairs == len(b)
