"""Parallel greedy selection against the plain one that goes through rows in order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import greedy


def plain_diverse(rows, threshold):
    """Best first, drop a row whose cosine with a kept one of another graph reaches the threshold."""
    out, kept = [], {}
    for group, graph, place, v in sorted(rows, key=lambda r: (r[0], r[2])):
        fine = v is not None and len(v) and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0
        if fine:
            u = np.asarray(v, float) / np.linalg.norm(v)
            if any(g != graph and len(w) == len(u) and w @ u >= threshold - 1e-12 for g, w in kept.get(group, [])):
                continue
            kept.setdefault(group, []).append((graph, u))
        out.append((group, graph, place))
    return sorted(out)


def stays(spark, rows, threshold, tile):
    frame = spark.createDataFrame(rows, "q int, kg string, p int, v array<double>").withColumn("place", F.lit(-1))
    got = greedy.diverse(frame, ["q"], "kg", [F.col("p")], "v", threshold, tile)
    assert got.columns == frame.columns
    return sorted((r.q, r.kg, r.p) for r in got.collect())


@pytest.mark.parametrize("tile, threshold", [(2048, 0.8), (16, 0.8), (7, 0.3), (5, 1.0)])
def test_diverse_equals_going_through_rows(spark, tile, threshold):
    rng = np.random.default_rng(tile)
    few = rng.normal(size=(25, 5)).round(1).tolist()  # vectors repeat, so there are ties and chains
    rows = [(q, f"kg{rng.integers(0, 3)}", k, few[rng.integers(0, 25)] if k % 5 else rng.normal(size=5).tolist()) for q in range(3) for k in range(60 + 40 * q)]
    rows += [(7, "kg0", 0, None), (7, "kg1", 1, [0.0] * 5), (7, "kg1", 2, [float("nan")] * 5), (7, "kg2", 3, [1.0, 0.0]), (7, "kg1", 4, [1.0, 0.0]), (7, "kg1", 5, [1.0, 0.0, 0.0]), (7, "kg1", 6, [])]
    assert stays(spark, rows, threshold, tile) == plain_diverse(rows, threshold)


def test_diverse_of_no_rows(spark):
    assert stays(spark, [], 0.5, 4) == [] and stays(spark, [(0, "a", 1, None)], 0.5, 4) == [(0, "a", 1)]


def test_diverse_of_very_many_hits_of_one_query(spark):
    """100,000 hits near 900 directions: far more than a task holds."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(900, 16))
    middles /= np.linalg.norm(middles, axis=1)[:, None]
    near = rng.integers(0, 900, 100_000)
    vectors = (middles[near] + rng.normal(size=(100_000, 16)) * 0.004).astype(np.float32)
    kg = rng.integers(0, 4, 100_000)
    frame = spark.createDataFrame([(0, int(g), k, v) for k, (g, v) in enumerate(zip(kg, vectors.tolist()))], "q int, kg int, p int, v array<float>")
    got = sorted(r.p for r in greedy.diverse(frame, ["q"], "kg", [F.col("p")], "v", 0.97).select("p").collect())
    u = vectors.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    kept, want, by = {}, [], {}
    # Only directions near each other can meet, so the plain version looks among those.
    alike = middles @ middles.T > 0.85
    for k in range(100_000):
        m = near[k]
        if m not in by:
            by[m] = np.flatnonzero(alike[m])
        if not any((g != kg[k]) and w @ u[k] >= 0.97 - 1e-12 for c in by[m] for g, w in kept.get(c, ())):
            kept.setdefault(m, []).append((kg[k], u[k]))
            want.append(k)
    assert got == want


def plain_without_redundant(rows, most):
    kept = {}
    for key, at, text, sure in sorted(rows, key=lambda r: (str(r[0]), r[1], float("-inf") if r[3] is None else r[3], r[2] or "")):
        words, sure, mine = set((text or "").lower().split()), float("-inf") if sure is None else sure, kept.setdefault(key, [])
        for j, (_, held, other) in enumerate(mine):
            union = len(words | held)
            if union and len(words & held) > most * union:
                if sure > other:
                    del mine[j]
                    mine.append((at, words, sure))
                break
        else:
            mine.append((at, words, sure))
    return sorted(((k, at) for k, rows in kept.items() for at, _, _ in rows), key=repr)


def left(spark, rows, most):
    df = spark.createDataFrame(rows, "k string, o int, content string, confidence double").withColumn("part", F.lit(0))
    return sorted((tuple(r) for r in greedy.without_redundant(df, "k", "o", most).collect()), key=repr)


def test_redundant_messages_go_or_take_the_place(spark):
    data = [("a", 1, "x y", 0.5), ("a", 2, "y x", 0.9), ("a", 3, "z", 0.1), ("a", 4, "x y", 0.2), ("b", 1, "x y", 0.1), ("b", 2, None, 0.1), ("c", 1, "q", 1.0)]
    assert left(spark, data, 0.6) == [("a", 2), ("a", 3), ("b", 1), ("b", 2), ("c", 1)]
    assert left(spark, data[:0], 0.6) == []


@pytest.mark.parametrize("most", [0.0, 0.3, 0.5, 0.8, 1.0])
def test_redundant_messages_equal_going_through_them(spark, most):
    rng = np.random.default_rng(int(most * 10))
    rows = []
    for k in ("a", "b", None):
        for o in range(120):
            text = " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 6)).tolist())
            rows.append((k, o // 2, text.upper() if o % 7 == 0 else text or None, None if o % 11 == 0 else float(rng.integers(0, 6)) / 5))
    assert left(spark, rows, most) == plain_without_redundant(rows, most)


def test_copies_of_one_message_are_one_aggregation(spark):
    """A third of all messages are one text: no overlap is listed for them."""
    rows = [("hot", k, "same words here", (k * 7919 % 1000) / 1000) for k in range(3000)] + [("hot", 5000 + k, f"t{k} u{k}", 0.5) for k in range(50)]
    assert left(spark, rows, 0.5) == plain_without_redundant(rows, 0.5)
