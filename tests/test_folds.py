"""Ordered folds and calibration fits against plain versions that go through all events."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import answers, calibration, folds

BOUND = st.floats(-5, 5) | st.just(float("inf")) | st.just(float("-inf"))
FORM = st.tuples(st.sampled_from([0.0, 0.5, 0.9, 1.0, 2.0]), st.floats(-3, 3), BOUND, BOUND).map(lambda f: (f[0], f[1], min(f[2], f[3]), max(f[2], f[3]))).filter(lambda f: f[2] < float("inf") and f[3] > float("-inf"))


@given(st.lists(FORM, min_size=1, max_size=12), st.floats(-10, 10))
@settings(deadline=None, max_examples=200)
def test_clamped_functions_compose(forms, x):
    one = forms[0]
    for f in forms[1:]:
        one = folds.after(one, f)
    want = x
    for f in forms:
        want = min(f[3], max(f[2], f[0] * want + f[1]))
    assert float(folds.applied(one, x)) == pytest.approx(want, abs=1e-9)
    keys = np.array([0] * len(forms) + [1])
    got, which = folds._composed(np.array([*forms, (1.0, 0.5, -9.0, 9.0)]).T, keys)
    assert which.tolist() == [0, 1] and float(folds.applied(tuple(got[:, 0]), x)) == pytest.approx(want, abs=1e-9)


def test_sequence_weights_equal_event_by_event(spark):
    rng = np.random.default_rng(3)
    # A third of all moves are one key.
    rows = [(int(a), k, "hot" if rng.random() < 0.6 else str(rng.choice(["x", "y", None])), bool(rng.random() < 0.4) if k % 9 else None) for k, a in enumerate(rng.integers(0, 40, 4000))]
    rows = [(a, k, None if s == "None" else s, g) for a, k, s, g in rows]
    want, last = {}, {}
    for a, k, s, g in rows:
        p = last.get(a)
        if p is not None and s is not None:
            w, n = want.get((p, s), (1.0, 0))
            want[p, s] = (min(10.0, max(0.0, w + (0.1 if g else -0.05))), n + 1)
        last[a] = s
    df = spark.createDataFrame(rows, "a int, o int, s string, g boolean")
    got = {(r.from_step, r.to_step): (r.weight, r.n) for r in folds.sequence_weights(df, "a", ["o"], "s", F.col("g")).collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=1e-8), want[k][1]) for k in want)
    assert folds.sequence_weights(df.limit(0), "a", ["o"], "s", F.col("g")).count() == 0


def test_a_hot_key_lies_in_many_partitions(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("rule"), (F.col("id") % 3 == 0).alias("wrong"), F.col("id").alias("o"))
    w = 1.0
    for k in range(20_000):
        w = max(w * 0.9, 0.1) if k % 3 == 0 else min(w + 0.1, 2.0)
    assert [tuple(r) for r in folds.rule_weights(df, ["o"], 0.1, 0.1, 2.0).collect()] == [("hot", pytest.approx(w, abs=1e-9), 20_000)]


def test_kind_weights_decay_at_every_event(spark):
    rng = np.random.default_rng(4)
    rows = [([str(x) for x in rng.choice(list("abc"), rng.integers(0, 4))] or None, str(rng.choice(["t1", "t2"])), str(rng.choice(["t1", "t2", "t3"])), k) for k in range(700)]
    want = {}
    for kinds, predicted, corrected, _ in rows:
        for kind in set(kinds or ()):
            want[kind, corrected] = want.get((kind, corrected), 0.0) + 0.1
            if predicted != corrected:
                want[kind, predicted] = max(want.get((kind, predicted), 0.0) - 0.1, 0.0)
        want = {k: w * 0.99 for k, w in want.items()}
    df = spark.createDataFrame(rows, "kinds array<string>, predicted string, corrected string, o int")
    got = {(r.kind, r.tool): r.weight for r in folds.kind_weights(df.repartition(5), ["o"], 0.1, 0.99).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def plain_isotonic(pairs):
    by = {}
    for c, y in pairs:
        s, n = by.get(c, (0.0, 0))
        by[c] = (s + y, n + 1)
    keys = sorted(by)
    out = []
    for k in keys:
        out.append([by[k][0], by[k][1], 1])
        while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
            s, n, size = out.pop()
            out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + size]
    return dict(zip(keys, [s / n for s, n, size in out for _ in range(size)]))


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "steps", "few", "one", "none"])
def test_isotonic_equals_pooling_all(spark, kind):
    rng = np.random.default_rng(len(kind))
    n = {"few": 3, "one": 1, "none": 0}.get(kind, 3000)
    c = rng.random(n) if kind != "steps" else np.round(rng.random(n), 2)
    p = {"rising": c, "falling": 1 - c, "steps": np.floor(c * 5) / 5}.get(kind, np.full(n, 0.5))
    pairs = [(float(x), int(rng.random() < q)) for x, q in zip(c, p)]
    df = spark.createDataFrame(pairs, "confidence double, correct int")
    for parts in (1, 4, 13):
        got = {r.confidence: r.calibrated for r in calibration.isotonic(df, parts).collect()}
        assert got == plain_isotonic(pairs)


def test_isotonic_leaves_nulls_out(spark):
    df = spark.createDataFrame([(0.1, 1, "a"), (0.2, 0, "a"), (None, 1, "a"), (0.3, None, "a"), (float("nan"), 1, "a"), (0.3, 1, "b")], "confidence double, correct int, part string")
    assert {r.confidence: r.calibrated for r in calibration.isotonic(df).collect()} == {0.1: 0.5, 0.2: 0.5, 0.3: 1.0}


def test_logistic_descent_equals_steps_over_all_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.random(500) * 120 - 10
    y = (rng.random(500) < 1 / (1 + np.exp(-(x - 50) / 8))).astype(int)
    u, a, b = np.clip(x / 100, 0, 1), 0.0, 0.0
    for _ in range(400):
        p = 1 / (1 + np.exp(-(a * u + b)))
        a, b = a - 2.0 * (((p - y) * u).mean() + 0.001 * a), b - 2.0 * (p - y).mean()
    p = 1 / (1 + np.exp(-(a * u + b)))
    df = spark.createDataFrame([(float(s), int(t)) for s, t in zip(x, y)] + [(None, 1)], "score double, correct int")
    got = calibration.logistic_descent(df, 0.0, 100.0, 2.0, 400, 0.001).first()
    assert abs(a) > 4 and got.a == pytest.approx(a, abs=1e-9) and got.b == pytest.approx(b, abs=1e-9) and got.loss == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean(), abs=1e-9)
    assert tuple(calibration.logistic_descent(df.limit(0), 0.0, 100.0, 0.01, 5, 0.001).first()) == (0.0, 0.0, 0.0)
    assert len(answers.platt(df.filter("score IS NOT NULL").withColumn("confidence", (F.col("score") + 20) / 140))) == 2
