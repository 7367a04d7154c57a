"""Merging with forbidden pairs against taking links one by one, and the layers together."""

import numpy as np
import pytest

from graphloom.operators import dedup


def one_by_one(links, forbidden):
    best = {}
    for a, b, c in links:
        if a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(best.get(k, -1), c)
    root, members = {}, {}
    for a, b in best:
        for x in (a, b):
            root[x], members[x] = x, {x}
    no = {(min(p), max(p)) for p in forbidden}
    decided = {}
    for (a, b), c in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        x, y = root[a], root[b]
        if x == y:
            decided[a, b] = True
            continue
        clash = any((min(p, q), max(p, q)) in no for p in members[x] for q in members[y])
        decided[a, b] = not clash
        if not clash:
            keep, gone = min(x, y), max(x, y)
            members[keep] |= members.pop(gone)
            for m in members[keep]:
                root[m] = keep
    return root, decided


@pytest.mark.parametrize("seed, n, m, k", [(1, 12, 25, 6), (2, 40, 60, 20), (3, 6, 0, 3), (4, 25, 24, 0)])
def test_merging_equals_one_by_one(spark, seed, n, m, k):
    rng = np.random.default_rng(seed)
    draw = lambda: tuple(int(x) for x in rng.integers(0, n, 2))
    links = [(*draw(), float(rng.choice([0.9, 0.95, 1.0]))) for _ in range(m)] if seed != 4 else [(x, x + 1, 0.9 + x / 1000) for x in range(m)]
    forbidden = [draw() for _ in range(k)]
    mapping, decided = dedup.forbidding_merge(spark.createDataFrame(links, "a long, b long, confidence double"), spark.createDataFrame(forbidden, "a long, b long"))
    root, want = one_by_one(links, forbidden)
    assert {r.id: r.root for r in mapping.collect()} == root
    got = {(r.a, r.b): r.accepted for r in decided.collect()}
    assert got == want


@pytest.mark.parametrize("seed, n, m, k", [(11, 30, 80, 60), (12, 60, 50, 200), (13, 20, 100, 15), (14, 8, 28, 12)])
def test_merging_with_many_forbidden_pairs(spark, seed, n, m, k):
    test_merging_equals_one_by_one(spark, seed, n, m, k)


def test_a_hub_with_many_leaves_takes_few_rounds(spark, monkeypatch):
    stored = []
    plain = dedup._store
    monkeypatch.setattr(dedup, "_store", lambda df: stored.append(0) or plain(df))
    links = [(0, x, 0.95 - x / 10000) for x in range(1, 400)] + [(x, 1000 + x, 0.9) for x in range(1, 400, 2)]
    forbidden = [(x, x + 1) for x in range(1, 399, 2)]
    mapping, decided = dedup.forbidding_merge(spark.createDataFrame(links, "a long, b long, confidence double"), spark.createDataFrame(forbidden, "a long, b long"))
    root, want = one_by_one(links, forbidden)
    assert {r.id: r.root for r in mapping.collect()} == root
    assert {(r.a, r.b): r.accepted for r in decided.collect()} == want
    assert len(stored) < 40


def test_layers_together(spark):
    nodes = [("f1", "getUser", "code", "short", "c1"), ("f2", "getUser", "code", "a longer text", "c1"), ("d1", "get_user", "document", None, None), ("d2", "get user", "user_knowledge", "x", None), ("o", "other", "code", None, None), ("p", "other", "document", "y", None)]
    edges = [("d1", "o", "R"), ("f1", "d1", "R"), ("f2", "p", "S")]
    decisions = [("f1", "d2", False), ("o", "p", False)]
    facts = [("f1", "code", "size", "1"), ("d1", "document", "size", "2"), ("d2", "user_knowledge", "size", "3")]
    ranks = {"code": 1, "api_spec": 2, "json_config": 3, "user_knowledge": 4, "document": 5}
    merged, moved, decided, against = dedup.dedup_graph(
        spark.createDataFrame(nodes, "id string, label string, source_type string, description string, canonical string"),
        spark.createDataFrame(edges, "src string, dst string, relationship string"),
        ranks,
        spark.createDataFrame(decisions, "a string, b string, accepted boolean"),
        facts=spark.createDataFrame(facts, "id string, source_type string, key string, value string"),
    )
    # f1 and f2 are one. d1 and d2 join first, as all names fit equally; f1 may not be with d2, so d1 can't join it either.
    assert {(r.id, r.description, r.merged) for r in merged.collect()} == {("f1", "a longer text", 2), ("d2", "x", 2), ("o", None, 1), ("p", "y", 1)}
    assert sorted(tuple(r) for r in moved.collect()) == [("d2", "o", "R"), ("f1", "d2", "R"), ("f1", "p", "S")]
    assert {(r.a, r.b) for r in decided.collect() if not r.accepted} == {("d1", "f1"), ("d2", "f1"), ("o", "p")}
    assert {(r.label, r.value_a, r.value_b) for r in against.collect()} == {("get user", "2", "3")}
