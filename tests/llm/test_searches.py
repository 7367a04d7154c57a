"""Lexical search, MinHash near-duplicates and hard negatives against plain versions, on the small tables and on odd rows."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import hardneg, lexical, minhash
from graphloom.llm.common import best_of, table

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# 11


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(CAPITALS))


def plain_rank(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(plain_terms(text)), []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // length
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def ranked(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_lexical_equals_plain(spark, sf, docs):
    items = table(spark, sf, "benchmark")
    want = plain_rank(docs.collect(), items.select("item_id", "text").collect())
    assert ranked(lexical.op11_ranked(docs, items)) == want
    # Items in many blocks give the same.
    assert ranked(lexical.rank(docs, items, terms=300)) == want


def test_lexical_odd_rows(spark):
    rows = [(1, "Apple banana"), (1, "Apple banana"), (2, "apple BANANA"), (None, "apple banana"), (3, None), (4, ""), (5, " \n!?"), (6, "été ÉTÉ naïve_word x1"), (7, "pear " * 3000 + "apple"), (8, "x" * 100_000), (9, "nothing here")]
    asked = [(1, "apple apple BANANA"), (1, "pear"), (2, None), (3, "..."), (None, "été word"), (4, "unknown"), (5, "x" * 100_000)]
    d = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id int, text string, score int, item string")
    q = spark.createDataFrame([(i, t, 2) for i, t in asked], "item_id int, text string, rank int")
    for k in (2, 10):
        assert ranked(lexical.rank(d, q, k)) == plain_rank(rows, asked, k)
    assert lexical.rank(d.limit(0), q).count() == 0 and lexical.rank(d, q.limit(0)).count() == 0
    assert lexical.rank(d, q).schema.simpleString() == lexical.rank(d, q.limit(0)).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_lexical_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    for text in ("one two three four five one", "x" * 50, "", " ", "a b", "a" * 7 + " " + "b" * 7 + " "):
        assert lexical.term_counts(text.encode()) == Counter(t.encode() for t in plain_terms(text))


@given(st.lists(st.integers(0, 2**40), max_size=300))
@settings(deadline=None, max_examples=60)
def test_radix_order_is_stable(keys):
    a = np.array(keys, np.uint64)
    assert lexical.radix_order(a).tolist() == np.argsort(a, kind="stable").tolist()


def test_accumulator_in_small_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    items = [(k, [f"t{t}" for t in rng.choice(20, 6, replace=False)], rng.integers(1, 3, 6).tolist()) for k in range(9)]
    block = lexical.ItemBlock(items)
    doc = np.repeat(np.arange(50), 5)
    term, tf, m = rng.integers(0, len(block.numbers), 250).astype(np.int64), rng.integers(1, 9, 250), rng.integers(25, 200, 50)
    w = rng.integers(0, 900, len(block.numbers))

    def best(entries):
        monkeypatch.setattr(lexical, "ENTRIES", entries)
        found = lexical.Accumulator(block, w, 4)
        for lo in range(0, 50, 13):
            hi = min(lo + 13, 50)
            some = (doc >= lo) & (doc < hi)
            found.add(list(range(lo, hi)), m[lo:hi], doc[some] - lo, term[some], tf[some])
        return [sorted(h) for h in found.heaps]

    want, names = [], {v: k.decode() for k, v in block.numbers.items()}
    for _, terms, times in items:
        sums = Counter()
        for d, t, f in zip(doc.tolist(), term.tolist(), tf.tolist()):
            if names[t] in terms:
                sums[d] += times[terms.index(names[t])] * int(w[t]) * (10**9 * f // (1000 * f + 8 * int(m[d])))
        want.append(sorted(sorted(((s, -d) for d, s in sums.items() if s > 0), reverse=True)[:4]))
    assert best(1) == best(40) == best(1 << 20) == want


def test_best_of_merges_many_parts(spark):
    rows = [(k % 3, p, (k * 7919 + p * 31) % 1000, k) for p in range(700) for k in range(3, 9)]
    got = best_of(spark.createDataFrame(rows, "g long, part long, s long, id long"), ["g"], ["s", "id"], 4, 700)
    by = defaultdict(list)
    for r in got.collect():
        by[r["g"]].append((r["rank"], r["s"], r["id"]))
    for g in range(3):
        assert sorted(by[g]) == [(n + 1, *x) for n, x in enumerate(sorted((s, i) for h, _, s, i in rows if h == g)[:4])]


# 12


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPITALS))
    return frozenset(tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()


def plain_near(rows):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs of sets."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    out = Counter()
    for k, (i, _) in enumerate(rows):
        named = i if not sets[k] else min((x for x in least[find(k)] if x is not None), default=None)
        out[i, len(sets[k]), named, i is not None and i == named] += 1
    return out


def near(df):
    return Counter(tuple(r) for r in minhash.op12_minhash(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_near_duplicates_equal_all_pairs(docs):
    assert near(docs) == plain_near([tuple(r) for r in docs.collect()])


def test_near_duplicates_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, "A b C d e"), (4, "a B c D e"), (4, "a B c D e"), (None, "a b c d e"), (6, None), (7, ""), (8, " \n\t"), (9, "one two"), (10, "ONE two"), (11, "two one"), (None, "x y z"), (None, "lonely words of a null id"), (12, long), (13, long + " tail"), (14, "Été naïve x y"), (15, "été naïve x y"), (16, "a b c d e \x1c f")]
    df = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id int, text string, rep string, t int")
    assert near(df) == plain_near(rows)
    assert near(df.limit(0)) == Counter()
    assert near(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == Counter([(1, 0, 1, True), (2, 0, 2, True)])


def variants(seed, n, words, most):
    """One template, changed in up to ``most`` words in a row: many pairs lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{k}" for k in range(words)], []
    for k in range(n):
        copy, size = list(base), int(rng.integers(0, most))
        start = int(rng.integers(0, words - size))
        copy[start : start + size] = [f"x{k}_{j}" for j in range(size)]
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("words, most", [(120, 40), (40, 14), (12, 5)])
def test_near_duplicates_of_a_template_equal_all_pairs(spark, words, most):
    """Members of one bucket that are alike but not like its middle must be linked too."""
    rows = variants(words, 150, words, most)
    assert near(spark.createDataFrame(rows, "doc_id long, text string")) == plain_near(rows)


@pytest.mark.parametrize("contiguous", [True, False])
def test_near_duplicates_at_the_threshold(spark, contiguous):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(300):
        base = [f"w{x}" for x in rng.integers(0, 20_000, 300)]
        copy = list(base)
        for at in range(100, 130) if contiguous else range(7, 301, 40):
            copy[at] = f"new{k}_{at}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    got, want = near(spark.createDataFrame(rows, "doc_id long, text string")), plain_near_of_pairs(rows)
    assert sum((got & want).values()) >= 598 and sum(r[3] for r in want.elements()) == 300


def plain_near_of_pairs(rows):
    return sum((plain_near(rows[k : k + 2]) for k in range(0, len(rows), 2)), Counter())


def test_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for size in (3, 20, 100, 3000):
        agreed = []
        for _ in range(300):
            shared, a, b = (np.unique(rng.integers(0, 2**64, n, np.uint64)) for n in (size, 1 + size // 10, 1 + size // 10))
            x, y = (minhash.signature(np.unique(np.concatenate([shared, own]))) for own in (a, b))
            agreed.append(np.mean(x == y))
        assert np.mean(agreed) == pytest.approx(size / (size + 2 * (1 + size // 10)), abs=0.02)


# 13


def plain_mine(rows, positives=5, negatives=3, window=(50, 95), anchors=50):
    good = sorted({(i, label, tuple(v)) for i, label, v in rows})
    out = Counter()
    for i, label, v in good:
        if i % anchors:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == label) for j, other, w in good)
        first = [(s, j) for s, j, same in scored if same and j != i][:positives]
        for s, j in first:
            fits = [(t, x) for t, x, same in scored if not same and window[0] * -s <= 100 * -t <= window[1] * -s]
            for r, (t, x) in enumerate(fits[:negatives]):
                out[i, j, r + 1, x, -s, -t] += 1
    return out


def mined(df):
    return Counter(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_plain(spark, sf):
    vectors = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * x) for x in r["embedding"]]) for r in vectors.collect()]
    got = mined(hardneg.op13_mined(vectors))
    assert got and got == plain_mine(rows)


@pytest.mark.parametrize("n, dim, clusters, block, bunch", [(900, 3, 5, 100, 7), (1500, 8, 12, 64, 10_000), (700, 2, 1, 300, 4)])
def test_hard_negatives_in_many_leaves(spark, n, dim, clusters, block, bunch):
    rng = np.random.default_rng(n)
    middles = rng.integers(-60, 60, (clusters, dim))
    # Few distinct vectors and labels: ties, repeated vectors, negative scores and different norms.
    rows = [(int(k), int(rng.integers(0, 3)), (middles[rng.integers(0, clusters)] + rng.integers(-6, 7, dim)).tolist()) for k in rng.permutation(n)]
    rows += rows[:40] + [(10_000 + k, 1, rows[0][2]) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    assert mined(hardneg.mine(frame, F.col("vec_id") % 20 == 0, block=block, bunch=bunch)) == plain_mine(rows, anchors=20)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.75, 0.0], 2), (3, None, 2), (4, [nan, 1.0], 2), (5, [inf, 1.0], 2), (6, [None, 1.0], 2), (8, [0.5, 0.5], None), (9, [], 2), (10, [1.0], 2), (50, [0.0, 0.0], 2), (None, [1.0, 1.0], 2), (100, [-1.0, 0.0], 3), (11, [-0.01, 0.3], 2), (7, [0.5, 0.5], 9)]
    df = spark.createDataFrame([(i, v, label, "x", 5) for i, v, label in rows], "vec_id long, embedding array<float>, label int, block string, rank int")
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and v and len(v) == 2 and None not in v and np.isfinite(v).all()]
    got = mined(hardneg.op13_mined(df))
    assert got and got == plain_mine(kept)
    assert mined(hardneg.op13_mined(df.limit(0))) == Counter()
    alone = spark.createDataFrame([(50, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert mined(hardneg.op13_mined(alone)) == Counter()


def test_hard_negatives_of_long_vectors(spark):
    """Beyond the range where doubles count whole numbers, scores are exact too."""
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, rng.integers(-(2**29), 2**29, 6).tolist()) for k in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    assert mined(hardneg.mine(frame, F.col("vec_id") % 50 == 0, block=64)) == plain_mine(rows)
    with pytest.raises(ValueError):
        hardneg.mine(spark.createDataFrame([(0, 1, [2**40])], "vec_id long, label long, vector array<long>"), F.col("vec_id") % 50 == 0)


def test_a_block_tree_skips_what_an_annulus_misses():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-20, 20, (2500, 4)) + c for c in ((900, 0, 0, 0), (0, 900, 0, 0), (0, 0, 900, 0))]).astype(float)
    largest = float((v**2).sum(axis=1).max())
    tree = hardneg.BlockTree(v, np.arange(len(v)) % 3, [[k] for k in range(len(v))], largest, True)
    seen = []
    whole = hardneg.products
    hardneg.products = lambda a, b, exact: (seen.append(len(a)), whole(a, b, exact))[1]
    try:
        anchor = v[:1]
        least, most = tree.bounds(anchor, (anchor**2).sum(axis=1) + largest)
        found = tree.nearest(anchor[0], least[0].tolist(), most[0].tolist(), 0, False, None, [600_000, 1], [780_000, 0], 3)
    finally:
        hardneg.products = whole
    scores = v @ anchor[0]
    fits = sorted((-s, k) for k, s in enumerate(scores.tolist()) if k % 3 and 600_000 <= s <= 780_000)[:3]
    assert found == [(0, int(-s), k) for s, k in fits] and sum(seen) < len(v) / 2
