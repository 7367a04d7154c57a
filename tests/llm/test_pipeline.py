"""The stages on the small table and on odd documents."""

import importlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from graphloom.llm.common import table

from .test_operators import ODD, plain_dedup


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_keep_columns(spark, sf, odd):
    docs = table(spark, sf, "documents")
    for frame in (docs, odd, odd.limit(0)):
        for _, stage in cp.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert sorted(out.dtypes) == sorted(frame.dtypes)
            assert out.count() <= frame.count()


def test_lines_stage_against_plain(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, t) for (i, _), t in plain_dedup(rows).items() if t.strip())
    assert Counter(map(tuple, cp.drop_repeated_lines(spark, docs, sf).select("doc_id", "text").collect())) == want


def test_near_copies_stage_drops_exact_copies_only_once(spark, sf):
    docs = table(spark, sf, "documents")
    out = cp.drop_near_copies(spark, docs, sf).select("doc_id", "text").collect()
    kept = Counter(r["text"] for r in out)
    assert max(kept.values()) == 1
    # Every text that went has a near copy that stayed.
    assert len(out) >= 0.7 * docs.count()


def test_near_copies_stage_keeps_null_and_shared_ids(spark):
    texts = {c: " ".join(f"{c}{k}" for k in range(60)) for c in "abcd"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["c"]), (5, texts["c"]), (7, texts["d"]), (7, texts["d"] + " more"), (7, "other " * 9)]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = Counter((r["doc_id"], r["text"][:2]) for r in cp.drop_near_copies(spark, frame, "").collect())
    assert out == Counter([(None, "a0"), (None, "b0"), (5, "c0"), (7, "d0"), (7, "ot")])


def test_lines_stage_with_null_ids(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(None, f"a\n{passage}"), (3, f"b\n{passage}"), (4, f"c\n{passage}")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"]: r["text"] for r in cp.drop_repeated_lines(spark, frame, "").collect()} == {None: "a", 3: f"b\n{passage}", 4: "c"}


def test_run_packs_everything_that_is_left(spark, sf):
    out = cp.run(spark, sf)
    used = {}
    for r in out.collect():
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert used and all(sum(n for _, n in parts) <= 2048 for parts in used.values())


def test_registered_queries():
    queries = importlib.import_module("graphloom.llm.queries")
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries())


CLASHES = ["lines", "__lines", "deleted_lines", "score", "lang_pred", "held_out", "base_spans", "added_spans", "key", "row", "component", "first", "t", "u", "rep", "a", "b", "h", "set", "part", "__id", "__null", "__text_hash", "a.b", "`"]


def test_stages_with_columns_named_like_their_own(spark, odd):
    names = [c for c in CLASHES if c not in odd.columns]
    wide = odd.select("*", *[F.lit(f"mine {k}").alias(c) for k, c in enumerate(names)])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns, name
        plain = Counter((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in stage(spark, odd, "").collect())
        rows = out.collect()
        assert Counter((r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in rows) == plain, name
        assert all(r[len(odd.columns) + k] == f"mine {k}" for r in rows for k in range(len(names))), name
    assert cp.STAGES[-1][1](spark, wide, "").count() == cp.STAGES[-1][1](spark, odd, "").count()
