"""Corpus pipeline: documents to packed training sequences.

Each stage takes what the one before kept and calls one operator; its decisions take effect before the next one
begins. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import langid, linededup, packing, secrets, simhash
from graphloom.llm.common import discard, release, save, scratch_mark, table
from graphloom.llm.tokens import vocabulary_path

#: Posterior below which a prediction counts as no language.
LEAST_SCORE = 0.5


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns as one struct, so that no name clashes with an operator's own columns."""
    others = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others or [F.lit(None).alias("none")]).alias("row"))


def unpacked(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` again, those in ``new`` computed anew."""

    def named(c: str) -> Column:
        value = F.col(c) if c in ("doc_id", "text") else F.col("row").getField(c)
        return (new[c] if c in new else value).alias(c)

    return rows.select(*map(named, docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows; ``lang`` stays as it was. Texts without a letter, null and empty ones go; an empty table stays empty."""
    found = langid.predict(packed(docs), langid.fit(docs))
    return unpacked(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later repeated runs of lines; documents of which nothing with a word is left go. Null texts, and empty ones that were so before, stay."""
    cleaned = linededup.dedup_lines(packed(docs))
    gone = (F.col("deleted_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("deleted_lines") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return unpacked(cleaned.filter(~F.coalesce(gone, F.lit(False))), docs, n_chars=n_chars)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones stays: the one with the smallest id (null ids last, of equal ids one row). Null and empty texts are one group."""
    rows, _ = save(packed(docs).withColumn("key", F.monotonically_increasing_id()), "keyed")
    found = simhash.similar_rows(rows.select("key", "doc_id", "text"))
    chosen = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    # The chosen keys grow with the input, so they are not broadcast at any size.
    return unpacked(rows.join(chosen.hint("merge"), "key", "left_semi"), docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark; every document stays, null texts as they are."""
    return unpacked(secrets.redact(packed(docs)), docs, n_chars=F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048 tokens; null and empty texts are a piece of the end id. An empty table gives no pieces."""
    return packing.op2_packed(packed(docs), vocabulary_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("secrets", remove_secrets),
    ("packing", pack_sequences),
]

#: Language models, winnowing and best-fit rounds have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written besides its result goes once the result is stored."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs, path = save(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, mark, keep=(path,))
        if kept is not None:
            discard(spark, kept)
        kept = path
    return STAGES[-1][1](spark, docs, sf_dir)
