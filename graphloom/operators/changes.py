"""Writes as joins: upserts, ingest, chunk tables, caches, capped sums and guards. Functions take and return DataFrames, lazily, unless they say that they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges after new ones are merged in: of equal (src, dst, relationship) the new row stays, with its largest weight if it comes more than once. Relations are upper-case words joined by ``_``."""
    clean = F.regexp_replace(F.upper(F.coalesce("relationship", F.lit("RELATED_TO"))), "[^A-Z0-9_]+", "_")
    both = edges.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1))).withColumn("relationship", clean)
    return both.groupBy("src", "dst", "relationship").agg(F.max_by("weight", F.struct("_n", "weight")).alias("weight"))


def ingest_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes after new ones are merged in: fields that a new node gives replace the old ones, and its properties are laid over the old ones; others stay."""
    fields = [c for c in nodes.columns if c not in ("id", "properties")]
    a = nodes.select("id", *[F.col(c).alias(f"_a_{c}") for c in fields], F.col("properties").alias("_p"))
    b = new.select("id", *[F.col(c).alias(f"_b_{c}") for c in fields], F.col("properties").alias("_q"))
    empty = F.create_map().cast("map<string,string>")
    old = F.map_filter(F.coalesce("_p", empty), lambda k, v: ~F.coalesce(F.map_contains_key("_q", k), F.lit(False)))
    return a.join(b, "id", "full").select("id", *[F.coalesce(f"_b_{c}", f"_a_{c}").alias(c) for c in fields], F.map_concat(old, F.coalesce("_q", empty)).alias("properties"))


def ingest_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges and those of ``new`` whose (src, dst, relationship) they don't have, each once (the heaviest)."""
    key = ["src", "dst", "relationship"]
    fresh = new.groupBy(*key).agg(F.max("weight").alias("weight")).join(edges.select(*key), key, "left_anti")
    return edges.select(*key, "weight").unionByName(fresh.select(*key, "weight"))


def replace_runtime(nodes: DataFrame, seen: DataFrame, kind: str = "RUNTIME_EVENT") -> DataFrame:
    """Nodes without runtime events that were not seen again, and the seen ones that are new. Inputs: id, label, entity_type."""
    kept = nodes.join(seen.select("id", F.lit(True).alias("_s")), "id", "left").filter((F.col("entity_type") != kind) | F.col("_s")).drop("_s")
    return kept.unionByName(seen.join(nodes.select("id"), "id", "left_anti").select(*nodes.columns))


def chunk_rows(nodes: DataFrame) -> DataFrame:
    """(id, node, idx, type, text): a row for each chunk with text, named by its node and place. Inputs: id, chunks (array of text, type)."""
    rows = nodes.select(F.col("id").alias("node"), F.posexplode("chunks").alias("idx", "c")).filter(F.length(F.trim(F.coalesce("c.text", F.lit("")))) > 0)
    return rows.select(F.concat_ws("_chunk_", "node", F.col("idx").cast("string")).alias("id"), "node", "idx", F.col("c.type").alias("type"), F.col("c.text").alias("text"))


def gathered_chunks(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes with their chunks in order; none gives an empty list. Inputs: id; node, idx, type, text."""
    lists = chunks.groupBy(F.col("node").alias("id")).agg(F.array_sort(F.collect_list(F.struct("idx", "type", "text"))).alias("chunks"))
    return nodes.join(lists, "id", "left").withColumn("chunks", F.coalesce("chunks", F.array().cast("array<struct<idx:int,type:string,text:string>>")))


def to_rebuild(nodes: DataFrame, sources: DataFrame, force: bool = False, incremental: bool = False) -> DataFrame:
    """Nodes whose chunks are to be made again: all with a source if forced, those without chunks, and - incrementally - those whose recorded hash differs from their source's. Inputs: id, path, chunks (count), hash; path, hash."""
    both = nodes.join(sources.select("path", F.col("hash").alias("_now")), "path")
    changed = F.lit(incremental) & F.col("hash").isNotNull() & (F.col("hash") != F.col("_now"))
    return both.filter(F.lit(force) | (F.coalesce("chunks", F.lit(0)) == 0) | F.coalesce(changed, F.lit(False))).select("id", F.col("_now").alias("hash"))


def refreshed_cache(cache: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """A cache of chunk vectors without the rows of changed nodes, and the fresh ones. Inputs: node, idx, vector; node."""
    return cache.join(changed.select("node"), "node", "left_anti").unionByName(fresh)


def cache_health(cache: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: cached and expected keys, keys that lack, keys nobody expects, and zero vectors. Inputs: node, idx, vector; node, idx."""
    zero = F.forall("vector", lambda x: x == 0)
    both = cache.select("node", "idx", F.coalesce(zero, F.lit(True)).alias("zero"), F.lit(True).alias("c")).join(expected.select("node", "idx", F.lit(True).alias("e")), ["node", "idx"], "full")
    return both.agg(F.count("c").alias("cached"), F.count("e").alias("expected"), F.count_if(F.col("c").isNull()).alias("lacking"), F.count_if(F.col("e").isNull()).alias("stale"), F.count_if("zero").alias("zero"))


def capped_sums(records: DataFrame, actor: str, ts: str, order: str, amount: str, seconds: float, cap: float) -> DataFrame:
    """(actor, order, total, refused): each record with the amounts of its actor that were taken in the last ``seconds`` and its own; beyond ``cap`` it is refused and not counted later on.

    A verdict depends on those before it, so an actor's records are gone through in order, batch by batch; what is held of an actor is what lies within the window.
    """
    from collections import deque
    from collections.abc import Iterable, Iterator

    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, held, total = object(), deque(), 0.0
        for frame in frames:
            rows = []
            for name, at, number, value in zip(frame[actor], frame["_at"], frame[order], frame[amount]):
                if name != who:
                    who, held, total = name, deque(), 0.0
                while held and at - held[0][0] >= seconds:
                    total -= held.popleft()[1]
                now = total + value
                rows.append((name, number, round(now, 6), now > cap))
                if now <= cap:
                    held.append((at, value))
                    total = now
            yield pd.DataFrame(rows, columns=[actor, order, "total", "refused"])

    timed = records.select(actor, order, F.col(amount).cast("double").alias(amount), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_at"))
    return timed.repartition(actor).sortWithinPartitions(actor, "_at", order).mapInPandas(run, f"{actor} {kinds[actor]}, {order} {kinds[order]}, total double, refused boolean")


def last_records(records: DataFrame, key: str, ts: str, order: str, most: int, seconds: int) -> DataFrame:
    """The newest ``most`` records of each key that are no older than ``seconds`` before its last one."""
    by = Window.partitionBy(key)
    newest = records.withColumn("_k", F.row_number().over(by.orderBy(F.desc(ts), F.desc(order)))).withColumn("_m", F.max(F.col(ts).cast("timestamp")).over(by))
    return newest.filter((F.col("_k") <= most) & (F.unix_micros("_m") - F.unix_micros(F.col(ts).cast("timestamp")) <= seconds * 1_000_000)).drop("_k", "_m")


def committed_batch(records: DataFrame, batches: DataFrame, batch: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, links) after a batch is committed: it is added unless it is there, and linked to those of ``wanted`` that exist. Inputs: id; batch, record; id."""
    links = wanted.join(records.select("id"), "id", "left_semi").select(F.lit(batch).alias("batch"), F.col("id").alias("record")).distinct()
    fresh = links.join(batches.select("batch"), "batch", "left_anti")
    return batches.select("batch", "record").unionByName(fresh), fresh


def uncommitted(records: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: how many records no batch is linked to."""
    return records.join(batches.select(F.col("record").alias("id")), "id", "left_anti").agg(F.count("*").alias("n"))
