"""Helpers that the training-data operators share: scratch tables, Arrow blocks, stable placement."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to Python (at least one row): long texts stay far below a worker's memory.
BATCH_BYTES = 8 << 20
#: Bytes of text that a Python worker treats as one block.
BLOCK_BYTES = 4 << 20

#: Scratch tables of this process that have not been deleted yet.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where it is unset, local sessions get a temporary one; a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-graphloom-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/graphloom/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def save(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that later steps no longer read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        if path in _WRITTEN:
            _WRITTEN.remove(path)


def scratch_mark() -> int:
    """A place in the list of scratch tables, for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, mark: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove the scratch tables written since ``mark`` but those in ``keep``: for callers that have stored what they got from an operator."""
    discard(spark, *[path for path in _WRITTEN[mark:] if path not in keep])


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, as one text may be very long. All operators set the same value, so that their order doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What operators remember in this Python worker, by operator.
_HELD: dict[str, dict] = {}


def held_by(owner: str) -> dict:
    """What an operator remembers in this Python worker. Workers are used again by whatever comes next, so what other operators have left is dropped when one begins."""
    for name in [n for n in _HELD if n != owner]:
        del _HELD[name]
    return _HELD.setdefault(owner, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches into blocks of about ``limit`` bytes of ``column``; one longer row stays alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    queue: list[pa.RecordBatch] = []
    for batch in batches:
        queue.append(batch)
        while queue:
            part = queue.pop(0)
            bytes_ = part.column(column).nbytes
            if bytes_ > limit and part.num_rows > 1:
                half = part.num_rows // 2
                queue[:0] = [part.slice(0, half), part.slice(half)]
                continue
            if held and size + bytes_ > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += bytes_
    if held:
        yield pa.Table.from_batches(held)


#: Partial results that ``best_of`` merges at once.
MERGED = 256


def best_of(found: DataFrame, keys: list[str], order: list[str], k: int, parts: int) -> DataFrame:
    """``keys``, rank (int, from 1) and ``order`` of the k first rows by ``order`` of each key.

    ``part`` says which of ``parts`` partial results a row comes from; each holds k rows of a key at most. They are merged ``MERGED`` at a time, so no key's rows meet all at once.
    """
    best = found.select(*keys, "part", F.struct(*order).alias("b"))
    least = F.slice(F.array_sort(F.collect_list("b")), 1, k).alias("best")
    while parts > MERGED:
        parts = -(-parts // MERGED)
        best = best.groupBy(*keys, F.floor(F.col("part") / MERGED).alias("part")).agg(least).select(*keys, "part", F.explode("best").alias("b"))
    ranked = best.groupBy(*keys).agg(least).select(*keys, F.posexplode("best").alias("at", "b"))
    return ranked.select(*keys, (F.col("at") + 1).alias("rank"), *[F.col(f"b.{c}").alias(c) for c in order])


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text leaves 2 on division by 4. A null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
