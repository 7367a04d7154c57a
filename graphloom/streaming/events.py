"""Event streams: exactly-once keys and counts by event time. Watermarks bound the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_sight(events: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first event of each key within the watermark's delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, key: str, ts: str, size: str, delay: str) -> DataFrame:
    """Events of each key in windows of fixed size."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), key, "n")


def over_limit(events: DataFrame, key: str, ts: str, size: str, delay: str, limit: int) -> DataFrame:
    """Windows in which a key exceeds the limit."""
    return tumbling_counts(events, key, ts, size, delay).filter(F.col("n") > limit)


def changed_paths(batch: DataFrame, path: str) -> list[str]:
    """Distinct paths of a micro-batch in order: what one debounced step works on. A batch is bounded by the source's limits (``maxFilesPerTrigger``)."""
    return [r[0] for r in batch.select(path).filter(F.col(path).isNotNull()).distinct().orderBy(path).collect()]


def visible(events: DataFrame, level: str, viewer: int, kinds: list[str]) -> DataFrame:
    """Events of these kinds that a viewer may see, as they come."""
    return events.filter((F.col(level) <= viewer) & F.col("kind").isin(kinds))


def append_once(batch: DataFrame, path: str, keys: list[str]) -> None:
    """Append a micro-batch without rows whose keys are stored already: with a checkpointed source, which may give a batch again, each key is stored once.

    For ``foreachBatch``; give it a trigger (``processingTime``, or ``maxFilesPerTrigger`` for the size) to store by size or time.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def store_epoch(batch: DataFrame, epoch: int, path: str) -> None:
    """Store a micro-batch under its number. For ``foreachBatch``: a batch that comes again after a crash, between its write and the source's commit, takes the place of what it wrote, so nothing is stored twice and no earlier batch is read."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
