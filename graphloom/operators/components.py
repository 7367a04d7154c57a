"""Connected components of an undirected edge list, by alternating star contractions; and tables written between the steps of loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def _scratch(df: DataFrame) -> str:
    """A new path in the folder all executors share. Where ``spark.checkpoint.dir`` is unset, local sessions get a temporary one; a cluster must name it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-graphloom-"))
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/graphloom/step-{uuid.uuid4().hex}"


def _store(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = _scratch(df)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _store_with(df: DataFrame, *measures) -> tuple[DataFrame, str, dict]:
    """``_store``, and aggregates of the rows that come from the same job."""
    seen = Observation()
    path = _scratch(df)
    df.observe(seen, *measures).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path, seen.get


def _remove(df: DataFrame, *paths: str) -> None:
    jvm = df.sparkSession.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes, to the value that the training-data operators set too: a batch of long texts stays far below a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


#: Edges up to which a round is one task without a shuffle, about 4 MB: less than Spark would deal to two.
FEW = 250_000


def _stars_of_few(edges: DataFrame) -> DataFrame:
    """Both contractions in one task, for edges that it may hold at once."""
    return _small_star_of_few(_large_star_of_few(edges.coalesce(1)))


def _large_star_of_few(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
    return both.withColumn("m", least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star_of_few(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return down.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))).filter("a > b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # `least` has one row a node, so the rows of a root that very many point at can be split among tasks.
    # It grows with the edges, so it is never gathered by the driver.
    return both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    rest = down.join(least.hint("merge"), "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component) for every node on an edge; the component is named by its smallest node.

    Each round is written to the shared folder, which cuts lineage; it ends once a round changes nothing. Up to ``few`` edges are contracted in
    one task a round, more are shuffled. Null endpoints are ignored; a self-loop makes its node known.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs, _, stored = _store_with(pairs, F.count(F.lit(1)).alias("n"))
    signature = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1000003).alias("x"), F.sum(F.xxhash64("b", "a") % 999983).alias("y"))
    light = stored["n"] <= few
    now, path, before = _store_with(_small_star_of_few(pairs.coalesce(1)) if light else _small_star(pairs), *signature)
    for _ in range(max_rounds):
        new, new_path, seen = _store_with(_stars_of_few(now) if before["n"] <= few else _small_star(_large_star(now)), *signature)
        _remove(new, path)
        now, path = new, new_path
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("a"))
    if light:
        nodes, now = nodes.coalesce(1), now.coalesce(1)
    return nodes.distinct().join(now.select("a", F.col("b").alias("m")).hint("merge"), "a", "left").select(F.col("a").alias("node"), F.coalesce("m", "a").alias("component"))
