"""Operator 8, approximate nearest neighbours with an inverted multi-index.

Each half of the vectors has its own centroids, fitted on a bounded sample; their number grows with the table. A vector lies in the cell
of its two nearest centroids. A query takes cells in order of the sum of its two halves' inner products with their centroids, largest first,
from a heap, until they hold enough vectors; these are ranked again by the exact inner product.

Vectors lie in blocks of neighbouring cells (a large cell is parted by a hash). A query goes to a block once, and only if it takes one of its
cells; with it goes, for each centroid of the first half, the least inner product of the second half's centroids taken, which says
for any cell whether it was taken. Blocks and bunches of queries meet as two matrices, so what a task holds doesn't grow with the table.

Equal vectors are indexed once, each with its smallest ``k + 1`` ids - more can't be among the k nearest of any query, as ties
go to smaller ids - so a vector that a third of all rows hold costs one entry.

Defined results: vectors that are null, empty, all zero or hold a null or a non-finite component take no part, nor do vectors of another length than most;
a query's own row is no neighbour, but an equal vector is; rows that share an id count once each;
with no more than ``k`` other rows all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, save

#: Neighbours; vectors that centroids are fitted on (or 32 for each centroid, if that is more).
K, SAMPLE = 20, 20_000
#: Centroids of each half: the root of the number of vectors, within these bounds.
LEAST_CENTROIDS, MOST_CENTROIDS = 4, 512
#: A query takes cells until they hold this many vectors, or this share of all, whichever is more. The test tables are nearly uniform on the sphere,
#: where a share is what recall depends on; clustered vectors can take a far smaller one.
CANDIDATES, SHARE = 1000, 0.5
#: The heap hands out this part of a row of cells at once.
STRETCH = 16
ROUNDS = 15
#: Vectors of a block, and queries that meet it together.
BLOCK, BUNCH = 8192, 512
#: Partial results that are merged at once.
MERGED = 256


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that take part, and how many these are."""
    kind = "float" if isinstance(vectors.schema["embedding"].dataType, T.ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    good = cast.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).filter(fine)
    sizes = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return (good.filter(F.size("vector") == sizes[0]["n"]), sizes[0]["count"]) if sizes else (good, 0)


def lloyd(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """k-means centroids."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        held, starts = np.unique(nearest[order], return_index=True)
        centres[held] = np.add.reduceat(points[order], starts) / np.diff([*starts, len(points)])[:, None]
    return centres


def halves(vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    half = max(1, vector.shape[1] // 2)
    return vector[:, :half], vector[:, half:]


class MultiIndex:
    """Centroids of both halves and how many vectors each cell holds."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.centres = [lloyd(x, centroids) if x.shape[1] else np.zeros((1, 0)) for x in halves(sample)]
        self.counts = np.zeros((len(self.centres[0]), len(self.centres[1])), np.int64)

    def cells(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1).astype(np.int32) for x, c in zip(halves(vectors), self.centres)]

    def dots(self, vectors: np.ndarray, half: int) -> np.ndarray:
        return halves(vectors)[half] @ self.centres[half].T

    def route(self, query: np.ndarray, enough: int) -> np.ndarray:
        """For each centroid of the first half the least inner product of the second half's centroids whose cells are taken (infinite: none).

        The heap holds, for each first centroid, the best cell not taken yet; cells are taken in stretches until they hold ``enough`` vectors.
        """
        first, second = self.dots(query[None], 0)[0], self.dots(query[None], 1)[0]
        order = np.argsort(-second, kind="stable")
        ordered = second[order].tolist()
        before = np.zeros((len(first), len(order) + 1), np.int64)
        np.cumsum(self.counts[:, order], axis=1, out=before[:, 1:])
        stretch = max(1, len(ordered) // STRETCH)
        heap = [(-(x + ordered[0]), i, 0) for i, x in enumerate(first.tolist())]
        heapq.heapify(heap)
        least, held = np.full(len(first), np.inf), 0
        while heap and held < enough:
            score, i, j = heap[0]
            upto = min(j + stretch, len(ordered))
            held += int(before[i, upto] - before[i, j])
            least[i] = ordered[upto - 1]
            if upto < len(ordered):
                heapq.heapreplace(heap, (score + ordered[j] - ordered[upto], i, upto))
            else:
                heapq.heappop(heap)
        return least


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def block_plan(held: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First block and number of blocks of each first centroid, with ``held`` entries; and the number of all blocks."""
    start, parts, at, filled = np.zeros(len(held), np.int64), np.ones(len(held), np.int64), 0, 0
    for c, n in enumerate(held.tolist()):
        if filled and filled + n > block:
            at, filled = at + 1, 0
        start[c] = at
        if n > block:
            parts[c] = -(-n // block)
            at += int(parts[c])
        else:
            filled += n
    return start, parts, at + 1


def nearest(vectors: DataFrame, queries, k: int = K, *, centroids: int | None = None, sample: int = SAMPLE, candidates: int = CANDIDATES, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of every row that the condition ``queries`` chooses."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    good, total = usable(vectors)
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    wanted_centroids = centroids or max(LEAST_CENTROIDS, min(MOST_CENTROIDS, isqrt(total)))
    rows = good.orderBy(F.xxhash64("vector"), "vec_id").limit(max(sample, 32 * wanted_centroids)).select("vector").toArrow()
    index = MultiIndex(matrix(rows.column("vector")), wanted_centroids)
    kind = good.schema["vector"].dataType.elementType.simpleString()

    # Equal vectors together, with their smallest ids. Ids alone are sorted, in two steps, as one vector may have a third of all rows.
    keyed = good.select(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "vec_id", "vector")
    few = keyed.groupBy("h1", "h2", F.spark_partition_id().alias("part")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    ids = few.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    entries = keyed.groupBy("h1", "h2").agg(F.any_value("vector").alias("vector")).join(ids, ["h1", "h2"]).select("h1", "ids", "vector")

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                cells = index.cells(matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, cells)], names=["h1", "ids", "vector", "c0", "c1"])

    placed, placed_path = save(entries.mapInArrow(place, f"h1 long, ids array<long>, vector array<{kind}>, c0 int, c1 int"), "cells")
    held = np.zeros(len(index.centres[0]), np.int64)
    for r in placed.groupBy("c0", "c1").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("entries")).collect():
        index.counts[r["c0"], r["c1"]] = r["n"]
        held[r["c0"]] += r["entries"]
    start, parts, n_blocks = block_plan(held, block)
    enough = max(candidates, int(np.ceil(share * index.counts.sum()))) + k + 1

    # What goes to tasks here is the index: centroids, counts and the plan of blocks, all bounded by MOST_CENTROIDS.
    def routes(batches):
        for batch in batches:
            taken, blocks = [], []
            for q in matrix(batch.column("vector")) if batch.num_rows else ():
                least = index.route(q, enough)
                own = np.flatnonzero(least < np.inf)
                blocks.append(np.unique(np.concatenate([np.arange(start[c], start[c] + parts[c]) for c in own])).astype(np.int32))
                # A little less than the exact bound: another order of additions must not lose a cell.
                taken.append((least - 1e-6).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(taken, pa.list_(pa.float32())), pa.array(blocks, pa.list_(pa.int32()))], names=["query_id", "vector", "least", "blocks"])

    asked = good.filter(queries).select(F.col("vec_id").alias("query_id"), "vector").mapInArrow(routes, f"query_id long, vector array<{kind}>, least array<float>, blocks array<int>")
    asked, _ = save(asked.withColumn("query", F.monotonically_increasing_id()), "queries")

    plan = spark.createDataFrame(list(zip(range(len(start)), start.tolist(), parts.tolist())), "c0 int, start long, parts long")
    located = placed.join(F.broadcast(plan), "c0").withColumn("block", (F.col("start") + F.pmod("h1", "parts")).cast("int"))
    stored = located.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("c0", "c1", "ids", "vector"))).alias("held"))
    bunches = max(1, asked.count() // BUNCH)
    sent = asked.select("query", "query_id", "vector", "least", F.explode("blocks").alias("block"))
    sent = sent.groupBy("block", F.pmod(F.xxhash64("query"), F.lit(bunches)).alias("bunch")).agg(F.collect_list(F.struct("query", "query_id", "vector", "least")).alias("asking"))
    met = sent.join(stored, "block").select("block", "asking", "held")

    def rank(batches):
        for batch in batches:
            for at, asking, entries in zip(batch.column("block").to_pylist(), batch.column("asking"), batch.column("held")):
                a, h = asking.values, entries.values
                q, v, least = matrix(a.field("vector")), matrix(h.field("vector")), matrix(a.field("least"))
                c0, second = h.field("c0").to_numpy(), index.dots(q, 1)[:, h.field("c1").to_numpy()]
                scores = np.full((len(q), len(v)), -np.inf)
                cuts = np.flatnonzero(np.diff(c0, prepend=-1, append=-1))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # a run of cells with one first centroid
                    bound = least[:, c0[lo]]
                    some = np.flatnonzero(bound < np.inf)
                    if len(some):
                        found = q[some] @ v[lo:hi].T
                        scores[some, lo:hi] = np.where(second[some, lo:hi] >= bound[some, None], found, -np.inf)
                top = min(k, scores.shape[1] - 1)
                cut = -np.partition(-scores, top, axis=1)[:, top]
                # Ties at the cut stay, so that smaller ids can win.
                above = (scores >= cut[:, None] - 1e-9) & (scores > -np.inf)
                ids, query, own = h.field("ids").to_pylist(), a.field("query").to_pylist(), a.field("query_id").to_pylist()
                out: list[tuple] = []
                for i in range(len(q)):
                    for j in np.flatnonzero(above[i]):
                        exact = float(np.dot(q[i], v[j]))
                        out += [(query[i], own[i], at, x, exact) for x in ids[j] if x != own[i]]
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["query", "query_id", "part", "vec_id", "score"])

    scored, _ = save(met.mapInArrow(rank, "query long, query_id long, part long, vec_id long, score double"), "scored")
    discard(spark, placed_path)
    best = scored.select("query", "query_id", "part", F.struct((-F.col("score")).alias("less"), "vec_id").alias("b"))
    # Each merge keeps k of at most MERGED partial results, so no query's results meet all at once.
    while n_blocks > 1:
        n_blocks = -(-n_blocks // MERGED)
        merged = best.groupBy("query", "query_id", F.floor(F.col("part") / MERGED).alias("part")).agg(F.slice(F.array_sort(F.collect_list("b")), 1, k).alias("best"))
        best = merged.select("query", "query_id", "part", F.explode("best").alias("b"))
    ranked = best.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.collect_list("b")), 1, k).alias("best")).select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def op8_nearest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("vec_id") % 20 == 0)
