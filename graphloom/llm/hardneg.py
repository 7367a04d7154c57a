"""Operator 13, hard-negative mining with a vantage-point tree over norm-augmented vectors.

A coordinate that fills every vector up to the largest norm turns inner products into distances: the squared distance of an anchor (with a zero there)
from a row is a constant of the anchor less twice their product. So larger scores are nearer rows, and a window of scores is an annulus around the anchor.

The top of the tree is fitted on a bounded sample: each node has a vantage point and parts the rows at their median distance from it. All rows are
placed under it, and for each leaf the least and the largest distance from the vantage points above are measured over all its rows, so skipping a leaf by
the triangle inequality is exact. A leaf is parted into blocks of bounded size, and a task builds the rest of the tree for a block. An anchor
meets only the blocks that its annuli may reach; there it walks the tree from the nearest node on, with a heap of nodes and rows, drops what lies wholly inside or outside
an annulus, and stops once k rows are nearer than the next node. What blocks found is merged, so results equal those of a full search.

First an anchor's positives are searched (in its own leaf, then in the leaves that may hold nearer ones), then for each positive the negatives in its window.
Blocks and bunches of anchors meet in sorted partitions that are read as a stream. Rows with equal vector and label are one entry with its smallest ids, as more can't be among the first.

Defined results: rows with a null id, label or vector, or with any null or non-finite component take no part, nor do vectors of another length than
most (of the shorter, if equally many); rows repeated in id, label and vector count once; a row that shares the anchor's id is none of its positives; without other rows of its label an anchor
returns nothing; an empty table gives an empty result; other columns are ignored. Squared norms must stay below 2 to the power of 62.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_of, bounded_batches, save

POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of the positive's: from, to.
WINDOW = (50, 95)
#: Vectors become whole numbers of this part of one.
UNITS = 256
#: Rows that the top of the tree is fitted on, and the most leaves it has.
SAMPLE, MOST_LEAVES = 20_000, 256
#: Rows of a block, anchors that meet it together, rows of a leaf within a block.
BLOCK, BUNCH, LEAF = 8192, 16_384, 256
#: Beyond any score.
FAR = 1 << 62
#: Bounds are widened by this share of the squared distances: rounding must not lose a row.
SLACK = 1e-6


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector (components times ``UNITS``, rounded down) of the rows that may take part."""
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = cast.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(fine)
    return good.select("vec_id", "label", F.transform("x", lambda x: F.floor(UNITS * x)).alias("vector"))


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as whole numbers; beyond the range where doubles are exact, in 64-bit integers."""
    return np.rint(a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


def augmented(vectors: np.ndarray, largest: float) -> np.ndarray:
    fill = np.sqrt(np.maximum(largest - (vectors**2).sum(axis=1), 0))
    return np.column_stack([vectors, fill])


def distances(points: np.ndarray, vantage: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - vantage) ** 2).sum(axis=1))


def vantage_of(points: np.ndarray) -> int:
    """The point farthest from the middle, from where distances differ most."""
    return int(np.argmax(((points - points.mean(axis=0)) ** 2).sum(axis=1)))


class TopTree:
    """Vantage points and radii over a sample; leaves are numbered from 0."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.nodes: list[tuple[np.ndarray, float, int, int]] = []
        #: For each leaf the nodes above it, from the root.
        self.paths: list[list[int]] = []
        self.root = self._grow(points, leaves, [])

    def _grow(self, points: np.ndarray, leaves: int, path: list[int]) -> int:
        """The number of a node, or -1 - the number of a leaf."""
        if leaves > 1 and len(points) > 1:
            vantage = points[vantage_of(points)]
            far = distances(points, vantage)
            radius = float(np.median(far))
            near = far <= radius
            if near.any() and not near.all():
                at = len(self.nodes)
                self.nodes.append((vantage, radius, 0, 0))
                left = self._grow(points[near], (leaves + 1) // 2, [*path, at])
                right = self._grow(points[~near], leaves // 2, [*path, at])
                self.nodes[at] = (vantage, radius, left, right)
                return at
        self.paths.append(path)
        return -len(self.paths)

    def place(self, points: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """The leaf of each point and its distances from the vantage points above."""
        leaf, above = np.zeros(len(points), np.int32), [[] for _ in points]

        def down(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node < 0:
                leaf[rows] = -1 - node
                return
            vantage, radius, left, right = self.nodes[node]
            far = distances(points[rows], vantage)
            for r, d in zip(rows.tolist(), far.tolist()):
                above[r].append(d)
            down(left, rows[far <= radius])
            down(right, rows[far > radius])

        down(self.root, np.arange(len(points)))
        return leaf, above

    def bounds(self, anchors: np.ndarray, spans: dict[int, list[tuple[float, float]]]) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that the rows of each leaf may have from each anchor; leaves without rows are infinitely far."""
        every = np.array([distances(anchors, v) for v, _, _, _ in self.nodes]).reshape(len(self.nodes), len(anchors))
        least, most = np.full((len(anchors), len(self.paths)), np.inf), np.full((len(anchors), len(self.paths)), np.inf)
        for leaf, span in spans.items():
            least[:, leaf] = 0
            for node, (low, high) in zip(self.paths[leaf], span):
                d = every[node]
                least[:, leaf] = np.maximum(least[:, leaf], np.maximum(d - high, low - d))
                most[:, leaf] = np.minimum(most[:, leaf], d + high)
        return least, most


class BlockTree:
    """The tree over one block: rows are ordered so that a node's rows are neighbours."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]], largest: float, exact: bool):
        points = augmented(vectors, largest)
        self.largest, self.exact = largest, exact
        self.order: list[int] = []
        #: For each node: first row, end, parent, least and largest distance from the parent's vantage point, children.
        self.nodes: list[list] = []
        self.vantages: list[int] = []
        self._grow(points, np.arange(len(points)), -1, 0.0, 0.0)
        order = np.array(self.order)
        self.vectors, self.labels, self.ids = vectors[order], labels[order], [ids[k] for k in order]
        self.watch = points[self.vantages] if self.vantages else points[:0]
        self.masks: dict[tuple[int, bool], np.ndarray] = {}
        self.only = [set(np.unique(self.labels[n[0] : n[1]])) for n in self.nodes]

    def _grow(self, points: np.ndarray, rows: np.ndarray, parent: int, low: float, high: float) -> int:
        at, node = len(self.nodes), [len(self.order), 0, parent, low, high, -1, ()]
        self.nodes.append(node)
        if len(rows) <= LEAF:
            self.order += rows.tolist()
        else:
            vantage = int(rows[vantage_of(points[rows])])
            far = distances(points[rows], points[vantage])
            by = np.argsort(far, kind="stable")
            node[5] = len(self.vantages)
            self.vantages.append(vantage)
            sides = np.split(by, [len(by) // 2])
            node[6] = tuple(self._grow(points, rows[s], at, float(far[s].min()), float(far[s].max())) for s in sides)
        node[1] = len(self.order)
        return at

    def bounds(self, anchors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that the rows of each node may have with each anchor."""
        d = np.sqrt(np.maximum(((anchors**2).sum(axis=1)[:, None] + (self.watch**2).sum(axis=1)[None]) - 2 * np.column_stack([anchors, np.zeros(len(anchors))]) @ self.watch.T, 0))
        least, most = np.zeros((len(anchors), len(self.nodes))), np.full((len(anchors), len(self.nodes)), np.inf)
        for k, (_, _, parent, low, high, _, _) in enumerate(self.nodes):
            if parent >= 0:
                p = d[:, self.nodes[parent][5]]
                least[:, k] = np.maximum(least[:, parent], np.maximum(p - high, low - p))
                most[:, k] = np.minimum(most[:, parent], p + high)
        half, slack = sizes[:, None] / 2, sizes[:, None] * SLACK + 1
        return half - most**2 / 2 - slack, half - least**2 / 2 + slack

    def asked(self, label: int, same: bool) -> np.ndarray:
        """Which rows have the label, or another one."""
        if (label, same) not in self.masks:
            self.masks[label, same] = (self.labels == label) == same
        return self.masks[label, same]

    def nearest(self, anchor: np.ndarray, least: list[float], most: list[float], label: int, same: bool, own: int | None, lows: list[int], highs: list[int], k: int) -> list[tuple[int, int, int]]:
        """(window, score, id): for each window of scores the first k rows with the anchor's label, or with another one.

        All windows of an anchor share one walk: the nearest node comes next, and the walk ends where no window can gain from it. ``least`` and ``most`` bound the scores of each node.
        """
        best: list[list[tuple[int, int]]] = [[] for _ in lows]
        # What a row must reach to count for a window; an empty window wants nothing.
        floors = [low if low <= high else FAR * 4 for low, high in zip(lows, highs)]
        wanted = self.asked(label, same)
        heap: list[tuple[float, int]] = [(-most[0], 0)]
        while heap:
            bound, at = heapq.heappop(heap)
            if -bound < min(floors):
                break
            first, end, _, _, _, _, children = self.nodes[at]
            for child in children:
                held = self.only[child]
                if (label in held if same else held != {label}) and any(most[child] >= f and least[child] <= h for f, h in zip(floors, highs)):
                    heapq.heappush(heap, (-most[child], child))
            if children:
                continue
            scores = products(self.vectors[first:end], anchor[None], self.exact)[:, 0]
            scores[~wanted[first:end]] = -2 * FAR
            for w, high in enumerate(highs):
                if most[at] < floors[w] or least[at] > high:
                    continue
                fits = np.flatnonzero((scores >= floors[w]) & (scores <= high))
                if len(fits) > 2 * k:  # rows as good as the one at place 2k, ties included
                    fits = fits[scores[fits] >= np.partition(scores[fits], -2 * k)[-2 * k]]
                if len(fits):
                    new = ((-int(scores[r]), i) for r in fits.tolist() for i in self.ids[first + r] if i != own)
                    best[w] = heapq.nsmallest(k, [*best[w], *new])
                    if len(best[w]) == k:
                        floors[w] = max(floors[w], -best[w][-1][0])
        return [(w, -less, i) for w, rows in enumerate(best) for less, i in rows]


class Index:
    """The placed rows in blocks, and what is needed to ask them."""

    def __init__(self, good: DataFrame, k: int, block: int = BLOCK, bunch: int = BUNCH):
        """``good``: vec_id, label, vector. ``k``: the most rows that are asked for."""
        self.bunch = bunch
        spark = good.sparkSession
        sizes = good.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm")).orderBy(F.desc("n"), "length").limit(1).collect()
        self.empty = not sizes
        if self.empty:
            return
        self.length, total, self.largest = sizes[0]["length"], sizes[0]["n"], float(sizes[0]["norm"])
        if self.largest >= 2**62:
            raise ValueError("squared norms must stay below 2 ** 62")
        self.exact = self.largest < 2**53
        kind = self.kind = "int" if self.largest < 2**60 else "long"
        good = good.filter(F.size("vector") == self.length).withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
        self.rows = good
        wanted = min(MOST_LEAVES, -(-total // block))
        sample = good.orderBy(F.xxhash64("vector"), "vec_id").limit(SAMPLE).select("vector").toArrow() if wanted > 1 else None
        self.top = TopTree(np.unique(augmented(matrix(sample.column("vector")), self.largest), axis=0) if sample else np.zeros((0, self.length + 1)), wanted)
        top, largest = self.top, self.largest

        # Equal vectors of a label together, with their smallest ids. Ids alone are sorted, in two steps, as one vector may have a third of all rows.
        keyed = good.select(F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"), "label", "vec_id", "vector")
        least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k + 1).alias("ids")
        few = keyed.groupBy("h1", "h2", "label", F.spark_partition_id().alias("part")).agg(least(F.collect_list("vec_id")))
        ids = few.groupBy("h1", "h2", "label").agg(least(F.flatten(F.collect_list("ids"))))
        entries = keyed.groupBy("h1", "h2", "label").agg(F.any_value("vector").alias("vector")).join(ids, ["h1", "h2", "label"]).select("h1", "label", "ids", "vector")

        def place(batches):
            for batch in batches:
                if batch.num_rows:
                    leaf, above = top.place(augmented(matrix(batch.column("vector")), largest))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(above, pa.list_(pa.float64()))], names=["h1", "label", "ids", "vector", "leaf", "above"])

        placed, _ = save(entries.mapInArrow(place, f"h1 long, label long, ids array<long>, vector array<{kind}>, leaf int, above array<double>"), "placed")
        depth = max(map(len, top.paths))
        near = [f(F.try_element_at("above", F.lit(d + 1))).alias(f"{name}{d}") for d in range(depth) for f, name in ((F.min, "low"), (F.max, "high"))]
        measured = placed.groupBy("leaf").agg(F.count("*").alias("n"), *near).collect()  # one row a leaf, MOST_LEAVES at most
        self.spans = {r["leaf"]: [(r[f"low{d}"], r[f"high{d}"]) for d in range(len(top.paths[r["leaf"]]))] for r in measured}
        self.parts = {r["leaf"]: -(-r["n"] // block) for r in measured}
        starts = np.cumsum([0, *self.parts.values()])
        self.first = dict(zip(self.parts, starts.tolist()))
        self.n_blocks = int(starts[-1])
        plan = spark.createDataFrame([(leaf, self.first[leaf], n) for leaf, n in self.parts.items()], "leaf int, first int, parts int")
        self.stored = placed.join(F.broadcast(plan), "leaf").select((F.col("first") + F.pmod("h1", "parts")).cast("int").alias("block"), "label", "ids", "vector")

    def ask(self, asking: DataFrame, same: bool, k: int, home: bool | None = None) -> DataFrame:
        """key, w, part, less (the negated score) and id: for each window w (``lows`` to ``highs``) of ``asking`` (key, own, label, vector) the first k rows of each block.

        ``home``: only the leaf that the anchor itself lies in, or all but that one.
        """
        spark = asking.sparkSession
        top, spans, parts, first, largest, exact, kind = self.top, self.spans, self.parts, self.first, self.largest, self.exact, self.kind

        def reach(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = matrix(batch.column("vector"))
                least, most = top.bounds(np.column_stack([v, np.zeros(len(v))]), spans)
                size = (v**2).sum(axis=1) + largest
                slack = size * SLACK + 1
                own = top.place(augmented(v, largest))[0] if home is not None else None
                blocks = []
                for r, (lows, highs) in enumerate(zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist())):
                    best, worst = (size[r] - least[r] ** 2) / 2 + slack[r], (size[r] - most[r] ** 2) / 2 - slack[r]
                    may = np.zeros(len(best), bool)
                    for low, high in zip(lows, highs):
                        may |= (best >= low) & (worst <= high)
                    if own is not None:
                        may &= (np.arange(len(may)) == own[r]) == home
                    blocks.append([b for leaf in np.flatnonzero(may).tolist() if leaf in parts for b in range(first[leaf], first[leaf] + parts[leaf])])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.list_(pa.int32()))], names=[*batch.schema.names, "blocks"])

        fields = f"key long, own long, label long, vector array<{kind}>, lows array<long>, highs array<long>"
        sent, _ = save(asking.select("key", "own", "label", "vector", "lows", "highs").mapInArrow(reach, f"{fields}, blocks array<int>"), "asking")
        bunches = max(1, -(-sent.count() // self.bunch))
        nothing = F.array().cast("array<long>")
        asked = sent.select(F.explode("blocks").alias("block"), F.pmod(F.xxhash64("key"), F.lit(bunches)).cast("int").alias("bunch"), F.lit(1).alias("kind"), "key", "own", "label", "vector", nothing.alias("ids"), "lows", "highs")
        every = F.explode(F.sequence(F.lit(0), F.lit(bunches - 1))).alias("bunch")
        held = self.stored.select("block", every, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("own"), "label", "vector", "ids", nothing.alias("lows"), nothing.alias("highs"))
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = held.unionByName(asked).repartition(tasks, "block", "bunch").sortWithinPartitions("block", "bunch", "kind")

        def search(batches):
            group, waiting, tree = None, [], None
            for batch in batches:
                which = np.column_stack([batch.column(c).to_numpy() for c in ("block", "bunch", "kind")])
                cuts = [0, *(np.flatnonzero((which[1:] != which[:-1]).any(axis=1)) + 1).tolist(), len(which)]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if lo == hi:
                        continue
                    part, (block, bunch, anchors) = batch.slice(lo, hi - lo), which[lo].tolist()
                    if (block, bunch) != group:
                        group, waiting, tree = (block, bunch), [], None
                    if not anchors:
                        waiting.append(part)
                        continue
                    if tree is None:
                        rows = pa.Table.from_batches(waiting)
                        tree, waiting = BlockTree(matrix(rows.column("vector")), rows.column("label").to_numpy(), rows.column("ids").to_pylist(), largest, exact), []
                    v = matrix(part.column("vector"))
                    least, most = tree.bounds(v, (v**2).sum(axis=1) + largest)
                    keys, own, labels, lows, highs = (part.column(c).to_pylist() for c in ("key", "own", "label", "lows", "highs"))
                    out = []
                    for r in range(len(v)):
                        found = tree.nearest(v[r], least[r].tolist(), most[r].tolist(), labels[r], same, own[r] if same else None, lows[r], highs[r], k)
                        out += [(keys[r], w, block, -score, i) for w, score, i in found]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["key", "w", "part", "less", "id"])

        return save(met.mapInArrow(search, "key long, w long, part long, less long, id long"), "found")[0]


def mine(rows: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, *, block: int = BLOCK, bunch: int = BUNCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from ``rows`` (vec_id, label, vector of whole numbers).

    ``anchors`` is the condition that chooses anchors. Their positives are the first other rows of their label; for each of these
    the first rows of other labels with ``window[0]`` to ``window[1]`` hundredths of its score are returned.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    index = Index(rows, max(positives, negatives), block, bunch)
    if index.empty:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    chosen = index.rows.filter(anchors).dropDuplicates(["vec_id", "label", "vector"])
    chosen, _ = save(chosen.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").alias("own"), "label", "vector"), "anchors")
    one = lambda c: F.array(c).cast("array<long>")
    open_ = chosen.withColumns({"lows": one(F.lit(-FAR)), "highs": one(F.lit(FAR))})
    near = index.ask(open_, True, positives, True if len(index.spans) > 1 else None)
    if len(index.spans) > 1:
        # The last of enough positives in the own leaf bounds what the other leaves must reach.
        reached = best_of(near, ["key"], ["less", "id"], positives, index.n_blocks).filter(F.col("rank") == positives).select("key", (-F.col("less")).alias("low"))
        bounded = chosen.join(reached, "key", "left").withColumns({"lows": one(F.coalesce("low", F.lit(-FAR))), "highs": one(F.lit(FAR))})
        near = near.unionByName(index.ask(bounded, True, positives, False))
    pairs, _ = save(best_of(near, ["key"], ["less", "id"], positives, index.n_blocks).select("key", (F.col("rank") - 1).cast("long").alias("w"), F.col("id").alias("positive_id"), (-F.col("less")).alias("positive_score")), "positives")
    # Whole bounds, rounded up and down; a window without room has its low end above its high one.
    # Hundreds and the rest apart, so that nothing overflows.
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100L)) div 100"), F.expr("pmod(positive_score, 100L)")
    windows = pairs.withColumns({"low": window[0] * hundreds + F.ceil(window[0] * rest / 100), "high": window[1] * hundreds + F.floor(window[1] * rest / 100)})
    gathered = windows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("s")).select("key", F.col("s.low").alias("lows"), F.col("s.high").alias("highs"))
    hard = best_of(index.ask(chosen.join(gathered, "key"), False, negatives), ["key", "w"], ["less", "id"], negatives, index.n_blocks)
    named = hard.join(pairs, ["key", "w"]).join(chosen.select("key", F.col("own").alias("anchor_id")), "key")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", (-F.col("less")).alias("negative_score"))


def op13_mined(vectors: DataFrame) -> DataFrame:
    """Anchors are the ids divisible by 50; the labels of ids divisible by 7 are moved on by one of ten first."""
    moved = whole(vectors).withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 50 == 0)
