"""Calibration fits whose work is spread over all rows: an isotonic fit merged from ranges, and a logistic fit by gradient steps on moments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _store


def pooled(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of the pool of each value after pooling adjacent violators; ``s`` sums over ``n`` rows each. Equal means are pooled too."""
    sums: list[float] = []
    counts: list[int] = []
    sizes: list[int] = []
    for x, k in zip(s.tolist(), n.tolist()):
        size = 1
        while sums and sums[-1] * k >= x * counts[-1]:
            x, k, size = x + sums.pop(), k + counts.pop(), size + sizes.pop()
        sums.append(x)
        counts.append(k)
        sizes.append(size)
    return np.repeat(np.arange(len(sizes)), sizes)


def _least_prefix(s: np.ndarray, n: np.ndarray, total_s: float, total_n: int) -> tuple[float, int, float]:
    """The whole sum of ``s * total_n - n * total_s``, the number of values of its least prefix (the shortest), and that prefix's sum."""
    steps = np.cumsum(s.astype(np.longdouble) * total_n - n.astype(np.longdouble) * total_s)
    at = int(np.argmin(steps))
    return (float(steps[-1]), at + 1, float(steps[at])) if steps[at] < 0 else (float(steps[-1]), 0, 0.0)


def isotonic(pairs: DataFrame, parts: int | None = None) -> DataFrame:
    """(confidence, calibrated): the non-decreasing steps that fit ``correct`` best, one row for each distinct confidence. Inputs: confidence, correct; rows with a null in either take no part.

    Distinct confidences are counted, parted by ranges, and pooled within each. What is left to find are pools that reach over a range's end, one for each end at most. A stretch of ranges is cut at the least prefix
    of its values less their mean: below the cut the fit is under the mean, above it is not; a stretch that has no such cut is one pool. All stretches are cut at once, from two numbers of each range, until
    each lies in one range - where the pools stand already - or is a pool. So no task and no driver holds more than its range or a few numbers of each range.
    """
    spark = pairs.sparkSession
    known = pairs.filter("confidence IS NOT NULL AND correct IS NOT NULL AND NOT isnan(confidence)")
    counted = known.groupBy(F.col("confidence").cast("double").alias("confidence")).agg(F.sum(F.col("correct").cast("double")).alias("s"), F.count("*").alias("n"))
    ranges = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = counted.repartitionByRange(ranges, "confidence").sortWithinPartitions("confidence").withColumn("part", F.spark_partition_id())

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's values in one batch, with the place of their pool and its sum."""
        rows = [b for b in batches if b.num_rows]
        if rows:
            whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            s, n = whole.column("s").to_numpy(), whole.column("n").to_numpy()
            number = pooled(s, n)
            yield pa.RecordBatch.from_arrays([whole.column("part"), whole.column("confidence"), pa.array(number), pa.array(np.bincount(number, s)[number]), pa.array(np.bincount(number, n).astype(np.int64)[number])], names=["part", "confidence", "pool", "s", "n"])

    points, _ = _store(sorted_.mapInArrow(pool, "part int, confidence double, pool long, s double, n long"))
    blocks, _ = _store(points.groupBy("part", "pool").agg(F.max("s").alias("s"), F.max("n").alias("n")).repartitionByRange(ranges, "part").sortWithinPartitions("part", "pool"))
    sizes = {r["part"]: r["k"] for r in blocks.groupBy("part").agg(F.count("*").alias("k")).collect()}  # one row a range
    order = sorted(sizes)

    def split_by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each range's pools: all of a range's rows stand together, in order."""
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        whole = pa.Table.from_batches(rows).combine_chunks()
        part, pool_, s, n = (whole.column(c).to_numpy() for c in ("part", "pool", "s", "n"))
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            mine = mine[np.argsort(pool_[mine])]
            yield p, s[mine], n[mine]

    grouped = blocks.groupBy("part")

    def ask(stretches: list[tuple[tuple[int, int], tuple[int, int]]]) -> tuple[dict, dict]:
        """For each stretch its sum and count, then for each range in it: whole sum, least prefix's length and sum."""

        def inside(k: int, p: int) -> slice:
            (a, i), (b, j) = stretches[k]
            return slice(i if p == a else 0, j if p == b else None)

        def touched(p: int) -> list[int]:
            return [k for k, ((a, _), (b, _)) in enumerate(stretches) if a <= p <= b]

        def sums(rows: pa.Table) -> pa.Table:
            p, s, n = next(split_by_part(rows.to_batches()))
            found = [(k, float(s[inside(k, p)].sum()), int(n[inside(k, p)].sum())) for k in touched(p)]
            return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64()))], names=["k", "s", "n"])

        totals = {r["k"]: (r["s"], r["n"]) for r in grouped.applyInArrow(sums, "k long, s double, n long").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()}

        def prefixes(rows: pa.Table) -> pa.Table:
            p, s, n = next(split_by_part(rows.to_batches()))
            found = [(k, p, *_least_prefix(s[inside(k, p)], n[inside(k, p)], *totals[k])) for k in touched(p)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
            return pa.table([pa.array([f[c] for f in found], t) for c, t in enumerate(kinds)], names=["k", "p", "all", "at", "least"])

        return totals, {(r["k"], r["p"]): (r["all"], r["at"], r["least"]) for r in grouped.applyInArrow(prefixes, "k long, p long, all double, at long, least double").collect()}

    # Stretches from (range, pool) to before (range, pool); pools that reach over ends of ranges, with their value. Both have a range's number at most.
    open_ = [((order[0], 0), (order[-1], sizes[order[-1]]))] if len(order) > 1 else []
    joined: list[tuple[tuple[int, int], tuple[int, int], float]] = []
    while open_:
        totals, parts_ = ask(open_)
        cut: list[tuple[tuple[int, int], tuple[int, int]]] = []
        for k, (start, end) in enumerate(open_):
            before, best = 0.0, (0.0, None)
            for p in order:
                if (k, p) in parts_:
                    whole, at, least = parts_[k, p]
                    if at and before + least < best[0]:
                        best = (before + least, (p, at + (start[1] if p == start[0] else 0)))
                    before += whole
            if best[1] is None or best[1] == end:
                joined.append((start, end, totals[k][0] / totals[k][1]))
                continue
            cut += [(start, best[1]), (best[1], end)]
        open_ = []
        for (a, i), (b, j) in cut:
            while i >= sizes[a] and a != b:  # begins after a range's last pool: with the next range
                a, i = order[order.index(a) + 1], 0
            if a != b:
                open_.append(((a, i), (b, j)))

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, pool_ = batch.column("part").to_numpy(), batch.column("pool").to_numpy()
            fitted = batch.column("s").to_numpy() / batch.column("n").to_numpy()
            for (a, i), (b, j), mean in joined:
                at_or_after = (part > a) | ((part == a) & (pool_ >= i))
                fitted[at_or_after & ((part < b) | ((part == b) & (pool_ < j)))] = mean
            yield pa.RecordBatch.from_arrays([batch.column("confidence"), pa.array(fitted)], names=["confidence", "calibrated"])

    return points.mapInArrow(value, "confidence double, calibrated double")


def logistic_descent(pairs: DataFrame, low: float, high: float, rate: float, steps: int, ridge: float, degree: int = 48) -> DataFrame:
    """One row (a, b, loss): the logistic regression of ``correct`` on a score scaled to 0..1 between ``low`` and ``high`` (and held there), after ``steps`` gradient steps from zero.

    The gradient needs the sums of sigmoid(a * x + b) and of its product with x over all rows. Over 0..1 this function is a polynomial of x to within rounding, as long as the slope stays moderate, so it is summed
    from the moments of x - its Chebyshev polynomials - which one aggregation gives; steps then cost the same for any number of rows. Inputs: score, correct; rows with a null take no part. No rows: zeros.
    """
    x = F.least(F.greatest((F.col("score").cast("double") - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    rows = pairs.filter("score IS NOT NULL AND correct IS NOT NULL").select(F.acos(2 * x - 1).alias("t"), x.alias("x"), F.col("correct").cast("double").alias("y"))
    sums = [F.sum(F.cos(k * F.col("t"))).alias(f"m{k}") for k in range(degree)] + [F.sum(F.col("x") * F.cos(k * F.col("t"))).alias(f"x{k}") for k in range(degree)] + [F.sum(F.col("y") * F.cos(k * F.col("t"))).alias(f"y{k}") for k in range(degree)]
    got = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy"), *sums).first()
    schema = "a double, b double, loss double"
    if not got["n"]:
        return pairs.sparkSession.createDataFrame([(0.0, 0.0, 0.0)], schema)
    m, mx, my = (np.array([got[f"{c}{k}"] for k in range(degree)]) for c in "mxy")
    nodes = np.cos(np.pi * (np.arange(degree) + 0.5) / degree)
    back = np.polynomial.chebyshev.chebvander(nodes, degree - 1) * 2 / degree
    back[:, 0] /= 2
    at, n, a, b = (nodes + 1) / 2, got["n"], 0.0, 0.0
    for _ in range(steps):
        c = (1 / (1 + np.exp(-(a * at + b)))) @ back
        da, db = (c @ mx - got["xy"]) / n + ridge * a, (c @ m - got["y"]) / n
        a, b = a - rate * da, b - rate * db
    p = 1 / (1 + np.exp(-(a * at + b)))
    right, wrong = np.log(np.maximum(p, 1e-12)) @ back, np.log(np.maximum(1 - p, 1e-12)) @ back
    return pairs.sparkSession.createDataFrame([(float(a), float(b), float(-(right @ my + wrong @ (m - my)) / n))], schema)
