"""Folds over ordered events as aggregates: clamped updates compose, so a key's history is folded in slices, wherever they lie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import _store

#: x -> min(high, max(low, scale * x + shift)), with a scale that is not negative. Such functions are closed under composition.
FORM = ("scale", "shift", "low", "high")
FAR = float("inf")


def after(first: tuple, then: tuple) -> tuple:
    """The function that applies ``first``, ``then`` next; works on numbers, arrays of numbers and columns of both."""
    a, b, low, high = first
    c, d, under, over = then
    numbers = not any(isinstance(x, Column) for x in (*first, *then))
    least, most = (np.minimum, np.maximum) if numbers else (F.least, F.greatest)
    fit = lambda x: least(over, most(under, x))

    def end(x):  # nothing times an infinite end is nothing
        if numbers:
            with np.errstate(invalid="ignore"):
                return np.where(np.equal(c, 0), 0.0, c * x) + d
        return F.when(c == 0, F.lit(0.0)).otherwise(c * x) + d

    return c * a, c * b + d, fit(end(low)), fit(end(high))


def applied(form: tuple, x):
    a, b, low, high = form
    return np.minimum(high, np.maximum(low, a * x + b)) if not any(isinstance(v, Column) for v in (*form, x)) else F.least(high, F.greatest(low, a * x + b))


def _composed(forms: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One function for each run of equal keys: neighbours are composed in pairs until each run is one (as many steps as the logarithm of the longest run)."""
    while True:
        same = keys[1:] == keys[:-1]
        if not same.any():
            return forms, keys
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        place = np.arange(len(keys)) - np.repeat(starts, np.diff([*starts, len(keys)]))
        # The first of each pair within its run, and whether it has a second.
        one = np.flatnonzero(place % 2 == 0)
        two = np.minimum(one + 1, len(keys) - 1)
        paired = (two > one) & (keys[two] == keys[one])
        merged = forms[:, one].copy()
        if paired.any():
            merged[:, paired] = np.array(after(tuple(forms[:, one[paired]]), tuple(forms[:, two[paired]])))
        forms, keys = merged, keys[one]


def clamped_fold(events: DataFrame, keys: list[str], order: list[str], scale: Column, shift: Column, low: Column, high: Column, start: float, slices: int | None = None) -> DataFrame:
    """``keys``, value and updates: each key's value after all its events in ``order``, from ``start`` on. An event makes min(high, max(low, scale * x + shift)) of a value x.

    Events are parted by ranges of key and order, so a hot key's history lies in many partitions; each partition composes its part of a key's updates into one
    function, and a key's few functions are applied in the order of the partitions. So no task holds a key's history, and no list of it is made.
    Events with a null in a function's numbers change nothing, but count. Equal orders are settled by the numbers.
    """
    spark = events.sparkSession
    numbers = [c.cast("double").alias(n) for c, n in zip((scale, shift, low, high), FORM)]
    whole = F.coalesce(*[F.when(c.isNull(), F.lit(True)) for c in (scale, shift, low, high)], F.lit(False))
    rows = events.select(F.struct(*keys).alias("key"), F.struct(*order).alias("at"), *numbers, whole.alias("void"))
    rows = rows.select("key", "at", "void", *[F.when(F.col("void"), F.lit(v)).otherwise(F.col(n)).alias(n) for n, v in zip(FORM, (1.0, 0.0, -FAR, FAR))])
    parts = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(parts, "key", "at", *FORM).sortWithinPartitions("key", "at", *FORM)
    # Adjacent keys are compared by two hashes.
    run = F.struct(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b"))
    stored, _ = _store(sorted_.select("key", run.alias("run"), F.monotonically_increasing_id().alias("row"), *FORM))

    key_type = stored.schema["key"].dataType.simpleString()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            run = batch.column("run")
            # Rows of another partition may follow in a batch, in any order: they are runs of their own.
            key = np.column_stack([*(run.field(c).to_numpy() for c in ("a", "b")), batch.column("row").to_numpy() >> 33])
            number = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(axis=1)]))
            forms, which = _composed(np.array([batch.column(n).to_numpy() for n in FORM]), number)
            first = pa.array(np.searchsorted(number, which))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(first), batch.column("row").take(first), pa.array(np.bincount(number)), *map(pa.array, forms)], names=["key", "row", "updates", *FORM])

    # A batch is a part of a partition in its order, so its function stands at its first row's number.
    named = stored.select("key", "run", "row", *FORM).mapInArrow(compose, f"key {key_type}, row long, updates long, scale double, shift double, low double, high double")
    gathered = named.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("row", *FORM))).alias("forms"), F.sum("updates").alias("updates"))
    value = F.aggregate("forms", F.lit(float(start)), lambda x, f: applied(tuple(f[n] for n in FORM), x))
    return gathered.select("key.*", value.alias("value"), "updates")


def numbered(rows: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """``rows`` with their place (long, from 0) in ``order``: ranges are sorted apart, and shifted by how many rows stand before them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = _store(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    offsets, total = [], 0
    for p in sorted(sizes):
        offsets.append((p, total))
        total += sizes[p]
    before = rows.sparkSession.createDataFrame(offsets, "__part long, __before long")
    local = F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + local).drop("__row", "__part", "__before")


def sequence_weights(records: DataFrame, actor: str, order: list[str], step: str, good: Column, start: float = 1.0, gain: float = 0.1, loss: float = 0.05, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """from_step, to_step, weight, n: the weight of each direct succession of steps after all successions in ``order``: a good one adds ``gain``, another takes away ``loss``, within the bounds.

    ``good`` says of the later record whether it went well; null counts as not.
    """
    before = F.lag(step).over(Window.partitionBy(actor).orderBy(*order))
    moves = records.select(before.alias("from_step"), F.col(step).alias("to_step"), F.coalesce(good, F.lit(False)).alias("good"), *order).filter("from_step IS NOT NULL AND to_step IS NOT NULL")
    shift = F.when(F.col("good"), F.lit(gain)).otherwise(F.lit(-loss))
    folded = clamped_fold(moves, ["from_step", "to_step"], order, F.lit(1.0), shift, F.lit(low), F.lit(high), start)
    return folded.select("from_step", "to_step", F.round("value", 9).alias("weight"), F.col("updates").alias("n"))


def rule_weights(corrections: DataFrame, order: list[str], rate: float, floor: float, ceiling: float) -> DataFrame:
    """(rule, weight, updates): rule weights from 1 after all corrections in order: a wrong one takes away ``rate`` of it, but not below the floor; a right one adds ``rate`` up to the ceiling. Inputs: rule, wrong."""
    wrong = F.col("wrong")
    pick = lambda a, b: F.when(wrong, F.lit(a)).when(~wrong, F.lit(b))
    folded = clamped_fold(corrections, ["rule"], order, pick(1.0 - rate, 1.0), pick(0.0, rate), pick(floor, -FAR), pick(FAR, ceiling), 1.0)
    return folded.select("rule", F.round("value", 9).alias("weight"), "updates")


def kind_weights(corrections: DataFrame, order: list[str], rate: float, keep: float) -> DataFrame:
    """(kind, tool, weight): how much a kind of node speaks for a tool after all corrections. Inputs: kinds (array), predicted, corrected.

    Each correction adds ``rate`` to the corrected tool for all its kinds and, if the prediction was wrong, takes it from the predicted one, not below zero; then all weights, of other kinds and tools too, shrink to ``keep`` of themselves.
    An event stands for its update and for the shrinking since the key's last one, which its place among all corrections tells; the shrinking after the last one comes at the end. Equal orders are settled by the tools.
    """
    placed = numbered(corrections.select("kinds", "predicted", "corrected", *order), [*order, "predicted", "corrected"])
    total = placed.count()
    each = placed.select("index", F.explode(F.array_distinct("kinds")).alias("kind"), "predicted", "corrected")
    up = each.select("kind", F.col("corrected").alias("tool"), "index", F.lit(rate).alias("shift"))
    down = each.filter("predicted <> corrected").select("kind", F.col("predicted").alias("tool"), "index", F.lit(-rate).alias("shift"))
    # With x a weight times keep to the power of minus the number of corrections so far, shrinking is no change; but such numbers overflow. So the gap since the key's last event is used.
    gap = F.coalesce(F.col("index") - F.lag("index").over(Window.partitionBy("kind", "tool").orderBy("index")) - 1, F.lit(0))
    events, _ = _store(up.unionByName(down).withColumn("gap", gap))
    shrunk = F.pow(F.lit(float(keep)), F.col("gap") + 1)
    folded = clamped_fold(events, ["kind", "tool"], ["index"], shrunk, F.col("shift") * keep, F.when(F.col("shift") < 0, F.lit(0.0)).otherwise(F.lit(-FAR)), F.lit(FAR), 0.0)
    last = events.groupBy("kind", "tool").agg(F.max("index").alias("last"))
    return folded.join(last, ["kind", "tool"]).select("kind", "tool", F.round(F.col("value") * F.pow(F.lit(float(keep)), F.lit(total - 1) - F.col("last")), 9).alias("weight"))
