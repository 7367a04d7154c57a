"""Greedy selection in parallel: what stays depends on what better or earlier rows stayed, without going through a key's rows one by one in one task."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import _remove, _store, connected_components

#: Rows of one side that a task compares at once.
TILE = 2048
#: Cosines this close below a threshold reach it: equal vectors must reach 1 whatever the rounding.
SLACK = 1e-12


def unit(vector: Column) -> Column:
    """The vector at length one; null where it is null, empty, zero, or holds a null or non-finite number."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(fine & (size > 0) & (size < float("inf")), F.transform(x, lambda v: v / size))


def _rows(table: pa.Table, column: str = "unit") -> np.ndarray:
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def _conflicting(left: DataFrame, right: DataFrame, threshold: float, tile: int) -> DataFrame:
    """id of the rows of ``right`` whose cosine with a better row of ``left`` - of the same group and another graph - reaches the threshold.

    Both sides are cut into tiles by their place, and each tile of one meets each of the other: a task holds two tiles, whatever the group's size. Columns: id, grp, graph, place, unit.
    """
    at = F.floor((F.col("place") - 1) / tile).cast("int")
    a, b = left.withColumn("lt", at), right.withColumn("rt", at)
    # Rows can only be hit by better ones, so tiles meet no tile behind them.
    meets = a.select("grp", "lt").distinct().join(b.select("grp", "rt").distinct(), "grp").filter("lt <= rt")
    key = ["grp", "lt", "rt"]
    # Both sides may come from one table: columns of their own tell them apart.
    x, y = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (a.join(meets, ["grp", "lt"]), b.join(meets, ["grp", "rt"])))

    def hit(one: pa.Table, two: pa.Table) -> pa.Table:
        ids = two.column("id").to_numpy()
        if not (one.num_rows and two.num_rows):
            return pa.table({"id": pa.array([], pa.int64())})
        near = _rows(two) @ _rows(one).T >= threshold - SLACK
        near &= two.column("graph").to_numpy()[:, None] != one.column("graph").to_numpy()[None]
        near &= two.column("place").to_numpy()[:, None] > one.column("place").to_numpy()[None]
        return pa.table({"id": pa.array(ids[near.any(axis=1)], pa.int64())})

    return x.groupBy(*key).cogroup(y.groupBy(*key)).applyInArrow(hit, "id long").distinct()


def _first_tile(rows: DataFrame, threshold: float) -> DataFrame:
    """id of the rows that stay, of groups that fit in one tile."""

    def greedy(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        units, graphs = _rows(group), group.column("graph").to_numpy()
        near = (units @ units.T >= threshold - SLACK) & (graphs[:, None] != graphs[None])
        stays = np.zeros(len(units), bool)
        for k in range(len(units)):
            stays[k] = not (near[k] & stays).any()
        return pa.table({"id": pa.array(group.column("id").to_numpy()[stays], pa.int64())})

    return rows.groupBy("grp").applyInArrow(greedy, "id long")


def diverse(rows: DataFrame, group: list[str], graph: str, order: list[Column], vector: str, threshold: float, tile: int = TILE) -> DataFrame:
    """``rows`` without those whose cosine with a better one that stays, of another graph in the group, reaches ``threshold``; null graphs are one, rows without a usable vector stay.

    The first rows of each group, as many as fit in a tile, are settled in one task. Then follow stretches that double: what stayed before takes its near ones out, and the rest
    is settled in rounds - a row stays once no better undecided one is near it, and takes out those near it. This gives what going through all rows in order gives;
    vectors are compared in tiles of two bounded blocks, and no pairs are listed.
    """
    placed = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    named, named_path = _store(placed.withColumn("__id", F.monotonically_increasing_id()))
    usable = unit(F.col(vector))
    # Vectors of different lengths are not compared.
    keyed = named.select(F.col("__id").alias("id"), F.struct(*group, F.size(vector).alias("__n")).alias("grp"), F.xxhash64(graph).alias("graph"), F.col("__place").alias("place"), usable.alias("unit")).filter("unit IS NOT NULL")
    light, light_path = _store(keyed.withColumn("stretch", F.when(F.col("place") <= tile, 0).otherwise(F.ceil(F.log2(F.col("place") / tile))).cast("int")))
    columns = ["id", "grp", "graph", "place", "unit"]
    last = light.agg(F.max("stretch")).first()[0]
    paths, kept = [named_path, light_path], None
    for stretch in range(0 if last is None else last + 1):
        todo = light.filter(F.col("stretch") == stretch).select(*columns)
        if stretch == 0:
            kept, path = _store(todo.join(_first_tile(todo, threshold), "id", "left_semi"))
            paths.append(path)
            continue
        todo, path = _store(todo.join(_conflicting(kept, todo, threshold, tile), "id", "left_anti"))
        while todo.limit(1).count():
            blocked = _conflicting(todo, todo, threshold, tile)
            free, free_path = _store(todo.join(blocked, "id", "left_anti"))
            paths.append(free_path)
            kept = kept.union(free)
            left = todo.join(free.select("id"), "id", "left_anti")
            rest, rest_path = _store(left.join(_conflicting(free, left, threshold, tile), "id", "left_anti"))
            _remove(rows, path)
            todo, path = rest, rest_path
        paths.append(path)
    if kept is None:
        return named.drop("__place", "__id")
    gone = light.select("id").join(kept.select("id"), "id", "left_anti")
    return named.join(gone, named["__id"] == gone["id"], "left_anti").drop("__place", "__id")


def word_set(text: Column) -> Column:
    """Sorted distinct words between white space, in small letters; none where there is no text."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")))


def _overlapping(classes: DataFrame, most: float) -> DataFrame:
    """Pairs (a, b) of classes of one key whose word sets have a Jaccard overlap above ``most``. Prefix filter: ordered from rare to frequent, such sets share one of the first ``n - ceil(most * n) + 1`` words."""
    words = classes.select("c", "key", F.size("words").alias("n"), F.explode("words").alias("word"))
    often = words.groupBy("word").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("c").orderBy("times", "word"))
    prefix = words.join(often, "word").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(most * F.col("n")) + 1).select("c", "key", "n", "word")
    x, y = prefix.alias("x"), prefix.alias("y")
    same = (F.col("x.word") == F.col("y.word")) & F.col("x.key").eqNullSafe(F.col("y.key")) & (F.col("x.c") < F.col("y.c"))
    sizes = (F.col("x.n") >= most * F.col("y.n")) & (F.col("y.n") >= most * F.col("x.n"))
    met = x.join(y, same & sizes).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    full = met.join(classes.select(F.col("c").alias("a"), F.col("words").alias("u")), "a").join(classes.select(F.col("c").alias("b"), F.col("words").alias("v")), "b")
    shared = F.size(F.array_intersect("u", "v"))
    return full.filter(shared > most * (F.size("u") + F.size("v") - shared)).select("a", "b")


def without_redundant(messages: DataFrame, key: str, order: str, most: float) -> DataFrame:
    """(key, order) of the messages that stay: one whose words overlap (Jaccard) by more than ``most`` with a kept one goes, or takes the place of the first such one if it is more confident. Inputs: content, confidence.

    Messages are gone through by ``order`` (equal ones by confidence, then content); a null confidence is below all others; messages without a word stay. Only messages whose word sets are linked by
    overlaps decide about each other. So equal word sets are one class, and classes that overlap with no other - copies of one message, however many - take one aggregation. Linked classes are gone
    through together, as a stream: what is held are their links and the messages that stay, never a key's messages.
    """
    kinds = {f.name: f.dataType.simpleString() for f in messages.schema.fields}
    sure = F.coalesce(F.col("confidence").cast("double"), F.lit(float("-inf")))
    rows, _ = _store(messages.select(F.col(key).alias("key"), F.col(order).alias("at"), F.coalesce("content", F.lit("")).alias("content"), sure.alias("sure"), word_set(F.col("content")).alias("words")))
    classes, _ = _store(rows.groupBy("key", "words").agg(F.lit(1).alias("one")).select("key", "words", F.monotonically_increasing_id().alias("c")))
    links, _ = _store(_overlapping(classes, most)) if most < 1 else (None, None)
    placed = rows.join(classes, rows["key"].eqNullSafe(classes["key"]) & (rows["words"] == classes["words"])).select(rows["key"], "at", "content", "sure", F.size(rows["words"]).alias("n"), "c")
    if links is None:  # no overlap is above one
        return rows.select(F.col("key").alias(key), F.col("at").alias(order))
    parts = connected_components(links).select(F.col("node").alias("c"), F.col("component").alias("part"))
    placed, _ = _store(placed.join(parts, "c", "left"))
    alone = placed.filter("part IS NULL AND n > 0").groupBy("c").agg(F.any_value("key").alias("key"), F.min_by("at", F.struct(-F.col("sure"), "at", "content")).alias("at")).select("key", "at")
    empty = placed.filter("n = 0").select("key", "at")

    none = lambda kind: F.lit(None).cast(kind)
    # The links of a part come first (kind 0), then its messages in order.
    own = links.join(parts.select(F.col("c").alias("a"), "part"), "a")
    linked = own.select("part", F.lit(0).alias("kind"), none(kinds[key]).alias("key"), none(kinds[order]).alias("at"), F.lit(0.0).alias("sure"), F.lit("").alias("content"), "a", "b")
    said = placed.filter("part IS NOT NULL").select("part", F.lit(1).alias("kind"), "key", "at", "sure", "content", F.col("c").alias("a"), F.col("c").alias("b"))
    stream = linked.unionByName(said).repartition("part").sortWithinPartitions("part", "kind", "at", "sure", "content").drop("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, near, alive = None, {}, {}
        names, types = ["key", "at"], None

        def out() -> pa.RecordBatch:
            kept = [k for q in alive.values() for k in q]
            return pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], t) for c, t in zip((2, 3), types)], names=names)

        for batch in batches:
            types = [batch.column(c).type for c in names]
            for p, kind, who, at, sure_, a, b in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "key", "at", "sure", "a", "b"))):
                if p != part:
                    if alive:
                        yield out()
                    part, near, alive, n = p, {}, {}, 0
                if kind == 0:
                    near.setdefault(a, [a]).append(b)
                    near.setdefault(b, [b]).append(a)
                    continue
                n += 1
                # The first message that stays and overlaps with this one: the oldest of each class is at its queue's head.
                first = min((alive[c][0] for c in near[a] if alive.get(c)), default=None)
                if first is not None:
                    if sure_ <= first[4]:
                        continue
                    alive[first[1]].popleft()
                alive.setdefault(a, deque()).append((n, a, who, at, sure_))
        if alive:
            yield out()

    settled = stream.mapInArrow(run, f"key {kinds[key]}, at {kinds[order]}")
    return alone.unionByName(empty).unionByName(settled).select(F.col("key").alias(key), F.col("at").alias(order))
