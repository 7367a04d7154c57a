"""Operator 2, best-fit packing in bulk-synchronous rounds.

Items (documents or their last pieces) and gaps (room left in open sequences) are distributed tables. A round

1. range-sorts items and gaps together by size, long before short and gaps before items of their size. Each sorted part is swept once: a gap that
   the sweep meets goes on a stack, an item takes the gap on top - its successor, the smallest that holds it - and what is left of the gap
   comes back once the sweep has come down to its size;
2. where parts place few of their items, matches across parts: each part has so many items that found no gap and so many gaps that it can hand
   on, and a gap that is handed on holds any item of a later part. Parts take from the nearest part before them, and conflicts - many items
   with one successor - are resolved by rank: the items' ranks in their part are joined to the gaps' ranks in theirs. The plan of this
   has two rows for each part;
3. opens new sequences with the longest items left, if even so few items found a gap;
4. updates the gaps by what they took in.

Rounds go on until no item is left, and each one's tables are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, discard, save
from .tokens import TOKEN_BLOCK, encoder, with_end

CAPACITY = 2048
#: Parts that place less than this share of the items left are followed by matches across parts, and these by opening sequences.
FEW = 0.1
#: Items and gaps of a part, about: what a task holds at once.
PART = 250_000
#: Kinds of rows that a sweep gives: an item placed, an item left, a gap handed on, a gap smaller than all items of its part.
PLACED, LEFT, HANDED, SMALL = range(4)
SWEPT = "kind int, part long, rank long, id long, sequence_id long, size long"


def sweep(sizes: np.ndarray, is_item: np.ndarray, ids: np.ndarray) -> tuple[list, list, list, list]:
    """One sorted part: placed (item, gap, room before it was placed), items left, gaps handed on (smallest last) and smaller ones, each as (id, size)."""
    stack: list[tuple[int, int]] = []
    waiting: dict[int, list[int]] = {}  # gaps that are less than the size swept, by their room
    placed, left = [], []
    now = -1
    for size, item, who in zip(sizes.tolist(), is_item.tolist(), ids.tolist()):
        if size != now:
            if waiting:  # what has been left of gaps from now down to this size
                for room in sorted((r for r in waiting if r >= size), reverse=True):
                    stack += [(g, room) for g in waiting.pop(room)]
            now = size
        if not item:
            stack.append((who, size))
        elif not stack:
            left.append((who, size))
        else:
            gap, room = stack.pop()
            placed.append((who, gap, room))
            if room - size >= size:
                stack.append((gap, room - size))
            elif room > size:
                waiting.setdefault(room - size, []).append(gap)
    return placed, left, stack, [(g, room) for room, found in waiting.items() for g in found]


def _sweep(batches):
    """Rows (size, item, id) of a sorted part to rows of SWEPT."""
    got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
    if not got:
        return
    rows = pa.concat_tables(got)
    found = sweep(*(rows.column(c).to_numpy() for c in ("size", "item", "id")))
    part = TaskContext.get().partitionId()
    for kind, out in enumerate(found):
        for k in range(0, len(out), 65536):
            some = out[k : k + 65536]
            n = len(some)
            columns = [np.full(n, kind, np.int32), np.full(n, part, np.int64), np.arange(k, k + n), [x[0] for x in some], [x[1] if kind == PLACED else None for x in some], [x[-1] for x in some]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), *[pa.int64()] * 5])], names=["kind", "part", "rank", "id", "sequence_id", "size"])


def handed(parts: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which gaps go to which part. ``parts``: part, items left, their largest size, gaps to hand on, the smallest of these.

    Gives (part, q0, q1, gap part, r1, times): the items left with ranks q0..q1 go to gaps with ranks r1, r1 - 1, ..., ``times`` items to each.
    Gaps are ranked with the smallest last, and the smallest goes first.
    """
    stack: list[list[int]] = []
    out = []
    for part, items, largest, gaps, smallest in sorted(parts):
        at = 0
        while at < items and stack:
            other, free, room = stack[-1]
            times = min(max(1, room // largest), items - at)
            used = min(free, -(-(items - at) // times))
            upto = min(items, at + used * times)
            out.append((part, at, upto, other, free - 1, times))
            at = upto
            if used == free:
                stack.pop()
            else:
                stack[-1][1] -= used
        if gaps:
            stack.append([part, gaps, smallest])
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, *, key: str = "uid", length: str = "length", few: float = FEW, part: int = PART) -> DataFrame:
    """Place every item in a sequence of at most ``capacity``; returns key, sequence_id, offset.

    ``items`` has a unique long ``key`` and a whole-number ``length`` from 1 to ``capacity``; a sequence is named by the
    key of the item that opened it. Other columns are ignored. An empty table gives an empty result; equal lengths are ranked by key.
    """
    spark = items.sparkSession
    bounded_batches(spark)
    left = items.select(F.col(key).cast("long").alias("id"), F.col(length).cast("long").alias("size"))
    bounds = left.agg(F.count_if((F.col("size") < 1) | (F.col("size") > capacity) | F.col("size").isNull()).alias("bad")).first()
    if bounds["bad"]:
        raise ValueError(f"lengths must lie between 1 and {capacity}")

    # No two items of over half the capacity share a sequence.
    first = left.filter(F.col("size") * 2 > capacity)
    done = [first.select(F.col("id").alias(key), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    gaps, gaps_path = save(first.select(F.col("id").alias("sequence_id"), (capacity - F.col("size")).alias("size")).filter("size > 0"), "gaps")
    left, left_path = save(left.filter(F.col("size") * 2 <= capacity), "left")
    waiting = left.count()
    while waiting:
        both = left.select("size", F.lit(True).alias("item"), "id").unionByName(gaps.select("size", F.lit(False).alias("item"), F.col("sequence_id").alias("id")))
        order = [F.col("size").desc(), F.col("item").asc(), F.col("id").asc()]
        parts = -(-(waiting + gaps.count()) // part)
        # What one task may hold is swept in one, without a shuffle.
        ranged = both.repartitionByRange(parts, *order) if parts > 1 else both.coalesce(1)
        swept, swept_path = save(ranged.sortWithinPartitions(*order).mapInArrow(_sweep, SWEPT), "swept")
        of = lambda kind: F.col("kind") == kind
        # A row for each part: what it has left, and what it can hand on.
        found = swept.groupBy("part").agg(*(F.count_if(of(k)).alias(f"n{k}") for k in (PLACED, LEFT, HANDED)), F.max(F.when(of(LEFT), F.col("size"))).alias("largest"), F.min(F.when(of(HANDED), F.col("size"))).alias("smallest"), F.sum(F.when(of(LEFT), F.col("size"))).alias("tokens")).collect()
        placed_now, tokens = sum(r["n0"] for r in found), sum(r["tokens"] or 0 for r in found)
        # Room is what a gap had before; a gap that took more items than one has the least room last.
        here = swept.filter(of(PLACED)).select(F.col("id").alias(key), "sequence_id", (capacity - F.col("size")).alias("offset"))
        rooms = swept.filter((F.col("kind") == HANDED) | (F.col("kind") == SMALL)).select(F.col("id").alias("sequence_id"), "size", "kind", "part", "rank")
        full = None
        rest = swept.filter(of(LEFT)).select("part", "rank", "id", "size")
        settled = [here]
        cleared, opened = [left_path, gaps_path, swept_path], []
        if placed_now < few * waiting and (flows := handed([(r["part"], r["n1"], r["largest"] or 0, r["n2"], r["smallest"] or 0) for r in found])):
            plan = spark.createDataFrame(flows, "part long, q0 long, q1 long, gap_part long, r1 long, times long")
            asked = rest.join(F.broadcast(plan), "part").filter("rank >= q0 AND rank < q1").selectExpr("id", "size", "gap_part", "r1 - (rank - q0) DIV times AS gap_rank", "rank AS turn")
            free = rooms.filter(of(HANDED)).select("sequence_id", F.col("size").alias("room"), F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"))
            before = Window.partitionBy("gap_part", "gap_rank").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
            across, across_path = save(asked.join(free, ["gap_part", "gap_rank"]).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).select("id", "size", "sequence_id", (capacity - F.col("room") + F.col("before")).alias("offset")), "across")
            cleared.append(across_path)
            settled.append(across.select(F.col("id").alias(key), "sequence_id", "offset"))
            full = across.groupBy("sequence_id").agg(F.sum("size").alias("took"))
            rest = rest.join(F.broadcast(plan.groupBy("part").agg(F.max("q1").alias("upto"))), "part", "left").filter("upto IS NULL OR rank >= upto").drop("upto")
            placed_now += sum(q1 - q0 for _, q0, q1, *_ in flows)
            tokens -= across.agg(F.sum("size")).first()[0]
        if placed_now < few * waiting and placed_now < waiting:
            # As many new sequences as the items left fill at least, with the longest of them. Parts are in order of size, so ranks run on from part to part.
            taken = {part: q1 for part, _, q1, *_ in flows} if full is not None else {}
            want, cuts = -(-tokens // capacity), []
            for r in sorted(found, key=lambda r: r["part"]):
                begin = taken.get(r["part"], 0)
                if n := min(want, r["n1"] - begin):
                    cuts.append((r["part"], begin + n))
                    want -= n
            cut = F.broadcast(spark.createDataFrame(cuts, "part long, cut long"))
            marked = rest.join(cut, "part", "left").withColumn("opens", F.coalesce(F.col("rank") < F.col("cut"), F.lit(False)))
            opened = [marked.filter("opens").select("id", "size")]
            settled.append(opened[0].select(F.col("id").alias(key), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            rest = marked.filter("NOT opens")
        remaining = rooms.select("sequence_id", "size")
        if full is not None:
            remaining = remaining.join(full, "sequence_id", "left").select("sequence_id", (F.col("size") - F.coalesce("took", F.lit(0))).alias("size"))
        for new in opened:
            remaining = remaining.unionByName(new.select(F.col("id").alias("sequence_id"), (capacity - F.col("size")).alias("size")))
        gaps, gaps_path = save(remaining.filter("size > 0"), "gaps")
        left, left_path = save(rest.select("id", "size"), "left")
        # What the round has placed is one small table, so that the result reads one for each round, whatever it took to get there.
        every = settled[0]
        for more in settled[1:]:
            every = every.unionByName(more)
        done.append(save(every.coalesce(max(1, -(-waiting // part))), "settled")[0])
        discard(spark, *cleared)
        waiting = left.count()
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


PIECES = "doc_id long, piece int, start long, length long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity`` where they are longer; ids as little-endian u32.

    Null or empty text gives one piece that holds the end id; repeated rows give repeated pieces; columns besides doc_id and text are ignored.
    """
    bounded_batches(docs.sparkSession)

    def cut(batches):
        words = encoder(tokenizer)
        for block in blocks(batches, limit=TOKEN_BLOCK):
            ids, bounds = with_end(*words.encode(block.column("text").combine_chunks()), end_id)
            n = np.diff(bounds)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            # Pieces follow each other in the ids, so the lengths bound them.
            ends = np.concatenate([[0], np.cumsum(length)]) * 4
            data = pa.py_buffer(ids.astype("<u4").tobytes())
            pieces = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks().cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pieces],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the table of pieces, which has a column ``length``. Pieces of full length need no round."""
    stored, _ = save(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = stored.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    rest = stored.filter(F.col("length") < capacity)
    placed = pack(rest, capacity)
    return whole.unionByName(rest.join(placed, "uid")).drop("uid")


def op2_packed(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Digest of each piece and its place; the ids themselves aren't kept."""
    pieces = token_pieces(docs, tokenizer, end_id, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
