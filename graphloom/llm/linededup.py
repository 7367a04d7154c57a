"""Operator 4, line dedup by winnowing.

A document is its list of lines. From each line on, the fewest lines that reach ``GRAM`` words form a gram; among the grams
that begin within ``GRAM`` words of each other, the one with the smallest hash is selected as a fingerprint. Two documents that share a run
of lines with ``2 * GRAM`` words or more therefore share a fingerprint in it. Around fingerprints that occur more than once, the shortest
runs of lines that reach ``2 * GRAM`` words are hashed, from every line on and up to every line; a run that stands earlier - in a document with a smaller id, or above in the same one without overlap - is
deleted. Longer repeats are unions of such runs, so the first place of each run decides, whichever copies the repeat is made of.

Joins carry hashes, not texts; first places are minima, which Spark combines before the shuffle, so a line in
a third of all documents costs a row for each task.

Defined results: null text stays null; an empty text has one empty line and stays; blank lines count as lines without words; a document all of whose words are deleted has an
empty text; rows with equal ids are treated alike (none is the other's earlier copy); null ids come last; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, discard, held_by, save
from .quality import let

#: Words of a gram; runs of twice as many are found without fail and deleted.
GRAM = 25


def line_hashes(text: str) -> tuple[list[int], list[int]]:
    """Hash (signed) and number of words of each line."""
    lines = text.encode().split(b"\n")
    hashes = [xxhash.xxh64_intdigest(x, 7) for x in lines]
    return [h - (1 << 64) if h >> 63 else h for h in hashes], [len(x.split()) for x in lines]


def select(hashes: list[int], words: list[int], gram: int = GRAM) -> list[tuple[int, int, int]]:
    """Fingerprints of a document: (hash, first line, lines). Ties go to the rightmost gram."""
    n = len(hashes)
    before = [0]
    for w in words:
        before.append(before[-1] + w)
    grams: list[tuple[int, int, int]] = []
    packed = np.array(hashes, np.int64)
    end = 0
    for i in range(n):
        end = max(end, i)
        while end < n and before[end] - before[i] < gram:
            end += 1
        if before[end] - before[i] < gram:
            break
        if words[i]:  # a gram begins with a line that has words
            key = xxhash.xxh64_intdigest(packed[i:end].tobytes(), 11)
            grams.append((key - (1 << 64) if key >> 63 else key, i, end - i))
    chosen: dict[int, tuple[int, int, int]] = {}
    queue: list[int] = []  # grams of the window, smallest hash first
    right, head = 0, 0
    for k, (_, i, _) in enumerate(grams):
        while right < len(grams) and (right == k or before[grams[right][1]] - before[i] < gram):
            while len(queue) > head and grams[queue[-1]][0] >= grams[right][0]:
                queue.pop()
            queue.append(right)
            right += 1
        while grams[queue[head]][1] < i:
            head += 1
        best = grams[queue[head]]
        chosen[best[1]] = best
    return list(chosen.values())


#: Odd multipliers of the two rolling sums that a run's hash is made of, and their inverses modulo 2 to the power of 64.
_TIMES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_BACK = tuple(pow(m, -1, 1 << 64) for m in _TIMES)


def run_hashes(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of lines from ``first`` to before ``end``, from prefix sums: a run costs the same however long it is."""
    lines, total = hashes.view(np.uint64), None
    for k, (times, back) in enumerate(zip(_TIMES, _BACK)):
        power = np.cumprod(np.full(len(lines), times, np.uint64))
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines * power)])
        inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(len(lines), back, np.uint64))])
        x = (before[end] - before[first]) * inverse[first] + (end - first).astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(times)
        x = (x ^ (x >> np.uint64(29 + k))) * np.uint64(_TIMES[1 - k])
        total = x if total is None else total ^ (x << np.uint64(1) | x >> np.uint64(63))
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def minimal_runs(hashes: np.ndarray, words: np.ndarray, marks: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs that hold one of ``marks`` (first line, lines): hash, first line, lines, and whether an own earlier run equals it.

    A run is the fewest lines from a line on, or up to a line, that reach ``least`` words. Every line of a longer run is in one of the
    runs within it, so a line is part of a repeat exactly if one of its runs is. There are two runs a line at most, so stretches of blank lines take time and space in proportion.
    """
    n = len(hashes)
    before = np.concatenate([[0], np.cumsum(words)])
    ends = np.searchsorted(before, before[:-1] + least)
    starts = np.searchsorted(before, before[1:] - least, side="right") - 1
    on, upto = np.flatnonzero(ends <= n), np.flatnonzero(starts >= 0)
    runs = np.unique(np.concatenate([on * (n + 1) + ends[on], starts[upto] * (n + 1) + upto + 1]))
    first, end = np.divmod(runs, n + 1)
    # The smallest end of a mark that begins at or after each line.
    nearest = np.full(n + 1, n + 1)
    for at, size in marks:
        nearest[at] = min(nearest[at], at + size)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    held = nearest[first] <= end
    first, end = first[held], end[held]
    keys, size = run_hashes(hashes, first, end), end - first
    # Runs are in order of their first line, so the first of equal keys is the earliest.
    _, earliest, which = np.unique(keys, return_index=True, return_inverse=True)
    return keys, first, size, first[earliest[which]] + size <= first


#: What tells documents apart: null ids come last and are equal to each other.
KEY = ["__null", "__id", "__text_hash"]


def document_key(docs: DataFrame) -> DataFrame:
    known = F.col("doc_id").cast("long")
    return docs.withColumn("__null", known.isNull()).withColumn("__id", F.coalesce(known, F.lit(0))).withColumn("__text_hash", F.xxhash64("text"))


def deletions(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """(__null, __id, __text_hash, lines): the line numbers to delete, for documents that have any."""
    spark = docs.sparkSession
    bounded_batches(spark)
    least = 2 * gram
    marked = pa.list_(pa.struct([("g", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))

    def listed(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Array:
        """A list of structs for each row, built from columns."""
        offsets = np.cumsum([0, *(len(r[0]) for r in rows)]).astype(np.int32)
        columns = [np.concatenate([r[c] for r in rows]).astype(np.int64 if names[c] == "h" else np.int32) if rows else np.zeros(0, np.int32) for c in range(len(names))]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, pa.int64() if x == "h" else pa.int32()) for x, c in zip(names, columns)], names=names))

    def hashed(batches):
        held_by("linededup")
        for block in blocks(batches):
            got = [line_hashes(t) for t in block.column("text").to_pylist()]
            marks = pa.array([[{"g": g, "at": i, "n": n} for g, i, n in select(h, w, gram)] for h, w in got], marked)
            columns = [pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int32())), marks]
            yield pa.RecordBatch.from_arrays([*(block.column(c).combine_chunks() for c in KEY), *columns], names=[*KEY, "hashes", "words", "marks"])

    def runs_of(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = zip(batch.column("hashes"), batch.column("words"), batch.column("often").to_pylist())
            got = [minimal_runs(h.values.to_numpy(), w.values.to_numpy().astype(np.int64), [(m["at"], m["n"]) for m in often], least) for h, w, often in rows]
            columns = [listed([r[:3] for r in got], ["h", "at", "n"]), listed([(first[own], size[own]) for _, first, size, own in got], ["at", "n"])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), *columns], names=[*KEY, "runs", "own"])

    def covered(batches):
        for batch in batches:
            lines = []
            for found in batch.column("found"):
                at, n = (found.values.field(c).to_numpy().astype(np.int64) for c in ("at", "n"))
                # Where a run begins one more covers the next lines, and one less where it ends.
                change = np.bincount(at, minlength=int((at + n).max()) + 1) - np.bincount(at + n)
                lines.append(np.flatnonzero(np.cumsum(change) > 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(lines, pa.list_(pa.int32()))], names=[*KEY, "lines"])

    key = "__null boolean, __id long, __text_hash long"
    keyed = document_key(docs.select("doc_id", "text")).filter("text IS NOT NULL").select(*KEY, "text")
    lines, lines_path = save(keyed.mapInArrow(hashed, f"{key}, hashes array<long>, words array<int>, marks array<struct<g:long,at:int,n:int>>"), "lines")
    marks = lines.select(*KEY, F.inline("marks"))
    # Equal runs share a fingerprint, so only runs that hold one that occurs more than once are asked about.
    often = marks.groupBy("g").agg(F.count("*").alias("times")).filter("times > 1").select("g")
    meeting = marks.join(often.hint("merge"), "g").groupBy(*KEY).agg(F.collect_set(F.struct("at", "n")).alias("often"))
    once = lines.select(*KEY, "hashes", "words").join(meeting, KEY).dropDuplicates(KEY)
    runs, _ = save(once.mapInArrow(runs_of, f"{key}, runs array<struct<h:long,at:int,n:int>>, own array<struct<at:int,n:int>>"), "runs")
    discard(spark, lines_path)
    asked = runs.select(*KEY, F.inline("runs"))
    place = F.struct("__null", "__id")
    first = asked.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("h", "first")
    found = asked.join(first, "h").filter(F.col("first") < place).select(*KEY, "at", "n")
    gone = found.union(runs.select(*KEY, F.inline("own"))).distinct()
    return gone.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n")).alias("found")).mapInArrow(covered, f"{key}, lines array<int>")


def dedup_lines(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from ``text``, and ``deleted_lines`` (long)."""
    gone, _ = save(deletions(docs, gram).withColumnRenamed("lines", "__lines"), "deletions")
    keyed = document_key(docs.drop("deleted_lines"))
    # Deletions grow with the input, so they are never broadcast.
    marked = keyed.join(gone.hint("merge"), KEY, "left")
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "__lines")
    rest = let(split, lambda x: F.transform(kept, lambda k: F.element_at(x, k + 1)))
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return marked.withColumn("text", text).withColumn("deleted_lines", F.when(F.col("__lines").isNull(), 0).otherwise(F.size("__lines")).cast("long")).select(*docs.drop("deleted_lines").columns, "deleted_lines")


def op4_line_dedup(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "deleted_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
