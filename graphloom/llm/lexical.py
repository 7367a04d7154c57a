"""Operator 11, ranked lexical search by sort-based accumulation.

One pass splits every whole text into terms and keeps, for each document, its length and how often it holds terms of the items. From that table
come the counts of the corpus and the weights. Then documents are parted by ranges; a task takes them in blocks, spells each document's matched
terms out as (item, document, impact), sorts the packed keys of item and document by radix, sums equal keys with ``reduceat``, and
keeps the best documents of each item in a heap. The heaps of the tasks are merged in groups of bounded size.

Items are taken in blocks of about ``TERMS`` terms, so what goes to the tasks - the terms of a block, their weights and items - has a fixed bound and
documents are read once a block. Scores are 64-bit integers throughout, but for the logarithm in the weights.

Defined results: a null or empty text has no terms, so such a document is never found and such an item finds nothing; each row of either table
counts for itself, also where ids repeat; of equal scores the smallest doc_id comes first, null ids last; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best_of, blocks, bounded_batches, save

K = 10
#: Terms of the items that are searched together (a longer item stays whole).
TERMS = 100_000
#: (item, document, impact) entries that a task sorts at once, or what one document needs if that is more.
ENTRIES = 1 << 20
#: Bytes of a text that are split at once.
PIECE = 4 << 20
#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII; capitals A-Z become small.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Fixed values of the score: scale of the weights, and of the saturating share of a term's occurrences.
WEIGHT, SHARE, TIMES, PER_LENGTH, LENGTH_PART = 1000, 1_000_000_000, 1000, 8, 75


def term_counts(text: bytes | None) -> Counter:
    """How often each term occurs; long texts are split piece by piece."""
    clean, counted, at = (text or b"").translate(CLEAN), Counter(), 0
    while at < len(clean):
        end = clean.find(b" ", at + PIECE) if at + PIECE < len(clean) else -1
        end = len(clean) if end < 0 else end
        counted.update(clean[at:end].split())
        at = end
    return counted


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((SHARE * tf) // (TIMES * tf + PER_LENGTH * m))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, 16 bits at a time from the lowest (numpy sorts 16-bit values by radix)."""
    order, top = None, int(keys.max()) if len(keys) else 0
    for shift in range(0, max(1, top.bit_length()), 16):
        digit = (keys >> np.uint64(shift)).astype(np.uint16)
        order = np.argsort(digit, kind="stable") if order is None else order[np.argsort(digit[order], kind="stable")]
    return order if order is not None else np.zeros(0, np.int64)


class ItemBlock:
    """Items that are searched together: for each term its number, and by number the items that hold it and how often."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]]):
        self.keys = [key for key, _, _ in items]
        self.numbers = {t: k for k, t in enumerate(sorted({t.encode() for _, terms, _ in items for t in terms}))}
        held = sorted((self.numbers[t.encode()], k, n) for k, (_, terms, counts) in enumerate(items) for t, n in zip(terms, counts))
        self.item = np.array([k for _, k, _ in held], np.int64)
        self.times = np.array([n for _, _, n in held], np.int64)
        self.count = np.bincount([t for t, _, _ in held], minlength=len(self.numbers)).astype(np.int64)
        self.start = np.cumsum(self.count) - self.count


class Accumulator:
    """Sums of impacts by item and document, and the best documents of each item so far."""

    def __init__(self, block: ItemBlock, weights: np.ndarray, k: int):
        self.block, self.weights, self.k = block, weights, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in block.keys]
        self.least = np.ones(len(block.keys), np.int64)

    def add(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents with their ids and length factors; their postings with the place of the document, ascending."""
        needs = np.bincount(doc, self.block.count[term], len(ids)).astype(np.int64)
        upto, at = np.cumsum(needs), 0
        while at < len(ids):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES, "right")))
            lo, hi = np.searchsorted(doc, [at, end])
            self._accumulate(ids[at:end], m[at:end], doc[lo:hi] - at, term[lo:hi], tf[lo:hi])
            at = end

    def _accumulate(self, ids, m, doc, term, tf) -> None:
        held = self.block.count[term]
        impact = np.repeat(impacts(self.weights[term], tf, m[doc]), held)
        entry = np.arange(len(impact)) + np.repeat(self.block.start[term] - (np.cumsum(held) - held), held)
        packed = (self.block.item[entry] * len(ids) + np.repeat(doc, held)).astype(np.uint64)
        order = radix_order(packed)
        if not len(order):
            return
        packed = packed[order]
        cuts = np.flatnonzero(np.diff(packed, prepend=packed[0] ^ np.uint64(1)))
        sums = np.add.reduceat((impact * self.block.times[entry])[order], cuts)
        item, place = np.divmod(packed[cuts].astype(np.int64), len(ids))
        near = sums >= self.least[item]
        for i, p, score in zip(item[near].tolist(), place[near].tolist(), sums[near].tolist()):
            heap, found = self.heaps[i], (score, -ids[p])
            if len(heap) < self.k:
                heapq.heappush(heap, found)
            elif found > heap[0]:
                heapq.heapreplace(heap, found)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]


#: Stands for a null id in the heaps: behind all others.
NO_ID = 1 << 63


def postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id and n (number of terms) of the documents that have a term, with the numbers of the terms asked for and how often each occurs."""

    def run(batches):
        for block in blocks(batches):
            ids, ns, terms, tfs = [], [], [], []
            for i, text in zip(block.column("doc_id").to_pylist(), block.column("text").cast(pa.binary()).to_pylist()):
                counted = term_counts(text)
                if counted:
                    known = counted.keys() & numbers.keys()
                    ids.append(i)
                    ns.append(counted.total())
                    terms.append([numbers[t] for t in known])
                    tfs.append([counted[t] for t in known])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, a key for each row, its distinct terms and how often each occurs."""

    def run(batches):
        for block in blocks(batches):
            counted = [term_counts(t) for t in block.column("text").cast(pa.binary()).to_pylist()]
            terms = pa.array([[t.decode() for t in c] for c in counted], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([block.column("item_id").combine_chunks(), block.column("item").combine_chunks(), terms, pa.array([list(c.values()) for c in counted], pa.list_(pa.int64()))], names=["item_id", "item", "terms", "times"])

    keyed = items.select(F.col("item_id").cast("long").alias("item_id"), F.monotonically_increasing_id().alias("item"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(run, "item_id long, item long, terms array<string>, times array<long>").filter(F.size("terms") > 0)


def search(docs: DataFrame, items: list, k: int) -> DataFrame:
    """item, part, score, doc_id: the k best documents of each task for the collected ``items`` of one block."""
    spark = docs.sparkSession
    block = ItemBlock([(r["item"], r["terms"], r["times"]) for r in items])
    stored, _ = save(postings(docs, block.numbers), "postings")
    size = stored.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, length = size["n"], size["l"] or 1
    df = np.zeros(len(block.numbers), np.int64)
    for r in stored.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # as many rows as the block has terms
        df[r["t"]] = r["count"]
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    factor = 100 - LENGTH_PART + F.expr(f"({LENGTH_PART} * n * {n_docs}) div {length}")

    def run(batches):
        found = Accumulator(block, weights, k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            lists, tf = batch.column("terms"), batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            found.add(ids, batch.column("m").to_numpy(zero_copy_only=False), doc, lists.flatten().to_numpy(zero_copy_only=False), tf)
        part = TaskContext.get().partitionId()
        rows = [(block.keys[i], part, score, None if -less == NO_ID else -less) for i, heap in enumerate(found.heaps) for score, less in heap]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "part", "score", "doc_id"])

    matched = stored.filter(F.size("terms") > 0).select("doc_id", factor.alias("m"), "terms", "tfs")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return matched.repartitionByRange(ranges, "doc_id").mapInArrow(run, "item long, part long, score long, doc_id long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents (``doc_id``, ``text``) with the highest scores above 0 for each row of ``items`` (``item_id``, ``text``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked, _ = save(item_terms(items), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = max(1, -(-total // terms))
    found = None
    for b in range(n_blocks):
        block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b).collect()
        if block:
            part, _ = save(search(docs, block, k), "ranked")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = found.select("item", "part", (-F.col("score")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    best = best_of(placed, ["item"], ["less", "no_id", "doc_id"], k, ranges)
    return best.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", (-F.col("less")).alias("score"))


def op11_ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    return rank(docs, items)
