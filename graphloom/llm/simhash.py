"""Operator 5, SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints alone are indexed; copies follow their class. The top of the index are masked bit patterns: the
64 bits are parted into six blocks, and fingerprints that differ in at most four bits agree in two blocks at least, so
each is filed under the 15 patterns of two blocks. Under a pattern, fingerprints stand in Gray order, where
neighbours share most bits; each 16 of them form a node that keeps the bits they all share, each 16 nodes a higher one. A search
goes down pairs of nodes and adds up the differences in bits that both share; a pair beyond the limit is
dropped with all below it. A pattern with too many members is parted again by the bits it leaves open, in the same way, until no
group is too large: nothing is cut off.

Defined results: null or empty text has fingerprint zero and is linked like any other; every row returns, repeated rows and rows with a null id too; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import blocks, bounded_batches, held_by, save

SHINGLE = 4
MAX_BITS = 4
#: Members of a group that a task searches at once; larger groups are parted again.
GROUP = 8192
FANOUT = 16
SMALL = 24
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    """SimHash of the text's word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for block in blocks(batches):
            got = np.array([fingerprint(t, shingle) for t in block.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def submasks(fixed: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks that add to ``fixed`` two of ``max_bits + 2`` blocks of the open bits: within ``max_bits`` differences, one of them agrees."""
    open_bits = [b for b in range(64) if not fixed >> b & 1]
    n = max_bits + 2
    parts = [open_bits[k * len(open_bits) // n : (k + 1) * len(open_bits) // n] for k in range(n)]
    return [fixed | sum(1 << b for k in pair for b in parts[k]) for pair in combinations(range(n), 2)]


def parts_further(mask: int, max_bits: int = MAX_BITS) -> bool:
    """Whether each block of open bits has a bit left to fix; otherwise a group has at most 2 ** (max_bits + 1) distinct members."""
    return 64 - (mask % (1 << 64)).bit_count() >= max_bits + 2


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(column):
    """Place of a code in Gray order, as a long that sorts rightly though it is signed."""
    for k in (1, 2, 4, 8, 16, 32):
        column = column.bitwiseXOR(F.shiftrightunsigned(column, k))
    return column.bitwiseXOR(F.lit(-(1 << 63)))


class Labels:
    """Smallest member of each component found so far, among n positions."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            la, lb = self.of[a], self.of[b]
            differ = la != lb
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            if not len(a):
                return
            np.minimum.at(self.of, np.maximum(la, lb), np.minimum(la, lb))
            while True:  # every label points at a root
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


def search_group(codes: np.ndarray, max_bits: int) -> np.ndarray:
    """Component labels of codes in Gray order, linked at ``max_bits`` or fewer differing bits."""
    n = len(codes)
    labels = Labels(n)
    levels = [(codes, np.full(n, ~np.uint64(0)))]
    while len(levels[-1][0]) > FANOUT:
        base, same = levels[-1]
        cuts = np.arange(0, len(base), FANOUT)
        first = base[cuts]
        differ = np.bitwise_or.reduceat(base ^ np.repeat(first, np.diff([*cuts, len(base)])), cuts)
        levels.append((first, np.bitwise_and.reduceat(same, cuts) & ~differ))
    top = len(levels[-1][0])
    i, j = np.triu_indices(top)
    spent, counted = np.zeros(len(i), np.int64), np.zeros(len(i), np.uint64)

    def pruned(level: int, i, j, spent, counted):
        base, same = levels[level]
        shared = same[i] & same[j]
        spent = spent + np.bitwise_count((base[i] ^ base[j]) & shared & ~counted)
        keep = spent <= max_bits
        return i[keep], j[keep], spent[keep], shared[keep]

    def below(level: int, i, j, spent, counted):
        """All pairs of children of each pair, in slices that stay small."""
        size = len(levels[level][0])
        step = np.arange(FANOUT)
        for k in range(0, len(i), 1024):
            a, b = i[k : k + 1024], j[k : k + 1024]
            ci = (a[:, None] * FANOUT + step)[:, :, None] + np.zeros(FANOUT, np.int64)
            cj = (b[:, None] * FANOUT + step)[:, None, :] + np.zeros((FANOUT, 1), np.int64)
            good = (ci < size) & (cj < size) & ((ci < cj) | ((ci == cj) & (level > 0)))
            row = np.broadcast_to(np.arange(len(a))[:, None, None], good.shape)[good]
            yield ci[good], cj[good], spent[k : k + 1024][row], counted[k : k + 1024][row]

    def descend(level: int, i, j, spent, counted):
        i, j, spent, counted = pruned(level, i, j, spent, counted)
        if level == 0:
            real = i < j
            labels.join(i[real], j[real])
            return
        if level == 1:  # leaves whose members are all in one component have nothing to add
            leaf = np.arange(0, n, FANOUT)
            low, high = np.minimum.reduceat(labels.of, leaf), np.maximum.reduceat(labels.of, leaf)
            open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
            i, j, spent, counted = i[open_], j[open_], spent[open_], counted[open_]
        for part in below(level - 1, i, j, spent, counted):
            descend(level - 1, *part)

    descend(len(levels) - 1, i, j, spent, counted)
    return labels.of


def search_runs(codes: np.ndarray, starts: np.ndarray, max_bits: int) -> np.ndarray:
    """Labels (positions) of all codes; a run of equal keys begins at each of ``starts``."""
    sizes = np.diff([*starts, len(codes)])
    labels = Labels(len(codes))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = sizes <= SMALL
    if small.any():
        for d in range(1, int(sizes[small].max())):
            a = np.flatnonzero(run[:-d] == run[d:]) if d < len(codes) else np.zeros(0, np.int64)
            a = a[small[run[a]]]
            near = a[np.bitwise_count(codes[a] ^ codes[a + d]) <= max_bits]
            labels.join(near, near + d)
    for k in np.flatnonzero(~small):
        lo, hi = starts[k], starts[k] + sizes[k]
        found = search_group(codes[lo:hi], max_bits)
        labels.join(np.arange(lo, hi), lo + found)
    return labels.of


def _search(group: int, max_bits: int):
    """Rows sorted by (mask, value, Gray rank) to links (kind 0: two class ids) and members of groups that are too large (kind 1: fp, class id, mask)."""
    names = ["mask", "value", "fp", "rep"]

    def run(batches):
        held: list[np.ndarray] | None = None
        too_large = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in names]
            if too_large is not None:  # more members of a group that is being passed on
                more = (new[0] == too_large[0]) & (new[1] == too_large[1])
                n = len(more) if more.all() else int(np.argmin(more))
                if n:
                    yield out(1, *[x[:n] for x in (new[2], new[3], new[0])])
                    new = [x[n:] for x in new]
                if not len(new[0]):
                    continue
                too_large = None
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            change = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1
            last = int(change[-1]) if len(change) else 0
            yield from finished([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > group and parts_further(int(held[0][0]), max_bits):
                too_large = (held[0][0], held[1][0])
                yield out(1, held[2], held[3], held[0])
                held = None
        if held is not None:
            yield from finished(held)

    def out(kind: int, *columns):
        full = [*columns, *[np.zeros(len(columns[0]), np.int64)] * (3 - len(columns))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(full[0]), kind, np.int32)), *map(pa.array, full)], names=["kind", "a", "b", "mask"])

    def finished(rows):
        if len(rows[0]) < 2:
            return
        starts = np.concatenate([[0], np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])) + 1])
        of = search_runs(np.ascontiguousarray(rows[2]).view(np.uint64), starts, max_bits)
        linked = np.flatnonzero(of != np.arange(len(of)))
        if len(linked):
            yield out(0, rows[3][linked], rows[3][of[linked]])

    return run


def hamming_links(classes: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """Links (a, b) between class ids that join all fingerprints within ``max_bits`` of each other into components.

    ``classes``: distinct ``fp`` and its ``rep``; rows with equal ``fp`` are linked to one of them first, so only distinct ones are parted.
    In each group a member is linked to one other of its component, so there are no more links than rows.
    """
    spark = classes.sparkSession
    bounded_batches(spark)
    first = classes.groupBy("fp").agg(F.min("rep").alias("first"))
    todo = first.select("fp", F.col("first").alias("rep"), F.lit(0).cast("long").alias("mask"))
    masks, links = [0], [classes.join(first, "fp").filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))]
    while masks:
        # At most 15 masks to the power of the depth, and the depth is bounded by the 64 bits.
        finer = spark.createDataFrame([(signed(m), signed(s)) for m in masks for s in dict.fromkeys(submasks(m, max_bits))], "mask long, finer long")
        rows = todo.join(F.broadcast(finer), "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"), "fp", "rep")
        ordered = rows.withColumn("gray", gray_rank(F.col("fp"))).repartition("mask", "value").sortWithinPartitions("mask", "value", "gray").drop("gray")
        found, _ = save(ordered.mapInArrow(_search(group, max_bits), "kind int, a long, b long, mask long"), "links")
        links.append(found.filter("kind = 0").select("a", "b"))
        todo = found.filter("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("rep"), "mask")
        masks = [r["mask"] % (1 << 64) for r in todo.select("mask").distinct().collect()]
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links lead to; null if all are null)."""
    prints, _ = save(fingerprints(docs, shingle), "prints")
    # Classes are named by their fingerprint, which is never null.
    classes, _ = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = connected_components(hamming_links(classes.select("fp", F.col("fp").alias("rep")), max_bits, group))
    named = classes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # classes holds each fingerprint once; joins to it can only be uneven on the documents' side, which Spark can split.
    roots = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(roots, "fp").select("doc_id", "fp", "component_id")


#: The similarity stage: words of a shingle, and the least Jaccard similarity of two documents' shingles as a fraction.
WIDE_SHINGLE, LEAST = 5, (4, 5)
#: Documents also meet if all smallest hashes of a band agree. At a similarity of s a pair is missed with a chance of (1 - s ** rows) ** bands: 0.0002 at 0.8.
BAND_ROWS, BANDS = 4, 16
#: Members of a bucket that the others are compared with before the exact step.
PIVOTS = 4
#: 64-bit words of the sketches of what a member lacks of, and has besides, its bucket's pivot.
SKETCH = 4
_rng = np.random.default_rng(42)
_TURN = _rng.integers(0, 2**64, BAND_ROWS * BANDS, np.uint64)
_TIMES = _rng.integers(0, 2**64, BAND_ROWS * BANDS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(WIDE_SHINGLE, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A hash of each band of smallest hashes; a document without shingles has none."""
    if not len(hashes):
        return []
    least = np.full(BAND_ROWS * BANDS, ~np.uint64(0))
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[k : k + 1024, None] ^ _TURN) * _TIMES).min(axis=0))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [signed(xxhash.xxh64_intdigest(rows[k].tobytes(), k)) for k in range(BANDS)]


def sketch(values: Column, word: int) -> Column:
    """64 of the bits of ``values``' sketch: each value sets one bit of all."""
    return F.aggregate(F.filter(values, lambda v: F.pmod(F.shiftright(v, 6), F.lit(SKETCH)) == word), F.lit(0).cast("long"), lambda acc, v: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(F.lit(63)).cast("int"))))


def overlap(pairs: DataFrame, sets: DataFrame, sketched: bool = False) -> DataFrame:
    """``pairs`` (a, b) with their numbers of shingles na and nb, and how many are in ``both``; with sketches of what b lacks of a and has besides."""
    full = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b")
    measured = full.withColumns({"na": F.size("x"), "nb": F.size("y"), "both": F.size(F.array_intersect("x", "y"))})
    if not sketched:
        return measured.select("a", "b", "na", "nb", "both")
    measured = measured.withColumns({"lacks": F.array_except("x", "y"), "besides": F.array_except("y", "x")})
    return measured.select("a", "b", "na", "nb", "both", *[sketch(F.col(c), w).alias(f"{c}{w}") for c in ("lacks", "besides") for w in range(SKETCH)])


def alike(both="both", na="na", nb="nb") -> Column:
    """Whether ``both`` of na and nb shingles in common reach the similarity."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return (LEAST[0] + LEAST[1]) * of(both) >= LEAST[0] * (of(na) + of(nb))


def possible(x: str, y: str) -> Column:
    """Whether two members of a bucket may be alike, by what is known of each and the pivot: no pair that is alike is ruled out.

    They have in common: what neither lacks of the pivot, and what both have besides. Distinct bits of a sketch are distinct shingles, so the bits
    of both sketches bound from below what at least one lacks, and bits in one sketch alone what one has and the other has not.
    """
    bits = lambda columns: sum((F.bit_count(c) for c in columns), F.lit(0))
    word = lambda side, c, w: F.col(f"{side}.{c}{w}")
    lacking = bits([word(x, "lacks", w).bitwiseOR(word(y, "lacks", w)) for w in range(SKETCH)])

    def own(this: str, other: str) -> Column:
        return F.col(f"{this}.nb") - F.col(f"{this}.both") - bits([word(this, "besides", w).bitwiseAND(F.bitwise_not(word(other, "besides", w))) for w in range(SKETCH)])

    most = F.col(f"{x}.na") - lacking + F.least(own(x, y), own(y, x))
    return alike(F.least(most, F.col(f"{x}.nb"), F.col(f"{y}.nb")), F.col(f"{x}.nb"), F.col(f"{y}.nb"))


def grown(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after more ``links`` (a, b): those known so far go in as stars, so that few rounds are left, and none if there is no new link."""
    if links.isEmpty():
        return known
    return save(connected_components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links)), "known")[0]


def similar_components(members: DataFrame, sets: DataFrame, candidates: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """node and component, as comparing all pairs of each bucket and ``candidates`` (a, b) would give; a row that is like no other is left out.

    ``members``: bucket ``h``, ``rep`` and the bucket's ``size``; ``sets``: ``rep`` and its shingles. The members of a bucket are compared with its pivot, the one that
    meets most others in all its buckets; then those outside the bucket's largest component with the next pivots of that component. Pairs
    that are in one component by now need no comparison. The rest is exact: members outside the largest component meet
    all others of the bucket, and a pair is compared unless the sketches rule out that it is alike. So a large group of near copies takes a few comparisons a member.
    What grows with the members is joined by merging: the driver gathers none of it.
    """
    central = members.groupBy("rep").agg(F.sum("size").alias("meets"))
    placed, _ = save(members.join(central.hint("merge"), "rep").select("h", "rep", "meets"), "buckets")
    order = F.struct(-F.col("meets"), "rep")
    pivot = placed.groupBy("h").agg(F.min_by("rep", order).alias("pivot"))
    around, _ = save(placed.join(pivot.hint("merge"), "h"), "around")
    first, _ = save(around.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "first")
    measured, _ = save(overlap(first, sets, sketched=True), "measured")
    near = overlap(candidates.join(first.hint("merge"), ["a", "b"], "left_anti"), sets).filter(alike()).select("a", "b")
    known, _ = save(connected_components(measured.filter(alike()).select("a", "b").unionByName(near)), "known")

    def unsettled() -> DataFrame:
        """Members of buckets with more than one component, and the largest component of the bucket (by members, then the smallest)."""
        parts = around.join(known.select(F.col("node").alias("rep"), F.col("component").alias("part")).hint("merge"), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        counted = parts.groupBy("h", "part").agg(F.count("*").alias("n"))
        largest = counted.groupBy("h").agg(F.count("*").alias("parts"), F.min_by("part", F.struct(-F.col("n"), "part")).alias("main")).filter("parts > 1")
        return save(parts.join(largest.select("h", "main").hint("merge"), "h"), "unsettled")[0]

    rest = unsettled()
    # The next pivots, those of the largest component that meet most others. Each task hands on no more than are asked for.
    place = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("meets"), "rep"))
    chosen = rest.filter("part = main AND rep <> pivot").select("h", F.col("rep").alias("next"), place.alias("place")).filter(F.col("place") < pivots)
    asked = rest.filter("part <> main").join(chosen.hint("merge"), "h").select(F.col("next").alias("a"), F.col("rep").alias("b"))
    asked, _ = save(asked.distinct().join(first.hint("merge"), ["a", "b"], "left_anti"), "asked")
    more, _ = save(overlap(asked, sets).filter(alike()).select("a", "b"), "similar")
    if not more.isEmpty():
        known = grown(known, more)
        rest = unsettled()

    by_pivot = measured.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), *[c for c in measured.columns if c not in "ab"])
    # The pivot itself lacks nothing; pairs with it have been compared.
    sketched, _ = save(rest.filter("rep <> pivot").join(by_pivot.hint("merge"), ["pivot", "rep"]), "sketched")
    some, every = sketched.filter("part <> main").alias("x"), sketched.alias("y")
    apart = (F.col("x.part") != F.col("y.part")) & ((F.col("y.part") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
    pairs = some.join(every, (F.col("x.h") == F.col("y.h")) & apart & possible("x", "y")).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    pairs, _ = save(pairs.distinct(), "asked")
    last, _ = save(overlap(pairs, sets).filter(alike()).select("a", "b"), "similar")
    return grown(known, last)


def similar_rows(rows: DataFrame, pivots: int = PIVOTS, max_bits: int = MAX_BITS) -> DataFrame:
    """key, doc_id and component of stored ``rows`` (unique long ``key``, ``doc_id``, ``text``): the smallest key that links lead to.

    Rows with equal sets of shingles are one class, so copies cost nothing; rows without shingles are a class too. Classes whose SimHashes
    are joined by the Gray-order index are candidates, and so are classes that share a band of smallest hashes: at a similarity of 0.8 SimHashes
    differ in ten of 64 bits on average, which an index for four bits does not reach. Candidates are linked if the Jaccard similarity of their shingles is 0.8 or more.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    schema = "key long, doc_id long, c1 long, c2 long, fp long, bands array<long>"

    def sign(batches):
        held_by("simhash")
        for block in blocks(batches):
            sets = [shingles(t) for t in block.column("text").to_pylist()]
            classes = np.array([list(xxhash.xxh128_digest(s.tobytes())) for s in sets], np.uint8).reshape(-1, 16).view(np.int64)
            columns = [block.column(c).combine_chunks() for c in ("key", "doc_id")]
            columns += [pa.array(np.ascontiguousarray(c)) for c in classes.T]
            columns += [pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "c1", "c2", "fp", "bands"])

    def spell(batches):
        held_by("simhash")
        for block in blocks(batches):
            # The upper halves of hashes tell the shingles of two documents apart.
            sets = [np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in block.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("key").combine_chunks(), pa.array(sets, pa.list_(pa.int32()))], names=["rep", "set"])

    prints, _ = save(rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, schema), "signatures")
    classes, _ = save(prints.groupBy("c1", "c2").agg(F.min("key").alias("rep")), "signature-classes")
    own = prints.join(classes.select(F.col("rep").alias("key")).hint("merge"), "key", "left_semi").filter(F.size("bands") > 0)
    candidates, _ = save(hamming_links(own.select("fp", F.col("key").alias("rep")), max_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    posted = own.select(F.col("key").alias("rep"), F.explode("bands").alias("h"))
    shared = posted.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    members, _ = save(posted.join(shared.hint("merge"), "h"), "members")
    # Only classes that meet another one are spelled out.
    asked = members.select("rep").union(candidates.select("a")).union(candidates.select("b")).distinct().withColumnRenamed("rep", "key")
    # Their keys grow with the input, so they are not broadcast at any size.
    sets, _ = save(rows.select("key", "text").join(asked.hint("merge"), "key", "left_semi").mapInArrow(spell, "rep long, set array<int>"), "shingles")
    joined = similar_components(members, sets, candidates, pivots)
    roots = classes.join(joined.select(F.col("node").alias("rep"), "component").hint("merge"), "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component"))
    return prints.join(roots.hint("merge"), ["c1", "c2"]).select("key", "doc_id", "component")


def similar_documents(docs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """doc_id and component_id (the smallest doc_id) of documents, joined wherever two have a Jaccard similarity of 0.8 or more in five-word shingles.

    Null and empty texts form one component.
    """
    rows, _ = save(docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    found, _ = save(similar_rows(rows, pivots), "similar-rows")
    return found.join(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def op5_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
