"""Operator 12, MinHash near-duplicates by one-permutation hashing.

One hash of each shingle is the permutation: its range is cut into ``BINS`` bins and a bin keeps its smallest hash. An empty bin takes the value of a
bin that its own sequence of random places reaches first (optimal densification), so all bins agree with a chance of the Jaccard similarity, for short
texts too. Bins make 25 bands of five; texts that share a band are candidates: at a similarity of 0.8 a pair is missed with a chance of (1 - 0.8 ** 5) ** 25, 0.00005.

Each bucket of a band is a star: its class that meets most others in all its buckets is joined to the others, so there are fewer pairs than entries. A pair goes on if at least ``AGREE`` of the 125 bins agree
(64 in a hundred, four and a half standard deviations below 0.8), and is a link if the full sets of shingles reach the similarity. Stars alone would lose links between members that are far from the
middle, so what they leave open is settled exactly: buckets whose members are not in one component by then compare members of different components, unless what each has in common with the middle rules the pair out. No pair is capped or sampled.

Documents with equal sets are one class, so copies are indexed once, however many.

Defined results: null, empty and blank texts have an empty set and are linked with nothing: each is its own component and kept, named by its own id; every row returns, repeated ones too (rows that share an id and have the smallest of a
component are all kept); a component is named by its smallest id, and if all are null, by null, where ``kept`` is false; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import blocks, bounded_batches, save
from .simhash import overlap, possible

SHINGLE = 4
#: The least similarity in hundredths.
LEAST = 80
BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
#: Bins that agree in pairs whose sets are compared.
AGREE = 80
#: Rows whose keys are broadcast; more are joined by sorting.
BROADCAST_ROWS = 1_000_000
#: Members of an unsettled bucket that meet the others in one task.
BLOCK = 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_rng = np.random.default_rng(12)
_TURN = _rng.integers(0, 2**64, SHINGLE + 1, np.uint64) | np.uint64(1)
#: For each bin the places that it asks for a value while it is empty.
_PROBES = _rng.integers(0, BINS, (BINS, 1024)).astype(np.int16)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, 12)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(33))) * _TURN[-1]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    n = len(h) - width + 1
    total = np.full(n, np.uint64(width))
    for k in range(width):
        total = mixed(total * _TURN[k] + h[k : k + n])
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin (its lower half), with empty bins filled; ``hashes`` are sorted and not empty."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    held, values = np.zeros(BINS, bool), np.zeros(BINS, np.uint32)
    held[bins[first]] = True
    values[bins[first]] = hashes[first].astype(np.uint32)
    if len(first) < BINS:
        empty = np.flatnonzero(~held)
        hits = held[_PROBES[empty]]
        source = _PROBES[empty, hits.argmax(axis=1)].astype(np.int64)
        full = bins[first]
        # A bin that none of its places helps takes the next one that holds a value.
        source = np.where(hits.any(axis=1), source, full[np.searchsorted(full, empty) % len(full)])
        values[empty] = values[source]
    return values.view(np.int32)


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, t (a hash of the text), n (shingles), c1 and c2 (a digest of the set) and sig (the bins, empty without shingles)."""

    def run(batches):
        for block in blocks(batches):
            known = WordHashes()
            sets = [shingle_set(t, known) for t in block.column("text").cast(pa.binary()).to_pylist()]
            digests = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            columns = [block.column(c).combine_chunks() for c in ("doc_id", "t")]
            columns += [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in digests.T)]
            columns.append(pa.array([signature(s) if len(s) else () for s in sets], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "c1", "c2", "sig"])

    return docs.mapInArrow(run, "doc_id long, t long, n long, c1 long, c2 long, sig array<int>")


def spelled(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """rep and set (hashes of the shingles) of the classes ``asked`` (rep, doc_id, t), from one text of each."""
    keys = asked.select("rep", F.col("doc_id").alias("d"), F.col("t").alias("u"))
    # The keys grow with the input: they are broadcast up to a bound, and sorted beyond it.
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys.hint("merge")
    found = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("u"))).select("rep", "text")

    def run(batches):
        for block in blocks(batches):
            known = WordHashes()
            sets = [shingle_set(t, known).view(np.int64) for t in block.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("rep").combine_chunks(), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "set"])

    sets, _ = save(found.mapInArrow(run, "rep long, set array<long>"), "sets")
    if sets.count() > sets.select("rep").distinct().count():  # rows that repeat both id and text
        sets, _ = save(sets.dropDuplicates(["rep"]), "sets")
    return sets


def measured(pairs: DataFrame, of: DataFrame, column: str, value) -> DataFrame:
    """``pairs`` (a, b, ...) with ``value`` of the two classes' ``column``s x and y in ``of``."""
    left, right = of.select(F.col("rep").alias("a"), F.col(column).alias("x")), of.select(F.col("rep").alias("b"), F.col(column).alias("y"))
    return pairs.join(right, "b").join(left, "a").select(*pairs.columns, value.alias("measure"))


def agreement(x: str | Column, y: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda total, same: total + same)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    both, sizes = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    # both / (sizes - both) >= LEAST / 100
    return measured(pairs.select("a", "b"), sets, "set", (100 + LEAST) * both >= LEAST * sizes).filter("measure").select("a", "b")


def part_of(links: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` with the component of each ``rep`` as ``part``."""
    known = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    return members.join(known, "rep", "left").withColumn("part", F.coalesce("part", "rep"))


def missing(rows: DataFrame, classes: DataFrame, asked: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets`` and those of the classes in ``asked`` (rep) that it lacks."""
    return sets.union(spelled(rows, classes.join(asked.join(sets.select("rep"), "rep", "left_anti"), "rep")))


def unsettled(posted: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (h, rep, centre, part, blocks) of the buckets that hold more than one component, without the centres; ``blocks``: into how many a bucket is cut."""
    placed = posted.join(parts, "rep")
    counted = placed.groupBy("h").agg(F.count("*").alias("size"), F.min("part").alias("p"), F.max("part").alias("q")).filter("p < q").select("h", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    return save(placed.join(counted, "h").filter("rep <> centre").select("h", "rep", "centre", "part", "blocks"), "unsettled")[0]


def open_pairs(members: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket, may reach the similarity by what is known of each and the bucket's centre, and agree in enough bins.

    Each member is compared with its centre once; bits of what it lacks of the centre and has besides rule out pairs without comparing them, so members that share little but the centre's words make no pairs.
    A large bucket is cut into blocks, each of which meets all its members.
    """
    pivots = members.select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    known, _ = save(overlap(pivots, sets, sketched=True).withColumnsRenamed({"a": "centre", "b": "rep"}), "sketched")
    wide = members.join(known, ["centre", "rep"]).join(signed, "rep")
    x = wide.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).alias("x")
    y = wide.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("y")
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.block") == F.col("y.block"))
    apart = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.part") != F.col("y.part"))
    # One expression, as Spark would put a filter after the join before the join's own condition: bins are compared only where the cheap bound leaves a pair.
    fits = F.when(possible("x", "y"), agreement("x.sig", "y.sig") >= AGREE).otherwise(False)
    return x.join(y, same & apart & fits).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of ``docs`` (``doc_id``, ``text``)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    printed, _ = save(prints(rows.select("doc_id", "t", "text")), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    grouped = printed.filter("n > 0").groupBy("c1", "c2").agg(first, F.any_value("sig").alias("sig"))
    classes, _ = save(grouped.select("c1", "c2", F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"), "sig", F.monotonically_increasing_id().alias("rep")), "classes")
    signed = classes.select("rep", "sig")

    bands = F.array(*[F.xxhash64(F.lit(b), *[F.element_at("sig", b * ROWS + r + 1) for r in range(ROWS)]) for b in range(BANDS)])
    every = signed.select("rep", F.explode(bands).alias("h"))
    sizes = every.groupBy("h").agg(F.count("*").alias("size")).filter("size > 1")
    sized, _ = save(every.join(sizes, "h"), "sized")
    # The class that meets most others, in all its buckets, is the likeliest to be like them.
    meets = sized.groupBy("rep").agg(F.sum("size").alias("meets"))
    placed, _ = save(sized.join(meets, "rep").select("h", "rep", "meets"), "placed")
    centres = placed.groupBy("h").agg(F.min_by("rep", F.struct(-F.col("meets"), "rep")).alias("centre"))
    posted, _ = save(placed.join(centres, "h"), "posted")
    stars = posted.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    edges, _ = save(measured(stars, signed, "sig", agreement("x", "y")).filter(F.col("measure") >= AGREE), "edges")

    asked = edges.select(F.col("a").alias("rep")).union(edges.select("b")).distinct()
    sets = spelled(rows, classes.join(asked, "rep"))
    # First the most alike star of each class: most others lie within one component then and need no comparison.
    best = edges.groupBy("b").agg(F.min_by("a", F.struct(-F.col("measure"), "a")).alias("a")).select("a", "b")
    links, _ = save(confirmed(best, sets), "links")
    parts, _ = save(part_of(links, posted.select("rep").distinct()), "parts")

    ends = edges.select("a", "b").join(best, ["a", "b"], "left_anti").join(parts.select(F.col("rep").alias("a"), F.col("part").alias("pa")), "a").join(parts.select(F.col("rep").alias("b"), F.col("part").alias("pb")), "b")
    members = unsettled(posted, parts)
    sets = missing(rows, classes, members.select("rep").union(members.select("centre")).distinct(), sets)
    asked = open_pairs(members, signed, sets).join(edges.select("a", "b"), ["a", "b"], "left_anti")
    rest, _ = save(ends.filter("pa <> pb").select("a", "b").union(asked).distinct(), "rest")
    every_link, _ = save(links.union(confirmed(rest, sets)), "links")

    named = part_of(every_link, classes.select("c1", "c2", "rep"))
    roots, _ = save(printed.filter("n > 0").join(named, ["c1", "c2"]).groupBy("part").agg(F.min("doc_id").alias("component_id")).join(named, "part").select("c1", "c2", "component_id"), "roots")
    # An empty set has no class: its row is a component of its own.
    found = printed.select("doc_id", "n", "c1", "c2").join(roots, ["c1", "c2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def op12_minhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)
