"""Operator 10, token-id output: fixed-width bit packing with block offsets.

A *segment* is one self-contained binary image, little-endian throughout::

    magic "GLBP", version u16, width u16, block u32, n_docs u32, n_tokens u64
    block offsets u64[n_blocks + 1]   where each block begins in the payload
    doc ids i64[n_docs]
    doc starts u64[n_docs + 1]        in tokens, from the segment's first token
    payload                           each block: `block` ids of `width` bits, padded to a byte

``width`` is the smallest number of bits that holds the vocabulary. Blocks have a fixed number of tokens, so
a reader finds a document's blocks by division and unpacks only those, with numpy. Segments are stored one to
a row by Spark's Parquet writer, so they can live in any store that Spark writes to.

Defined results: null or empty text is a document of the end id alone; documents with equal ids follow each other in the order of their
texts; an empty table has no segments; other columns are ignored; a null id sorts first and is kept.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, new_path
from .tokens import TOKEN_BLOCK, encoder, with_end

MAGIC = b"GLBP"
HEAD = struct.Struct("<4sHHIIQ")
BLOCK_TOKENS = 4096
SEGMENT_TOKENS = 1 << 20
NULL_ID = -(2**63)

SEGMENTS = "segment_id long, first_doc_id long, last_doc_id long, n_docs long, n_tokens long, image binary"


def width_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits an id, lowest bit first, padded to a whole byte."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, count: int, width: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype(np.uint32)
    at = np.arange(count, dtype=np.int64) * width
    padded = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(count, np.uint64)
    for k in range((width + 14) // 8):
        word |= padded[(at >> 3) + k] << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def build_segment(doc_ids: np.ndarray, bounds: np.ndarray, ids: np.ndarray, width: int, block: int = BLOCK_TOKENS) -> bytes:
    packed = [pack_bits(ids[k : k + block], width) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, packed)]).astype("<u8")
    head = HEAD.pack(MAGIC, 1, width, block, len(doc_ids), len(ids))
    return b"".join([head, offsets.tobytes(), doc_ids.astype("<i8").tobytes(), bounds.astype("<u8").tobytes(), *packed])


class Segment:
    """Reads a segment image; ``tokens(lo, hi)`` unpacks only the blocks that the range touches."""

    def __init__(self, image: bytes):
        self.image = memoryview(image)
        magic, version, self.width, self.block, self.n_docs, self.n_tokens = HEAD.unpack_from(image)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        n_blocks = -(-self.n_tokens // self.block)
        at = HEAD.size
        self.offsets = np.frombuffer(image, "<u8", n_blocks + 1, at)
        at += self.offsets.nbytes
        self.doc_ids = np.frombuffer(image, "<i8", self.n_docs, at)
        at += self.doc_ids.nbytes
        self.starts = np.frombuffer(image, "<u8", self.n_docs + 1, at)
        self.payload = self.image[at + self.starts.nbytes :]

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, -(-hi // self.block)
        parts = [unpack_bits(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], min(self.block, self.n_tokens - b * self.block), self.width) for b in range(first, last)]
        return np.concatenate(parts)[lo - first * self.block : hi - first * self.block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        everything = self.tokens(0, self.n_tokens)
        for k in range(self.n_docs):
            lo, hi = int(self.starts[k]), int(self.starts[k + 1])
            yield int(self.doc_ids[k]), lo, everything[lo:hi]


def segments(docs: DataFrame, tokenizer: str, end_id: int, *, segment_tokens: int = SEGMENT_TOKENS, remembered: int | None = None) -> DataFrame:
    """Segments of all documents in ascending doc_id order: one range shuffle of the texts, then encoding in place."""
    bounded_batches(docs.sparkSession)

    def encode(batches):
        words = encoder(tokenizer) if remembered is None else encoder(tokenizer, remembered)
        width = width_for(words.tokenizer.get_vocab_size(with_added_tokens=True))
        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal held, size, made
            doc_ids = np.concatenate([x[0] for x in held])
            lengths = np.concatenate([np.diff(x[1]) for x in held])
            ids = np.concatenate([x[2] for x in held])
            image = build_segment(doc_ids, np.concatenate([[0], np.cumsum(lengths)]), ids, width)
            row = [[(part << 33) + made], [int(doc_ids[0])], [int(doc_ids[-1])], [len(doc_ids)], [len(ids)], [image]]
            held, size, made = [], 0, made + 1
            kinds = [pa.int64()] * 5 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["segment_id", "first_doc_id", "last_doc_id", "n_docs", "n_tokens", "image"])

        for block in blocks(batches, limit=TOKEN_BLOCK):
            doc_ids = block.column("doc_id").combine_chunks().fill_null(NULL_ID).to_numpy()
            ids, bounds = with_end(*words.encode(block.column("text").combine_chunks()), end_id)
            cut = 0
            while cut < len(doc_ids):
                room = max(1, segment_tokens - size)
                upto = max(cut + 1, int(np.searchsorted(bounds, bounds[cut] + room, "right")) - 1)
                held.append((doc_ids[cut:upto], bounds[cut : upto + 1], ids[bounds[cut] : bounds[upto]]))
                size += int(bounds[upto] - bounds[cut])
                cut = upto
                if size >= segment_tokens or cut < len(doc_ids):
                    yield flush()
        if held:
            yield flush()

    # The hash parts documents that share an id among tasks, unless their texts are equal too.
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, SEGMENTS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, **options) -> None:
    segments(docs, tokenizer, end_id, **options).write.option("compression", "zstd").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, segment_id, start (in its segment), n_tokens, ids (binary, little-endian u32), in any order."""
    return _decoded(spark, path, lambda ids: ids.astype("<u4").tobytes(), "ids binary", pa.binary())


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Like ``read_documents`` with the ids' CRC-32 in place of the ids."""
    return _decoded(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32 long", pa.int64())


def _decoded(spark: SparkSession, path: str, value, field: str, kind: pa.DataType) -> DataFrame:
    name = field.split()[0]

    def decode(batches):
        for batch in batches:
            for segment_id, image in zip(batch.column("segment_id").to_pylist(), batch.column("image")):
                found = [(d, lo, len(ids), value(ids)) for d, lo, ids in Segment(image.as_py()).documents()]
                for k in range(0, len(found), 1024):
                    doc, lo, n, v = zip(*found[k : k + 1024])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([None if x == NULL_ID else x for x in doc], pa.int64()), pa.array([segment_id] * len(doc), pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(v, kind)],
                        names=["doc_id", "segment_id", "start", "n_tokens", name],
                    )

    bounded_batches(spark)
    return spark.read.schema(SEGMENTS).parquet(path).select("segment_id", "image").mapInArrow(decode, f"doc_id long, segment_id long, start long, n_tokens long, {field}")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """Tokens before each segment. Two levels: sums within a writer's task, then over the tasks' totals."""
    sizes = spark.read.schema(SEGMENTS).parquet(path).select("segment_id", "n_tokens").withColumn("task", F.shiftright("segment_id", 33))
    inner = Window.partitionBy("task").orderBy("segment_id").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("task").agg(F.sum("n_tokens").alias("total")).select("task", F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("before"))
    return sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(totals, "task").select("segment_id", (F.col("before") + F.col("inside")).alias("base"))


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Random access: ids (binary) of a few documents, reading only segments and blocks that hold them."""
    wanted = np.array(sorted(set(doc_ids)), np.int64)

    def find(batches):
        for batch in batches:
            for image in batch.column("image"):
                segment = Segment(image.as_py())
                hits = np.flatnonzero(np.isin(segment.doc_ids, wanted))
                got = [segment.tokens(int(segment.starts[k]), int(segment.starts[k + 1])).astype("<u4").tobytes() for k in hits]
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids[hits], pa.int64()), pa.array(got, pa.binary())], names=["doc_id", "ids"])

    near = F.lit(False)
    for d in wanted.tolist():
        near = near | ((F.col("first_doc_id") <= d) & (F.col("last_doc_id") >= d))
    return spark.read.schema(SEGMENTS).parquet(path).filter(near).select("image").mapInArrow(find, "doc_id long, ids binary")


def op10_token_file(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write all documents to a token file in the shared folder, read it back, and give each its place and checksum."""
    path = new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    found, bases = read_checksums(spark, path), segment_starts(spark, path)
    return found.join(bases, "segment_id").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
