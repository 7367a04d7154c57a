"""Operator 1, byte-level BPE without replaying merges.

For every prefix of a word one token is known to end its encoding: the longest of the tokens that are a suffix of the
prefix and *fit* what ends the encoding before it. An automaton over the vocabulary gives the longest token
that ends at each byte, and a link from each token to the next shorter one that is a suffix of it. Two tokens fit
if merging their joined bytes would give back just these two. The last token of each prefix is stored; following
them back from the end gives the ids.

All distinct words of a block go through this together, one byte position at a time, in numpy.

Defined results: null is treated as empty; an empty text has no ids; the special token's text stands for its id, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, bounded_batches, held_by

#: Fixed value: the public pattern that parts a text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = np.int64(1) << 40
#: Distinct words a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Words encoded together.
TOGETHER = 40_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class PrefixBPE:
    """Encodes and decodes with a vocabulary file of the ``tokenizers`` format (byte-level BPE)."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for text, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        # rank -1: a single byte. left, right: what a token was merged from.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        pairs = np.zeros((len(spec["model"]["merges"]), 2), np.int64)
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = vocab[a + b]
            pairs[r] = vocab[a], vocab[b]
            self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
        keys = pairs[:, 0] * size + pairs[:, 1]
        self.pair_order = np.argsort(keys)
        self.pair_keys = keys[self.pair_order]
        self.size = size
        self._automaton(sorted(vocab.values()))
        # Answers of fits(), by a hash of the pair.
        self.asked = np.full(1 << 20, -1, np.int64)
        self.answer = np.zeros(1 << 20, bool)
        self.pattern = regex.compile(PATTERN)
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.remembered = remembered
        self.known: dict[str, bytes] = {}

    def _automaton(self, ids: list[int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for i in ids:
            at = 0
            for b in self.bytes[i]:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                at = children[at][b]
            ends[at] = i
        n = len(children)
        self.next = np.zeros((n, 256), np.int32)
        longest = np.full(n, -1, np.int64)
        fail = np.zeros(n, np.int64)
        level = [0]
        while level:
            deeper = []
            for s in level:
                back = fail[s]
                if s:
                    self.next[s] = self.next[back]
                longest[s] = ends.get(s, longest[back])
                for b, child in children[s].items():
                    fail[child] = self.next[back][b] if s else 0
                    deeper.append(child)
                for b, child in children[s].items():
                    self.next[s, b] = child
            level = deeper
        self.longest = longest.astype(np.int32)
        self.shorter = np.full(self.size, -1, np.int64)
        for s, i in ends.items():
            if s and fail[s]:
                self.shorter[i] = longest[fail[s]]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_order[at], NEVER)

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the merges next to the border from the latest to the first; a merge across it that would come before the one just undone shows that the pair doesn't last."""
        out = np.ones(len(a), bool)
        who, before = np.arange(len(a)), np.full(len(a), NEVER)
        while len(who):
            crossed = self._pair_rank(a, b) < before
            out[who[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            going = ~crossed & ((ra >= 0) | (rb >= 0))
            who, a, b, ra, rb = who[going], a[going], b[going], ra[going], rb[going]
            # Equal merges go from left to right, so at a tie the right one is undone first, and a tie across the border counts as earlier.
            on_left = ra > rb
            before = np.where(on_left, ra, rb + 1)
            a, b = np.where(on_left, self.right[a], a), np.where(on_left, b, self.left[b])
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        slot = (key * 0x9E3779B1 >> 8) & (len(self.asked) - 1)
        out = self.answer[slot]
        new = np.flatnonzero(self.asked[slot] != key)
        if len(new):
            fresh, where = np.unique(key[new], return_inverse=True)
            got = self._fits(fresh // self.size, fresh % self.size)
            out[new] = got[where]
            at = (fresh * 0x9E3779B1 >> 8) & (len(self.asked) - 1)
            # Two keys may share a slot: write the key and the answer of the same one.
            at, first = np.unique(at, return_index=True)
            self.asked[at], self.answer[at] = fresh[first], got[first]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (no empty ones), as little-endian u32."""
        order = sorted(range(len(words)), key=lambda k: -len(words[k]))
        lengths = np.array([len(words[k]) for k in order], np.int64)
        data = np.frombuffer(b"".join(words[k] for k in order), np.uint8)
        start = np.cumsum(lengths) - lengths
        state = np.zeros(len(words), np.int32)
        last = np.zeros(len(data), np.int32)
        count = np.zeros(len(data), np.int32)
        active = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
        for i, n in enumerate(active.tolist()):
            state[:n] = self.next[state[:n], data[start[:n] + i]]
            todo, token = np.arange(n), self.longest[state[:n]].astype(np.int64)
            while len(todo):
                begin = i + 1 - self.lengths[token]
                whole = begin == 0
                before = start[todo] + begin - 1
                good = whole.copy()
                inner = np.flatnonzero(~whole)
                good[inner] = self.fits(last[before[inner]].astype(np.int64), token[inner])
                at = start[todo[good]] + i
                last[at] = token[good]
                count[at] = np.where(whole[good], 1, count[np.where(whole, 0, before)[good]] + 1)
                todo, token = todo[~good], self.shorter[token[~good]]
        ends = start + lengths - 1
        totals = count[ends].astype(np.int64)
        into = np.cumsum(totals)
        out = np.zeros(into[-1] if len(into) else 0, "<u4")
        at, put, left = ends.copy(), into - 1, totals.copy()
        while len(at):
            token = last[at]
            out[put] = token
            left -= 1
            more = left > 0
            at, put, left = (at - self.lengths[token])[more], (put - 1)[more], left[more]
        flat, bounds = out.tobytes(), [0, *(into * 4).tolist()]
        result: list[bytes] = [b""] * len(words)
        for k, lo, hi in zip(order, bounds, bounds[1:]):
            result[k] = flat[lo:hi]
        return result

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian u32."""
        parts: list[list] = []
        for text in texts:
            found: list = []
            pieces = self.marks.split(text) if self.marks and any(m in text for m in self.special) else [text]
            for piece in pieces:
                if piece in self.special:
                    found.append(piece)
                else:
                    found += self.pattern.findall(piece)
            parts.append(found)
        fixed = {text: i.to_bytes(4, "little") for text, i in self.special.items()}
        seen: set[str] = set().union(*parts)
        if len(self.known) + len(seen) > self.remembered:
            self.known = {}
        missing = [w for w in seen if w not in self.known and w not in fixed]
        for k in range(0, len(missing), TOGETHER):
            some = missing[k : k + TOGETHER]
            self.known.update(zip(some, self.encode_words([w.encode() for w in some])))
        self.known.update(fixed)
        get = self.known.__getitem__
        return [b"".join(map(get, found)) for found in parts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def coder(path: str) -> PrefixBPE:
    held = held_by("bpe")
    if path not in held:
        held[path] = PrefixBPE(path)
    return held[path]


def bpe_encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (binary, little-endian u32) of every text."""
    return _mapped(docs, vocabulary, "doc_id long, ids binary", lambda c, texts, ids: [pa.array(ids, pa.binary())])


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    bounded_batches(encoded.sparkSession)

    def decode(batches):
        c = coder(vocabulary)
        for block in blocks(batches, "ids"):
            texts = [None if x is None else c.decode(x) for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them."""

    def digests(c: PrefixBPE, texts: list[str], ids: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
        ]

    return _mapped(docs, vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, vocabulary: str, schema: str, columns) -> DataFrame:
    bounded_batches(docs.sparkSession)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        c = coder(vocabulary)
        for block in blocks(batches):
            texts = [x or "" for x in block.column("text").to_pylist()]
            out = columns(c, texts, c.encode(texts))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), *out], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
