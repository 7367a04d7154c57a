"""Whole-text encoding with the ``tokenizers`` library, through a bounded table of words already seen.

The vocabularies used here drop white space before they merge and never merge across it, so the ids of
a text are the ids of its space-separated chunks in order. Each distinct chunk of a block is encoded once.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held_by

#: Distinct chunks a worker remembers before it starts afresh (about 150 bytes each).
REMEMBERED = 1_000_000
#: Bytes of text encoded together: more of them repeat their words.
TOKEN_BLOCK = 8 << 20


class ChunkEncoder:
    """Texts to ids; ``tokenizers`` encodes each chunk that isn't remembered."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _learn(self, words: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        ids = [x.ids for x in found]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self.slot), int(lengths.sum())
        while n + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        ends = self.used + np.cumsum(lengths)
        self.start[n : n + len(words)] = ends - lengths
        self.length[n : n + len(words)] = lengths
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.used += total
        self.slot.update(zip(words, range(n, n + len(words))))

    def _slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > self.remembered:
            self._forget()
        get = self.slot.get
        slots = [get(w, -1) for w in words]
        missing = [w for w, s in zip(words, slots) if s < 0]
        for at in range(0, len(missing), 20_000):
            self._learn(missing[at : at + 20_000])
        if missing:
            slots = [get(w) for w in words]
        return np.array(slots, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's offsets into them; null counts as empty."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        if isinstance(chunks, pa.ChunkedArray):
            chunks = chunks.combine_chunks()
        words = chunks.flatten()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        bounds = chunks.offsets.to_numpy() - chunks.offsets[0].as_py() if len(chunks) else np.zeros(1, np.int64)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        slots = self._slots(coded.dictionary.to_pylist())[codes]
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.start[slots] - (ends - lengths), lengths) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[bounds]


def encoder(path: str, remembered: int = REMEMBERED) -> ChunkEncoder:
    """One encoder for each vocabulary in a Python worker."""
    held = held_by("tokens")
    if (path, remembered) not in held:
        held[path, remembered] = ChunkEncoder(path, remembered)
    return held[path, remembered]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end`` to each text's ids."""
    bounds = offsets + np.arange(len(offsets))
    out = np.empty(bounds[-1], np.uint32)
    last = np.zeros(len(out), bool)
    last[bounds[1:] - 1] = True
    out[last] = end
    out[~last] = ids
    return out, bounds
