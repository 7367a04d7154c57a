"""Operator 9, language identification: known words first, then ever shorter character n-grams.

Each language keeps the log frequency of its words. A word that is known in any language counts by these; an
unseen one by the longest of its character n-grams (with word borders) of which any is known, averaged. A text's
language is the one with the largest sum; the score is its posterior probability with equal priors.

Frequencies are smoothed by half a count, so a language that hasn't shown a word (or gram) gives it the same least value, and one that has shown it c times
adds log(2c + 1) to that. Only those additions are stored, so the model grows with what was learned, not with languages times words.

Learning reads a bounded sample of the labelled rows that are not held out: about ``per_language`` documents of each
language, and ``documents`` in all, chosen by a hash of their ids. All words of these and all languages are learned. Prediction reads the text alone.

Defined results: null text or text without a letter is ``und`` with score 0; a tie goes to the language that sorts first; with nothing to learn from
every text is ``und``; rows with a null id are not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, bounded_batches, held_by, held_out

UNKNOWN = "und"
#: Bounds of the fit: documents of each language, and of all.
PER_LANGUAGE, DOCUMENTS = 1000, 20_000
LONGEST_GRAM = 4
#: Unseen words whose scores a worker remembers.
REMEMBERED = 100_000
#: Words, and numbers of texts times languages, that are scored at once.
COUNTED, SCORED = 1 << 16, 1 << 22
WORDS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


class Frequencies:
    """Counts of strings in languages: the least log frequency of each language, and for each string what to add for the languages that have shown it."""

    def __init__(self, strings: pa.Array, language: np.ndarray, n: np.ndarray, languages: int):
        """Rows are sorted by string and language."""
        coded = strings.dictionary_encode()
        self.strings = coded.dictionary
        self.starts = np.searchsorted(coded.indices.to_numpy(zero_copy_only=False), np.arange(len(self.strings) + 1))
        self.language = language
        totals = np.bincount(language, n, languages) + 0.5 * len(self.strings)
        self.least = np.log(0.5 / np.maximum(totals, 0.5))
        self.more = np.log(2.0 * n + 1).astype(np.float32)
        self._slot: dict[str, int] | None = None

    @property
    def slot(self) -> dict[str, int]:
        """Place of each string; made where it is used, so that the driver and the broadcast hold arrays alone."""
        if self._slot is None:
            self._slot = {x: k for k, x in enumerate(self.strings.to_pylist())}
        return self._slot

    def row(self, x: str) -> tuple[np.ndarray, np.ndarray]:
        k = self.slot[x]
        a, b = self.starts[k], self.starts[k + 1]
        return self.language[a:b], self.more[a:b]


def gram_counts(rows: list[tuple[str, str, int]]) -> Counter:
    """Counts by (length, string, language) of words (length 0) and their n-grams."""
    out: Counter = Counter()
    for language, word, n in rows:
        out[0, word, language] += n
        for k in range(1, LONGEST_GRAM + 1):
            for g in grams(word, k):
                out[k, g, language] += n
    return out


class LanguageModel:
    """Fitted from a table of counts: k (0 for words, else the length of grams), x, lang, n."""

    def __init__(self, counts: pa.Table):
        self.name = uuid.uuid4().hex
        counts = counts.sort_by([("k", "ascending"), ("x", "ascending"), ("lang", "ascending")]).combine_chunks()
        self.languages = sorted(counts.column("lang").unique().to_pylist())
        place = pa.array(self.languages, pa.string())
        at = pc.index_in(counts.column("lang"), place).to_numpy().astype(np.int32)
        bounds = np.searchsorted(counts.column("k").to_numpy(), np.arange(LONGEST_GRAM + 2))
        n = counts.column("n").to_numpy()
        strings = counts.column("x")
        self.tables = [Frequencies(strings.slice(a, b - a).combine_chunks(), at[a:b], n[a:b], len(self.languages)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    @classmethod
    def of(cls, rows: list[tuple[str, str, int]]) -> LanguageModel:
        """From (language, word, count) rows."""
        counts = gram_counts(rows)
        keys = list(counts)
        return cls(pa.table({"k": pa.array([k for k, _, _ in keys], pa.int32()), "x": pa.array([x for _, x, _ in keys], pa.string()), "lang": pa.array([m for _, _, m in keys], pa.string()), "n": pa.array([counts[k] for k in keys], pa.int64())}))

    def unseen(self, word: str) -> tuple[int, np.ndarray, np.ndarray]:
        """The table that decides on an unseen word (0: none does), and the languages and additions of its grams there, averaged."""
        for n in range(LONGEST_GRAM, 0, -1):
            table = self.tables[n]
            known = [table.row(g) for g in grams(word, n) if g in table.slot]
            if known:
                return n, np.concatenate([r[0] for r in known]), np.concatenate([r[1] for r in known]) / len(known)
        return 0, np.zeros(0, np.int32), np.zeros(0, np.float32)


class Predictor:
    """A model with the rows of words met so far. Known words and met ones share their slots; ``decides`` is the table of each slot (-1: it doesn't count)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.least = np.stack([*(t.least for t in model.tables), np.zeros(len(model.languages))])
        self._fresh()

    def _fresh(self) -> None:
        table = self.model.tables[0]
        self.slot, self.known = dict(table.slot), len(table.strings)
        self.starts, self.language, self.more = table.starts, table.language, table.more
        self.decides = np.zeros(self.known, np.int64)

    def _learn(self, new: list[str]) -> None:
        found = [self.model.unseen(w) for w in new]
        self.slot.update(zip(new, range(len(self.decides), len(self.decides) + len(new))))
        self.decides = np.concatenate([self.decides, [f[0] or -1 for f in found]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(f[1]) for f in found])])
        self.language = np.concatenate([self.language, *(f[1] for f in found)])
        self.more = np.concatenate([self.more, *(f[2] for f in found)])

    def totals(self, found: list[list[str]]) -> np.ndarray:
        """Log likelihood of each list of words in each language."""
        n, languages = len(found), len(self.model.languages)
        sizes = np.fromiter(map(len, found), np.int64, n)
        slots = np.fromiter((self.slot[w] for words in found for w in words), np.int64, sizes.sum())
        text = np.repeat(np.arange(n), sizes)
        tables = len(self.least)
        used = np.bincount(text * tables + self.decides[slots] % tables, minlength=n * tables).reshape(n, tables)
        lengths = (self.starts[1:] - self.starts[:-1])[slots]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[slots] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        more = np.bincount(np.repeat(text, lengths) * languages + self.language[at], self.more[at], n * languages)
        return used @ self.least + more.reshape(n, languages)

    def total(self, words: list[str]) -> np.ndarray:
        """``totals`` of one list, by parts if it is long."""
        return sum(self.totals([words[k : k + COUNTED]]) for k in range(0, len(words), COUNTED))

    def portions(self, found: dict[int, list[str]]) -> Iterator[list[int]]:
        """Keys of texts that are scored together; a longer text stays alone."""
        most, some, n = max(1, SCORED // len(self.model.languages)), [], 0
        for x, words in found.items():
            if some and (n + len(words) > COUNTED or len(some) == most):
                yield some
                some, n = [], 0
            some.append(x)
            n += len(words)
        if some:
            yield some

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        languages = self.model.languages
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not languages:
            return names, scores
        found = {k: words for k, t in enumerate(texts) if (words := words_of(t))}
        seen = set().union(*found.values()) if found else set()
        if len(self.slot) - self.known > REMEMBERED:
            self._fresh()
        if new := [w for w in seen if w not in self.slot]:
            self._learn(new)
        for some in self.portions(found):
            total = self.totals([found[x] for x in some]) if len(some) > 1 else self.total(found[some[0]])
            best = total.argmax(axis=1)
            odds = np.exp(np.maximum(total - total[np.arange(len(some)), best][:, None], -700)).sum(axis=1)
            for x, b, o in zip(some, best.tolist(), odds.tolist()):
                names[x], scores[x] = languages[b], 1 / o
        return names, scores


def fit(docs: DataFrame, *, per_language: int = PER_LANGUAGE, documents: int = DOCUMENTS) -> LanguageModel:
    """Learn from (doc_id, text, lang) rows that are not held out."""
    bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size"))
    languages = sizes.count()
    if not languages:
        return LanguageModel.of([])
    wanted = min(per_language, documents / languages)
    # The hash decides, so that the sample is the same on every run.
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000))
    # One row a language: few, but labels are data, so the bound is checked.
    chosen = rows.join(F.broadcast(sizes) if languages <= documents else sizes, "lang").filter(share < F.ceil(1_000_000 * F.least(F.lit(1.0), F.lit(wanted) / F.col("size"))))

    def count(batches):
        for block in blocks(batches):
            counts: Counter = Counter()
            for language, text in zip(block.column("lang").to_pylist(), block.column("text").to_pylist()):
                counts.update((language, w) for w in words_of(text))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    def split(batches):
        for batch in batches:
            counts = gram_counts(list(zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")))))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in keys], pa.int32()), pa.array([x for _, x, _ in keys], pa.string()), pa.array([m for _, _, m in keys], pa.string()), pa.array([counts[k] for k in keys], pa.int64())], names=["k", "x", "lang", "n"])

    counted = chosen.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    whole = counted.mapInArrow(split, "k int, x string, lang string, n long").groupBy("k", "x", "lang").agg(F.sum("n").alias("n"))
    return LanguageModel(whole.toArrow())


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (columns of these names are replaced)."""
    bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    # The model's size is bounded by the sample that it was fitted on.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        held = held_by("langid")
        if model.name not in held:
            held.clear()
            held[model.name] = Predictor(model)
        predictor = held[model.name]
        for block in blocks(batches):
            names, scores = predictor.predict(block.column("text").to_pylist())
            yield from block.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64())).combine_chunks().to_batches()

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def op9_language(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    found = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
