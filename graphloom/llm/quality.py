"""Operator 3, quality rules by weak supervision, in DataFrame functions alone.

Each rule votes +1 (good), -1 (bad) or 0 (abstains). Rules are taken to err independently of each other given a
document's true class; expectation-maximisation estimates how often each is right and how common good documents are.
A document is kept if its posterior probability of being good reaches one half, instead of having to pass every rule.
The fit needs only how often each pattern of votes occurs (3 to the number of rules at most, whatever the input).

Defined results: null or empty text has no words and fails; every row returns, repeated ones too; an empty table keeps nothing.
Words in 3-word windows are compared by a 64-bit hash of the three words within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

#: The white space between words, and the characters that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[^#*$%&|<>]+"
ROUNDS, SETTLED = 40, 1e-6
#: An estimated accuracy stays between these, so that a rule is never taken for its opposite or for certain.
LEAST, MOST = 0.55, 0.99


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, though ``use`` refers to it inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """How many words stand in 3-word windows that occur twice or more in the text."""

    def covered(starts: Column) -> Column:
        # Windows overlap: each adds the words up to the next window's start, three at most.
        gaps = F.zip_with(F.slice(starts, 2, F.size(starts) - 1), F.slice(starts, 1, F.size(starts) - 1), lambda b, a: F.least(b - a, F.lit(3)))
        return F.aggregate(gaps, F.lit(3), lambda total, gap: total + gap)

    def twice(ordered: Column) -> Column:
        """Starts of the windows whose neighbour in hash order has the same hash."""
        n = F.size(ordered)

        def same(x: Column, k: Column) -> Column:
            before = F.try_element_at(ordered, k)  # k counts from 0, so this is the one before
            after = F.try_element_at(ordered, k + 2)
            return F.coalesce((k > 0) & (before["h"] == x["h"]), F.lit(False)) | F.coalesce((k + 1 < n) & (after["h"] == x["h"]), F.lit(False))

        starts = F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["i"]))
        return let(starts, lambda s: F.when(F.size(s) == 0, F.lit(0)).otherwise(covered(s)))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("i")))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(let(F.array_sort(windows(w)), twice))).cast("long")


def duplicate_lines(lines: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(lines, lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with what the rules look at."""
    text = F.coalesce("text", F.lit(""))
    words = word_list(text)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.split(text, "\n")).alias("n_dup_lines"),
        (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long").alias("n_exclaim"),
    ).select("doc_id", "w.*", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_upper", "n_exclaim")


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The rules by name: votes from the measures. Shares are compared by cross-multiplying, so nothing divides by zero."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "length": vote(n >= 80, n < 50),
        "word_size": vote((chars >= 3 * n) & (chars <= 10 * n), (chars < 2 * n) | (chars > 14 * n)),
        "symbols": vote(50 * F.col("n_symbols") <= n, 5 * F.col("n_symbols") > n),
        "lines": vote(10 * F.col("n_dup_lines") <= F.col("n_lines"), 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        "repeats": vote(100 * F.col("n_repeat_words") <= 15 * n, 100 * F.col("n_repeat_words") > 40 * n),
        "capitals": vote(5 * F.col("n_upper") <= chars, 2 * F.col("n_upper") > chars),
        "exclaims": vote(20 * F.col("n_exclaim") <= n, 2 * F.col("n_exclaim") > n),
    }


def posterior(names: list[str], accuracy: dict[str, float], prior: float) -> Column:
    """Probability that a document with these votes is good: a vote shifts the odds by its rule's."""
    odds = F.log(F.lit(prior / (1 - prior)))
    for name in names:
        odds = odds + F.col(name) * F.log(F.lit(accuracy[name] / (1 - accuracy[name])))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def fit(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Accuracies and the share of good documents, from the patterns of votes and their counts ``n``."""
    accuracy, prior = dict.fromkeys(names, 0.75), 0.75
    for _ in range(rounds):
        weighed = patterns.withColumn("q", posterior(names, accuracy, prior))
        right = [F.sum(F.when(F.col(r) == 1, F.col("n") * F.col("q")).when(F.col(r) == -1, F.col("n") * (1 - F.col("q")))).alias(r) for r in names]
        given = [F.sum(F.when(F.col(r) != 0, F.col("n"))).alias(f"{r}_given") for r in names]
        got = weighed.agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("q")).alias("good"), *right, *given).first()
        if not got["all"]:
            break
        new = {r: round(min(MOST, max(LEAST, got[r] / got[f"{r}_given"])), 9) if got[f"{r}_given"] else accuracy[r] for r in names}
        share = round(min(0.95, max(0.05, got["good"] / got["all"])), 9)
        moved = max(abs(share - prior), *(abs(new[r] - accuracy[r]) for r in names))
        accuracy, prior = new, share
        if moved < SETTLED:
            break
    return accuracy, prior


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame) -> DataFrame:
    """Measures, base_failed, the posterior ``quality`` and ``kept`` for every document."""
    names = list(rules())
    measured, _ = save(measures(docs).withColumns(rules()), "measures")
    patterns, _ = save(measured.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "votes")
    accuracy, prior = fit(patterns, names)
    judged = measured.withColumn("base_failed", base_failed()).withColumn("quality", posterior(names, accuracy, prior))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def op3_quality(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))
