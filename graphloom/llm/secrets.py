"""Operator 7, secret scans in DataFrame functions alone.

Fixed patterns give the base spans. A character Markov model adds to them: tokens of 20 or more characters with a digit and a letter are
scored by the log-likelihood ratio of two first-order models, one of random strings and one of ordinary identifiers, over
the number of pairs of characters. A token counts as a secret if that exceeds the threshold and it touches no base span.

Both models are trained on labelled samples: values that the fixed patterns find in a bounded sample of the documents are secrets, and other
tokens of eight or more characters there are ordinary. Strings made by a fixed rule are added to both, so that alphabets that
the documents' secrets happen to lack are known too, and a table without secrets still has a model.

Defined results: null or empty text has no spans; positions are code points, ends exclusive; every row returns, repeated ones too; an empty table gives an empty result.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let

#: The base patterns in the order of their kinds, and the least length of what counts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A run of hex digits is maximal, so asking for 16 of them finds the runs of 16 or more.
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A token that the model looks at: no shorter, with a digit and a letter, not inside a longer one.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least log-likelihood ratio a pair of characters.
THRESHOLD = 0.3
#: Size of the generated part of the labelled sample, for each label.
SAMPLES = 6000
#: Documents that labelled strings are taken from, about.
LEARNED = 4000
#: Words that generated identifiers are put together from.
STEMS = (
    "get set user name order item count total price list page index date time value key map array text line file path size max min first last next "
    "parent child node edge graph table column row field record update delete insert select query result status error message request response "
    "config option default version build test main util helper service client server handler manager factory account customer product part"
)


def default_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled strings (text, secret): hashes in three alphabets, and identifiers in four styles. The rule is fixed, so training is repeatable."""
    i = F.col("id")
    digest = F.sha2(F.concat(F.lit("sample-"), i.cast("string")), 256)
    long = F.concat(digest, F.sha2(digest, 256))
    length = (20 + i % 29).cast("int")
    base64 = F.base64(F.unhex(long))
    random = F.element_at(F.array(base64, F.translate(base64, "+/=", "-_a"), long, F.upper(base64)), (i % 4 + 1).cast("int"))
    secrets = spark.range(n).select(F.substring(random, F.lit(1), length).alias("text"), F.lit(True).alias("secret"))
    stems = F.array(*map(F.lit, STEMS.split()))
    picks = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.element_at(stems, (F.pmod(F.xxhash64(i, k), F.size(stems)) + 1).cast("int")))
    digits = F.when(i % 3 == 0, (i % 2030).cast("string")).otherwise("")
    caps = F.transform(picks, F.initcap)
    styles = F.array(F.concat_ws("_", picks), F.concat_ws("-", picks), F.concat_ws("", caps), F.upper(F.concat_ws("_", picks)), F.concat_ws("/", picks), F.concat_ws("", picks))
    plain = spark.range(n).select(F.concat(F.element_at(styles, (i % 6 + 1).cast("int")), digits).alias("text"), F.lit(False).alias("secret"))
    return secrets.unionByName(plain)


def found_samples(docs: DataFrame, bound: int = LEARNED) -> DataFrame:
    """Labelled strings (text, secret) from about ``bound`` rows, each chosen by a hash of its id (where there is one) and text, so that the layout of partitions decides nothing: what the fixed patterns find, and other tokens."""
    share = min(1.0, bound / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(F.lit("sample"), *[c for c in ("doc_id", "text") if c in docs.columns]), F.lit(1 << 30)) < int(share * (1 << 30))
    some = docs.filter(chosen).filter("text IS NOT NULL").select("text")
    hidden = F.col("text")
    for pattern in (ASSIGN, ACCESS, HEX):
        hidden = F.regexp_replace(hidden, pattern, " ")
    values = F.concat(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)))
    secrets = some.select(F.explode(values).alias("text"), F.lit(True).alias("secret")).filter(F.length("text") >= LEAST["assign"])
    plain = some.select(F.explode(F.regexp_extract_all(hidden, F.lit(r"[A-Za-z0-9+/_=-]{8,}"), F.lit(0))).alias("text"), F.lit(False).alias("secret"))
    return secrets.unionByName(plain)


def neighbours(values: Column, merge) -> Column:
    """What ``merge`` makes of each value and the next."""
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), merge)


def train(samples: DataFrame) -> list[float]:
    """Log ratio of each pair of characters, in the alphabet's order: how much likelier after the first the second is in secrets. Add-one smoothing."""
    letters = F.split("text", "")
    pairs = samples.filter(F.length("text") > 1).select("secret", F.explode(let(letters, lambda x: neighbours(x, lambda a, b: F.concat(a, b)))).alias("p"))
    counted = pairs.groupBy("p").agg(F.count_if("secret").alias("s"), F.count_if(~F.col("secret")).alias("o"))
    got = {r["p"]: (r["s"], r["o"]) for r in counted.filter(F.col("p").rlike("^[A-Za-z0-9+/_=-]{2}$")).collect()}
    n, out = len(ALPHABET), []
    for a in ALPHABET:
        rows = [got.get(a + b, (0, 0)) for b in ALPHABET]
        s, o = sum(r[0] for r in rows), sum(r[1] for r in rows)
        out += [round(log((x + 1) / (s + n)) - log((y + 1) / (o + n)), 3) for x, y in rows]
    return out


def fitted(docs: DataFrame) -> list[float]:
    """The model of these documents."""
    return train(found_samples(docs).unionByName(default_samples(docs.sparkSession)))


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token a pair of its characters."""

    # The token is split once: looking characters up by their place would start from its beginning each time.
    places = F.transform(F.split(token, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
    steps = let(places, lambda p: neighbours(p, lambda a, b: F.element_at(table, (a - 1) * len(ALPHABET) + b)))
    return let(steps, lambda s: F.aggregate(s, F.lit(0.0), lambda total, x: total + x) / F.size(s))


def running(values: Column, merge, chunk: int = 256) -> Column:
    """What merging the values before each one gives (0 for the first). By chunks, as appending to an array would copy it each time."""
    fold = lambda x: F.aggregate(x, F.lit(0), merge)

    def over(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / chunk).cast("int")), lambda c: fold(F.slice(v, c * chunk + 1, F.lit(chunk))))
        before = let(chunks, lambda s: F.transform(s, lambda _, c: fold(F.slice(s, F.lit(1), c))))
        inside = lambda i: fold(F.slice(v, i - i % chunk + 1, i % chunk))
        return let(before, lambda o: F.transform(v, lambda _, i: merge(F.element_at(o, F.floor(i / chunk).cast("int") + 1), inside(i))))

    return let(values, lambda v: F.when(F.size(v) > 0, over(v)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str, tail: int = 0) -> Column:
    """Matches of ``pattern`` as (start, end, tail): what lies between them is split off, so lengths add up to places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tails = F.regexp_extract_all(text, F.lit(pattern), F.lit(tail)) if tail else whole
    # The last of the gaps follows the last match.
    gaps = F.slice(F.transform(F.split(text, pattern), F.length), F.lit(1), F.size(whole))
    sizes = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), tails.alias("tail"))

    def placed(z: Column) -> Column:
        starts = running(F.transform(z, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return F.zip_with(z, starts, lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["tail"].alias("tail")))

    return let(sizes, placed)


def spans_of(text: Column, kind: str, pattern: str, keep, tail: int = 0) -> Column:
    """Spans (start, kind's place, end) of the matches that ``keep`` accepts; texts without a match skip the work."""
    order = KINDS.index(kind)
    found = F.transform(F.filter(located(text, pattern, tail), keep), lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def scan(docs: DataFrame, table: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` with ``base_spans`` and ``added_spans`` (columns of these names are replaced): arrays of (start, kind, end). ``table``: a trained model; by default one is fitted on ``docs``."""
    weights = F.split(F.lit(",".join(map(str, table if table is not None else fitted(docs)))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    base = F.array_sort(
        F.concat(
            spans_of(text, "assign", ASSIGN, lambda m: F.length(m["tail"]) >= LEAST["assign"], tail=2),
            spans_of(text, "access", ACCESS, lambda m: m["end"] - m["start"] >= LEAST["access"]),
            spans_of(text, "hex", HEX, lambda m: F.lit(True)),
        )
    )
    random = spans_of(text, "random", TOKEN, lambda m: ratio(m["tail"], weights) > threshold)
    free = lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = docs.drop("base_spans", "added_spans").withColumn("base_spans", base)
    return found.withColumn("added_spans", F.filter(random, free))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; overlapping spans give one mark. Null texts stay null."""
    found = scan(docs, **options)
    spans = F.array_sort(F.concat("base_spans", "added_spans"))

    def rest(s: Column, letters: Column) -> Column:
        """What stands between the spans, with a mark for each group of spans that overlap or touch no text. The text is split once into its characters, so a span costs its length."""

        def pieces(upto: Column) -> Column:
            between = lambda at, end: F.array_join(F.slice(letters, at + 1, F.greatest(end - at, F.lit(0))), "")
            kept = lambda x, at: F.when(x["start"] >= at, F.concat(between(at, x["start"]), F.lit(mark))).otherwise("")
            last = F.array_max(F.transform(s, lambda x: x["end"]))
            return F.concat(F.array_join(F.zip_with(s, upto, kept), ""), between(last, F.size(letters)))

        return let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), pieces)

    return found.withColumn("text", F.when(F.size("base_spans") + F.size("added_spans") > 0, let(F.split("text", ""), lambda letters: let(spans, lambda s: rest(s, letters)))).otherwise(F.col("text"))).select(*docs.columns)


def op7_secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base_spans", "added_spans"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base_spans")), 256).alias("base_sha256"), written(every).alias("spans"))
