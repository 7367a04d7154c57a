"""Text operators: chunks of documents and a quality gate."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words in a path that mark test data.
FIXTURE_MARKERS = ("fixture", "mock", "__fixtures__", "testdata", "test_data")
BLANK_LINES = r"\n{2,}"
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def paragraph_count(text: Column) -> Column:
    """Paragraphs (blank lines between) that hold more than white space."""
    return F.size(F.filter(F.split(text, BLANK_LINES), lambda p: p.rlike(r"[^ \t\n\r]")))


def document_quality(docs: DataFrame, path: str) -> DataFrame:
    """Adds reason (the first that applies) and score (4 places). Null text counts as empty: too short."""
    text = F.coalesce("text", F.lit(""))
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    marked = F.lit(False)
    for word in FIXTURE_MARKERS:
        marked = marked | F.coalesce(F.lower(path).contains(word), F.lit(False))
    sections = paragraph_count(text)
    reason = F.when(F.length(F.btrim(text, F.lit(" \t\n\r"))) < 50, "too_short").when(foreign > 0.5 * F.length(text), "garbled").when(sections == 0, "no_structure").when(marked, "fixture").otherwise("ok")
    score = F.least(F.lit(1.0), F.lit(0.3) + sections * F.lit(0.1) + F.least(F.length(text) / F.lit(5000.0), F.lit(0.4)))
    graded = F.when(F.col("reason") == "ok", F.round(score, 4)).when(F.col("reason") == "too_short", F.lit(0.0)).when(F.col("reason") == "no_structure", F.lit(0.2)).otherwise(F.lit(0.1))
    return docs.withColumn("reason", reason).withColumn("score", graded)


def pieces(text: str, least: int, most: int) -> Iterator[str]:
    """Paragraphs, short ones with those that follow, long ones cut after sentences, else between words, else anywhere."""
    held = ""
    for paragraph in filter(None, map(str.strip, re.split(BLANK_LINES, text))):
        if held and len(held) < least and len(held) + 1 + len(paragraph) <= most:
            held += "\n\n" + paragraph
            continue
        yield from sized(held, most)
        held = paragraph
    yield from sized(held, most)


def sized(text: str, most: int) -> Iterator[str]:
    held = ""
    for sentence in SENTENCE_END.split(text) if len(text) > most else [text]:
        joined = f"{held} {sentence}" if held else sentence
        if len(joined) <= most:
            held = joined
            continue
        if held:
            yield held
        start = 0
        while len(sentence) - start > most:
            space = sentence.rfind(" ", start, start + most)
            end = space if space > start else start + most
            yield sentence[start:end].rstrip()
            start = end
            while start < len(sentence) and sentence[start].isspace():
                start += 1
        held = sentence[start:]
    if held:
        yield held


def chunk(docs: DataFrame, key: str, least: int = 100, most: int = 1500, overlap: int = 100) -> DataFrame:
    """(key, position, chunk): a chunk after the first begins with the end of the one before. Null and blank texts give no chunk.

    Chunks leave the worker as they are made, so that a long text needs no more memory than itself and one batch.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, size = [], 0
            for name, text in zip(frame[key], frame["text"]):
                before = ""
                for position, piece in enumerate(pieces(text or "", least, most)):
                    tail = before[-overlap:].lstrip() if overlap else ""
                    rows.append((name, position, f"{tail} {piece}" if tail and not piece.startswith(tail) else piece))
                    size += len(piece)
                    before = piece
                    if size > 1 << 22:
                        yield pd.DataFrame(rows, columns=[key, "position", "chunk"])
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=[key, "position", "chunk"])

    schema = T.StructType([docs.schema[key], T.StructField("position", T.IntegerType()), T.StructField("chunk", T.StringType())])
    return docs.select(key, "text").mapInPandas(run, schema)


#: File names that say what a JSON file is (lower case), then marks among its top-level keys, in order of precedence.
JSON_PATTERNS: list[tuple[str, str, float]] = [(r"\.schema\.json$", "SCHEMA_FILE", 0.95), (r"^\..*rc\.json$", "TOOL_CONFIG", 0.9)]
JSON_KEYS: list[tuple[list[list[str]], str, float]] = [
    ([["openapi"], ["swagger"]], "API_SPEC", 0.95),
    ([["dependencies", "scripts"], ["dependencies", "devDependencies"]], "DEPENDENCY_MANIFEST", 0.9),
    ([["packages"], ["dev-packages"]], "DEPENDENCY_MANIFEST", 0.85),
    ([["require", "autoload"]], "DEPENDENCY_MANIFEST", 0.85),
    ([["compilerOptions"]], "TOOL_CONFIG", 0.95),
    ([["AWSTemplateFormatVersion"], ["Resources"]], "INFRA_CONFIG", 0.95),
    ([["service", "functions", "provider"]], "INFRA_CONFIG", 0.9),
    ([["$schema"]], "SCHEMA_FILE", 0.8),
    ([["rules"]], "TOOL_CONFIG", 0.7),
]


def classify_json(files: DataFrame, path: str, text: str, known: dict[str, str]) -> DataFrame:
    """Category and confidence of JSON files, by the first that holds: known name, name pattern, top-level keys, size over 50 KiB, default.

    Null text: unknown, unless the name tells. Text that isn't an object has no keys.
    """
    name = F.lower(F.substring_index(path, "/", -1))
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    rules: list[tuple[Column, Column | str, float]] = []
    if known:
        rules.append((name.isin(list(known)), F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name), 1.0))
    rules += [(name.rlike(pattern), category, sure) for pattern, category, sure in JSON_PATTERNS]
    rules.append((F.col(text).isNull(), "UNKNOWN", 0.0))
    for options, category, sure in JSON_KEYS:
        hit = F.lit(False)
        for option in options:
            hit = hit | F.forall(F.array(*map(F.lit, option)), lambda k: F.array_contains(keys, k))
        rules.append((hit, category, sure))
    rules.append((F.octet_length(text) > 50 * 1024, "DATA_FILE", 0.6))
    category, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for hit, name_, value in [*rules, (F.lit(True), "APP_CONFIG", 0.5)][::-1]:
        category = F.when(hit, name_ if isinstance(name_, Column) else F.lit(name_)).otherwise(category)
        sure = F.when(hit, F.lit(value)).otherwise(sure)
    return files.withColumns({"category": category, "confidence": sure})


def route(queries: DataFrame, text: str, routes: list[tuple[str, list[str]]], default: str = "reason") -> DataFrame:
    """The tool with the most matching patterns, as confidence ``0.7 + 0.1 * matches`` (0.95 at most); the earlier one on ties, the default without a match."""
    wanted = F.trim(F.lower(text))
    hits = [sum((F.coalesce(wanted.rlike(f"(?U){p}").cast("int"), F.lit(0)) for p in patterns), F.lit(0)) for _, patterns in routes]
    sure = [F.when(h > 0, F.least(F.lit(0.95), 0.7 + h * 0.1)).otherwise(F.lit(0.0)) for h in hits]
    best = F.greatest(F.lit(0.3), *sure)
    tool = F.lit(default)
    for (name, _), s in list(zip(routes, sure))[::-1]:
        tool = F.when((s == best) & (best > 0.3), F.lit(name)).otherwise(tool)
    return queries.withColumns({"tool": tool, "confidence": best})


def link_tests(files: DataFrame, path: str, is_test: Column) -> DataFrame:
    """(src, dst): each test file and the file it is named after, the smallest path of several; tests without one are left out."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    bare = F.regexp_replace(F.regexp_replace(stem, "^test[_-]", ""), r"([_-]test|\.test|\.spec)$", "")
    tests = files.filter(is_test).select(F.col(path).alias("src"), bare.alias("stem"))
    sources = files.filter(~is_test).select(F.col(path).alias("dst"), stem.alias("stem")).groupBy("stem").agg(F.min("dst").alias("dst"))
    return tests.join(sources, "stem").select("src", "dst")


def reclassify(nodes: DataFrame, label: str, kind: str, rules: list[tuple[str, list[str], str]]) -> DataFrame:
    """``kind`` after the first rule (pattern of the label, kinds it applies to, new kind) that holds, and ``changed``."""
    new = F.col(kind)
    for pattern, kinds, target in rules[::-1]:
        new = F.when(F.coalesce(F.col(label).rlike(pattern), F.lit(False)) & F.col(kind).isin(kinds), F.lit(target)).otherwise(new)
    return nodes.withColumn("__new", new).withColumn("changed", ~F.col("__new").eqNullSafe(F.col(kind))).withColumn(kind, F.col("__new")).drop("__new")


def transfer_report(events: DataFrame, destination: str, sensitivity: str, redactions: str) -> DataFrame:
    """Events and redactions in all, by destination and by sensitivity, in one pass; a level's ``value`` is null for the whole."""
    grouped = events.groupingSets([[], [F.col(destination)], [F.col(sensitivity)]], F.col(destination), F.col(sensitivity))
    counted = grouped.agg(F.grouping_id().alias("level"), F.count("*").alias("events"), F.sum(redactions).alias("redactions"))
    kind = F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "destination").otherwise("sensitivity")
    return counted.select(kind.alias("kind"), F.when(F.col("level") == 1, F.col(destination)).when(F.col("level") == 2, F.col(sensitivity)).alias("value"), "events", "redactions")
