"""Links between documents and the nodes they speak of, and between nodes by their words or vectors. Functions take and return DataFrames, lazily."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, trigrams
from .components import _store, bounded_batches
from .linking import cosine
from .vectors import best_matches

#: Words that say nothing about what a description is about.
STOP_WORDS = ("the", "a", "an", "is", "in", "to", "of", "and", "for", "it", "on", "with", "as", "at", "by", "this", "that")


#: Terms that a task looks for at once; more are found by joins.
TERMS = 50_000


def _starts(terms: list[str]) -> Callable[[np.ndarray, bytes], Iterator[tuple[int, int]]]:
    """A function that finds (place, term) of all terms in bytes: eight bytes - or as many as the shortest short term has - are looked up at every place, whole terms where they fit."""
    words = [x.encode() for x in terms]
    groups = []
    for some in ([k for k, w in enumerate(words) if len(w) >= 8], [k for k, w in enumerate(words) if len(w) < 8]):
        if some:
            width = min(8, *(len(words[k]) for k in some), 8)
            codes = np.array([int.from_bytes(words[k][:width], "little") for k in some], np.uint64)
            order = np.argsort(codes, kind="stable")
            groups.append((np.uint64((1 << 8 * width) - 1), codes[order], np.array(some)[order]))
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(44)

    def find(data: np.ndarray, raw: bytes) -> Iterator[tuple[int, int]]:
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        for mask, codes, which in groups:
            known = np.zeros(1 << 20, bool)
            known[codes * mix >> shift] = True
            for at in range(0, len(data), 1 << 20):
                n = min(1 << 20, len(data) - at)
                here = np.ndarray((n,), "<u8", padded, at, (1,)) & mask
                hits = np.flatnonzero(known[here * mix >> shift])
                low, high = (np.searchsorted(codes, here[hits], side) for side in ("left", "right"))
                for p, lo, hi in zip((hits + at).tolist(), low.tolist(), high.tolist()):
                    for k in which[lo:hi].tolist():
                        if raw.startswith(words[k], p):
                            yield p, k

    return find


def _standing(texts: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, term) of the terms that stand in the texts (doc_id, low), in one pass over their bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, ends = _starts(terms), [len(x.encode()) for x in terms]
        for batch in batches:
            low = pa.concat_arrays([batch.column("low")])
            bounds = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1]
            if not len(low) or bounds[-1] == bounds[0]:
                continue
            data = np.frombuffer(low.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            found = list(find(data, data.tobytes()))
            places = np.array([p for p, _ in found], np.int64)
            docs = np.searchsorted(bounds, places, "right") - 1
            pairs = sorted({(d, k) for d, (p, k) in zip(docs.tolist(), found) if p + ends[k] <= bounds[d + 1]})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([terms[k] for _, k in pairs], pa.string())], names=["doc_id", "term"])

    bounded_batches(texts.sparkSession)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, term string")


def mentions(docs: DataFrame, code: DataFrame, least: int = 3, terms: int = TERMS) -> DataFrame:
    """(doc_id, code_id, how): nodes whose id, or else label, stands in the text, whatever the case. Inputs: doc_id, text; id, label.

    Substrings without a cross join: up to ``terms`` terms are looked for in one pass over the texts. More are joined: a term can only stand in texts that have its rarest run
    of three characters. Terms of fewer than ``least`` characters take no part.
    """
    named = code.select("id", F.explode(F.array(F.struct(F.lit(0).alias("how"), F.lower("id").alias("term")), F.struct(F.lit(1).alias("how"), F.lower("label").alias("term")))).alias("t")).select("id", "t.how", "t.term").filter(F.length("term") >= max(3, least))
    texts = docs.select("doc_id", F.lower("text").alias("low")).filter(F.length("low") >= 3)
    wanted = [r["term"] for r in named.select("term").distinct().limit(terms + 1).collect()]
    if len(wanted) <= terms:
        near = _standing(texts, wanted)
    else:
        parts = named.select("term").distinct().select("term", F.explode(trigrams(F.col("term"))).alias("g"))
        held = texts.select("doc_id", F.explode(trigrams(F.col("low"))).alias("g")).join(parts.select("g").distinct(), "g", "left_semi")
        rarest = parts.join(held.groupBy("g").agg(F.count("*").alias("n")), "g").groupBy("term").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
        near = rarest.join(held, "g").select("doc_id", "term").distinct().join(texts, "doc_id").filter(F.contains("low", F.col("term"))).select("doc_id", "term")
    return near.join(named, "term").groupBy("doc_id", F.col("id").alias("code_id")).agg(F.when(F.min("how") == 0, "id").otherwise("label").alias("how"))


def fuzzy_mentions(docs: DataFrame, code: DataFrame, least: float, most: int = 50) -> DataFrame:
    """(doc_id, code_id, score): words in common by the number of words of the side with fewer, ``least`` or more; the ``most`` best of each document. Inputs: doc_id, text; id, label.

    Of a text only the number of its words and those that some label has are kept. Prefix filter: with words from rare to frequent, a pair that reaches the threshold shares one of the
    first ``n - ceil(least * n) + 1`` of the side with fewer words, so a word that most documents have makes no candidates by itself. Words that no label has come before all others.
    """
    first = lambda n: n - F.ceil(F.lit(least - 1e-6) * n) + 1
    b, _ = _store(code.select(F.col("id").alias("code_id"), tokens(F.col("label")).alias("y")).filter(F.size("y") > 0).withColumn("n1", F.size("y")))
    spoken = b.select("code_id", "n1", F.explode("y").alias("w"))
    a = docs.select("doc_id", tokens(F.col("text")).alias("x")).filter(F.size("x") > 0).withColumn("row", F.monotonically_increasing_id())
    words = a.select("row", "doc_id", F.size("x").alias("n0"), F.explode("x").alias("w")).join(spoken.select("w").distinct(), "w")
    # A row's words follow each other, so they meet again without much of a shuffle.
    held, _ = _store(words.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n0").alias("n0"), F.collect_list("w").alias("x")))
    often, _ = _store(held.select(F.explode("x").alias("w")).groupBy("w").agg(F.count("*").alias("times")))
    rank = lambda who: F.row_number().over(Window.partitionBy(who).orderBy("times", "w"))
    rare = spoken.join(often, "w").withColumn("at", rank("code_id") + F.col("n1") - F.count("*").over(Window.partitionBy("code_id"))).filter(F.col("at") <= first(F.col("n1"))).select("w", "code_id", "n1")
    fewer_labels = held.select("row", "n0", F.explode("x").alias("w")).join(rare, "w").filter("n1 <= n0").select("row", "code_id")
    longest = b.agg(F.max("n1").alias("longest"))
    short = held.join(F.broadcast(longest), F.col("n0") < F.col("longest")).select("row", "n0", F.size("x").alias("h"), F.explode("x").alias("w")).join(often, "w")
    scarce = short.withColumn("at", rank("row") + F.col("n0") - F.col("h")).filter(F.col("at") <= first(F.col("n0")))
    fewer_words = scarce.join(spoken, "w").filter("n0 < n1").select("row", "code_id")
    full = fewer_labels.union(fewer_words).distinct().join(held, "row").join(b, "code_id")
    scored = full.select("doc_id", "code_id", F.round(F.size(F.array_intersect("x", "y")) / F.least("n0", "n1"), 6).alias("score")).filter(F.col("score") >= least)
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "code_id"))).filter(F.col("place") <= most).drop("place")


def plain_words(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct lower-case words between white space, stop words left out."""
    return F.array_except(F.array_remove(F.split(F.lower(text), r"\s+"), ""), F.array(*map(F.lit, stop)))


def keyword_connect(new: DataFrame, nodes: DataFrame, edges: DataFrame, shared: int = 3, limit: int = 20) -> DataFrame:
    """(src, dst, shared): new nodes and others whose descriptions have ``shared`` words or more in common and that no edge joins; the first ``limit`` in order of ids. Inputs: id, description.

    Prefix filter: with words from rare to frequent, such a pair shares one of the first ``n - shared + 1`` words of each side, so words that most nodes have make no candidates by themselves.
    """
    a = new.select(F.col("id").alias("src"), plain_words(F.col("description")).alias("x")).filter(F.size("x") >= max(2, shared))
    b = nodes.select(F.col("id").alias("dst"), plain_words(F.col("description")).alias("y")).filter(F.size("y") >= shared)
    often = b.select(F.explode("y").alias("w")).groupBy("w").agg(F.count("*").alias("times"))

    def rare(side: DataFrame, who: str, words: str) -> DataFrame:
        each = side.select(who, F.size(words).alias("n"), F.explode(words).alias("w")).join(often, "w", "left").withColumn("times", F.coalesce("times", F.lit(0)))
        return each.withColumn("at", F.row_number().over(Window.partitionBy(who).orderBy("times", "w"))).filter(F.col("at") <= F.col("n") - shared + 1).select(who, "w")

    near = rare(a, "src", "x").join(rare(b, "dst", "y"), "w").filter("src <> dst").select("src", "dst").distinct()
    counted = near.join(a, "src").join(b, "dst").select("src", "dst", F.size(F.array_intersect("x", "y")).cast("long").alias("shared")).filter(F.col("shared") >= shared)
    return counted.join(joined_pairs(edges), ["src", "dst"], "left_anti").orderBy("src", "dst").limit(limit)


def joined_pairs(edges: DataFrame) -> DataFrame:
    """(src, dst) of nodes that an edge joins, either way round."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def vector_connect(new: DataFrame, nodes: DataFrame, edges: DataFrame, least: float, limit: int = 20) -> DataFrame:
    """(src, dst, similarity): new nodes and others with a cosine of ``least`` or more that no edge joins; the first ``limit``, by new node and then the most similar. Inputs: id, embedding.

    New nodes may be any number: they and the others meet tile by tile. Of each one's matches as many are enough as ``limit`` and its edges.
    """
    joined = joined_pairs(edges)
    known = joined.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("known"))
    asked = new.join(known, "id", "left").select("id", "embedding", (F.lit(limit) + F.coalesce("known", F.lit(0))).alias("most"))
    others = nodes.join(new.select("id"), "id", "left_anti")
    near = best_matches(asked, others, limit, least, digits=4).select("src", "dst", "similarity")
    return near.join(joined, ["src", "dst"], "left_anti").orderBy("src", F.desc("similarity"), "dst").limit(limit)


def knowledge_connect(entities: DataFrame, nodes: DataFrame, preferred: list[str], bound: int = 10_000) -> DataFrame:
    """(entity, id, score): the node that fits each entity best - same id 1, same label 0.95, in the id 0.8, in the label 0.7, in the description 0.5; preferred types count a fifth more, one at most.

    Inputs: entity; id, label, entity_type, description. Entities are a stated set of at most ``bound``; each task keeps its best node of each, by score and then id.
    """
    if entities.limit(bound + 1).count() > bound:
        raise ValueError(f"more than {bound} entities: connect them in several calls")
    e = F.lower("entity")
    text = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    fits = F.when(e == text("id"), 1.0).when(F.contains(text("id"), e), 0.8).when(e == text("label"), 0.95).when(F.contains(text("label"), e), 0.7).when(F.contains(text("description"), e), 0.5)
    # An id that contains the entity is asked about before the label, as the order of the rules decides.
    score = F.when(F.col("entity_type").isin(preferred), F.least(F.lit(1.0), fits * 1.2)).otherwise(fits)
    hits = nodes.join(F.broadcast(entities.select("entity").distinct()), fits.isNotNull()).select("entity", "id", score.alias("score"))
    return hits.groupBy("entity").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("b")).select("entity", "b.id", "b.score")


def hybrid_search(chunks: DataFrame, edges: DataFrame, query: list[float], k: int, decay: float = 0.6, limit: int = 50) -> DataFrame:
    """(id, score, direct): parents of the ``k`` nearest chunks, and their neighbours at ``decay`` times the score; the best of each. Inputs: id, parent, embedding.

    A parent with neighbours gives its score to these and is itself only found as the neighbour of another hit; ``direct`` tells parents without any.
    """
    probe = F.array(*[F.lit(float(x)) for x in query])
    near = chunks.select("id", "parent", cosine(F.col("embedding"), probe).alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)
    hits = near.groupBy("parent").agg(F.max("score").alias("score"))
    around = hits.join(joined_pairs(edges).withColumnRenamed("src", "parent"), "parent", "left")
    scored = around.select(F.coalesce("dst", "parent").alias("id"), F.when(F.col("dst").isNull(), F.col("score")).otherwise(F.col("score") * decay).alias("score"), F.col("dst").isNull().alias("direct"))
    return scored.groupBy("id").agg(F.max("score").alias("score"), F.max("direct").alias("direct")).orderBy(F.desc("score"), "id").limit(limit)


def evidence(chunks: DataFrame, query: list[float], k: int = 3) -> DataFrame:
    """The ``k`` chunks of each node that are nearest to the query, in order. Inputs: parent, id, embedding."""
    probe = F.array(*[F.lit(float(x)) for x in query])
    scored = chunks.select("parent", "id", F.coalesce(cosine(F.col("embedding"), probe), F.lit(0.0)).alias("score"))
    return scored.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)


def extracted_entities(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entities): quoted terms, words of capitals, capitalised phrases of two words or more and words with inner capitals, distinct and sorted."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) for pattern, group in ((r"\"([^\"]{2,60})\"", 1), (r"\b[A-Z]{2,}\b", 0), (r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b", 0), (r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b", 0))]
    return texts.select(key, F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f, F.array().cast("array<string>")) for f in found]))).alias("entities"))


#: Characters of sections that are handed on together.
SECTIONS = 4 << 20


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, level, title, path, body): sections by their # headings, outside of fenced code; what stands before the first heading has level 0 and no title.

    ``path`` lists the titles of the headings above and the section's own. One pass over each text's lines; a worker holds a batch of bounded bytes, and hands sections on as it goes.
    """
    import re

    heading = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
    kind = docs.schema[key].dataType.simpleString()
    fields = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string()]

    def sections(value: str | None) -> Iterator[tuple]:
        above: list[tuple[int, str]] = []
        level, title, body, seq, fenced = 0, None, [], 0, False
        for line in [*(value or "").split("\n"), None]:
            found = heading.match(line) if line is not None and not fenced else None
            if line is not None and line.lstrip().startswith("```"):
                fenced = not fenced
            if line is not None and not found:
                body.append(line)
                continue
            content = "\n".join(body).strip()
            if title is not None or content:
                yield seq, level, title, [t for _, t in above], content
                seq += 1
            if found:
                level, title, body = len(found[1]), found[2], []
                above = [(n, t) for n, t in above if n < level] + [(level, title)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, size = [], [], 0
            for k in range(batch.num_rows):
                for row in sections(batch.column(text)[k].as_py()):
                    rows.append(row)
                    of.append(k)
                    size += len(row[-1]) + 200
                    if size > SECTIONS:
                        yield table(batch, of, rows)
                        rows, of, size = [], [], 0
            if rows:
                yield table(batch, of, rows)

    def table(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), fields)]
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of, pa.int64())), *columns], names=[key, "seq", "level", "title", "path", "body"])

    bounded_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, seq int, level int, title string, path array<string>, body string")
