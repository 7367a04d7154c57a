"""Messages, answers and memory: filters, agreement, summaries, tool ranking, impact templates, calibration and decay. Functions take and return DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the sender of an observer's messages.
OBSERVER = "__observer__"


def confident(messages: DataFrame, least: float) -> DataFrame:
    """Messages of at least that confidence, the observer's left out."""
    return messages.filter((F.col("confidence") >= least) & (F.col("node") != OBSERVER))


def most_confident(messages: DataFrame, key: str) -> DataFrame:
    """(key, node, content): the message with the highest confidence, of several that of the smallest node, of its own the smallest content. Missing values come last."""
    best = F.struct(*[x for c, v in (("confidence", -F.col("confidence")), ("node", F.col("node")), ("content", F.col("content"))) for x in (F.col(c).isNull(), v)])
    return messages.groupBy(key).agg(F.min_by(F.struct("node", "content"), best).alias("b")).select(key, "b.node", "b.content")


def joined_by_confidence(messages: DataFrame, key: str, mark: str = "[CONFLICT] ") -> DataFrame:
    """(key, text): contents by confidence, then node, a blank line between; contradictions carry a mark."""
    text = F.concat(F.when(F.col("reasoning_type") == "CONTRADICTION", mark).otherwise(""), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct(-F.col("confidence"), F.col("node"), text.alias("text"))))
    return messages.groupBy(key).agg(rows.alias("r")).select(key, F.array_join(F.transform("r", lambda x: x["text"]), "\n\n").alias("text"))


def agreement(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, nodes, ratio): the share of pairs of nodes whose last messages have the same words; pairs without any word don't count, no pair gives null.

    Equal word sets are counted in classes, so pairs are never listed: a class of n makes n * (n - 1) / 2 of them. Every node has one last message.
    """
    last = messages.groupBy(key, "node").agg(F.max_by("content", order).alias("content")).filter(F.col("content") != "")
    words = last.select(key, F.array_sort(F.array_distinct(F.array_remove(F.split(F.lower("content"), r"\s+"), ""))).alias("w"))
    classes = words.groupBy(key, "w").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    whole = classes.groupBy(key).agg(F.sum("n").alias("nodes"), F.sum(F.when(F.size("w") == 0, F.col("n")).otherwise(0)).alias("silent"), F.sum(F.when(F.size("w") > 0, pairs(F.col("n"))).otherwise(0.0)).alias("same"))
    total = pairs(F.col("nodes")) - pairs(F.col("silent"))
    return whole.select(key, "nodes", F.when(total > 0, F.round(F.col("same") / total, 6)).alias("ratio"))


def blended_confidence(agreed: DataFrame, key: str, raw: str, weight: float, gain: float, alone: tuple[float, float], floors: list[tuple[int, float, float]]) -> DataFrame:
    """(key, confidence): ``weight`` of the agreement and the rest of ``raw`` times ``gain``; without agreement ``raw * alone[0] + alone[1]``.

    ``floors``: least nodes, least agreement and the confidence that they are worth, highest first. All values are the user's to choose.
    """
    blend = weight * F.col("ratio") + (1 - weight) * F.least(F.lit(1.0), F.col(raw) * gain)
    floor = F.lit(0.0)
    for nodes, ratio, worth in reversed(floors):
        floor = F.when((F.col("nodes") >= nodes) & (F.col("ratio") >= ratio), worth).otherwise(floor)
    value = F.when(F.col("ratio").isNull(), F.col(raw) * alone[0] + alone[1]).otherwise(F.greatest(blend, floor))
    return agreed.select(key, F.round(F.least(F.lit(1.0), value), 3).alias("confidence"))


def community_summaries(messages: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """(community, n, summary): beginnings of the messages of each community (else type), by node, cut at ``most`` characters.

    Each message gives 200 characters or its share of ``most``, so of a community's messages the first ``most`` (in order of node) are all that can show; only these are gathered.
    """
    placed = messages.join(nodes.select(F.col("id").alias("node"), F.coalesce("community", "entity_type").alias("community")), "node", "left").withColumn("community", F.coalesce("community", F.lit("__all__")))
    sizes = placed.groupBy("community").agg(F.count("*").alias("n"))
    order = Window.partitionBy("community").orderBy("node")
    first = placed.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= most).join(sizes, "community")
    snippet = F.concat(F.lit("["), F.col("node"), F.lit("] "), F.substring(F.coalesce("content", F.lit("")), F.lit(1), F.greatest(F.lit(200), F.floor(F.lit(most) / F.col("n")).cast("int"))))
    joined = first.groupBy("community").agg(F.max("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", snippet.alias("s")))), lambda x: x["s"]), "\n").alias("all"))
    return joined.select("community", "n", F.when(F.length("all") > most, F.concat(F.substring("all", 1, most), F.lit("\n…[community summary truncated]"))).otherwise(F.col("all")).alias("summary"))


def recipients(edges: DataFrame, nodes: DataFrame, shapes: DataFrame, ancestors: DataFrame, source: str) -> DataFrame:
    """Neighbours of ``source`` that some edge lets it speak to: its relation has no shape, or both types (or types above them) fit the shape.

    ``shapes``: relationship, domain, range (arrays; null: any); ``ancestors``: type, above (the type itself included).
    """
    ends = edges.filter((F.col("src") == source) | (F.col("dst") == source)).select(F.when(F.col("src") == source, F.col("dst")).otherwise(F.col("src")).alias("id"), F.upper("relationship").alias("relationship")).filter(F.col("id") != source).distinct()
    above = ancestors.groupBy(F.col("type").alias("entity_type")).agg(F.collect_set("above").alias("kinds"))
    kinds = nodes.select("id", "entity_type").join(above, "entity_type", "left").withColumn("kinds", F.coalesce("kinds", F.array("entity_type")))
    own = kinds.filter(F.col("id") == source).select(F.col("kinds").alias("own"))
    asked = ends.join(kinds, "id").join(shapes.withColumn("known", F.lit(True)), "relationship", "left").crossJoin(F.broadcast(own))
    fits = lambda allowed, kinds: F.col(allowed).isNull() | F.arrays_overlap(allowed, kinds)
    return asked.filter(F.col("known").isNull() | (fits("domain", "own") & fits("range", "kinds"))).select("id").distinct()


def rank_tools(matches: DataFrame, preferred: DataFrame, patterns: DataFrame, after: DataFrame, confidence: float, weights: dict[str, float], limit: int) -> DataFrame:
    """(tool, score): how well tools fit an intent, best first. Weights are the user's to choose.

    ``matches``: tool, weight, which count times the confidence; ``preferred`` and ``patterns``: tool, at (from 0), which count ``weights["preferred"]`` and ``weights["pattern"]``,
    less by ``weights["preferred_step"]`` and ``weights["pattern_step"]`` a place; ``after``: tool, before, weight - a tool used after one that scored gets ``weights["chain"]`` of its score.
    """
    base = matches.select("tool", (F.col("weight") * confidence).alias("s"))
    base = base.unionByName(preferred.select("tool", (weights["preferred"] * (1 - F.col("at") * weights["preferred_step"])).alias("s")))
    base = base.unionByName(patterns.select("tool", (weights["pattern"] * (1 - F.col("at") * weights["pattern_step"])).alias("s")))
    first = base.groupBy("tool").agg(F.sum("s").alias("s"))
    chained = after.filter("tool <> before").join(first.select(F.col("tool").alias("before"), "s"), "before").select("tool", (F.col("s") * F.col("weight") * weights["chain"]).alias("s"))
    return first.unionByName(chained).groupBy("tool").agg(F.round(F.sum("s"), 4).alias("score")).orderBy(F.desc("score"), "tool").limit(limit)


def template_impact(edges: DataFrame, start: str, steps: list[tuple[str, bool, str, list]]) -> DataFrame:
    """(id, severity, depth): what fixed paths of relations reach from ``start``; of several impacts of a node the first in order of the steps.

    A step is (relation, outward, severity, steps from there).
    """
    parts: list[DataFrame] = []

    def walk(at: DataFrame, some: list, depth: int) -> None:
        for relation, outward, severity, further in some:
            here, there = ("src", "dst") if outward else ("dst", "src")
            near = edges.filter(F.col("relationship") == relation).select(F.col(here).alias("id"), F.col(there).alias("next")).join(at, "id", "left_semi").select(F.col("next").alias("id")).distinct()
            parts.append(near.select("id", F.lit(severity).alias("severity"), F.lit(depth).alias("depth"), F.lit(len(parts)).alias("order")))
            walk(near, further, depth + 1)

    walk(edges.sparkSession.createDataFrame([(start,)], "id string"), steps, 1)
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.min_by(F.struct("severity", "depth"), "order").alias("b")).select("id", "b.severity", "b.depth")


def decayed(memory: DataFrame, now: int, keep: float, penalty: float) -> DataFrame:
    """Adds ``confidence``: the initial one times ``keep`` for each round since it was verified and ``penalty`` for each contradiction. Inputs: initial, verified, contradictions."""
    rounds = F.greatest(F.lit(now) - F.col("verified"), F.lit(0))
    return memory.withColumn("confidence", F.col("initial") * F.pow(F.lit(keep), rounds) * F.pow(F.lit(penalty), F.col("contradictions")))


def merged_memory(store: DataFrame, scratch: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """Entries after concurrent writes: of those with a key the best score stays (the earlier on ties), the best of the others under ``DISSENT:`` and the key.

    The store comes before all writes, which come in their order.
    """
    both = store.withColumn("_o", F.lit(-1).cast("long")).unionByName(scratch.withColumn("_o", F.col(order).cast("long")), allowMissingColumns=True)
    ranked = both.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), "_o"))).filter("_k <= 2")
    return ranked.withColumn(key, F.when(F.col("_k") == 2, F.concat(F.lit("DISSENT:"), F.col(key))).otherwise(F.col(key))).select(*store.columns)


def temperature(pairs: DataFrame, least: float = 0.1, most: float = 5.0, steps: int = 500) -> DataFrame:
    """One row (temperature, brier): the grid's first temperature that minimises the Brier score of confidences whose log odds it divides. Inputs: confidence, correct.

    Equal (confidence, correct) pairs are counted first; the grid is a list of fixed length in each row.
    """
    counted = pairs.groupBy("confidence", F.col("correct").cast("double").alias("y")).agg(F.count("*").alias("n"))
    p = F.least(F.greatest(F.col("confidence"), F.lit(1e-7)), F.lit(1 - 1e-7))
    logit = F.log(p / (1 - p))
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.lit(least) + k * ((most - least) / (steps - 1)))
    rows = counted.select("y", "n", logit.alias("x"), F.explode(grid).alias("t"))
    loss = rows.groupBy("t").agg((F.sum(F.col("n") * F.pow(1 / (1 + F.exp(-F.col("x") / F.col("t"))) - F.col("y"), F.lit(2))) / F.sum("n")).alias("brier"))
    return loss.agg(F.min_by("t", F.struct(F.round("brier", 12), "t")).alias("temperature"), F.min("brier").alias("brier"))


def platt(pairs: DataFrame, rounds: int = 100, settled: float = 1e-9) -> tuple[float, float]:
    """(slope, offset) of the logistic regression of ``correct`` on the log odds of ``confidence``, by Newton steps; each is one aggregation to six sums."""
    p = F.least(F.greatest(F.col("confidence"), F.lit(1e-7)), F.lit(1 - 1e-7))
    rows = pairs.groupBy(F.log(p / (1 - p)).alias("x"), F.col("correct").cast("double").alias("y")).agg(F.count("*").alias("n"))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        q = 1 / (1 + F.exp(-(F.col("x") * a + b)))
        w = F.col("n") * q * (1 - q)
        r = F.col("n") * (F.col("y") - q)
        s = rows.agg(F.sum(r * F.col("x")).alias("ga"), F.sum(r).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("aa"), F.sum(w * F.col("x")).alias("ab"), F.sum(w).alias("bb")).first()
        if s["bb"] is None:
            break
        aa, bb = s["aa"] + 1e-9, s["bb"] + 1e-9
        det = aa * bb - s["ab"] ** 2
        if det <= 0:
            break
        da, db = (bb * s["ga"] - s["ab"] * s["gb"]) / det, (aa * s["gb"] - s["ab"] * s["ga"]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < settled:
            break
    return a, b


def route_federated(hits: DataFrame, registry: DataFrame, query: str, own: str, quorum: int, penalty: float) -> DataFrame:
    """``hits`` of the graphs that answered, with ``normalized``: the score, times ``penalty`` for graphs other than the one that asked; no rows if fewer than ``quorum`` answered.

    Inputs: query_id, kg_id, score; kg_id, status.
    """
    answered = registry.filter(F.col("status") == "success").select("kg_id").distinct()
    met = answered.agg((F.count("*") >= quorum).alias("met"))
    kept = hits.join(answered, "kg_id", "left_semi").crossJoin(F.broadcast(met)).filter("met").drop("met")
    return kept.withColumn("normalized", F.when(F.col("kg_id") == own, F.col("score")).otherwise(F.col("score") * penalty))
