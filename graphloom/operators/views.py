"""Views for people and gates over a whole graph: filtered selections, health, question graphs, the dedup composition and pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linking import rewire
from .traverse import degrees, symmetric


def selected_view(nodes: DataFrame, edges: DataFrame, score: DataFrame | None, kinds: list[str] | None, limit: int, neighbors: bool = True) -> DataFrame:
    """(id, degree, chosen): the ``limit`` nodes with the highest score (without one: degree) of some kinds, and their best connected neighbours up to twice as many in all. Ties go to the smaller id.

    ``score``: id, score; nodes without a score are not chosen.
    """
    found = nodes.select("id", "entity_type").join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    ranked = found if kinds is None else found.filter(F.col("entity_type").isin(kinds))
    ranked = ranked.withColumn("score", F.col("degree").cast("double")) if score is None else ranked.join(score, "id")
    top = ranked.orderBy(F.desc("score"), "id").limit(limit).select("id", "degree")
    if not neighbors:
        return top.withColumn("chosen", F.lit(True))
    near = symmetric(edges.select("src", "dst")).join(top.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct().join(top.select("id"), "id", "left_anti")
    more = found.join(near, "id").orderBy(F.desc("degree"), "id").limit(2 * limit).select("id", "degree")
    both = top.withColumn("chosen", F.lit(True)).unionByName(more.withColumn("chosen", F.lit(False)))
    return both.orderBy(F.desc("chosen"), F.desc("degree"), "id").limit(2 * limit)


def risk_composite(modules: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(module, score): risk times one more than the impact times one more than the log of consumers, times the boost of its level. Inputs: module, risk_score, risk_level, impact, consumers."""
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv]), F.col("risk_level")), F.lit(1.0)) if boosts else F.lit(1.0)
    return modules.select("module", (F.col("risk_score") * (F.col("impact") + 1) * (1 + F.log(F.col("consumers") + 1.0)) * boost).alias("score"))


def health_gates(nodes: DataFrame, cache: DataFrame, least: int = 100) -> DataFrame:
    """(gate, ok, fatal): enough nodes; a cache; no zero vectors; nothing left to embed. ``cache``: one row of ``changes.cache_health``."""
    one = nodes.agg(F.count("*").alias("n")).crossJoin(F.broadcast(cache))
    gates = [("graph_size", F.col("n") >= least, True), ("cache_exists", F.col("cached") > 0, False), ("no_zero_vectors", F.col("zero") == 0, False), ("cache_up_to_date", F.col("lacking") == 0, False)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), ok.alias("ok"), F.lit(fatal).alias("fatal")) for g, ok, fatal in gates])).alias("g")).select("g.*")


def question_edges(paragraphs: DataFrame) -> DataFrame:
    """(question, src, dst): paragraphs of a question of which one's text names the other's title, whatever the case, or that both are supporting facts. Inputs: question, title, text, gold.

    Pairs are within a question, which has a handful of paragraphs.
    """
    a = paragraphs.select("question", F.col("title").alias("src"), F.lower("text").alias("x"), F.col("gold").alias("gx"))
    b = paragraphs.select("question", F.col("title").alias("dst"), F.lower("text").alias("y"), F.col("gold").alias("gy"))
    linked = (F.col("gx") & F.col("gy")) | F.contains("x", F.lower("dst")) | F.contains("y", F.lower("src"))
    return a.join(b, "question").filter((F.col("src") < F.col("dst")) & linked).select("question", "src", "dst").distinct()


def sampled(questions: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` of the questions, by a hash of key and seed: the same ones on every run."""
    return questions.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def deduplicated(nodes: DataFrame, edges: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with nodes of one canonical id merged into the first of them and edges rewired. ``canonical``: id, canonical; a null one keeps its node.

    The keeper is the smallest id, and its description the longest of all (of equally long ones the smallest).
    """
    keyed = nodes.join(canonical, "id", "left").withColumn("canonical", F.coalesce(F.concat(F.lit("c:"), "canonical"), F.concat(F.lit("id:"), "id")))
    keeper = keyed.groupBy("canonical").agg(F.min("id").alias("keeper"), F.min_by("description", F.struct(-F.length("description"), "description")).alias("longest"))
    kept = nodes.join(keeper.select(F.col("keeper").alias("id"), "longest"), "id").withColumn("description", F.coalesce("longest", "description")).select(*nodes.columns)
    mapping = keyed.select("id", "canonical").join(keeper, "canonical").filter("id <> keeper").select("id", "keeper")
    return kept, rewire(edges, mapping)


def pending(entries: DataFrame, done: DataFrame, key: str, order: list[str], retries: int, limit: int) -> DataFrame:
    """The first ``limit`` entries to try again, oldest first: those not done that have been tried ``retries`` times at most. Others stay in the table and are never dropped. Inputs: attempts."""
    return entries.join(done.select(key), key, "left_anti").filter(F.col("attempts") <= retries).orderBy(*order).limit(limit)


def bounded_inbox(messages: DataFrame, key: str, order: list[str], capacity: int, newest: bool = True) -> DataFrame:
    """The messages of each receiver that its queue of that capacity holds: the newest, or - where new ones are refused - the oldest."""
    by = Window.partitionBy(key).orderBy(*[F.desc(c) if newest else F.asc(c) for c in order])
    return messages.withColumn("_k", F.row_number().over(by)).filter(F.col("_k") <= capacity).drop("_k")
