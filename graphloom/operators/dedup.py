"""Deduplication of a graph in three layers: canonical classes, unification of names that recorded decisions can forbid, and contradictions of what was merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import _remove, _store, _store_with, connected_components
from .linking import contradictions, copies, rewire, unify


def forbidding_merge(links: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, decided): what goes where when ``links`` (a, b, confidence) are taken one by one, the surest first (ties: smaller a, then b), each joining two groups unless that would put a ``forbidden`` pair (a, b) into one.

    ``mapping``: id and root (the group's smallest id) of every end of a link; ``decided``: a, b, confidence and accepted - false where a pair was forbidden; links within a group that earlier ones made are accepted.

    Links are decided in rounds, and groups that links have joined go on as one. All open links between two groups that may not meet are refused at once. A group then takes its first
    open link if each group that it may not meet has none as early: until that link's turn neither has grown, so it is taken whatever happens elsewhere. That holds for all groups
    without forbidden pairs, so a round joins whole trees of them, and a hub with any number of leaves takes one round.
    """
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence").filter("a < b").groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    known, _ = _store(ends)
    rank = F.struct((-F.col("confidence")).alias("less"), F.col("a").alias("first"), F.col("b").alias("second"))
    open_, open_path, found = _store_with(known.select("a", "b", rank.alias("rank")), F.count(F.lit(1)).alias("n"))
    apart, apart_path = _store(forbidden.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    groups, groups_path = _store(known.select("a").union(known.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("root")))
    refused = None
    while found["n"]:
        no, _ = _store(open_.join(apart, ["a", "b"], "left_semi").select("rank"))
        refused = no if refused is None else refused.union(no)
        left = open_.join(apart, ["a", "b"], "left_anti")
        first, first_path = _store(left.select(F.col("a").alias("g"), "rank", F.col("b").alias("to")).union(left.select("b", "rank", "a")).groupBy("g").agg(F.min(F.struct("rank", "to")).alias("f")).select("g", "f.rank", "f.to"))
        pairs = apart.union(apart.select("b", "a")).toDF("g", "other")
        later = pairs.join(first.select(F.col("g").alias("other"), F.col("rank").alias("theirs")), "other").groupBy("g").agg(F.min("theirs").alias("theirs"))
        taken = first.join(later, "g", "left").filter("theirs IS NULL OR rank < theirs").select("g", "to")
        moves, moves_path = _store(connected_components(taken, "g", "to").filter("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new")))

        def renamed(df: DataFrame, *columns: str) -> DataFrame:
            for c in columns:
                df = df.join(moves.withColumnsRenamed({"old": c, "new": "__new"}), c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
            return df

        def ordered(df: DataFrame) -> DataFrame:
            rest = [c for c in df.columns if c not in ("a", "b")]
            return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)

        gone = (open_path, apart_path, groups_path, first_path, moves_path)
        open_, open_path, found = _store_with(ordered(renamed(left, "a", "b")), F.count(F.lit(1)).alias("n"))
        apart, apart_path = _store(ordered(renamed(apart, "a", "b")).distinct())
        groups, groups_path = _store(renamed(groups, "root"))
        _remove(known, *gone)
    out = known.withColumn("accepted", F.lit(True)) if refused is None else known.withColumn("rank", rank).join(refused.withColumn("no", F.lit(True)), "rank", "left").select("a", "b", "confidence", F.col("no").isNull().alias("accepted"))
    return groups, out


def dedup_graph(nodes: DataFrame, edges: DataFrame, ranks: dict[str, int], decisions: DataFrame, surely: float = 0.9, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """(nodes, edges, decided, contradictions) of a graph after three layers.

    Nodes (id, label, source_type, description, canonical, ...) of one canonical id are one (a null one: none's). Then nodes of different sources whose names are variants of each other join at a confidence of ``surely`` or more; ``decisions`` (a, b, accepted) are what was decided about pairs before: accepted ones join first,
    rejected ones are never put into one group, by whatever chain of merges. A group's node is the one of the best source (``ranks``; the smallest id on ties), with the longest description of all. Edges follow; loops that arise go. ``facts`` (label, source_type, key, value) are compared under the label of the node they end in.
    """
    named, _ = _store(nodes)
    first = named.filter("canonical IS NOT NULL").groupBy("canonical").agg(F.min("id").alias("least"))
    same = named.join(first, "canonical").filter("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(2.0).alias("confidence"))
    kept = decisions.filter("accepted").select("a", "b", F.lit(3.0).alias("confidence"))
    alike = unify(named.select("id", "label", "source_type"), ranks).filter(F.col("confidence") >= surely).select(F.col("primary").alias("a"), F.col("secondary").alias("b"), "confidence")
    equal = copies(named.select("id", "label", "source_type"))
    # Copies of one name in one source are one entity only where another source has the name too: they follow their representative.
    follow = equal.join(alike.select(F.col("a").alias("representative")).union(alike.select("b")).distinct(), "representative").select(F.col("representative").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("confidence"))
    groups, decided = forbidding_merge(same.unionByName(kept).unionByName(alike).unionByName(follow), decisions.filter("NOT accepted"))
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col("source_type")), F.lit(10))
    grouped, _ = _store(named.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id")))
    chosen = grouped.groupBy("root").agg(F.min_by("id", F.struct(place, "id")).alias("keeper"), F.min_by("description", F.when(F.col("description").isNotNull(), F.struct(-F.length("description"), "description"))).alias("longest"), F.count("*").alias("merged"))
    keepers, _ = _store(grouped.select("id", "root").join(chosen, "root").select("id", "keeper", "longest", "merged"))
    merged = named.join(keepers.filter("id = keeper"), "id").withColumn("description", F.coalesce("longest", "description")).select(*named.columns, "merged")
    moved = rewire(edges, keepers.filter("id <> keeper").select("id", "keeper"))
    if facts is None:
        return merged, moved, decided, None
    labels = named.select(F.col("id").alias("keeper"), F.col("label").alias("of"))
    under = facts.join(keepers.select("id", "keeper"), "id").join(labels, "keeper").select(F.col("of").alias("label"), "source_type", "key", "value")
    return merged, moved, decided, contradictions(under)
