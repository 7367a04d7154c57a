"""Search, name lookups, fusion of federated hits, and alignment of two vector spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .greedy import diverse

DOUBLE = "double"


def word_set(text: Column) -> Column:
    """Distinct lower-case runs of two or more letters, digits or underscores, in any script."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 1))


def recall(records: DataFrame, key: str, text: str, query: str, current: Column, k: int = 8, bonus: float = 0.05) -> DataFrame:
    """The ``k`` records that share most words with ``query`` (Jaccard); those of the current turn get a bonus. Ties go to the smaller key."""
    asked, words = word_set(F.lit(query)), word_set(F.col(text))
    shared = F.size(F.array_intersect(words, asked))
    score = shared / (F.size(words) + F.size(asked) - shared) + F.when(current, F.lit(bonus)).otherwise(F.lit(0.0))
    return records.select(key, score.alias("score"), shared.alias("shared")).filter("shared > 0").drop("shared").orderBy(F.desc("score"), key).limit(k)


def find_node(nodes: DataFrame, query: str) -> DataFrame:
    """One node: with this id, else with this label whatever the case, else one whose label or id holds the text; the smallest id of the best kind."""
    wanted = query.lower()
    kind = F.when(F.col("id") == query, 0).when(F.lower("label") == wanted, 1).when(F.lower("label").contains(wanted) | F.lower("id").contains(wanted), 2)
    return nodes.withColumn("kind", kind).filter("kind IS NOT NULL").orderBy("kind", "id").limit(1).select("id", "label", "kind")


def search_projects(nodes: DataFrame, edges: DataFrame, projects: list[str], query: str, k: int) -> DataFrame:
    """Nodes of the projects whose label or description holds the text, most connected first (ties: smaller id). Degrees are counted for the hits alone."""
    wanted = query.lower()
    hits = nodes.filter(F.col("project").isin(projects) & (F.lower("label").contains(wanted) | F.lower("description").contains(wanted)))
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    degrees = ends.join(hits.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))
    found = hits.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))
    return found.orderBy(F.desc("degree"), "id").limit(k).select("id", "label", "project", "degree")


def _first_of_each(nodes: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= k).drop("place")


def _enough(nodes: DataFrame, by_label: bool, k: int) -> DataFrame:
    """The ``k`` first nodes of each of the ``k + 1`` first labels of a type: whichever label is left out, the ``k`` first of the others are among them."""
    few = nodes.withColumn("place", F.row_number().over(Window.partitionBy("entity_type", "label").orderBy("id"))).filter(F.col("place") <= k)
    first = F.col("label") if by_label else F.min("id").over(Window.partitionBy("entity_type", "label"))
    rank = F.dense_rank().over(Window.partitionBy("entity_type").orderBy("first", "label"))
    return few.withColumn("first", first).withColumn("rank", rank).filter(F.col("rank") <= k + 1).select("id", "label", "entity_type")


def project_links(a: DataFrame, b: DataFrame, k: int, left_out: str = "MODULE") -> DataFrame:
    """The first ``k`` pairs with the same label, then with the same type, in order of link, label and ids.

    No more than ``k`` nodes a label, and ``k * (k + 1)`` a type, can stand in the first ``k`` pairs, so a label or type
    with a third of all nodes makes no more pairs than any other.
    """
    same_name = _first_of_each(a, "label", ["id"], k).alias("a").join(_first_of_each(b, "label", ["id"], k).alias("b"), F.col("a.label") == F.col("b.label"))
    left, right = (_enough(side.filter(F.col("entity_type") != left_out), by_label, k) for side, by_label in ((a, True), (b, False)))
    same_type = left.alias("a").join(right.alias("b"), (F.col("a.entity_type") == F.col("b.entity_type")) & (F.col("a.label") != F.col("b.label")))

    def shape(pairs: DataFrame, link: str) -> DataFrame:
        return pairs.select(F.col("a.id").alias("source_id"), F.col("a.label").alias("source_label"), F.col("b.id").alias("target_id"), F.lit(link).alias("connection_type"))

    return shape(same_name, "SAME_NAME").unionAll(shape(same_type, "SAME_TYPE")).orderBy("connection_type", "source_label", "source_id", "target_id").limit(k)


def scoped(records: DataFrame, wanted: Column) -> DataFrame:
    """The records that match; all of them where none does."""
    some = records.filter(wanted).limit(1).agg((F.count("*") > 0).alias("some"))
    return records.crossJoin(F.broadcast(some)).filter(~F.col("some") | F.coalesce(wanted, F.lit(False))).drop("some")


def hits_of(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur; words and their bounds are those of any script."""
    return sum((F.coalesce(text.rlike(f"(?iU){p}").cast("int"), F.lit(0)) for p in patterns), F.lit(0))


def complexity(queries: DataFrame, text: str, patterns: dict[str, tuple[list[str], float]], weights: dict[str, float], tiers: list[tuple[float, str, int]], low: int, high: int) -> DataFrame:
    """Scores from 0 to 1, their weighted sum ``composite``, a tier, and how many nodes that tier may use.

    ``token_score`` grows from ``low`` to ``high`` words; each entry of ``patterns`` is a score: how many of them occur, by the number that counts in full.
    ``tiers``: upper bound of the composite, name and nodes, lowest first; the last one has no bound. Weights and tiers are the user's to choose.
    """
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    parts = {"token_score": F.greatest(F.lit(0.0), (F.coalesce(words, F.lit(0)) - low) / F.lit(float(max(1, high - low))))}
    parts |= {name: hits_of(F.col(text), found) / F.lit(full) for name, (found, full) in patterns.items()}
    scored = queries.withColumns({name: F.round(F.least(F.lit(1.0), c), 3) for name, c in parts.items()})
    terms = [F.lit(w) * F.col(name) for name, w in weights.items()]
    chosen = F.struct(F.lit(tiers[-1][1]).alias("tier"), F.lit(tiers[-1][2]).alias("nodes"))
    for bound, name, nodes in reversed(tiers[:-1]):
        chosen = F.when(F.col("composite") < bound, F.struct(F.lit(name).alias("tier"), F.lit(nodes).alias("nodes"))).otherwise(chosen)
    total = scored.withColumn("composite", sum(terms[1:], terms[0])).withColumn("_tier", chosen)
    return total.withColumns({"tier": F.col("_tier.tier"), "max_nodes": F.col("_tier.nodes")}).drop("_tier")


def look_alike(name: Column, known: list[str]) -> Column:
    """The first known name (of four letters or more) that ``name`` imitates: with an affix, with dashes put in, or with one or two places changed."""
    short = F.when(name.contains("/"), F.substring_index(name, "/", -1)).otherwise(name)
    bare = F.regexp_replace(short, "[-_]", "")

    def imitates(good: Column) -> Column:
        gap = F.abs(F.length(short) - F.length(good))
        places = F.sequence(F.lit(1), F.least(F.length(short), F.length(good)))
        changed = F.size(F.filter(places, lambda i: F.substr(short, i, F.lit(1)) != F.substr(good, i, F.lit(1)))) + gap
        affix = F.startswith(short, F.concat(good, F.lit("-"))) | F.startswith(short, F.concat(good, F.lit("_"))) | F.endswith(short, F.concat(F.lit("-"), good)) | F.endswith(short, F.concat(F.lit("_"), good))
        return affix | (bare == good) | ((gap <= 2) & changed.between(1, 2))

    candidates = F.array(*[F.lit(k) for k in known if len(k) >= 4])
    return F.when((F.length(short) > 0) & ~short.isin(known), F.get(F.filter(candidates, imitates), F.lit(0)))


#: Fixed values, which decide the health score: what a finding of each kind and severity takes away, and the most that all of its kind do. Anomalies
#: and flips weigh less in larger graphs: their penalty is divided by the nodes over this number, where that is more than one; echoes weigh more in graphs of at most five nodes.
PENALTIES = {"c_high": (0.08, 0.32), "c_medium": (0.03, 0.15), "c_low": (0.01, 0.05), "a_critical": (0.10, 0.20), "a_high": (0.03, 0.10), "echo": (0.05, 0.15), "flip": (0.01, 0.05)}
SHARED_BY = {"a_high": 5.0, "flip": 3.0}
SMALL_GRAPH, SMALL_ECHO = 5, 0.10


def health(findings: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """One less capped penalties of each key. ``findings``: key, kind (conflict, anomaly, echo, flip), severity; ``sizes``: key, nodes. Keys without findings score one."""

    def count(kind: str, *severities: str) -> Column:
        hit = F.col("kind") == kind
        return F.count_if(hit & F.col("severity").isin(*severities)) if severities else F.count_if(hit)

    kinds = {"c_high": count("conflict", "high", "critical"), "c_medium": count("conflict", "medium"), "c_low": count("conflict", "low"), "a_critical": count("anomaly", "critical"), "a_high": count("anomaly", "high"), "echo": count("echo"), "flip": count("flip")}
    counted = findings.groupBy(key).agg(*[c.alias(n) for n, c in kinds.items()])
    rows = sizes.join(counted, key, "left").fillna(0, list(kinds))
    n = F.greatest(F.col("nodes"), F.lit(1))

    def penalty(name: str) -> Column:
        each, most = PENALTIES[name]
        worth = F.lit(each)
        if name in SHARED_BY:
            worth = worth / F.greatest(F.lit(1.0), n / SHARED_BY[name])
        if name == "echo":
            worth = F.when(n <= SMALL_GRAPH, SMALL_ECHO).otherwise(worth)
        return F.least(F.col(name) * worth, F.lit(most))

    total = sum((penalty(name) for name in kinds), F.lit(0.0))
    return rows.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total)).alias("health"))


def influencers(messages: DataFrame, edges: DataFrame, scale: float, most: float) -> DataFrame:
    """How much each node moved its neighbours: their change of confidence times ``scale`` (``most`` at most), summed over the rounds after one in which it spoke.

    ``messages``: node, round, confidence, one a node and round; ``edges``: src, dst, where dst hears src.
    """
    before = messages.select("node", (F.col("round") + 1).alias("round"), F.col("confidence").alias("earlier"))
    moved = messages.join(before, ["node", "round"]).select(F.col("node").alias("dst"), "round", F.least(F.abs(F.col("confidence") - F.col("earlier")) * scale, F.lit(most)).alias("strength"))
    spoke = before.select(F.col("node").alias("src"), "round")
    return moved.join(edges.select("src", "dst").distinct(), "dst").join(spoke, ["src", "round"]).groupBy(F.col("src").alias("node")).agg(F.sum("strength").alias("influence"))


def first_match(records: DataFrame, key: str, candidates: list[Column], known: DataFrame, name: str, target: str) -> DataFrame:
    """(key, target): what the first of the candidate names that is known stands for; keys without one are left out."""
    ranked = records.select(key, F.posexplode(F.array(*candidates)).alias("rank", name)).filter(F.col(name).isNotNull())
    return ranked.join(known.select(name, target), name).groupBy(key).agg(F.min_by(target, "rank").alias(target))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, target or null): the file an import means, by path, dotted module, a path made of the module, or its last part.

    ``imports``: import_id, target; ``files``: path. A last part of one or two characters means nothing; a name that several
    files have stands for the smallest path. Null: outside the project.
    """
    module = F.regexp_replace(F.regexp_replace("path", r"[/\\]", "."), r"\.(py|js|ts|jsx|tsx)$", "")
    last = F.substring_index(module, ".", -1)
    wanted, as_path = F.col("target"), F.replace(F.col("target"), F.lit("."), F.lit("/"))
    names = files.select("path", F.explode(F.array(F.concat(F.lit("f:"), "path"), F.concat(F.lit("m:"), module), F.when(F.length(last) > 2, F.concat(F.lit("l:"), last)))).alias("name")).filter("name IS NOT NULL")
    known = names.groupBy("name").agg(F.min("path").alias("found"))
    tail = F.substring_index(wanted, ".", -1)
    tries = [F.concat(F.lit("f:"), wanted), F.concat(F.lit("m:"), wanted), F.concat(F.lit("l:"), wanted), *[F.concat(F.lit("f:"), as_path, F.lit(end)) for end in (".py", "/__init__.py", ".ts", ".js")], F.concat(F.lit("m:"), tail), F.concat(F.lit("l:"), tail)]
    return imports.select("import_id").join(first_match(imports, "import_id", tries, known, "name", "found"), "import_id", "left").withColumnRenamed("found", "target")


def related_events(events: DataFrame, key: str, group: str, most: int = 4) -> DataFrame:
    """Edges from the first event of each group to the next ``most``."""
    few = _first_of_each(events.select(key, group), group, [key], most + 1)
    first = few.groupBy(group).agg(F.min(key).alias("src"))
    return few.join(first, group).filter(F.col(key) != F.col("src")).select("src", F.col(key).alias("dst"), group)


def type_usage(activations: DataFrame, group: str, node: str, useful: Column) -> DataFrame:
    """Nodes, activations, their share of all and how many of them were useful, for each type."""
    counted = activations.groupBy(group).agg(F.countDistinct(node).alias("nodes"), F.count("*").alias("activations"), F.count_if(useful).alias("useful"))
    whole = counted.agg(F.sum("activations").alias("whole"))
    return counted.crossJoin(F.broadcast(whole)).select(group, "nodes", "activations", (F.col("activations") / F.col("whole")).alias("share"), (F.col("useful") / F.col("activations")).alias("usefulness"))


def coactivation(patterns: DataFrame, group: str, pattern: str, least: float) -> DataFrame:
    """Pairs of types by the share of patterns in common of the one with fewer. ``group`` has a handful of values, so a pattern has a handful of rows."""
    once = patterns.select(group, pattern).distinct()
    sizes = once.groupBy(group).agg(F.count("*").alias("n"))
    a, b = (once.select(pattern, F.col(group).alias(side)) for side in ("a", "b"))
    shared = a.join(b, pattern).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = shared.join(sizes.select(F.col(group).alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col(group).alias("b"), F.col("n").alias("n_b")), "b")
    return sized.withColumn("overlap", F.col("shared") / F.least("n_a", "n_b")).filter(F.col("overlap") >= least).select("a", "b", "shared", "overlap")


def smoothed(records: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential moving average in order, begun with the first value. Its closed form is a sum of weighted values, so no list of a key's values is held."""
    spec = Window.partitionBy(key)
    place = records.select(key, value, (F.row_number().over(spec.orderBy(*[F.desc(c) for c in order])) - 1).alias("age"), F.count("*").over(spec).alias("n"))
    weight = F.when(F.col("age") == F.col("n") - 1, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(1 - alpha), F.col("age"))
    return place.groupBy(key).agg(F.sum(weight * F.col(value)).alias("average"), F.count("*").alias("n"))


def ambiguous(messages: DataFrame, key: str, node: str, confidence: str, near: float, least: float, most: int) -> DataFrame:
    """The best options of each key whose two best are close and both good enough; no rows for others."""
    spec = Window.partitionBy(key)
    top = messages.withColumn("option", F.row_number().over(spec.orderBy(F.desc(confidence), node))).filter(F.col("option") <= most)
    first, second = (F.max(F.when(F.col("option") == k, F.col(confidence))).over(spec) for k in (1, 2))
    return top.withColumns({"__1": first, "__2": second}).filter((F.col("__1") - F.col("__2") <= near) & (F.col("__2") >= least)).select(key, "option", node, confidence)


def fingerprint(records: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a table that does not depend on the order of its rows: the sum of their hashes, which needs no sort."""
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 12), 16, 10).cast("decimal(20,0)")
    return records.agg(F.count("*").alias("n"), F.sum(hashed).cast("string").alias("digest"))


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def component(word: Column, dim: int) -> Column:
    """The component of a hashed vector that a word counts in."""
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % dim).cast("int")


def bag_vectors(records: DataFrame, key: str, text: str, dim: int = 128) -> DataFrame:
    """(key, dim, value): hashed words weighted by one over their place, scaled to length one; zero components have no row."""
    placed = records.select(key, F.posexplode(words(F.col(text))).alias("at", "word"))
    sums = placed.groupBy(key, component(F.col("word"), dim).alias("dim")).agg(F.sum(1.0 / (F.col("at") + 1)).alias("w"))
    return sums.select(key, "dim", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("value"))


def fuse(hits: DataFrame, authority: dict[str, float], threshold: float = 1.0, least_share: float = 0.1) -> DataFrame:
    """Federated hits of each query, fused: z-score in a graph, reciprocal rank, authority, near-duplicates of other graphs
    dropped, conflicts flagged, rare graphs raised, ranks from 0.

    ``hits``: query_id, kg_id, node_id, node_type, description, embedding (may be null), score. All hits take part. A hit goes or
    stays by what better ones of its query stayed (``greedy.diverse``).
    A null score counts as 0; z-scores may be negative, and are multiplied as they are. Ties go to the smaller graph and node.
    """
    by_graph = Window.partitionBy("query_id", "kg_id")
    placed = hits.withColumn("score", F.coalesce("score", F.lit(0.0)).cast(DOUBLE)).withColumn("place", F.row_number().over(by_graph.orderBy(F.desc("score"), "node_id")) - 1)
    spread = F.stddev_pop("score").over(by_graph)
    z = (F.col("score") - F.avg("score").over(by_graph)) / F.when(spread < 1e-8, 1.0).otherwise(spread)
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in authority.items() for x in pair]), F.col("kg_id")), F.lit(1.0)) if authority else F.lit(1.0)
    scored = placed.withColumn("score", (z + 1.0 / (60 + F.col("place"))) * weight)
    kept = diverse(scored, ["query_id"], "kg_id", [F.desc("score"), F.col("kg_id"), F.col("node_id")], "embedding", threshold)
    alike = Window.partitionBy("query_id", "node_type", F.substring("description", 1, 50))
    conflict = F.min("kg_id").over(alike) != F.max("kg_id").over(alike)
    share = F.count("*").over(by_graph) / F.count("*").over(Window.partitionBy("query_id"))
    raised = F.when(share < least_share, F.col("score") * F.least(F.lit(least_share) / (share + 1e-8), F.lit(2.0))).otherwise(F.col("score"))
    final = kept.withColumn("conflict", conflict).withColumn("score", raised)
    return final.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "kg_id", "node_id")) - 1).select("query_id", "kg_id", "node_id", "score", "conflict", "rank")


def _moments(pairs: DataFrame, dim: int, cross: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean difference, and either the cross product of the two sides or the covariance sum of their difference.

    Each partition adds up its own numbers and Spark adds up the partitions'; only dim * dim + dim + 1 numbers reach the driver.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 + dim + dim * dim)
        for rows in batches:
            if len(rows):
                a, b = (np.stack(rows[c].to_list()).astype(float) for c in ("a", "b"))
                d = a - b
                total += np.concatenate([[len(rows)], d.sum(0), (b.T @ a if cross else d.T @ d).ravel()])
        yield pd.DataFrame({"at": np.arange(len(total), dtype=np.int32), "value": total})

    sums = pairs.select("a", "b").mapInPandas(partial, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + dim + dim * dim)
    for row in sums.collect():
        values[row["at"]] = row["value"]
    n = int(values[0])
    return n, values[1 : dim + 1] / max(n, 1), values[dim + 1 :].reshape(dim, dim)


def complete_pairs(pairs: DataFrame, dim: int) -> DataFrame:
    """Pairs with ``dim`` finite numbers on both sides; others take no part."""
    return pairs.filter(" AND ".join(f"size({c}) = {dim} AND forall({c}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))" for c in ("a", "b")))


def diagnose(pairs: DataFrame, dim: int, least: int = 10) -> DataFrame:
    """Why two vector spaces differ: one shift, a few directions, or noise. ``pairs``: a, b (arrays of ``dim`` numbers)."""
    spark, pairs = pairs.sparkSession, complete_pairs(pairs, dim)
    n, mean, squares = _moments(pairs, dim, cross=False)
    schema = "diagnosis string, confidence double, correction string, shift_ratio double, top3 double, pairs long"
    if n < least:
        return spark.createDataFrame([("insufficient_data", 0.0, "none", None, None, n)], schema)
    centre = F.array(*[F.lit(float(x)) for x in mean])
    off = F.zip_with(F.zip_with("a", "b", lambda x, y: x.cast(DOUBLE) - y.cast(DOUBLE)), centre, lambda x, y: x - y)
    spread = pairs.agg(F.avg(F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    ratio = float(np.linalg.norm(mean) / (spread + 1e-8))
    own = np.sort(np.linalg.eigvalsh(squares - n * np.outer(mean, mean)))[::-1]
    top3 = float(own[:3].sum() / own.sum()) if own.sum() > 0 else 0.0
    if ratio > 2.0:
        row = ("systematic_shift", min(1.0, ratio / 5.0), "procrustes")
    elif top3 > 0.70:
        row = ("domain_drift", min(1.0, top3), "augmentation")
    else:
        row = ("random_noise", 0.7, "dual_encoder")
    return spark.createDataFrame([(*row, ratio, top3, n)], schema)


def rotation(pairs: DataFrame, dim: int) -> np.ndarray:
    """The orthogonal map that brings a closest to b. Aggregated in Spark; the driver factors a matrix of dim by dim."""
    u, _, vt = np.linalg.svd(_moments(complete_pairs(pairs, dim), dim, cross=True)[2])
    return u @ vt


def rotate(vectors: DataFrame, column: str, by: np.ndarray) -> DataFrame:
    """``column`` times the map, batch by batch; null stays null."""

    @F.pandas_udf("array<double>")
    def turned(values: pd.Series) -> pd.Series:
        known = values.dropna()
        rows = np.stack(known.tolist()) @ by.T if len(known) else []
        return pd.Series(list(rows), index=known.index, dtype=object).reindex(values.index).map(lambda v: None if v is None or isinstance(v, float) else v)

    return vectors.withColumn(column, turned(column))
