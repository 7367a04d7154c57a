"""Joins, filters, aggregates, windows, ranking and deltas over graph and record tables. Each function takes and returns DataFrames, lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def search_page(nodes: DataFrame, query: str, entity_type: str | None, offset: int, limit: int) -> DataFrame:
    """A page of the nodes whose label, type or description holds the query, whatever the case, in order of id; ``total`` is how many there are on all pages."""
    hit = F.lower(F.concat_ws(" ", "label", "entity_type", "description")).contains(query.lower())
    kept = nodes.filter(hit) if entity_type is None else nodes.filter(hit & (F.col("entity_type") == entity_type))
    total = kept.agg(F.count("*").alias("total"))
    return kept.orderBy("id").offset(offset).limit(limit).withColumn("description", F.substring("description", 1, 300)).crossJoin(F.broadcast(total))


def type_counts(nodes: DataFrame, samples: int = 5) -> DataFrame:
    """Nodes of each type and the first labels in order; only ``samples`` labels of each type reach the last stage."""
    place = F.row_number().over(Window.partitionBy("entity_type", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("label", "id"))
    ranked = nodes.withColumn("place", place)
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("place") <= samples, F.col("label")))), 1, samples)
    return ranked.groupBy("entity_type").agg(F.count("*").alias("n"), F.array_join(first, "|").alias("labels"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree and density of the multigraph."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(F.broadcast(e)).select("nodes", "edges", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("avg_degree"), F.round(F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density"))


def node_context(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Every node with at most ``limit`` of its distinct outgoing neighbours, smallest first; none gives an empty list."""
    place = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
    few = edges.select("src", "dst").distinct().withColumn("place", place).filter(F.col("place") <= limit)
    lists = few.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("dst")), "|").alias("context"))
    return nodes.select("id").join(lists, "id", "left").select("id", F.coalesce("context", F.lit("")).alias("context"))


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the chosen nodes."""
    return edges.join(chosen.select(F.col("id").alias("src")), "src", "left_semi").join(chosen.select(F.col("id").alias("dst")), "dst", "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(missing, n): endpoints that no node has, and on how many edges."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return ends.join(nodes.select("id"), "id", "left_anti").groupBy(F.col("id").alias("missing")).agg(F.count("*").alias("n"))


def shared_types(nodes: DataFrame) -> DataFrame:
    """Types in more than one project: how many projects, and nodes."""
    return nodes.groupBy("entity_type").agg(F.countDistinct("project").alias("projects"), F.count("*").alias("n")).filter("projects > 1")


def projects(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("entity_type").alias("types"))


def token_classes(rows: DataFrame) -> DataFrame:
    """(class_id, set, size, members): distinct token sets, named by the smallest id that has them. Inputs: id, text; rows without a token are left out."""
    sets = rows.select("id", F.array_sort(tokens(F.col("text"))).alias("set")).filter(F.size("set") > 0)
    return sets.groupBy("set").agg(F.min("id").alias("class_id"), F.count("*").alias("members")).select("class_id", "set", F.size("set").alias("size"), "members")


def class_members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(class_id, id): which class each row is in, the one that names it too."""
    return rows.select("id", F.array_sort(tokens(F.col("text"))).alias("set")).join(classes.select("class_id", "set"), "set").select("class_id", "id")


def class_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id, score, links) of classes with token Jaccard of ``least`` or more; ``links``: pairs of members. Inputs: what ``token_classes`` gives.

    Equal texts are one class, so copies cost nothing and the result doesn't grow with the square of their number. Prefix filter: with tokens
    ordered from rare to frequent, a pair that reaches the threshold shares a token in the first ``n - ceil(least * n) + 1`` of each side,
    so frequent tokens make no candidates by themselves.
    """
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    words = both.select("side", "class_id", "size", F.explode("set").alias("token"))
    often = words.groupBy("token").agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy("side", "class_id").orderBy("times", "token"))
    prefix = words.join(often, "token").withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1)
    a = prefix.filter("side = 0").select("token", F.col("class_id").alias("left_id"), F.col("size").alias("ln"))
    b = prefix.filter("side = 1").select("token", F.col("class_id").alias("right_id"), F.col("size").alias("rn"))
    near = a.join(b, "token").filter((F.col("ln") >= least * F.col("rn")) & (F.col("rn") >= least * F.col("ln"))).select("left_id", "right_id").distinct()
    full = near.join(left.select(F.col("class_id").alias("left_id"), F.col("set").alias("x"), F.col("members").alias("nx")), "left_id").join(right.select(F.col("class_id").alias("right_id"), F.col("set").alias("y"), F.col("members").alias("ny")), "right_id")
    shared = F.size(F.array_intersect("x", "y"))
    score = shared / (F.size("x") + F.size("y") - shared)
    return full.select("left_id", "right_id", F.round(score, 4).alias("score"), (F.col("nx") * F.col("ny")).alias("links")).filter(F.col("score") >= least)


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: expected and largest calibration error over equal-width bins (the last one closed), and Brier score. Inputs: confidence, correct."""
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    binned = pairs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"), F.sum(F.pow(F.col("confidence") - F.col("correct"), F.lit(2))).alias("sq"))
    gap = F.abs(F.col("a") - F.col("c"))
    return binned.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def mutual_information(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Mutual information of two columns in bits."""
    cells = pairs.groupBy(x, y).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"))
    full = cells.join(cells.groupBy(x).agg(F.sum("n").alias("nx")), x).join(cells.groupBy(y).agg(F.sum("n").alias("ny")), y).crossJoin(F.broadcast(total))
    return full.agg(F.round(F.sum(F.col("n") / F.col("total") * F.log2(F.col("n") * F.col("total") / (F.col("nx") * F.col("ny")))), 6).alias("bits"))


def day_calendar(events: DataFrame) -> DataFrame:
    """Every day from the first to the last with its number of events and a level of at most 4."""
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return span.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.least(F.coalesce("n", F.lit(0)), F.lit(4)).alias("level"))


def changes(records: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """How often the value differs from the one before, for each key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return records.withColumn("before", before).groupBy(key).agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col(value))).alias("flips"))


def latest(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last record of each key and how many there are: one aggregation, no sort."""
    rest = [c for c in records.columns if c != key]
    best = records.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), F.count("*").alias("times"))
    return best.select(key, "r.*", "times")


def running_share(records: DataFrame, key: str, order: list[str], hit: str) -> DataFrame:
    """Share of hits so far, record by record."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return records.withColumn("seen", F.count("*").over(so_far)).withColumn("share", F.round(F.sum(F.col(hit).cast("double")).over(so_far) / F.col("seen"), 6))


def budget_prefix(records: DataFrame, key: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Records up to the first one with which the sizes exceed the budget."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("used", total).filter(F.col("used") <= budget)


def zscores(hits: DataFrame, group: str, score: str) -> DataFrame:
    """Scores by their group's mean and population deviation; no deviation gives 0."""
    stats = hits.groupBy(group).agg(F.avg(score).alias("m"), F.stddev_pop(score).alias("sd"))
    return hits.join(stats, group).withColumn("z", F.when(F.col("sd") > 0, (F.col(score) - F.col("m")) / F.col("sd")).otherwise(F.lit(0.0))).drop("m", "sd")


def reciprocal_ranks(hits: DataFrame, group: str, item: str, score: str, k: int = 60, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of all items of each group, or of its best ``depth``; ranks from 0."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item)) - 1
    top = hits.withColumn("place", place)
    top = top if depth is None else top.filter(F.col("place") < depth)
    return top.groupBy(item).agg(F.round(F.sum(1.0 / (k + F.col("place"))), 9).alias("fused"))


def row_hash(columns: list[str]) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 16)


def delta(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, modified or deleted."""
    a = old.select(key, row_hash(columns).alias("was"))
    b = new.select(key, row_hash(columns).alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, key, "full").select(key, kind.alias("change")).filter("change IS NOT NULL")


def graph_changes(old_nodes: DataFrame, new_nodes: DataFrame, old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """(kind, id, change) of nodes (by id) and edges (by ends and relationship) that were added, modified or deleted; all other columns that both sides have are compared."""

    def keyed(edges: DataFrame) -> DataFrame:
        return edges.withColumn("id", F.concat_ws("___", "src", "relationship", "dst")).drop("src", "relationship", "dst")

    def changed(kind: str, a: DataFrame, b: DataFrame) -> DataFrame:
        columns = [c for c in a.columns if c != "id" and c in b.columns]
        return delta(a, b, "id", columns).select(F.lit(kind).alias("kind"), "id", "change")

    return changed("node", old_nodes, new_nodes).unionByName(changed("edge", keyed(old_edges), keyed(new_edges)))


def merge_maps(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Upsert: rows of ``source`` replace those with their key; others stay."""
    return target.join(source.select(key), key, "left_anti").unionByName(source)


def bag_f1(pairs: DataFrame, predicted: str, gold: str, key: str) -> DataFrame:
    """Token-bag F1 and exact match after lower-casing and dropping punctuation and articles. ``key`` is unique."""

    def bag(c: str) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\b(a|an|the)\b", " ")
        return F.array_remove(F.split(F.trim(clean), r"\s+"), "")

    both = pairs.select(key, bag(predicted).alias("p"), bag(gold).alias("g"))
    words = both.select(key, F.explode(F.array(F.struct(F.col("p").alias("words"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("g").alias("words"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s"))
    counted = words.select(key, F.explode("s.words").alias("w"), "s.a", "s.b").groupBy(key, "w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    common = counted.groupBy(key).agg(F.sum(F.least("a", "b")).alias("common"))
    f1 = F.when(F.size("p") + F.size("g") == 0, F.lit(1.0)).otherwise(F.round(2.0 * F.coalesce("common", F.lit(0)) / (F.size("p") + F.size("g")), 6))
    return both.join(common, key, "left").select(key, f1.alias("f1"), (F.col("p") == F.col("g")).cast("int").alias("em"))


def keyword_recall(answers: DataFrame, text: str, keywords: str, key: str) -> DataFrame:
    """Share of the expected keywords (an array) that occur in the text, whatever the case; no keywords give 1."""
    wanted = F.transform(F.coalesce(keywords, F.array().cast("array<string>")), F.lower)
    found = F.filter(wanted, lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))
    return answers.select(key, F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.round(F.size(found) / F.size(wanted), 6)).alias("recall"))


def window_metrics(records: DataFrame, group: Column, value: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one record) and linear 95th percentile."""
    return records.groupBy(group.alias("window")).agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("sd"), F.round(F.percentile(value, 0.95), 6).alias("p95"))


def bounded_rate(records: DataFrame, actor: str, ts: str, limit: int) -> DataFrame:
    """(actor, hour, n) of the hours in which an actor exceeds the limit."""
    return records.groupBy(actor, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def repeated_within(records: DataFrame, keys: list[str], ts: str, order: str, seconds: int) -> DataFrame:
    """Records that follow one with equal keys within so many seconds."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts, order))
    return records.withColumn("gap", F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))).filter(F.col("gap") <= seconds * 1_000_000).drop("gap")


def sequences(records: DataFrame, actor: str, order: list[str], step: str) -> DataFrame:
    """(from, to, n): how often a step directly follows another."""
    after = F.lead(step).over(Window.partitionBy(actor).orderBy(*order))
    return records.select(F.col(step).alias("from_step"), after.alias("to_step")).filter("to_step IS NOT NULL").groupBy("from_step", "to_step").agg(F.count("*").alias("n"))
