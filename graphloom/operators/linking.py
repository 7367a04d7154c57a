"""Linking and merging of entities: equi joins on derived keys, cascaded lookups, contradictions and rewiring. Functions take and return DataFrames, lazily."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_tokens, name_variants, normalised


def exact_bridge(left: DataFrame, right: DataFrame, key: Column, confidence: float = 0.9) -> DataFrame:
    """(left_id, right_id, confidence) of equal keys that are not empty. Inputs: id and what ``key`` reads."""
    a = left.select(F.col("id").alias("left_id"), key.alias("k")).filter("k <> ''")
    b = right.select(F.col("id").alias("right_id"), key.alias("k")).filter("k <> ''")
    return a.join(b, "k").select("left_id", "right_id", F.lit(confidence).alias("confidence"))


def unmatched(left: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rows of ``left`` (id) without an accepted exact match (left_id): those that token overlap asks about."""
    return left.join(accepted.select(F.col("left_id").alias("id")), "id", "left_anti")


def reconcile(candidates: DataFrame, key: str, confidence: str, priority: str, source: str) -> DataFrame:
    """The best candidate of each key: largest confidence, then smallest priority, then smallest source. One aggregation, no sort."""
    order = F.struct((-F.col(confidence)).alias("c"), F.col(priority).alias("p"), F.col(source).alias("s"))
    return candidates.groupBy(key).agg(F.min_by(F.struct(confidence, priority, source), order).alias("best")).select(key, "best.*")


def unify(entities: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(primary, secondary, confidence) of entities from different sources that share a name variant. Inputs: id, label, source_type.

    The confidence is the number of shared variants by the smaller number of variants; the source with the smaller rank is primary (unknown
    sources: 10), on a tie the smaller id. Of equal (label, source) rows the one with the smallest id takes part, so a hot label joins once.
    """
    named = entities.groupBy("label", "source_type").agg(F.min("id").alias("id")).withColumn("variants", name_variants(F.col("label")))
    keyed = named.select("id", "source_type", F.size("variants").alias("n"), F.explode("variants").alias("variant"))
    a = keyed.select("variant", F.col("id").alias("a"), F.col("source_type").alias("ta"), F.col("n").alias("na"))
    b = keyed.select("variant", F.col("id").alias("b"), F.col("source_type").alias("tb"), F.col("n").alias("nb"))
    shared = a.join(b, "variant").filter("a < b AND ta <> tb").groupBy("a", "b", "ta", "tb", "na", "nb").agg(F.count("*").alias("n"))
    place = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])

    def rank(c: str) -> Column:
        return F.coalesce(F.try_element_at(place, F.col(c)), F.lit(10))

    first = rank("ta") <= rank("tb")
    return shared.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("primary"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("secondary"), F.round(F.col("n") / F.least("na", "nb"), 4).alias("confidence"))


def copies(entities: DataFrame) -> DataFrame:
    """(representative, id) of each further entity of a (label, source): what ``unify`` says of the representative holds for it."""
    first = entities.groupBy("label", "source_type").agg(F.min("id").alias("representative"))
    return entities.filter("label IS NOT NULL").join(first, ["label", "source_type"]).filter("id <> representative").select("representative", "id")


def contradictions(facts: DataFrame, longest: int = 100) -> DataFrame:
    """Different values of one property under one label in two source types. Inputs: label, source_type, key, value (strings).

    Values that both read as numbers are compared as numbers, others as short strings without regard to case. Only distinct values are joined,
    so copies of a fact cost nothing. Labels shorter than three characters take no part.
    """
    known = facts.select(F.lower(F.trim("label")).alias("label"), "source_type", "key", "value").filter("length(label) >= 3 AND value IS NOT NULL").distinct()
    a = known.select("label", "key", F.col("source_type").alias("source_a"), F.col("value").alias("value_a"))
    b = known.select("label", "key", F.col("source_type").alias("source_b"), F.col("value").alias("value_b"))
    x, y = F.col("value_a").try_cast("double"), F.col("value_b").try_cast("double")
    short = (F.length("value_a") < longest) & (F.length("value_b") < longest) & (F.lower("value_a") != F.lower("value_b"))
    kind = F.when(x.isNotNull() & y.isNotNull(), F.when(x != y, "numeric_mismatch")).when(short, "value_mismatch")
    return a.join(b, ["label", "key"]).filter("source_a < source_b").withColumn("type", kind).filter("type IS NOT NULL")


def similar_names(entities: DataFrame, stop: list[str], cap: int = 3, least: int = 2) -> DataFrame:
    """(src, dst, shared) of entities in different projects with ``least`` or more common tokens of four letters. Inputs: id, project, label.

    As a definition, only the first ``cap`` ids of a project stand for a token, which also bounds the join.
    """
    words = entities.select("id", "project", F.explode(F.array_distinct(name_tokens(F.col("label")))).alias("token")).filter((F.length("token") >= 4) & ~F.col("token").isin(stop))
    # Salted first, so that a project with one very frequent token is ranked by many tasks.
    salted = Window.partitionBy("project", "token", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("project", "token").orderBy("id")
    few = words.withColumn("k", F.row_number().over(salted)).filter(F.col("k") <= cap).withColumn("k", F.row_number().over(whole)).filter(F.col("k") <= cap)
    a = few.select("token", F.col("project").alias("pa"), F.col("id").alias("src"))
    b = few.select("token", F.col("project").alias("pb"), F.col("id").alias("dst"))
    return a.join(b, "token").filter("pa < pb").groupBy("src", "dst").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def shared_labels(entities: DataFrame, known: DataFrame) -> DataFrame:
    """(label, src, dst): the first entity of a label in each project, joined across projects; pairs in ``known`` (src, dst) are left out."""
    one = entities.groupBy("project", "label").agg(F.min("id").alias("id"))
    a = one.select("label", F.col("project").alias("pa"), F.col("id").alias("src"))
    b = one.select("label", F.col("project").alias("pb"), F.col("id").alias("dst"))
    return a.join(b, "label").filter("pa < pb").select("label", "src", "dst").join(known, ["src", "dst"], "left_anti")


def link_paths(texts: DataFrame, endpoints: DataFrame, pattern: str) -> DataFrame:
    """Distinct (src, dst): every path that the pattern finds in a text, joined to its endpoint. Inputs: id, text; id, path."""
    called = texts.select(F.col("id").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("path"))
    return called.join(endpoints.select(F.col("id").alias("dst"), "path"), "path").select("src", "dst").distinct()


def resolve(references: DataFrame, ref: str, known: DataFrame, aliases: DataFrame, prefix: str) -> DataFrame:
    """Cascaded lookup: the reference itself, without its prefix, by alias, else unresolved. ``known``: id; ``aliases``: alias, id (unique).

    Only the first way that succeeds counts; adds target and how.
    """
    names = known.select("id").distinct()
    bare = F.regexp_replace(F.col(ref), f"^{prefix}", "")
    found = (
        references.withColumn("_bare", bare)
        .join(names.select(F.col("id").alias("_d")), F.col(ref) == F.col("_d"), "left")
        .join(names.select(F.col("id").alias("_p")), F.col("_bare") == F.col("_p"), "left")
        .join(aliases.select(F.col("alias").alias("_a"), F.col("id").alias("_t")), F.col(ref) == F.col("_a"), "left")
    )
    how = F.when(F.col("_d").isNotNull(), "direct").when(F.col("_p").isNotNull(), "prefix").when(F.col("_t").isNotNull(), "alias").otherwise("unresolved")
    return found.withColumn("target", F.coalesce("_d", "_p", "_t")).withColumn("how", how).drop("_bare", "_d", "_p", "_a", "_t")


def canonical_keepers(records: DataFrame, key: Column, order: str) -> DataFrame:
    """Each record's canonical id (16 hexadecimal digits of SHA-256; null where the key is null) and the first record that has it."""
    named = records.withColumn("canonical", F.substring(F.sha2(key, 256), 1, 16))
    first = named.filter("canonical IS NOT NULL").groupBy("canonical").agg(F.min(order).alias("keeper"))
    return named.join(first, "canonical", "left").withColumn("keeper", F.coalesce("keeper", order))


def merge_records(records: DataFrame, key: str, rank: str, fields: list[str], longest: list[str]) -> DataFrame:
    """One record of each key: every field from the best rank that has a value, and the longest value of ``longest`` (ties: smallest)."""
    best = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(rank, f))).alias(f) for f in fields]
    long = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct((-F.length(f)).alias("n"), F.col(f)))).alias(f) for f in longest]
    return records.groupBy(key).agg(*best, *long, F.count("*").alias("merged"))


def rewire(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``mapping`` (id, keeper); loops that arise go, and equal edges become one."""
    a, b = mapping.select(F.col("id").alias("src"), F.col("keeper").alias("_s")), mapping.select(F.col("id").alias("dst"), F.col("keeper").alias("_d"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), "relationship", (F.col("_s").isNotNull() | F.col("_d").isNotNull()).alias("_moved"))
    return moved.filter(~F.col("_moved") | (F.col("src") != F.col("dst"))).select("src", "dst", "relationship").distinct()


def merge_projects(projects: list[tuple[str, DataFrame]]) -> DataFrame:
    """Nodes of all projects: ids without ``/`` get their project's name before them; of equal ids the last project's row stays."""
    parts = [df.withColumn("id", F.when(F.col("id").contains("/"), F.col("id")).otherwise(F.concat(F.lit(f"{name}/"), F.col("id")))).withColumn("source_project", F.lit(name)).withColumn("_k", F.lit(k)) for k, (name, df) in enumerate(projects)]
    both = reduce(DataFrame.unionByName, parts)
    rest = [c for c in both.columns if c not in ("id", "_k")]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), "_k").alias("r")).select("id", "r.*")


def validate(nodes: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(id, rule): nodes of a type that break a rule. ``rules``: type, name, condition that must hold (null counts as broken). One pass."""
    broken = [F.when((F.col("entity_type") == kind) & ~F.coalesce(holds, F.lit(False)), F.lit(name)) for kind, name, holds in rules]
    return nodes.select("id", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def validate_edges(edges: DataFrame, nodes: DataFrame, shapes: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """(src, dst, relationship, problem): a missing end, or an end whose type the relationship's shape doesn't allow; one without a shape passes."""
    types = nodes.select("id", "entity_type")
    typed = edges.join(types.select(F.col("id").alias("src"), F.col("entity_type").alias("_s")), "src", "left").join(types.select(F.col("id").alias("dst"), F.col("entity_type").alias("_d")), "dst", "left")
    problem = F.when(F.col("_s").isNull(), "missing_source").when(F.col("_d").isNull(), "missing_target")
    for name, (sources, targets) in shapes.items():
        problem = problem.when((F.col("relationship") == name) & ~F.col("_s").isin(sources), "source_type").when((F.col("relationship") == name) & ~F.col("_d").isin(targets), "target_type")
    return typed.select("src", "dst", "relationship", problem.alias("problem")).filter("problem IS NOT NULL")


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is zero, null where the lengths differ."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0)))


def vector_search(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """(parent, score): the best of the ``k`` nearest chunks for each parent. Inputs: id, parent, embedding. The query is one vector."""
    probe = F.array(*[F.lit(float(x)) for x in query])
    near = chunks.select("id", "parent", cosine(F.col("embedding"), probe).alias("score")).filter("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)
    return near.groupBy("parent").agg(F.max("score").alias("score"), F.count("*").alias("hits"))
