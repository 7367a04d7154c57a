"""Nodes and edges out of files, turns and records; sessions, gates and evaluation. Functions take and return DataFrames, lazily."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import glob_pattern

#: HTTP methods of an API description, and the groups of a manifest that list dependencies.
METHODS = ("get", "put", "post", "delete", "patch", "head", "options")
GROUPS = ("dependencies", "devDependencies", "peerDependencies")
#: Languages by the endings of their files.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby"}


def discovered(files: DataFrame, path: str, endings: list[str], excludes: list[str], limit: int | None = None) -> DataFrame:
    """Files with one of the endings that no glob excludes, in order of path, ``limit`` at most."""
    kept = files.filter(F.lower(path).rlike(r"\.(" + "|".join(map(re.escape, endings)) + ")$"))
    for glob in excludes:
        kept = kept.filter(~F.col(path).rlike(glob_pattern(glob)))
    return kept if limit is None else kept.orderBy(path).limit(limit)


def language_of(path: Column) -> Column:
    """Language by the file's ending; others are unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("unknown"))


def manifest_edges(files: DataFrame, path: str, text: str) -> DataFrame:
    """(src, dst, relationship, version): what each manifest depends on. Text that isn't JSON, or has no such group, gives no rows."""
    parts = [F.from_json(F.get_json_object(text, f"$.{g}"), "map<string,string>") for g in GROUPS]
    rows = files.select(F.col(path).alias("src"), F.explode(F.array(*[F.struct(F.lit(g).alias("g"), p.alias("m")) for g, p in zip(GROUPS, parts)])).alias("p"))
    return rows.select("src", F.explode("p.m").alias("name", "version")).select("src", F.concat(F.lit("dep:"), "name").alias("dst"), F.lit("DEPENDS_ON").alias("relationship"), "version").distinct()


def endpoints(files: DataFrame, path: str, text: str) -> DataFrame:
    """(id, method, route): the endpoints of API descriptions, by the paths and methods they list."""
    routes = files.select(F.col(path).alias("file"), F.explode(F.from_json(F.get_json_object(text, "$.paths"), "map<string,map<string,string>>")).alias("route", "methods"))
    return routes.select("file", "route", F.explode(F.map_keys("methods")).alias("method")).filter(F.lower("method").isin(*METHODS)).select(F.concat_ws(" ", F.upper("method"), "route").alias("id"), F.upper("method").alias("method"), "route").distinct()


def session_graph(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of conversations: a node for each turn, an edge to the next one. Inputs: conv_id, turn, role, text."""
    name = F.concat(F.lit("turn:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string"))
    nodes = turns.select(name.alias("id"), F.initcap(F.coalesce("role", F.lit("unknown"))).alias("label"), F.lit("TURN").alias("entity_type"), F.substring(F.coalesce("text", F.lit("")), 1, 100).alias("description"))
    after = F.lead(name).over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    edges = turns.select(name.alias("src"), after.alias("dst"), F.lit("NEXT").alias("relationship")).filter("dst IS NOT NULL")
    return nodes, edges


def seeded(goals: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a new graph: goals and sources as nodes, an edge from each source to the goals it is for. Inputs: goal, title; source, title, goal."""
    a = goals.select(F.concat(F.lit("goal:"), F.col("goal").cast("string")).alias("id"), F.col("title").alias("label"), F.lit("GOAL").alias("entity_type"))
    b = sources.select(F.concat(F.lit("source:"), F.col("source").cast("string")).alias("id"), F.col("title").alias("label"), F.lit("SOURCE").alias("entity_type")).distinct()
    edges = sources.join(goals.select("goal"), "goal", "left_semi").select(F.concat(F.lit("source:"), F.col("source").cast("string")).alias("src"), F.concat(F.lit("goal:"), F.col("goal").cast("string")).alias("dst"), F.lit("SUPPORTS").alias("relationship")).distinct()
    return a.unionByName(b), edges


def repeated_keys(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one record has, or that lack a part, with their number: what a uniqueness constraint would refuse."""
    lacking = F.lit(False)
    for k in keys:
        lacking = lacking | F.col(k).isNull()
    return records.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | lacking)


def streaks(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, streak, longest): days in a row up to the last one of all keys - a key may lack that very day - and the longest run."""
    once = days.select(key, F.col(day).alias("d")).distinct()
    runs = once.withColumn("g", F.date_sub("d", F.row_number().over(Window.partitionBy(key).orderBy("d")).cast("int")))
    sized = runs.groupBy(key, "g").agg(F.count("*").alias("n"), F.max("d").alias("end"))
    last = once.agg(F.max("d").alias("last"))
    now = F.max(F.when(F.date_diff("last", "end") <= 1, F.col("n")))
    return sized.crossJoin(F.broadcast(last)).groupBy(key).agg(F.coalesce(now, F.lit(0)).alias("streak"), F.max("n").alias("longest"))


def topk_accuracy(predictions: DataFrame, ranked: str, gold: str, ks: list[int]) -> DataFrame:
    """One row: share of records whose gold value is among the first k predictions, for each k."""
    return predictions.agg(*[F.round(F.avg(F.array_contains(F.slice(ranked, 1, k), F.col(gold)).cast("double")), 6).alias(f"top{k}") for k in ks])


def cold_start(records: DataFrame, key: str, order: list[str], hit: str, first: int) -> DataFrame:
    """(key, early, late): share of hits among the first records of each key, and among the others (null without any)."""
    placed = records.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    share = lambda cond: F.round(F.avg(F.when(cond, F.col(hit).cast("double"))), 6)
    return placed.groupBy(key).agg(share(F.col("_k") <= first).alias("early"), share(F.col("_k") > first).alias("late"))


def bootstrap_interval(records: DataFrame, group: Column, value: str, key: str, rounds: int = 200, share: float = 0.95) -> DataFrame:
    """(bin, mean, low, high): the mean of each bin and the interval that ``share`` of its resampled means lie in.

    Poisson bootstrap: a record counts 0, 1, 2, ... times in a round, by a hash of its key and the round, so the result is the same on every run; sums of a bin and round are all that is shuffled.
    """
    unit = (F.pmod(F.xxhash64(F.col(key), F.col("round")), F.lit(1 << 30)) + 0.5) / (1 << 30)
    times, total, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        total += p
        times = times + (unit > total).cast("int")
        p /= k
    rows = records.select(group.alias("bin"), F.col(value).cast("double").alias("v"), key, F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("times", times)
    means = rows.groupBy("bin", "round").agg((F.sum(F.col("v") * F.col("times")) / F.nullif(F.sum("times"), F.lit(0))).alias("m"))
    low, high = (1 - share) / 2, (1 + share) / 2
    spread = means.groupBy("bin").agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))
    return records.groupBy(group.alias("bin")).agg(F.avg(F.col(value).cast("double")).alias("mean")).join(spread, "bin")


def gate(records: DataFrame, rules: list[tuple[str, Column]], default: str) -> DataFrame:
    """Adds ``decision``: that of the first rule that holds. Conditions that are null don't hold."""
    told = F.lit(default)
    for decision, holds in reversed(rules):
        told = F.when(F.coalesce(holds, F.lit(False)), decision).otherwise(told)
    return records.withColumn("decision", told)


def guarded_text(records: DataFrame, text: str, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Adds ``level`` (the highest of the rules found, 0 without one) and ``clean``: matches of (name, pattern, level) replaced by ``[NAME]``, rule after rule."""
    body = F.coalesce(F.col(text), F.lit(""))
    level = F.greatest(F.lit(0), *[F.when(body.rlike(p), n).otherwise(0) for _, p, n in rules])
    clean = body
    for name, pattern, _ in rules:
        clean = F.regexp_replace(clean, pattern, f"[{name.upper()}]")
    return records.withColumns({"level": level, "clean": clean})


def latest_state(events: DataFrame, key: str, order: list[str], state: str, final: list[str]) -> DataFrame:
    """(key, state, changes, reopened): the last state of each key, how often it changed, and whether it left a final state."""
    by = Window.partitionBy(key).orderBy(*order)
    before = F.lag(state).over(by)
    told = events.select(key, F.struct(*order).alias("_o"), F.col(state).alias("state"), before.alias("_b"))
    left = F.col("_b").isin(final) & (F.col("state") != F.col("_b"))
    return told.groupBy(key).agg(F.max_by("state", "_o").alias("state"), F.count_if(F.col("_b").isNotNull() & (F.col("_b") != F.col("state"))).alias("changes"), F.coalesce(F.bool_or(left), F.lit(False)).alias("reopened"))
