"""Reports: risk, coverage, drift, conflicts between deltas, observer checks. Functions take and return DataFrames, lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def module_risk(modules: DataFrame, weights: dict[str, tuple[float, float]], levels: list[tuple[float, str]], lowest: str) -> DataFrame:
    """Adds risk_score (3 places) and risk_level, which the score before rounding decides.

    ``weights``: for each column its weight and the value from which it counts in full; ``levels``: least score and name, highest first. Neither has a
    default: they are the user's to choose.
    """
    parts = [F.lit(weight) * F.least(F.col(column) / F.lit(full), F.lit(1.0)) for column, (weight, full) in weights.items()]
    level = F.lit(lowest)
    for least, name in reversed(levels):
        level = F.when(F.col("_s") >= least, name).otherwise(level)
    return modules.withColumn("_s", F.least(F.lit(1.0), sum(parts[1:], parts[0]))).withColumn("risk_level", level).withColumn("risk_score", F.round("_s", 3)).drop("_s")


def coverage(records: DataFrame, chunk_ok: Column, edge_ok: Column) -> DataFrame:
    """One row: shares of records that hold (100 for none, one place) and a status."""
    chunks, edges = (F.coalesce(F.try_divide(F.count_if(c) * 100.0, F.count("*")), F.lit(100.0)) for c in (chunk_ok, edge_ok))
    both = records.agg(F.count("*").alias("n"), F.round(chunks, 1).alias("chunk_coverage"), F.round(edges, 1).alias("edge_coverage"))
    status = F.when((F.col("chunk_coverage") >= 95) & (F.col("edge_coverage") >= 99), "HEALTHY").when((F.col("chunk_coverage") >= 80) & (F.col("edge_coverage") >= 95), "WARNING").otherwise("CRITICAL")
    return both.withColumn("status", status)


def graph_quality(nodes: DataFrame) -> DataFrame:
    """One row: share of descriptions over 20 characters, share with chunks, mean description length, score of at most 100. Inputs: description, chunks."""
    n = F.nullif(F.count("*"), F.lit(0))
    described, chunked, mean = F.count_if(F.length("description") > 20) * 100.0 / n, F.count_if(F.col("chunks") > 0) * 100.0 / n, F.avg(F.length(F.coalesce("description", F.lit(""))))
    score = F.floor(0.4 * F.col("described") + 0.4 * F.col("chunked") + 20 * F.least(F.col("mean_length"), F.lit(200.0)) / 200)
    parts = nodes.agg(described.alias("described"), chunked.alias("chunked"), mean.alias("mean_length"))
    return parts.select(F.round("described", 3).alias("described"), F.round("chunked", 3).alias("chunked"), F.round("mean_length", 3).alias("mean_length"), F.least(score, F.lit(100)).cast("long").alias("score"))


def shares(records: DataFrame, group: Column) -> DataFrame:
    """(project, n, share): records of each group and their percentage of all."""
    counted = records.groupBy(group.alias("project")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.crossJoin(F.broadcast(total)).select("project", "n", F.round(F.col("n") * 100.0 / F.col("_all"), 3).alias("share"))


def saved_tokens(records: DataFrame, group: str, returned: str, without: int = 25_000) -> DataFrame:
    """What answers saved against loading everything, never below zero."""
    return records.groupBy(group).agg(F.count("*").alias("n"), F.round(F.sum(F.greatest(F.lit(float(without)) - F.col(returned), F.lit(0.0))), 2).alias("saved"))


def drift(records: DataFrame, group: str, value: str, mean: float, deviation: float, alert: float) -> DataFrame:
    """Mean and sample deviation (0 for one record), drift from a baseline in its deviations (null without one) and whether it alerts."""
    stats = records.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    far = (F.col("m") - mean) / F.when(F.lit(deviation) > 0, F.lit(deviation))
    return stats.select(group, "n", F.round("m", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(far, 6).alias("drift"), F.coalesce(F.abs(far) >= alert, F.lit(False)).alias("alert"))


def jumps(records: DataFrame, key: str, order: list[str], value: str, least: float) -> DataFrame:
    """Records whose value rose or fell by more than ``least`` since the one before: adds change and kind."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return records.withColumn("change", F.round(step, 6)).filter(F.abs("change") > least).withColumn("kind", F.when(F.col("change") > 0, "spike").otherwise("drop"))


def stagnation(records: DataFrame, key: str, round_: str, value: str, close: float = 0.02, enough: float = 0.7) -> DataFrame:
    """Rounds whose mean moved by less than ``close`` while below ``enough``."""
    means = records.groupBy(key, round_).agg(F.avg(value).alias("m"))
    step = F.abs(F.col("m") - F.lag("m").over(Window.partitionBy(key).orderBy(round_)))
    return means.withColumn("step", step).filter((F.col("step") < close) & (F.col("m") < enough)).select(key, round_, F.round("m", 6).alias("mean"))


def dominance(records: DataFrame, key: str, value: str, margin: float = 0.25) -> DataFrame:
    """Groups of more than two whose largest value stands over their mean by more than ``margin``."""
    stats = records.groupBy(key).agg(F.count(value).alias("n"), F.max(value).alias("top"), F.avg(value).alias("m"))
    return stats.filter((F.col("n") > 2) & (F.col("top") > F.col("m") + margin)).select(key, "n", F.round("top", 6).alias("top"))


def workflow_patterns(steps: DataFrame, session: list[str], order: list[str], step: str, actor: str, least: int = 3) -> DataFrame:
    """(pattern, sessions, actors): equal step sequences of two or more steps that so many actors show. A session's steps make one array."""
    one = steps.groupBy(*session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, step))), lambda s: s[step]), ">").alias("pattern"), F.count("*").alias("length"))
    return one.filter("length >= 2").groupBy("pattern").agg(F.count("*").alias("sessions"), F.countDistinct(actor).alias("actors")).filter(F.col("actors") >= least)


def by_first_segment(files: DataFrame, path: Column, size: str) -> DataFrame:
    """(segment, n, largest, total) by the first segment of the paths."""
    return files.groupBy(F.split_part(path, F.lit("/"), F.lit(1)).alias("segment")).agg(F.count("*").alias("n"), F.max(size).alias("largest"), F.sum(size).alias("total"))


def stale(manifest: DataFrame, current: DataFrame, key: str, stamp: list[str]) -> DataFrame:
    """(key, state): new, changed (any stamp differs) or removed against the manifest."""
    was, now = F.struct(*stamp), F.struct(*stamp)
    both = manifest.select(key, was.alias("was")).join(current.select(key, now.alias("now")), key, "full")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return both.select(key, state.alias("state")).filter("state IS NOT NULL")


def delta_conflicts(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """(key, conflict): both modified, or modified here and deleted there - not the reverse. Inputs: key, change."""
    both = local.filter("change = 'modified'").select(key).join(remote.filter("change IN ('modified', 'deleted')").select(key, "change"), key)
    return both.select(key, F.when(F.col("change") == "modified", "both_modified").otherwise("deleted_remotely").alias("conflict"))


def resolve_conflicts(versions: DataFrame, key: str, priority: str, updated: str, value: str) -> DataFrame:
    """The version of the source with the largest priority, then the latest one; ``settled`` is false where two versions tie with different values."""
    rank = F.struct(priority, updated)
    best = versions.groupBy(key).agg(F.max_by(F.struct(priority, updated), rank).alias("best"))
    top = versions.join(best, key).filter(F.struct(priority, updated).eqNullSafe(F.col("best")))
    return top.groupBy(key).agg(F.min(value).alias(value), (F.min(value).eqNullSafe(F.max(value))).alias("settled"))


def dominant(hits: DataFrame, group: str, kind: str) -> DataFrame:
    """(group, n, kind): hits of each group and their most frequent kind, on a tie the smallest."""
    counted = hits.groupBy(group, kind).agg(F.count("*").alias("_n"))
    return counted.groupBy(group).agg(F.sum("_n").alias("n"), F.min_by(kind, F.struct((-F.col("_n")).alias("x"), F.col(kind))).alias(kind))


def at_least(records: DataFrame, level: str, order: list[str], least: str) -> DataFrame:
    """Records whose level stands at or after ``least`` in ``order``; unknown levels go."""
    return records.filter(F.col(level).isin(order[order.index(least) :]))


def cleared(records: DataFrame, level: Column, viewer: int, value: str, notice: str) -> DataFrame:
    """All records; the value of one above the viewer's level is replaced by a notice."""
    return records.withColumn(value, F.when(level > viewer, F.lit(notice)).otherwise(F.col(value)))


def governed_yield(tasks: DataFrame, group: str) -> DataFrame:
    """Weight of completed tasks by the weight of completed, isolated and gate tasks (0 without any). Inputs: status, weight, is_gate."""
    done = F.sum(F.when(F.col("status") == "completed", F.col("weight")).otherwise(0.0))
    base = F.sum(F.when(F.col("status").isin("completed", "isolated") | F.col("is_gate"), F.col("weight")).otherwise(0.0))
    return tasks.groupBy(group).agg(F.round(F.coalesce(F.try_divide(done, base), F.lit(0.0)), 6).alias("governed_yield"))


def alignment(pairs: DataFrame, tiers: list[tuple[str, float]]) -> DataFrame:
    """One row over ``score``: n, mean, median, population deviation, and how many reach each tier (a bound belongs to the better tier)."""
    bounds, counts = F.lit(False), []
    for name, least in tiers:
        reached = (F.col("score") >= least) & ~bounds
        counts.append(F.count_if(reached).alias(name))
        bounds = bounds | (F.col("score") >= least)
    return pairs.agg(F.count("score").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", 0.5), 6).alias("median"), F.round(F.stddev_pop("score"), 6).alias("sd"), *counts)


def step_profile(steps: DataFrame, key: str, order: list[str], size: str, kind: str) -> DataFrame:
    """Each run's steps, total and largest size, its bottleneck (the first step of the largest size) and the kind of its last step."""
    return steps.groupBy(key).agg(
        F.count("*").alias("steps"),
        F.sum(size).alias("total"),
        F.max(size).alias("largest"),
        F.min_by(order[0], F.struct((-F.col(size)).alias("x"), *order)).alias("bottleneck"),
        F.max_by(kind, F.struct(*order, kind)).alias("last_kind"),
    )
