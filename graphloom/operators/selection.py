"""Filters, gates and rules over nodes, modules, files and answers. Functions take and return DataFrames, lazily."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of nodes that are lessons, and severities from the gravest on.
LESSON_KINDS = ("LESSON", "MISTAKE", "SAFETY", "ADR", "DECISION")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
#: Parts of keys whose values are hidden, whole keys that are too, and what stands in their place.
SENSITIVE_PARTS = ("password", "secret", "token", "api_key", "apikey", "credential", "private_key", "auth_token", "access_key", "secret_key", "ssn", "pii")
INTERNAL_KEYS = ("_embedding_cache", "_activation_score", "_last_reasoning")
HIDDEN = "[REDACTED]"
#: Fixed value: a file name that so many nodes share says nothing without its path.
COMMON_NAME = 12


def severity_rank(severity: Column) -> Column:
    """0 for the gravest; unknown and missing ones count as medium."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.upper(severity)), F.lit(0)) - 1, F.lit(2)).cast("int")


def lessons(nodes: DataFrame, topic: str, worst: int = 99, limit: int = 50) -> DataFrame:
    """Lessons of rank ``worst`` or graver that hold a word of the topic (all without one): id, severity, score; the gravest first, then the most words, then the smaller id."""
    words = topic.lower().split()
    low = F.lower(F.concat_ws(" ", "id", F.coalesce("label", F.lit("")), F.substring(F.coalesce("description", F.lit("")), 1, 300)))
    score = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) if words else F.lit(1)
    found = nodes.filter(F.upper("entity_type").isin(*LESSON_KINDS)).select("id", F.upper(F.coalesce("severity", F.lit("MEDIUM"))).alias("severity"), severity_rank(F.col("severity")).alias("rank"), score.cast("int").alias("score"))
    return found.filter((F.col("rank") <= worst) & (F.col("score") > 0)).orderBy("rank", F.desc("score"), "id").limit(limit)


def module_page(modules: DataFrame, risk: str | None, search: str | None, sort: str, descending: bool, offset: int, limit: int) -> DataFrame:
    """A page of the modules of a risk level whose name holds the text, sorted by one of the known columns (else by risk), then by name."""
    key = sort if sort in ("risk_score", "impact_radius", "consumers", "functions", "module") else "risk_score"
    kept = modules if not risk else modules.filter(F.upper("risk_level") == risk.upper())
    kept = kept if not search else kept.filter(F.lower(F.col("module").cast("string")).contains(search.lower()))
    return kept.orderBy(F.col(key).desc() if descending else F.col(key).asc(), "module").offset(offset).limit(limit)


def missing_citations(messages: DataFrame, nodes: DataFrame, key: str, evidence: str) -> DataFrame:
    """(key, reference): cited nodes that don't exist, once for each message."""
    cited = messages.select(key, F.explode(F.array_distinct(evidence)).alias("reference"))
    return cited.join(nodes.select(F.col("id").alias("reference")), "reference", "left_anti").select(key, "reference")


def named_files(nodes: DataFrame, edges: DataFrame, query: str, most: int = 50) -> DataFrame:
    """(id, matched): nodes of files that the query names, and their neighbours up to ``most`` in all; no rows if it names none.

    A node's file is its id before ``::``. The name must stand between word bounds; one that more than twelve nodes share counts only where the query holds the whole path.
    Matches come first, then neighbours, each in order of id.
    """
    asked = query.lower()
    path = F.lower(F.replace(F.substring_index("id", "::", 1), F.lit("\\"), F.lit("/")))
    named = nodes.select("id", path.alias("path"), F.substring_index(path, "/", -1).alias("name")).filter(F.col("name").rlike(r"\.[a-z0-9]{1,8}$") & (F.length("name") >= 3))
    bound = r"[\s\-/\\,;:\"'()]"
    # The query's own words are few, so names are compared with these rather than searched for.
    words = [w for w in re.split(bound, asked) if w]
    hits = named.filter(F.col("name").isin(words) if words else F.lit(False))
    shared = hits.groupBy("name").agg(F.count("*").alias("n"))
    kept = hits.join(shared, "name").filter((F.col("n") <= COMMON_NAME) | F.contains(F.lit(asked), F.col("path"))).select("id", F.lit(True).alias("matched"))
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select("dst", "src"))
    around = ends.join(kept.select("id"), "id", "left_semi").select(F.col("other").alias("id")).distinct().join(kept.select("id"), "id", "left_anti").withColumn("matched", F.lit(False))
    return kept.unionByName(around).orderBy(F.desc("matched"), "id").limit(most)


def hide_sensitive(records: DataFrame, column: str, parts: tuple[str, ...] = SENSITIVE_PARTS) -> DataFrame:
    """Values of a map whose keys hold a sensitive part, whatever the case, or are internal ones are replaced."""
    bad = lambda k: k.isin(*INTERNAL_KEYS) | F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(F.lower(k), p))
    return records.withColumn(column, F.transform_values(column, lambda k, v: F.when(bad(k), F.lit(HIDDEN)).otherwise(v)))


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression over whole paths."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def first_rule(files: DataFrame, path: str, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """Adds ``rule``: what the first glob that fits says."""
    told = F.lit(default)
    for glob, verdict in reversed(rules):
        told = F.when(F.col(path).rlike(glob_pattern(glob)), verdict).otherwise(told)
    return files.withColumn("rule", told)


def protected(files: DataFrame, path: str, globs: list[str]) -> DataFrame:
    """Adds ``protected``: whether a glob fits the path with forward slashes, without ``./`` before it."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    return files.withColumn("protected", sum((plain.rlike(glob_pattern(g)).cast("int") for g in globs), F.lit(0)) > 0)


def consumers(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, consumer): files that import a file, by its path, its dotted name, or the end of either from a part on. Inputs: consumer, target; path.

    A target is compared with the ends of a file's dotted name, which are as many as the name has parts; an end of one or two characters means nothing.
    """
    dotted = F.replace(F.regexp_replace("path", r"\.(py|js|ts|jsx|tsx)$", ""), F.lit("/"), F.lit("."))
    parts = F.split(dotted, r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    names = files.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.filter(ends, lambda e: F.length(e) > 2))).alias("name"))
    wanted = imports.select("consumer", F.replace(F.regexp_replace("target", r"\.(py|js|ts|jsx|tsx)$", ""), F.lit("/"), F.lit(".")).alias("name"))
    return wanted.join(names, "name").filter("file <> consumer").select("file", "consumer").distinct()


def domain_scores(files: DataFrame, path: str, signals: list[tuple[str, str, float]]) -> DataFrame:
    """(domain, score): the weights of the signals (domain, directory, weight) whose directory some path has, summed."""
    hits = [F.max(F.concat(F.lit("/"), F.col(path)).contains(f"/{directory}/")).alias(f"s{k}") for k, (_, directory, _) in enumerate(signals)]
    found = files.agg(*hits)
    rows = F.array(*[F.struct(F.lit(domain).alias("domain"), F.when(F.col(f"s{k}"), F.lit(weight)).otherwise(0.0).alias("weight")) for k, (domain, _, weight) in enumerate(signals)])
    return found.select(F.explode(rows).alias("r")).groupBy("r.domain").agg(F.round(F.sum("r.weight"), 6).alias("score")).filter("score > 0")


def skill_scores(nodes: DataFrame, text: str, query: str, skills: list[tuple[str, str]], content: float = 3.0, asked: float = 2.0) -> DataFrame:
    """(id, skill, score): patterns (skill, pattern) found in a node's text and in the query, weighted, by the node's largest sum; skills without a hit are left out."""
    rows = F.array(*[F.struct(F.lit(s).alias("skill"), (F.coalesce(F.col(text).rlike(f"(?i){p}"), F.lit(False)).cast("int") * content + F.lit(asked if re.search(p, query, re.I) else 0.0)).alias("w")) for s, p in skills])
    summed = nodes.select("id", F.explode(rows).alias("r")).groupBy("id", "r.skill").agg(F.sum("r.w").alias("w")).filter("w > 0")
    return summed.select("id", "skill", F.round(F.col("w") / F.max("w").over(Window.partitionBy("id")), 6).alias("score"))


def shape_gate(answers: DataFrame, key: str, kind: str, text: str, shapes: dict[str, dict]) -> DataFrame:
    """(key, violations, score) of texts by the shape of their kind; a kind without a shape passes with 1.

    A shape may have ``forbidden`` (strings), ``most_words`` (times 0.7), ``mention`` (lists of strings of which one must occur; times 0.5 each), ``required`` (patterns; times 0.6
    each) and ``least_words``. Null texts are empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low, words = F.lower(body), F.size(F.filter(F.split(body, r"\s+"), lambda w: w != ""))
    broken, score = F.lit(0), F.lit(1.0)
    for name, shape in shapes.items():
        rules = [(F.contains(low, F.lit(f.lower())), 1.0) for f in shape.get("forbidden", ())]
        rules += [(words > shape["most_words"], 0.7)] if "most_words" in shape else []
        rules += [(~F.exists(F.array(*[F.lit(o.lower()) for o in options]), lambda o: F.contains(low, o)), 0.5) for options in shape.get("mention", ())]
        rules += [(~body.rlike(f"(?i){p}"), 0.6) for p in shape.get("required", ())]
        rules += [(words < shape.get("least_words", 10), 1.0)]
        own = F.col(kind) == name
        broken = F.when(own, sum((r.cast("int") for r, _ in rules), F.lit(0))).otherwise(broken)
        product = F.lit(1.0)
        for rule, factor in rules:
            product = product * F.when(rule, F.lit(factor)).otherwise(F.lit(1.0))
        score = F.when(own, product).otherwise(score)
    return answers.select(key, broken.cast("int").alias("violations"), F.round(score, 6).alias("score"))


def balanced(text: Column, opening: str, closing: str) -> Column:
    """Whether brackets of a kind open before they close and all close: a fold over the brackets alone."""
    marks = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[{re.escape(opening)}{re.escape(closing)}]"), F.lit(0))
    depth = F.aggregate(marks, F.lit(0), lambda d, m: F.when(d < 0, d).when(m == opening, d + 1).otherwise(d - 1))
    return depth == 0


def format_checks(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, problems): unbalanced brackets of three kinds, an odd number of code fences, an empty text."""
    checks = [("empty", F.length(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\r\n"))) == 0), ("fences", F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("```"), F.lit(0))) % 2 == 1)]
    checks += [(name, ~balanced(F.col(text), *pair)) for name, pair in (("round", "()"), ("square", "[]"), ("curly", "{}"))]
    return answers.select(key, F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks])), ",").alias("problems"))


def insights(modules: DataFrame, hub: int, risky: float) -> DataFrame:
    """(category, module, value): the module with most consumers, with the highest risk, with most functions; and all with ``hub`` consumers or more or at least ``risky``.

    Ties go to the smaller module. Inputs: module, consumers, functions, risk_score.
    """
    best = modules.agg(*[F.max_by(F.struct(F.col("module").cast("string").alias("module"), F.col(c).cast("double").alias("value")), F.struct(F.col(c).cast("double"), -F.col("module"))).alias(c) for c in ("consumers", "risk_score", "functions")])
    tops = best.select(F.explode(F.array(*[F.struct(F.lit(f"most_{c}").alias("category"), F.col(f"{c}.module").alias("module"), F.col(f"{c}.value").alias("value")) for c in ("consumers", "risk_score", "functions")])).alias("r")).select("r.*").filter("module IS NOT NULL")
    every = modules.select(F.explode(F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(name).alias("category"), F.col("module").cast("string").alias("module"), F.col(c).cast("double").alias("value"))) for name, c, cond in (("hub", "consumers", F.col("consumers") >= hub), ("risky", "risk_score", F.col("risk_score") >= risky))]))).alias("r")).select("r.*")
    return tops.unionByName(every)


def config_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): files whose hash changed, that are missing, or that are new. Inputs: path, hash."""
    both = baseline.select("path", F.col("hash").alias("was")).join(current.select("path", F.col("hash").alias("now")), "path", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", change.alias("change")).filter("change IS NOT NULL")


def fill_default(records: DataFrame, column: str, default: list[str], known: list[str]) -> DataFrame:
    """An empty or missing array becomes the default; ``unknown`` lists values that aren't known."""
    filled = F.when(F.coalesce(F.size(column), F.lit(0)) <= 0, F.array(*map(F.lit, default))).otherwise(F.col(column))
    return records.withColumn(column, filled).withColumn("unknown", F.array_except(column, F.array(*map(F.lit, known))))


def log_class(line: Column, patterns: list[tuple[str, str, str]], default: tuple[str, str] = ("INFO", "LOW")) -> Column:
    """(category, severity) of a log line by the first of the patterns (pattern, category, severity), whatever the case."""
    told = F.struct(F.lit(default[0]).alias("category"), F.lit(default[1]).alias("severity"))
    for pattern, category, severity in reversed(patterns):
        told = F.when(line.rlike(f"(?i){pattern}"), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))).otherwise(told)
    return told
