"""Risk, coverage, drift, conflict and observer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import SQL_NODES, nodes, table
from ..operators import linking, reports, texts

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def modules(spark, sf_dir):
    """Suppliers as modules: customers consume them, parts are their functions, order lines their edges."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    counts = lines.groupBy(F.col("l_suppkey").alias("module")).agg(F.countDistinct("o_custkey").alias("consumers"), F.countDistinct("l_partkey").alias("functions"), F.countDistinct("l_returnflag").alias("dependencies"), F.count("*").alias("edges"))
    return counts.withColumn("consumers", F.pmod(F.col("consumers") * F.col("module"), F.lit(23)))


SQL_RISK = """m AS (SELECT l_suppkey AS module, count(DISTINCT o_custkey) * l_suppkey % 23 AS consumers, count(DISTINCT l_partkey) AS functions, count(DISTINCT l_returnflag) AS dependencies, count(*) AS edges
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey),
s AS (SELECT module, least(1.0, CAST(0.25 AS DOUBLE) * least(consumers / 16.0, 1.0) + CAST(0.25 AS DOUBLE) * least(functions / 32.0, 1.0) + CAST(0.25 AS DOUBLE) * least(dependencies / 8.0, 1.0) + CAST(0.25 AS DOUBLE) * least(edges / 64.0, 1.0)) AS score FROM m),
risk AS (SELECT module, round(score, 3) AS risk_score, CASE WHEN score >= 0.75 THEN 'CRITICAL' WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s)"""

#: Equal weights and levels, for the queries below; any may be given.
RISK = {"weights": {"consumers": (0.25, 16.0), "functions": (0.25, 32.0), "dependencies": (0.25, 8.0), "edges": (0.25, 64.0)}, "levels": [(0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "MEDIUM")], "lowest": "LOW"}


@query(f"WITH {SQL_RISK} SELECT module, risk_score, risk_level FROM risk")
def module_risk(spark, sf_dir):
    return reports.module_risk(modules(spark, sf_dir), **RISK).select("module", "risk_score", "risk_level")


@query(f"WITH {SQL_RISK} SELECT risk_level, count(*) AS n FROM risk GROUP BY risk_level")
def risk_distribution(spark, sf_dir):
    return reports.module_risk(modules(spark, sf_dir), **RISK).groupBy("risk_level").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey AS module, count(DISTINCT o_custkey) AS consumers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey HAVING count(DISTINCT o_custkey) >= 10")
def impact_matrix(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return lines.groupBy(F.col("l_suppkey").alias("module")).agg(F.countDistinct("o_custkey").alias("consumers")).filter("consumers >= 10")


@query("WITH c AS (SELECT count(*) AS n, round(count(CASE WHEN n_chars >= 50 THEN 1 END) * 100.0 / count(*), 1) AS chunk_coverage, round(count(CASE WHEN lang IS NOT NULL THEN 1 END) * 100.0 / count(*), 1) AS edge_coverage FROM documents) SELECT *, CASE WHEN chunk_coverage >= 95 AND edge_coverage >= 99 THEN 'HEALTHY' WHEN chunk_coverage >= 80 AND edge_coverage >= 95 THEN 'WARNING' ELSE 'CRITICAL' END AS status FROM c")
def coverage_report(spark, sf_dir):
    return reports.coverage(table(spark, sf_dir, "documents"), F.col("n_chars") >= 50, F.col("lang").isNotNull())


@query(f"WITH {SQL_NODES}, q AS (SELECT count(CASE WHEN length(description) > 20 THEN 1 END) * 100.0 / count(*) AS described, count(CASE WHEN length(label) > 15 THEN 1 END) * 100.0 / count(*) AS chunked, avg(length(description)) AS mean_length FROM nodes) SELECT round(described, 3) AS described, round(chunked, 3) AS chunked, round(mean_length, 3) AS mean_length, CAST(least(floor(0.4 * described + 0.4 * chunked + 20 * least(mean_length, 200) / 200), 100) AS BIGINT) AS score FROM q")
def graph_quality(spark, sf_dir):
    return reports.graph_quality(nodes(spark, sf_dir).withColumn("chunks", (F.length("label") > 15).cast("int")))


@query(f"WITH {SQL_NODES} SELECT split_part(id, ':', 1) AS project, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM nodes), 3) AS share FROM nodes GROUP BY 1")
def project_share(spark, sf_dir):
    return reports.shares(nodes(spark, sf_dir), F.split_part("id", F.lit(":"), F.lit(1)))


@query("SELECT event_type, count(*) AS n, round(sum(greatest(25000 - value * 100, 0)), 2) AS saved FROM events GROUP BY event_type")
def metrics_summary(spark, sf_dir):
    return reports.saved_tokens(table(spark, sf_dir, "events").withColumn("returned", F.col("value") * 100), "event_type", "returned")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round((avg(value) - 48) / 0.5, 6) AS drift, abs((avg(value) - 48) / 0.5) >= 1.5 AS alert FROM events GROUP BY event_type")
def welford_trend(spark, sf_dir):
    return reports.drift(table(spark, sf_dir, "events"), "event_type", "value", 48.0, 0.5, 1.5)


@query("WITH j AS (SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS change FROM events) SELECT event_id, user_id, change, CASE WHEN change > 0 THEN 'spike' ELSE 'drop' END AS kind FROM j WHERE abs(change) > 100")
def observer_anomalies(spark, sf_dir):
    return reports.jumps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 100).select("event_id", "user_id", "change", "kind")


@query("WITH m AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) / 100 AS m FROM events GROUP BY 1, 2), s AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY event_type ORDER BY day)) AS step FROM m) SELECT event_type, day, round(m, 6) AS mean FROM s WHERE step < 0.02 AND m < 0.7")
def stagnation(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), (F.col("value") / 100).alias("score"))
    return reports.stagnation(rows, "event_type", "day", "score")


@query("SELECT user_id, count(value) AS n, round(max(value), 6) AS top FROM events GROUP BY user_id HAVING count(value) > 2 AND max(value) > avg(value) + 250")
def dominance(spark, sf_dir):
    return reports.dominance(table(spark, sf_dir, "events"), "user_id", "value", 250)


@query("WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, string_agg(event_type, '>' ORDER BY ts, event_id) AS pattern, count(*) AS length FROM events GROUP BY 1, 2) SELECT pattern, count(*) AS sessions, count(DISTINCT user_id) AS actors FROM s WHERE length >= 2 GROUP BY pattern HAVING count(DISTINCT user_id) >= 3")
def mine_workflow_patterns(spark, sf_dir):
    return reports.workflow_patterns(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], ["ts", "event_id"], "event_type", "user_id")


@query("SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS segment, count(*) AS n, max(length(html)) AS largest, CAST(sum(length(html)) AS BIGINT) AS total FROM pages GROUP BY 1")
def pr_blast_radius(spark, sf_dir):
    files = table(spark, sf_dir, "pages").withColumn("size", F.length("html").cast("long"))
    return reports.by_first_segment(files, F.regexp_replace("url", "^[a-z]+://", ""), "size")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'removed' ELSE 'changed' END AS state FROM documents WHERE doc_id % 10 IN (0, 1) OR doc_id % 7 = 0")
def manifest_stale(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    now = docs.filter("doc_id % 10 <> 1").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)) + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0))
    return reports.stale(docs.filter("doc_id % 10 <> 0").withColumn("n_chars", F.coalesce("n_chars", F.lit(0))), now, "doc_id", ["n_chars", "source"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'deleted_remotely' ELSE 'both_modified' END AS conflict FROM customer WHERE c_custkey % 3 = 0 AND (c_custkey % 5 = 0 OR c_custkey % 7 = 0)")
def delta_conflicts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    local = c.withColumn("change", F.when(F.col("id") % 3 == 0, "modified").otherwise("deleted"))
    remote = c.withColumn("change", F.when(F.col("id") % 5 == 0, "deleted").when(F.col("id") % 7 == 0, "modified").otherwise("added"))
    return reports.delta_conflicts(local, remote, "id")


@query("WITH v AS (SELECT user_id, length(event_type) AS p, CAST(ts AS DATE) AS u, event_type FROM events), b AS (SELECT user_id, max((p, u)) AS best FROM v GROUP BY user_id) SELECT v.user_id, min(event_type) AS event_type, min(event_type) = max(event_type) AS settled FROM v JOIN b ON v.user_id = b.user_id AND (v.p, v.u) = b.best GROUP BY v.user_id")
def auto_resolve(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.length("event_type").alias("priority"), F.to_date("ts").alias("updated"))
    return reports.resolve_conflicts(rows, "user_id", "priority", "updated", "event_type")


@query("WITH c AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY 1, 2), r AS (SELECT *, sum(k) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY k DESC, lang) AS place FROM c) SELECT source, CAST(n AS BIGINT) AS n, lang FROM r WHERE place = 1")
def domain_agents(spark, sf_dir):
    return reports.dominant(table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def severity_filter(spark, sf_dir):
    order = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    return reports.at_least(table(spark, sf_dir, "orders"), "o_orderpriority", order, "2-HIGH").select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN '[withheld]' ELSE c_name END AS c_name FROM customer")
def clearance_filter(spark, sf_dir):
    return reports.cleared(table(spark, sf_dir, "customer"), (F.col("c_acctbal") > 5000).cast("int"), 0, "c_name", "[withheld]").select("c_custkey", "c_name")


@query("SELECT o_orderpriority, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) / sum(CASE WHEN o_orderstatus IN ('F', 'P') OR o_orderkey % 10 = 0 THEN o_totalprice END), 0), 6) AS governed_yield FROM orders GROUP BY o_orderpriority")
def governance_yield(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "isolated").otherwise("open")
    tasks = table(spark, sf_dir, "orders").select("o_orderpriority", status.alias("status"), F.col("o_totalprice").alias("weight"), (F.col("o_orderkey") % 10 == 0).alias("is_gate"))
    return reports.governed_yield(tasks, "o_orderpriority")


@query("WITH p AS (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT count(s) AS n, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.5), 6) AS median, round(stddev_pop(s), 6) AS sd, count(CASE WHEN s >= 0.2 THEN 1 END) AS green, count(CASE WHEN s >= 0 AND s < 0.2 THEN 1 END) AS yellow, count(CASE WHEN s >= -1 AND s < 0 THEN 1 END) AS red FROM p")
def alignment_measure(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    pairs = rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return reports.alignment(pairs.select(linking.cosine(F.col("a"), F.col("b")).alias("score")), [("green", 0.2), ("yellow", 0.0), ("red", -1.0)])


@query("""WITH d AS (SELECT doc_id, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t, text, len(list_filter(string_split_regex(text, '\\n{2,}'), lambda x: regexp_matches(x, '[^ \\t\\n\\r]'))) AS sections, lower(source) AS path FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, CASE WHEN length(t) < 50 THEN 'too_short' WHEN length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) > 0.5 * length(text) THEN 'garbled' WHEN path LIKE '%mock%' OR path LIKE '%fixture%' THEN 'fixture' ELSE 'ok' END AS reason FROM d)
SELECT doc_id, reason, round(CASE reason WHEN 'ok' THEN least(1.0, 0.3 + sections * 0.1 + least(length(text) / 5000.0, 0.4)) WHEN 'too_short' THEN 0.0 ELSE 0.1 END, 4) AS score FROM c""")
def document_quality(spark, sf_dir):
    return texts.document_quality(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "source").select("doc_id", "reason", "score")


@query()
def chunk_documents(spark, sf_dir):
    chunks = texts.chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return chunks.select("doc_id", "position", F.length("chunk").alias("length"), F.substring(F.sha2("chunk", 256), 1, 16).alias("hash"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS l, max(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS m FROM events) t WHERE l = m")
def taint_max(spark, sf_dir):
    level = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).withColumn("level", level)
    most = rows.groupBy("user_id", "day").agg(F.max("level").alias("level"))
    return rows.join(most, ["user_id", "day", "level"], "left_semi").select("user_id", "event_id", "event_type")


@query("WITH s AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS size FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS z FROM s) SELECT conv_id, count(*) AS steps, CAST(sum(size) AS BIGINT) AS total, CAST(max(size) AS BIGINT) AS largest, max(CASE WHEN a = 1 THEN turn END) AS bottleneck, max(CASE WHEN z = 1 THEN role END) AS last_kind FROM r GROUP BY conv_id")
def profile_summary(spark, sf_dir):
    steps = table(spark, sf_dir, "conversations").withColumn("size", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return reports.step_profile(steps, "conv_id", ["turn"], "size", "role")
