"""Queries of extraction, sessions, gates and evaluation, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import SQL_EDGES, SQL_GEO, SQL_NODES, edges, geo_edges, nodes, table
from ..operators import extracts, traverse
from .retrieval import SQL_FILES, files
from .selection import pick, sql_list

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SQL_EDGES} SELECT 'out' AS direction, dst AS other, relationship FROM edges WHERE src = 'nation:3' UNION ALL SELECT 'in', src, relationship FROM edges WHERE dst = 'nation:3'")
def incoming_outgoing(spark, sf_dir):
    return traverse.incident(edges(spark, sf_dir), "nation:3")


@query(f"WITH {SQL_GEO}, {SQL_NODES}, d AS (SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT src AS id FROM geo UNION ALL SELECT dst FROM geo) e ON n.id = e.id GROUP BY n.id) SELECT id, degree FROM d ORDER BY degree DESC, id LIMIT (SELECT greatest(1, count(*) // 10) FROM nodes)")
def graph_hubs(spark, sf_dir):
    return traverse.top_share(nodes(spark, sf_dir), geo_edges(spark, sf_dir))


@query("SELECT (SELECT count(DISTINCT n_regionkey) FROM nation) + (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) + (SELECT count(*) FROM part) AS components")
def graph_components(spark, sf_dir):
    return traverse.component_count(nodes(spark, sf_dir), geo_edges(spark, sf_dir))


#: How grave each kind of change is by depth; any table may be given.
RISKS = {"remove": ("high", "medium"), "deploy": ("medium", "low"), "modify": ("medium", "low"), "add": ("low",)}


@query(f"WITH {SQL_GEO}, o AS (SELECT dst AS id, 1 AS depth FROM geo WHERE src = 'nation:3'), i AS (SELECT src AS id, 1 AS depth FROM geo WHERE dst = 'nation:3') SELECT id, depth, 'out' AS direction, 'high' AS risk FROM o UNION ALL SELECT * FROM (SELECT id, depth, 'in', 'high' FROM i ORDER BY depth, id LIMIT 5)")
def impact_risk(spark, sf_dir):
    start = spark.createDataFrame([("nation:3",)], "id string")
    return traverse.impact_risk(traverse.impact(geo_edges(spark, sf_dir), start, 2, 5), "remove", RISKS)


@query(f"WITH {SQL_FILES} SELECT path FROM files WHERE (path LIKE '%.py' OR path LIKE '%.ts') AND NOT path LIKE '%m1%' AND NOT path LIKE 'src2/%' ORDER BY path LIMIT 40")
def doc_discovery(spark, sf_dir):
    return extracts.discovered(files(spark, sf_dir), "path", ["py", "ts"], ["*m1*", "src2/*"], 40)


@query(f"WITH {SQL_FILES} SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'javascript' END AS language FROM files")
def type_classification(spark, sf_dir):
    return files(spark, sf_dir).select("path", extracts.language_of(F.col("path")).alias("language"))


@query("SELECT DISTINCT 'supplier/' || l_suppkey AS src, 'dep:part-' || l_partkey AS dst, 'DEPENDS_ON' AS relationship, CAST(max(l_linenumber) AS VARCHAR) AS version FROM lineitem GROUP BY l_suppkey, l_partkey, l_returnflag = 'A'")
def json_dependencies(spark, sf_dir):
    """A manifest of each supplier, of the parts it has delivered: those ever returned are its dependencies, the others development ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_returnflag") == "A").alias("returned"), "l_partkey").agg(F.max("l_linenumber").alias("version"))
    held = lambda cond: F.map_from_entries(F.array_compact(F.collect_list(F.when(cond, F.struct(F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), F.col("version").cast("string"))))))
    text = F.to_json(F.struct(F.first("l_suppkey").alias("name"), held(F.col("returned")).alias("dependencies"), held(~F.col("returned")).alias("devDependencies")))
    files_ = lines.groupBy("l_suppkey").agg(text.alias("text")).select(F.concat(F.lit("supplier/"), F.col("l_suppkey").cast("string")).alias("path"), "text")
    return extracts.manifest_edges(files_, "path", "text")


@query(
    r"""WITH p AS (SELECT regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS route, CASE WHEN contains(url, '?') THEN 'POST' WHEN contains(url, '#') THEN 'DELETE' ELSE 'GET' END AS method FROM pages)
SELECT DISTINCT method || ' ' || route AS id, method, route FROM p"""
)
def json_endpoints(spark, sf_dir):
    """An API description of each page: its path, with a method that its address tells and a key that is none."""
    route = F.regexp_extract("url", r"^https?://[^/]+([^?#]*)", 1)
    method = F.when(F.contains("url", F.lit("?")), "post").when(F.contains("url", F.lit("#")), "delete").otherwise("get")
    spec = F.to_json(F.struct(F.create_map(route, F.create_map(method, F.create_map(F.lit("summary"), F.col("url")), F.lit("parameters"), F.create_map(F.lit("in"), F.lit("path")))).alias("paths")))
    return extracts.endpoints(table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), spec.alias("text")), "path", "text")


@query("WITH t AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM conversations) SELECT 'turn:' || conv_id || ':' || turn AS src, 'turn:' || conv_id || ':' || after AS dst, 'NEXT' AS relationship FROM t WHERE after IS NOT NULL")
def session_graph(spark, sf_dir):
    return extracts.session_graph(table(spark, sf_dir, "conversations"))[1]


@query("SELECT DISTINCT 'source:' || s_suppkey AS src, 'goal:' || s_nationkey AS dst, 'SUPPORTS' AS relationship FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)")
def seed_graph(spark, sf_dir):
    goals = table(spark, sf_dir, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("goal"), F.col("n_name").alias("title"))
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("goal"))
    return extracts.seeded(goals, sources)[1]


@query("SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def schema_constraints(spark, sf_dir):
    return extracts.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events), g AS (SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS g FROM d),
r AS (SELECT user_id, g, count(*) AS n, max(d) AS e FROM g GROUP BY user_id, g), l AS (SELECT max(d) AS last FROM d)
SELECT user_id, coalesce(max(n) FILTER (last - e <= 1), 0) AS streak, max(n) AS longest FROM r, l GROUP BY user_id"""
)
def session_streak(spark, sf_dir):
    return extracts.streaks(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "user_id", "day")


@query(
    """WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events WHERE event_id % 2 = 0 GROUP BY user_id, event_type)
SELECT round(avg(CASE WHEN n.k <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN n.k <= 3 THEN 1.0 ELSE 0 END), 6) AS top3 FROM events e LEFT JOIN n ON n.user_id = e.user_id AND n.event_type = e.event_type WHERE e.event_id % 2 = 1 AND e.user_id IN (SELECT user_id FROM n)"""
)
def topk_accuracy(spark, sf_dir):
    """A user's odd events, predicted by how often each kind is among the even ones."""
    events = table(spark, sf_dir, "events")
    counts = events.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "event_type"))).alias("r")).select("user_id", F.col("r.event_type").alias("ranked"))
    return extracts.topk_accuracy(events.filter("event_id % 2 = 1").join(ranked, "user_id"), "ranked", "event_type", [1, 3])


@query("WITH r AS (SELECT user_id, value > 50 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT user_id, round(avg(CAST(hit AS INT)) FILTER (k <= 3), 6) AS early, round(avg(CAST(hit AS INT)) FILTER (k > 3), 6) AS late FROM r GROUP BY user_id")
def cold_start(spark, sf_dir):
    return extracts.cold_start(table(spark, sf_dir, "events").withColumn("hit", F.col("value") > 50), "user_id", ["ts", "event_id"], "hit", 3)


@query()
def bootstrap_bin_ci(spark, sf_dir):
    return extracts.bootstrap_interval(table(spark, sf_dir, "events"), F.col("event_type"), "value", "event_id", 100)


@query("SELECT event_id, CASE WHEN value > 150 THEN 'BLOCK' WHEN value > 80 AND event_type = 'error' THEN 'REVIEW' WHEN value > 80 THEN 'WARN' ELSE 'ALLOW' END AS decision FROM events")
def gate_decisions(spark, sf_dir):
    rules = [("BLOCK", F.col("value") > 150), ("REVIEW", (F.col("value") > 80) & (F.col("event_type") == "error")), ("WARN", F.col("value") > 80)]
    return extracts.gate(table(spark, sf_dir, "events"), rules, "ALLOW").select("event_id", "decision")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS level, 'Customer#[NUMBER]' || CASE WHEN c_custkey % 3 = 0 THEN ' [MAIL]' ELSE '' END AS clean FROM customer")
def security_gate(spark, sf_dir):
    text = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " a.b@c.example").otherwise(""))
    return extracts.guarded_text(table(spark, sf_dir, "customer").withColumn("text", text), "text", [("mail", r"[a-z.]+@[a-z.]+", 2), ("number", "[0-9]{6,}", 1)]).select("c_custkey", "level", "clean")


STATES = ["PENDING", "COMMITTED", "ANCHORED", "FAILED"]


@query(
    f"""WITH s AS (SELECT user_id, ts, event_id, {sql_list(STATES)}[event_id % 4 + 1] AS state FROM events), b AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s)
SELECT user_id, max_by(state, (ts, event_id)) AS state, count(*) FILTER (b IS NOT NULL AND b <> state) AS changes, coalesce(bool_or(b IN ('ANCHORED', 'FAILED') AND b <> state), FALSE) AS reopened FROM b GROUP BY user_id"""
)
def commit_lifecycle(spark, sf_dir):
    return extracts.latest_state(table(spark, sf_dir, "events").withColumn("state", pick(STATES, "event_id")), "user_id", ["ts", "event_id"], "state", ["ANCHORED", "FAILED"])


@query("WITH p AS (SELECT * FROM (VALUES ('before', (SELECT count(*) FROM nation) + 0), ('after', (SELECT count(DISTINCT n_regionkey) FROM nation))) t(stage, components)) SELECT stage, CAST(components AS BIGINT) AS components FROM p")
def bridge_pipeline_report(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    ids = nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))
    none = geo_edges(spark, sf_dir).limit(0)
    first = nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("m"))
    bridges = nation.join(first, "n_regionkey").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.col("m").cast("string")).alias("dst"))
    parts = [traverse.component_count(ids, e).select(F.lit(stage).alias("stage"), "components") for stage, e in (("before", none), ("after", bridges))]
    return parts[0].unionByName(parts[1])
