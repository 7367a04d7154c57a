"""Queries of views and gates over a whole graph, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import SQL_GEO, SQL_NODES, geo_edges, nodes, table
from ..operators import dedup, greedy, reports, views
from .reports import RISK, SQL_RISK, modules

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SQL_DEGREE = "d AS (SELECT n.id, n.entity_type, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT src AS id FROM geo UNION ALL SELECT dst FROM geo) e ON n.id = e.id GROUP BY n.id, n.entity_type)"


@query(
    f"""WITH {SQL_GEO}, {SQL_NODES}, {SQL_DEGREE}, t AS (SELECT id, degree FROM d WHERE entity_type = 'NATION' ORDER BY degree DESC, id LIMIT 5),
n AS (SELECT DISTINCT x.id FROM (SELECT src AS a, dst AS id FROM geo UNION SELECT dst, src FROM geo) x JOIN t ON x.a = t.id WHERE x.id NOT IN (SELECT id FROM t)),
u AS (SELECT id, degree, TRUE AS chosen FROM t UNION ALL SELECT d.id, d.degree, FALSE FROM d JOIN n ON d.id = n.id)
SELECT id, degree, chosen FROM u ORDER BY chosen DESC, degree DESC, id LIMIT 10"""
)
def viz_filtered(spark, sf_dir):
    return views.selected_view(nodes(spark, sf_dir), geo_edges(spark, sf_dir), None, ["NATION"], 5)


@query(f"WITH {SQL_RISK} SELECT m.module, round(risk_score * (functions + 1) * (1 + ln(consumers + 1.0)) * CASE risk_level WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 1.5 ELSE 1 END, 6) AS score FROM risk JOIN m ON risk.module = m.module")
def module_composite(spark, sf_dir):
    scored = reports.module_risk(modules(spark, sf_dir), **RISK).withColumn("impact", F.col("functions"))
    return views.risk_composite(scored, {"CRITICAL": 3.0, "HIGH": 1.5}).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {SQL_NODES}, c AS (SELECT count(*) AS cached, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero FROM embeddings), l AS (SELECT count(*) AS lacking FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))
SELECT 'graph_size' AS gate, count(*) >= 100 AS ok, TRUE AS fatal FROM nodes UNION ALL SELECT 'cache_exists', cached > 0, FALSE FROM c UNION ALL SELECT 'no_zero_vectors', zero = 0, FALSE FROM c UNION ALL SELECT 'cache_up_to_date', lacking = 0, FALSE FROM l"""
)
def health_gates(spark, sf_dir):
    """The graph, and the vectors as the cache of documents' embeddings."""
    vectors = table(spark, sf_dir, "embeddings")
    lacking = table(spark, sf_dir, "documents").join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").agg(F.count("*").alias("lacking"))
    cache = vectors.agg(F.count("*").alias("cached"), F.count_if(F.forall("embedding", lambda x: x == 0)).alias("zero")).crossJoin(F.broadcast(lacking))
    return views.health_gates(nodes(spark, sf_dir), cache)


@query(
    """WITH p AS (SELECT item_id // 4 AS question, substr(text, 1, 12) AS title, text, item_id % 4 < 2 AS gold FROM benchmark)
SELECT DISTINCT a.question, a.title AS src, b.title AS dst FROM p a JOIN p b ON a.question = b.question WHERE a.title < b.title AND ((a.gold AND b.gold) OR contains(lower(a.text), lower(b.title)) OR contains(lower(b.text), lower(a.title)))"""
)
def question_graph(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / 4).alias("question"), F.substring("text", 1, 12).alias("title"), "text", (F.col("item_id") % 4 < 2).alias("gold"))
    return views.question_edges(rows)


@query(
    f"""WITH {SQL_GEO}, m AS (SELECT 'supplier:' || s_suppkey AS id, min('supplier:' || s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 3) AS keeper FROM supplier)
SELECT DISTINCT coalesce(m.keeper, geo.src) AS src, dst, relationship FROM geo LEFT JOIN m ON geo.src = m.id"""
)
def dedup_pipeline(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    canonical = supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.concat_ws("/", F.col("s_nationkey").cast("string"), (F.col("s_suppkey") % 3).cast("string")).alias("canonical"))
    return views.deduplicated(nodes(spark, sf_dir), geo_edges(spark, sf_dir), canonical)[1]


@query(
    """WITH n AS (SELECT 'code:' || p_partkey AS id, p_name AS name, 'code' AS source FROM part WHERE p_size % 2 = 0 UNION ALL SELECT 'doc:' || p_partkey, p_name, 'document' FROM part WHERE p_size % 2 = 1),
g AS (SELECT name, min(id) FILTER (source = 'code') AS code, min(id) FILTER (source = 'document') AS doc FROM n GROUP BY name),
f AS (SELECT n.id, coalesce(CASE WHEN code IS NULL OR doc IS NULL THEN n.id WHEN contains(n.name, 'red') THEN CASE WHEN source = 'code' THEN code ELSE doc END ELSE code END, n.id) AS keeper FROM n JOIN g USING (name))
SELECT keeper, count(*) AS merged FROM f GROUP BY keeper"""
)
def dedup_decisions(spark, sf_dir):
    """Parts as entities of two sources that write their names in two ways; what has red in its name was decided to be two things."""
    part = table(spark, sf_dir, "part").select((F.col("p_size") % 2 == 0).alias("code"), F.col("p_partkey").cast("string").alias("k"), "p_name")
    label = F.when(F.col("code"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).otherwise(F.col("p_name"))
    found = part.select(F.concat(F.when(F.col("code"), "code:").otherwise("doc:"), "k").alias("id"), label.alias("label"), F.when(F.col("code"), "code").otherwise("document").alias("source_type"), F.col("p_name").alias("description"), F.lit(None).cast("string").alias("canonical"))
    first = found.groupBy("description").agg(F.min(F.when(F.col("source_type") == "code", F.col("id"))).alias("a"), F.min(F.when(F.col("source_type") == "document", F.col("id"))).alias("b"))
    decisions = first.filter("contains(description, 'red') AND a IS NOT NULL AND b IS NOT NULL").select("a", "b", F.lit(False).alias("accepted"))
    merged, _, _, _ = dedup.dedup_graph(found, spark.createDataFrame([], "src string, dst string, relationship string"), {"code": 1, "document": 5}, decisions)
    return merged.select(F.col("id").alias("keeper"), "merged")


@query(
    r"""WITH RECURSIVE m AS (SELECT o_custkey, o_orderkey AS o, list_distinct(list_filter(regexp_split_to_array(lower(o_orderstatus || ' ' || o_orderpriority), '\s+'), lambda w: w <> '')) AS w, CAST(o_totalprice AS DOUBLE) / 1e6 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT o_custkey, k, [{'o': o, 'w': w, 'c': c}] AS kept FROM m WHERE k = 1
UNION ALL SELECT o_custkey, k, CASE WHEN hit IS NULL THEN list_append(kept, new) WHEN new.c > kept[hit].c THEN list_append(list_concat(kept[:hit - 1], kept[hit + 1:]), new) ELSE kept END
FROM (SELECT m.o_custkey, m.k, s.kept, {'o': m.o, 'w': m.w, 'c': m.c} AS new, list_filter(range(1, len(s.kept) + 1), lambda i: len(list_intersect(s.kept[i].w, m.w)) > 0.5 * len(list_distinct(list_concat(s.kept[i].w, m.w))))[1] AS hit FROM s JOIN m ON m.o_custkey = s.o_custkey AND m.k = s.k + 1))
SELECT o_custkey, unnest(arg_max(kept, k)).o AS o_orderkey FROM s GROUP BY o_custkey"""
)
def token_redundancy(spark, sf_dir):
    messages = table(spark, sf_dir, "orders").select(F.col("o_custkey"), F.col("o_orderkey"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"), (F.col("o_totalprice") / 1e6).alias("confidence"))
    return greedy.without_redundant(messages, "o_custkey", "o_orderkey", 0.5)


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <= 2 ORDER BY ts, event_id LIMIT 50")
def replay_queue(spark, sf_dir):
    entries = table(spark, sf_dir, "events").withColumn("attempts", F.col("event_id") % 5)
    return views.pending(entries, entries.filter("event_id % 3 = 0"), "event_id", ["ts", "event_id"], 2, 50).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def bounded_inbox(spark, sf_dir):
    return views.bounded_inbox(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 10).select("event_id", "user_id")
