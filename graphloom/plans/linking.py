"""Linking, merging and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import SQL_GEO, SQL_NODES, geo_edges, nodes, table
from ..operators import linking

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def geo_nodes(spark, sf_dir, *kinds: str):
    return nodes(spark, sf_dir).filter(F.col("entity_type").isin(*kinds))


@query("SELECT c_custkey AS left_id, s_suppkey AS right_id, CAST(0.9 AS DOUBLE) AS confidence FROM customer JOIN supplier ON substr(regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g'), 9) = substr(regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g'), 9)")
def bridge_exact(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    # Both kinds of names begin with a word of eight letters.
    return linking.exact_bridge(left, right, F.substring(linking.normalised(F.col("name")), 9, 1000))


@query("WITH r AS (SELECT user_id, value, length(event_type) AS priority, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, length(event_type), event_id) AS k FROM events) SELECT user_id, value, CAST(priority AS INTEGER) AS priority, event_id FROM r WHERE k = 1")
def bridge_reconcile(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("priority", F.length("event_type"))
    return linking.reconcile(rows, "user_id", "value", "priority", "event_id")


@query()
def entity_unify(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    code = parts.select(F.concat(F.lit("code:"), "p_partkey").alias("id"), F.regexp_replace("p_name", " ", "_").alias("label"), F.lit("code").alias("source_type"))
    docs = parts.select(F.concat(F.lit("doc:"), "p_partkey").alias("id"), F.initcap("p_name").alias("label"), F.lit("document").alias("source_type"))
    entities = code.unionByName(docs)
    pairs = linking.unify(entities, {"code": 1, "document": 2}).withColumn("kind", F.lit("pair"))
    copies = linking.copies(entities).select(F.col("representative").alias("primary"), F.col("id").alias("secondary"), F.lit(1.0).alias("confidence"), F.lit("copy").alias("kind"))
    return pairs.unionByName(copies)


@query(
    "SELECT lower(trim(c_name)) AS label, k.key, 'crm' AS source_a, 'web' AS source_b, CASE k.key WHEN 'nation' THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS value_a, "
    "CASE k.key WHEN 'nation' THEN CAST(c_nationkey + 1 AS VARCHAR) ELSE c_mktsegment || 'X' END AS value_b, CASE k.key WHEN 'nation' THEN 'numeric_mismatch' ELSE 'value_mismatch' END AS type "
    "FROM customer, (VALUES ('nation', 5), ('segment', 7)) k(key, step) WHERE c_custkey % k.step = 0"
)
def contradictions(spark, sf_dir):
    c = table(spark, sf_dir, "customer")

    def facts(source: str, nation, segment):
        entries = F.explode(F.array(F.struct(F.lit("nation").alias("key"), nation.cast("string").alias("value")), F.struct(F.lit("segment").alias("key"), segment.alias("value"))))
        return c.select(F.col("c_name").alias("label"), F.lit(source).alias("source_type"), entries.alias("e")).select("label", "source_type", "e.key", "e.value")

    nation = F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    segment = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit("X"))).otherwise(F.lower("c_mktsegment"))
    return linking.contradictions(facts("crm", F.col("c_nationkey"), F.col("c_mktsegment")).unionByName(facts("web", nation, segment)))


@query(
    "WITH w AS (SELECT DISTINCT p_partkey AS id, p_brand AS project, unnest(string_split(lower(p_name), ' ')) AS token FROM part), f AS (SELECT *, row_number() OVER (PARTITION BY project, token ORDER BY id) AS k FROM w WHERE length(token) >= 4 AND token <> 'small'), "
    "t AS (SELECT * FROM f WHERE k <= 3) SELECT a.id AS src, b.id AS dst, count(*) AS shared FROM t a JOIN t b ON a.token = b.token AND a.project < b.project GROUP BY a.id, b.id HAVING count(*) >= 2"
)
def name_similarity_edges(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_name").alias("label"))
    return linking.similar_names(parts, ["small"])


@query("WITH o AS (SELECT p_brand AS project, p_name AS label, min(p_partkey) AS id FROM part GROUP BY 1, 2) SELECT a.label, a.id AS src, b.id AS dst FROM o a JOIN o b ON a.label = b.label AND a.project < b.project WHERE NOT (a.id < 20 AND b.id = a.id + 1)")
def env_edge_infer(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project"), F.col("p_name").alias("label"))
    known = parts.filter("id < 20").select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return linking.shared_labels(parts, known)


@query("WITH c AS (SELECT DISTINCT page_id AS src, unnest(regexp_extract_all(html, 'href=\"(/[^\"#?]*)', 1)) AS path FROM pages), e AS (SELECT '/' || text AS path, min(item_id) AS dst FROM (SELECT item_id, split_part(text, ' ', 1) AS text FROM benchmark) t GROUP BY 1) SELECT DISTINCT src, dst FROM c JOIN e ON c.path = e.path")
def api_edge_infer(spark, sf_dir):
    ends = table(spark, sf_dir, "benchmark").groupBy(F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("path")).agg(F.min("item_id").alias("id"))
    return linking.link_paths(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text")), ends, 'href="(/[^"#?]*)')


REFS = "CASE o_orderkey % 4 WHEN 0 THEN 'customer:' || o_custkey WHEN 1 THEN 'svc.customer:' || o_custkey WHEN 2 THEN 'client-' || o_custkey ELSE 'gone:' || o_custkey END"


@query(f"WITH r AS (SELECT o_orderkey, o_custkey, {REFS} AS ref FROM orders) SELECT o_orderkey, ref, CASE WHEN ref LIKE 'gone%' OR c_custkey IS NULL OR (ref LIKE 'client-%' AND o_custkey % 2 = 1) THEN NULL ELSE 'customer:' || o_custkey END AS target, CASE WHEN c_custkey IS NULL THEN 'unresolved' WHEN ref LIKE 'customer%' THEN 'direct' WHEN ref LIKE 'svc%' THEN 'prefix' WHEN ref LIKE 'client-%' AND o_custkey % 2 = 0 THEN 'alias' ELSE 'unresolved' END AS how FROM r LEFT JOIN customer ON o_custkey = c_custkey")
def cross_language_resolve(spark, sf_dir):
    key = F.col("o_custkey").cast("string")
    kind = F.col("o_orderkey") % 4
    ref = F.when(kind == 0, F.concat(F.lit("customer:"), key)).when(kind == 1, F.concat(F.lit("svc.customer:"), key)).when(kind == 2, F.concat(F.lit("client-"), key)).otherwise(F.concat(F.lit("gone:"), key))
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey")
    aliases = known.filter("c_custkey % 2 = 0").select(F.concat(F.lit("client-"), F.col("c_custkey").cast("string")).alias("alias"), "id")
    return linking.resolve(table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref")), "ref", known, aliases, r"svc\.")


@query("WITH n AS (SELECT doc_id, substr(sha256(lower(trim(text, ' '))), 1, 16) AS canonical FROM documents) SELECT doc_id, canonical, CASE WHEN canonical IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY canonical) END AS keeper FROM n")
def canonical_dedup(spark, sf_dir):
    return linking.canonical_keepers(table(spark, sf_dir, "documents"), F.lower(F.trim("text")), "doc_id").select("doc_id", "canonical", "keeper")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS label, CASE WHEN c_custkey % 3 = 0 AND length(c_mktsegment || c_mktsegment || c_mktsegment) > length(c_name) THEN c_mktsegment || c_mktsegment || c_mktsegment ELSE c_name END AS description, CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS merged FROM customer")
def merge_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("id"), F.lit(2).alias("rank"), F.col("c_name").alias("label"), F.col("c_name").alias("description"))
    code = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("rank"), F.col("c_mktsegment").alias("label"), F.repeat("c_mktsegment", F.lit(3)).alias("description"))
    return linking.merge_records(docs.unionByName(code), "id", "rank", ["label"], ["description"])


@query(f"WITH {SQL_GEO}, m AS (SELECT 'customer:' || c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'nation:' || c_nationkey ELSE 'customer:' || (c_custkey - c_custkey % 2) END AS keeper FROM customer), e AS (SELECT coalesce(m.keeper, src) AS src, dst, relationship FROM geo LEFT JOIN m ON src = m.id) SELECT DISTINCT src, dst, relationship FROM e WHERE src <> dst")
def rewire_edges(spark, sf_dir):
    key = F.col("c_custkey")
    keeper = F.when(key % 50 == 0, F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("customer:"), (key - key % 2).cast("string")))
    mapping = table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), key.cast("string")).alias("id"), keeper.alias("keeper"))
    return linking.rewire(geo_edges(spark, sf_dir), mapping)


@query("WITH u AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'a/' || s_suppkey ELSE 'shared/' || s_suppkey END AS id, s_name AS label, 'a' AS source_project, 0 AS k FROM supplier UNION ALL SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'b/' || s_suppkey ELSE 'shared/' || s_suppkey END, upper(s_name), 'b', 1 FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS place FROM u) SELECT id, label, source_project FROM r WHERE place = 1")
def link_merge(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")

    def project(step: int, label):
        return s.select(F.when(key % step == 0, key.cast("string")).otherwise(F.concat(F.lit("shared/"), key.cast("string"))).alias("id"), label.alias("label"))

    return linking.merge_projects([("a", project(2, F.col("s_name"))), ("b", project(3, F.upper("s_name")))])


@query(f"WITH {SQL_NODES} SELECT id, 'pattern' AS rule FROM nodes WHERE entity_type = 'NATION' AND NOT regexp_full_match(label, 'NATION_[0-9]') UNION ALL SELECT id, 'length' FROM nodes WHERE entity_type = 'CUSTOMER' AND length(description) > 45 UNION ALL SELECT id, 'allowed' FROM nodes WHERE entity_type = 'REGION' AND label NOT IN ('ASIA', 'EUROPE')")
def validate_graph(spark, sf_dir):
    rules = [("NATION", "pattern", F.col("label").rlike("^NATION_[0-9]$")), ("CUSTOMER", "length", F.length("description") <= 45), ("REGION", "allowed", F.col("label").isin("ASIA", "EUROPE"))]
    return linking.validate(nodes(spark, sf_dir), rules)


@query(f"WITH {SQL_GEO} SELECT src, dst, relationship, CASE WHEN dst = 'region:1' THEN 'missing_target' ELSE 'source_type' END AS problem FROM geo WHERE dst = 'region:1' OR src LIKE 'customer:%'")
def validate_edge_shapes(spark, sf_dir):
    known = nodes(spark, sf_dir).filter("id <> 'region:1'")
    return linking.validate_edges(geo_edges(spark, sf_dir), known, {"LOCATED_IN": (["SUPPLIER"], ["NATION"]), "PART_OF": (["NATION"], ["REGION"])})


@query("WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label AS parent, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS score FROM embeddings, q WHERE embedding IS NOT NULL ORDER BY score DESC, vec_id LIMIT 20) SELECT parent, round(max(score), 6) AS score, count(*) AS hits FROM s GROUP BY parent")
def vector_search(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    probe = rows.filter("vec_id = 0").select("embedding").limit(1).collect()
    found = linking.vector_search(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("parent"), "embedding"), list(probe[0][0]) if probe else [], 20)
    return found.select("parent", F.round("score", 6).alias("score"), "hits")
