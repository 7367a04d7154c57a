"""Search, lookup, fusion and alignment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import SQL_EDGES, SQL_NODES, edges, nodes, table
from ..operators import retrieval
from ..streaming import batches

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1))"
ASKED = "customer part brand#12 blue ring"


@query(f"WITH {SQL_NODES}, w AS (SELECT id, entity_type, {WORDS.format('description')} AS words, {WORDS.format(repr(ASKED))} AS asked FROM nodes), s AS (SELECT *, len(list_intersect(words, asked)) AS n FROM w) SELECT id, n / (len(words) + len(asked) - n) + CASE WHEN entity_type = 'PART' THEN 0.05 ELSE 0 END AS score FROM s WHERE n > 0 ORDER BY score DESC, id LIMIT 8")
def session_recall(spark, sf_dir):
    return retrieval.recall(nodes(spark, sf_dir), "id", "description", ASKED, F.col("entity_type") == "PART")


@query(f"WITH {SQL_NODES}, k AS (SELECT id, label, CASE WHEN id = 'nation_7' THEN 0 WHEN lower(label) = 'nation_7' THEN 1 WHEN contains(lower(label), 'nation_7') OR contains(lower(id), 'nation_7') THEN 2 END AS kind FROM nodes) SELECT id, label, kind FROM k WHERE kind IS NOT NULL ORDER BY kind, id LIMIT 1")
def find_node(spark, sf_dir):
    return retrieval.find_node(nodes(spark, sf_dir), "nation_7")


SQL_PROJECT = f"{SQL_NODES}, p AS (SELECT *, split_part(id, ':', 1) AS project FROM nodes)"


def projects(spark, sf_dir):
    return nodes(spark, sf_dir).withColumn("project", F.substring_index("id", ":", 1))


@query(f"WITH {SQL_EDGES}, {SQL_PROJECT}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) t GROUP BY id) SELECT p.id, label, project, coalesce(degree, 0) AS degree FROM p LEFT JOIN d ON p.id = d.id WHERE project IN ('part', 'supplier') AND (contains(lower(label), 'blue') OR contains(lower(description), 'blue')) ORDER BY degree DESC, p.id LIMIT 50")
def cross_project_search(spark, sf_dir):
    return retrieval.search_projects(projects(spark, sf_dir), edges(spark, sf_dir), ["part", "supplier"], "Blue", 50)


SQL_SIDES = "a AS (SELECT 'x:' || p_partkey AS id, p_name AS label, p_type AS entity_type FROM part WHERE p_partkey % 2 = 0), b AS (SELECT 'y:' || p_partkey AS id, p_name AS label, p_type AS entity_type FROM part WHERE p_partkey % 2 = 1)"


@query(f"WITH {SQL_SIDES} SELECT a.id AS source_id, a.label AS source_label, b.id AS target_id, CASE WHEN a.label = b.label THEN 'SAME_NAME' ELSE 'SAME_TYPE' END AS connection_type FROM a JOIN b ON a.label = b.label OR (a.entity_type = b.entity_type AND a.entity_type <> 'MODULE') ORDER BY connection_type, source_label, source_id, target_id LIMIT 20")
def cross_project_connections(spark, sf_dir):
    parts = table(spark, sf_dir, "part")

    def side(mark: str, rest: int):
        return parts.filter(F.col("p_partkey") % 2 == rest).select(F.concat(F.lit(mark), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("entity_type"))

    return retrieval.project_links(side("x:", 0), side("y:", 1), 20)


@query(f"WITH {SQL_NODES} SELECT id FROM nodes WHERE entity_type = 'REGION' OR contains(lower(id), 'supplier:1') OR contains(lower(label), 'widget')")
def dimension_filter(spark, sf_dir):
    wanted = (F.col("entity_type") == "REGION") | F.lower("id").contains("supplier:1") | F.lower("label").contains("widget")
    return retrieval.scoped(nodes(spark, sf_dir), wanted).select("id")


#: Marks of entities, of joined questions and of several steps, for the query below; any lists may be given.
MARKS = ([r"\bring\b", r"\bwidget\b", r"\bbolt\b", r"\bth\w*"], [r"\band\b", r"\bwith\b", r"\ber\w*"], [r"\bacross\b", r"\bin\w*", r"\bon\w*"])


def sql_hits(patterns: list[str], over: str) -> str:
    """Word bounds count letters of any script, which ``\\b`` does not do in DuckDB."""
    begin, end = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
    patterns = [(begin + p[2:-2] + end if p.endswith(r"\b") else begin + p[2:]) for p in patterns]
    return "round(least(1.0, (" + " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INT)" for p in patterns) + f") / {over}), 3)"


@query(
    f"""WITH s AS (SELECT page_id, round(least(1.0, greatest(0.0, (len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) - 4) / 28.0)), 3) AS token_score,
  {sql_hits(MARKS[0], '2.0')} AS entity_score, {sql_hits(MARKS[1], '2.0')} AS conjunction_score, {sql_hits(MARKS[2], '2.0')} AS depth_score FROM (SELECT item_id AS page_id, text FROM benchmark) t),
c AS (SELECT *, CAST(0.25 AS DOUBLE) * token_score + CAST(0.25 AS DOUBLE) * entity_score + CAST(0.25 AS DOUBLE) * conjunction_score + CAST(0.25 AS DOUBLE) * depth_score AS composite FROM s)
SELECT page_id AS item_id, round(composite, 6) AS composite, CASE WHEN composite < 0.25 THEN 'simple' WHEN composite < 0.5 THEN 'moderate' WHEN composite < 0.75 THEN 'complex' ELSE 'expert' END AS tier,
  CASE WHEN composite < 0.25 THEN 5 WHEN composite < 0.5 THEN 10 WHEN composite < 0.75 THEN 15 ELSE 20 END AS max_nodes FROM c"""
)
def query_complexity(spark, sf_dir):
    patterns = {name: (found, 2.0) for name, found in zip(("entity_score", "conjunction_score", "depth_score"), MARKS)}
    tiers = [(0.25, "simple", 5), (0.5, "moderate", 10), (0.75, "complex", 15), (1.0, "expert", 20)]
    scored = retrieval.complexity(table(spark, sf_dir, "benchmark"), "text", patterns, dict.fromkeys(("token_score", *patterns), 0.25), tiers, 4, 32)
    return scored.select("item_id", F.round("composite", 6).alias("composite"), "tier", "max_nodes")


KNOWN = ["red", "nation_1", "region", "supplier"]
SQL_KNOWN = "['nation_1', 'region', 'supplier']"


@query(
    f"""WITH names AS (SELECT n_nationkey AS k, lower(n_name) || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-client' ELSE '_x' END AS name FROM nation UNION ALL SELECT 100 + r_regionkey, replace(lower(r_name), 'e', 'e-') FROM region)
SELECT k, name, CASE WHEN list_contains(['red', 'nation_1', 'region', 'supplier'], name) THEN NULL ELSE list_filter({SQL_KNOWN}, lambda g:
  starts_with(name, g || '-') OR starts_with(name, g || '_') OR ends_with(name, '-' || g) OR ends_with(name, '_' || g) OR regexp_replace(name, '[-_]', '', 'g') = g
  OR (abs(length(name) - length(g)) <= 2 AND len(list_filter(range(1, least(length(name), length(g)) + 1), lambda i: name[i] <> g[i])) + abs(length(name) - length(g)) BETWEEN 1 AND 2))[1] END AS imitates FROM names"""
)
def typosquat(spark, sf_dir):
    key = F.col("n_nationkey") % 3
    named = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lower("n_name"), F.when(key == 0, "").when(key == 1, "-client").otherwise("_x")).alias("name"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).alias("k"), F.replace(F.lower("r_name"), F.lit("e"), F.lit("e-")).alias("name"))
    return named.unionByName(regions).withColumn("imitates", retrieval.look_alike(F.col("name"), KNOWN))


@query(
    """WITH f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 'conflict' WHEN 'purchase' THEN 'anomaly' WHEN 'signup' THEN 'echo' WHEN 'click' THEN 'flip' ELSE 'none' END AS kind,
  CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity FROM events),
c AS (SELECT user_id, user_id % 9 AS nodes, count(*) FILTER (kind = 'conflict' AND severity IN ('high', 'critical')) AS ch, count(*) FILTER (kind = 'conflict' AND severity = 'medium') AS cm, count(*) FILTER (kind = 'conflict' AND severity = 'low') AS cl,
  count(*) FILTER (kind = 'anomaly' AND severity = 'critical') AS ac, count(*) FILTER (kind = 'anomaly' AND severity = 'high') AS ah, count(*) FILTER (kind = 'echo') AS e, count(*) FILTER (kind = 'flip') AS fl FROM f GROUP BY user_id)
SELECT user_id, round(greatest(0, least(1, 1 - (least(ch * 0.08, 0.32) + least(cm * 0.03, 0.15) + least(cl * 0.01, 0.05) + least(ac * 0.10, 0.20) + least(ah * (CAST(0.03 AS DOUBLE) / greatest(1.0, greatest(nodes, 1) / 5.0)), 0.10)
  + least(e * CASE WHEN nodes <= 5 THEN 0.10 ELSE 0.05 END, 0.15) + least(fl * (CAST(0.01 AS DOUBLE) / greatest(1.0, greatest(nodes, 1) / 3.0)), 0.05)))), 6) AS health FROM c"""
)
def observer_health(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    named = F.when(kind == "error", "conflict").when(kind == "purchase", "anomaly").when(kind == "signup", "echo").when(kind == "click", "flip").otherwise("none")
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("event_id") % 4 + 1).cast("int"))
    sizes = events.select("user_id").distinct().withColumn("nodes", F.col("user_id") % 9)
    return retrieval.health(events.select("user_id", named.alias("kind"), severity.alias("severity")), sizes, "user_id").select("user_id", F.round("health", 6).alias("health"))


@query(
    """WITH m AS (SELECT c_nationkey AS node, CAST(month(o_orderdate) AS INT) AS round, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS confidence FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
e AS (SELECT x.n_nationkey AS src, y.n_nationkey AS dst FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey <> y.n_nationkey),
v AS (SELECT n.node AS dst, n.round, least(abs(n.confidence - p.confidence), 0.5) AS s FROM m n JOIN m p ON n.node = p.node AND n.round = p.round + 1)
SELECT e.src AS node, round(sum(v.s), 6) AS influence FROM v JOIN e ON v.dst = e.dst JOIN m ON m.node = e.src AND m.round = v.round - 1 GROUP BY e.src"""
)
def top_influencers(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("node"))
    closed = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    messages = table(spark, sf_dir, "orders").join(customers, "o_custkey").groupBy("node", F.month("o_orderdate").alias("round")).agg(F.avg(closed).alias("confidence"))
    nation = table(spark, sf_dir, "nation")
    hears = nation.select(F.col("n_nationkey").alias("src"), "n_regionkey").join(nation.select(F.col("n_nationkey").alias("dst"), "n_regionkey"), "n_regionkey").filter("src <> dst")
    return retrieval.influencers(messages, hears, 1.0, 0.5).select("node", F.round("influence", 6).alias("influence"))


def files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    end = F.element_at(F.array(*map(F.lit, (".py", "/__init__.py", ".ts", ".js", ".jsx"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select(F.concat(F.col("source"), F.lit("/m"), F.col("doc_id").cast("string"), end).alias("path"))


SQL_FILES = "files AS (SELECT source || '/m' || doc_id || ['.py', '/__init__.py', '.ts', '.js', '.jsx'][doc_id % 5 + 1] AS path FROM documents)"


@query(
    f"""WITH {SQL_FILES}, modules AS (SELECT path, regexp_replace(replace(path, '/', '.'), '\\.(py|js|ts|jsx|tsx)$', '') AS module FROM files),
names AS (SELECT 'f:' || path AS name, path FROM files UNION ALL SELECT 'm:' || module, path FROM modules UNION ALL SELECT 'l:' || split_part(module, '.', -1), path FROM modules WHERE length(split_part(module, '.', -1)) > 2),
known AS (SELECT name, min(path) AS found FROM names GROUP BY name),
imports AS (SELECT doc_id AS import_id, CASE doc_id % 4 WHEN 0 THEN source || '.m' || doc_id WHEN 1 THEN source || '/m' || doc_id || '.py' WHEN 2 THEN 'other.m' || (doc_id + 1) ELSE 'numpy' END AS target FROM documents),
tries AS (SELECT import_id, unnest(['f:' || target, 'm:' || target, 'l:' || target, 'f:' || replace(target, '.', '/') || '.py', 'f:' || replace(target, '.', '/') || '/__init__.py', 'f:' || replace(target, '.', '/') || '.ts', 'f:' || replace(target, '.', '/') || '.js', 'm:' || split_part(target, '.', -1), 'l:' || split_part(target, '.', -1)]) AS name, unnest(range(9)) AS rank FROM imports),
best AS (SELECT import_id, arg_min(found, rank) AS target FROM tries JOIN known USING (name) GROUP BY import_id)
SELECT i.import_id, b.target FROM imports i LEFT JOIN best b ON i.import_id = b.import_id"""
)
def pending_edge_resolve(spark, sf_dir):
    key, text = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    target = F.when(key == 0, F.concat(F.col("source"), F.lit(".m"), text)).when(key == 1, F.concat(F.col("source"), F.lit("/m"), text, F.lit(".py"))).when(key == 2, F.concat(F.lit("other.m"), (F.col("doc_id") + 1).cast("string"))).otherwise("numpy")
    return retrieval.resolve_imports(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("import_id"), target.alias("target")), files(spark, sf_dir))


@query(
    """WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SUPPLIER#' || lpad(CAST(user_id AS VARCHAR), 9, '0') WHEN 1 THEN 'nation-' || (user_id % 40) ELSE 'job' || (user_id % 20) END AS service FROM events),
known AS (SELECT lower(s_name) AS name, 'supplier:' || s_suppkey AS target FROM supplier UNION ALL SELECT lower(n_name), 'nation:' || n_nationkey FROM nation UNION ALL SELECT '/aws/lambda/job' || r_regionkey, 'region:' || r_regionkey FROM region),
t AS (SELECT event_id, unnest([service, lower(service), replace(service, '-', '_'), '/aws/lambda/' || service]) AS name, unnest(range(4)) AS rank FROM e)
SELECT event_id, arg_min(target, rank) AS target FROM t JOIN known USING (name) GROUP BY event_id"""
)
def event_service_link(spark, sf_dir):
    key, user = F.col("event_id") % 3, F.col("user_id")
    service = F.when(key == 0, F.concat(F.lit("SUPPLIER#"), F.lpad(user.cast("string"), 9, "0"))).when(key == 1, F.concat(F.lit("nation-"), (user % 40).cast("string"))).otherwise(F.concat(F.lit("job"), (user % 20).cast("string")))
    named = nodes(spark, sf_dir)
    known = named.filter(F.col("entity_type").isin("SUPPLIER", "NATION")).select(F.lower("label").alias("name"), F.col("id").alias("target"))
    jobs = named.filter("entity_type = 'REGION'").select(F.concat(F.lit("/aws/lambda/job"), F.substring_index("id", ":", -1)).alias("name"), F.col("id").alias("target"))
    s = F.col("service")
    return retrieval.first_match(table(spark, sf_dir, "events").select("event_id", service.alias("service")), "event_id", [s, F.lower(s), F.replace(s, F.lit("-"), F.lit("_")), F.concat(F.lit("/aws/lambda/"), s)], known.unionByName(jobs), "name", "target")


@query("WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k, min(event_id) OVER (PARTITION BY event_type) AS src FROM events) SELECT src, event_id AS dst, event_type FROM r WHERE k BETWEEN 2 AND 5")
def related_events(spark, sf_dir):
    return retrieval.related_events(table(spark, sf_dir, "events"), "event_id", "event_type")


@query("SELECT event_type, count(DISTINCT user_id) AS nodes, count(*) AS activations, round(count(*) / CAST((SELECT count(*) FROM events) AS DOUBLE), 6) AS share, round(avg(CASE WHEN value > 10 THEN 1.0 ELSE 0.0 END), 6) AS usefulness FROM events GROUP BY event_type")
def type_usage(spark, sf_dir):
    used = retrieval.type_usage(table(spark, sf_dir, "events"), "event_type", "user_id", F.col("value") > 10)
    return used.select("event_type", "nodes", "activations", F.round("share", 6).alias("share"), F.round("usefulness", 6).alias("usefulness"))


@query(
    """WITH o AS (SELECT DISTINCT event_type AS t, props AS p FROM events), n AS (SELECT t, count(*) AS n FROM o GROUP BY t)
SELECT x.t AS a, y.t AS b, count(*) AS shared, round(count(*) / CAST(least(min(nx.n), min(ny.n)) AS DOUBLE), 6) AS overlap FROM o x JOIN o y ON x.p = y.p AND x.t < y.t JOIN n nx ON nx.t = x.t JOIN n ny ON ny.t = y.t
GROUP BY x.t, y.t HAVING count(*) / CAST(least(min(nx.n), min(ny.n)) AS DOUBLE) >= 0.2"""
)
def type_coactivation(spark, sf_dir):
    return retrieval.coactivation(table(spark, sf_dir, "events"), "event_type", "props", 0.2).withColumn("overlap", F.round("overlap", 6))


@query(
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS age, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(sum(CASE WHEN age = n - 1 THEN 1.0 ELSE 0.3 END * pow(CAST(0.7 AS DOUBLE), age) * value), 6) AS average, count(*) AS n FROM r GROUP BY event_type"""
)
def kg_registry(spark, sf_dir):
    return retrieval.smoothed(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").withColumn("average", F.round("average", 6))


@query("SELECT user_id AS member, max(ts) AS last, CASE WHEN max(ts) < (SELECT max(ts) FROM events) - INTERVAL 6 HOUR THEN 'OFFLINE' ELSE 'ACTIVE' END AS status FROM events GROUP BY user_id")
def kg_registry_status(spark, sf_dir):
    return batches.registry(table(spark, sf_dir, "events"), "user_id", "ts", "6 HOURS")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice / 500000 AS confidence, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice / 500000 DESC, o_orderkey) AS option FROM orders),
g AS (SELECT o_custkey FROM r GROUP BY o_custkey HAVING max(confidence) FILTER (option = 1) - max(confidence) FILTER (option = 2) <= 0.125 AND max(confidence) FILTER (option = 2) >= 0.4)
SELECT o_custkey, option, o_orderkey, confidence FROM r WHERE option <= 4 AND o_custkey IN (SELECT o_custkey FROM g)"""
)
def ambiguous_options(spark, sf_dir):
    messages = table(spark, sf_dir, "orders").withColumn("confidence", F.col("o_totalprice") / 500000)
    return retrieval.ambiguous(messages, "o_custkey", "o_orderkey", "confidence", 0.125, 0.4, 4)


@query(f"WITH {SQL_NODES} SELECT count(*) AS n, CAST(sum(CAST(('0x' || substr(md5(id || '|' || label || '|' || entity_type || '|' || description), 1, 12)) AS BIGINT)) AS VARCHAR) AS digest FROM nodes")
def graph_hash(spark, sf_dir):
    return retrieval.fingerprint(nodes(spark, sf_dir), ["id", "label", "entity_type", "description"])


@query(
    """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0B]+'), lambda x: x <> '') AS words FROM benchmark),
p AS (SELECT item_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w),
d AS (SELECT item_id, CAST(CAST(('0x' || substr(md5(word), 1, 8)) AS BIGINT) % 128 AS INT) AS dim, sum(CAST(1 AS DOUBLE) / place) AS w FROM p GROUP BY 1, 2)
SELECT item_id, dim, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS value FROM d"""
)
def embed_simple(spark, sf_dir):
    return retrieval.bag_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("value", F.round("value", 6))


@query(
    """WITH RECURSIVE h AS (SELECT label AS query_id, 'kg' || (vec_id % 3) AS kg_id, CAST(vec_id AS VARCHAR) AS node_id, CAST(vec_id % 7 AS VARCHAR) AS node_type, 'node ' || (vec_id % 7) AS description, CAST(embedding AS DOUBLE[]) AS v, coalesce(CAST(embedding[1] AS DOUBLE), 0) AS score FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, kg_id ORDER BY score DESC, node_id) - 1 AS place, stddev_pop(score) OVER w AS sd, avg(score) OVER w AS mean FROM h WINDOW w AS (PARTITION BY query_id, kg_id)),
s AS (SELECT query_id, kg_id, node_id, node_type, description, v, ((score - mean) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END + CAST(1 AS DOUBLE) / (60 + place)) * CASE WHEN kg_id = 'kg1' THEN 1.5 ELSE 1 END AS score FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kg_id, node_id) AS k FROM s),
g AS (SELECT query_id, k, [{'kg': kg_id, 'v': v, 'k': k}] AS kept FROM o WHERE k = 1
UNION ALL SELECT o.query_id, o.k, CASE WHEN len(list_filter(g.kept, lambda x: x.kg <> o.kg_id AND list_cosine_similarity(x.v, o.v) >= 0.5)) > 0 THEN g.kept ELSE list_append(g.kept, {'kg': o.kg_id, 'v': o.v, 'k': o.k}) END FROM g JOIN o ON o.query_id = g.query_id AND o.k = g.k + 1),
t AS (SELECT query_id, unnest(arg_max(kept, k)).k AS k FROM g GROUP BY query_id),
c AS (SELECT o.*, min(kg_id) OVER w <> max(kg_id) OVER w AS conflict, count(*) OVER (PARTITION BY query_id, kg_id) / CAST(count(*) OVER (PARTITION BY query_id) AS DOUBLE) AS share FROM o JOIN t USING (query_id, k) WINDOW w AS (PARTITION BY query_id, node_type, substr(description, 1, 50))),
f AS (SELECT query_id, kg_id, node_id, conflict, CASE WHEN share < 0.34 THEN score * least(0.34 / (share + 1e-8), 2.0) ELSE score END AS score FROM c)
SELECT query_id, kg_id, node_id, round(score, 6) AS score, conflict, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kg_id, node_id) - 1 AS INTEGER) AS rank FROM f"""
)
def fed_merge(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    kind = (F.col("vec_id") % 7).cast("string")
    hits = vectors.select(F.col("label").alias("query_id"), F.concat(F.lit("kg"), (F.col("vec_id") % 3).cast("string")).alias("kg_id"), F.col("vec_id").cast("string").alias("node_id"), kind.alias("node_type"), F.concat(F.lit("node "), kind).alias("description"), "embedding", F.element_at("embedding", 1).cast("double").alias("score"))
    return retrieval.fuse(hits, {"kg1": 1.5}, threshold=0.5, least_share=0.34).withColumn("score", F.round("score", 6))


def vector_pairs(spark, sf_dir):
    """Each vector beside itself with its numbers rolled on by one place and halved."""
    rolled = F.concat(F.slice("embedding", 2, 64), F.slice("embedding", 1, 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("a"), F.transform(rolled, lambda x: x * 0.5).alias("b"))


@query()
def alignment_diagnose(spark, sf_dir):
    return retrieval.diagnose(vector_pairs(spark, sf_dir), 64)


@query("WITH r AS (SELECT vec_id, unnest(list_concat(embedding[2:64], embedding[1:1])) AS x, unnest(range(64)) AS pos FROM embeddings) SELECT vec_id, CAST(pos AS INT) AS place, round(CAST(x AS DOUBLE), 4) + 0.0 AS value FROM r")
def procrustes(spark, sf_dir):
    pairs = vector_pairs(spark, sf_dir)
    turned = retrieval.rotate(pairs.select("vec_id", F.col("a").cast("array<double>").alias("a")), "a", retrieval.rotation(pairs, 64))
    return turned.select("vec_id", F.posexplode("a").alias("place", "x")).select("vec_id", "place", (F.round("x", 4) + 0.0).alias("value"))
