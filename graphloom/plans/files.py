"""File, routing and transfer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import SQL_NODES, nodes, table
from ..operators import texts
from .retrieval import SQL_FILES, files

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: What a word of a part's name stands for as a file's name and a part's type or brand as a key: a rule over all rows, for the query below.
FILE_WORDS = {"bolt": "package.json", "ring": "api.schema.json", "gear": ".eslintrc.json"}
KEY_WORDS = {"ECONOMY": "openapi", "STANDARD": "Resources", "PROMO": "rules", "LARGE": "$schema", "MEDIUM": "packages", "Brand#1": "dependencies", "Brand#2": "scripts", "Brand#3": "devDependencies"}
SQL_WORDS = lambda words, column: f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE {column} END"


def worded(words: dict[str, str], column):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), column), column)


@query(
    f"""WITH p AS (SELECT 'part/' || p_partkey AS id, {SQL_WORDS(FILE_WORDS, "string_split(p_name, ' ')[2]")} AS name, CASE WHEN p_size > 1 THEN '{{"' || {SQL_WORDS(KEY_WORDS, "p_type")} || '": {{"n": ' || p_size || '}}, "' || {SQL_WORDS(KEY_WORDS, "p_brand")} || '": "' || p_name || '"}}' END AS body FROM part),
f AS (SELECT id, name, body FROM p UNION ALL SELECT 'page/' || page_id, 'page.json', html FROM pages UNION ALL SELECT 'event/' || event_id, 'event.json', props FROM events),
k AS (SELECT *, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' THEN json_keys(CASE WHEN json_valid(body) THEN body END) ELSE [] END AS keys FROM f),
c AS (SELECT id, CASE WHEN name = 'package.json' THEN 'DEPENDENCY_MANIFEST 1.0' WHEN name LIKE '%.schema.json' THEN 'SCHEMA_FILE 0.95' WHEN name LIKE '.%rc.json' THEN 'TOOL_CONFIG 0.9' WHEN body IS NULL THEN 'UNKNOWN 0'
  WHEN list_has_any(keys, ['openapi', 'swagger']) THEN 'API_SPEC 0.95' WHEN list_has_all(keys, ['dependencies', 'scripts']) OR list_has_all(keys, ['dependencies', 'devDependencies']) THEN 'DEPENDENCY_MANIFEST 0.9' WHEN list_contains(keys, 'packages') THEN 'DEPENDENCY_MANIFEST 0.85' WHEN list_contains(keys, 'Resources') THEN 'INFRA_CONFIG 0.95'
  WHEN list_contains(keys, '$schema') THEN 'SCHEMA_FILE 0.8' WHEN list_contains(keys, 'rules') THEN 'TOOL_CONFIG 0.7' WHEN strlen(body) > 51200 THEN 'DATA_FILE 0.6' ELSE 'APP_CONFIG 0.5' END AS told FROM k)
SELECT id, string_split(told, ' ')[1] AS category, CAST(string_split(told, ' ')[2] AS DOUBLE) AS confidence FROM c"""
)
def classify_json(spark, sf_dir):
    """Parts as small JSON files, events' properties, and pages, which aren't JSON."""
    part, text = table(spark, sf_dir, "part"), lambda c: F.col(c).cast("string")
    body = F.concat(F.lit('{"'), worded(KEY_WORDS, F.col("p_type")), F.lit('": {"n": '), text("p_size"), F.lit('}, "'), worded(KEY_WORDS, F.col("p_brand")), F.lit('": "'), F.col("p_name"), F.lit('"}'))
    files_ = part.select(F.concat(F.lit("part/"), text("p_partkey")).alias("id"), worded(FILE_WORDS, F.element_at(F.split("p_name", " "), 2)).alias("path"), F.when(F.col("p_size") > 1, body).alias("body"))
    files_ = files_.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), text("page_id")).alias("id"), F.lit("page.json").alias("path"), F.col("html").alias("body")))
    files_ = files_.unionByName(table(spark, sf_dir, "events").select(F.concat(F.lit("event/"), text("event_id")).alias("id"), F.lit("event.json").alias("path"), F.col("props").alias("body")))
    return texts.classify_json(files_, "path", "body", {"package.json": "DEPENDENCY_MANIFEST"}).select("id", "category", "confidence")


#: Tools and the patterns that speak for them, for the query below; any list may be given.
ROUTES = [("impact", ["th", "er", "qu"]), ("search", ["an", "on"]), ("context", ["in", "ch", "st"])]


@query(
    """WITH h AS (SELECT item_id, """
    + ", ".join("(" + " + ".join(f"CAST(contains(lower(text), '{p}') AS INT)" for p in patterns) + f") AS {name}" for name, patterns in ROUTES)
    + """ FROM benchmark), s AS (SELECT item_id, """
    + ", ".join(f"CASE WHEN {name} > 0 THEN least(0.95, 0.7 + {name} * 0.1) ELSE 0 END AS {name}" for name, _ in ROUTES)
    + """ FROM h), b AS (SELECT *, greatest(0.3, impact, search, context) AS best FROM s)
SELECT item_id, CASE WHEN best <= 0.3 THEN 'reason' WHEN impact = best THEN 'impact' WHEN search = best THEN 'search' ELSE 'context' END AS tool, CAST(best AS DOUBLE) AS confidence FROM b"""
)
def nl_route(spark, sf_dir):
    return texts.route(table(spark, sf_dir, "benchmark"), "text", ROUTES).select("item_id", "tool", F.round("confidence", 2).alias("confidence"))


@query(
    f"""WITH {SQL_FILES}, stems AS (SELECT path, regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS stem FROM files)
SELECT 'tests/test_m' || d.doc_id || '.py' AS src, min(s.path) AS dst FROM documents d JOIN stems s ON s.stem = 'm' || d.doc_id WHERE d.doc_id % 3 = 0 GROUP BY 1"""
)
def test_link(spark, sf_dir):
    tests = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("tests/test_m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"))
    return texts.link_tests(files(spark, sf_dir).unionByName(tests), "path", F.col("path").startswith("tests/"))


@query(f"WITH {SQL_NODES}, c AS (SELECT entity_type, CASE WHEN contains(label, 'bolt') AND entity_type IN ('PART', 'TOOL') THEN 'FASTENER' WHEN contains(label, 'b') AND entity_type = 'PART' THEN 'SMALL_PART' WHEN contains(label, 'NATION') AND entity_type = 'PART' THEN 'NEVER' ELSE entity_type END AS new_type FROM nodes) SELECT new_type AS entity_type, count(*) AS n, count(*) FILTER (new_type <> entity_type) AS changed FROM c GROUP BY new_type")
def reclassify_batch(spark, sf_dir):
    rules = [("bolt", ["PART", "TOOL"], "FASTENER"), ("b", ["PART"], "SMALL_PART"), ("NATION", ["PART"], "NEVER")]
    return texts.reclassify(nodes(spark, sf_dir), "label", "entity_type", rules).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed"))


@query(
    """WITH e AS (SELECT event_type AS d, CASE user_id % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' ELSE 'secret' END AS s, event_id % 4 AS r FROM events)
SELECT 'all' AS kind, NULL AS value, count(*) AS events, CAST(sum(r) AS BIGINT) AS redactions FROM e UNION ALL SELECT 'destination', d, count(*), CAST(sum(r) AS BIGINT) FROM e GROUP BY d UNION ALL SELECT 'sensitivity', s, count(*), CAST(sum(r) AS BIGINT) FROM e GROUP BY s"""
)
def security_report(spark, sf_dir):
    level = F.when(F.col("user_id") % 3 == 0, "public").when(F.col("user_id") % 3 == 1, "internal").otherwise("secret")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("destination"), level.alias("sensitivity"), (F.col("event_id") % 4).alias("redactions"))
    return texts.transfer_report(events, "destination", "sensitivity", "redactions")
