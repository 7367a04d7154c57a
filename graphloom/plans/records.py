"""Record, text and ranking queries over events, documents and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graphview import table
from ..operators import relations
from ..operators.components import _store

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("WITH b AS (SELECT least(floor(c * 10), 9) AS bin, c, y FROM (SELECT least(1.0, n_chars / 5000.0) AS c, quality AS y FROM labels JOIN documents ON labels.doc_id = documents.doc_id) t), g AS (SELECT count(*) AS n, avg(c) AS c, avg(y) AS a, sum((c - y) * (c - y)) AS sq FROM b GROUP BY bin) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece, round(max(abs(a - c)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM g")
def calibration_error(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("confidence"), F.col("quality").alias("correct"))
    return relations.calibration(pairs)


@query("WITH c AS (SELECT event_type AS x, user_id % 7 AS y, count(*) AS n FROM events GROUP BY 1, 2), x AS (SELECT x, sum(n) AS nx FROM c GROUP BY x), y AS (SELECT y, sum(n) AS ny FROM c GROUP BY y), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM c) SELECT round(sum(n / total * log2(n * total / (CAST(nx AS DOUBLE) * ny))), 6) AS bits FROM c JOIN x ON c.x = x.x JOIN y ON c.y = y.y CROSS JOIN t")
def mutual_information(spark, sf_dir):
    return relations.mutual_information(table(spark, sf_dir, "events").select(F.col("event_type").alias("x"), (F.col("user_id") % 7).alias("y")), "x", "y")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, least(count(*), 4) AS level FROM events GROUP BY 1")
def session_calendar(spark, sf_dir):
    return relations.day_calendar(table(spark, sf_dir, "events"))


@query("WITH b AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, count(CASE WHEN p <> event_type THEN 1 END) AS flips FROM b GROUP BY user_id")
def type_flips(spark, sf_dir):
    return relations.changes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS times FROM events) SELECT user_id, event_id, event_type, times FROM r WHERE k = 1")
def session_list(spark, sf_dir):
    return relations.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_id, count(*) OVER w AS seen, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) OVER w, 6) AS share FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def learning_curve(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "purchase")
    return relations.running_share(rows, "user_id", ["ts", "event_id"], "hit").select("user_id", "event_id", "seen", "share")


@query("WITH u AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS used FROM conversations) SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM u WHERE used <= 2000")
def budget_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    return relations.budget_prefix(rows, "conv_id", ["turn", "role", "text"], "size", 2000).select("conv_id", "turn", "used")


@query("WITH s AS (SELECT source, avg(n_chars) AS m, stddev_pop(n_chars) AS sd FROM documents GROUP BY source) SELECT doc_id, round(CASE WHEN sd > 0 THEN (n_chars - m) / sd ELSE 0.0 END, 3) AS z FROM documents JOIN s ON documents.source = s.source")
def fed_zscore(spark, sf_dir):
    return relations.zscores(table(spark, sf_dir, "documents"), "source", "n_chars").select("doc_id", F.round("z", 3).alias("z"))


@query("WITH r AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) - 1 AS k FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source) t) SELECT source, round(sum(1.0 / (60 + k)), 9) AS fused FROM r WHERE k < 100 GROUP BY source")
def fed_rrf(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return relations.reciprocal_ranks(hits, "lang", "source", "n", depth=100)


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS window, count(*) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def quality_metrics_window(spark, sf_dir):
    return relations.window_metrics(table(spark, sf_dir, "events"), F.to_date("ts"), "value")


@query("SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def hourly_rate_limit(spark, sf_dir):
    return relations.bounded_rate(table(spark, sf_dir, "events"), "user_id", "ts", 1)


@query("WITH g AS (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM events) SELECT event_id, user_id FROM g WHERE epoch_us(ts) - epoch_us(p) <= 3600000000")
def repeated_within_hour(spark, sf_dir):
    return relations.repeated_within(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 3600).select("event_id", "user_id")


@query("WITH n AS (SELECT event_type AS from_step, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_step FROM events) SELECT from_step, to_step, count(*) AS n FROM n WHERE to_step IS NOT NULL GROUP BY 1, 2")
def mine_sequences(spark, sf_dir):
    return relations.sequences(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT event_type AS category, substr(sha256(event_type || ':' || CAST(user_id % 10 AS VARCHAR)), 1, 16) AS id, count(*) AS hits, min(event_id) AS first FROM events GROUP BY event_type, user_id % 10")
def runtime_event_dedup(spark, sf_dir):
    key = F.concat_ws(":", "event_type", (F.col("user_id") % 10).cast("string"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("category"), F.substring(F.sha2(key, 256), 1, 16).alias("id")).agg(F.count("*").alias("hits"), F.min("event_id").alias("first"))


CLASSES = """WITH t AS (SELECT p_partkey AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> ''))) AS words FROM part),
l AS (SELECT words, min(id) AS c, count(*) AS n FROM t WHERE id % 2 = 0 AND len(words) > 0 GROUP BY words), r AS (SELECT words, min(id) AS c, count(*) AS n FROM t WHERE id % 2 = 1 AND len(words) > 0 GROUP BY words),
p AS (SELECT l.c AS left_id, r.c AS right_id, len(list_intersect(l.words, r.words)) AS s, len(l.words) + len(r.words) AS total, l.n * r.n AS links FROM l, r)
"""


@query(CLASSES + """SELECT 'pair' AS kind, left_id, right_id, round(s / CAST(total - s AS DOUBLE), 4) AS score, links FROM p WHERE round(s / CAST(total - s AS DOUBLE), 4) >= 0.35
UNION ALL SELECT 'left member', l.c, t.id, NULL, NULL FROM t JOIN l ON t.words = l.words WHERE t.id % 2 = 0
UNION ALL SELECT 'right member', r.c, t.id, NULL, NULL FROM t JOIN r ON t.words = r.words WHERE t.id % 2 = 1""")
def bridge_token_overlap(spark, sf_dir):
    """Pairs between classes of equal token sets, and the members of each class.

    Every even name of the smallest table has an exact match on the other side, so linking.unmatched would leave nothing to compare.
    """
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    even, odd = parts.filter("id % 2 = 0"), parts.filter("id % 2 = 1")
    left, right = (_store(relations.token_classes(side))[0] for side in (even, odd))
    pairs = relations.class_pairs(left, right, 0.35).select(F.lit("pair").alias("kind"), "left_id", "right_id", "score", "links")
    sides = [relations.class_members(rows, classes).select(F.lit(kind).alias("kind"), F.col("class_id").alias("left_id"), F.col("id").alias("right_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("links")) for kind, rows, classes in (("left member", even, left), ("right member", odd, right))]
    return pairs.unionByName(sides[0]).unionByName(sides[1])


BAGS = """WITH t AS (SELECT item_id, list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g')), '\\s+'), lambda x: x <> '') AS words FROM benchmark),
b AS (SELECT g.item_id, p.words AS p, g.words AS g FROM t g JOIN t p ON g.item_id = p.item_id + 1),
c AS (SELECT item_id, sum(least(a, b)) AS common FROM (SELECT item_id, w, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM (SELECT item_id, unnest(p) AS w, 0 AS side FROM b UNION ALL SELECT item_id, unnest(g), 1 FROM b) GROUP BY item_id, w) GROUP BY item_id)
SELECT b.item_id, CASE WHEN len(p) + len(g) = 0 THEN 1.0 ELSE round(2.0 * coalesce(common, 0) / (len(p) + len(g)), 6) END AS f1, CAST(p = g AS INTEGER) AS em FROM b LEFT JOIN c ON b.item_id = c.item_id"""


@query(BAGS)
def em_f1(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    b = a.select((F.col("item_id") + 1).alias("item_id"), F.col("gold").alias("predicted"))
    return relations.bag_f1(a.join(b, "item_id"), "predicted", "gold", "item_id")
