"""Node-link JSON graphs and JSON-lines records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "id STRING, label STRING, type STRING, entity_type STRING, description STRING, properties MAP<STRING, STRING>"
LINK = "id STRING, source STRING, target STRING, relationship STRING, weight DOUBLE, properties MAP<STRING, STRING>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link files: edges under ``links`` or ``edges``, types under ``type`` or ``entity_type``; edges without an end are dropped."""
    raw = spark.read.schema(f"nodes ARRAY<STRUCT<{NODE}>>, links ARRAY<STRUCT<{LINK}>>, edges ARRAY<STRUCT<{LINK}>>").option("multiLine", True).json(path)
    nodes = raw.select(F.inline("nodes")).select("id", F.coalesce("label", "id").alias("label"), F.coalesce("type", "entity_type", F.lit("Entity")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"), "properties")
    edges = raw.select(F.inline(F.coalesce("links", "edges"))).filter("source IS NOT NULL AND target IS NOT NULL")
    return nodes, edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("relationship", F.lit("RELATED_TO")).alias("relationship"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "properties")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Tables under ``path``: one Parquet folder each; the committer makes each appear as a whole."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link rows as JSON lines: a file set of nodes and one of links, whose columns have the names of that format. Many tasks write, so there is no one file for all."""
    nodes.select("id", "label", F.col("entity_type").alias("type"), "description", *[c for c in ("properties",) if c in nodes.columns]).write.mode("overwrite").json(f"{path}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relationship", "weight", *[c for c in ("properties",) if c in edges.columns]).write.mode("overwrite").json(f"{path}/links")


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of lists of dicts, as graph libraries give them, with the same defaults as ``read_graph``. Other keys become properties; nested ``properties`` and ``metadata`` lie under outer ones."""

    def rest(row: dict, known: tuple[str, ...]) -> dict[str, str]:
        flat = {k: v for part in ("metadata", "properties") for k, v in (row.get(part) or {}).items()}
        flat |= {k: v for k, v in row.items() if k not in (*known, "metadata", "properties")}
        return {k: str(v) for k, v in flat.items() if v is not None}

    named = [(r["id"], r.get("label") or r["id"], r.get("type") or r.get("entity_type") or "Entity", r.get("description") or "", rest(r, ("id", "label", "type", "entity_type", "description"))) for r in nodes]
    linked = [(r.get("source"), r.get("target"), r.get("relationship") or "RELATED_TO", float(r.get("weight") or 1.0), rest(r, ("id", "source", "target", "relationship", "weight"))) for r in edges if r.get("source") is not None and r.get("target") is not None]
    return (
        spark.createDataFrame(named, "id string, label string, entity_type string, description string, properties map<string,string>"),
        spark.createDataFrame(linked, "src string, dst string, relationship string, weight double, properties map<string,string>"),
    )


def check_dimension(nodes: DataFrame, wanted: int) -> DataFrame:
    """Nodes, after a check that all embeddings have the wanted number of components."""
    wrong = nodes.filter(F.col("embedding").isNotNull() & (F.size("embedding") != wanted)).limit(1).count()
    if wrong:
        raise ValueError(f"embeddings must have {wanted} components")
    return nodes


def append_records(records: DataFrame, path: str, ts: str) -> None:
    """Records appended as JSON lines, a folder for each UTC day."""
    records.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def refuse_shrink(old: DataFrame, new: DataFrame, old_edges: DataFrame | None = None, new_edges: DataFrame | None = None, *, least_share: float = 0.5, small: int = 10, most_edge_loss: float = 0.1, few_edges: int = 100) -> None:
    """Raise if a graph would lose all its nodes, or too many where it has more than ``small``; or more than a tenth of its edges where it has more than ``few_edges``."""
    a, b = old.count(), new.count()
    if a and (not b or (a > small and b < least_share * a)):
        raise ValueError(f"{b} rows would replace {a}")
    if old_edges is not None and new_edges is not None:
        e, f = old_edges.count(), new_edges.count()
        if e > few_edges and 1 - f / e > most_edge_loss:
            raise ValueError(f"{f} edges would replace {e}")


def refuse_loss(old: DataFrame, new: DataFrame, share: float = 0.01, least: int = 50) -> None:
    """Raise if a stored graph of ``least`` nodes or more would lose over ``share`` of them (one node may always go): for every write over an existing graph."""
    a, b = old.count(), new.count()
    if a >= least and b < a - max(1, int(a * share)):
        raise ValueError(f"{b} nodes would replace {a}")
