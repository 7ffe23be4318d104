"""JSON Lines in and out: export records, knowledge bases, patterns, graphs and taxonomies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "text string, meta map<string,string>"
KB = "id string, name string, type string, aliases array<string>, attributes map<string,string>"
PATTERN = "label string, pattern string"
GRAPH = (
    "tags array<struct<id:long,name:string>>, nodes array<struct<id:long,type:string,name:string,domain:string,confidence:double,tags:array<string>>>, "
    "edges array<struct<source_id:long,target_id:long,type:string,weight:double,confidence:double>>"
)
_TOPIC = "id:long,name:string,keywords:array<string>"
TAXONOMY = f"name string, nodes array<struct<{_TOPIC},children:array<struct<{_TOPIC},children:array<struct<{_TOPIC},children:array<struct<{_TOPIC}>>>>>>>>"


def write_records(rows: DataFrame, path: str, text: str = "text", meta: str = "meta") -> None:
    """One {"text", "meta"} object a line, UTF-8, NUL characters removed."""
    rows.select(F.to_json(F.struct(F.regexp_replace(F.col(text), r"\x00", "").alias("text"), F.col(meta).alias("meta"))).alias("value")).write.text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KB).json(path, multiLine=True)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PATTERN).json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph document; edges whose ends are missing are left out."""
    g = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = g.select(F.inline("nodes"))
    ids = nodes.select("id")
    edges = g.select(F.inline("edges")).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return nodes, edges


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, parent_id, name, keywords, level) of up to four nested levels."""
    level = spark.read.schema(TAXONOMY).json(path, multiLine=True).select(F.lit(None).cast("long").alias("parent_id"), F.explode("nodes").alias("t"))
    out = None
    for depth in range(4):
        rows = level.select(F.col("t.id").alias("id"), "parent_id", F.col("t.name").alias("name"), F.col("t.keywords").alias("keywords"), F.lit(depth).alias("level"))
        out = rows if out is None else out.unionByName(rows)
        if depth < 3:
            level = level.select(F.col("t.id").alias("parent_id"), F.explode("t.children").alias("t"))
    return out


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, types: list[str] | None = None, min_confidence: float = 0.0, domain: str | None = None) -> None:
    """Nodes and edges as two folders of JSON Lines, so that no graph has to fit into one document."""
    kept = nodes.filter(F.col("confidence") >= min_confidence)
    kept = kept.filter(F.col("node_type").isin(types)) if types else kept
    kept = kept.filter(F.col("domain") == domain) if domain else kept
    ids = kept.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    kept.write.json(f"{path}/nodes")
    inside.write.json(f"{path}/edges")
