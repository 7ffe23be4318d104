"""Property graph operators.

nodes: (node_id, node_type, name, domain, confidence); edges: (source_id, target_id, relationship_type, confidence). Other
columns pass through where rows do. Searches run level by level: a level is one join of the frontier with the edges and
one grouped minimum, so a node is expanded once a level whatever its degree, and the frontier is written to the shared
folder between levels. Where several answers are as good, the one with the least ids is taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import erased, written

EDGE_KEY = ["source_id", "target_id", "relationship_type"]


def chosen(edges: DataFrame, types: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    out = edges
    if types is not None:
        out = out.filter(F.col("relationship_type").isin(*types))
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    return out


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, relationship_type, confidence, direction): every edge from both of its ends."""
    rest = ["relationship_type", "confidence"]
    out = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), *rest, F.lit("outgoing").alias("direction"))
    return out.union(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), *rest, F.lit("incoming").alias("direction")))


def neighbors(edges: DataFrame, node_id: int, limit: int = 50, types: Sequence[str] | None = None) -> DataFrame:
    """(node_id, relationship_type, direction, confidence): outgoing first, incoming for what is left of the limit."""
    near = undirected(chosen(edges, types)).filter(F.col("a") == node_id)
    order = [F.col("direction") != "outgoing", F.col("b"), F.col("relationship_type")]
    return near.orderBy(*order).limit(limit).select(F.col("b").alias("node_id"), "relationship_type", "direction", "confidence")


def all_paths(edges: DataFrame, start: int, end: int | None = None, max_length: int = 3, types: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """(path, types, directions): all simple paths of at most max_length edges, to `end` or, without it, to any node."""
    und = undirected(chosen(edges, types, min_confidence)).select("a", F.col("b").alias("next"), "relationship_type", "direction")
    none = F.array().cast("array<string>")
    level = edges.sparkSession.range(1).select(F.array(F.lit(start).cast("long")).alias("path"), none.alias("types"), none.alias("directions"))
    out = None
    for _ in range(max_length):
        step = level.join(und, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("next")))
        if end is not None:  # a path ends where it reaches its end
            step = step.filter(F.element_at("path", -1) != end)
        level = step.select(
            F.array_append("path", F.col("next")).alias("path"), F.array_append("types", F.col("relationship_type")).alias("types"), F.array_append("directions", F.col("direction")).alias("directions")
        )
        out = level if out is None else out.union(level)
    return out if end is None else out.filter(F.element_at("path", -1) == end)


def reach(edges: DataFrame, start: int, max_depth: int, types: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """(node_id, depth, path): nodes within max_depth edges, each with a shortest path, the least of them."""
    und = undirected(chosen(edges, types, min_confidence)).select("a", F.col("b").alias("next"))
    seen = edges.sparkSession.range(1).select(F.lit(start).cast("long").alias("node_id"), F.lit(0).alias("depth"), F.array(F.lit(start).cast("long")).alias("path"))
    for depth in range(1, max_depth + 1):
        front = seen.filter(F.col("depth") == depth - 1).join(und, F.col("node_id") == F.col("a"))
        step = front.groupBy("next").agg(F.min(F.array_append("path", F.col("next"))).alias("path"))
        step = step.join(seen.select(F.col("node_id").alias("next")), "next", "left_anti").select(F.col("next").alias("node_id"), F.lit(depth).alias("depth"), "path")
        before, seen = seen, written(seen.union(step))
        erased(before)
        if seen.filter(F.col("depth") == depth).isEmpty():
            break
    return seen


def find_path(edges: DataFrame, start: int, end: int, max_depth: int = 3) -> DataFrame:
    """(step, node_id): a shortest path of at most max_depth nodes, or no rows."""
    got = reach(edges, start, max_depth - 1).filter(F.col("node_id") == end)
    return got.select(F.posexplode("path").alias("step", "node_id"))


def shortest_paths(edges: DataFrame, start: int, max_length: int = 5) -> DataFrame:
    """(target, length, path): length counts nodes, max_length edges."""
    return reach(edges, start, max_length).filter("depth > 0").select(F.col("node_id").alias("target"), (F.col("depth") + 1).alias("length"), "path")


def subgraph(nodes: DataFrame, edges: DataFrame, center: int, max_depth: int = 2, max_nodes: int = 50, types: Sequence[str] | None = None, min_confidence: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, edges between them): the max_nodes nearest nodes, by depth and id."""
    near = reach(edges, center, max_depth, types, min_confidence).select("node_id", "depth").orderBy("depth", "node_id").limit(max_nodes)
    inside = nodes.join(F.broadcast(near), "node_id")
    ends = near.select("node_id")
    kept = chosen(edges, types, min_confidence).join(F.broadcast(ends.withColumnRenamed("node_id", "source_id")), "source_id", "left_semi")
    return inside, kept.join(F.broadcast(ends.withColumnRenamed("node_id", "target_id")), "target_id", "left_semi")


def hierarchy(edges: DataFrame, root: int, types: Sequence[str], max_depth: int = 3) -> DataFrame:
    """(node_id, parent, depth): what stands below a root along incoming edges of the types; a node once, at its least
    depth and under its least parent, so that circles end."""
    down = chosen(edges, types).select(F.col("target_id").alias("up"), F.col("source_id").alias("next"))
    seen = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"))
    for depth in range(1, max_depth + 1):
        step = seen.filter(F.col("depth") == depth - 1).join(down, F.col("node_id") == F.col("up")).groupBy("next").agg(F.min("up").alias("parent"))
        step = step.join(seen.select(F.col("node_id").alias("next")), "next", "left_anti").select(F.col("next").alias("node_id"), "parent", F.lit(depth).alias("depth"))
        before, seen = seen, written(seen.union(step))
        erased(before)
        if seen.filter(F.col("depth") == depth).isEmpty():
            break
    return seen


def match_pattern(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, name_has: str | None = None, domain: str | None = None, min_confidence: float | None = None, edge_types: Sequence[str] = ()) -> DataFrame:
    """Nodes that meet the conditions and have an outgoing edge of each of the edge types."""
    out = nodes
    for on, test in (
        (node_type, F.col("node_type") == node_type), (name_has, F.lower("name").contains((name_has or "").lower())),
        (domain, F.col("domain") == domain), (min_confidence, F.col("confidence") >= (min_confidence or 0.0)),
    ):
        if on is not None:
            out = out.filter(test)
    for kind in edge_types:
        out = out.join(chosen(edges, [kind]).select(F.col("source_id").alias("node_id")), "node_id", "left_semi")
    return out


def canonical(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def upsert_nodes(nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows (name, domain, ...) that are new: one for each canonical name and domain that has no node yet."""
    named = incoming.withColumn("canonical", canonical(F.col("name"))).filter("canonical <> ''")
    first = named.groupBy("canonical", "domain").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in incoming.columns if c != "domain"]), "name").alias("row")).select("canonical", "domain", "row.*")
    known = nodes.select(canonical(F.col("name")).alias("canonical"), "domain").distinct()
    return first.join(known, ["canonical", "domain"], "left_anti")


def upsert_edges(nodes: DataFrame, edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming edges that are new and whose ends exist, each once."""
    ids = nodes.select("node_id")
    new = incoming.dropDuplicates(EDGE_KEY).join(edges, EDGE_KEY, "left_anti")
    for end in ("source_id", "target_id"):
        new = new.join(ids.withColumnRenamed("node_id", end), end, "left_semi")
    return new


def update_rows(rows: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with the values of changes where these are not null; a map column takes over the keys that a change names."""
    new = {c: f"__{c}" for c in changes.columns if c not in key}
    joined = rows.join(changes.withColumnsRenamed(new), list(key), "left")

    def value(c):
        if c not in new:
            return F.col(f"`{c}`")
        if rows.schema[c].dataType.typeName() == "map":
            kept = F.map_filter(F.coalesce(c, F.create_map().cast(rows.schema[c].dataType)), lambda k, v: ~F.coalesce(F.map_contains_key(new[c], k), F.lit(False)))
            return F.when(F.col(new[c]).isNull(), F.col(c)).otherwise(F.map_concat(kept, new[c])).alias(c)
        return F.coalesce(new[c], c).alias(c)

    return joined.select(*[value(c) for c in rows.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of ids (node_id) and the edges that touch them."""
    for end in ("source_id", "target_id"):
        edges = edges.join(ids.select(F.col("node_id").alias(end)), end, "left_anti").select(*edges.columns)
    return nodes.join(ids.select("node_id"), "node_id", "left_anti").select(*nodes.columns), edges


def delete_domain(nodes: DataFrame, edges: DataFrame, domain: str, confirmed: bool = False) -> tuple[DataFrame, DataFrame]:
    if not confirmed:
        raise ValueError("deleting a domain must be confirmed")
    return delete_nodes(nodes, edges, nodes.filter(F.col("domain") == domain))


def merge_nodes(rows: DataFrame, columns: Sequence[str], kept: int, dropped: int) -> DataFrame:
    """rows with one id put for another in the columns."""
    return rows.withColumns({c: F.when(F.col(c) == dropped, F.lit(kept).cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns})


def extract_nodes(mentions: DataFrame) -> DataFrame:
    """(entity_id, confidence, contents): entities mentioned more than once; the mean confidence is rounded to six places.

    Sums and the mean are of whole billionths, so the result doesn't depend on the order of rows."""
    units = F.sum((F.col("confidence").cast("decimal(18,9)") * F.lit(1_000_000_000)).cast("long"))
    out = mentions.groupBy("entity_id").agg(units.alias("s"), F.count("confidence").alias("k"), F.countDistinct("content_id").alias("contents"), F.count(F.lit(1)).alias("n"))
    return out.filter("n > 1").select("entity_id", F.expr("((2 * s + 1000 * k) div (2000 * k)) / 1e6D").alias("confidence"), "contents")
