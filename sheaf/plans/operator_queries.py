"""Queries that call the graph, claim, linking, taxonomy and credibility operators. The SQL beside them is written on its own:
recursion where the operator goes level by level, pairs where it compares classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import credibility, url
from ..operators import claims, crawl, graph, linking, taxonomy
from .fixtures import expanded, run_sql, view
from .registry import query


def q(name: str, sql: str):
    return query(name, expanded(sql))


UND = "und AS (SELECT source_id AS a, target_id AS b, confidence FROM edges UNION ALL SELECT target_id, source_id, confidence FROM edges)"


@q("kg_neighbors", """SELECT node_id, relationship_type, direction, confidence FROM (SELECT target_id AS node_id, relationship_type, 'outgoing' AS direction, confidence, 0 AS o FROM edges WHERE source_id = 105
    UNION ALL SELECT source_id, relationship_type, 'incoming', confidence, 1 FROM edges WHERE target_id = 105) t ORDER BY o, node_id, relationship_type LIMIT 50""")
def kg_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.neighbors(view(spark, sf_dir, "edges"), 105)


@q("kg_all_paths", f"""WITH RECURSIVE {UND}, p AS (SELECT [CAST(100001 AS BIGINT)] AS path UNION ALL SELECT list_append(p.path, u.b) FROM p JOIN und u ON u.a = p.path[-1]
    WHERE len(p.path) <= 3 AND u.confidence >= 0.5e0 AND NOT list_contains(p.path, u.b)) SELECT CAST(len(path) - 1 AS INT) AS length, array_to_string(path, '>') AS path FROM p WHERE len(path) > 1""")
def kg_all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.all_paths(view(spark, sf_dir, "edges"), 100001, max_length=3, min_confidence=0.5)
    return got.select((F.size("path") - 1).alias("length"), F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@q("kg_find_path", f"""WITH RECURSIVE {UND}, p AS (SELECT [CAST(100 AS BIGINT)] AS path UNION ALL SELECT list_append(p.path, u.b) FROM p JOIN und u ON u.a = p.path[-1] WHERE len(p.path) < 3 AND NOT list_contains(p.path, u.b)),
    best AS (SELECT path FROM p WHERE path[-1] = 105 ORDER BY len(path), path LIMIT 1) SELECT CAST(s - 1 AS INT) AS step, path[s] AS node_id FROM best, range(1, 4) r(s) WHERE s <= len(path)""")
def kg_find_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.find_path(view(spark, sf_dir, "edges"), 100, 105, max_depth=3)


@q("kg_shortest_path", f"""WITH RECURSIVE {UND}, reach AS (SELECT CAST(100001 AS BIGINT) AS n, 0 AS d UNION SELECT u.b, r.d + 1 FROM reach r JOIN und u ON u.a = r.n WHERE r.d < 5)
    SELECT n AS target, CAST(min(d) + 1 AS INT) AS length FROM reach WHERE n <> 100001 GROUP BY n""")
def kg_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest_paths(view(spark, sf_dir, "edges"), 100001, max_length=5).select("target", "length")


@q("kg_subgraph", f"""WITH RECURSIVE {UND}, reach AS (SELECT CAST(2 AS BIGINT) AS n, 0 AS d UNION SELECT u.b, r.d + 1 FROM reach r JOIN und u ON u.a = r.n WHERE r.d < 2 AND u.confidence >= 0.6e0),
    near AS (SELECT n, min(d) AS d FROM reach GROUP BY n ORDER BY d, n LIMIT 50) SELECT k.node_id, k.name, CAST(d AS INT) AS depth FROM near JOIN nodes k ON k.node_id = near.n""")
def kg_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, _ = graph.subgraph(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), 2, max_depth=2, max_nodes=50, min_confidence=0.6)
    return got.select("node_id", "name", "depth")


@q("kg_subgraph_edges", f"""WITH RECURSIVE {UND}, reach AS (SELECT CAST(2 AS BIGINT) AS n, 0 AS d UNION SELECT u.b, r.d + 1 FROM reach r JOIN und u ON u.a = r.n WHERE r.d < 2 AND u.confidence >= 0.6e0),
    near AS (SELECT n, min(d) AS d FROM reach GROUP BY n ORDER BY d, n LIMIT 50) SELECT source_id, target_id, relationship_type FROM edges
    WHERE confidence >= 0.6e0 AND source_id IN (SELECT n FROM near) AND target_id IN (SELECT n FROM near)""")
def kg_subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, got = graph.subgraph(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), 2, max_depth=2, max_nodes=50, min_confidence=0.6)
    return got.select("source_id", "target_id", "relationship_type")


@q("kg_hierarchy", """WITH RECURSIVE h AS (SELECT CAST(1 AS BIGINT) AS node_id, CAST(NULL AS BIGINT) AS parent, 0 AS depth UNION ALL SELECT e.source_id, h.node_id, h.depth + 1 FROM h JOIN edges e ON e.target_id = h.node_id WHERE h.depth < 3)
    SELECT node_id, min(parent) AS parent, CAST(min(depth) AS INT) AS depth FROM h GROUP BY node_id""")
def kg_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.hierarchy(view(spark, sf_dir, "edges"), 1, ["part_of", "located_in", "involves"])


@q("kg_pattern", """SELECT n.node_id, n.name FROM nodes n WHERE n.node_type = 'entity' AND n.confidence >= 0.6e0 AND n.domain = 'trade'
    AND EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.node_id AND e.relationship_type = 'located_in')""")
def kg_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = graph.match_pattern(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), node_type="entity", domain="trade", min_confidence=0.6, edge_types=["located_in"])
    return got.select("node_id", "name")


_INCOMING = "SELECT p_name AS name, 'trade' AS domain FROM part UNION ALL SELECT s_name, 'trade' FROM supplier UNION ALL SELECT r_name, 'trade' FROM region"


@q("kg_upsert_entity", f"""SELECT i.canonical, i.domain, i.name FROM (SELECT lower(trim(name)) AS canonical, domain, min(name) AS name FROM ({_INCOMING}) x GROUP BY lower(trim(name)), domain) i
    WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE lower(trim(n.name)) = i.canonical AND n.domain = i.domain)""")
def kg_upsert_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert_nodes(view(spark, sf_dir, "nodes"), run_sql(spark, sf_dir, _INCOMING)).select("canonical", "domain", "name")


_EDGES = "SELECT 100000 + s_suppkey AS source_id, CAST(100 + (s_nationkey + s_suppkey % 2) AS BIGINT) AS target_id, 'located_in' AS relationship_type FROM supplier"


@q("kg_upsert_edge", f"""SELECT DISTINCT p.source_id, p.target_id FROM ({_EDGES}) p WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = p.source_id) AND EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = p.target_id)
    AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = p.source_id AND e.target_id = p.target_id AND e.relationship_type = 'located_in')""")
def kg_upsert_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.upsert_edges(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), run_sql(spark, sf_dir, _EDGES)).select("source_id", "target_id")


_CHANGES = "SELECT CAST(100 + n_nationkey AS BIGINT) AS node_id, lower(n_name) AS name, 0.9e0 AS confidence FROM nation WHERE n_nationkey < 12"


@q("kg_update_node", f"SELECT n.node_id, coalesce(u.name, n.name) AS name, coalesce(u.confidence, n.confidence) AS confidence FROM nodes n LEFT JOIN ({_CHANGES}) u ON u.node_id = n.node_id")
def kg_update_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.update_rows(view(spark, sf_dir, "nodes"), run_sql(spark, sf_dir, _CHANGES), ["node_id"]).select("node_id", "name", "confidence")


@q("kg_delete_domain", """WITH gone AS (SELECT node_id FROM nodes WHERE domain = 'geo') SELECT (SELECT count(*) FROM nodes WHERE domain <> 'geo') AS nodes_left,
    (SELECT count(*) FROM edges WHERE source_id NOT IN (SELECT node_id FROM gone) AND target_id NOT IN (SELECT node_id FROM gone)) AS edges_left""")
def kg_delete_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = graph.delete_domain(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), "geo", confirmed=True)
    return nodes.agg(F.count(F.lit(1)).alias("nodes_left")).join(edges.agg(F.count(F.lit(1)).alias("edges_left")))


@q("kg_delete_node", """SELECT source_id, target_id, relationship_type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE (e.source_id = 100 + n.n_nationkey OR e.target_id = 100 + n.n_nationkey) AND n.n_regionkey = 1)""")
def kg_delete_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = run_sql(spark, sf_dir, "SELECT CAST(100 + n_nationkey AS BIGINT) AS node_id FROM nation WHERE n_regionkey = 1")
    return graph.delete_nodes(view(spark, sf_dir, "nodes"), view(spark, sf_dir, "edges"), gone)[1].select("source_id", "target_id", "relationship_type")


@q("kg_extract_nodes", """SELECT entity_id, CAST((2 * s + 1000 * n) // (2000 * n) AS DOUBLE) / 1e6 AS confidence, contents FROM (SELECT entity_id, count(*) AS n, count(DISTINCT content_id) AS contents,
    CAST(sum(CAST(round(confidence * 1e9) AS BIGINT)) AS BIGINT) AS s FROM mentions GROUP BY entity_id) t WHERE n > 1""")
def kg_extract_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.extract_nodes(view(spark, sf_dir, "mentions"))


@q("entity_merge", "SELECT content_id, start_char, CASE WHEN entity_id = 2 THEN 1 ELSE entity_id END AS entity_id FROM mentions")
def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.merge_nodes(view(spark, sf_dir, "mentions"), ["entity_id"], 1, 2).select("content_id", "start_char", "entity_id")


# ---- claims
_NOT = " OR ".join(f"contains({{a}}, '{m.replace(chr(39), chr(39) * 2)}')" for m in claims.NEGATIONS)
_OPP = " OR ".join(f"(contains(x.t, '{a}') AND contains(y.t, '{b}')) OR (contains(x.t, '{b}') AND contains(y.t, '{a}'))" for a, b in claims.OPPOSED)
_CLASS = "c AS (SELECT min(claim_id) AS id, count(*) AS n, max(confidence) AS p, entity_id, claim_type, sentiment, lower(content) AS t FROM {table} GROUP BY entity_id, claim_type, sentiment, lower(content))"
_KIND = f"""CASE WHEN abs(x.sentiment - y.sentiment) > 1e0 THEN 'sentiment_conflict' WHEN (({_NOT.format(a="x.t")}) AND contains(x.t, y.t)) OR (({_NOT.format(a="y.t")}) AND contains(y.t, x.t)) THEN 'direct_negation'
    WHEN x.claim_type = 'factual' AND y.claim_type = 'factual' AND length(x.t) > 20 AND length(y.t) > 20 AND ({_OPP})
    AND len(list_intersect(list_distinct(string_split(x.t, ' ')), list_distinct(string_split(y.t, ' ')))) > 0.5e0 * least(len(list_distinct(string_split(x.t, ' '))), len(list_distinct(string_split(y.t, ' ')))) THEN 'factual_conflict' END"""
_PAIRS = f"w AS (SELECT x.entity_id, x.id AS c1, y.id AS c2, x.n * y.n AS n_pairs, x.p AS p1, y.p AS p2, {_KIND} AS kind FROM c x JOIN c y ON x.entity_id = y.entity_id AND x.id < y.id)"


def _with(table: str, select: str) -> str:
    return f"WITH {_CLASS.format(table=table)}, {_PAIRS} {select}"


def _conflicts(spark: SparkSession, sf_dir: str, table: str = "claims", kinds: tuple[str, ...] = claims.KINDS) -> DataFrame:
    return claims.conflicts(claims.classes(view(spark, sf_dir, table)), kinds)


@q("cross_claim_pairs", _with("claims", "SELECT c1, c2, kind, n_pairs FROM w WHERE kind IS NOT NULL"))
def cross_claim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir).select("c1", "c2", "kind", "n_pairs")


@q("contradiction_sentiment", "SELECT a.entity_id, count(*) AS n FROM claims a JOIN claims b ON a.entity_id = b.entity_id AND a.claim_id < b.claim_id WHERE abs(a.sentiment - b.sentiment) > 1e0 GROUP BY a.entity_id")
def contradiction_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir, kinds=claims.KINDS[:1]).groupBy("entity_id").agg(F.sum("n_pairs").alias("n"))


@q("contradiction_negation", _with("statements", "SELECT c1, c2 FROM w WHERE kind = 'direct_negation'"))
def contradiction_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir, "statements", claims.KINDS[1:2]).select("c1", "c2")


@q("contradiction_factual", _with("statements", "SELECT c1, c2, n_pairs FROM w WHERE kind = 'factual_conflict'"))
def contradiction_factual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conflicts(spark, sf_dir, "statements", claims.KINDS[2:]).select("c1", "c2", "n_pairs")


@q("contradiction_candidates", "SELECT DISTINCT a.claim_id FROM claims a JOIN claims b ON a.entity_id = b.entity_id WHERE b.claim_id = 3 AND a.claim_id <> 3")
def contradiction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.candidates(view(spark, sf_dir, "claims"), 3)


@q("contradiction_record", _with("claims", "SELECT DISTINCT CASE WHEN p1 >= p2 THEN c1 ELSE c2 END AS primary_id, CASE WHEN p1 >= p2 THEN c2 ELSE c1 END AS contra_id, kind FROM w WHERE kind IS NOT NULL"))
def contradiction_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = claims.classes(view(spark, sf_dir, "claims"))
    return claims.records(claims.conflicts(of), of)


@q("contradiction_attributes", "SELECT node_id, CAST(NULL AS STRING) AS attribute FROM nodes WHERE 1 = 0")
def contradiction_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.entity_attributes(view(spark, sf_dir, "nodes"))


@q("claim_common_words", """SELECT a.claim_id AS c1, b.claim_id AS c2, len(list_intersect(a.w, b.w)) > 0.5e0 * least(len(a.w), len(b.w)) AS common
    FROM (SELECT claim_id, list_distinct(string_split(lower(content), ' ')) AS w FROM claims) a JOIN (SELECT claim_id, list_distinct(string_split(lower(content), ' ')) AS w FROM claims) b ON b.claim_id = a.claim_id + 1""")
def claim_common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "claims").select("claim_id", F.lower("content").alias("t"))
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, F.col("b.claim_id") == F.col("a.claim_id") + 1)
    return met.select(F.col("a.claim_id").alias("c1"), F.col("b.claim_id").alias("c2"), claims.common_words(F.col("a.t"), F.col("b.t")).alias("common"))


@q("kg_upsert_event", "SELECT e.event_id FROM domain_events e WHERE NOT EXISTS (SELECT 1 FROM domain_events o WHERE o.start_at = e.start_at AND o.event_id < e.event_id AND contains(lower(o.name), lower(e.name)))")
def kg_upsert_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "domain_events").select("event_id", "start_at", F.lower("name").alias("name"))
    e, o = own.alias("e"), own.alias("o")
    same = (F.col("o.start_at") == F.col("e.start_at")) & (F.col("o.event_id") < F.col("e.event_id")) & F.contains(F.col("o.name"), F.col("e.name"))
    return e.join(o, same, "left_anti").select("event_id")


# ---- linking
_NORM = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g'))"
_TYPO = "SELECT entity_id AS mention_id, substr(name, 1, 2) || substr(name, 4) AS text, type, 'about ' || name || ' by ' || alias AS context FROM kb_entities"
_BRAND = "SELECT entity_id + 1000000000 AS mention_id, alias AS text, type, 'about ' || name || ' and ' || name AS context FROM kb_entities"
_SQL_CANDIDATES = f"""m AS (SELECT mention_id, {_NORM.format(x="text")} AS k, type, context FROM ({_TYPO} UNION ALL {_BRAND}) z),
    i AS (SELECT entity_id, type, {_NORM.format(x="name")} AS k, 1e0 AS s FROM kb_entities UNION ALL SELECT entity_id, type, {_NORM.format(x="alias")}, 0.9e0 FROM kb_entities),
    ex AS (SELECT m.mention_id, i.entity_id, max(i.s) AS score FROM m JOIN i ON i.k = m.k AND (i.type = m.type OR starts_with(i.type, m.type || '.')) GROUP BY m.mention_id, i.entity_id),
    fz AS (SELECT m.mention_id, i.entity_id, max(CASE WHEN contains(i.k, m.k) OR contains(m.k, i.k) THEN 0.8e0 * least(length(i.k), length(m.k)) / greatest(length(i.k), length(m.k)) + 0.2e0
        ELSE 1e0 - CAST(levenshtein(i.k, m.k) AS DOUBLE) / greatest(length(i.k), length(m.k)) END) AS score FROM m JOIN i ON i.type = m.type OR starts_with(i.type, m.type || '.')
        WHERE m.mention_id NOT IN (SELECT mention_id FROM ex) GROUP BY m.mention_id, i.entity_id),
    cand AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, entity_id) AS rank FROM (SELECT * FROM ex UNION ALL SELECT * FROM fz WHERE score >= 0.8e0) u)"""


def _kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "kb_entities").select("entity_id", "name", "type", F.array("alias").alias("aliases"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"{_TYPO} UNION ALL {_BRAND}")


@q("fuzzy_theta_join", f"WITH {_SQL_CANDIDATES} SELECT mention_id, entity_id, round(score, 6) AS score FROM cand WHERE rank <= 5 AND mention_id < 1000000000")
def fuzzy_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linking.candidates(run_sql(spark, sf_dir, _TYPO), _kb(spark, sf_dir), threshold=0.8)
    return got.select("mention_id", "entity_id", F.round("score", 6).alias("score"))


@q("candidate_rank", f"WITH {_SQL_CANDIDATES} SELECT mention_id, entity_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM cand WHERE rank <= 5")
def candidate_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linking.candidates(_mentions(spark, sf_dir), _kb(spark, sf_dir), threshold=0.8)
    return got.select("mention_id", "entity_id", F.round("score", 6).alias("score"), "rank")


_COUNTS = "(length(lower(m.context)) - length(replace(lower(m.context), lower({x}), ''))) / length({x})"
_SQL_LINK = f"""WITH {_SQL_CANDIDATES}, t AS (SELECT c.mention_id, c.entity_id, c.score, c.rank, count(*) OVER (PARTITION BY c.mention_id) AS n,
    c.score * (0.5e0 + 0.5e0 * least(1e0, ln(1e0 + {_COUNTS.format(x="e.name")} + {_COUNTS.format(x="e.alias")}) / 2)) AS by_context FROM cand c JOIN m ON m.mention_id = c.mention_id JOIN kb_entities e ON e.entity_id = c.entity_id WHERE c.rank <= 5),
    f AS (SELECT *, CASE WHEN n = 1 THEN score ELSE by_context END AS combined FROM t), g AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY combined DESC, rank) AS place FROM f)"""


@q("disambiguate", f"{_SQL_LINK} SELECT mention_id, entity_id, round(combined, 6) AS score, CASE WHEN n = 1 THEN 'only' ELSE 'context' END AS linked_by FROM g WHERE place = 1 AND (n = 1 OR combined >= 0.5e0)")
def disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _mentions(spark, sf_dir)
    got = linking.link(mentions, _kb(spark, sf_dir), threshold=0.8)
    return got.select("mention_id", "entity_id", F.round("score", 6).alias("score"), "linked_by")


@q("unlinked_mentions", f"{_SQL_LINK} SELECT mention_id FROM m WHERE mention_id NOT IN (SELECT mention_id FROM g WHERE place = 1 AND (n = 1 OR combined >= 0.5e0))")
def unlinked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = _mentions(spark, sf_dir)
    return linking.unlinked(mentions, linking.link(mentions, _kb(spark, sf_dir), threshold=0.8)).select("mention_id")


@q("suggest_entity", f"""SELECT 'trade_' || regexp_replace(lower(type), '[^a-z0-9]+', '_', 'g') || '_' || CAST((SELECT count(*) FROM kb_entities k WHERE k.type = s.type) + row_number() OVER (PARTITION BY type ORDER BY k) AS STRING) AS entity_id, name, type
    FROM (SELECT {_NORM.format(x="c_name")} AS k, 'STANDARD PLATED TIN' AS type, min(c_name) AS name FROM customer GROUP BY {_NORM.format(x="c_name")}) s""")
def suggest_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = run_sql(spark, sf_dir, "SELECT c_name AS text, 'STANDARD PLATED TIN' AS type FROM customer")
    return linking.suggest(new, _kb(spark, sf_dir), "trade")


_HALF = "SELECT entity_id, name, alias, type FROM kb_entities WHERE entity_id <= (SELECT max(entity_id) / 2 FROM kb_entities)"
_NEW = "SELECT p_partkey AS row_id, CASE WHEN p_size < 25 THEN p_partkey END AS entity_id, p_name AS name, p_type AS type FROM part"


@q("entity_get_or_create", f"""WITH half AS ({_HALF}), new AS ({_NEW}), r AS (SELECT n.row_id, n.type, {_NORM.format(x="n.name")} AS k, coalesce(a.entity_id, b.entity_id) AS resolved FROM new n LEFT JOIN half a ON a.entity_id = n.entity_id
    LEFT JOIN (SELECT min(entity_id) AS entity_id, {_NORM.format(x="name")} AS k, type FROM half GROUP BY {_NORM.format(x="name")}, type) b ON b.k = {_NORM.format(x="n.name")} AND b.type = n.type)
    SELECT row_id, resolved, resolved IS NULL AND row_number() OVER (PARTITION BY k, type, resolved IS NULL ORDER BY row_id) = 1 AS created FROM r""")
def entity_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.get_or_create(run_sql(spark, sf_dir, _NEW), run_sql(spark, sf_dir, _HALF)).select("row_id", "resolved", "created")


# ---- taxonomies
_TOPICS = "SELECT CAST(topic_id AS STRING) AS topic_id, CAST(parent_id AS STRING) AS parent_id, name FROM topics"


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, _TOPICS).withColumn("keywords", F.filter(F.split(F.lower("name"), "[^a-z]+"), lambda w: F.length(w) > 3))


_TREE = """t AS (SELECT topic_id, parent_id, name, topic_id AS root, 0 AS level, [name] AS path FROM topics WHERE parent_id IS NULL
    UNION ALL SELECT c.topic_id, c.parent_id, c.name, t.root, t.level + 1, list_append(t.path, c.name) FROM t JOIN topics c ON c.parent_id = t.topic_id)"""
_KEYS = "list_filter(regexp_split_to_array(lower({x}), '[^a-z]+'), lambda w: length(w) > 3)"


@q("taxonomy_path", f"WITH RECURSIVE {_TREE} SELECT CAST(topic_id AS STRING) AS topic_id, CAST(level AS INT) AS level, array_to_string(path, ' > ') AS path FROM t")
def taxonomy_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.paths(_topics(spark, sf_dir))


@q("taxonomy_leaves", "SELECT CAST(topic_id AS STRING) AS topic_id, name FROM topics t WHERE NOT EXISTS (SELECT 1 FROM topics c WHERE c.parent_id = t.topic_id)")
def taxonomy_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.leaves(_topics(spark, sf_dir)).select("topic_id", "name")


@q("taxonomy_lookup", "SELECT CAST(topic_id AS STRING) AS topic_id, CAST(parent_id AS STRING) AS parent_id FROM topics WHERE lower(name) = 'nation_7' OR CAST(topic_id AS STRING) = 'Nation_7'")
def taxonomy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.lookup(_topics(spark, sf_dir), "Nation_7").select("topic_id", "parent_id")


@q("taxonomy_training_data", f"WITH RECURSIVE {_TREE} SELECT CAST(topic_id AS STRING) AS topic_id, lower(name || ' ' || array_to_string({_KEYS.format(x='name')}, ' ') || ' ' || array_to_string(path, ' ')) AS text FROM t")
def taxonomy_training_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.training_texts(_topics(spark, sf_dir))


@q("taxonomy_keywords", f"""WITH RECURSIVE {_TREE}, k AS (SELECT root, name, {_KEYS.format(x='name')} AS ks FROM t), w AS (SELECT root, unnest(list_concat(ks, list_filter(string_split(lower(name), ' '), lambda x: x <> ''))) AS keyword FROM k WHERE len(ks) > 0)
    SELECT DISTINCT lower(r.name) AS domain, w.keyword FROM w JOIN topics r ON r.topic_id = w.root""")
def taxonomy_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.domain_keywords(_topics(spark, sf_dir))


@q("add_domain_keywords", f"""WITH RECURSIVE {_TREE}, k AS (SELECT root, name, {_KEYS.format(x='name')} AS ks FROM t), w AS (SELECT root, unnest(list_concat(ks, list_filter(string_split(lower(name), ' '), lambda x: x <> ''))) AS keyword FROM k WHERE len(ks) > 0)
    SELECT DISTINCT lower(r.name) AS domain, w.keyword FROM w JOIN topics r ON r.topic_id = w.root UNION SELECT * FROM (VALUES ('europe', 'danube'), ('europe', 'alps')) v(domain, keyword)""")
def add_domain_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.domain_keywords(_topics(spark, sf_dir), {"Europe": ["Danube", "Alps"]})


_SCORES = "SELECT e.event_id AS doc_id, CAST(t.topic_id AS STRING) AS topic_id, CAST((e.event_id * 31 + t.topic_id * 17) % 100 AS DOUBLE) / 100 AS score FROM events e JOIN topics t ON t.topic_id < 200"


@q("hierarchical_predict", f"""WITH s AS ({_SCORES}), a AS (SELECT s.doc_id, s.topic_id, CAST(t.parent_id AS STRING) AS up, s.score FROM s JOIN topics t ON CAST(t.topic_id AS STRING) = s.topic_id),
    l0 AS (SELECT * FROM a WHERE up IS NULL), l1 AS (SELECT a.* FROM a JOIN l0 ON l0.doc_id = a.doc_id AND l0.topic_id = a.up WHERE a.score >= 0.5e0)
    SELECT doc_id, topic_id, 0 AS level, score FROM l0 UNION ALL SELECT doc_id, topic_id, 1, score FROM l1""")
def hierarchical_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.hierarchical(run_sql(spark, sf_dir, _SCORES), _topics(spark, sf_dir))


_FILTERED = "SELECT event_id AS doc_id, CAST(event_id % 50 AS DOUBLE) / 100 AS score, event_id % 50 >= 20 AS relevant, event_id % 97 = 0 AS empty FROM events"


@q("classify_pipeline", f"""WITH s AS ({_SCORES}), f AS ({_FILTERED}), a AS (SELECT s.doc_id, s.topic_id, s.score, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.score DESC, s.topic_id) AS r FROM s JOIN topics t ON CAST(t.topic_id AS STRING) = s.topic_id WHERE t.parent_id IS NULL)
    SELECT f.doc_id, CASE WHEN NOT empty AND relevant THEN a.topic_id END AS primary_topic, round(CASE WHEN empty THEN 1e0 WHEN relevant THEN 0.7e0 * a.score + 0.3e0 * f.score ELSE f.score END, 6) AS overall, NOT empty AND relevant AND a.score >= 0.5e0 AS relevant FROM f JOIN a ON a.doc_id = f.doc_id AND a.r = 1""")
def classify_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = taxonomy.hierarchical(run_sql(spark, sf_dir, _SCORES), _topics(spark, sf_dir))
    got = taxonomy.classified(found, run_sql(spark, sf_dir, _FILTERED))
    return got.select("doc_id", "primary_topic", F.round("overall", 6).alias("overall"), "relevant")


@q("hybrid_filter", f"""WITH f AS ({_FILTERED}) SELECT doc_id, round(CASE WHEN score BETWEEN 0.2e0 AND 0.4e0 THEN (score + 2 * (1 - score)) / 3 ELSE score END, 6) AS score,
    CASE WHEN score BETWEEN 0.2e0 AND 0.4e0 THEN (score + 2 * (1 - score)) / 3 ELSE score END >= 0.25e0 AS relevant FROM f""")
def hybrid_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = taxonomy.hybrid(F.col("score"), 1 - F.col("score"))
    return run_sql(spark, sf_dir, _FILTERED).select("doc_id", both.alias("h")).select("doc_id", F.round("h.score", 6).alias("score"), "h.relevant")


# ---- credibility
_HOSTS = "SELECT r_regionkey AS k, CASE r_regionkey WHEN 0 THEN 'www.fifa.com' WHEN 1 THEN 'skysports.com' WHEN 2 THEN 'guardian.co.uk' WHEN 3 THEN 'x.medium.com' ELSE 'example.org' END AS host FROM region"


@q("source_credibility", f"""SELECT host, round(a * 0.4e0 + e * 0.3e0 + 0.7e0 * 0.2e0 + t * 0.1e0, 6) AS overall FROM (SELECT host, CASE k WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.8e0 WHEN 2 THEN 0.8e0 WHEN 3 THEN 0.6e0 ELSE 0.7e0 END AS a,
    CASE k WHEN 0 THEN 0.95e0 WHEN 1 THEN 0.85e0 WHEN 2 THEN 0.7e0 WHEN 3 THEN 0.5e0 ELSE 0.6e0 END AS e, CASE k WHEN 0 THEN 0.85e0 WHEN 1 THEN 0.75e0 WHEN 2 THEN 0.8e0 WHEN 3 THEN 0.5e0 ELSE 0.6e0 END AS t FROM ({_HOSTS}) h) s
    UNION ALL SELECT split_part(split_part(url, '://', 2), '/', 1), round(0.7e0 * 0.4e0 + 0.6e0 * 0.3e0 + 0.7e0 * 0.2e0 + 0.6e0 * 0.1e0, 6) FROM pages""")
def source_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = run_sql(spark, sf_dir, _HOSTS).select("host").union(run_sql(spark, sf_dir, "SELECT url FROM pages").select(url.domain(F.col("url"))))
    return hosts.select("host", F.round(credibility.evaluate(F.col("host"))["overall"], 6).alias("overall"))


_HELD = "SELECT event_type AS key, 0.9e0 AS overall_score, max(ts) AS updated_at, count(*) AS uses FROM events GROUP BY event_type"
_ASKED = "SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN event_type ELSE 'x' || event_type END AS key, 0.5e0 AS overall FROM events"


@q("credibility_cache", f"""SELECT a.key, CASE WHEN c.updated_at > TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY THEN 0.9e0 ELSE 0.5e0 END AS score, CASE WHEN c.key IS NULL THEN 1 WHEN c.updated_at > TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY THEN c.uses ELSE c.uses + 1 END AS uses,
    CASE WHEN c.key IS NULL THEN 'new' WHEN c.updated_at > TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 30 DAY THEN 'reused' ELSE 'updated' END AS state FROM ({_ASKED}) a LEFT JOIN ({_HELD}) c ON c.key = a.key""")
def credibility_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credibility.cached(run_sql(spark, sf_dir, _ASKED), run_sql(spark, sf_dir, _HELD), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))


# ---- crawling
@query("crawl_bfs")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of the pages table from its first page of each host."""
    pages = run_sql(spark, sf_dir, "SELECT page_id, url, html FROM pages")
    seeds = pages.groupBy(url.host(F.col("url"))).agg(F.min_by("url", "page_id").alias("url")).select("url")
    got = crawl.bfs(pages.select("url", "html"), seeds)
    return got.select("url", "depth", F.round("quality", 6).alias("quality"))
