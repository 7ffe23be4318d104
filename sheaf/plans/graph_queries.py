"""Property graph: upserts, neighbours, paths, subgraphs, patterns, contradictions, credibility, layouts."""

from .fixtures import sql_query as q

q("kg_insert_claim", "SELECT claim_id, content, confidence FROM claims UNION ALL SELECT CAST(-1 AS BIGINT), 'new claim', 1e0")
q("claim_name", "SELECT content_id, CASE WHEN length(extracted_text) > 100 THEN substr(extracted_text, 1, 100) || '...' ELSE extracted_text END AS name FROM content")
q("kg_point_lookup", "SELECT node_id, name, node_type FROM nodes WHERE node_id = 100001")
q("kg_sources", "SELECT node_id, url, confidence FROM edge_sources WHERE node_id = 10000001")
q("kg_batch_store_valid", "SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND trim(p_name) <> '' AND p_retailprice > 0")
q("node_format", """SELECT n.node_id, n.name, n.node_type, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM nodes n LEFT JOIN (SELECT source_id, count(*) AS n FROM edges GROUP BY source_id) o ON o.source_id = n.node_id
    LEFT JOIN (SELECT target_id, count(*) AS n FROM edges GROUP BY target_id) i ON i.target_id = n.node_id""")
q("node_viz_format", "SELECT node_id, CASE node_type WHEN 'entity' THEN 'dot' WHEN 'event' THEN 'diamond' WHEN 'concept' THEN 'triangle' ELSE 'square' END AS shape, round(5 + 10 * coalesce(confidence, 0.5e0), 6) AS size FROM nodes")
q("edge_viz_format", "SELECT source_id, target_id, round(1 + 2 * confidence, 6) AS width, confidence AS opacity FROM edges")
q("sink_vis_js", "SELECT e.source_id AS edge_from, e.target_id AS edge_to, CASE WHEN e.relationship_type IN ('part_of', 'located_in') THEN 'hierarchy' ELSE 'association' END AS edge_class FROM edges e")
q("sink_graph_json", "SELECT n.node_id, n.node_type, n.name FROM nodes n WHERE n.confidence >= 0.8e0 AND n.domain = 'trade'")
q("contradictions_unresolved", "SELECT c.claim_id, n.domain FROM claims c JOIN nodes n ON n.node_id = 1000000 + c.entity_id WHERE c.claim_id % 4 = 0 ORDER BY c.claim_id LIMIT 100")
q("similarity_matrix", """WITH v AS (SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM embeddings), n AS (SELECT vec_id, label, e, sqrt(aggregate(e, 0D, (p, x) -> p + x * x)) AS len FROM v)
    SELECT a.vec_id AS v1, b.vec_id AS v2, round(aggregate(zip_with(a.e, b.e, (x, y) -> x * y), 0D, (p, x) -> p + x) / greatest(a.len * b.len, 1e-10), 4) + 0D AS cosine FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id""",
  """WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings)
    SELECT a.vec_id AS v1, b.vec_id AS v2, round(list_dot_product(a.e, b.e) / greatest(a.len * b.len, 1e-10), 4) + CAST(0 AS DOUBLE) AS cosine FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id""")
# ---- taxonomy
q("taxonomy_db_roundtrip", "SELECT c.topic_id, c.name, p.name AS parent_name FROM topics c LEFT JOIN topics p ON p.topic_id = c.parent_id")
q("entity_type_tree", """WITH RECURSIVE t AS (SELECT topic_id, name AS full_name FROM topics WHERE parent_id IS NULL UNION ALL SELECT c.topic_id, t.full_name || '.' || c.name FROM t JOIN topics c ON c.parent_id = t.topic_id)
    SELECT topic_id, full_name, full_name LIKE 'ASIA%' AS is_subtype FROM t""")
q("classifier_attach", "SELECT p.topic_id AS parent_id, c.topic_id AS child_id FROM topics p JOIN topics c ON c.parent_id = p.topic_id")
q("default_classification", "SELECT content_id, t.topic, t.confidence FROM classification CROSS JOIN (VALUES ('general', 0.7e0), ('sub1', 0.6e0), ('sub2', 0.5e0)) AS t(topic, confidence) WHERE is_relevant")
q("basic_keyword_relevance", """SELECT content_id, m, round(least(0.9e0, 0.3e0 + 0.1e0 * m), 6) AS confidence FROM (SELECT content_id, CAST((CASE WHEN lower(extracted_text) LIKE '%the%' THEN 1 ELSE 0 END) + (CASE WHEN lower(extracted_text) LIKE '%and%' THEN 1 ELSE 0 END)
    + (CASE WHEN lower(extracted_text) LIKE '%der%' THEN 1 ELSE 0 END) + (CASE WHEN lower(extracted_text) LIKE '%license%' THEN 1 ELSE 0 END) AS BIGINT) AS m FROM content) t""")
# ---- entities
q("kb_lookup", "SELECT k.entity_id, 1e0 AS score FROM kb_entities k WHERE lower(k.name) = (SELECT lower(max(p_name)) FROM part) UNION ALL SELECT entity_id, 0.9e0 FROM kb_entities WHERE alias = 'Brand#11'")
q("type_compatible", "SELECT a.type AS actual, b.type AS expected, a.type = b.type OR a.type LIKE b.type || '.%' AS ok FROM (SELECT DISTINCT type FROM kb_entities) a CROSS JOIN (SELECT DISTINCT type FROM kb_entities) b")
q("mentions_in_content", "SELECT entity_id, start_char, end_char FROM mentions WHERE content_id = 7")
q("content_with_entity", "SELECT DISTINCT content_id FROM mentions WHERE entity_id = 5 ORDER BY content_id LIMIT 20")
q("kb_register", "SELECT lower(name) AS key, entity_id, 'name' AS kind FROM kb_entities UNION ALL SELECT lower(alias), entity_id, 'alias' FROM kb_entities")
q("kb_persist", "SELECT entity_id, name FROM kb_entities WHERE entity_id % 2 = 0 UNION ALL SELECT entity_id, lower(name) FROM kb_entities k WHERE entity_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM kb_entities o WHERE o.entity_id % 2 = 0 AND o.entity_id = k.entity_id)")
q("mention_persist", "SELECT m.content_id, m.start_char, k.entity_id FROM mentions m LEFT JOIN (SELECT entity_id FROM kb_entities WHERE type LIKE 'S%') k ON k.entity_id = m.entity_id")
q("knowledge_pipeline", """SELECT m.content_id, count(DISTINCT m.entity_id) AS nodes, round(avg(m.confidence), 6) AS confidence, max(coalesce(p.n, 0)) AS pairs FROM mentions m LEFT JOIN (SELECT a.content_id, count(*) AS n FROM mentions a JOIN mentions b ON a.content_id = b.content_id AND b.start_char - a.end_char BETWEEN 0 AND 100 AND a.entity_id <> b.entity_id GROUP BY a.content_id) p ON p.content_id = m.content_id GROUP BY m.content_id""")
q("kb_similarity", "SELECT a.n_name AS a, b.n_name AS b, round(CASE WHEN a.n_name = b.n_name THEN 1e0 WHEN contains(a.n_name, b.n_name) OR contains(b.n_name, a.n_name) THEN 0.8e0 * least(length(a.n_name), length(b.n_name)) / greatest(length(a.n_name), length(b.n_name)) + 0.2e0 ELSE 1e0 - CAST(levenshtein(a.n_name, b.n_name) AS DOUBLE) / greatest(length(a.n_name), length(b.n_name)) END, 6) AS similarity FROM nation a CROSS JOIN nation b")
q("context_relevance", "SELECT doc_id, round(least(1e0, ln(1e0 + (length(text) - length(replace(text, 'the', ''))) / 3) / 2), 6) AS relevance FROM documents")
# ---- streaming in batch form, and event-time extras
q("running_domain_state", "SELECT domain, count(*) AS n, round(avg(quality_score), 6) AS mean_quality FROM crawl_log GROUP BY domain")
q("event_tumbling", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('hour', ts), event_type")