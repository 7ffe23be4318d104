"""Dashboards, filters, joins, set operations, windows and top-k over the harvest."""

from .fixtures import sql_query as q

WORDS_S = "size(filter(split(extracted_text, '[ \\\\t\\\\n\\\\r]+'), x -> x <> ''))"
WORDS_D = "len(list_filter(string_split_regex(extracted_text, '[ \\t\\n\\r]+'), lambda x: x <> ''))"


def _both(name: str, text: str) -> None:
    q(name, text.replace("{words}", WORDS_S), text.replace("{words}", WORDS_D))


# ---- §2.5 aggregates of a job
q("dashboard_counts", "SELECT (SELECT count(*) FROM jobs) AS n_jobs, (SELECT count(*) FROM content) AS n_content, (SELECT count(*) FROM jobs WHERE status = 'RUNNING') AS n_running")
_both("content_metadata_build", "SELECT content_id, CAST({words} AS BIGINT) AS word_count, CAST(length(extracted_text) AS BIGINT) AS char_count FROM content")
_both("job_word_stats", """WITH w AS (SELECT job_id, CAST({words} AS BIGINT) AS n FROM content)
    SELECT job_id, min(n) AS min_words, max(n) AS max_words, round(avg(CAST(n AS DOUBLE)), 6) AS avg_words, count(*) FILTER (WHERE n < 100) AS bin_0_100, count(*) FILTER (WHERE n >= 100 AND n < 500) AS bin_100_500,
    count(*) FILTER (WHERE n >= 500 AND n < 1000) AS bin_500_1000, count(*) FILTER (WHERE n >= 1000 AND n < 5000) AS bin_1000_5000, count(*) FILTER (WHERE n >= 5000) AS bin_5000 FROM w GROUP BY job_id""")
_both("backlog_select", "SELECT content_id, url FROM content WHERE {words} >= 100 AND job_id = 1 ORDER BY content_id LIMIT 50")
_both("should_process", "SELECT content_id, {words} >= 100 AS should_process FROM content")
_both("process_by_domain", "SELECT c.content_id, k.primary_topic FROM content c JOIN classification k ON k.content_id = c.content_id WHERE {words} >= 100 AND k.is_relevant")
q("job_processing_time", "SELECT job_id, min(processing_time) AS min_ms, max(processing_time) AS max_ms, round(avg(CAST(processing_time AS DOUBLE)), 6) AS avg_ms FROM content GROUP BY job_id")
q("job_depth_distribution", "SELECT job_id, crawl_depth, count(*) AS n FROM content WHERE crawl_depth IS NOT NULL GROUP BY job_id, crawl_depth")
q("job_languages", "SELECT job_id, language, count(*) AS n FROM content WHERE language IS NOT NULL GROUP BY job_id, language")
q("job_domain_top10", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS domain, count(*) AS n FROM pages GROUP BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY n DESC, domain LIMIT 10")
q("job_extended_depth_count", "SELECT j.job_id, count(*) AS n_extended FROM content c JOIN jobs j ON j.job_id = c.job_id WHERE c.crawl_depth > j.max_depth GROUP BY j.job_id")
q("job_quality_avg", "SELECT domain, round(avg(quality_score), 6) AS avg_quality FROM crawl_log GROUP BY domain")
q("job_high_quality_domains", "SELECT count(DISTINCT domain) AS n_domains FROM (SELECT domain, avg(quality_score) AS a FROM crawl_log GROUP BY domain) t WHERE a > 0.25e0")
_BINS = "(VALUES ('0.0-0.3', 0), ('0.3-0.5', 1), ('0.5-0.7', 2), ('0.7-0.9', 3), ('0.9-1.0', 4)) AS b(bin, k)"
q("job_quality_histogram", f"""WITH c AS (SELECT CASE WHEN quality_score < 0 THEN NULL WHEN quality_score < 0.3e0 THEN 0 WHEN quality_score < 0.5e0 THEN 1 WHEN quality_score < 0.7e0 THEN 2 WHEN quality_score < 0.9e0 THEN 3 WHEN quality_score < 1e0 THEN 4 END AS k, count(*) AS n
    FROM crawl_log GROUP BY 1) SELECT b.bin, coalesce(c.n, 0) AS n FROM {_BINS} LEFT JOIN c ON c.k = b.k""")
q("topic_distribution", "SELECT primary_topic, count(*) AS n FROM classification GROUP BY primary_topic ORDER BY n DESC, primary_topic LIMIT 10")
q("entity_type_distribution", "SELECT k.type AS entity_type, count(*) AS n FROM mentions m JOIN kb_entities k ON k.entity_id = m.entity_id GROUP BY k.type")
q("active_domains", "SELECT count(DISTINCT primary_topic) AS n FROM classification WHERE is_relevant")
q("recent_activity", """SELECT 'classification' AS kind, content_id AS item, confidence AS score FROM (SELECT * FROM classification ORDER BY content_id DESC LIMIT 5) a
    UNION ALL SELECT 'entities', content_id, CAST(count(*) AS DOUBLE) FROM (SELECT * FROM mentions ORDER BY content_id DESC, start_char DESC, entity_id LIMIT 10) b GROUP BY content_id""")
q("storage_stats", "SELECT 'node_type' AS metric, node_type AS k, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'domain', domain, count(*) FROM nodes GROUP BY domain UNION ALL SELECT 'edge_type', relationship_type, count(*) FROM edges GROUP BY relationship_type UNION ALL SELECT 'total', 'tags', count(*) FROM tags UNION ALL SELECT 'total', 'sources', count(*) FROM edge_sources")
q("storage_stats_grouping_sets", "SELECT node_type, domain, count(*) AS n FROM nodes GROUP BY GROUPING SETS ((node_type), (domain), ())")
q("domain_running_avg", """WITH s AS (SELECT seq, domain, sum(CAST(round(quality_score * 1e9) AS BIGINT)) OVER (PARTITION BY domain ORDER BY fetched_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS units,
    count(*) OVER (PARTITION BY domain ORDER BY fetched_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pages FROM crawl_log)
    SELECT seq, domain, CAST((2 * units + 1000 * pages - (2 * units + 1000 * pages) % (2000 * pages)) / (2000 * pages) AS DOUBLE) / 1e6 AS running_avg, pages FROM s""")
q("running_domain_average", "SELECT domain, count(*) AS pages, round(avg(quality_score), 6) AS avg_quality FROM crawl_log GROUP BY domain")
q("entity_counts", "SELECT m.content_id, k.type AS label, count(*) AS n FROM mentions m JOIN kb_entities k ON k.entity_id = m.entity_id GROUP BY m.content_id, k.type")
q("entity_distribution_bins", "SELECT content_id, least(CAST(floor(start_char / 50e0) AS BIGINT), 9) AS bin, count(*) AS n FROM mentions GROUP BY content_id, least(CAST(floor(start_char / 50e0) AS BIGINT), 9)")
q("entity_distribution_pairs", """WITH t AS (SELECT m.content_id, m.start_char, m.entity_id, k.alias AS label FROM mentions m JOIN kb_entities k ON k.entity_id = m.entity_id)
    SELECT a.label AS label1, b.label AS label2, count(*) AS n FROM t a JOIN t b ON a.content_id = b.content_id AND a.start_char < b.start_char AND a.label <> b.label GROUP BY a.label, b.label""")
q("entity_mean_confidence", "SELECT entity_id, round(avg(coalesce(confidence, 1e0)), 6) AS avg_confidence, count(*) AS n FROM mentions GROUP BY entity_id")
q("credibility_weighted_conf", """SELECT s.node_id, round(sum(s.confidence * coalesce(c.overall_score, 1e0)) / sum(coalesce(c.overall_score, 1e0)), 6) AS weighted FROM edge_sources s LEFT JOIN credibility c ON c.url = s.url GROUP BY s.node_id""")
q("content_source_eval", "SELECT s.url, count(*) AS n_sources, round(max(coalesce(c.overall_score, 0.5e0)), 6) AS credibility FROM edge_sources s LEFT JOIN credibility c ON c.url = s.url GROUP BY s.url")
q("text_quality_overall", """SELECT doc_id, round(CASE WHEN k = 0 THEN 0e0 ELSE t / k END, 6) AS overall FROM (SELECT doc_id,
    (CASE WHEN a > 0 THEN a ELSE 0 END) + (CASE WHEN b > 0 THEN b ELSE 0 END) + (CASE WHEN c > 0 THEN c ELSE 0 END) + (CASE WHEN d > 0 THEN d ELSE 0 END) AS t,
    (CASE WHEN a > 0 THEN 1 ELSE 0 END) + (CASE WHEN b > 0 THEN 1 ELSE 0 END) + (CASE WHEN c > 0 THEN 1 ELSE 0 END) + (CASE WHEN d > 0 THEN 1 ELSE 0 END) AS k
    FROM (SELECT doc_id, CAST(n_chars % 7 AS DOUBLE) / 7 AS a, CAST(n_chars % 5 AS DOUBLE) / 5 AS b, CAST(n_chars % 3 AS DOUBLE) / 3 AS c, CAST(n_chars % 2 AS DOUBLE) / 2 AS d FROM documents) m) s""")
q("annotation_stats", "SELECT count(*) AS total, count(*) FILTER (WHERE answer = 'accept') AS accepted, count(*) FILTER (WHERE answer = 'reject') AS rejected, count(*) FILTER (WHERE answer = 'ignore') AS unanswered, round(100e0 * count(*) FILTER (WHERE answer <> 'ignore') / count(*), 6) AS completion, count(DISTINCT label) AS views FROM annotations")
q("annotation_label_counts", "SELECT label, count(*) AS n FROM annotations WHERE answer = 'accept' GROUP BY label")
q("batch_stats", "SELECT count(*) AS n, sum(CAST(success AS BIGINT)) AS ok, count(*) - sum(CAST(success AS BIGINT)) AS failed, round(sum(CAST(success AS DOUBLE)) / count(*), 6) AS rate, round(avg(processing_time), 4) AS avg_time FROM crawl_log".replace("sum(CAST(success AS BIGINT)) AS ok", "CAST(sum(success) AS BIGINT) AS ok").replace("count(*) - sum(CAST(success AS BIGINT)) AS failed", "CAST(count(*) - sum(success) AS BIGINT) AS failed"))
q("job_counters", "SELECT domain, count(*) AS processed, CAST(sum(success) AS BIGINT) AS successful, CAST(count(*) - sum(success) AS BIGINT) AS failed FROM crawl_log GROUP BY domain")
q("inference_tracker", "SELECT event_type AS model, count(*) AS calls, round(avg(value), 6) AS mean_time, min(value) AS min_time, max(value) AS max_time FROM events GROUP BY event_type")
q("example_entity_summary", "SELECT k.type AS label, count(*) AS n, count(DISTINCT m.content_id) AS items FROM mentions m JOIN kb_entities k ON k.entity_id = m.entity_id GROUP BY k.type")

# ---- §2.3 filters
q("node_search", """SELECT node_id, name, confidence FROM nodes n WHERE domain = 'trade' AND lower(name) LIKE '%supplier%' AND node_type IN ('entity', 'event') AND confidence >= 0.6e0
    AND EXISTS (SELECT 1 FROM tags t WHERE t.node_id = n.node_id AND t.tag = 'even') ORDER BY confidence DESC, node_id LIMIT 20 OFFSET 5""")
q("node_search_total", "SELECT count(*) AS total FROM nodes WHERE domain = 'trade' AND lower(name) LIKE '%supplier%' AND confidence >= 0.6e0")
q("node_find", "SELECT node_id, name FROM nodes WHERE lower(name) LIKE '%a%' AND node_type = 'concept' AND domain = 'geo' ORDER BY node_id LIMIT 100")
q("events_by_timeframe", "SELECT event_id, start_at FROM domain_events WHERE start_at >= TIMESTAMP '2024-01-05 00:00:00' AND (start_at <= TIMESTAMP '2024-01-12 00:00:00' OR start_at IS NULL) ORDER BY start_at, event_id LIMIT 20")
q("temporal_view", "SELECT event_id, name, start_at AS at FROM domain_events WHERE start_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00'")
q("temporal_refs_range", "SELECT event_id, CAST(event_date AS STRING) AS event_date FROM domain_events WHERE event_date BETWEEN DATE '2024-01-10' AND DATE '2024-01-11' AND name <> 'error'")
q("upcoming_events", "SELECT event_id, name, CAST(event_date AS STRING) AS event_date FROM domain_events WHERE name = 'purchase' AND event_date >= DATE '2024-01-20' AND event_date <= DATE '2024-01-27'")
q("events_by_entity", "SELECT event_id, name FROM domain_events WHERE entity_id = 7")
q("upcoming_matches", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01 00:00:00' AND o_orderstatus <> 'F' AND (o_custkey = 10 OR o_orderkey % 100 = 10) ORDER BY o_orderdate, o_orderkey LIMIT 10")
q("recent_transfers", "SELECT transfer_id, n, player_id, fee FROM transfers WHERE to_team IN (1, 2) ORDER BY moved_at DESC, transfer_id, n LIMIT 10")
q("low_confidence_content", "SELECT c.content_id, k.confidence FROM classification k JOIN content c ON c.content_id = k.content_id WHERE k.confidence < 0.8e0 ORDER BY k.confidence, c.content_id LIMIT 50")
q("uncertain_examples", "SELECT item_id, round(1e0 - avg(coalesce(score, 1e0)), 6) AS uncertainty FROM annotation_spans GROUP BY item_id HAVING 1e0 - avg(coalesce(score, 1e0)) >= 0.5e0 ORDER BY uncertainty DESC, item_id LIMIT 20")
q("url_list_parse", "SELECT page_id, url FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://%'")
q("entity_conf_filter", "SELECT content_id, entity_id, start_char FROM mentions WHERE confidence >= 0.95e0")

# ---- §2.4 joins
q("join_content_metadata", "SELECT c.content_id, c.job_id, d.n_chars FROM content c JOIN documents d ON d.doc_id = c.content_id WHERE c.job_id = 3")
q("join_quality_implicit", "SELECT count(*) AS n FROM content c, classification k WHERE c.content_id = k.content_id AND k.confidence > 0.7e0")
q("join_export_left3", "SELECT c.content_id, k.primary_topic, j.status FROM content c LEFT JOIN classification k ON k.content_id = c.content_id LEFT JOIN jobs j ON j.job_id = c.job_id")
q("join_edges_endpoints", "SELECT e.source_id, e.target_id, s.name AS source_name, t.name AS target_name FROM edges e JOIN nodes s ON s.node_id = e.source_id JOIN nodes t ON t.node_id = e.target_id WHERE s.domain = 'trade' AND t.domain = 'trade'")
q("join_related_entities", "SELECT r.relation_id, r.target_id AS entity_id, 'out' AS direction FROM entity_rel r WHERE r.source_id = 10 UNION ALL SELECT r.relation_id, r.source_id, 'in' FROM entity_rel r WHERE r.target_id = 10")
q("join_claims_by_entity", "SELECT c.claim_id, c.content FROM claim_edges e JOIN claims c ON c.claim_id = e.claim_id WHERE e.entity_id = 5 AND c.claim_type = 'factual' AND c.confidence >= 0.6e0 ORDER BY c.claim_id LIMIT 50")
q("semi_tag", "SELECT node_id FROM tags WHERE tag IN ('even', 'tag0') GROUP BY node_id HAVING count(DISTINCT tag) = 2")
q("anti_unprocessed", "SELECT c.content_id FROM content c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.content_id) AND c.language = 'en' ORDER BY c.content_id LIMIT 100")
q("anti_not_in_list", "SELECT source_id, name FROM sources s WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = s.list_id AND n.n_regionkey = 1)")
q("semi_in_subquery", "SELECT content_id, primary_topic FROM classification WHERE primary_topic IN (SELECT DISTINCT lang FROM documents WHERE lang LIKE '%e%')")
q("dict_lookup_join", "SELECT m.name AS mention, k.entity_id, 1e0 AS score FROM (SELECT DISTINCT lower(p_name) AS name FROM part) m JOIN kb_entities k ON lower(k.name) = m.name")
q("range_cooccurrence_join", "SELECT a.content_id, a.entity_id AS source_entity, b.entity_id AS target_entity, b.start_char - a.end_char AS gap FROM mentions a JOIN mentions b ON a.content_id = b.content_id AND b.start_char - a.end_char BETWEEN 0 AND 100 AND a.entity_id <> b.entity_id")
q("theta_pattern_join", """WITH t AS (SELECT m.content_id, m.entity_id, m.start_char, k.name, k.type FROM mentions m JOIN kb_entities k ON k.entity_id = m.entity_id)
    SELECT a.content_id, a.entity_id AS source_entity, b.entity_id AS target_entity FROM t a JOIN t b ON a.content_id = b.content_id AND abs(a.start_char - b.start_char) <= 200 AND a.entity_id <> b.entity_id
    WHERE a.type LIKE 'S%' AND b.type LIKE 'P%' AND (a.name || ' ' || b.name) LIKE '%e%'""")
q("temporal_overlap_join", "SELECT a.edge_id AS e1, b.edge_id AS e2, a.player FROM tenures a JOIN tenures b ON a.player = b.player AND a.edge_id < b.edge_id AND a.team <> b.team AND (a.valid_to IS NULL OR b.valid_from <= a.valid_to) AND (b.valid_to IS NULL OR a.valid_from <= b.valid_to)")
q("contradiction_entity", "SELECT a.player, count(*) AS conflicts FROM tenures a JOIN tenures b ON a.player = b.player AND a.edge_id < b.edge_id AND a.team <> b.team AND (a.valid_to IS NULL OR b.valid_from <= a.valid_to) AND (b.valid_to IS NULL OR a.valid_from <= b.valid_to) GROUP BY a.player")
q("nearest_entity_join", """SELECT content_id, start_char, near_entity, distance FROM (SELECT a.content_id, a.start_char, b.entity_id AS near_entity, abs(a.start_char - b.start_char) AS distance,
    row_number() OVER (PARTITION BY a.content_id, a.start_char ORDER BY abs(a.start_char - b.start_char), b.start_char, b.entity_id) AS rn FROM mentions a JOIN mentions b ON a.content_id = b.content_id AND a.start_char <> b.start_char AND abs(a.start_char - b.start_char) <= 100) t WHERE rn = 1""")
q("nearest_entity_rank", """SELECT content_id, start_char, rank_no, distance FROM (SELECT a.content_id, a.start_char, abs(a.start_char - b.start_char) AS distance,
    row_number() OVER (PARTITION BY a.content_id, a.start_char ORDER BY abs(a.start_char - b.start_char), b.start_char, b.entity_id) AS rank_no FROM mentions a JOIN mentions b ON a.content_id = b.content_id AND a.start_char <> b.start_char) t WHERE rank_no <= 3""")
q("dangling_edge_filter", "SELECT e.source_id, e.target_id FROM edges e WHERE e.source_id IN (SELECT node_id FROM nodes WHERE confidence > 0.7e0) AND e.target_id IN (SELECT node_id FROM nodes WHERE confidence > 0.7e0)")
q("hash_join_fk_cascade", "SELECT e.source_id, e.target_id, e.relationship_type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.confidence < 0.55e0 AND n.node_id = e.source_id) AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.confidence < 0.55e0 AND n.node_id = e.target_id)")

# ---- §2.6 and §2.7 windows and top-k
q("latest_score_per_content", "SELECT entity_id, event_id, score FROM (SELECT entity_id, event_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY start_at DESC, event_id DESC) AS rn FROM domain_events) t WHERE rn = 1 ORDER BY score DESC, entity_id LIMIT 20")
q("career_history", "SELECT transfer_id, n, player_id, to_team, lag(to_team) OVER (PARTITION BY player_id ORDER BY moved_at, transfer_id, n) AS previous_team FROM transfers")
q("job_pagination", "SELECT content_id, url, (SELECT count(*) FROM content WHERE job_id = 2) AS total FROM content WHERE job_id = 2 ORDER BY content_id DESC LIMIT 10 OFFSET 5")
q("recent_jobs_topk", "SELECT job_id, status FROM jobs ORDER BY job_id DESC LIMIT 10")
q("list_jobs", "SELECT job_id, status, n_content FROM jobs ORDER BY job_id DESC")
q("sources_by_priority", "SELECT source_id, name, priority FROM sources ORDER BY priority DESC, name, source_id")
q("source_credibility_ranking", "SELECT url, overall_score FROM credibility ORDER BY overall_score DESC, url LIMIT 3")
q("recent_classifications", "SELECT content_id, primary_topic FROM classification ORDER BY content_id DESC LIMIT 10")
q("recent_entities", "SELECT content_id, entity_id, start_char FROM mentions ORDER BY content_id DESC, start_char, entity_id LIMIT 10")
q("latest_enhancements", "SELECT event_id, name FROM domain_events ORDER BY start_at DESC, event_id LIMIT 15")
q("related_content_topk", """WITH o AS (SELECT target_doc AS doc FROM (SELECT target_doc, similarity, l_orderkey, l_linenumber FROM similar_docs WHERE source_doc = 5 AND similarity >= 0.3e0 ORDER BY similarity DESC, l_orderkey, l_linenumber LIMIT 5) a),
    i AS (SELECT source_doc AS doc FROM (SELECT source_doc, similarity, l_orderkey, l_linenumber FROM similar_docs WHERE target_doc = 5 AND similarity >= 0.3e0 ORDER BY similarity DESC, l_orderkey, l_linenumber LIMIT 5) b)
    SELECT doc FROM (SELECT doc FROM o UNION SELECT doc FROM i) u WHERE doc <> 5""")
q("limit_offset_scan", "SELECT content_id FROM content ORDER BY content_id LIMIT 25 OFFSET 50")
q("sample_without_order", "SELECT content_id, url FROM content ORDER BY content_id LIMIT 200")

# ---- §2.8 set operations
q("set_except", "SELECT content_id FROM content EXCEPT SELECT doc_id FROM labels")
q("set_intersect", "SELECT content_id FROM content INTERSECT SELECT doc_id FROM labels")
q("set_union_related", "SELECT target_doc AS doc FROM similar_docs WHERE source_doc = 7 UNION SELECT source_doc FROM similar_docs WHERE target_doc = 7")
q("list_concat_all", "SELECT target_doc AS doc FROM similar_docs WHERE source_doc = 7 UNION ALL SELECT source_doc FROM similar_docs WHERE target_doc = 7")
q("ordered_union_dedup", "SELECT url, min(pos) AS pos FROM (SELECT url, source_id AS pos FROM sources WHERE priority > 2 UNION ALL SELECT url, 100000 + source_id FROM sources) t GROUP BY url")
q("distinct_content_ids", "SELECT DISTINCT content_id FROM mentions WHERE entity_id % 50 = 3")
q("visited_dedup", "SELECT p.page_id, p.url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages v WHERE v.url = p.url AND v.page_id < p.page_id)")
q("registry_merge", "SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT n_name AS k, n_nationkey AS v FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_name AS k, n_nationkey + 1000 AS v FROM nation WHERE n_nationkey >= 10) b ON a.k = b.k")
q("registry_combined", "SELECT name, kind FROM (SELECT name, kind, row_number() OVER (PARTITION BY name ORDER BY kind) AS rn FROM (SELECT n_name AS name, 'extension' AS kind FROM nation WHERE n_nationkey > 12 UNION ALL SELECT n_name, 'standard' FROM nation) u) t WHERE rn = 1")

# ---- §2.20 annotation streams
q("task_classification", "SELECT content_id, md5(extracted_text) AS input_hash, md5(extracted_text || '|classification') AS task_hash, language FROM content WHERE extracted_text <> ''")
q("task_stream", "SELECT content_id, CASE WHEN content_id % 2 = 0 THEN 'ner' ELSE 'classification' END AS task, length(extracted_text) AS n FROM content WHERE extracted_text IS NOT NULL AND extracted_text <> ''".replace("length(extracted_text) AS n", "CAST(length(extracted_text) AS BIGINT) AS n"))
q("ner_task_from_db", "SELECT m.content_id, count(*) AS n_spans, min(m.start_char) AS first_start, max(m.end_char) AS last_end FROM mentions m JOIN kb_entities k ON k.entity_id = m.entity_id WHERE k.type LIKE 'S%' GROUP BY m.content_id")
q("annotations_to_rows", "SELECT conv_id, turn, label AS topic, substr(text, 1, 50) AS context_before FROM annotations WHERE answer = 'accept'")
q("apply_annotations", "SELECT conv_id, turn, label FROM annotations a WHERE answer = 'accept' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = a.conv_id)")
q("recipe_active", "SELECT item_id, round(avg(score), 6) AS mean_score FROM annotation_spans GROUP BY item_id ORDER BY mean_score, item_id LIMIT 25")
q("add_predictions", "SELECT c.content_id, m.entity_id, m.start_char, m.end_char FROM content c JOIN mentions m ON m.content_id = c.content_id JOIN kb_entities k ON k.entity_id = m.entity_id WHERE k.type LIKE 'L%'")

# ---- §2.1 and §2.23 rows of the control plane
q("scan_sql", "SELECT content_id, job_id, crawl_depth FROM content WHERE crawl_depth <= 1")
q("export_validate", "SELECT j.job_id, count(c.content_id) AS n, count(c.content_id) = 0 AS is_error FROM (SELECT job_id FROM jobs UNION ALL SELECT 999) j LEFT JOIN content c ON c.job_id = j.job_id GROUP BY j.job_id")
q("process_by_id", "SELECT c.content_id, c.language, k.is_relevant, k.primary_topic FROM content c LEFT JOIN classification k ON k.content_id = c.content_id WHERE c.content_id = 7")
q("list_delete_batched", "SELECT content_id FROM content c WHERE NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = c.job_id AND j.status = 'RUNNING')")
