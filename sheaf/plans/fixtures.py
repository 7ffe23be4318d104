"""Named views that stand in for the tables of a harvesting installation, over the tables of a data folder.

The same text runs in Spark SQL and in ANSI SQL engines, so a query that uses a view has one definition."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "match_reports": """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'Arsenal' WHEN 1 THEN 'Man City' ELSE 'Fulham' END || ' '
        || CAST(o_orderkey % 5 AS STRING) || '-' || CAST(o_orderkey % 4 AS STRING) || CASE o_orderkey % 2 WHEN 0 THEN ' Chelsea' ELSE ' Everton' END || chr(10)
        || CASE o_orderkey % 4 WHEN 0 THEN 'Tim Cook of Arsenal scored a goal.' WHEN 1 THEN 'The striker Elon Musk saw a Red Card at Old Trafford.'
        WHEN 2 THEN 'A free kick, a corner and a save by the goalkeeper.' ELSE 'Chelsea''s winger Jeff Bezos scored in a 4-4-2 shape.' END AS text FROM orders""",
    "content": """SELECT doc_id AS content_id, CAST(substr(source, 4) AS INT) AS job_id,
        'https://' || source || '.example.org/' || lang || '/' || CAST(doc_id AS STRING) AS url,
        text AS extracted_text, CAST(doc_id % 5 AS INT) AS crawl_depth, CAST(n_chars % 997 AS INT) AS processing_time,
        lang AS language, n_chars AS char_count FROM documents""",
    "nodes": """SELECT CAST(r_regionkey AS BIGINT) AS node_id, 'concept' AS node_type, r_name AS name, 'geo' AS domain, CAST(1 AS DOUBLE) AS confidence FROM region
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 'concept', n_name, 'geo', CAST(1 AS DOUBLE) FROM nation
        UNION ALL SELECT 100000 + s_suppkey, 'entity', s_name, 'trade', 0.5e0 + CAST(s_suppkey % 50 AS DOUBLE) / 100 FROM supplier
        UNION ALL SELECT 1000000 + c_custkey, 'entity', c_name, 'trade', 0.5e0 + CAST(c_custkey % 50 AS DOUBLE) / 100 FROM customer
        UNION ALL SELECT 10000000 + o_orderkey, 'event', o_orderpriority, 'trade', 0.5e0 + CAST(o_orderkey % 50 AS DOUBLE) / 100 FROM orders""",
    "edges": """SELECT CAST(100 + n_nationkey AS BIGINT) AS source_id, CAST(n_regionkey AS BIGINT) AS target_id, 'part_of' AS relationship_type, CAST(1 AS DOUBLE) AS confidence FROM nation
        UNION ALL SELECT 100000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), 'located_in', 0.5e0 + CAST(s_suppkey % 50 AS DOUBLE) / 100 FROM supplier
        UNION ALL SELECT 1000000 + c_custkey, CAST(100 + c_nationkey AS BIGINT), 'located_in', 0.5e0 + CAST(c_custkey % 50 AS DOUBLE) / 100 FROM customer
        UNION ALL SELECT 10000000 + o_orderkey, 1000000 + o_custkey, 'involves', 0.5e0 + CAST(o_orderkey % 50 AS DOUBLE) / 100 FROM orders""",
    "kb_entities": "SELECT p_partkey AS entity_id, p_name AS name, p_brand AS alias, p_type AS type FROM part",
    "mentions": """SELECT l_orderkey AS content_id, l_partkey AS entity_id, CAST(l_linenumber * 60 + l_partkey % 40 AS INT) AS start_char,
        CAST(l_linenumber * 60 + l_partkey % 40 + 12 AS INT) AS end_char, 1e0 - l_discount AS confidence FROM lineitem""",
    "claims": """SELECT event_id AS claim_id, user_id AS entity_id, CASE WHEN event_id % 3 = 0 THEN 'opinion' ELSE 'factual' END AS claim_type,
        CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100 AS sentiment,
        'user ' || CAST(user_id AS STRING) || CASE WHEN event_id % 2 = 0 THEN ' did ' ELSE ' did not ' END || event_type AS content,
        0.5e0 + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence FROM events""",
    "crawl_log": """SELECT event_id AS seq, ts AS fetched_at, 'host' || CAST(user_id AS STRING) || '.example.org' AS domain,
        CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS success, value AS processing_time, least(value / 200, CAST(1 AS DOUBLE)) AS quality_score FROM events""",
    "annotations": """SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN 'accept' WHEN turn % 3 = 1 THEN 'reject' ELSE 'ignore' END AS answer, role AS label FROM conversations""",
    "classification": """SELECT l.doc_id AS content_id, l.quality = 1 AS is_relevant, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS primary_topic,
        0.5e0 + CAST(l.doc_id % 50 AS DOUBLE) / 100 AS confidence FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "statements": """SELECT event_id AS claim_id, user_id AS entity_id, CASE WHEN event_id % 5 = 0 THEN 'opinion' ELSE 'factual' END AS claim_type, CAST(0 AS DOUBLE) AS sentiment,
        CASE event_id % 4 WHEN 0 THEN 'The report says user ' || CAST(user_id AS STRING) || ' will win the ' || event_type WHEN 1 THEN 'The report says user ' || CAST(user_id AS STRING) || ' will lose the ' || event_type
        WHEN 2 THEN 'user ' || CAST(user_id AS STRING) || ' likes a ' || event_type ELSE 'It is false that user ' || CAST(user_id AS STRING) || ' likes a ' || event_type END AS content,
        0.5e0 + CAST(event_id % 50 AS DOUBLE) / 100 AS confidence FROM events""",
    "claim_edges": "SELECT event_id AS claim_id, user_id AS entity_id, 'mentions' AS relationship_type FROM events",
    "edge_sources": """SELECT o_orderkey AS source_row, 10000000 + o_orderkey AS node_id,
        'https://src' || CAST(o_orderkey % 7 AS STRING) || '.example.org' AS url, 0.3e0 + CAST(o_orderkey % 60 AS DOUBLE) / 100 AS confidence FROM orders""",
    "credibility": """SELECT 'https://src' || CAST(r_regionkey AS STRING) || '.example.org' AS url, 0.4e0 + CAST(r_regionkey AS DOUBLE) / 10 AS overall_score FROM region""",
    "jobs": """SELECT job_id, count(*) AS n_content, CASE WHEN job_id % 3 = 0 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, 2 AS max_depth
        FROM (SELECT CAST(substr(source, 4) AS INT) AS job_id FROM documents) j GROUP BY job_id""",
    "tags": "SELECT node_id, tag FROM (SELECT 100000 + s_suppkey AS node_id, 'tag' || CAST(s_suppkey % 3 AS STRING) AS tag FROM supplier UNION ALL SELECT 100000 + s_suppkey, 'even' FROM supplier WHERE s_suppkey % 2 = 0) t",
    "tenures": """SELECT c_custkey AS edge_id, c_custkey % 500 AS player, CAST(c_nationkey AS BIGINT) AS team, CAST(c_custkey % 37 AS INT) AS valid_from,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 37 + c_custkey % 13 AS INT) END AS valid_to FROM customer""",
    "entity_rel": "SELECT o_orderkey AS relation_id, o_custkey AS source_id, CAST(o_orderkey % 1000 AS BIGINT) AS target_id, o_orderpriority AS relation FROM orders",
    "topics": """SELECT CAST(r_regionkey AS BIGINT) AS topic_id, CAST(NULL AS BIGINT) AS parent_id, r_name AS name FROM region
        UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), n_name FROM nation
        UNION ALL SELECT 100000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), s_name FROM supplier""",
    "domain_events": "SELECT event_id, ts AS start_at, CAST(ts AS DATE) AS event_date, event_type AS name, user_id AS entity_id, value AS score FROM events",
    "sources": """SELECT s_suppkey AS source_id, s_name AS name, 'https://www.' || lower(replace(s_name, '#', '-')) || '.example.com/' AS url, CAST(s_suppkey % 5 AS INT) AS priority,
        s_suppkey % 2 = 0 AS is_active, CAST(s_nationkey AS BIGINT) AS list_id FROM supplier""",
    "transfers": "SELECT l_orderkey AS transfer_id, l_partkey AS player_id, l_suppkey AS to_team, l_shipdate AS moved_at, l_extendedprice AS fee, l_linenumber AS n FROM lineitem",
    "similar_docs": "SELECT l_orderkey % 1000 AS source_doc, l_partkey % 1000 AS target_doc, l_discount * 10 AS similarity, l_orderkey, l_linenumber FROM lineitem",
    "annotation_spans": "SELECT event_id AS task_id, user_id AS item_id, event_type AS label, value / 400 AS score FROM events",
}


def expanded(text: str) -> str:
    """text with the views that it names put before it."""
    names: list[str] = []

    def need(part: str) -> None:
        for name, body in VIEWS.items():
            if name not in names and re.search(rf"\b{name}\b", part):
                need(body)
                names.append(name)

    need(text)
    if not names:
        return text
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
    if own:
        return f"WITH {own.group(1) or ''}{head}, {text[own.end():]}"
    return f"WITH {head} {text}"


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    full = expanded(text)
    for name in TABLES:
        if re.search(rf"\b{name}\b", full):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(full)


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers a query that is said in SQL. oracle: its wording elsewhere, where a function has another name."""
    query(name, expanded(oracle or text))(lambda spark, sf_dir: run_sql(spark, sf_dir, text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
