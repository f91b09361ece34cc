"""A dependency graph derived from the driver's tables. One prelude serves Spark and the DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quarrygraph.graph import Graph

PARTS: dict[str, str] = {
    "repos": """SELECT CAST(r_regionkey AS BIGINT) AS repo_id, lower(r_name) AS name,
  CASE CAST(r_regionkey AS BIGINT) % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'dbt' ELSE 'sqlmesh' END AS repo_type FROM region""",
    "files": """SELECT CAST(n_nationkey AS BIGINT) AS file_id, CAST(n_regionkey AS BIGINT) AS repo_id,
  concat('models/', CASE CAST(n_nationkey AS BIGINT) % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'staging' ELSE 'marts' END,
    '/', lower(n_name), '.sql') AS path FROM nation""",
    "nodes": """SELECT CAST(s_suppkey AS BIGINT) AS node_id, CAST(s_nationkey AS BIGINT) AS file_id,
    CASE CAST(s_suppkey AS BIGINT) % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'query' ELSE 'table' END AS kind,
    concat('m', CAST(CAST(s_suppkey AS BIGINT) % 60 AS VARCHAR(20))) AS name FROM supplier
  UNION ALL
  SELECT 1000000 + CAST(p_partkey AS BIGINT),
    CASE WHEN CAST(p_partkey AS BIGINT) % 10 = 0 THEN NULL ELSE CAST(p_partkey AS BIGINT) % 25 END,
    CASE CAST(p_partkey AS BIGINT) % 7 WHEN 0 THEN 'cte' WHEN 1 THEN 'view' WHEN 2 THEN 'query' ELSE 'table' END,
    concat('p', CAST(CAST(p_partkey AS BIGINT) % 400 AS VARCHAR(20))) FROM part""",
    "edges": """SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS source_id, 1000000 + CAST(l_partkey AS BIGINT) AS target_id,
    CASE WHEN l_linenumber = 1 AND CAST(l_partkey AS BIGINT) % 20 = CAST(l_suppkey AS BIGINT) % 20 THEN 'defines' WHEN l_linenumber = 2 THEN 'inserts_into'
      WHEN l_linenumber = 3 THEN 'cte_references' ELSE 'references' END AS relationship,
    CASE CAST(l_linenumber AS BIGINT) WHEN 2 THEN 'INSERT INTO' WHEN 4 THEN 'JOIN clause' ELSE 'FROM clause' END AS context
  FROM lineitem
  UNION
  SELECT 1000000 + CAST(p_partkey AS BIGINT), 1000001 + (CAST(p_partkey AS BIGINT) * 7 + 11) % 200, 'references', 'FROM clause'
  FROM part""",
    "column_usage": """SELECT CAST(l_suppkey AS BIGINT) AS node_id, CAST(s_nationkey AS BIGINT) AS file_id,
    concat('p', CAST(CAST(l_partkey AS BIGINT) % 400 AS VARCHAR(20))) AS table_name,
    concat('c', CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR(20))) AS column_name,
    CASE CAST(l_quantity AS BIGINT) % 10 WHEN 0 THEN 'select' WHEN 1 THEN 'where' WHEN 2 THEN 'join_on' WHEN 3 THEN 'group_by'
      WHEN 4 THEN 'order_by' WHEN 5 THEN 'having' WHEN 6 THEN 'partition_by' WHEN 7 THEN 'window_order' WHEN 8 THEN 'qualify'
      ELSE 'insert' END AS usage_type,
    CASE l_returnflag WHEN 'A' THEN 'SUM(x)' WHEN 'R' THEN 'CAST(x AS INT)' ELSE NULL END AS transform
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "columns": """SELECT 1000000 + CAST(p_partkey AS BIGINT) AS node_id, lower(replace(p_brand, '#', '_')) AS column_name, 'TEXT' AS data_type, CAST(0 AS BIGINT) AS position FROM part
  UNION ALL
  SELECT 1000000 + CAST(p_partkey AS BIGINT), lower(p_type), 'TEXT', CAST(1 AS BIGINT) FROM part
  UNION ALL
  SELECT 1000000 + CAST(p_partkey AS BIGINT), concat('size_', CAST(CAST(p_size AS BIGINT) % 10 AS VARCHAR(20))), 'INT', CAST(2 AS BIGINT) FROM part""",
    "column_lineage": """SELECT CAST(conv_id AS BIGINT) % 25 AS file_id, concat('m', CAST(CAST(conv_id AS BIGINT) % 60 AS VARCHAR(20))) AS output_node,
    concat('c', CAST(CAST(conv_id AS BIGINT) % 7 AS VARCHAR(20))) AS output_column, CAST(conv_id AS BIGINT) AS chain_index,
    CAST(turn AS BIGINT) AS hop_index, role AS hop_column,
    concat('p', CAST((CAST(conv_id AS BIGINT) * 8 + CAST(turn AS BIGINT)) % 400 AS VARCHAR(20))) AS hop_table FROM conversations""",
    "semantic_tags": """SELECT d.source AS tag_name, 1000000 + CAST(d.doc_id AS BIGINT) % 200 AS node_id,
    CAST((1000000 + CAST(d.doc_id AS BIGINT) % 200) % 5 AS BIGINT) AS repo_id,
    max(CAST(60 + 25 * l.quality + 10 * (1 - l.toxic) AS DOUBLE) / 100) AS confidence
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source, 1000000 + CAST(d.doc_id AS BIGINT) % 200""",
}
#: Driver tables that each derived table reads.
INPUTS = {
    "repos": ["region"], "files": ["nation"], "nodes": ["supplier", "part"], "edges": ["lineitem", "part"], "column_usage": ["lineitem", "supplier"],
    "columns": ["part"], "column_lineage": ["conversations"], "semantic_tags": ["documents", "labels"],
}


def prelude(*names: str) -> str:
    """Common table expressions of the named tables (all of them by default)."""
    return ",\n".join(f"{n} AS ({PARTS[n]})" for n in names or PARTS)


def oracle(body: str, *names: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {prelude(*names)}{', ' + ctes if ctes else ''}\n{body}"


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    tables = {}
    for name, sql in PARTS.items():
        for t in INPUTS[name]:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        tables[name] = spark.sql(sql)
    return Graph.of(spark, **tables)
