"""Registered queries of SQL analysis, ingest and small stores, over statements made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph import ingest
from quarrygraph.graph import Graph
from quarrygraph.operators import catalog, maintenance
from quarrygraph.plans.analyse import parse_files
from quarrygraph.queries import on_graph, query
from quarrygraph.sources import projects, scan
from quarrygraph.streaming.debounce import sessions


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7).alias("m"), F.col("s_nationkey").alias("n"))


def _filled(template: str, **columns: str):
    """``template`` with {name} replaced by columns, as text."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.col(columns.get(p, p)).cast("string") for i, p in enumerate(parts) if p])


def _files(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """One file a supplier: models/q_{k}.sql with the filled template."""
    return _suppliers(spark, sf_dir).select(F.lit("r").alias("repo"), _filled("models/q_{k}.sql").alias("path"), _filled(template).alias("text"), "k", "m", "n")


_S = "WITH f AS (SELECT s_suppkey AS k, s_suppkey % 7 AS m, s_nationkey AS n, 'q_' || s_suppkey AS stem, 'models/q_' || s_suppkey || '.sql' AS path FROM supplier) "
_EDGE_COLS = ("e.source_name", "e.target_name", "e.relationship", "e.context")


def _edges(files: DataFrame) -> DataFrame:
    return parse_files(files).select("path", F.explode("edges").alias("e")).select("path", *_EDGE_COLS)


def _usage(files: DataFrame) -> DataFrame:
    return parse_files(files).select("path", F.explode("column_usage").alias("u")).select("path", "u.table_name", "u.column_name", "u.usage_type", "u.alias", "u.transform")


def _chains(files: DataFrame, known: DataFrame | None = None) -> DataFrame:
    rows = parse_files(files, known).select("path", F.explode("column_lineage").alias("l"))
    return rows.select("path", "l.output_column", F.array_join(F.transform("l.chain", lambda h: F.concat_ws(".", h["table"], h["column"])), " <- ").alias("chain"))


def _laid(values: str, columns: str) -> str:
    return f"{_S}SELECT path, u.* FROM f, LATERAL (VALUES {values}) u({columns})"


_CHAIN, _EDGE, _USE = "output_column, chain", "source_name, target_name, relationship, context", "table_name, column_name, usage_type, alias, transform"

# --- one statement form a query
UNION = "SELECT id AS k FROM a_{m} UNION ALL SELECT other FROM b_{n} UNION SELECT third FROM c"
query("sql_union_lineage", _laid("('k', stem || '.k <- a_' || m || '.id'), ('k', stem || '.k <- b_' || n || '.other'), ('k', stem || '.k <- c.third'), ('other', stem || '.other <- b_' || n || '.other'), ('third', stem || '.third <- c.third')", _CHAIN), raw=True)(lambda s, d: _chains(_files(s, d, UNION)))
INSERT = "INSERT INTO dim_{m} (order_id, customer_name, order_total) SELECT o.id, c.name, SUM(o.amount) FROM orders_{n} o JOIN customers c ON o.cid = c.id"
query(
    "sql_insert_mapping",
    _laid("('orders_' || n, 'id', 'insert', 'order_id', NULL), ('customers', 'name', 'insert', 'customer_name', NULL), ('orders_' || n, 'amount', 'insert', 'order_total', 'SUM(o.amount)')", _USE),
    raw=True,
)(lambda s, d: _usage(_files(s, d, INSERT)).filter("usage_type = 'insert'"))
query(
    "sql_insert_edges", _laid("(stem, 'dim_' || m, 'inserts_into', 'INSERT INTO'), (stem, 'orders_' || n, 'inserts_into', 'FROM clause'), (stem, 'customers', 'inserts_into', 'JOIN clause')", _EDGE), raw=True
)(lambda s, d: _edges(_files(s, d, INSERT)))
STAR = "WITH s AS (SELECT * FROM orders_{m}) SELECT * FROM s"
_KNOWN = "SELECT DISTINCT 'orders_' || (p_partkey % 7) AS table_name, 'size_' || p_size AS column_name, 'INT' AS data_type FROM part"
query("sql_star_expansion", f"{_S.rstrip()}, known AS ({_KNOWN}) SELECT f.path, column_name AS output_column, stem || '.' || column_name || ' <- s.' || column_name || ' <- ' || table_name || '.' || column_name AS chain FROM f JOIN known ON table_name = 'orders_' || m", raw=True)(
    lambda s, d: _chains(_files(s, d, STAR), s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("orders_"), (F.col("p_partkey") % 7).cast("string")).alias("table_name"), F.concat(F.lit("size_"), F.col("p_size").cast("string")).alias("column_name"), F.lit("INT").alias("data_type")).distinct())
)
query("sql_star_usage", _laid("('orders_' || m, '*', 'select', NULL, NULL), ('s', '*', 'select', NULL, NULL)", _USE), raw=True)(lambda s, d: _usage(_files(s, d, STAR)))
MERGE = "MERGE INTO t_{m} t USING s_{n} s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (id, a) VALUES (s.id, s.a)"
query("sql_merge_edges", _laid("(stem, 't_' || m, 'references', 'MERGE target'), (stem, 's_' || n, 'references', 'MERGE target')", _EDGE), raw=True)(lambda s, d: _edges(_files(s, d, MERGE)))
QUOTED = 'SELECT "Id", Amt FROM "Raw_{m}" r JOIN Dim_{n} d ON r.k = d.k'
_DIALECT = "CASE k % 3 WHEN 0 THEN 'postgres' WHEN 1 THEN 'snowflake' ELSE 'bigquery' END"
query(
    "sql_case_folding",
    f"{_S}SELECT path, CASE k % 3 WHEN 0 THEN stem WHEN 1 THEN upper(stem) ELSE stem END AS source_name, CASE WHEN side = 0 THEN 'Raw_' || m WHEN k % 3 = 0 THEN 'dim_' || n WHEN k % 3 = 1 THEN 'DIM_' || n ELSE 'Dim_' || n END AS target_name, 'references' AS relationship, CASE side WHEN 0 THEN 'FROM clause' ELSE 'JOIN clause' END AS context FROM f, (VALUES (0), (1)) v(side)",
    raw=True,
)(lambda s, d: _edges(_files(s, d, QUOTED).withColumn("dialect", F.expr(_DIALECT))))
CREATE = "CREATE OR REPLACE VIEW mart.v_{k} AS SELECT o.id, o.amount * 2 AS twice, CASE WHEN o.f > {m} THEN 'x' END AS flag FROM src_{m} o WHERE o.status = 'ok' AND o.n > {n}"
query("sql_create_nodes", _S + "SELECT path, u.* FROM f, LATERAL (VALUES ('view', 'v_' || k, 'mart'), ('table', 'src_' || m, NULL), ('query', stem, NULL)) u(kind, name, schema)", raw=True)(
    lambda s, d: parse_files(_files(s, d, CREATE)).select("path", F.explode("nodes").alias("n")).select("path", "n.kind", "n.name", "n.schema")
)
query("sql_create_columns", _S + "SELECT path, 'v_' || k AS node_name, u.* FROM f, LATERAL (VALUES ('id', 0, 'inferred'), ('twice', 1, 'inferred'), ('flag', 2, 'inferred')) u(column_name, position, source)", raw=True)(
    lambda s, d: parse_files(_files(s, d, CREATE)).select("path", F.explode("columns").alias("c")).select("path", "c.node_name", "c.column_name", F.col("c.position").cast("int").alias("position"), "c.source")
)
query(
    "sql_where_filters", _S + "SELECT path, u.* FROM f, LATERAL (VALUES ('o.status = ''ok'''), ('o.n > ' || n)) u(condition)", raw=True
)(lambda s, d: parse_files(_files(s, d, CREATE.split(" AS ", 1)[1])).select("path", F.explode("nodes").alias("n")).select("path", F.explode(F.from_json(F.get_json_object("n.metadata", "$.filters"), "array<string>")).alias("condition")))
query("sql_transforms", _laid("('src_' || m, 'amount', 'select', 'twice', 'o.amount * 2'), ('src_' || m, 'id', 'select', NULL, NULL)", _USE), raw=True)(
    lambda s, d: _usage(_files(s, d, CREATE.split(" AS ", 1)[1])).filter("usage_type = 'select' AND column_name IN ('amount', 'id')")
)
SHADOW = "WITH outer_cte AS (WITH orders AS (SELECT 1 AS x FROM inner_{m}) SELECT x FROM orders) SELECT * FROM outer_cte JOIN orders o ON true JOIN dim_{n} d ON o.k = d.k"
query("sql_cte_shadowing", _laid("(stem, 'orders', 'references', 'JOIN clause'), (stem, 'dim_' || n, 'references', 'JOIN clause'), (stem, 'inner_' || m, 'references', 'FROM clause')", _EDGE), raw=True)(
    lambda s, d: _edges(_files(s, d, SHADOW)).filter("relationship = 'references'")
)
query("sql_syntax_errors", _S + "SELECT path, m = 0 AS broken FROM f", raw=True)(
    lambda s, d: parse_files(_files(s, d, "SELECT a FROM t_{m}").withColumn("text", F.when(F.col("m") == 0, "SELECT FROM WHERE (").otherwise(F.col("text")))).select("path", (F.size("errors") > 0).alias("broken"))
)

# --- ingest: a tree of models, each over its half and a source
TREE = "CREATE TABLE m_{k} AS SELECT a.id, a.v + b.amt AS total FROM m_{half} a JOIN src_{m} b ON a.id = b.id"
_T = "WITH f AS (SELECT s_suppkey AS k, s_suppkey // 2 AS half, s_suppkey % 7 AS m FROM supplier)"


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _suppliers(spark, sf_dir).withColumn("half", F.floor(F.col("k") / 2).cast("bigint"))
    rows = rows.select(F.lit("shop").alias("repo"), _filled("models/m_{k}.sql").alias("path"), _filled(TREE).alias("text"), "k", "half", "m")
    return rows.withColumn("checksum", F.sha2("text", 256))


def _repos(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("shop", "/code/shop", "sql"), ("wh", "/code/wh", "dbt")], "name string, path string, repo_type string")


def _indexed(spark: SparkSession, sf_dir: str) -> Graph:
    return ingest.reindex(Graph.of(spark), _repos(spark), _tree(spark, sf_dir), infer=False)[0]


def _linked(g: Graph) -> DataFrame:
    return g.ends().select(F.col("src_name").alias("source_name"), F.col("tgt_name").alias("target_name"), "relationship").distinct()


_TREE_EDGES = "SELECT 'm_' || k AS source_name, 'm_' || half AS target_name, 'references' AS relationship FROM f{w} UNION SELECT 'm_' || k, 'src_' || m, 'references' FROM f{w} UNION SELECT 'm_' || k, 'm_' || k, 'defines' FROM f{w}"
query("reindex_edges", f"{_T} {_TREE_EDGES.format(w='')}", raw=True)(lambda s, d: _linked(_indexed(s, d)))
query("reindex_columns", f"{_T} SELECT 'm_' || k AS name, u.* FROM f, (VALUES ('id', 0, 'inferred'), ('total', 1, 'inferred')) u(column_name, position, source)", raw=True)(
    lambda s, d: (lambda g: g.columns.join(g.nodes.select("node_id", "name"), "node_id").select("name", "column_name", F.col("position").cast("int").alias("position"), "source"))(_indexed(s, d))
)
query(
    "reindex_lineage",
    f"{_T} SELECT 'm_' || k AS output_node, u.* FROM f, LATERAL (VALUES ('id', 0, 0, 'm_' || k, 'id'), ('id', 0, 1, 'm_' || half, 'id'), ('total', 0, 0, 'm_' || k, 'total'), ('total', 0, 1, 'm_' || half, 'v'), ('total', 1, 0, 'm_' || k, 'total'), ('total', 1, 1, 'src_' || m, 'amt')) u(output_column, chain_index, hop_index, hop_table, hop_column)",
    raw=True,
)(lambda s, d: _indexed(s, d).column_lineage.select("output_node", "output_column", F.col("chain_index").cast("int").alias("chain_index"), F.col("hop_index").cast("int").alias("hop_index"), "hop_table", "hop_column"))
_AGAIN = f"{_T} {_TREE_EDGES.format(w=' WHERE k % 5 <> 0 AND k % 3 <> 0')} UNION SELECT 'm_' || k, 'new_' || m, 'references' FROM f WHERE {{changed}} UNION SELECT 'm_' || k, 'm_' || k, 'defines' FROM f WHERE {{changed}}"


def _changed(tree: DataFrame) -> DataFrame:
    """Every third model reads another source, every fifth is gone."""
    text = F.when(F.col("k") % 3 == 0, _filled("CREATE TABLE m_{k} AS SELECT id FROM new_{m}")).otherwise(F.col("text"))
    return tree.filter("k % 5 <> 0").withColumn("text", text).withColumn("checksum", F.sha2("text", 256))


query("reindex_incremental", _AGAIN.format(changed="k % 3 = 0 AND k % 5 <> 0"), raw=True)(
    lambda s, d: _linked(ingest.reindex(_indexed(s, d), _repos(s), _changed(_tree(s, d)), infer=False)[0])
)


def _saved(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """Of the tree only every third and fifth file is named, beside files of no repo and no SQL."""
    text = F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 2 == 0, F.col("text")).otherwise(_filled("CREATE TABLE m_{k} AS SELECT id FROM new_{m}"))
    paths = _tree(spark, sf_dir).filter("k % 3 = 0 OR k % 5 = 0").select(F.concat(F.when(F.col("m") == 6, "/other/").otherwise("/code/shop/"), F.when(F.col("m") == 5, F.regexp_replace("path", "sql$", "md")).otherwise(F.col("path"))).alias("path"), text.alias("text"))
    return ingest.reindex_files(_indexed(spark, sf_dir), paths)


_SAVED = "g AS (SELECT *, CASE m WHEN 6 THEN '/other/' ELSE '/code/shop/' END || 'models/m_' || k || CASE m WHEN 5 THEN '.md' ELSE '.sql' END AS path, CASE WHEN m IN (5, 6) THEN 'skipped' WHEN k % 5 = 0 THEN 'deleted' WHEN k % 2 = 0 THEN 'skipped' ELSE 'reindexed' END AS status FROM f WHERE k % 3 = 0 OR k % 5 = 0)"
query("reindex_files_status", f"{_T}, {_SAVED} SELECT path, status, CASE WHEN m = 5 THEN 'not a SQL file' WHEN m = 6 THEN 'no matching repo' WHEN status = 'skipped' THEN 'unchanged' END AS reason FROM g", raw=True)(
    lambda s, d: _saved(s, d)[1].select("path", "status", "reason")
)
_LEFT = _TREE_EDGES.format(w=" WHERE k NOT IN (SELECT k FROM g WHERE status <> 'skipped')")
query(
    "reindex_files_edges",
    f"{_T}, {_SAVED} {_LEFT} UNION SELECT 'm_' || k, 'new_' || m, 'references' FROM g WHERE status = 'reindexed' UNION SELECT 'm_' || k, 'm_' || k, 'defines' FROM g WHERE status = 'reindexed'",
    raw=True,
)(lambda s, d: _linked(_saved(s, d)[0]))


# --- projects
def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model a supplier, which reads a source and, by the manifest alone, the seed of its nation."""
    rows = _suppliers(spark, sf_dir)
    table = "map<string,struct<name:string,data_type:string,description:string>>"
    none = F.lit(None).cast("string")
    columns = F.create_map(F.lit("id"), F.struct(F.lit("id").alias("name"), F.lit("BIGINT").alias("data_type"), none.alias("description")))
    deps = F.struct(F.array(_filled("source.wh.s.raw_{m}"), _filled("seed.wh.seed_{n}")).alias("nodes"), F.array().cast("array<string>").alias("public_nodes"))
    models = rows.select(F.lit("node").alias("kind"), _filled("model.wh.d_{k}").alias("key"), F.lit("model").alias("resource_type"), F.lit("wh").alias("package_name"), _filled("d_{k}").alias("name"), none.alias("alias"), none.alias("identifier"), _filled("staging/d_{k}.sql").alias("path"), F.lit("staging").alias("schema"), deps.alias("depends_on"), F.create_map().cast(table).alias("columns"))
    sources = rows.select("m").distinct().select(F.lit("source").alias("kind"), _filled("source.wh.s.raw_{m}").alias("key"), none.alias("resource_type"), none.alias("package_name"), _filled("raw_{m}").alias("name"), none.alias("alias"), _filled("phys_{m}").alias("identifier"), none.alias("path"), none.alias("schema"), F.lit(None).cast(models.schema["depends_on"].dataType).alias("depends_on"), columns.alias("columns"))
    return models.unionByName(sources)


def _dbt(spark: SparkSession, sf_dir: str) -> Graph:
    compiled = _suppliers(spark, sf_dir).select(_filled("staging/d_{k}.sql").alias("path"), _filled("SELECT * FROM phys_{m}").alias("text"))
    notes = _suppliers(spark, sf_dir).select(F.lit("model").alias("entity"), _filled("d_{k}").alias("model"), F.lit("note").alias("column_name"), F.lit("TEXT").alias("data_type"), F.lit(0).cast("bigint").alias("position"), _filled("of {n}").alias("description"))
    notes = notes.unionByName(_suppliers(spark, sf_dir).select("m").distinct().select(F.lit("source").alias("entity"), _filled("phys_{m}").alias("model"), F.lit("id").alias("column_name"), F.lit("BIGINT").alias("data_type"), F.lit(0).cast("bigint").alias("position"), F.lit(None).cast("string").alias("description")))
    return ingest.reindex_dbt(Graph.of(spark), "wh", "/code/wh", compiled, _manifest(spark, sf_dir), notes, infer=False)[0]


query("dbt_manifest_edges", f"{_S}SELECT 'staging/d_' || k || '.sql' AS path, 'd_' || k AS source_name, 'staging' AS source_schema, u.* FROM f, LATERAL (VALUES ('phys_' || m, 'source()'), ('seed_' || n, 'ref()')) u(target_name, context)", raw=True)(
    lambda s, d: projects.manifest_edges(_manifest(s, d), "wh")
)
query("dbt_manifest_columns", f"{_S}SELECT DISTINCT 'phys_' || m AS table_name, 'id' AS column_name, 'BIGINT' AS data_type FROM f", raw=True)(lambda s, d: projects.manifest_columns(_manifest(s, d)))
query("reindex_dbt_edges", f"{_S}SELECT 'd_' || k AS source_name, u.* FROM f, LATERAL (VALUES ('phys_' || m, 'references'), ('seed_' || n, 'references'), ('d_' || k, 'defines')) u(target_name, relationship)", raw=True)(lambda s, d: _linked(_dbt(s, d)))
query(
    "reindex_dbt_columns",
    f"{_S}SELECT DISTINCT u.* FROM (SELECT 'd_' || k AS name, 'note' AS column_name, 'TEXT' AS data_type, 0 AS position, 'schema_yml' AS source, 'of ' || n AS description FROM f UNION ALL SELECT 'd_' || k, 'id', NULL, 1, 'inferred', NULL FROM f UNION ALL SELECT 'phys_' || m, 'id', 'BIGINT', 0, 'schema_yml', NULL FROM f) u",
    raw=True,
)(lambda s, d: (lambda g: g.columns.join(g.nodes.select("node_id", "name"), "node_id").select("name", "column_name", "data_type", F.col("position").cast("int").alias("position"), "source", "description"))(_dbt(s, d)))
query("dbt_node_metadata", f"{_S}SELECT 'd_' || k AS name, 'staging/d_' || k AS model FROM f", raw=True)(
    lambda s, d: _dbt(s, d).nodes.filter("kind = 'table' AND metadata LIKE '%create_type%'").select("name", F.get_json_object("metadata", "$.dbt_model").alias("model"))
)
query("dbt_lineage", f"{_S}SELECT 'd_' || k AS output_node, 'id' AS output_column, 'phys_' || m AS hop_table FROM f", raw=True)(lambda s, d: _dbt(s, d).column_lineage.filter("hop_index = 1").select("output_node", "output_column", "hop_table"))


def _mesh(spark: SparkSession, sf_dir: str) -> Graph:
    """Rendered once, then indexed again with the same fingerprint and other texts, which the cache replaces."""
    types = F.to_json(F.create_map(F.lit("id"), _filled("INT_{m}")))
    first = _suppliers(spark, sf_dir).select(_filled('"cat"."sales"."s_{k}"').alias("model_name"), _filled("SELECT id, v FROM raw_{n}").alias("rendered_sql"), types.alias("column_schemas"))
    g, _ = ingest.reindex_sqlmesh(Graph.of(spark), "mesh", "/code/mesh", first, "f1", infer=False)
    return ingest.reindex_sqlmesh(g, "mesh", "/code/mesh", first.withColumn("rendered_sql", F.lit("SELECT 1 AS one")), "f1", infer=False)[0]


query("reindex_sqlmesh_edges", f"{_S}SELECT 's_' || k AS source_name, u.* FROM f, LATERAL (VALUES ('raw_' || n, 'references'), ('s_' || k, 'defines')) u(target_name, relationship)", raw=True)(lambda s, d: _linked(_mesh(s, d)))
query("reindex_sqlmesh_columns", f"{_S}SELECT 's_' || k AS name, u.* FROM f, LATERAL (VALUES ('id', 'INT_' || m, 'sqlmesh_schema'), ('v', NULL, 'inferred')) u(column_name, data_type, source)", raw=True)(
    lambda s, d: (lambda g: g.columns.join(g.nodes.select("node_id", "name"), "node_id").select("name", "column_name", "data_type", "source"))(_mesh(s, d))
)
query("render_cache", f"{_S}SELECT '\"cat\".\"sales\".\"s_' || k || '\"' AS model_name, 'SELECT id, v FROM raw_' || n AS rendered_sql FROM f", raw=True)(lambda s, d: _mesh(s, d).rendered_cache.select("model_name", "rendered_sql"))

# --- small stores and readers
on_graph("files_by_stem", "SELECT DISTINCT repo_id, 'nation_3' AS stem, path FROM files WHERE path LIKE '%/nation_3.sql'")(lambda g: scan.file_paths_by_stem(g.files, g.repos.select("repo_id", F.lit("nation_3").alias("stem"))))
on_graph("model_of_file", "SELECT node_id, name, kind FROM loc WHERE path = 'models/raw/nation_3.sql' AND kind IN ('table', 'view') ORDER BY kind, name, node_id LIMIT 1")(lambda g: catalog.model_of_file(g, "europe", "models/raw/nation_3.sql"))
on_graph(
    "tags_upsert",
    "SELECT tag_name, node_id, CASE WHEN node_id % 2 = 0 THEN 0.5 ELSE confidence END AS confidence FROM semantic_tags",
)(lambda g: maintenance.upsert_tags(g.semantic_tags, g.semantic_tags.filter("node_id % 2 = 0").withColumn("confidence", F.lit(0.5))).select("tag_name", "node_id", "confidence"))
on_graph("repos_upsert", "SELECT name, repo_id, CASE WHEN name = 'asia' THEN 'dbt' ELSE repo_type END AS repo_type FROM repos UNION ALL SELECT 'zeta', (SELECT max(repo_id) FROM repos) + 1, 'sql'")(
    lambda g: maintenance.upsert_repos(g, g.spark.createDataFrame([("asia", "/a", "dbt"), ("zeta", "/z", "sql")], "name string, path string, repo_type string")).repos.select("name", "repo_id", "repo_type")
)
on_graph("context_answer", "SELECT (SELECT max(node_id) FROM loc WHERE name = 'p43' AND file_id IS NOT NULL) AS node_id, (SELECT count(*) FROM columns WHERE node_id = (SELECT max(node_id) FROM loc WHERE name = 'p43' AND file_id IS NOT NULL)) AS n_columns, (SELECT count(*) FROM (SELECT DISTINCT src_name, src_kind FROM flow WHERE target_id = (SELECT max(node_id) FROM loc WHERE name = 'p43' AND file_id IS NOT NULL))) AS n_downstream, (SELECT string_agg(column_name, ',' ORDER BY n DESC, column_name) FROM (SELECT column_name, count(*) AS n FROM column_usage WHERE table_name = 'p43' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS most_used")(
    lambda g: catalog.get_context(g, "p43").select("model.node_id", F.size("columns").cast("long").alias("n_columns"), F.col("downstream_count").cast("long").alias("n_downstream"), F.array_join("most_used_columns", ",").alias("most_used"))
)
on_graph("index_status", "SELECT '1.0' AS schema_version, 'idle' AS state, (SELECT count(*) FROM repos) AS n_repos, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(
    lambda g: catalog.index_status(g).select("schema_version", "state", F.size("repos").cast("long").alias("n_repos"), "totals.nodes", "totals.edges")
)
query("snippets", "WITH t AS (SELECT page_id, string_split(html, chr(10)) AS l FROM pages) SELECT CAST(page_id AS VARCHAR) AS path, array_to_string([lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || l[i] FOR i IN range(1, least(len(l), 5) + 1)], chr(10)) AS snippet FROM t", raw=True)(
    lambda s, d: (lambda p: catalog.snippets(p, p.select("repo", "path", F.lit(2).alias("line_start"), F.lit(3).alias("line_end"))).select("path", "snippet"))(s.read.parquet(f"{d}/pages.parquet").select(F.lit("r").alias("repo"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("text")))
)
query("model_name_paths", "SELECT DISTINCT p_partkey, 'cat/' || replace(p_brand, '.', '/') || '/p' || p_partkey AS path FROM part", raw=True)(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", projects.model_path(F.concat(F.lit('"cat".'), F.col("p_brand"), F.lit(".`p"), F.col("p_partkey").cast("string"), F.lit("`"))).alias("path"))
)
query("json_properties", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1", raw=True)(
    lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_type", F.from_json("props", "k bigint")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"))
)
for _gap, _name in (("0.5 seconds", "debounce_plain"), ("2 seconds", "debounce_rendered")):
    _ms = "500" if _gap.startswith("0.5") else "2000"
    query(
        _name,
        f"WITH e AS (SELECT CAST(user_id % 5 AS BIGINT) AS repo, TIMESTAMP '2024-01-01' + INTERVAL 1 MILLISECOND * CAST(event_id * 97 % 1000003 AS BIGINT) AS ts, event_type || user_id AS path FROM events), m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts) < INTERVAL {_ms} MILLISECOND THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT repo, min(ts) AS started, count(*) AS n_events, count(DISTINCT path) AS n_paths FROM s GROUP BY repo, k",
        raw=True,
    )(
        lambda s, d, gap=_gap: sessions(
            s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 5).alias("repo"), F.expr("timestamp_millis(1704067200000 + event_id * 97 % 1000003)").cast("timestamp_ntz").alias("ts"), F.concat("event_type", F.col("user_id").cast("string")).alias("path")), gap
        ).select("repo", "started", "n_events", F.size("paths").cast("long").alias("n_paths"))
    )
