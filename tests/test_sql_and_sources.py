"""SQL analysis, file scans, project readers, ingest end to end, and debounced saves."""

import json

import pytest

from quarrygraph import ingest
from quarrygraph.graph import Graph
from quarrygraph.operators import catalog, traversal
from quarrygraph.plans.analyse import analyse, file_stem, parse_files
from quarrygraph.plans.sqlparse import SqlError, parse
from quarrygraph.sources import projects, scan
from quarrygraph.streaming import debounce


def edges(sql, path="q.sql", **more):
    return {(e["source_name"], e["target_name"], e["relationship"], e["context"]) for e in analyse(path, sql, **more)["edges"]}


def uses(sql, **more):
    return {(u["table_name"], u["column_name"], u["usage_type"]) for u in analyse("q.sql", sql, **more)["column_usage"]}


def chains(sql, column, **more):
    return sorted(" <- ".join(f"{h['table']}.{h['column']}" for h in c["chain"]) for c in analyse("q.sql", sql, **more)["column_lineage"] if c["output_column"] == column)


def test_cte_lineage():
    sql = "WITH base AS (SELECT id, CAST(amount AS DECIMAL) AS amt, cid FROM orders), enriched AS (SELECT b.amt, c.name FROM base b JOIN customers c ON b.cid = c.id) SELECT amt, name FROM enriched"
    assert chains(sql, "amt") == ["q.amt <- enriched.amt <- base.amt <- orders.amount"]
    assert chains(sql, "name") == ["q.name <- enriched.name <- customers.name"]


def test_insert_mapping():
    sql = "INSERT INTO dim_orders (order_id, customer_name, order_total) SELECT o.id, c.name, SUM(o.amount) FROM orders o JOIN customers c ON o.cid = c.id"
    got = {(u["table_name"], u["column_name"], u["alias"], u["transform"]) for u in analyse("q.sql", sql)["column_usage"] if u["usage_type"] == "insert"}
    assert got == {("orders", "id", "order_id", None), ("customers", "name", "customer_name", None), ("orders", "amount", "order_total", "SUM(o.amount)")}
    assert ("q", "dim_orders", "inserts_into", "INSERT INTO") in edges(sql) and ("q", "orders", "inserts_into", "FROM clause") in edges(sql)


def test_window_and_clause_roles():
    got = uses("SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) AS rn, SUM(c) OVER (PARTITION BY a) FROM t WHERE d > 1 GROUP BY e HAVING MAX(f) > 2 QUALIFY g = 1 ORDER BY h")
    assert got == {("t", "a", "partition_by"), ("t", "b", "window_order"), ("t", "c", "select"), ("t", "d", "where"), ("t", "e", "group_by"), ("t", "f", "having"), ("t", "g", "qualify"), ("t", "h", "order_by")}


def test_inner_cte_does_not_hide_an_outer_table():
    got = edges("WITH outer_cte AS (WITH orders AS (SELECT 1 AS x FROM inner_t) SELECT x FROM orders) SELECT * FROM outer_cte JOIN orders o ON true")
    assert ("q", "orders", "references", "JOIN clause") in got and ("q", "inner_t", "references", "FROM clause") in got
    assert not any(t == "outer_cte" and r == "references" for _, t, r, _ in got)


def test_recursive_cte_and_self_join():
    got = edges("WITH RECURSIVE r AS (SELECT id FROM t UNION ALL SELECT r.id FROM r JOIN t ON r.id = t.pid) SELECT * FROM r")
    assert ("r", "t", "cte_references", "FROM clause") in got and not any(s == t for s, t, *_ in got)
    assert ("t", "x", "join_on") in uses("SELECT a.x FROM t a JOIN t b ON a.x = b.y")


def test_union_lineage_follows_all_branches():
    sql = "SELECT id AS k FROM a UNION ALL SELECT other AS k FROM b"
    assert chains(sql, "k") == ["q.k <- a.id", "q.k <- b.other"]
    assert chains("SELECT id FROM a UNION ALL SELECT other FROM b", "id") == ["q.id <- a.id", "q.id <- b.other"]


def test_star_with_and_without_catalog():
    sql = "WITH s AS (SELECT * FROM orders) SELECT * FROM s"
    assert chains(sql, "amount") == []
    assert chains(sql, "amount", catalog={"orders": {"id": "INT", "amount": "INT"}}) == ["q.amount <- s.amount <- orders.amount"]
    assert ("orders", "*", "select") in uses(sql)


@pytest.mark.parametrize(("dialect", "name", "quoted"), [("postgres", "orders", "Orders"), ("snowflake", "ORDERS", "Orders"), ("bigquery", "Orders", "Orders"), ("duckdb", "orders", "Orders"), ("redshift", "orders", "Orders")])
def test_case_folding(dialect, name, quoted):
    assert {t for _, t, *_ in edges("SELECT 1 FROM Orders", dialect=dialect)} == {name}
    assert {t for _, t, *_ in edges('SELECT 1 FROM "Orders"', dialect=dialect)} == {quoted}


def test_create_defines():
    got = analyse("models/report.sql", "CREATE OR REPLACE VIEW sales.v AS SELECT id, total * 2 AS twice FROM orders")
    assert {(n["kind"], n["name"], n["schema"]) for n in got["nodes"]} == {("view", "v", "sales"), ("table", "orders", None), ("query", "report", None)}
    assert ("report", "v", "defines", "CREATE statement") in edges("CREATE VIEW sales.v AS SELECT id FROM orders", "models/report.sql")
    assert [(c["column_name"], c["source"]) for c in got["columns"]] == [("id", "inferred"), ("twice", "inferred")]
    ddl = analyse("t.sql", "CREATE TABLE t (id INT NOT NULL, amount DECIMAL(10,2), tags ARRAY<STRING>, PRIMARY KEY (id))")
    assert [(c["column_name"], c["data_type"]) for c in ddl["columns"]] == [("id", "INT"), ("amount", "DECIMAL(10, 2)"), ("tags", "ARRAY < STRING >")]
    assert {n["kind"] for n in ddl["nodes"]} == {"table"}


def test_merge_update_and_others():
    got = edges("MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = s.a WHEN NOT MATCHED THEN INSERT (id, a) VALUES (s.id, s.a)")
    assert {(t, c) for _, t, _, c in got} == {("t", "MERGE target"), ("s", "MERGE target")}
    got = edges("UPDATE t SET a = b FROM u WHERE t.id = u.id AND t.x IN (SELECT y FROM v)")
    assert {(t, c) for _, t, _, c in got} == {("t", "UPDATE target"), ("u", "FROM clause"), ("v", "FROM clause")}
    assert edges("GRANT SELECT ON t TO r; DROP TABLE x") == set()


def test_subqueries_and_filters():
    got = analyse("q.sql", "SELECT s.a FROM (SELECT a FROM t WHERE b = 1) s, LATERAL (SELECT 1 FROM w) l WHERE EXISTS (SELECT 1 FROM u WHERE u.k = s.a) AND s.a > 2")
    assert {"subquery"} == {n["kind"] for n in got["nodes"] if n["name"] == "s"}
    meta = [json.loads(n["metadata"]) for n in got["nodes"] if n["name"] == "q"][0]
    assert meta["filters"] == ["s.a > 2"] or "s.a > 2" in meta["filters"]
    assert ("t", "b", "where") in {(u["table_name"], u["column_name"], u["usage_type"]) for u in got["column_usage"]}


def test_degenerate_texts():
    for sql in ("", "  \n", "-- nothing", "/* x */ ;"):
        assert analyse("q.sql", sql)["nodes"] == []
    bad = analyse("q.sql", "SELECT FROM WHERE (")
    assert bad["nodes"] == [] and bad["errors"]
    with pytest.raises(SqlError):
        parse("SELECT a FROM t WHERE")


def test_file_names():
    assert file_stem("models/orders.sql") == "orders" and file_stem("models/orders/query.sql") == "orders" and file_stem("Index.sql") == "Index"


REPO = {
    "orders.sql": "CREATE TABLE orders (id INT, customer_id INT, amount INT)",
    "customers.sql": "CREATE TABLE customers (id INT, name TEXT)",
    "report.sql": "SELECT o.id, c.name FROM orders o JOIN customers c ON o.customer_id = c.id",
}


def write(root, files):
    for name, text in files.items():
        path = root / "models" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_ingest_and_incremental(spark, tmp_path):
    root = tmp_path / "repo"
    write(root, REPO | {"templ.sql": "SELECT {{ x }} FROM y", "../target/skip.sql": "SELECT 1", "../.git/skip.sql": "SELECT 1"})
    repos = spark.createDataFrame([("r", str(root), "sql")], "name string, path string, repo_type string")
    g, report = ingest.reindex(Graph.of(spark), repos, scan.scan_repo(spark, "r", f"file://{root}"), infer=False)
    assert {r["path"] for r in g.files.collect()} == {f"models/{n}" for n in (*REPO, "templ.sql")}
    assert {r["path"] for r in report.collect()} == {f"models/{n}" for n in REPO}
    assert {r["name"] for r in traversal.trace(g, "report").collect()} == {"orders", "customers"}
    assert {r["name"] for r in catalog.find_references(g, "orders").collect()} == {"report"}
    declared = lambda g: {r["column_name"] for r in g.columns.join(g.nodes.filter("name = 'orders'"), "node_id").collect()}
    assert declared(g) == {"id", "customer_id", "amount"}
    assert catalog.trace_column_lineage(g, output_node="report").count() == 4
    # a changed definition keeps the edges that lead to it; a deleted file takes its own
    (root / "models" / "orders.sql").write_text("CREATE TABLE orders (id INT)")
    (root / "models" / "customers.sql").unlink()
    diff = {(r["path"], r["change"]) for r in scan.incremental_diff(g.files.join(g.repos.selectExpr("repo_id", "name AS repo"), "repo_id"), scan.scan_repo(spark, "r", f"file://{root}")).collect()}
    assert diff == {("models/orders.sql", "changed"), ("models/customers.sql", "deleted")}
    g, _ = ingest.reindex(g, repos, scan.scan_repo(spark, "r", f"file://{root}"), infer=False)
    assert {r["name"] for r in catalog.find_references(g, "orders").collect()} == {"report"}
    assert declared(g) == {"id"}


def test_catalog_expands_stars_of_files(spark):
    files = spark.createDataFrame([("r", "m/s.sql", "SELECT * FROM orders")], "repo string, path string, text string")
    known = spark.createDataFrame([("orders", "id", "INT"), ("other", "z", "INT")], "table_name string, column_name string, data_type string")
    got = parse_files(files, known).first()
    assert [(c["output_column"], [h["table"] for h in c["chain"]]) for c in got["column_lineage"]] == [("id", ["s", "orders"])]
    assert ingest.result_checksum(parse_files(files)).first()["checksum"] != ingest.result_checksum(parse_files(files, known)).first()["checksum"]


def test_dbt_manifest(spark, tmp_path):
    node = {"resource_type": "model", "package_name": "p", "columns": {}}
    manifest = {
        "nodes": {
            "model.p.a": node | {"name": "a", "path": "staging/a.sql", "depends_on": {"nodes": ["source.p.s.raw", "model.p.gone", "macro.p.x", "model.p.a"], "public_nodes": ["model.other.b"]}, "schema": "stg", "columns": {"id": {"name": "id", "data_type": "INT"}, "n": {"name": "n"}}},
            "model.other.b": node | {"package_name": "other", "name": "b", "path": "b.sql", "alias": "b_phys", "columns": {"z": {"name": "z"}}},
        },
        "sources": {"source.p.s.raw": {"name": "raw", "identifier": "raw_table", "columns": {}}},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    m = projects.read_manifest(spark, f"file://{tmp_path}/manifest.json")
    got = {(r["path"], r["source_name"], r["source_schema"], r["target_name"], r["context"]) for r in projects.manifest_edges(m, "p").collect()}
    assert got == {("staging/a.sql", "a", "staging", t, c) for t, c in (("raw_table", "source()"), ("gone", "ref()"), ("b", "ref()"))}
    cols = {(r["table_name"], r["column_name"]): r["data_type"] for r in projects.manifest_columns(m).collect()}
    assert cols == {("a", "id"): "INT", ("a", "n"): None, ("stg.a", "id"): "INT", ("stg.a", "n"): None, ("b_phys", "z"): None}
    known = spark.createDataFrame([("a", "n", "DATE")], "table_name string, column_name string, data_type string")
    full = {(r["table_name"], r["column_name"]): r["data_type"] for r in projects.effective_schema(known.filter("false"), known, projects.manifest_columns(m)).collect()}
    assert full["a", "n"] == "DATE" and full["b_phys", "z"] == "TEXT"


def test_schema_yml(spark):
    text = "models:\n  - name: m\n    columns:\n      - {name: b, data_type: INT, description: key}\nsources:\n  - name: s\n    tables:\n      - {name: t, identifier: phys, columns: [{name: c}]}\n"
    found = projects.schema_yml(spark, spark.createDataFrame([(text,), ("a: [",), ("- 1",)], "text string"))
    assert {(r["entity"], r["model"], r["column_name"]) for r in found.collect()} == {("model", "m", "b"), ("source", "phys", "c")}
    inferred = spark.createDataFrame([("m", "a", "T", 0, "inferred", None), ("m", "b", "T", 1, "inferred", None)], "model string, column_name string, data_type string, position bigint, source string, description string")
    merged = projects.merge_documented(inferred, found.filter("entity = 'model'")).orderBy("position").collect()
    assert [(r["column_name"], r["data_type"], r["source"]) for r in merged] == [("b", "INT", "schema_yml"), ("a", "T", "inferred")]


def test_compiled_models_carry_their_folder(spark):
    files = spark.createDataFrame([("r", "staging/a.sql", "SELECT 1 AS x FROM t;\n"), ("r", "b.sql", "SELECT 1")], "repo string, path string, text string")
    got = {r["path"]: r["text"] for r in projects.compiled_models(files).collect()}
    assert got["staging/a.sql"] == 'CREATE TABLE "staging"."a" AS\nSELECT 1 AS x FROM t'
    assert analyse("staging/a.sql", got["staging/a.sql"])["nodes"][0]["schema"] == "staging"


def test_small_readers(tmp_path):
    assert projects.split_model_name('"cat"."sch"."na.me"') == ("na.me", "sch") and projects.split_model_name("x") == ("x", None)
    assert projects.parse_env("# c\nexport A=1\nB='x y'\nbad\n") == {"A": "1", "B": "x y"}
    (tmp_path / "c.yml").write_text("repos: {a: /x}\n")
    assert projects.read_config(str(tmp_path / "c.yml")) == {"repos": {"a": "/x"}}


def test_dialects_and_repos(spark):
    files = spark.createDataFrame([("a/x.sql",), ("b/y.sql",), ("c.sql",)], "path string")
    got = {r["path"]: r["dialect"] for r in scan.resolve_dialect(files, [("a/", "snowflake"), ("b/*.sql", "duckdb"), ("*", "spark")]).collect()}
    assert got == {"a/x.sql": "snowflake", "b/y.sql": "duckdb", "c.sql": "spark"}
    roots = spark.createDataFrame([("/p", "outer"), ("/p/q/", "inner")], "root string, name string")
    paths = spark.createDataFrame([("/p/a.sql",), ("/p/q/b.sql",), ("/pq/c.sql",)], "path string")
    assert {r["path"]: r["repo"] for r in scan.resolve_repos(paths, roots).collect()} == {"/p/a.sql": "outer", "/p/q/b.sql": "inner"}


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "b"), ("r", "2024-01-01 00:00:01", "a"), ("r", "2024-01-01 00:00:02", "b"), ("r", "2024-01-01 00:01:00", "c"), ("s", "2024-01-01 00:00:00", "d")]
    events = spark.createDataFrame(rows, "repo string, ts string, path string").selectExpr("repo", "CAST(ts AS TIMESTAMP) AS ts", "path")
    got = {(r["repo"], tuple(r["paths"])) for r in debounce.sessions(events, "2 seconds").collect()}
    assert got == {("r", ("b", "a")), ("r", ("c",)), ("s", ("d",))}
    src = f"{tmp_path}/in"
    events.coalesce(1).write.parquet(src)
    batches = []
    query = debounce.reindex_stream(spark.readStream.schema(events.schema).parquet(src), lambda df, k: batches.append([(r["repo"], tuple(r["paths"])) for r in df.collect()]), f"{tmp_path}/ck", "2 seconds", "1 seconds")
    query.processAllAvailable()
    query.stop()
    assert ("r", ("b", "a")) in {x for b in batches for x in b}
