"""Single files, dbt and sqlmesh projects into the graph."""

import json

import pytest
from pyspark.sql import functions as F

from quarrygraph import ingest
from quarrygraph.graph import Graph
from quarrygraph.operators import catalog, traversal
from quarrygraph.sources import projects, scan

FILES = {
    "models/stg_pay.sql": "CREATE TABLE stg_pay AS SELECT id, amount FROM raw_pay",
    "models/fct_pay.sql": "CREATE VIEW fct_pay AS SELECT id, amount FROM stg_pay",
    "models/daily.sql": "SELECT amount FROM fct_pay",
}


@pytest.fixture(scope="module")
def plain(spark):
    repos = spark.createDataFrame([("shop", "/code/shop", "sql"), ("inner", "/code/shop/nested", "sql"), ("wh", "/code/wh", "dbt")], "name string, path string, repo_type string")
    rows = [("shop", p, t) for p, t in FILES.items()]
    scanned = spark.createDataFrame(rows, "repo string, path string, text string").withColumn("checksum", F.sha2("text", 256))
    g, _ = ingest.reindex(Graph.of(spark), repos, scanned, infer=False)
    return g


def names(g):
    return {(r["src_name"], r["tgt_name"], r["relationship"]) for r in g.ends().collect()}


def paths_of(spark, rows):
    return spark.createDataFrame(rows, "path string, text string")


def test_files_alone_are_read_again(spark, plain):
    given = [
        ("/code/shop/models/stg_pay.sql", "CREATE TABLE stg_pay AS SELECT id FROM other_pay"), ("/code/shop/models/fct_pay.sql", FILES["models/fct_pay.sql"]),
        ("/code/shop/models/daily.sql", None), ("/code/shop/nested/x.sql", "SELECT 1 AS one FROM deep"), ("/code/shop/read.me", "text"), ("/elsewhere/a.sql", "SELECT 1"), ("/code/wh/models/m.sql", "{{ x }}"),
    ]
    g, told = ingest.reindex_files(plain, paths_of(spark, given))
    assert {(r["path"], r["status"], r["reason"]) for r in told.collect()} == {
        ("/code/shop/models/stg_pay.sql", "reindexed", None), ("/code/shop/models/fct_pay.sql", "skipped", "unchanged"), ("/code/shop/models/daily.sql", "deleted", None),
        ("/code/shop/nested/x.sql", "reindexed", None), ("/code/shop/read.me", "skipped", "not a SQL file"), ("/elsewhere/a.sql", "skipped", "no matching repo"), ("/code/wh/models/m.sql", "skipped", "not rendered"),
    }
    assert {(r["repo_id"], r["path"]) for r in g.files.collect()} == {(2, "models/stg_pay.sql"), (2, "models/fct_pay.sql"), (1, "x.sql")}
    got = names(g)
    assert ("fct_pay", "stg_pay", "references") in got and ("stg_pay", "other_pay", "references") in got and ("x", "deep", "references") in got
    assert not any(s == "daily" or t == "raw_pay" for s, t, _ in got)
    before = {r["path"]: r["file_id"] for r in plain.files.collect()}
    assert {r["path"]: r["file_id"] for r in g.files.collect()}["models/fct_pay.sql"] == before["models/fct_pay.sql"]
    assert all(r["indexed_at"] is not None for r in g.files.collect())


def test_nothing_to_read(spark, plain):
    g, told = ingest.reindex_files(plain, paths_of(spark, []))
    assert told.count() == 0 and names(g) == names(plain)


def test_models_of_a_project_are_found_by_stem(spark, plain):
    rendered = spark.createDataFrame([("wh", "staging/m.sql", 'CREATE TABLE "staging"."m" AS SELECT a FROM src')], "repo string, path string, text string")
    g, told = ingest.reindex_files(plain, paths_of(spark, [("/code/wh/models/deep/m.sql", "{{ x }}")]), rendered)
    assert [(r["status"], r["repo"]) for r in told.collect()] == [("reindexed", "wh")]
    assert ("m", "src", "references") in names(g)
    stems = spark.createDataFrame([(3, "m"), (2, "daily"), (2, "none")], "repo_id bigint, stem string")
    assert {(r["repo_id"], r["path"]) for r in scan.file_paths_by_stem(g.files, stems).collect()} == {(3, "staging/m.sql"), (2, "models/daily.sql")}
    assert catalog.model_of_file(g, "wh", "staging/m.sql").first()["name"] == "m"
    g, told = ingest.reindex_files(g, paths_of(spark, [("/code/wh/models/deep/m.sql", None)]))
    assert [r["status"] for r in told.collect()] == ["deleted"] and not any(s == "m" for s, *_ in names(g))


def dbt(spark, tmp_path):
    node = {"resource_type": "model", "package_name": "wh", "columns": {}}
    manifest = {
        "nodes": {
            "model.wh.stg": node | {"name": "stg", "path": "staging/stg.sql", "depends_on": {"nodes": ["source.wh.s.raw"]}, "columns": {"id": {"name": "id", "data_type": "INT"}, "v": {"name": "v", "data_type": "DATE"}}},
            "model.wh.mart": node | {"name": "mart", "path": "marts/mart.sql", "depends_on": {"nodes": ["model.wh.stg", "seed.wh.hidden"]}},
        },
        "sources": {"source.wh.s.raw": {"name": "raw", "identifier": "raw_table", "columns": {"id": {"name": "id", "data_type": "BIGINT"}}}},
    }
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    yml = "models:\n  - name: mart\n    columns:\n      - {name: v, description: day}\nsources:\n  - name: s\n    tables:\n      - {name: raw, identifier: raw_table, columns: [{name: id, data_type: BIGINT}]}\n"
    compiled = spark.createDataFrame([("staging/stg.sql", "SELECT id, v FROM raw_table"), ("marts/mart.sql", "SELECT * FROM stg;")], "path string, text string")
    return compiled, projects.read_manifest(spark, f"file://{tmp_path}/manifest.json"), projects.schema_yml(spark, spark.createDataFrame([(yml,)], "text string"))


def test_dbt_project(spark, plain, tmp_path):
    compiled, manifest, documented = dbt(spark, tmp_path)
    g, report = ingest.reindex_dbt(plain, "wh", "/code/wh", compiled, manifest, documented, infer=False)
    assert {r["n_errors"] for r in report.collect()} == {0}
    got = names(g)
    assert {("stg", "raw_table", "references"), ("mart", "stg", "references"), ("mart", "hidden", "references")} <= got
    assert ("daily", "fct_pay", "references") in got  # the other repo is as it was
    cols = {(r["name"], r["column_name"]): (r["data_type"], r["source"], r["position"]) for r in g.columns.join(g.nodes, "node_id").collect()}
    assert cols["mart", "v"][1:] == ("schema_yml", 0) and cols["mart", "id"][2] == 1 and cols["raw_table", "id"][:2] == ("BIGINT", "schema_yml")
    meta = {r["name"]: json.loads(r["metadata"]) for r in g.nodes.filter("metadata IS NOT NULL").collect()}
    assert meta["mart"]["dbt_model"] == "marts/mart" and meta["mart"]["create_type"]
    assert {r["path"] for r in g.files.join(g.repos.filter("name = 'wh'"), "repo_id").select(g.files["path"]).collect()} == {"staging/stg.sql", "marts/mart.sql", ingest.SOURCES_FILE}
    assert {r["hop_table"] for r in catalog.trace_column_lineage(g, output_node="mart").collect()} >= {"stg"}
    # again without sources and without one model
    g, _ = ingest.reindex_dbt(g, "wh", "/code/wh", compiled.filter("path LIKE 'marts%'"), manifest, infer=False)
    assert {r["path"] for r in g.files.join(g.repos.filter("name = 'wh'"), "repo_id").select(g.files["path"]).collect()} == {"marts/mart.sql"}
    assert ("mart", "stg", "references") in names(g) and ("stg", "raw_table", "references") not in names(g)


def test_sqlmesh_project_and_its_cache(spark, plain, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"name": '"cat"."sales"."orders"', "sql": "SELECT id, amount FROM raw_orders", "columns": {"id": "INT", "amount": "DECIMAL"}}, {"name": "sales.totals", "sql": "SELECT * FROM orders", "columns": {}}]))
    rendered = projects.rendered_models(spark, f"file://{tmp_path}/m.json")
    g, _ = ingest.reindex_sqlmesh(plain, "mesh", "/code/mesh", rendered, "print-1", infer=False)
    assert {("orders", "raw_orders", "references"), ("totals", "orders", "references")} <= names(g)
    cols = {(r["name"], r["column_name"]): (r["data_type"], r["source"]) for r in g.columns.join(g.nodes, "node_id").collect()}
    assert cols["orders", "id"] == ("INT", "sqlmesh_schema") and ("totals", "id") not in cols
    assert {r["path"] for r in g.files.filter("path LIKE '%orders.sql' OR path LIKE '%totals.sql'").collect()} == {"cat/sales/orders.sql", "sales/totals.sql"}
    assert {r["source_fingerprint"] for r in g.repos.filter("name = 'mesh'").collect()} == {"print-1"} and g.rendered_cache.count() == 2
    # the same sources: the cache is parsed again, and stars expand by what is known now
    bad = rendered.withColumn("rendered_sql", F.lit("SELECT x FROM wrong"))
    g, _ = ingest.reindex_sqlmesh(g, "mesh", "/code/mesh", bad, "print-1", infer=False)
    assert ("totals", "orders", "references") in names(g)
    assert {r["hop_column"] for r in catalog.trace_column_lineage(g, output_node="totals").collect()} == {"id", "amount"}
    g, _ = ingest.reindex_sqlmesh(g, "mesh", "/code/mesh", bad, "print-2", infer=False)
    assert ("totals", "wrong", "references") in names(g) and ("totals", "orders", "references") not in names(g)


def test_fingerprints_and_names(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, checksum string")
    assert scan.source_fingerprint(files) == scan.source_fingerprint(files.orderBy(F.desc("path"))) != scan.source_fingerprint(files.filter("path = 'a'"))
    got = [r[0] for r in spark.createDataFrame([('"c"."s.t"."m"',), ("`a`.b",), ("x",)], "n string").select(projects.model_path("n")).collect()]
    assert got == ["c/s.t/m", "a/b", "x"]


def test_context_in_one_answer(spark, plain):
    files = spark.createDataFrame([("shop", p, t + "\n-- end") for p, t in FILES.items()], "repo string, path string, text string")
    r = catalog.get_context(plain, "fct_pay", files=files, rank=True).first()
    assert (r["model"]["name"], r["model"]["kind"], r["model"]["path"]) == ("fct_pay", "view", "models/fct_pay.sql")
    assert [c["column_name"] for c in r["columns"]] == ["id", "amount"] and "stg_pay" in {x["name"] for x in r["upstream"]} and "daily" in {x["name"] for x in r["downstream"]}
    assert r["most_used_columns"] == ["amount"] and r["snippet"].startswith("CREATE VIEW fct_pay") and r["importance"] > 0
    assert catalog.get_context(plain, "nothing").count() == 0


def test_status_in_one_answer(spark, plain):
    report = spark.createDataFrame([("shop", f"f{k:03d}.sql", 1, "bad") for k in range(60)] + [("shop", "ok.sql", 0, "")], "repo string, path string, n_errors int, errors string")
    r = catalog.index_status(plain, report).first()
    assert (r["schema_version"], r["state"], r["parse_error_count"], len(r["last_parse_errors"])) == ("1.0", "completed", 60, 50)
    assert {x["name"]: x["files"] for x in r["repos"]} == {"shop": 3, "inner": 0, "wh": 0} and r["totals"]["files"] == 3
    assert catalog.index_status(plain).first()["state"] == "idle"
    assert {x["name"] for x in traversal.trace(plain, "daily").collect()} >= {"fct_pay", "stg_pay"}
