"""The registry, a few of its queries against DuckDB, and the command line."""

import json
import os
import subprocess

import duckdb
import pytest

import __spark_entry__
from quarrygraph import cli
from quarrygraph.sources import git

SF = "/root/testdata/sf0.001"


def test_registry():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found)
    rows_only = {"semantic_clusters", "inferred_tags", "conventions_by_layer", "suggest_placement"}
    core = {n for n in found if n != "pipeline" and not n.startswith("op")}
    assert core - set(sql) == rows_only
    areas = ["trace_", "search_", "references_", "column_usage_", "lineage_", "schema_", "context_", "find_path", "detect_cycles", "pagerank_top", "bottlenecks", "impact_", "structural_diff_", "pr_impact_", "similar_", "tag_", "reindex_files_", "reindex_dbt_", "reindex_sqlmesh_", "sql_", "dbt_", "index_status", "debounce_", "render_cache", "snippets", "files_by_stem"]
    assert [a for a in areas if not any(n.startswith(a) for n in core)] == []


def test_core_queries_without_the_subpackage(tmp_path):
    """Without the subpackage's folder and the pipeline the entry still lists the other queries."""
    import shutil
    import sys

    root = os.path.dirname(__spark_entry__.__file__)
    shutil.copytree(f"{root}/quarrygraph", tmp_path / "quarrygraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, check=True, capture_output=True, text=True).stdout.split()
    core = [n for n in __spark_entry__.queries() if n != "pipeline" and not n.startswith("op")]
    assert [int(x) for x in said] == [len(core), len(core) - 4]


def test_entry(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(__spark_entry__.oracle_sql()["trace_downstream_d3"])
    assert __spark_entry__.entry(spark).count() == len(want.fetchall()) > 0


@pytest.mark.parametrize("name", ["search_substring", "references_inbound", "column_usage_summary", "lineage_chains", "local_clustering", "similar_models", "sql_column_lineage", "debounce_sessions",
    "sql_union_lineage", "sql_insert_mapping", "sql_insert_edges", "sql_star_expansion", "sql_star_usage", "sql_merge_edges", "sql_case_folding", "sql_create_nodes", "sql_create_columns", "sql_where_filters", "sql_transforms", "sql_cte_shadowing", "sql_syntax_errors",
    "dbt_manifest_edges", "dbt_manifest_columns", "files_by_stem", "model_of_file", "tags_upsert", "repos_upsert", "snippets", "model_name_paths", "json_properties", "debounce_plain", "debounce_rendered", "search_escaped", "detect_cycles"])
def test_queries_equal_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(want.columns)
    got = __spark_entry__.queries()[name](spark, SF).select(*cols)
    tidy = lambda rows: sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    rows = tidy(got.collect())
    assert rows and rows == tidy(want.select(*cols).fetchall())


def test_command_line(spark, tmp_path, capsys):
    from tests.test_graph_engine import CHAIN, build

    store = f"file://{tmp_path}/g"
    build(spark, CHAIN, [(0, 1), (1, 2), (2, 3)]).save(store)
    cli.main(["--store", store, "trace", "raw.orders", "--max-depth", "2"])
    assert {json.loads(x)["name"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")} == {"staging.orders", "int_payments"}
    cli.main(["--store", store, "context", "staging.orders"])
    assert json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][0])["model"]["name"] == "staging.orders"
    cli.main(["--store", store, "status"])
    assert json.loads([x for x in capsys.readouterr().out.splitlines() if x.startswith("{")][0])["schema_version"] == "1.0"
    (tmp_path / "quarrygraph.yml").write_text("repos: {a: /x}\n")
    assert cli.find_config(folder=str(tmp_path)) == {"repos": {"a": "/x"}}


def test_git_versions(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.sql").write_text("SELECT 1 FROM t")
    run("add", "."), run("commit", "-qm", "one")
    base = git.head(str(tmp_path))[0]
    (tmp_path / "a.sql").write_text("SELECT 1 FROM u")
    (tmp_path / "b.sql").write_text("SELECT 2")
    run("add", "."), run("commit", "-qm", "two")
    before, after = git.versions(spark, "r", str(tmp_path), base)
    assert {r["path"]: r["text"] for r in before.collect()} == {"a.sql": "SELECT 1 FROM t"}
    assert {r["path"] for r in after.collect()} == {"a.sql", "b.sql"}
    with pytest.raises(ValueError):
        git.changed_paths(str(tmp_path), "--output=x")
