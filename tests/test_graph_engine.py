"""Operators on small hand-built graphs with known answers."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarrygraph import queries as registered
from quarrygraph.graph import Graph
from quarrygraph.operators import catalog, centrality, conventions, impact, maintenance, similarity, traversal

NODE = "node_id bigint, file_id bigint, kind string, name string, schema string"
EDGE = "source_id bigint, target_id bigint, relationship string, context string"


def build(spark, nodes, edges, files=None, repos=None, **tables):
    """nodes: (name, kind, file) or name; edges: (source, target[, relationship]) by position."""
    rows = [(k + 1, *((n, "table", 1) if isinstance(n, str) else n)) for k, n in enumerate(nodes)]
    links = [(s + 1, t + 1, rel[0] if rel else "references", "FROM clause") for s, t, *rel in edges]
    return Graph.of(
        spark,
        repos=spark.createDataFrame(repos or [(1, "a"), (2, "b")], "repo_id bigint, name string"),
        files=spark.createDataFrame(files or [(1, 1, "models/staging/x.sql"), (2, 2, "models/marts/y.sql")], "file_id bigint, repo_id bigint, path string"),
        nodes=spark.createDataFrame([(i, f, k, n, None) for i, n, k, f in rows], NODE),
        edges=spark.createDataFrame(links, EDGE),
        **tables,
    )


CHAIN = ["raw.orders", "staging.orders", "int_payments", "marts.revenue", "model_isolated"]


@pytest.fixture(scope="module")
def chain(spark):
    return build(spark, CHAIN, [(0, 1), (1, 2), (2, 3)])


def test_path(chain):
    found = traversal.find_path(chain, "raw.orders", "marts.revenue").collect()
    assert [(r["path"], r["length"]) for r in found] == [(" -> ".join(CHAIN[:4]), 3)]
    for a, b, n in (("marts.revenue", "raw.orders", 5), ("raw.orders", "model_isolated", 5), ("raw.orders", "raw.orders", 5), ("raw.orders", "marts.revenue", 2)):
        assert traversal.find_path(chain, a, b, n).count() == 0


def test_path_back_to_itself_needs_a_cycle(spark):
    g = build(spark, ["a", "b"], [(0, 1), (1, 0)])
    assert [r["length"] for r in traversal.find_path(g, "a", "a").collect()] == [0]


def test_dependents_and_ranks(chain):
    got = {r["name"]: r["direct_dependents"] for r in centrality.find_critical_models(chain, iterations=5).collect()}
    assert got == dict(zip(CHAIN, (0, 1, 1, 1, 0)))
    assert abs(sum(r["rank"] for r in centrality.pagerank(chain, iterations=4).collect()) - 1) < 1e-9


def names(df):
    return {r["name"] for r in df.collect()}


def test_trace_tree(spark):
    g = build(spark, ["raw_orders", "stg_orders", "marts_revenue", "dim_customers"], [(0, 1), (1, 2), (0, 3)])
    assert names(traversal.trace(g, "raw_orders")) == {"stg_orders", "marts_revenue", "dim_customers"}
    assert names(traversal.trace(g, "raw_orders", max_depth=1)) == {"stg_orders", "dim_customers"}
    assert names(traversal.trace(g, "marts_revenue", direction="upstream")) == {"raw_orders", "stg_orders"}
    assert traversal.trace(g, "absent").count() == 0


def test_trace_joins_shadows_and_skips_identity(spark):
    """A query defines its table; finance and marketing refer to shadows of the platform's model."""
    nodes = [("order_items", "query", 1), ("order_items", "table", 1), ("stg_order_items", "table", 1), ("orders", "query", 2), ("order_items", "table", 2), ("not_null_orders_id", "query", 2)]
    g = build(spark, nodes, [(0, 1, "defines"), (0, 2), (3, 4), (5, 4)])
    up = traversal.trace(g, "stg_order_items", direction="upstream")
    assert names(up) == {"order_items", "orders"}
    assert names(traversal.trace(g, "stg_order_items", direction="upstream", max_depth=1)) == {"order_items"}
    assert {r["repo"] for r in up.filter("name = 'orders'").collect()} == {"b"}


def test_own_insert_is_not_followed(spark):
    g = build(spark, [("t", "query", 1), ("t", "table", 1), ("u", "table", 1)], [(0, 1, "inserts_into"), (0, 2, "inserts_into")])
    assert names(traversal.trace(g, "t")) == {"u"}
    assert names(catalog.find_references(g, "t", direction="outbound")) == {"u"}


def test_kind_filter_and_local_fallback(spark):
    g = build(spark, [("x", "cte", 1), ("y", "table", 1), ("x", "table", 1), ("z", "table", 1)], [(0, 1), (2, 3)])
    assert names(traversal.trace(g, "x")) == {"z"}
    assert names(traversal.trace(g, "x", kind="cte")) == {"y"}
    only = build(spark, [("x", "cte", 1), ("y", "table", 1)], [(0, 1)])
    assert names(traversal.trace(only, "x")) == {"y"}


@pytest.mark.parametrize(("n", "most", "found"), [(3, 5, 1), (4, 3, 0), (4, 4, 1)])
def test_cycles(spark, n, most, found):
    g = build(spark, [f"n{k}" for k in range(n)], [(k, (k + 1) % n) for k in range(n)])
    got = traversal.detect_cycles(g, max_length=most).collect()
    assert len(got) == found and all(r["length"] == n for r in got)


def test_cycles_of_a_repo(spark):
    g = build(spark, [("a1", "table", 1), ("a2", "table", 1), ("b1", "table", 2), ("b2", "table", 2)], [(0, 1), (2, 3), (3, 2), (0, 0)])
    assert traversal.detect_cycles(g, "a").count() == 0
    assert [r["path"] for r in traversal.detect_cycles(g, "b").collect()] == ["b1 -> b2"]


def test_components(spark):
    g = build(spark, ["a", "b", "c", "x", "y", "z_orphan"], [(0, 1), (1, 2), (3, 4)])
    got = centrality.find_subgraphs(g).collect()
    assert [(r["size"], r["members"]) for r in got] == [(3, "a,b,c"), (2, "x,y"), (1, "z_orphan")]
    assert names(centrality.orphans(g)) == {"z_orphan"}
    assert centrality.find_subgraphs(build(spark, ["a", "b", "c"], [])).count() == 3


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), max_size=20))
def test_components_equal_union_find(spark, links):
    g = build(spark, [f"n{k}" for k in range(15)], links)
    root = list(range(15))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r["node_id"] - 1: r["component"] - 1 for r in centrality.components(g).collect()} == {k: find(k) for k in range(15)}


@pytest.mark.parametrize(("spokes", "risk"), [(25, "high"), (21, "high"), (15, "medium"), (10, "low"), (5, "low")])
def test_bottleneck_risk(spark, spokes, risk):
    g = build(spark, ["hub", *[f"s{k}" for k in range(spokes)]], [(k + 1, 0) for k in range(spokes)])
    got = centrality.find_bottlenecks(g).collect()
    assert [(r["name"], r["downstream"], r["risk"]) for r in got] == [("hub", spokes, risk)]


def test_triangle(spark):
    g = build(spark, ["a", "b", "c", "d"], [(0, 1), (1, 2), (2, 0), (0, 3)])
    assert {r["node_id"]: round(r["lcc"], 6) for r in centrality.local_clustering(g).collect()} == {1: round(1 / 3, 6), 2: 1.0, 3: 1.0, 4: 0.0}


def test_cross_repo(spark):
    g = build(spark, [("raw_orders", "table", 1), ("staging_orders", "table", 1), ("marts_revenue", "table", 2)], [(1, 0), (2, 1)])
    assert catalog.cross_repo_edges(g).count() == 1
    assert {r["repo"] for r in traversal.repos_affected(traversal.trace(g, "marts_revenue")).collect()} == {"a"}
    assert names(traversal.trace(g, "marts_revenue")) == {"staging_orders", "raw_orders"}


def usage(spark, rows):
    return spark.createDataFrame(rows, "node_id bigint, file_id bigint, table_name string, column_name string, usage_type string")


def test_impact_classes(spark):
    g = build(spark, ["src", "sel", "flt", "safe", "odd"], [(1, 0), (2, 0), (3, 0), (4, 0)], column_usage=usage(spark, [(2, 1, "src", "c", "select"), (2, 1, "src", "c", "where"), (3, 1, "src", "c", "where"), (5, 1, "src", "c", "unknown"), (4, 1, "src", "d", "select")]))
    got = {(r["name"], r["severity"]) for r in impact.check_impact(g, "src", [{"action": "remove_column", "column": "c"}]).collect()}
    assert got == {("sel", "breaking"), ("flt", "warning"), ("safe", "safe")}
    added = impact.check_impact(g, "src", [{"action": "add_column", "column": "n"}]).collect()
    assert {r["severity"] for r in added} == {"safe"} and len(added) == 4


def test_pr_impact_delta(spark):
    nodes = ["a", "b", "c", "d"]
    base, head = build(spark, nodes, [(0, 1)]), build(spark, nodes, [(0, 1), (0, 2), (2, 3)])
    got = {r["name"]: r["status"] for r in impact.pr_impact(base, head).collect()}
    assert got == {"b": "unchanged", "c": "newly_affected", "d": "newly_affected"}
    assert set(impact.pr_impact(base, head, mode="absolute").select("status").distinct().toPandas().status) == {"affected"}


def test_delete_file_leaves_phantoms(spark):
    g = build(spark, [("m", "table", 1), ("own", "table", 1), ("user", "table", 2)], [(2, 0), (0, 1)])
    left = maintenance.delete_files(g, g.files.filter("file_id = 1"))
    assert {(r["name"], r["file_id"]) for r in left.nodes.collect()} == {("m", None), ("user", 2)}
    assert [(r["source_id"], r["target_id"]) for r in left.edges.collect()] == [(3, 1)]


def test_phantoms_meet_their_definition(spark):
    g = build(spark, [("m", "table", None), ("m", "table", 1), ("user", "table", 2), ("gone", "table", None)], [(2, 0)])
    done = maintenance.cleanup_phantoms(g)
    assert {r["node_id"] for r in done.nodes.collect()} == {2, 3}
    assert [(r["source_id"], r["target_id"]) for r in done.edges.collect()] == [(3, 2)]


def test_stale_phantom_chains_go(spark):
    g = build(spark, [("p", "table", None), ("q", "table", None), ("r", "table", 1)], [(0, 1)])
    assert "q" not in names(maintenance.cleanup_phantoms(g).nodes)


def test_stubs_merge_within_a_repo(spark):
    g = build(spark, [("orders", "table", 1), ("orders", "query", 1), ("orders", "query", 2), ("use", "query", 1)], [(3, 0), (3, 1)])
    done = maintenance.merge_duplicate_nodes(g)
    assert {r["node_id"] for r in done.nodes.collect()} == {2, 3, 4}
    assert [(r["source_id"], r["target_id"]) for r in done.edges.collect()] == [(4, 2)]


def test_resolution_order(spark):
    g = build(spark, [("t", "table", 2), ("t", "view", 1), ("t", "table", 1), ("u", "query", 2), ("p", "table", None)], [])
    want = spark.createDataFrame([(1, "t", "table", 1, None), (2, "t", "query", 1, None), (3, "u", "table", 1, None), (4, "p", "table", 1, None), (5, "p", "view", 1, None)], "key bigint, name string, kind string, repo_id bigint, schema string")
    got = {r["key"]: (r["node_id"], r["step"]) for r in maintenance.resolve_nodes(g, want).collect()}
    assert got == {1: (3, 1), 2: (3, 3), 3: (4, 4), 4: (5, 2)}
    assert {r["key"] for r in maintenance.resolve_nodes(g, want, same_repo_only=True).collect()} == {1, 2}


def test_columns_upsert_keeps_known_values(spark):
    kind = "node_id bigint, column_name string, data_type string, position bigint, source string, description string"
    old = spark.createDataFrame([(1, "a", "INT", 0, "definition", "x"), (1, "b", "INT", 1, "definition", None)], kind)
    new = spark.createDataFrame([(1, "a", None, 5, "schema_yml", None), (2, "c", "TEXT", 0, "inferred", None)], kind)
    got = {(r["node_id"], r["column_name"]): (r["data_type"], r["position"], r["source"], r["description"]) for r in maintenance.upsert_columns(old, new).collect()}
    assert got[1, "a"] == ("INT", 5, "schema_yml", "x") and got[1, "b"][2] == "definition" and got[2, "c"][0] == "TEXT"


def test_snapshots(spark, tmp_path, chain):
    path = f"file://{tmp_path}/store"
    first = chain.save(path)
    chain.having(edges=chain.edges.limit(1)).save(path)
    assert Graph.load(spark, path).edges.count() == 1
    assert Graph.load(spark, path, first).edges.count() == 3


def members(spark, rows):
    return spark.createDataFrame([(1, layer, "models", name) for layer, name in rows], "repo_id bigint, layer string, prefix string, name string")


def pattern(spark, model_names):
    return conventions.naming_patterns(members(spark, [("l", n) for n in model_names])).first()


def test_naming(spark):
    got = pattern(spark, [f"stg_{x}" for x in ("a", "b", "c", "d", "e", "f")])
    assert got["pattern"] == "stg_{entity}" and got["confidence"] == 1.0
    got = pattern(spark, [f"stg_{x}" for x in "abcdefghij"] + ["legacy_users"])
    assert (got["matching_count"], got["total_count"], got["confidence"]) == (10, 11, 0.91)
    assert pattern(spark, ["stg_a", "stg_b", "stg_c", "stg_d"])["confidence"] == 0.6


@pytest.fixture(scope="module")
def layered(spark):
    paths = ["models/raw/r1.sql", "models/raw/r2.sql", "models/staging/s1.sql", "models/staging/s2.sql", "models/staging/s3.sql", "models/marts/m1.sql", "models/marts/m2.sql"]
    nodes = [(p.split("/")[-1][:-4], "table", k + 1) for k, p in enumerate(paths)]
    cols = spark.createDataFrame([(k + 1, c, "TEXT", 0) for k in range(7) for c in ("updated_at", *(["created_at"] if k % 5 else []))], "node_id bigint, column_name string, data_type string, position bigint")
    return build(spark, nodes, [(2, 0), (3, 1), (4, 0), (5, 2), (6, 3)], files=[(k + 1, 1, p) for k, p in enumerate(paths)], columns=cols)


def test_layers_and_rules(layered):
    got = {r["layer"]: (r["model_count"], r["path_pattern"], r["confidence"]) for r in conventions.detect_layers(layered).collect()}
    assert got == {"raw": (2, "models/raw/**", 0.6), "staging": (3, "models/staging/**", 0.6), "marts": (2, "models/marts/**", 0.6)}
    rules = {(r["source_layer"], r["target_layer"]): (r["confidence"], r["allowed"]) for r in conventions.reference_rules(layered).collect()}
    assert rules == {("staging", "raw"): (1.0, True), ("marts", "staging"): (1.0, True)}


def test_nested_domains_collapse(spark):
    paths = [f"models/{d}/{layer}/{d}_{k}.sql" for d in ("finance", "sales") for layer in ("staging", "marts") for k in range(2)]
    g = build(spark, [(p.split("/")[-1][:-4], "view", k + 1) for k, p in enumerate(paths)], [], files=[(k + 1, 1, p) for k, p in enumerate(paths)])
    assert {(r["layer"], r["model_count"]) for r in conventions.detect_layers(g).collect()} == {("staging", 4), ("marts", 4)}


def test_required_columns_and_style(layered):
    got = {(r["layer"], r["column_name"]): (r["frequency"], r["missing"]) for r in conventions.required_columns(layered).collect()}
    assert got["staging", "updated_at"] == (1.0, "") and got["staging", "created_at"] == (1.0, "")
    assert ("marts", "created_at") not in got
    assert {r["style"] for r in conventions.column_styles(layered).collect()} == {"snake_case"}


def test_conventions_merge_and_placement(spark, layered):
    g = layered.having(conventions=conventions.infer_conventions(layered))
    got = similarity.suggest_placement(g, ["s1", "s2"], "orders").first()
    assert (got["recommended_layer"], got["recommended_path"], got["ambiguous"]) == ("marts", "models/marts/", False)
    over = conventions.overrides_from_yaml(g, 1, "conventions:\n  marts:\n    naming: fct_{entity}\n")
    merged = conventions.merge_conventions(g.conventions, conventions.infer_conventions(layered), over)
    row = merged.filter("layer = 'marts' AND convention_type = 'naming'").first()
    assert row["source"] == "override" and "fct_" in row["payload"] and row["confidence"] == 1.0
    assert {r["change"] for r in conventions.conventions_diff(g.conventions, merged).collect()} == {"changed"}
    assert "fct_" in conventions.conventions_yaml(merged)


def test_similarity(spark, layered):
    got = similarity.find_similar_models(layered, model="s1").collect()
    assert got[0]["name"] == "s3" and got[0]["similarity"] >= 0.8 and got[0]["suggestion"] == "extend s3"
    with pytest.raises(LookupError):
        similarity.find_similar_models(layered, model="absent")
    assert similarity.find_similar_models(layered).count() == 0


def test_tags(spark):
    nodes = [*[(f"stg_{x}", "table", 1) for x in ("users", "orders")], *[(f"customer_{k}", "table", 1) for k in "vwxyz"]]
    g = build(spark, nodes, [(k, t) for k in range(2, 7) for t in (0, 1)])
    got = similarity.infer_tags(g).collect()
    assert {(r["tag_name"], r["confidence"]) for r in got} == {("customer", 0.95)} and len(got) == 5
    few = build(spark, nodes[:4], [(2, 0), (3, 0)])
    assert similarity.infer_tags(few).count() == 0


def naive_resolve(nodes, files, want, same_repo_only):
    rank = {"table": 0, "view": 1, "query": 2, "cte": 99, "subquery": 99}
    got = {}
    for key, name, kind, repo, schema in want:
        for node, file, own_kind, own, own_schema in nodes:
            if name is None or own != name or (schema is not None and own_schema != schema):
                continue
            home, same = file in files and repo is not None and files[file] == repo, None if kind is None or own_kind is None else kind == own_kind
            step = 1 if home and same else 2 if same and not same_repo_only else 3 if home else 4 if file is not None and not same_repo_only else None
            if step:
                at = (step, {True: 0, False: 1, None: 2}[same], rank.get(own_kind, 10), node)
                got[key] = min(got.get(key, at), at)
    return {k: (v[3], v[0]) for k, v in got.items()}


def test_resolution_equals_all_pairs(spark):
    import random

    dice = random.Random(7)
    kinds, schemas, names = ["table", "view", "query", "cte", "other", None], [None, "x", "y"], ["t", "u", "v", None]
    files = {1: 1, 2: 2, 3: 1, 4: 3}
    nodes = [(k, dice.choice([None, 1, 2, 3, 4]), dice.choice(kinds), dice.choice(names), dice.choice(schemas)) for k in range(40)]
    want = [(dice.choice([None, k, k // 2]), dice.choice([*names, "w"]), dice.choice(kinds), dice.choice([1, 2, 3, 9, None]), dice.choice([*schemas, "z"])) for k in range(300)]
    g = Graph.of(spark, files=spark.createDataFrame([(f, r, "p") for f, r in files.items()], "file_id bigint, repo_id bigint, path string"), nodes=spark.createDataFrame(nodes, NODE))
    asked = spark.createDataFrame(want, "key bigint, name string, kind string, repo_id bigint, schema string")
    for own in (False, True):
        assert {r["key"]: (r["node_id"], r["step"]) for r in maintenance.resolve_nodes(g, asked, own).collect()} == naive_resolve(nodes, files, want, own)


def test_resolution_meets_no_pairs_of_a_name(spark):
    """A name of many nodes that many keys ask for: pairs would be 400 million rows."""
    n = 20_000
    nodes = spark.range(n).selectExpr("id AS node_id", "1 + id % 2 AS file_id", "'table' AS kind", "'t' AS name")
    g = build(spark, ["x"], []).having(nodes=nodes)
    asked = spark.range(n).selectExpr("id AS key", "'t' AS name", "'table' AS kind", "1 + id % 2 AS repo_id", "CAST(NULL AS STRING) AS schema")
    found = maintenance.resolve_nodes(g, asked)
    assert [tuple(r) for r in found.groupBy("node_id", "step").count().orderBy("node_id").collect()] == [(0, 1, n // 2), (1, 1, n // 2)]
    assert "Window" not in found._jdf.queryExecution().toString()  # no ranking of pairs


def test_search_takes_wildcards_literally(spark):
    g = build(spark, ["a_b", "aXb", "100%", ("gone", "table", None)], [])
    assert names(catalog.search(g, "A_B")) == {"a_b"} and names(catalog.search(g, "%")) == {"100%"}
    assert names(catalog.search(g, "GON")) == {"gone"}


def test_filtered_usage_is_no_page(spark, monkeypatch):
    use = spark.createDataFrame([(k + 1, 1, "p3", "c1", "select") for k in range(130)], "node_id bigint, file_id bigint, table_name string, column_name string, usage_type string")
    repos = [(1, "asia"), (2, "b")]
    g = build(spark, [f"m{k}" for k in range(130)], [], repos=repos, column_usage=use)
    monkeypatch.setattr(registered, "derived", lambda *_: g)
    got = registered.QUERIES["column_usage_filtered"](spark, "").collect()
    assert len({r["node_id"] for r in got}) == 130 and {r["total_count"] for r in got} == {130}
    assert [r["node_id"] for r in catalog.find_column_usage(g, "p3", limit=None, offset=128).collect()] == [129, 130]


def test_snippets(spark):
    files = spark.createDataFrame([("r", "f.sql", "\n".join(f"l{k}" for k in range(1, 9)))], "repo string, path string, text string")
    spans = spark.createDataFrame([("r", "f.sql", 4, 5)], "repo string, path string, line_start bigint, line_end bigint")
    assert catalog.snippets(files, spans, context=1).first()["snippet"] == "   3 | l3\n   4 | l4\n   5 | l5\n   6 | l6"


def naive_merge(sets, threshold):
    members, union = [[i] for i in range(len(sets))], [set(x) for x in sets]
    while True:
        found = [(-len(union[i] & union[j]) / len(union[i] | union[j]), i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if union[i] and union[j]]
        s, i, j = min(found, default=(1, 0, 0))
        if -s < threshold:
            return sorted(sorted(m) for m in members if len(m) > 1)
        members[i] += members[j]
        union[i] |= union[j]
        members[j], union[j] = [], set()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 9), min_size=1, max_size=5), max_size=14), st.sampled_from([0.2, 0.4, 0.5, 0.75, 1.0]))
def test_merge_loop_equals_all_pairs(sets, threshold):
    assert sorted(sorted(m) for m in similarity._merge(sets, threshold)) == naive_merge(sets, threshold)


def test_similar_pairs_equal_all_pairs(spark):
    """Over several blocks, with copies, and with references so frequent that pairs are made from rare ones."""
    import random

    dice = random.Random(3)
    common = list(range(1000, 1040))
    sets = [sorted({*dice.sample(range(60), dice.randint(1, 12)), *(common if k % 3 == 0 else [])}) for k in range(150)]
    rows = [(1 + k % 2, k, sets[k if k < 120 else k - 80]) for k in range(150)]
    refs = spark.createDataFrame(rows, "repo_id bigint, node_id bigint, refs array<bigint>")
    want = {}
    for least in (0.3, 0.5, 1.0):
        for r, a, x in rows:
            for q, b, y in rows:
                both, either = len({*x} & {*y}), len({*x} | {*y})
                if r == q and a < b and both / either >= least:
                    want[a, b] = both / either
        got = [tuple(x) for x in similarity.similar_pairs(refs, least).collect()]
        assert len(got) == len({x[:2] for x in got}) and {(a, b): s for a, b, s in got} == want
        classes = similarity.reference_classes(refs)
        few = {tuple(sorted(x[:2])) for x in similarity.similar_classes(classes, least, block=300, cheap=-10**9).collect()}
        assert few == {tuple(sorted(x[:2])) for x in similarity.similar_classes(classes, least).collect()} and (few or least == 1)
        want = {}


def test_copies_are_compared_as_one(spark):
    """3000 models with the same references: one class, no pair of classes, and all 4.5 million pairs."""
    refs = spark.range(3000).selectExpr("1L AS repo_id", "id AS node_id", "array(7L, 8L) AS refs")
    classes = similarity.reference_classes(refs)
    assert classes.count() == 1 and similarity.similar_classes(classes).count() == 0
    assert similarity.similar_pairs(refs).filter("similarity = 1 AND a < b").count() == 3000 * 2999 // 2


def test_clusters_of_copies_cross_the_worker_once(spark):
    """600 models of 2 sets in one repo: 2 classes, one cluster, and the mean similarity of all pairs in its confidence."""
    names = ["a", "b", "c"] + [f"stg_topic_{k}" for k in range(600)]
    links = [(3 + k, t) for k in range(600) for t in ((0, 1) if k % 3 else (0, 1, 2))]
    g = build(spark, names, links)
    classes = similarity.reference_classes(similarity.model_references(g))
    assert classes.count() == 2
    assert {(r["cluster"], r["n"]) for r in similarity.semantic_clusters(g).groupBy("cluster").agg({"*": "count"}).toDF("cluster", "n").collect()} == {(4, 600)}
    got = {r["confidence"] for r in similarity.infer_tags(g).collect()}
    mean = lambda same, other: ((same - 1) + other * 2 / 3) / 599
    assert got == {round(min(0.85, 0.6 + (mean(*x) - 0.5) * 0.5) + 0.1, 2) for x in ((200, 400), (400, 200))}


def test_clusters_of_a_repo_of_over_500_models(spark):
    n = 300  # pairs that share both references, each its own cluster
    names = [f"src_{k}" for k in range(2 * n)] + [f"stg_topic_{k}" for k in range(2 * n)]
    links = [(2 * n + 2 * k + a, 2 * k + b) for k in range(n) for a in (0, 1) for b in (0, 1)]
    g = build(spark, names, links)
    got = similarity.semantic_clusters(g).select("cluster", "node_id").collect()
    assert sorted(map(tuple, got)) == [(2 * n + 2 * k + 1, 2 * n + 2 * k + a + 1) for k in range(n) for a in (0, 1)]
    assert similarity.infer_tags(g).filter("tag_name is not null").count() == 2 * n
