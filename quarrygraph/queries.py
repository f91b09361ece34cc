"""Registered queries over the derived graph and the DuckDB SQL that each has to equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import column_style, layer_of
from quarrygraph.graph import Graph
from quarrygraph.operators import catalog, centrality, conventions, impact, maintenance, similarity, traversal
from quarrygraph.plans.analyse import parse_files
from quarrygraph.sources import scan
from quarrygraph.streaming.debounce import sessions
from quarrygraph.testgraph import derived, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FLOW = """flow AS (SELECT e.source_id, e.target_id, e.relationship, e.context, s.name AS src_name, s.kind AS src_kind, s.file_id AS src_file,
    t.name AS tgt_name, t.kind AS tgt_kind, t.file_id AS tgt_file
  FROM edges e JOIN nodes s ON e.source_id = s.node_id JOIN nodes t ON e.target_id = t.node_id),
df AS (SELECT * FROM flow WHERE relationship <> 'defines'
  AND NOT (relationship = 'inserts_into' AND src_kind = 'query' AND tgt_kind = 'table' AND src_name = tgt_name)),
loc AS (SELECT n.*, f.path, f.repo_id, r.name AS repo FROM nodes n LEFT JOIN files f ON n.file_id = f.file_id LEFT JOIN repos r ON f.repo_id = r.repo_id)"""
RANK = "CASE kind WHEN 'table' THEN 0 WHEN 'view' THEN 1 WHEN 'query' THEN 2 WHEN 'cte' THEN 99 WHEN 'subquery' THEN 99 ELSE 10 END"
NOISE = "(kind = 'cte' OR regexp_matches(name, '^(not_null_|unique_|relationships_|accepted_values_)'))"
BEST = f"best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file_id IS NULL, {RANK}, node_id) AS rn FROM loc) WHERE rn = 1)"


def query(name: str, sql: str | None = None, *, ctes: str = "", raw: bool = False):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if raw else oracle(sql, ctes=ctes or FLOW)
        return f

    return add


def on_graph(name: str, sql: str | None = None, **more):
    """A query that takes the derived graph."""

    def add(f):
        query(name, sql, **more)(lambda spark, sf_dir: f(derived(spark, sf_dir)))
        return f

    return add


# --- traces
def _trace_sql(direction: str, depth: int, start: str = "m7", exclude: str = "FALSE", label: bool = True) -> tuple[str, str]:
    own, hop = ("src", "tgt") if direction == "downstream" else ("tgt", "src")
    ctes = f"""{FLOW},
walk AS (SELECT {hop}_name AS name, relationship, context, 1 AS depth, [{own}_name, {hop}_name] AS seen FROM df
    WHERE {own}_name = '{start}' AND {own}_kind NOT IN ('cte', 'subquery') AND {hop}_name <> {own}_name AND NOT ({exclude})
  UNION ALL
  SELECT d.{hop}_name, d.relationship, d.context, w.depth + 1, list_append(w.seen, d.{hop}_name) FROM df d JOIN walk w ON d.{own}_name = w.name
    WHERE w.depth < {depth} AND NOT list_contains(w.seen, d.{hop}_name) AND NOT ({exclude})),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY depth, relationship, context) AS k FROM walk) WHERE k = 1),
{BEST},
told AS (SELECT f.name, b.kind, f.depth, f.relationship, f.context, b.repo, b.path FROM first f LEFT JOIN best b ON f.name = b.name ORDER BY f.depth, f.name LIMIT 200),
kept AS (SELECT '{direction}' AS direction, * FROM told WHERE NOT {NOISE} ORDER BY depth, name LIMIT 100)"""
    return ctes, "SELECT direction, name, kind, depth, relationship, context, repo, path FROM kept"


for _d in ("downstream", "upstream"):
    _ctes, _sql = _trace_sql(_d, 3, "m7" if _d == "downstream" else "p43")
    on_graph(f"trace_{_d}_d3", _sql, ctes=_ctes)(lambda g, d=_d: traversal.trace(g, "m7" if d == "downstream" else "p43", direction=d, max_depth=3))

_ctes, _ = _trace_sql("downstream", 3)
on_graph("trace_depth_summary", "SELECT depth, count(*) AS n FROM kept GROUP BY depth", ctes=_ctes)(lambda g: traversal.depth_summary(traversal.trace(g, "m7")))
on_graph("trace_repos_affected", "SELECT DISTINCT repo FROM kept WHERE repo IS NOT NULL", ctes=_ctes)(lambda g: traversal.repos_affected(traversal.trace(g, "m7")))
_ctes, _sql = _trace_sql("downstream", 3, exclude="src_name = 'm7' AND tgt_name = 'p43'")
on_graph("trace_excluding_edges", _sql, ctes=_ctes)(lambda g: traversal.trace(g, "m7", exclude=g.spark.createDataFrame([("m7", "p43")], "source_name string, target_name string")))
_down, _ = _trace_sql("downstream", 2, "p43")
_up, _ = _trace_sql("upstream", 2, "p43")
_both = _down + ",\n" + _up[len(FLOW) + 2 :].replace(BEST + ",", "").replace("walk", "walk2").replace("first", "first2").replace("told", "told2").replace("kept", "kept2")
on_graph("trace_both", "SELECT direction, name, kind, depth, relationship, context, repo, path FROM kept UNION ALL SELECT direction, name, kind, depth, relationship, context, repo, path FROM kept2", ctes=_both)(
    lambda g: traversal.trace(g, "p43", direction="both", max_depth=2)
)


# --- search and references
on_graph("search_substring", "SELECT node_id, name, kind, CAST(NULL AS VARCHAR) AS schema, CAST(NULL AS VARCHAR) AS language, repo, path, (SELECT count(*) FROM loc WHERE name ILIKE '%M1%') AS total_count FROM loc WHERE name ILIKE '%M1%' ORDER BY name, kind, node_id LIMIT 20")(
    lambda g: catalog.search(g, "M1")
)
_ODD = "odd AS (SELECT node_id, CASE WHEN kind = 'view' THEN name || '%_X' ELSE name END AS name, kind, repo, path FROM loc)"
on_graph(
    "search_escaped",
    "SELECT node_id, name, kind, CAST(NULL AS VARCHAR) AS schema, CAST(NULL AS VARCHAR) AS language, repo, path, (SELECT count(*) FROM odd WHERE contains(lower(name), '1%_')) AS total_count FROM odd WHERE contains(lower(name), '1%_') ORDER BY name, kind, node_id LIMIT 20",
    ctes=f"{FLOW}, {_ODD}",
)(lambda g: catalog.search(g.having(nodes=g.nodes.withColumn("name", F.when(F.col("kind") == "view", F.concat("name", F.lit("%_X"))).otherwise(F.col("name")))), "1%_"))
on_graph(
    "search_kind_repo_page",
    "SELECT node_id, name, kind, CAST(NULL AS VARCHAR) AS schema, CAST(NULL AS VARCHAR) AS language, repo, path, (SELECT count(*) FROM loc WHERE contains(name, 'p1') AND kind = 'view' AND repo = 'asia') AS total_count FROM loc WHERE contains(name, 'p1') AND kind = 'view' AND repo = 'asia' ORDER BY name, kind, node_id LIMIT 10 OFFSET 5",
)(lambda g: catalog.search(g, "p1", kind="view", repo="asia", limit=10, offset=5))

_REF = "SELECT '{label}' AS direction, d.{other}_id AS node_id, d.{o}_name AS name, d.{o}_kind AS kind, d.relationship, d.context, l.repo, l.path FROM df d JOIN loc l ON d.{other}_id = l.node_id WHERE d.{own}_id IN (SELECT node_id FROM nodes WHERE name = '{name}') AND d.{o}_kind <> 'cte' ORDER BY 3, 4, 2, 5, 6 LIMIT 100"
on_graph("references_inbound", _REF.format(label="inbound", other="source", own="target", o="src", name="p43"))(lambda g: catalog.find_references(g, "p43"))
on_graph("references_outbound", _REF.format(label="outbound", other="target", own="source", o="tgt", name="m7"))(lambda g: catalog.find_references(g, "m7", direction="outbound"))

# --- column usage and lineage
_USE = "used AS (SELECT u.*, n.name AS node_name, n.kind AS node_kind, f.path, r.name AS repo FROM column_usage u JOIN nodes n ON u.node_id = n.node_id JOIN files f ON u.file_id = f.file_id JOIN repos r ON f.repo_id = r.repo_id WHERE u.table_name = 'p43'), page AS (SELECT * FROM used ORDER BY table_name, column_name, usage_type, node_id, transform NULLS FIRST LIMIT 100)"
on_graph("column_usage_page", "SELECT table_name, column_name, usage_type, node_id, node_name, node_kind, repo, path, CAST(NULL AS VARCHAR) AS alias, transform, (SELECT count(*) FROM used) AS total_count FROM page", ctes=f"{FLOW}, {_USE}")(lambda g: catalog.find_column_usage(g, "p43"))
on_graph("column_usage_summary", "SELECT usage_type, count(*) AS n FROM page GROUP BY usage_type", ctes=f"{FLOW}, {_USE}")(lambda g: catalog.column_usage_summary(catalog.find_column_usage(g, "p43")))
on_graph("column_usage_filtered", "SELECT table_name, column_name, usage_type, node_id, node_name, node_kind, repo, path, CAST(NULL AS VARCHAR) AS alias, transform, (SELECT count(*) FROM used WHERE column_name = 'c1' AND usage_type = 'select' AND repo = 'asia') AS total_count FROM used WHERE column_name = 'c1' AND usage_type = 'select' AND repo = 'asia'", ctes=f"{FLOW}, {_USE.replace('p43', 'p3')}")(
    lambda g: catalog.find_column_usage(g, "p3", "c1", "select", "asia", limit=None)
)
_HOPS = "SELECT l.output_node, l.output_column, l.chain_index, l.hop_index, l.hop_column, l.hop_table, CAST(NULL AS VARCHAR) AS hop_expression FROM column_lineage l JOIN chains c ON l.output_node = c.output_node AND l.output_column = c.output_column AND l.chain_index = c.chain_index"
_CHAINS = "chains AS (SELECT DISTINCT output_node, output_column, chain_index FROM column_lineage WHERE {w} ORDER BY 1, 2, 3 LIMIT {n} OFFSET {o})"
on_graph("lineage_by_output", _HOPS, ctes=f"{FLOW}, {_CHAINS.format(w="output_node = 'm7'", n=100, o=0)}")(lambda g: catalog.trace_column_lineage(g, output_node="m7"))
on_graph("lineage_by_hop", _HOPS, ctes=f"{FLOW}, {_CHAINS.format(w="hop_table = 'p80' OR FALSE", n=100, o=0)}")(lambda g: catalog.trace_column_lineage(g, table="p80"))
on_graph("lineage_chain_page", _HOPS, ctes=f"{FLOW}, {_CHAINS.format(w="output_column = 'user' OR hop_column = 'user'", n=15, o=5)}")(lambda g: catalog.trace_column_lineage(g, column="user", limit=15, offset=5))
on_graph("lineage_chains", "SELECT output_node, output_column, chain_index, string_agg(hop_table || '.' || hop_column, ' <- ' ORDER BY hop_index) AS chain, count(*) AS hops FROM column_lineage GROUP BY 1, 2, 3")(lambda g: catalog.lineage_chains(g.column_lineage))

# --- schema, context, catalog
_PICK = "pick AS (SELECT max(node_id) AS node_id FROM loc WHERE name = 'p43' AND file_id IS NOT NULL)"
on_graph("schema_columns", "SELECT c.node_id, c.column_name, c.data_type, c.position, CAST(NULL AS VARCHAR) AS description FROM columns c JOIN pick p ON c.node_id = p.node_id", ctes=f"{FLOW}, {_PICK}")(lambda g: catalog.schema_columns(g, "p43"))
on_graph("schema_neighbours", "SELECT 'upstream' AS side, tgt_name AS name, tgt_kind AS kind FROM flow JOIN pick ON source_id = node_id UNION SELECT 'downstream', src_name, src_kind FROM flow JOIN pick ON target_id = node_id", ctes=f"{FLOW}, {_PICK}")(
    lambda g: catalog.schema_neighbours(g, "p43")
)
on_graph("schema_matches", "SELECT p.node_id, l.name, l.kind, CAST(NULL AS VARCHAR) AS schema, l.repo, l.path, (SELECT count(*) FROM loc WHERE name = 'p43' AND file_id IS NOT NULL) AS matches FROM pick p JOIN loc l ON p.node_id = l.node_id", ctes=f"{FLOW}, {_PICK}")(lambda g: catalog.pick_node(g, "p43"))
on_graph(
    "context_top_columns",
    "SELECT column_name, CAST(sum(n) AS BIGINT) AS total, string_agg(usage_type || '=' || n, ',' ORDER BY usage_type || '=' || n) AS by_type FROM (SELECT column_name, usage_type, count(*) AS n FROM column_usage WHERE table_name = 'p43' GROUP BY 1, 2) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)(lambda g: catalog.context_top_columns(g, "p43"))
on_graph(
    "context_keys", "SELECT DISTINCT CASE WHEN usage_type = 'join_on' THEN 'join' ELSE 'group' END AS role, column_name FROM column_usage WHERE table_name = 'p43' AND usage_type IN ('join_on', 'group_by', 'partition_by')"
)(lambda g: catalog.context_keys(g, "p43"))
_ENTRIES = "entries AS (SELECT l.name AS table_name, c.column_name, c.data_type, l.repo, 0 AS r, l.node_id FROM columns c JOIN loc l ON c.node_id = l.node_id WHERE l.file_id IS NOT NULL UNION ALL SELECT u.table_name, u.column_name, 'TEXT', r.name, 1, u.node_id FROM column_usage u JOIN files f ON u.file_id = f.file_id JOIN repos r ON f.repo_id = r.repo_id)"
_CAT = "SELECT table_name, column_name, data_type FROM (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY {o}r, node_id, data_type) AS k FROM entries) WHERE k = 1"
on_graph("schema_catalog", _CAT.format(o=""), ctes=f"{FLOW}, {_ENTRIES}")(lambda g: catalog.schema_catalog(g))
on_graph("cross_repo_catalog", _CAT.format(o="repo <> 'asia', "), ctes=f"{FLOW}, {_ENTRIES}")(lambda g: catalog.schema_catalog(g, "asia"))

# --- paths, cycles
_PATH = f"""{FLOW}, walk AS (SELECT (SELECT min(node_id) FROM nodes WHERE name = '{{a}}') AS id, ['{{a}}'] AS path
  UNION ALL SELECT d.target_id, list_append(w.path, d.tgt_name) FROM walk w JOIN (SELECT DISTINCT source_id, target_id, tgt_name FROM df) d ON d.source_id = w.id
    WHERE len(w.path) <= 5 AND NOT list_contains(w.path, d.tgt_name))"""
_PATH_END = "SELECT array_to_string(path, ' -> ') AS path, CAST(len(path) - 1 AS INT) AS length FROM walk WHERE id = (SELECT min(node_id) FROM nodes WHERE name = '{b}') AND len(path) > 1 ORDER BY len(path), path LIMIT 1"
on_graph("find_path", _PATH_END.format(b="p84"), ctes=_PATH.format(a="p0"))(lambda g: traversal.find_path(g, "p0", "p84", 5))
on_graph("find_path_none", _PATH_END.format(b="m7"), ctes=_PATH.format(a="p43"))(lambda g: traversal.find_path(g, "p43", "m7", 5))


on_graph(
    "detect_cycles",
    "SELECT CAST(c.n AS INT) AS length, c.ids AS node_ids, string_agg(n.name, ' -> ' ORDER BY c.k) AS path FROM (SELECT n, ids, unnest(p) AS id, generate_subscripts(p, 1) AS k FROM (SELECT DISTINCT len(p) AS n, array_to_string(p, ',') AS ids, p FROM walk JOIN links l ON l.source_id = p[-1] AND l.target_id = p[1] WHERE len(p) > 1 AND list_min(p) = p[1])) c JOIN nodes n ON c.id = n.node_id GROUP BY 1, 2",
    ctes=f"{FLOW}, links AS (SELECT DISTINCT source_id, target_id FROM edges), walk AS (SELECT [source_id] AS p FROM (SELECT DISTINCT source_id FROM links) UNION ALL SELECT list_append(p, target_id) FROM walk JOIN links ON source_id = p[-1] WHERE len(p) < 5 AND NOT list_contains(p, target_id))",
)(lambda g: traversal.detect_cycles(g, max_length=5))

# --- centrality
_N = 20
_PR = f"""{FLOW}, links AS (SELECT DISTINCT source_id, target_id FROM edges), outs AS (SELECT source_id, count(*) AS o FROM links GROUP BY 1),
c AS (SELECT count(*) AS n FROM nodes), r0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE / c.n AS rank FROM nodes, c), """ + ", ".join(
    f"""r{k + 1} AS MATERIALIZED (SELECT p.node_id, 0.15 / c.n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(x.rank), 0) FROM r{k} x WHERE x.node_id NOT IN (SELECT source_id FROM outs)) / c.n) AS rank
  FROM r{k} p CROSS JOIN c LEFT JOIN (SELECT l.target_id, sum(q.rank / outs.o) AS got FROM links l JOIN r{k} q ON l.source_id = q.node_id JOIN outs ON l.source_id = outs.source_id GROUP BY 1) g ON p.node_id = g.target_id)"""
    for k in range(_N)
)
on_graph(
    "pagerank_top",
    f"SELECT l.node_id, l.name, l.kind, l.repo, round(r.rank, 6) AS importance, coalesce(d.n, 0) AS direct_dependents FROM r{_N} r JOIN loc l ON r.node_id = l.node_id LEFT JOIN (SELECT target_id, count(DISTINCT source_id) AS n FROM edges GROUP BY 1) d ON d.target_id = l.node_id WHERE l.file_id IS NOT NULL ORDER BY 5 DESC, 1 LIMIT 20",
    ctes=_PR,
)(lambda g: centrality.find_critical_models(g))
on_graph("direct_dependents", "SELECT target_id AS node_id, count(DISTINCT source_id) AS direct_dependents FROM edges GROUP BY 1")(centrality.direct_dependents)
_CC = f"{FLOW}, pair AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges UNION SELECT node_id, node_id FROM nodes), low0 AS (SELECT node_id AS a, node_id AS low FROM nodes), " + ", ".join(
    f"low{k + 1} AS MATERIALIZED (SELECT p.a, min(l.low) AS low FROM pair p JOIN low{k} l ON p.b = l.a GROUP BY p.a)" for k in range(12)
)  # more rounds than any component is wide
_CC += ", comp AS (SELECT a AS node_id, low AS component FROM low12)"
on_graph("connected_components", "SELECT c.component, count(*) AS size, string_agg(l.name, ',' ORDER BY l.name) AS members FROM comp c JOIN loc l ON c.node_id = l.node_id WHERE l.file_id IS NOT NULL GROUP BY 1", ctes=_CC)(centrality.find_subgraphs)
_DEFS = _CC.replace("target_id AS b FROM edges", "target_id AS b FROM edges WHERE relationship = 'defines'").replace("target_id, source_id FROM edges", "target_id, source_id FROM edges WHERE relationship = 'defines'")
on_graph("orphans", "SELECT min(l.name) AS name FROM comp c JOIN loc l ON c.node_id = l.node_id WHERE l.file_id IS NOT NULL GROUP BY c.component HAVING count(*) = 1", ctes=_DEFS)(
    lambda g: centrality.orphans(g.having(edges=g.edges.filter("relationship = 'defines'")))  # nodes that no definition links to others
)
_LCC = "und AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM edges WHERE source_id <> target_id), nb AS (SELECT a AS v, b AS w FROM und UNION ALL SELECT b, a FROM und), deg AS (SELECT v, count(*) AS d FROM nb GROUP BY v), tri AS (SELECT x.v, count(*) AS t FROM nb x JOIN nb y ON x.v = y.v AND x.w < y.w JOIN und u ON u.a = x.w AND u.b = y.w GROUP BY x.v), lcc AS (SELECT deg.v AS node_id, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0::DOUBLE END AS lcc FROM deg LEFT JOIN tri ON deg.v = tri.v)"
on_graph("local_clustering", "SELECT node_id, lcc FROM lcc", ctes=f"{FLOW}, {_LCC}")(centrality.local_clustering)
_BOTTLE = "SELECT l.node_id, l.name, l.kind, l.repo, i.n AS downstream, coalesce(o.n, 0) AS upstream, round(c.lcc, 4) AS clustering, CASE WHEN i.n > 20 AND (c.lcc IS NULL OR c.lcc < 0.1) THEN 'high' WHEN i.n > 10 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT target_id, count(DISTINCT source_id) AS n FROM df GROUP BY 1 HAVING count(DISTINCT source_id) >= 5) i JOIN loc l ON i.target_id = l.node_id AND l.file_id IS NOT NULL LEFT JOIN (SELECT source_id, count(DISTINCT target_id) AS n FROM df GROUP BY 1) o ON o.source_id = l.node_id LEFT JOIN lcc c ON c.node_id = l.node_id"
on_graph("bottlenecks", _BOTTLE, ctes=f"{FLOW}, {_LCC}")(centrality.find_bottlenecks)
on_graph("bottlenecks_repo", _BOTTLE + " WHERE l.repo = 'asia'", ctes=f"{FLOW}, {_LCC}")(lambda g: centrality.find_bottlenecks(g, repo="asia"))

# --- impact
_DOWN = "down AS (SELECT DISTINCT src_name AS name FROM df WHERE tgt_name = 'p43' AND src_kind <> 'cte'), hit AS (SELECT n.name, max(CASE WHEN usage_type IN ('select', 'join_on', 'insert', 'update') THEN 2 ELSE 1 END) AS s, string_agg(DISTINCT usage_type, ',' ORDER BY usage_type) AS usages FROM column_usage u JOIN nodes n ON u.node_id = n.node_id WHERE table_name = 'p43' AND column_name = 'c1' GROUP BY 1)"
on_graph(
    "impact_remove_column",
    "SELECT 0 AS ord, 'remove_column c1' AS change, name, CASE s WHEN 2 THEN 'breaking' ELSE 'warning' END AS severity, usages FROM hit UNION ALL SELECT 0, 'remove_column c1', name, 'safe', '' FROM down WHERE name NOT IN (SELECT name FROM hit)",
    ctes=f"{FLOW}, {_DOWN}",
)(lambda g: impact.check_impact(g, "p43", [{"action": "remove_column", "column": "c1"}]))
on_graph("impact_add_column", "SELECT 0 AS ord, 'add_column zz' AS change, name, 'safe' AS severity, '' AS usages FROM down", ctes=f"{FLOW}, {_DOWN}")(lambda g: impact.check_impact(g, "p43", [{"action": "add_column", "column": "zz"}]))
on_graph(
    "impact_mixed",
    "SELECT 0 AS ord, 'rename_column c1' AS change, name, CASE s WHEN 2 THEN 'breaking' ELSE 'warning' END AS severity, usages FROM hit UNION ALL SELECT 0, 'rename_column c1', name, 'safe', '' FROM down WHERE name NOT IN (SELECT name FROM hit) UNION ALL SELECT 1, 'frob x', NULL, 'skipped', ''",
    ctes=f"{FLOW}, {_DOWN}",
)(lambda g: impact.check_impact(g, "p43", [{"action": "rename_column", "old": "c1"}, {"action": "frob", "column": "x"}]))
on_graph("impact_downstream", "SELECT DISTINCT src_name AS name, src_kind AS kind FROM df WHERE tgt_name = 'p43' AND src_kind <> 'cte'")(lambda g: impact.downstream_models(g, "p43"))


def _snapshots(g: Graph) -> tuple[Graph, Graph]:
    """Two snapshots: the base lacks some nodes, edges and uses, the head others."""
    base = g.having(nodes=g.nodes.filter("node_id % 11 <> 3"), edges=g.edges.filter("target_id % 7 <> 2"), column_usage=g.column_usage.filter("node_id % 13 <> 5"))
    head = g.having(nodes=g.nodes.filter("node_id % 17 <> 4"), edges=g.edges.filter("target_id % 5 <> 1"), column_usage=g.column_usage.filter("node_id % 19 <> 6"))
    return base, head


_SNAP = """bn AS (SELECT * FROM nodes WHERE node_id % 11 <> 3), hn AS (SELECT * FROM nodes WHERE node_id % 17 <> 4),
be AS (SELECT DISTINCT s.name AS src_name, s.kind AS src_kind, t.name AS tgt_name, t.kind AS tgt_kind, relationship FROM edges e JOIN bn s ON source_id = s.node_id JOIN bn t ON target_id = t.node_id WHERE target_id % 7 <> 2),
he AS (SELECT DISTINCT s.name AS src_name, s.kind AS src_kind, t.name AS tgt_name, t.kind AS tgt_kind, relationship FROM edges e JOIN hn s ON source_id = s.node_id JOIN hn t ON target_id = t.node_id WHERE target_id % 5 <> 1),
bu AS (SELECT DISTINCT n.name AS node_name, table_name, column_name, usage_type FROM column_usage u JOIN bn n ON u.node_id = n.node_id WHERE u.node_id % 13 <> 5),
hu AS (SELECT DISTINCT n.name AS node_name, table_name, column_name, usage_type FROM column_usage u JOIN hn n ON u.node_id = n.node_id WHERE u.node_id % 19 <> 6)"""


def _diff_sql(a: str, b: str, cols: str) -> str:
    return f"SELECT 'added' AS change, * FROM (SELECT {cols} FROM {b} EXCEPT SELECT {cols} FROM {a}) UNION ALL SELECT 'removed', * FROM (SELECT {cols} FROM {a} EXCEPT SELECT {cols} FROM {b})"


on_graph("structural_diff_nodes", _diff_sql("bn", "hn", "name, kind, '' AS schema"), ctes=f"{FLOW}, {_SNAP}")(lambda g: impact.structural_diff(*_snapshots(g), "nodes"))
on_graph("structural_diff_edges", _diff_sql("be", "he", "src_name, src_kind, tgt_name, tgt_kind, relationship"), ctes=f"{FLOW}, {_SNAP}")(lambda g: impact.structural_diff(*_snapshots(g), "edges"))
on_graph("structural_diff_columns", _diff_sql("bu", "hu", "node_name, table_name, column_name, usage_type"), ctes=f"{FLOW}, {_SNAP}")(lambda g: impact.structural_diff(*_snapshots(g), "columns"))
_MOD = f"{FLOW}, {_SNAP}, de AS ({_diff_sql('be', 'he', 'src_name, src_kind, tgt_name, tgt_kind, relationship')}), du AS ({_diff_sql('bu', 'hu', 'node_name, table_name, column_name, usage_type')}), modified AS (SELECT DISTINCT b.name FROM bn b JOIN hn h ON b.name = h.name AND b.kind = h.kind WHERE b.name IN (SELECT src_name FROM de UNION SELECT node_name FROM du))"
on_graph("structural_diff_modified", "SELECT name FROM modified", ctes=_MOD)(lambda g: impact.nodes_modified(*_snapshots(g)))
_PRI = f"""{_MOD}, roots AS (SELECT name AS root FROM (SELECT name FROM ({_diff_sql('bn', 'hn', 'name, kind')}) UNION SELECT name FROM modified) ORDER BY 1 LIMIT 20),
hf AS (SELECT DISTINCT src_name, src_kind, tgt_name FROM he WHERE relationship <> 'defines'),
fresh AS (SELECT DISTINCT src_name, tgt_name FROM (SELECT * FROM he EXCEPT SELECT * FROM be)),
bf AS (SELECT h.* FROM hf h WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.src_name = h.src_name AND f.tgt_name = h.tgt_name)),
a1 AS (SELECT root, tgt_name AS name FROM hf JOIN roots ON src_name = root WHERE src_kind NOT IN ('cte', 'subquery') AND tgt_name <> root), a2 AS (SELECT root, name FROM a1 UNION SELECT root, tgt_name FROM a1 JOIN hf ON src_name = name WHERE tgt_name <> root),
b1 AS (SELECT root, tgt_name AS name FROM bf JOIN roots ON src_name = root WHERE src_kind NOT IN ('cte', 'subquery') AND tgt_name <> root), b2 AS (SELECT root, name FROM b1 UNION SELECT root, tgt_name FROM b1 JOIN bf ON src_name = name WHERE tgt_name <> root)"""
on_graph(
    "pr_impact_delta",
    "SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.name IS NULL THEN 'newly_affected' WHEN a.name IS NULL THEN 'no_longer_affected' ELSE 'unchanged' END AS status FROM (SELECT DISTINCT name FROM a2) a FULL JOIN (SELECT DISTINCT name FROM b2) b ON a.name = b.name",
    ctes=_PRI,
)(lambda g: impact.pr_impact(*_snapshots(g), depth=2))
on_graph("pr_impact_absolute", "SELECT DISTINCT name, 'affected' AS status FROM a2", ctes=_PRI)(lambda g: impact.pr_impact(*_snapshots(g), depth=2, mode="absolute"))

# --- tags, similarity, placement
on_graph("tag_search", "SELECT t.node_id, t.tag_name, t.confidence, l.name, l.kind, l.repo, l.path FROM semantic_tags t JOIN loc l ON t.node_id = l.node_id WHERE tag_name = 'src3' AND confidence >= 0.8")(lambda g: catalog.search_by_tag(g, "src3", min_confidence=0.8))
on_graph("tag_list", "SELECT tag_name, count(*) AS model_count, round(avg(confidence), 4) AS avg_confidence FROM semantic_tags GROUP BY 1")(catalog.list_tags)
_SIM = """cand AS (SELECT node_id, name, path, split_part(path, '/', 2) AS layer FROM loc WHERE kind IN ('table', 'view') AND file_id IS NOT NULL),
refs AS (SELECT DISTINCT e.source_id AS node_id, t.name FROM edges e JOIN nodes t ON e.target_id = t.node_id WHERE relationship = 'references'),
cols AS (SELECT DISTINCT node_id, column_name AS name FROM columns),
wr AS (SELECT unnest(['p43', 'p3', 'p51']) AS name), wc AS (SELECT unnest(['size_1', 'size_2', 'brand_11']) AS name),
score AS (SELECT c.node_id, c.name, c.path,
  (SELECT count(*) FROM refs r JOIN wr ON r.name = wr.name WHERE r.node_id = c.node_id) AS ri, (SELECT count(*) FROM refs r WHERE r.node_id = c.node_id) AS rn,
  (SELECT count(*) FROM cols r JOIN wc ON r.name = wc.name WHERE r.node_id = c.node_id) AS ci, (SELECT count(*) FROM cols r WHERE r.node_id = c.node_id) AS cn,
  coalesce((SELECT string_agg(r.name, ',' ORDER BY r.name) FROM refs r JOIN wr ON r.name = wr.name WHERE r.node_id = c.node_id), '') AS shared_refs,
  coalesce((SELECT string_agg(r.name, ',' ORDER BY r.name) FROM cols r JOIN wc ON r.name = wc.name WHERE r.node_id = c.node_id), '') AS shared_columns FROM cand c),
done AS (SELECT *, 0.6::DOUBLE * ri / (3 + rn - ri) + 0.3::DOUBLE * ci / (3 + cn - ci) AS s FROM score)"""
on_graph(
    "similar_models",
    "SELECT node_id, name, path, round(s, 4) AS similarity, shared_refs, shared_columns, CASE WHEN s >= 0.8 THEN 'extend ' || name END AS suggestion FROM done WHERE s >= 0.05 ORDER BY round(s, 12) DESC, name, node_id LIMIT 20",
    ctes=f"{FLOW}, {_SIM}",
)(lambda g: similarity.find_similar_models(g, ["p43", "p3", "p51"], ["size_1", "size_2", "brand_11"], limit=20))
_PAIRS = "m AS (SELECT n.node_id, f.repo_id FROM nodes n JOIN files f ON n.file_id = f.file_id WHERE kind IN ('table', 'view')), ref AS (SELECT DISTINCT m.repo_id, m.node_id, x.ref FROM m JOIN (SELECT source_id AS node_id, target_id AS ref FROM edges WHERE relationship IN ('references', 'cte_references') UNION SELECT d.target_id, e.target_id FROM edges d JOIN edges e ON d.source_id = e.source_id WHERE d.relationship = 'defines' AND e.relationship IN ('references', 'cte_references')) x ON x.node_id = m.node_id WHERE x.ref <> m.node_id), n AS (SELECT node_id, count(*) AS n FROM ref GROUP BY 1)"
on_graph(
    "similar_pairs",
    "SELECT a, b, k::DOUBLE / (x.n + y.n - k) AS similarity FROM (SELECT p.node_id AS a, q.node_id AS b, count(*) AS k FROM ref p JOIN ref q ON p.repo_id = q.repo_id AND p.ref = q.ref AND p.node_id < q.node_id GROUP BY 1, 2) JOIN n x ON a = x.node_id JOIN n y ON b = y.node_id WHERE k::DOUBLE / (x.n + y.n - k) >= 0.5",
    ctes=f"{FLOW}, {_PAIRS}",
)(lambda g: similarity.similar_pairs(similarity.model_references(g)))
on_graph("semantic_clusters")(lambda g: similarity.semantic_clusters(g).select("repo_id", "cluster", "node_id", "name"))
on_graph("inferred_tags")(lambda g: similarity.infer_tags(g))

# --- conventions
_LAY = "mem AS (SELECT DISTINCT f.repo_id, f.path, split_part(f.path, '/', 2) AS layer, n.name FROM nodes n JOIN files f ON n.file_id = f.file_id WHERE n.kind IN ('table', 'view')), lay AS (SELECT repo_id, layer, count(*) AS model_count FROM mem GROUP BY 1, 2 HAVING count(*) >= 2)"
on_graph("layers", "SELECT repo_id, layer, 'models/' || layer || '/**' AS path_pattern, model_count, CASE WHEN model_count >= 10 THEN 0.9 WHEN model_count >= 5 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM lay", ctes=f"{FLOW}, {_LAY}")(conventions.detect_layers)
_RULES = "own AS (SELECT repo_id, name, layer FROM (SELECT m.repo_id, m.name, m.layer, row_number() OVER (PARTITION BY m.repo_id, m.name ORDER BY l.model_count, m.layer DESC) AS k FROM mem m JOIN lay l ON m.repo_id = l.repo_id AND m.layer = l.layer) WHERE k = 1), cnt AS (SELECT sf.repo_id, a.layer AS source_layer, b.layer AS target_layer, count(*) AS n FROM flow e JOIN files sf ON e.src_file = sf.file_id LEFT JOIN files tf ON e.tgt_file = tf.file_id JOIN own a ON a.repo_id = sf.repo_id AND a.name = e.src_name JOIN own b ON b.repo_id = sf.repo_id AND b.name = e.tgt_name WHERE e.relationship IN ('references', 'cte_references') AND (e.tgt_file IS NULL OR tf.repo_id = sf.repo_id) AND a.layer <> b.layer GROUP BY 1, 2, 3), sh AS (SELECT repo_id, source_layer, target_layer, round_even(n::DOUBLE / sum(n) OVER (PARTITION BY repo_id, source_layer), 2) AS share FROM cnt)"
on_graph("reference_rules", "SELECT *, share >= 0.1 AS allowed, max(share) OVER (PARTITION BY repo_id, source_layer) AS confidence FROM sh", ctes=f"{FLOW}, {_LAY}, {_RULES}")(lambda g: conventions.reference_rules(g))
_REQ = "nd AS (SELECT DISTINCT l.repo_id, l.layer, l.model_count, n.node_id, n.name FROM mem m JOIN lay l ON m.repo_id = l.repo_id AND m.layer = l.layer JOIN files f ON f.repo_id = m.repo_id JOIN nodes n ON n.file_id = f.file_id AND n.name = m.name), d AS (SELECT repo_id, layer, column_name, count(DISTINCT nd.node_id) AS n FROM nd JOIN columns c ON nd.node_id = c.node_id GROUP BY 1, 2, 3), u AS (SELECT repo_id, layer, column_name, count(DISTINCT nd.node_id) AS n FROM nd JOIN column_usage c ON nd.node_id = c.node_id WHERE usage_type = 'select' GROUP BY 1, 2, 3), fr AS (SELECT coalesce(d.repo_id, u.repo_id) AS repo_id, coalesce(d.layer, u.layer) AS layer, coalesce(d.column_name, u.column_name) AS column_name, CASE WHEN d.n IS NOT NULL AND u.n IS NOT NULL THEN 'both' WHEN d.n IS NOT NULL THEN 'definition' ELSE 'usage' END AS source, greatest(coalesce(d.n, 0), coalesce(u.n, 0)) AS n FROM d FULL JOIN u ON d.repo_id = u.repo_id AND d.layer = u.layer AND d.column_name = u.column_name), kept AS (SELECT fr.*, least(fr.n::DOUBLE / lay.model_count, 1.0) AS f FROM fr JOIN lay ON fr.repo_id = lay.repo_id AND fr.layer = lay.layer WHERE least(fr.n::DOUBLE / lay.model_count, 1.0) >= {t}), has AS (SELECT DISTINCT repo_id, layer, name, column_name FROM nd JOIN (SELECT node_id, column_name FROM columns UNION SELECT node_id, column_name FROM column_usage) x ON nd.node_id = x.node_id), mi AS (SELECT k.repo_id, k.layer, k.column_name, string_agg(m.name, ',' ORDER BY m.name) AS missing FROM kept k JOIN mem m ON k.repo_id = m.repo_id AND k.layer = m.layer WHERE NOT EXISTS (SELECT 1 FROM has h WHERE h.repo_id = k.repo_id AND h.layer = k.layer AND h.name = m.name AND h.column_name = k.column_name) GROUP BY 1, 2, 3)"
on_graph("required_columns", "SELECT k.repo_id, k.layer, k.column_name, round_even(k.f, 2) AS frequency, k.source, coalesce(mi.missing, '') AS missing FROM kept k LEFT JOIN mi ON k.repo_id = mi.repo_id AND k.layer = mi.layer AND k.column_name = mi.column_name", ctes=f"{FLOW}, {_LAY}, {_REQ.format(t=0.1)}")(
    lambda g: conventions.required_columns(g, threshold=0.1)
)
_STYLE = "cn AS (SELECT DISTINCT repo_id, layer, column_name FROM nd JOIN columns c ON nd.node_id = c.node_id), st AS (SELECT repo_id, layer, CASE WHEN column_name = upper(column_name) AND contains(column_name, '_') THEN 'SCREAMING_SNAKE' WHEN column_name = lower(column_name) AND contains(column_name, '_') THEN 'snake_case' END AS style, count(*) AS n FROM cn GROUP BY 1, 2, 3), tot AS (SELECT *, sum(n) OVER (PARTITION BY repo_id, layer) AS t, row_number() OVER (PARTITION BY repo_id, layer ORDER BY n DESC) AS k FROM st WHERE style IS NOT NULL)"
on_graph("column_style", "SELECT lay.repo_id, lay.layer, coalesce(style, 'snake_case') AS style, coalesce(round_even(n::DOUBLE / t, 2), 0.0) AS confidence FROM lay LEFT JOIN tot ON lay.repo_id = tot.repo_id AND lay.layer = tot.layer AND k = 1", ctes=f"{FLOW}, {_LAY}, {_REQ.format(t=0.1)}, {_STYLE}")(
    lambda g: conventions.column_styles(g)
)
_NAME = "tk AS (SELECT m.repo_id, m.layer, m.name, string_split(m.name, '_')[1] AS tok FROM mem m), top AS (SELECT repo_id, layer, tok, n, total FROM (SELECT repo_id, layer, tok, count(*) AS n, sum(count(*)) OVER (PARTITION BY repo_id, layer) AS total, row_number() OVER (PARTITION BY repo_id, layer ORDER BY count(*) DESC, tok) AS k FROM tk GROUP BY 1, 2, 3) WHERE k = 1), seg AS (SELECT repo_id, layer, count(DISTINCT name) AS d, count(*) AS n FROM tk GROUP BY 1, 2)"
on_graph(
    "naming_prefix",
    "SELECT s.repo_id, s.layer, CASE WHEN s.d::DOUBLE / s.n < 0.3 AND s.d <= 5 THEN '{source}' ELSE '{entity}' END AS pattern, round_even(CASE WHEN s.n < 5 THEN least(0.6, 0.7) ELSE 0.7 END, 2)::DOUBLE AS confidence, s.n AS matching_count, s.n AS total_count FROM seg s JOIN top t ON s.repo_id = t.repo_id AND s.layer = t.layer WHERE t.n::DOUBLE / t.total < 0.7",
    ctes=f"{FLOW}, {_LAY}, {_NAME}",
)(lambda g: conventions.naming_patterns(conventions.layer_members(g)))
on_graph("conventions_by_layer")(lambda g: conventions.get_conventions(g.having(conventions=conventions.infer_conventions(g))))
on_graph("suggest_placement")(lambda g: similarity.suggest_placement(g.having(conventions=conventions.infer_conventions(g)), ["p43", "p3", "p51"], "orders"))

# --- status
on_graph(
    "index_status_repos",
    "SELECT r.name, r.repo_type, coalesce(f.n, 0) AS files, coalesce(n.n, 0) AS nodes FROM repos r LEFT JOIN (SELECT repo_id, count(*) AS n FROM files GROUP BY 1) f ON r.repo_id = f.repo_id LEFT JOIN (SELECT f.repo_id, count(*) AS n FROM nodes n JOIN files f ON n.file_id = f.file_id GROUP BY 1) n ON r.repo_id = n.repo_id",
)(catalog.status_repos)
_XREPO = "xr AS (SELECT e.* FROM flow e JOIN files a ON e.src_file = a.file_id JOIN files b ON e.tgt_file = b.file_id WHERE a.repo_id <> b.repo_id), col AS (SELECT name, string_agg(DISTINCT repo, ',' ORDER BY repo) AS repos, count(DISTINCT repo) AS n_repos FROM loc WHERE repo IS NOT NULL AND kind NOT IN ('cte', 'subquery') GROUP BY 1 HAVING count(DISTINCT repo) > 1)"
on_graph("index_totals", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE file_id IS NULL) AS phantoms, (SELECT count(*) FROM repos) AS repos, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM column_usage) AS column_usage, (SELECT count(*) FROM column_lineage) AS column_lineage, (SELECT count(*) FROM xr) AS cross_repo_edges, (SELECT count(*) FROM col) AS name_collisions", ctes=f"{FLOW}, {_XREPO}")(
    catalog.status_totals
)
on_graph("cross_repo_edges", "SELECT source_id, target_id, relationship FROM xr", ctes=f"{FLOW}, {_XREPO}")(lambda g: catalog.cross_repo_edges(g).select("source_id", "target_id", "relationship"))
on_graph("name_collisions", "SELECT name, repos, n_repos FROM col", ctes=f"{FLOW}, {_XREPO}")(catalog.name_collisions)


# --- maintenance
def _wanted(g: Graph) -> DataFrame:
    return g.nodes.select(F.col("node_id").alias("key"), "name", F.when(F.col("node_id") % 2 == 0, "table").otherwise("query").alias("kind"), (F.col("node_id") % 5).alias("repo_id"), F.lit(None).cast("string").alias("schema"))


on_graph(
    "resolve_node_ranked",
    f"SELECT key, node_id, step FROM (SELECT w.key, l.node_id, CASE WHEN l.repo_id = w.repo_id AND l.kind = w.kind THEN 1 WHEN l.kind = w.kind THEN 2 WHEN l.repo_id = w.repo_id THEN 3 ELSE 4 END AS step, row_number() OVER (PARTITION BY w.key ORDER BY CASE WHEN l.repo_id = w.repo_id AND l.kind = w.kind THEN 1 WHEN l.kind = w.kind THEN 2 WHEN l.repo_id = w.repo_id THEN 3 ELSE 4 END, {RANK.replace('kind WHEN', 'l.kind WHEN', 1)}, l.node_id) AS k FROM (SELECT node_id AS key, name, CASE WHEN node_id % 2 = 0 THEN 'table' ELSE 'query' END AS kind, node_id % 5 AS repo_id FROM nodes) w JOIN loc l ON w.name = l.name WHERE l.kind = w.kind OR l.file_id IS NOT NULL) WHERE k = 1",
)(lambda g: maintenance.resolve_nodes(g, _wanted(g)))
_PH = "mv AS (SELECT p.node_id AS old, min(r.node_id) AS new FROM nodes p JOIN nodes r ON p.name = r.name AND p.kind = r.kind WHERE p.file_id IS NULL AND r.file_id IS NOT NULL GROUP BY 1), ne AS (SELECT coalesce(a.new, e.source_id) AS source_id, coalesce(b.new, e.target_id) AS target_id, e.relationship FROM edges e LEFT JOIN mv a ON e.source_id = a.old LEFT JOIN mv b ON e.target_id = b.old), nn AS (SELECT n.node_id, n.file_id IS NULL AS phantom FROM nodes n WHERE n.node_id NOT IN (SELECT old FROM mv) AND (n.file_id IS NOT NULL OR n.node_id IN (SELECT source_id FROM ne UNION SELECT target_id FROM ne)))"
on_graph("phantom_cleanup_nodes", "SELECT node_id, phantom FROM nn", ctes=f"{FLOW}, {_PH}")(lambda g: maintenance.cleanup_phantoms(g).nodes.select("node_id", F.col("file_id").isNull().alias("phantom")))
on_graph("phantom_cleanup_edges", "SELECT source_id, target_id, relationship FROM ne", ctes=f"{FLOW}, {_PH}")(lambda g: maintenance.cleanup_phantoms(g).edges.select("source_id", "target_id", "relationship"))


_STUB = f"n2 AS (SELECT n.node_id, n.name, n.kind, f.repo_id FROM nodes n JOIN files f ON n.file_id = f.file_id), sm AS (SELECT old, new FROM (SELECT s.node_id AS old, d.node_id AS new, row_number() OVER (PARTITION BY s.node_id ORDER BY {RANK.replace('kind WHEN', 'd.kind WHEN', 1)}, d.node_id) AS k FROM n2 s JOIN n2 d ON s.name = d.name AND s.repo_id = d.repo_id WHERE s.kind = 'table' AND d.kind <> 'table') WHERE k = 1), se AS (SELECT DISTINCT coalesce(a.new, e.source_id) AS source_id, coalesce(b.new, e.target_id) AS target_id, e.relationship FROM edges e LEFT JOIN sm a ON e.source_id = a.old LEFT JOIN sm b ON e.target_id = b.old)"
on_graph("stub_merge_edges", "SELECT source_id, target_id, relationship FROM se", ctes=f"{FLOW}, {_STUB}")(lambda g: maintenance.merge_duplicate_nodes(g).edges.select("source_id", "target_id", "relationship"))
on_graph("stub_merge_nodes", "SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT old FROM sm)", ctes=f"{FLOW}, {_STUB}")(lambda g: maintenance.merge_duplicate_nodes(g).nodes.select("node_id"))
_DEL = "gone AS (SELECT node_id, file_id FROM nodes WHERE file_id % 4 = 1), keep AS (SELECT DISTINCT g.node_id FROM gone g JOIN edges e ON e.target_id = g.node_id JOIN nodes s ON e.source_id = s.node_id WHERE s.file_id IS NULL OR s.file_id <> g.file_id)"
on_graph("file_delete_nodes", "SELECT n.node_id, coalesce(CASE WHEN k.node_id IS NULL THEN n.file_id END, -1) AS file_id FROM nodes n LEFT JOIN keep k ON n.node_id = k.node_id WHERE n.node_id NOT IN (SELECT node_id FROM gone) OR k.node_id IS NOT NULL", ctes=f"{FLOW}, {_DEL}")(
    lambda g: maintenance.delete_files(g, g.files.filter("file_id % 4 = 1")).nodes.select("node_id", F.coalesce("file_id", F.lit(-1)).alias("file_id"))
)
on_graph("file_delete_edges", "SELECT source_id, target_id, relationship FROM edges WHERE source_id NOT IN (SELECT node_id FROM gone) AND (target_id NOT IN (SELECT node_id FROM gone) OR target_id IN (SELECT node_id FROM keep))", ctes=f"{FLOW}, {_DEL}")(
    lambda g: maintenance.delete_files(g, g.files.filter("file_id % 4 = 1")).edges.select("source_id", "target_id", "relationship")
)
on_graph("repo_delete_counts", "SELECT (SELECT count(*) FROM files WHERE repo_id <> 2) AS files, (SELECT count(*) FROM loc WHERE repo_id IS DISTINCT FROM 2) AS nodes, (SELECT count(*) FROM flow e LEFT JOIN files a ON e.src_file = a.file_id LEFT JOIN files b ON e.tgt_file = b.file_id WHERE a.repo_id IS DISTINCT FROM 2 AND b.repo_id IS DISTINCT FROM 2) AS edges")(
    lambda g: _counts(maintenance.delete_repo(g, "asia"))
)


def _counts(g: Graph) -> DataFrame:
    return g.files.agg(F.count("*").alias("files")).crossJoin(g.nodes.agg(F.count("*").alias("nodes"))).crossJoin(g.edges.agg(F.count("*").alias("edges")))


on_graph(
    "columns_upsert",
    "SELECT node_id, column_name, CASE WHEN node_id % 2 = 0 AND position = 2 THEN 'BIGINT' ELSE data_type END AS data_type, CASE WHEN node_id % 2 = 0 AND position = 2 THEN 9 ELSE position END AS position FROM columns",
)(
    lambda g: maintenance.upsert_columns(
        g.columns, g.columns.filter("node_id % 2 = 0 AND position = 2").withColumns({"data_type": F.lit("BIGINT"), "position": F.lit(9).cast("long")})
    ).select("node_id", "column_name", "data_type", "position")
)


# --- scans and streams
def _docs_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("source").alias("repo"), F.concat(F.lit("models/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".sql")).alias("path"), "text", F.sha2("text", 256).alias("checksum"), "doc_id")


query("checksum_scan", "SELECT source AS repo, 'models/' || lang || '/' || doc_id || '.sql' AS path, sha256(text) AS checksum FROM documents", raw=True)(lambda s, d: _docs_as_files(s, d).select("repo", "path", "checksum"))
query("jinja_skip", "SELECT page_id, contains(html, '{{') OR contains(html, '{%') AS template FROM pages", raw=True)(lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", scan.has_jinja(F.col("html")).alias("template")))
query(
    "incremental_diff",
    "WITH a AS (SELECT doc_id, source AS repo, 'models/' || lang || '/' || doc_id || '.sql' AS path FROM documents) SELECT repo, path, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 5 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM a WHERE (doc_id % 7 = 0) <> (doc_id % 5 = 0) OR (doc_id % 7 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 = 0)",
    raw=True,
)(
    lambda s, d: scan.incremental_diff(
        _docs_as_files(s, d).filter("doc_id % 7 <> 0"),
        _docs_as_files(s, d).filter("doc_id % 5 <> 0").withColumn("checksum", F.when(F.col("doc_id") % 3 == 0, "new").otherwise(F.col("checksum"))),
    )
)
query(
    "dialect_resolution",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'snowflake' WHEN suffix(CAST(doc_id AS VARCHAR), '7') THEN 'bigquery' ELSE 'spark' END AS dialect FROM documents",
    raw=True,
)(lambda s, d: scan.resolve_dialect(_docs_as_files(s, d), [("models/fr/", "snowflake"), ("models/*7.sql", "bigquery")], "spark").select("doc_id", "dialect"))
query(
    "repo_resolution",
    "SELECT url AS path, CASE WHEN starts_with(url, 'http://') AND contains(url, '.net/fr/') THEN 'fr' WHEN starts_with(url, 'http://') THEN 'plain' END AS repo FROM (SELECT DISTINCT regexp_replace(url, '^(https?)://[^/]*', '\\1://x.net') AS url FROM pages) WHERE starts_with(url, 'http://')",
    raw=True,
)(
    lambda s, d: scan.resolve_repos(
        s.read.parquet(f"{d}/pages.parquet").select(F.regexp_replace("url", "^(https?)://[^/]*", "$1://x.net").alias("path")).distinct(), s.createDataFrame([("http:/", "plain"), ("http://x.net/fr", "fr")], "root string, name string")
    ).select("path", "repo")
)
query("layer_extraction", "SELECT file_id, split_part(path, '/', 2) AS layer FROM files", ctes=FLOW)(lambda s, d: derived(s, d).files.select("file_id", layer_of().alias("layer")))
query(
    "column_naming_styles",
    "SELECT name, CASE WHEN name = upper(name) AND contains(name, '_') THEN 'SCREAMING_SNAKE' WHEN name = lower(name) AND contains(name, '_') THEN 'snake_case' WHEN regexp_matches(name, '^[a-z]') AND regexp_matches(name, '[A-Z]') THEN 'camelCase' WHEN regexp_matches(name, '^[A-Z]') AND regexp_matches(name, '[a-z]') THEN 'PascalCase' END AS style FROM (SELECT DISTINCT p_type AS name FROM part UNION SELECT DISTINCT event_type FROM events UNION SELECT DISTINCT p_brand FROM part)",
    raw=True,
)(
    lambda s, d: s.read.parquet(f"{d}/part.parquet")
    .select(F.col("p_type").alias("name"))
    .union(s.read.parquet(f"{d}/events.parquet").select("event_type"))
    .union(s.read.parquet(f"{d}/part.parquet").select("p_brand"))
    .distinct()
    .select("name", column_style("name").alias("style"))
)
query(
    "debounce_sessions",
    "WITH e AS (SELECT CAST(user_id % 5 AS BIGINT) AS repo, ts, event_type || user_id AS path FROM events), m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY repo ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY repo ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT repo, min(ts) AS started, max(ts) AS ended, count(*) AS n_events, count(DISTINCT path) AS n_paths FROM s GROUP BY repo, k",
    raw=True,
)(lambda s, d: sessions(s.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 5).alias("repo"), "ts", F.concat("event_type", F.col("user_id").cast("string")).alias("path"))).select("repo", "started", "ended", "n_events", F.size("paths").cast("long").alias("n_paths")))


# --- SQL analysis, over statements made from the tables
def _sql_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SQL file a supplier: a model over another supplier's, with a common table expression and a window."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 7).alias("m"), F.col("s_nationkey").alias("n"))
    text = F.concat(
        F.lit("WITH base AS (SELECT o.id, CAST(o.amount AS DOUBLE) AS amt FROM src_"), F.col("m").cast("string"), F.lit(" o WHERE o.status = 'ok')\nSELECT b.id, b.amt, ROW_NUMBER() OVER (PARTITION BY b.id ORDER BY b.amt) AS rn FROM base b JOIN dim_"), F.col("n").cast("string"), F.lit(" d ON b.id = d.id"),
    )
    return s.select(F.lit("r").alias("repo"), F.concat(F.lit("models/model_"), F.col("k").cast("string"), F.lit(".sql")).alias("path"), text.alias("text"))


_FILES = "WITH f AS (SELECT 'model_' || s_suppkey AS stem, 'src_' || (s_suppkey % 7) AS src, 'dim_' || s_nationkey AS dim, 'models/model_' || s_suppkey || '.sql' AS path FROM supplier) "
query(
    "sql_parse_nodes",
    _FILES + "SELECT path, kind, name FROM (SELECT path, 'table' AS kind, src AS name FROM f UNION ALL SELECT path, 'table', dim FROM f UNION ALL SELECT path, 'cte', 'base' FROM f UNION ALL SELECT path, 'query', stem FROM f)",
    raw=True,
)(lambda s, d: parse_files(_sql_files(s, d)).select("path", F.explode("nodes").alias("n")).select("path", "n.kind", "n.name"))
query(
    "sql_parse_edges",
    _FILES
    + "SELECT path, stem AS source_name, src AS target_name, 'references' AS relationship, 'FROM clause' AS context FROM f UNION ALL SELECT path, stem, dim, 'references', 'JOIN clause' FROM f UNION ALL SELECT path, 'base', src, 'cte_references', 'FROM clause' FROM f",
    raw=True,
)(lambda s, d: parse_files(_sql_files(s, d)).select("path", F.explode("edges").alias("e")).select("path", "e.source_name", "e.target_name", "e.relationship", "e.context"))
query(
    "sql_column_usage",
    _FILES
    + "SELECT path, u.* FROM f, LATERAL (VALUES (src, 'id', 'select', 'base'), (src, 'amount', 'select', 'base'), (src, 'status', 'where', 'base'), ('base', 'id', 'select', stem), ('base', 'amt', 'select', stem), ('base', 'id', 'partition_by', stem), ('base', 'amt', 'window_order', stem), ('base', 'id', 'join_on', stem), (dim, 'id', 'join_on', stem)) u(table_name, column_name, usage_type, node_name)",
    raw=True,
)(lambda s, d: parse_files(_sql_files(s, d)).select("path", F.explode("column_usage").alias("u")).select("path", "u.table_name", "u.column_name", "u.usage_type", "u.node_name"))
query(
    "sql_column_lineage",
    _FILES
    + "SELECT path, u.* FROM f, LATERAL (VALUES ('id', stem || '.id <- base.id <- ' || src || '.id'), ('amt', stem || '.amt <- base.amt <- ' || src || '.amount'), ('rn', stem || '.rn <- base.id <- ' || src || '.id'), ('rn', stem || '.rn <- base.amt <- ' || src || '.amount')) u(output_column, chain)",
    raw=True,
)(
    lambda s, d: parse_files(_sql_files(s, d))
    .select("path", F.explode("column_lineage").alias("l"))
    .select("path", "l.output_column", F.array_join(F.transform("l.chain", lambda h: F.concat_ws(".", h["table"], h["column"])), " <- ").alias("chain"))
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
