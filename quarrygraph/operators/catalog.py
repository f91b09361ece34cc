"""Flat lookups over the graph: search, references, column usage, lineage, schema, context, tags, status.

Every page is taken in a total order, so equal inputs give equal pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import dataflow, noise
from quarrygraph.graph import Graph


#: Fixed value.
SCHEMA_VERSION = "1.0"


def _page(df: DataFrame, order: list, limit: int | None, offset: int) -> DataFrame:
    """Without a limit all rows from the offset on."""
    rest = df.orderBy(*order).offset(offset)
    return rest if limit is None else rest.limit(limit)


def _with_total(page: DataFrame, whole: DataFrame) -> DataFrame:
    """The page with the number of all matches; the count is one row."""
    return page.crossJoin(F.broadcast(whole.agg(F.count("*").alias("total_count"))))


def search(g: Graph, pattern: str, kind: str | None = None, schema: str | None = None, repo: str | None = None, language: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Nodes whose name holds ``pattern`` in any case, phantoms included; ``% _ \\`` are ordinary characters."""
    found = g.located().filter(F.lower("name").contains(pattern.lower()))
    for column, value in (("kind", kind), ("schema", schema), ("repo", repo), ("language", language)):
        if value is not None:
            found = found.filter(F.col(column) == value)
    shown = found.select("node_id", "name", "kind", "schema", "language", "repo", "path")
    return _with_total(_page(shown, ["name", "kind", "node_id"], limit, offset), shown)


def find_references(g: Graph, name: str, kind: str | None = None, schema: str | None = None, direction: str = "inbound", limit: int = 100, offset: int = 0) -> DataFrame:
    """Dataflow edges in or out of all nodes of that name, without noise; ``both`` gives either side."""
    start = g.nodes.filter(F.col("name") == name)
    for column, value in (("kind", kind), ("schema", schema)):
        if value is not None:
            start = start.filter(F.col(column) == value)
    start = start.select(F.col("node_id").alias("start_id"))
    flow = g.ends().filter(dataflow())
    where = g.located().select(F.col("node_id").alias("other_id"), "path", "repo")

    def side(own: str, other: str, prefix: str, label: str) -> DataFrame:
        hit = flow.join(start, F.col(own) == F.col("start_id"), "left_semi")
        hit = hit.select(F.col(other).alias("other_id"), F.col(f"{prefix}_name").alias("name"), F.col(f"{prefix}_kind").alias("kind"), "relationship", "context")
        return hit.filter(~noise()).join(where, "other_id", "left").withColumn("direction", F.lit(label))

    sides = []
    if direction in ("inbound", "both"):
        sides.append(side("target_id", "source_id", "src", "inbound"))
    if direction in ("outbound", "both"):
        sides.append(side("source_id", "target_id", "tgt", "outbound"))
    found = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    found = found.select("direction", F.col("other_id").alias("node_id"), "name", "kind", "relationship", "context", "repo", "path")
    return _page(found, ["direction", "name", "kind", "node_id", "relationship", "context"], limit, offset)


def _usage(g: Graph, table: str, column: str | None, usage_type: str | None, repo: str | None) -> DataFrame:
    found = g.column_usage.filter(F.col("table_name") == table)
    if column is not None:
        found = found.filter(F.col("column_name") == column)
    if usage_type is not None:
        found = found.filter(F.col("usage_type") == usage_type)
    nodes = g.nodes.select("node_id", F.col("name").alias("node_name"), F.col("kind").alias("node_kind"))
    files = g.files.select("file_id", "path", "repo_id")
    repos = g.repos.select("repo_id", F.col("name").alias("repo"))
    found = found.join(nodes, "node_id").join(files, "file_id").join(repos, "repo_id")
    return found.filter(F.col("repo") == repo) if repo is not None else found


def find_column_usage(g: Graph, table: str, column: str | None = None, usage_type: str | None = None, repo: str | None = None, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Uses of a table's columns, a page of them or, without a limit, all."""
    found = _usage(g, table, column, usage_type, repo).select("table_name", "column_name", "usage_type", "node_id", "node_name", "node_kind", "repo", "path", "alias", "transform")
    return _with_total(_page(found, ["table_name", "column_name", "usage_type", "node_id", "transform", "alias"], limit, offset), found)


def column_usage_summary(page: DataFrame) -> DataFrame:
    """Usage types of one page."""
    return page.groupBy("usage_type").agg(F.count("*").alias("n"))


def trace_column_lineage(g: Graph, table: str | None = None, column: str | None = None, output_node: str | None = None, repo: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """All hops of the chains on one page of chains. Without any filter nothing is found."""
    rows = g.column_lineage
    if repo is not None:
        files = g.files.join(g.repos.filter(F.col("name") == repo).select("repo_id"), "repo_id", "left_semi")
        rows = rows.join(files, "file_id", "left_semi")
    hit: Column = F.lit(True)
    if output_node is not None:
        hit &= F.col("output_node") == output_node
    if column is not None:
        own = F.col("output_column") == column
        hit &= own if output_node is not None else own | (F.col("hop_column") == column)
    if table is not None:
        hit &= F.col("hop_table") == table
    if table is None and column is None and output_node is None:
        hit = F.lit(False)
    key = ["output_node", "output_column", "chain_index"]
    chains = _page(rows.filter(hit).select(*key).distinct(), key, limit, offset)
    return rows.join(chains, key, "left_semi").select(*key, "hop_index", "hop_column", "hop_table", "hop_expression").orderBy(*key, "hop_index")


def lineage_chains(hops: DataFrame) -> DataFrame:
    """One row a chain: its hops from output to source."""
    steps = F.array_sort(F.collect_list(F.struct("hop_index", "hop_table", "hop_column")))
    path = F.array_join(F.transform(steps, lambda x: F.concat_ws(".", x["hop_table"], x["hop_column"])), " <- ")
    return hops.groupBy("output_node", "output_column", "chain_index").agg(path.alias("chain"), F.count("*").alias("hops"))


def pick_node(g: Graph, name: str, repo: str | None = None) -> DataFrame:
    """The real node of that name with the largest id, and how many there are."""
    found = g.located().filter((F.col("name") == name) & F.col("file_id").isNotNull())
    if repo is not None:
        found = found.filter(F.col("repo") == repo)
    return found.agg(F.max_by(F.struct("node_id", "name", "kind", "schema", "repo", "path"), "node_id").alias("n"), F.count("*").alias("matches")).filter("matches > 0").select("n.*", "matches")


def schema_columns(g: Graph, name: str, repo: str | None = None) -> DataFrame:
    node = pick_node(g, name, repo).select("node_id")
    rows = g.columns.join(F.broadcast(node), "node_id", "left_semi")  # one row
    return rows.select("node_id", "column_name", F.coalesce("data_type", F.lit("UNKNOWN")).alias("data_type"), "position", "description").orderBy("position", "column_name")


def schema_neighbours(g: Graph, name: str, repo: str | None = None) -> DataFrame:
    """Distinct (side, name, kind) around the node, over edges of every relationship: what it reads is upstream."""
    node = F.broadcast(pick_node(g, name, repo).select(F.col("node_id").alias("own")))  # one row
    e = g.ends()
    up = e.join(node, F.col("source_id") == F.col("own"), "left_semi").select(F.lit("upstream").alias("side"), F.col("tgt_name").alias("name"), F.col("tgt_kind").alias("kind"))
    down = e.join(node, F.col("target_id") == F.col("own"), "left_semi").select(F.lit("downstream").alias("side"), F.col("src_name").alias("name"), F.col("src_kind").alias("kind"))
    return up.unionByName(down).distinct()


def _context_usage(g: Graph, name: str, repo: str | None) -> DataFrame:
    used = g.column_usage.filter(F.col("table_name") == name)
    if repo is not None:
        nodes = g.located().filter(F.col("repo") == repo).select("node_id")
        used = used.join(nodes, "node_id", "left_semi")
    return used


def context_top_columns(g: Graph, name: str, repo: str | None = None, top: int = 10) -> DataFrame:
    """The most used columns of a model, with the number of uses by type."""
    counts = _context_usage(g, name, repo).groupBy("column_name", "usage_type").agg(F.count("*").alias("n"))
    by = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "usage_type", F.col("n").cast("string")))), ",")
    return counts.groupBy("column_name").agg(F.sum("n").alias("total"), by.alias("by_type")).orderBy(F.desc("total"), "column_name").limit(top)


def context_keys(g: Graph, name: str, repo: str | None = None) -> DataFrame:
    """Columns that consumers join on, and those they group or partition by."""
    used = _context_usage(g, name, repo)
    role = F.when(F.col("usage_type") == "join_on", "join").when(F.col("usage_type").isin("group_by", "partition_by"), "group")
    return used.select(role.alias("role"), "column_name").filter("role IS NOT NULL").distinct()


def model_of_file(g: Graph, repo: str, path: str) -> DataFrame:
    """The first table or view of a stored file, by kind and name."""
    at = g.located().filter((F.col("repo") == repo) & (F.col("path") == path) & F.col("kind").isin("table", "view"))
    return at.select("node_id", "name", "kind").orderBy("kind", "name", "node_id").limit(1)


def get_context(g: Graph, name: str, repo: str | None = None, files: DataFrame | None = None, rank: bool = False) -> DataFrame:
    """One row about a model: model, columns, upstream, downstream, most_used_columns, join_keys, aggregations,
    downstream_count, the first 30 lines of its file where ``files`` (repo, path, text) are given, and its
    PageRank where ``rank`` is asked for. No row: there is no such node. Each part is of one model or a page."""
    node = pick_node(g, name, repo)
    model = node.select(F.struct("node_id", "name", "kind", "schema", "repo", "path").alias("model"), "node_id", F.col("repo").alias("of_repo"), F.col("path").alias("of_path"))
    columns = schema_columns(g, name, repo).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name", "data_type", "description"))), lambda c: F.struct(c["column_name"].alias("column_name"), c["data_type"].alias("data_type"), c["position"].alias("position"), c["description"].alias("description"))).alias("columns"))
    near = schema_neighbours(g, name, repo)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("name", "kind")))).alias(s)
    near = near.agg(side("upstream"), side("downstream"))
    used = context_top_columns(g, name, repo).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("total")).alias("minus"), "column_name"))), lambda c: c["column_name"]).alias("most_used_columns"))
    role = lambda r: F.array_sort(F.collect_list(F.when(F.col("role") == r, F.col("column_name"))))
    keys = context_keys(g, name, repo).agg(role("join").alias("join_keys"), role("group").alias("aggregations"))
    out = model
    for part in (columns, near, used, keys):
        out = out.crossJoin(F.broadcast(part))  # one row each
    out = out.withColumn("downstream_count", F.size("downstream"))
    if files is not None:
        head = files.select(F.col("repo").alias("of_repo"), F.col("path").alias("of_path"), F.when(F.octet_length("text") <= 1_000_000, F.array_join(F.slice(F.split("text", "\n", -1), 1, 30), "\n")).alias("snippet"))
        out = out.join(head, ["of_repo", "of_path"], "left")
    else:
        out = out.withColumn("snippet", F.lit(None).cast("string"))
    if rank:
        from quarrygraph.operators.centrality import pagerank

        out = out.join(pagerank(g).select("node_id", F.round("rank", 6).alias("importance")), "node_id", "left")
    else:
        out = out.withColumn("importance", F.lit(None).cast("double"))
    return out.select("model", "columns", "upstream", "downstream", "most_used_columns", "join_keys", "aggregations", "downstream_count", "snippet", "importance")


def index_status(g: Graph, report: DataFrame | None = None) -> DataFrame:
    """One row: schema_version, repos, totals, state, and of the last reindex's ``report`` the number of files with
    errors and the first 50 of them by repo and path."""
    repos = status_repos(g).agg(F.array_sort(F.collect_list(F.struct("name", "repo_type", "files", "nodes"))).alias("repos"))
    totals = status_totals(g)
    out = repos.crossJoin(F.broadcast(totals.select(F.struct(*totals.columns).alias("totals")))).withColumn("schema_version", F.lit(SCHEMA_VERSION))
    if report is None:
        empty = F.array().cast("array<struct<repo:string,path:string,errors:string>>")
        return out.withColumns({"state": F.lit("idle"), "parse_error_count": F.lit(0).cast("long"), "last_parse_errors": empty})
    bad = report.filter("n_errors > 0").select("repo", "path", "errors")
    first = bad.orderBy("repo", "path").limit(50).agg(F.array_sort(F.collect_list(F.struct("repo", "path", "errors"))).alias("last_parse_errors"))
    return out.withColumn("state", F.lit("completed")).crossJoin(F.broadcast(bad.agg(F.count("*").alias("parse_error_count")))).crossJoin(F.broadcast(first))


def search_by_tag(g: Graph, tag: str, repo: str | None = None, min_confidence: float | None = None) -> DataFrame:
    tags = g.semantic_tags.filter(F.col("tag_name") == tag)
    if min_confidence is not None:
        tags = tags.filter(F.col("confidence") >= min_confidence)
    found = tags.select("tag_name", "node_id", "confidence").join(g.located().select("node_id", "name", "kind", "repo", "path"), "node_id")
    if repo is not None:
        found = found.filter(F.col("repo") == repo)
    return found.orderBy(F.desc("confidence"), "name", "node_id")


def list_tags(g: Graph, repo: str | None = None) -> DataFrame:
    tags = g.semantic_tags
    if repo is not None:
        tags = tags.join(g.repos.filter(F.col("name") == repo).select("repo_id"), "repo_id", "left_semi")
    return tags.groupBy("tag_name").agg(F.count("*").alias("model_count"), F.round(F.avg("confidence"), 4).alias("avg_confidence")).orderBy(F.desc("model_count"), "tag_name")


def status_repos(g: Graph) -> DataFrame:
    files = g.files.groupBy("repo_id").agg(F.countDistinct("file_id").alias("files"))
    nodes = g.nodes.join(g.files.select("file_id", "repo_id"), "file_id").groupBy("repo_id").agg(F.countDistinct("node_id").alias("nodes"))
    out = g.repos.select("repo_id", "name", "repo_type").join(files, "repo_id", "left").join(nodes, "repo_id", "left")
    return out.select("name", "repo_type", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def cross_repo_edges(g: Graph) -> DataFrame:
    """Edges between files of different repos."""
    files = g.files.select("file_id", "repo_id")
    e = g.ends().join(files.withColumnsRenamed({"file_id": "src_file", "repo_id": "src_repo"}), "src_file").join(files.withColumnsRenamed({"file_id": "tgt_file", "repo_id": "tgt_repo"}), "tgt_file")
    return e.filter("src_repo <> tgt_repo")


def name_collisions(g: Graph) -> DataFrame:
    """Names of real tables, views and queries that several repos hold."""
    real = g.located().filter(F.col("repo").isNotNull() & ~F.col("kind").isin("cte", "subquery"))
    return real.groupBy("name").agg(F.sort_array(F.collect_set("repo")).alias("r")).filter(F.size("r") > 1).select("name", F.array_join("r", ",").alias("repos"), F.size("r").cast("long").alias("n_repos"))


def status_totals(g: Graph) -> DataFrame:
    """One row of totals."""
    counts = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("file_id").isNull()).alias("phantoms"))
    for name, df in (("repos", g.repos), ("files", g.files), ("edges", g.edges), ("column_usage", g.column_usage), ("column_lineage", g.column_lineage), ("cross_repo_edges", cross_repo_edges(g)), ("name_collisions", name_collisions(g))):
        counts = counts.crossJoin(df.agg(F.count("*").alias(name)))  # one row each
    return counts


def snippets(files: DataFrame, spans: DataFrame, context: int = 2, most: int = 20) -> DataFrame:
    """Numbered source lines of (repo, path, line_start, line_end) from (repo, path, text); texts over 1 MB have none."""
    small = files.filter(F.octet_length("text") <= 1_000_000)
    first = F.greatest(F.col("line_start") - context, F.lit(1))
    last = F.least(F.coalesce("line_end", F.col("line_start")) + context, first + most - 1)
    lines = F.split("text", "\n", -1)
    wanted = F.slice(lines, first.cast("int"), F.greatest(F.lit(0), F.least(last, F.size(lines)) - first + 1).cast("int"))
    shown = F.transform(wanted, lambda x, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(" | "), x))
    return spans.filter("line_start IS NOT NULL").join(small, ["repo", "path"]).select("repo", "path", "line_start", F.array_join(shown, "\n").alias("snippet"))


def schema_catalog(g: Graph, own_repo: str | None = None) -> DataFrame:
    """(table_name, column_name, data_type): declared columns first, then used ones as TEXT. With ``own_repo``
    that repo's entries overlay those of its siblings."""
    at = g.located().filter(F.col("file_id").isNotNull()).select("node_id", F.col("name").alias("table_name"), "repo")
    declared = g.columns.join(at, "node_id").select("table_name", "column_name", F.coalesce("data_type", F.lit("TEXT")).alias("data_type"), "repo", F.lit(0).alias("rank"), "node_id")
    files = g.files.join(g.repos.select("repo_id", F.col("name").alias("repo")), "repo_id").select("file_id", "repo")
    used = g.column_usage.filter("column_name <> '*'").join(files, "file_id").select("table_name", "column_name", F.lit("TEXT").alias("data_type"), "repo", F.lit(1).alias("rank"), F.col("node_id"))
    rows = declared.unionByName(used)
    own = F.when(F.col("repo") == own_repo, 0).otherwise(1) if own_repo else F.lit(0)
    best = Window.partitionBy("table_name", "column_name").orderBy(own, "rank", "node_id", "data_type")
    return rows.withColumn("r", F.row_number().over(best)).filter("r = 1").select("table_name", "column_name", "data_type")
