"""From SQL files to the stored graph, all repos and files at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.graph import Graph
from quarrygraph.operators.catalog import schema_catalog
from quarrygraph.operators.maintenance import cleanup_phantoms, delete_files, merge_duplicate_nodes, replace_rendered, resolve_nodes, upsert_columns, upsert_repos
from quarrygraph.plans.analyse import parse_files
from quarrygraph.runtime import materialise
from quarrygraph.sources import projects
from quarrygraph.sources.scan import file_stem, has_jinja, incremental_diff, is_sql, resolve_repos

#: Fixed value: the file that holds the sources of a dbt project's schema files.
SOURCES_FILE = "__schema_yml_sources__.sql"


def _numbered(df: DataFrame, column: str, top: DataFrame, *order: str) -> DataFrame:
    """``df`` with dense ids after the one in ``top`` (one row). Each partition counts its own rows, so nothing
    is sorted in one place."""
    from pyspark.sql import functions as F

    rows = materialise(df.withColumn("part__", F.spark_partition_id()), "numbered")
    sizes = rows.groupBy("part__").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base__", F.coalesce(F.sum("n").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part__", "base__")  # one row a partition
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*order))
    return rows.join(F.broadcast(before), "part__").crossJoin(F.broadcast(top)).withColumn(column, (F.col("top") + F.col("base__") + own).cast("long")).drop("part__", "base__", "top")


def _top(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("top"))


_KEPT = ("conventions", "semantic_tags", "rendered_cache")


def _settled(g: Graph, before: Graph | None = None) -> Graph:
    """The graph with every table written once that is not the one of ``before``, so later steps do not plan
    earlier ones again and tables that a step left alone are not copied."""
    old = before.tables if before is not None else {}
    return g.having(**{k: materialise(v, k) for k, v in g.tables.items() if k not in _KEPT and v is not old.get(k)})


def _replaced(g: Graph, stale: DataFrame, new: DataFrame, parsed: DataFrame, infer: bool) -> tuple[Graph, DataFrame]:
    """The graph without the ``stale`` files (file_id) and with ``new`` ones (repo, repo_id, path, checksum) and what
    they say (``parsed``), and the report of ``reindex``. Other files and repos are left alone; nodes that others
    still use stay as phantoms and meet their definitions again."""
    stale = materialise(stale, "stale")
    if not stale.isEmpty():
        g = _settled(delete_files(g, stale), g)
    files = _numbered(new.select("repo", "repo_id", "path", "checksum"), "file_id", _top(g.files, "file_id"), "repo", "path")
    files = materialise(files.withColumns({"language": F.lit("sql"), "indexed_at": F.current_timestamp()}), "files")
    parsed = materialise(parsed.join(files.select("repo", "path", "repo_id", "file_id"), ["repo", "path"]), "parsed")
    old = g
    repos = g.repos.join(files.select("repo_id").distinct().withColumn("touched", F.lit(True)), "repo_id", "left").withColumn("indexed_at", F.when(F.col("touched"), F.current_timestamp()).otherwise(F.col("indexed_at")))
    g = g.having(files=g.files.unionByName(files.select("file_id", "repo_id", "path", "language", "checksum", "indexed_at"), allowMissingColumns=True), repos=repos)
    g, dropped = insert_parsed(g, parsed)
    dropped = materialise(dropped, "dropped")
    g = _settled(g, old)
    g = _settled(cleanup_phantoms(g), g)
    g = _settled(merge_duplicate_nodes(g), g)
    if infer:
        from quarrygraph.operators.conventions import infer_conventions, merge_conventions
        from quarrygraph.operators.similarity import infer_tags

        g = g.having(conventions=materialise(merge_conventions(g.conventions, infer_conventions(g)), "conventions"), semantic_tags=materialise(infer_tags(g, stored=g.semantic_tags), "tags"))
    report = parsed.select("repo", "path", F.size("errors").alias("n_errors"), F.array_join("errors", "; ").alias("errors")).join(dropped, ["repo", "path"], "left")
    return g, report.withColumn("dropped_usage", F.coalesce("dropped_usage", F.lit(0)))


def reindex(g: Graph, repos: DataFrame, scanned: DataFrame, catalog: DataFrame | None = None, infer: bool = True) -> tuple[Graph, DataFrame]:
    """The graph after the files (repo, path, text, checksum, and dialect if known) replaced what was stored of
    the same repos, and (repo, path, errors, dropped_usage) of the parsed files.

    Only added and changed files are parsed; templates are recorded but not parsed. Stored files that the scan
    does not hold are deleted: for a part of a repo's files there is ``reindex_files``.
    """
    g = _settled(upsert_repos(g, repos), g)
    named = g.repos.select("repo_id", F.col("name").alias("repo"))
    stored = g.files.join(named, "repo_id").join(repos.select(F.col("name").alias("repo")), "repo", "left_semi")
    diff = materialise(incremental_diff(stored, scanned), "diff")
    stale = stored.join(diff.filter("change <> 'added'"), ["repo", "path"], "left_semi").select("file_id")
    new = scanned.join(diff.filter("change <> 'deleted'"), ["repo", "path"], "left_semi").join(named, "repo")
    return _replaced(g, stale, new, parse_files(new.filter(~has_jinja(F.col("text"))), catalog), infer)


def reindex_files(g: Graph, paths: DataFrame, rendered: DataFrame | None = None, catalog: DataFrame | None = None, infer: bool = False) -> tuple[Graph, DataFrame]:
    """The graph after the named files alone were read again, and (path, repo, status, reason), one row a path.

    ``paths`` has absolute paths with the text of each, null where the file is gone. What is no SQL file or lies
    below no stored repo is skipped, as are texts that did not change. Of nested repos the deepest counts. Files
    of dbt and sqlmesh repos are models: ``rendered`` (repo, path, text) gives what they compile to, found by the
    file's stem, and they are skipped without it. All other files of a repo stay as they are.
    """
    given = paths.groupBy("path").agg(F.max("text").alias("text")).withColumn("checksum", F.sha2("text", 256))
    sql = given.filter(is_sql(F.col("path")))
    roots = g.repos.select(F.regexp_replace("path", "/+$", "").alias("root"), F.col("name").alias("repo"), "repo_id", "repo_type")
    at = resolve_repos(sql.select("path"), roots.select("root", F.col("repo").alias("name")))
    rows = sql.join(at, "path", "left").join(roots, "repo", "left").withColumn("own", F.expr("substring(path, length(root) + 2)"))
    plain = rows.filter("repo_type = 'sql'").select("path", "repo", "repo_id", F.col("own").alias("stored_path"), "text", "checksum")
    models = rows.filter("repo_type <> 'sql'").withColumn("stem", file_stem("path"))
    if rendered is not None:
        found = rendered.select("repo", F.col("path").alias("stored_path"), F.col("text").alias("made"), file_stem("path").alias("stem"))
        models = models.join(found, ["repo", "stem"], "left")
    else:
        models = models.withColumns({"stored_path": F.lit(None).cast("string"), "made": F.lit(None).cast("string")})
    known = g.files.join(g.repos.select("repo_id", F.col("name").alias("repo")), "repo_id").select("repo", F.col("path").alias("stored_path"), "file_id", F.col("checksum").alias("old"))
    cols = ["path", "repo", "repo_id", "stored_path", "text", "made"]
    by_stem = known.select(F.col("repo").alias("own_repo"), file_stem("stored_path").alias("own_stem"), F.col("stored_path").alias("found"))
    gone = models.filter("text IS NULL").join(by_stem, (F.col("repo") == F.col("own_repo")) & (F.col("stem") == F.col("own_stem")), "left").withColumn("stored_path", F.col("found"))
    models = models.filter("text IS NOT NULL").select(*cols).unionByName(gone.select(*cols))
    models = models.select("path", "repo", "repo_id", "stored_path", F.when(F.col("text").isNotNull(), F.col("made")).alias("text"), F.sha2(F.when(F.col("text").isNotNull(), F.col("made")), 256).alias("checksum"), (F.col("text").isNotNull() & F.col("made").isNull()).alias("bare"))
    rows = plain.withColumn("bare", F.lit(False)).unionByName(models).join(known, ["repo", "stored_path"], "left")
    rows = rows.withColumns({
        "status": F.when(F.col("bare"), "skipped").when(F.col("text").isNull(), "deleted").when(F.col("old") == F.col("checksum"), "skipped").otherwise("reindexed"),
        "reason": F.when(F.col("bare"), "not rendered").when(F.col("old") == F.col("checksum"), "unchanged"),
    })
    rows = materialise(rows.select("path", "repo", "repo_id", "stored_path", "text", "checksum", "file_id", "status", "reason"), "saved-files")
    stale = rows.filter("status IN ('deleted', 'reindexed') AND file_id IS NOT NULL").select("file_id").distinct()
    new = rows.filter("status = 'reindexed'").select("repo", "repo_id", F.col("stored_path").alias("path"), "text", "checksum").dropDuplicates(["repo", "path"])
    g, _ = _replaced(g, stale, new, parse_files(new.filter(~has_jinja(F.col("text"))), catalog), infer)
    skipped = given.join(rows.select("path"), "path", "left_anti").select("path", F.lit(None).cast("string").alias("repo"), F.lit("skipped").alias("status"), F.when(is_sql(F.col("path")), "no matching repo").otherwise("not a SQL file").alias("reason"))
    return g, rows.select("path", "repo", "status", "reason").unionByName(skipped)


def _enriched(parsed: DataFrame, key: str) -> DataFrame:
    """Parsed files whose nodes carry the model they came from, the file's path without its suffix, as metadata."""
    model = F.to_json(F.struct(F.regexp_replace("path", r"\.sql$", "").alias(key)))
    both = lambda old: F.when(old.isNull(), model).otherwise(F.concat(F.substring(old, 1, F.length(old) - 1), F.lit(", "), F.substring(model, 2, F.length(model))))
    return parsed.withColumn("nodes", F.transform("nodes", lambda n: n.withField("metadata", both(n["metadata"]))))


def _with_columns(parsed: DataFrame, defs: DataFrame) -> DataFrame:
    """Parsed files with the column definitions (path, ...) in place of their own."""
    fields = ["node_name", "column_name", "data_type", "position", "source", "description"]
    listed = defs.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("own"))
    kind = parsed.schema["columns"].dataType
    return parsed.drop("columns").join(listed, "path", "left").withColumn("columns", F.coalesce(F.col("own").cast(kind), F.array().cast(kind))).drop("own")


def reindex_dbt(g: Graph, name: str, path: str, compiled: DataFrame, manifest: DataFrame | None = None, documented: DataFrame | None = None, infer: bool = True, dialect: str | None = None) -> tuple[Graph, DataFrame]:
    """The graph after all compiled models (path, text) of a dbt project replaced what was stored of it.

    Stars are expanded by the manifest's types, then documented ones, then the graph's. References that the
    ``manifest`` (``read_manifest``) names become edges where the SQL does not show them. ``documented``
    (``schema_yml``) columns come before inferred ones and lend them types; documented sources become nodes of a
    file of their own. Nodes carry their model as metadata.
    """
    spark = g.spark
    g = _settled(upsert_repos(g, spark.createDataFrame([(name, path, "dbt")], "name string, path string, repo_type string")), g)
    repo = g.repos.filter(F.col("name") == name).select("repo_id", F.col("name").alias("repo"))
    files = projects.compiled_models(compiled.select(F.lit(name).alias("repo"), "path", "text", F.lit(dialect).alias("dialect")))
    typed = "table_name string, column_name string, data_type string"
    own = projects.manifest_columns(manifest) if manifest is not None else spark.createDataFrame([], typed)
    notes = documented if documented is not None else spark.createDataFrame([], "entity string, model string, column_name string, data_type string, position bigint, description string")
    known = projects.effective_schema(schema_catalog(g, name), notes.select(F.col("model").alias("table_name"), "column_name", "data_type"), own)
    parsed = _enriched(materialise(parse_files(files, known), "dbt-parsed"), "dbt_model")
    if manifest is not None:
        extra = projects.manifest_edges(manifest, name)
        record = F.struct("source_name", F.lit("table").alias("source_kind"), "source_schema", "target_name", F.lit("table").alias("target_kind"), F.lit(None).cast("string").alias("target_schema"), F.lit("references").alias("relationship"), "context")
        listed = extra.groupBy("path").agg(F.array_sort(F.collect_list(record)).alias("extra"))
        shown = lambda e: F.exists("edges", lambda x: (x["target_name"] == e["target_name"]) & x["relationship"].isin("references", "cte_references"))
        kind = parsed.schema["edges"].dataType
        parsed = parsed.join(listed, "path", "left").withColumn("edges", F.concat("edges", F.coalesce(F.filter("extra", lambda e: ~shown(e)).cast(kind), F.array().cast(kind)))).drop("extra")
    if documented is not None:
        inferred = parsed.select("path", F.explode("columns").alias("c")).select("path", F.col("c.node_name").alias("model"), "c.column_name", "c.data_type", "c.position", "c.source", "c.description")
        where = files.select("path", file_stem("path").alias("model")).distinct()
        merged = projects.merge_documented(inferred.drop("path"), notes.filter("entity = 'model'").join(where.select("model").distinct(), "model", "left_semi"))
        parsed = _with_columns(parsed, merged.join(where, "model").select("path", F.col("model").alias("node_name"), "column_name", "data_type", "position", "source", "description"))
        sources = notes.filter("entity = 'source'")
        node = F.struct(F.lit("source").alias("kind"), F.col("model").alias("name"), *[F.lit(None).alias(c) for c in ("schema", "line_start", "line_end", "metadata")])
        column = F.struct(F.col("model").alias("node_name"), "column_name", "data_type", "position", F.lit("schema_yml").alias("source"), "description")
        made = sources.agg(F.array_sort(F.collect_set(node)).alias("nodes"), F.array_sort(F.collect_list(column)).alias("columns")).filter(F.size("nodes") > 0)  # what the project's source files declare
        made = made.withColumns({"repo": F.lit(name), "path": F.lit(SOURCES_FILE)})
        types = {f.name: f.dataType for f in parsed.schema.fields}
        parsed = parsed.unionByName(made.select(*[(F.col(c) if c in made.columns else F.array()).cast(t).alias(c) for c, t in types.items()]))
    return _project(g, repo, parsed, infer)


def reindex_sqlmesh(g: Graph, name: str, path: str, rendered: DataFrame | None, fingerprint: str | None = None, dialect: str | None = None, infer: bool = True) -> tuple[Graph, DataFrame]:
    """The graph after the rendered models (``rendered_models``) of a sqlmesh project replaced what was stored of it.

    With the stored ``fingerprint`` of the sources (``source_fingerprint``), or without ``rendered``, the models
    of the cache are parsed again, since the graph's columns may expand more stars than before. Column types that
    the project gives come before inferred ones.
    """
    spark = g.spark
    g = _settled(upsert_repos(g, spark.createDataFrame([(name, path, "sqlmesh")], "name string, path string, repo_type string")), g)
    repo = g.repos.filter(F.col("name") == name).select("repo_id", F.col("name").alias("repo"), "source_fingerprint")
    row = repo.first()
    cached = g.rendered_cache.filter(F.col("repo_id") == row["repo_id"]).select("model_name", "rendered_sql", "column_schemas")
    if rendered is None or (fingerprint is not None and fingerprint == row["source_fingerprint"] and not cached.isEmpty()):
        rendered = cached
    rendered = materialise(rendered.select(F.lit(row["repo_id"]).alias("repo_id"), "model_name", "rendered_sql", "column_schemas"), "rendered")
    g = g.having(rendered_cache=materialise(replace_rendered(g.rendered_cache, row["repo_id"], rendered), "rendered-cache"))
    files = rendered.select(F.lit(name).alias("repo"), F.concat(projects.model_path("model_name"), F.lit(".sql")).alias("path"), F.col("rendered_sql").alias("text"), F.lit(dialect).alias("dialect"), "column_schemas")
    parsed = _enriched(materialise(parse_files(projects.compiled_models(files, deepest=True), schema_catalog(g, name)), "sqlmesh-parsed"), "sqlmesh_model")
    given = files.select("path", file_stem("path").alias("node_name"), F.posexplode(F.from_json("column_schemas", "map<string,string>")).alias("position", "column_name", "data_type"))
    given = given.select("path", "node_name", "column_name", "data_type", F.col("position").cast("bigint").alias("position"), F.lit("sqlmesh_schema").alias("source"), F.lit(None).cast("string").alias("description"))
    inferred = parsed.select("path", F.explode("columns").alias("c")).select("path", "c.*").join(given, ["path", "node_name", "column_name"], "left_anti")
    parsed = _with_columns(parsed, given.unionByName(inferred))
    g, report = _project(g, repo.select("repo_id", "repo"), parsed, infer)
    repos = g.repos.withColumn("source_fingerprint", F.when(F.col("name") == name, F.lit(fingerprint)).otherwise(F.col("source_fingerprint")))
    return g.having(repos=materialise(repos, "repos")), report


def _project(g: Graph, repo: DataFrame, parsed: DataFrame, infer: bool) -> tuple[Graph, DataFrame]:
    """All files of one repo replaced by parsed models; a file's checksum is that of what it says."""
    parsed = materialise(parsed, "models")
    new = result_checksum(parsed).crossJoin(F.broadcast(repo.select("repo_id")))  # one row
    stale = g.files.join(repo, "repo_id", "left_semi").select("file_id")
    return _replaced(g, stale, new, parsed, infer)


def insert_parsed(g: Graph, parsed: DataFrame) -> tuple[Graph, DataFrame]:
    """Records of parsed files put into the graph, and (repo, path, dropped_usage): uses whose node is unknown."""
    at = ["repo", "path", "repo_id", "file_id"]
    key = ["file_id", "name", "kind", F.coalesce("schema", F.lit(""))]
    nodes = parsed.select(*at, F.explode("nodes").alias("n")).select("file_id", "n.*")
    nodes = nodes.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("metadata").isNull(), "metadata"))).filter("r = 1").drop("r")
    nodes = _numbered(nodes, "node_id", _top(g.nodes, "node_id"), "file_id", "name", "kind").withColumn("language", F.lit("sql"))
    nodes = materialise(nodes, "new-nodes")
    g = g.having(nodes=g.nodes.unionByName(nodes, allowMissingColumns=True))
    mine = nodes.select("file_id", "name", "kind", "schema", "node_id")

    # edges: both ends are looked up together
    edges = parsed.select(*at, F.posexplode("edges").alias("pos", "e")).select("file_id", "repo_id", "pos", "e.*")
    edges = materialise(edges.withColumn("edge_key", F.concat_ws(":", "file_id", "pos")), "new-edges")
    ends = edges.select(F.concat("edge_key", F.lit(":s")).alias("key"), "file_id", "repo_id", F.col("source_name").alias("name"), F.col("source_kind").alias("kind"), F.col("source_schema").alias("schema"))
    ends = ends.unionByName(edges.select(F.concat("edge_key", F.lit(":t")).alias("key"), "file_id", "repo_id", F.col("target_name").alias("name"), F.col("target_kind").alias("kind"), F.col("target_schema").alias("schema")))
    local = ends.join(mine.withColumnRenamed("schema", "own_schema"), ["file_id", "name", "kind"])
    fit = F.when(F.col("own_schema").eqNullSafe(F.col("schema")), 0).when(F.col("own_schema").isNull(), 1)
    local = local.withColumn("fit", fit).filter("fit IS NOT NULL").groupBy("key").agg(F.min_by("node_id", F.struct("fit", "node_id")).alias("node_id"))
    # The file's own query that defines a model of the same name is that model.
    queries = ends.filter("kind = 'query'").join(local, "key", "left_anti").select("key", "file_id", "name")
    made_here = queries.join(mine.filter("kind IN ('table', 'view')").select("file_id", "name", "node_id"), ["file_id", "name"]).groupBy("key").agg(F.min("node_id").alias("node_id"))
    local = local.unionByName(made_here)
    far = ends.join(local, "key", "left_anti")
    found = resolve_nodes(g, far.select("key", "name", "kind", "repo_id", "schema")).select("key", "node_id")
    lost = far.join(found, "key", "left_anti")
    phantoms = _numbered(lost.select("name", "kind").distinct(), "node_id", _top(g.nodes, "node_id"), "name", "kind").withColumn("language", F.lit("sql"))
    phantoms = materialise(phantoms, "phantoms")
    made = lost.join(phantoms.select("name", "kind", "node_id"), ["name", "kind"]).select("key", "node_id")
    ids = materialise(local.unionByName(found).unionByName(made), "ends")
    g = g.having(nodes=g.nodes.unionByName(phantoms, allowMissingColumns=True))
    s = ids.select(F.regexp_extract("key", "^(.*):s$", 1).alias("edge_key"), F.col("node_id").alias("source_id")).filter("edge_key <> ''")
    t = ids.select(F.regexp_extract("key", "^(.*):t$", 1).alias("edge_key"), F.col("node_id").alias("target_id")).filter("edge_key <> ''")
    new_edges = edges.join(s, "edge_key").join(t, "edge_key").select("source_id", "target_id", "relationship", "context")

    # column usage
    usage = parsed.select(*at, F.posexplode("column_usage").alias("pos", "u")).select(*at, "pos", "u.*").withColumn("key", F.concat_ws(":", "file_id", "pos"))
    names = usage.select("file_id", "repo_id", "node_name", "node_kind").distinct()
    near = names.join(mine.select("file_id", F.col("name").alias("node_name"), F.col("kind").alias("node_kind"), "node_id"), ["file_id", "node_name", "node_kind"]).groupBy("file_id", "node_name", "node_kind").agg(F.min("node_id").alias("node_id"))
    rest = names.join(near, ["file_id", "node_name", "node_kind"], "left_anti").withColumn("key", F.to_json(F.struct("file_id", "node_name", "node_kind")))
    other = resolve_nodes(g, rest.select("key", F.col("node_name").alias("name"), F.col("node_kind").alias("kind"), "repo_id", F.lit(None).cast("string").alias("schema")))
    other = rest.join(other, "key").select("file_id", "node_name", "node_kind", "node_id")
    placed = usage.join(near.unionByName(other), ["file_id", "node_name", "node_kind"], "left")
    dropped = placed.filter("node_id IS NULL").groupBy("repo", "path").agg(F.count("*").alias("dropped_usage"))
    new_usage = placed.filter("node_id IS NOT NULL").select("node_id", "file_id", "table_name", "column_name", "usage_type", "alias", "transform")

    # lineage: chains are numbered within their output column
    chains = parsed.select("file_id", F.posexplode("column_lineage").alias("pos", "c")).select("file_id", "pos", "c.*")
    number = F.row_number().over(Window.partitionBy("file_id", "output_node", "output_column").orderBy("pos")) - 1
    hops = chains.withColumn("chain_index", number.cast("long")).select("file_id", "output_node", "output_column", "chain_index", F.posexplode("chain").alias("hop_index", "h"))
    hops = hops.select("file_id", "output_node", "output_column", "chain_index", F.col("hop_index").cast("long").alias("hop_index"), F.col("h.column").alias("hop_column"), F.col("h.table").alias("hop_table"), F.col("h.expression").alias("hop_expression"))

    # column definitions belong to a node of the same repo
    defs = parsed.select(*at, F.explode("columns").alias("d")).select(*at, "d.*")
    rank = F.when(F.col("kind") == "table", 0).when(F.col("kind") == "view", 1).when(F.col("kind") == "source", 2).otherwise(3)
    home = mine.filter(F.col("kind").isin("table", "view", "source", "query")).groupBy("file_id", F.col("name").alias("node_name")).agg(F.min_by("node_id", F.struct(rank, "node_id")).alias("node_id"))
    defs = defs.join(home, ["file_id", "node_name"]).groupBy("node_id", "column_name").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("data_type", "position", "source", "description")])
    return g.having(
        edges=g.edges.unionByName(new_edges, allowMissingColumns=True), column_usage=g.column_usage.unionByName(new_usage), column_lineage=g.column_lineage.unionByName(hops), columns=upsert_columns(g.columns, defs)
    ), dropped


def result_checksum(parsed: DataFrame) -> DataFrame:
    """(repo, path, checksum) of what files say, whatever the order of its records."""
    n = F.transform("nodes", lambda x: F.concat_ws(":", F.lit("N"), x["kind"], x["name"]))
    e = F.transform("edges", lambda x: F.concat_ws(":", F.lit("E"), x["source_name"], x["target_name"], x["relationship"]))
    u = F.transform("column_usage", lambda x: F.concat_ws(":", F.lit("U"), x["node_name"], x["table_name"], x["column_name"], x["usage_type"]))
    c = F.transform("columns", lambda x: F.concat_ws(":", F.lit("C"), x["node_name"], x["column_name"], x["data_type"], x["position"].cast("string"), x["source"]))
    hop = lambda h: F.concat_ws(".", h["table"], h["column"], h["expression"])
    lin = F.transform("column_lineage", lambda x: F.concat_ws(":", F.lit("L"), x["output_node"], x["output_column"], F.array_join(F.transform(x["chain"], hop), "|")))
    return parsed.select("repo", "path", F.sha2(F.array_join(F.array_sort(F.concat(n, e, u, c, lin)), "\n"), 256).alias("checksum"))
