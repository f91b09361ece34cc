"""Keeping the stored graph: merging, deleting, resolving. Every operator returns new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import kind_rank
from quarrygraph.graph import Graph
from quarrygraph.runtime import materialise


def upsert_repos(g: Graph, repos: DataFrame) -> Graph:
    """Repos by name: known ones keep their id and take the new path and type, others get the next ids."""
    old = g.repos
    known = repos.select("name", F.col("path").alias("new_path"), F.col("repo_type").alias("new_type"))
    kept = old.join(known, "name", "left").withColumn("path", F.coalesce("new_path", "path")).withColumn("repo_type", F.coalesce("new_type", "repo_type"))
    top = old.agg(F.coalesce(F.max("repo_id"), F.lit(0)).alias("top"))  # one row
    fresh = repos.join(old.select("name"), "name", "left_anti").crossJoin(F.broadcast(top))
    fresh = fresh.withColumn("repo_id", F.col("top") + F.row_number().over(Window.orderBy("name")))  # a repo is a project
    return g.having(repos=kept.drop("new_path", "new_type").unionByName(fresh.drop("top"), allowMissingColumns=True))


def delete_repo(g: Graph, name: str) -> Graph:
    """Without the repo, its files and all that hangs on them; conventions and tags stay."""
    repo = g.repos.filter(F.col("name") == name).select("repo_id")
    files = g.files.join(repo, "repo_id", "left_semi").select("file_id")
    nodes = g.nodes.join(files, "file_id", "left_semi").select("node_id")
    source, target = nodes.withColumnRenamed("node_id", "source_id"), nodes.withColumnRenamed("node_id", "target_id")
    return g.having(
        repos=g.repos.filter(F.col("name") != name),
        files=g.files.join(repo, "repo_id", "left_anti"),
        nodes=g.nodes.join(files, "file_id", "left_anti"),
        edges=g.edges.join(source, "source_id", "left_anti").join(target, "target_id", "left_anti"),
        column_usage=g.column_usage.join(files, "file_id", "left_anti"),
        column_lineage=g.column_lineage.join(files, "file_id", "left_anti"),
        columns=g.columns.join(nodes, "node_id", "left_anti"),
        rendered_cache=g.rendered_cache.join(repo, "repo_id", "left_anti"),
    )


def delete_files(g: Graph, files: DataFrame) -> Graph:
    """Without the files (by ``file_id``); their nodes that edges of other files lead to stay as phantoms."""
    gone = files.select("file_id").distinct()
    mine = g.nodes.join(gone, "file_id", "left_semi").select("node_id", F.col("file_id").alias("own"))
    owner = g.nodes.select(F.col("node_id").alias("source_id"), F.col("file_id").alias("src_file"))
    into = g.edges.join(mine.withColumnRenamed("node_id", "target_id"), "target_id").join(owner, "source_id")
    keep = into.filter(F.col("src_file").isNull() | (F.col("src_file") != F.col("own"))).select(F.col("target_id").alias("node_id")).distinct()
    # Of the edges into kept nodes, those from deleted files go with their source.
    ids = mine.select("node_id")
    dropped = ids.join(keep, "node_id", "left_anti")
    edges = g.edges.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(dropped.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    nodes = g.nodes.join(dropped, "node_id", "left_anti").join(keep.withColumn("lost", F.lit(True)), "node_id", "left")
    for c in ("file_id", "line_start", "line_end"):
        nodes = nodes.withColumn(c, F.when(F.col("lost").isNull(), F.col(c)))
    return g.having(
        files=g.files.join(gone, "file_id", "left_anti"), nodes=nodes, edges=edges, columns=g.columns.join(ids, "node_id", "left_anti"),
        column_usage=g.column_usage.join(gone, "file_id", "left_anti"), column_lineage=g.column_lineage.join(gone, "file_id", "left_anti"),
    )


def repoint(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """Edges with both ends replaced by ``moves`` (old, new)."""
    s, t = moves.select(F.col("old").alias("source_id"), F.col("new").alias("s")), moves.select(F.col("old").alias("target_id"), F.col("new").alias("t"))
    out = edges.join(s, "source_id", "left").join(t, "target_id", "left")
    return out.withColumn("source_id", F.coalesce("s", "source_id")).withColumn("target_id", F.coalesce("t", "target_id")).drop("s", "t")


def phantom_moves(g: Graph) -> DataFrame:
    """(old, new): phantoms and the first real node of the same name, kind and schema."""
    key = ["name", "kind", "schema"]
    n = g.nodes.withColumn("schema", F.coalesce("schema", F.lit("")))
    real = n.filter(F.col("file_id").isNotNull()).groupBy(*key).agg(F.min("node_id").alias("new"))
    return n.filter(F.col("file_id").isNull()).select(F.col("node_id").alias("old"), *key).join(real, key).select("old", "new")


def cleanup_phantoms(g: Graph) -> Graph:
    """Phantoms with a real counterpart are replaced by it; then phantoms without edges go. Where nothing can be
    replaced, phantoms that only phantoms lead to go as well."""
    moves = phantom_moves(g)
    nodes = g.nodes.join(moves.select(F.col("old").alias("node_id")), "node_id", "left_anti")
    edges = repoint(g.edges, moves)
    used = edges.select(F.col("source_id").alias("node_id")).unionByName(edges.select(F.col("target_id").alias("node_id"))).distinct()
    phantom = nodes.filter(F.col("file_id").isNull()).select("node_id")
    drop = phantom.join(used, "node_id", "left_anti")
    if moves.isEmpty():
        real = nodes.filter(F.col("file_id").isNotNull()).select(F.col("node_id").alias("source_id"))
        into = edges.select("source_id", F.col("target_id").alias("node_id"))
        stale = phantom.join(into, "node_id", "left_semi").join(into.join(real, "source_id", "left_semi"), "node_id", "left_anti")
        drop = drop.unionByName(stale).distinct()
        edges = edges.join(drop.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(drop.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return g.having(nodes=nodes.join(drop, "node_id", "left_anti"), edges=edges)


def stub_moves(g: Graph) -> DataFrame:
    """(old, new): table nodes that only record a reference, and the defining node of their name in the repo;
    of several the first by kind and id."""
    n = g.nodes.join(g.files.select("file_id", "repo_id"), "file_id").select("repo_id", "name", "node_id", "kind", "schema")
    stub, made = n.filter("kind = 'table'"), n.filter("kind <> 'table'")
    pair = stub.select("repo_id", "name", F.col("node_id").alias("old"), F.col("schema").alias("s1")).join(made.select("repo_id", "name", F.col("node_id").alias("new"), "kind", F.col("schema").alias("s2")), ["repo_id", "name"])
    pair = pair.filter(F.col("s1").isNull() | F.col("s2").isNull() | (F.col("s1") == F.col("s2")))
    best = Window.partitionBy("old").orderBy(kind_rank(), "new")
    return pair.withColumn("r", F.row_number().over(best)).filter("r = 1").select("old", "new")


def merge_duplicate_nodes(g: Graph) -> Graph:
    """Stubs are replaced by their definitions, and edges that become equal are one."""
    moves = stub_moves(g)
    edges = repoint(g.edges, moves).groupBy("source_id", "target_id", "relationship").agg(F.min("context").alias("context"), F.min("metadata").alias("metadata"))
    return g.having(edges=edges, nodes=g.nodes.join(moves.select(F.col("old").alias("node_id")), "node_id", "left_anti"))


def resolve_nodes(g: Graph, wanted: DataFrame, same_repo_only: bool = False) -> DataFrame:
    """``wanted`` (key, name, kind, repo_id, schema) with the node each name means, as (key, node_id).

    In order: same name and kind in the repo, anywhere, then any kind in the repo, then any real node. A given
    schema has to match. Within a step the wanted kind, then the kind's rank, then the id decides.

    The best node of each step is found once for all that ask for the same, so a name that many nodes have is
    never met by every key that asks for it.
    """
    n = g.nodes.join(g.files.select("file_id", F.col("repo_id").alias("own_repo")), "file_id", "left").filter(F.col("name").isNotNull())
    n = n.groupBy("name", F.col("kind").alias("own_kind"), F.col("schema").alias("own_schema"), "own_repo", F.col("file_id").isNotNull().alias("real")).agg(F.min("node_id").alias("node_id"))
    # once for keys without a schema, once for those that name its own; "given" is never null
    given = F.explode(F.when(F.col("own_schema").isNull(), F.array(F.lit("any"))).otherwise(F.array(F.lit("any"), F.concat(F.lit("="), "own_schema"))))
    n = materialise(n.select("name", "own_kind", "own_repo", "real", "node_id", given.alias("given")), "resolve")
    asked = wanted.filter(F.col("name").isNotNull()).select("key", "name", "kind", "repo_id", F.coalesce(F.concat(F.lit("="), "schema"), F.lit("any")).alias("given"))
    asked = materialise(asked, "resolve")
    ask = asked.select("name", "kind", "repo_id", "given").distinct()

    rank = kind_rank("own_kind")
    other = F.when(F.col("own_kind").isNull(), 2).otherwise(1)  # of another kind, of none
    exact = F.min(F.struct(F.lit(0).alias("like"), rank.alias("rank"), "node_id"))
    loose = [F.min(F.struct(other.alias("like"), rank.alias("rank"), "node_id")).alias("told"), F.min(F.struct(F.lit(2).alias("like"), rank.alias("rank"), "node_id")).alias("untold")]  # for keys with a kind, without
    n = n.withColumn("kind", F.col("own_kind")).withColumn("repo_id", F.col("own_repo"))

    def best(step: int, key: list[str], *found: Column) -> DataFrame:
        """Equal joins drop the nodes without a kind or repo where these are in the key."""
        rows = (n.filter("real") if step == 4 else n).groupBy("name", "given", *key).agg(*found)
        pick = F.when(F.col("kind").isNull(), F.col("untold")).otherwise(F.col("told")) if len(found) > 1 else F.col("told")
        return ask.join(rows, ["name", "given", *key]).select("name", "kind", "repo_id", "given", F.struct(F.lit(step).alias("step"), pick["like"].alias("like"), pick["rank"].alias("rank"), pick["node_id"].alias("node_id")).alias("best"))

    steps = [best(1, ["kind", "repo_id"], exact.alias("told")), best(3, ["repo_id"], *loose)]
    if not same_repo_only:
        steps += [best(2, ["kind"], exact.alias("told")), best(4, [], *loose)]
    found = steps[0]
    for more in steps[1:]:
        found = found.unionByName(more)
    found = found.groupBy("name", "kind", "repo_id", "given").agg(F.min("best").alias("best"))
    a, b = asked.alias("a"), found.alias("b")
    met = a.join(b, (F.col("a.name") == F.col("b.name")) & (F.col("a.given") == F.col("b.given")) & F.col("a.kind").eqNullSafe(F.col("b.kind")) & F.col("a.repo_id").eqNullSafe(F.col("b.repo_id")))
    return met.groupBy("a.key").agg(F.min("b.best").alias("best")).select("key", "best.node_id", "best.step")


def upsert_columns(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row a (node_id, column_name): new values before stored ones, but never a null over a value; the
    source is the new row's."""
    key = ["node_id", "column_name"]
    a = stored.select(*key, *[F.col(c).alias(f"a_{c}") for c in ("data_type", "position", "source", "description")])
    b = new.select(*key, *[F.col(c).alias(f"b_{c}") for c in ("data_type", "position", "source", "description")])
    return a.join(b, key, "full").select(*key, *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in ("data_type", "position", "source", "description")])


def upsert_tags(stored: DataFrame, new: DataFrame) -> DataFrame:
    key = ["repo_id", "tag_name", "node_id"]
    return new.unionByName(stored.join(new, key, "left_anti"))


def replace_rendered(stored: DataFrame, repo_id: int, new: DataFrame) -> DataFrame:
    """The cache with all models of one repo replaced."""
    return stored.filter(F.col("repo_id") != repo_id).unionByName(new)
