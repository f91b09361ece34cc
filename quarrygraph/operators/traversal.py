"""Walks over the dependency graph: traces, shortest paths and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import dataflow, kind_rank, noise
from quarrygraph.graph import Graph
from quarrygraph.runtime import materialise
from quarrygraph.schema import QUERY_LOCAL



def representatives(g: Graph) -> DataFrame:
    """One node a name: real before phantom, then by kind, then by id."""
    best = Window.partitionBy("name").orderBy(F.col("file_id").isNull(), kind_rank(), "node_id")
    at = g.located().withColumn("r", F.row_number().over(best)).filter("r = 1")
    return at.select("name", "kind", "language", "path", "repo", "line_start", "line_end")


def start_nodes(g: Graph, name: str, kind: str | None = None) -> DataFrame:
    """Nodes that a walk from ``name`` may start at, best first; query-local ones only if there is no other."""
    found = g.nodes.filter(F.col("name") == name)
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    else:
        local = F.col("kind").isin(QUERY_LOCAL)
        some = found.agg(F.coalesce(F.bool_or(~local), F.lit(False)).alias("some"))  # one row
        found = found.crossJoin(F.broadcast(some)).filter(~local | ~F.col("some")).drop("some")
    return found.select("node_id", "name", "kind", kind_rank().alias("rank")).orderBy("rank", "node_id").drop("rank")


def _name_edges(g: Graph, direction: str, exclude: DataFrame | None) -> DataFrame:
    """Dataflow edges between names as (here, here_kind, hop, relationship, context)."""
    flow = g.ends().filter(dataflow())
    if exclude is not None:
        flow = flow.join(exclude, (flow["src_name"] == exclude["source_name"]) & (flow["tgt_name"] == exclude["target_name"]), "left_anti")
    here, hop = ("src", "tgt") if direction == "downstream" else ("tgt", "src")
    return flow.select(F.col(f"{here}_name").alias("here"), F.col(f"{here}_kind").alias("here_kind"), F.col(f"{hop}_name").alias("hop"), "relationship", "context").distinct()


def reach(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(root, name, depth, relationship, context): every name that a walk reaches, at its least depth.

    ``edges`` has here, hop, relationship, context; ``starts`` has root and the first hops as name,
    relationship, context. One join a level against the names not seen yet: the shortest walk to a name
    never repeats one, so this equals enumerating paths without their number.
    """
    pick = F.min(F.struct(F.coalesce("relationship", F.lit("")).alias("relationship"), F.coalesce("context", F.lit("")).alias("context"))).alias("m")
    level = starts.filter("name <> root").groupBy("root", "name").agg(pick).select("root", "name", F.lit(1).alias("depth"), "m.relationship", "m.context")
    seen = level = materialise(level, "trace")
    for depth in range(2, max_depth + 1):
        if level.isEmpty():
            break
        nxt = level.select("root", F.col("name").alias("here")).join(edges.select("here", F.col("hop").alias("name"), "relationship", "context"), "here").filter("name <> root")
        nxt = nxt.join(seen.select("root", "name"), ["root", "name"], "left_anti")
        level = nxt.groupBy("root", "name").agg(pick).select("root", "name", F.lit(depth).alias("depth"), "m.relationship", "m.context")
        level = materialise(level, "trace")
        seen = seen.unionByName(level)
    return seen


def trace(g: Graph, name: str, kind: str | None = None, direction: str = "downstream", max_depth: int = 3, limit: int = 100, exclude: DataFrame | None = None) -> DataFrame:
    """(direction, name, kind, depth, relationship, context, repo, path) of what depends on ``name`` or what it
    depends on, over names: nodes of one name in several repos are one hop.

    ``downstream`` follows edges from source to target, ``upstream`` against them, ``both`` does both. The kind
    restricts only the start. ``exclude`` holds (source_name, target_name) pairs that are not followed.
    Twice the limit is taken before noise is dropped, so noise rarely costs places.
    """
    if direction == "both":
        return trace(g, name, kind, "downstream", max_depth, limit, exclude).unionByName(trace(g, name, kind, "upstream", max_depth, limit, exclude))
    depth = max(1, min(max_depth, 10))
    edges = materialise(_name_edges(g, direction, exclude), "name-edges")  # every level joins them
    kinds = start_nodes(g, name, kind).select(F.col("kind").alias("here_kind")).distinct()
    first = edges.filter(F.col("here") == name).join(F.broadcast(kinds), "here_kind", "left_semi")  # a few kinds
    found = reach(edges, first.select(F.col("here").alias("root"), F.col("hop").alias("name"), "relationship", "context"), depth)
    rows = found.join(representatives(g), "name", "left")
    rows = rows.orderBy("depth", "name", F.coalesce("repo", F.lit(""))).limit(2 * limit).filter(~noise())
    rows = rows.select(F.lit(direction).alias("direction"), "name", "kind", "depth", "relationship", "context", "repo", "path")
    return rows.orderBy("depth", "name").limit(limit)


def depth_summary(paths: DataFrame) -> DataFrame:
    return paths.groupBy("depth").agg(F.count("*").alias("n"))


def repos_affected(paths: DataFrame) -> DataFrame:
    return paths.filter("repo IS NOT NULL").select("repo").distinct().orderBy("repo")


def find_path(g: Graph, source: str, target: str, max_hops: int = 5) -> DataFrame:
    """(path, length) of the shortest directed path between the first nodes of two names, over dataflow edges,
    that repeats no name; of several the least by names. No row: there is none. A cycle back to the same name
    counts as a path of length 0.
    """
    flow = g.ends().filter(dataflow()).select("source_id", "target_id", "tgt_name").distinct()
    ends = g.nodes.filter(F.col("name").isin(source, target)).groupBy("name").agg(F.min("node_id").alias("node_id"))
    first = ends.filter(F.col("name") == source).select("node_id", F.array("name").alias("path"))
    goal = F.broadcast(ends.filter(F.col("name") == target).select(F.col("node_id").alias("goal")))  # one row
    if source == target:
        level = first.select("node_id", F.lit(0).alias("steps"))
        seen = level.select("node_id")
        for _ in range(max_hops):
            level = materialise(level.join(flow, level["node_id"] == flow["source_id"]).select(F.col("target_id").alias("node_id")).distinct(), "path")
            if not level.join(goal, level["node_id"] == F.col("goal")).isEmpty():
                return first.select(F.lit(source).alias("path"), F.lit(0).alias("length"))
            level = level.join(seen, "node_id", "left_anti")
            seen = seen.unionByName(level).distinct()
        return first.filter(F.lit(False)).select(F.lit(source).alias("path"), F.lit(0).alias("length"))
    level = first
    for hops in range(1, max_hops + 1):
        nxt = level.join(flow, level["node_id"] == flow["source_id"]).filter(~F.array_contains("path", F.col("tgt_name")))
        # Of the paths that meet in a node with the same names in any order, one is enough.
        nxt = nxt.select(F.col("target_id").alias("node_id"), F.array_append("path", F.col("tgt_name")).alias("path"))
        nxt = nxt.groupBy("node_id", F.array_sort("path").alias("names")).agg(F.min("path").alias("path")).select("node_id", "path")
        level = materialise(nxt, "path")
        hit = level.join(goal, level["node_id"] == F.col("goal"))
        if hops == max_hops or not hit.isEmpty() or level.isEmpty():
            break
    return hit.select(F.array_join("path", " -> ").alias("path"), (F.size("path") - 1).alias("length")).orderBy("path").limit(1)


def _on_cycles(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Without edges that no cycle can hold: again and again those go whose source nothing leads to or whose target
    leads nowhere, until none is left or ``rounds`` are over (then some may stay, which cost only time)."""
    edges = materialise(edges, "cycle-edges")
    left = edges.count()
    for _ in range(rounds):
        into, out = edges.select(F.col("target_id").alias("source_id")).distinct(), edges.select(F.col("source_id").alias("target_id")).distinct()
        edges = materialise(edges.join(into, "source_id", "left_semi").join(out, "target_id", "left_semi").select("source_id", "target_id"), "cycle-edges")
        now = edges.count()
        if now == left:
            break
        left = now
    return edges


def detect_cycles(g: Graph, repo: str | None = None, max_length: int = 10, limit: int | None = None) -> DataFrame:
    """(length, path) of each simple cycle of 2 to ``max_length`` edges of any relationship, once.

    A cycle is walked only from its smallest node, through larger ones, so no rotation is made or has to be
    dropped. A cycle belongs to ``repo`` if one of its nodes does.
    """
    edges = g.edges.filter("source_id <> target_id").select("source_id", "target_id").distinct()
    if repo is not None:
        inside = g.located().filter(F.col("repo") == repo).select("node_id")
        edges_in = edges.join(inside, edges["source_id"] == inside["node_id"], "left_semi")
        edges = edges_in.join(inside, edges_in["target_id"] == inside["node_id"], "left_semi")
    edges = _on_cycles(edges)
    paths = edges.filter("target_id > source_id").select(F.col("source_id").alias("start"), F.col("target_id").alias("at"), F.array("source_id", "target_id").alias("nodes"))
    found = None
    for length in range(2, max_length + 1):
        paths = materialise(paths, "cycles")
        if paths.isEmpty():
            break
        closed = paths.join(edges, (paths["at"] == edges["source_id"]) & (paths["start"] == edges["target_id"]), "left_semi").select(F.lit(length).alias("length"), "nodes")
        found = closed if found is None else found.unionByName(closed)
        step = paths.join(edges, paths["at"] == edges["source_id"]).filter((F.col("target_id") > F.col("start")) & ~F.array_contains("nodes", F.col("target_id")))
        paths = step.select("start", F.col("target_id").alias("at"), F.array_append("nodes", F.col("target_id")).alias("nodes"))
    if found is None:
        found = paths.select(F.lit(0).alias("length"), "nodes").filter(F.lit(False))
    names = g.nodes.select("node_id", "name")
    spelled = found.select("length", "nodes", F.posexplode("nodes").alias("pos", "node_id")).join(names, "node_id")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " -> ")
    out = spelled.groupBy("length", "nodes").agg(path.alias("path")).select("length", F.array_join("nodes", ",").alias("node_ids"), "path").orderBy("length", "node_ids")
    return out.limit(limit) if limit is not None else out
