"""Effects of changes: column changes of one model, and structural differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import dataflow, noise
from quarrygraph.graph import Graph
from quarrygraph.operators.traversal import _name_edges, reach, trace
from quarrygraph.runtime import materialise
from quarrygraph.schema import BREAKING, WARNING

ACTIONS = ("remove_column", "rename_column", "add_column")


def downstream_models(g: Graph, model: str, repo: str | None = None) -> DataFrame:
    """Distinct (name, kind) of the sources of dataflow edges into the model."""
    own = g.located().filter(F.col("name") == model)
    if repo is not None:
        own = own.filter(F.col("repo") == repo)
    ids = own.select(F.col("node_id").alias("target_id"))
    hit = g.ends().filter(dataflow()).join(ids, "target_id", "left_semi")
    return hit.select(F.col("src_name").alias("name"), F.col("src_kind").alias("kind")).filter(~noise()).distinct()


def check_impact(g: Graph, model: str, changes: list[dict], repo: str | None = None) -> DataFrame:
    """(change, column_name, name, severity, usages) of each consumer.

    A consumer is breaking if it selects, joins on or inserts the column, else a warning if it uses it in
    another clause; models downstream of which neither is true are safe. Added columns are always safe.
    Unknown actions are one row of severity ``skipped``.
    """
    spark = g.spark
    down = downstream_models(g, model, repo).select("name").distinct()
    listed = [(k, c.get("action", ""), c.get("column") or c.get("old") or "") for k, c in enumerate(changes)]
    plan = spark.createDataFrame(listed, "ord int, action string, column_name string")  # the caller's list
    used = g.column_usage.filter(F.col("table_name") == model).join(g.nodes.select("node_id", "name"), "node_id").select("name", "column_name", "usage_type")
    lossy = F.broadcast(plan.filter(F.col("action").isin("remove_column", "rename_column")))
    breaking, warning = F.col("usage_type").isin(BREAKING), F.col("usage_type").isin(WARNING)
    hit = used.join(lossy, "column_name").groupBy("ord", "action", "column_name", "name").agg(
        F.when(F.bool_or(breaking), "breaking").when(F.bool_or(warning), "warning").alias("severity"),
        F.array_join(F.array_sort(F.collect_set("usage_type")), ",").alias("usages"),
    )
    hit = hit.filter("severity IS NOT NULL")
    known = F.broadcast(plan.filter(F.col("action").isin(*ACTIONS)))
    safe = down.crossJoin(known).join(hit.select("ord", "name"), ["ord", "name"], "left_anti")  # the caller's few changes
    # A consumer with a use of no known class is neither affected nor safe.
    other = used.join(lossy, "column_name").select("ord", "name")
    safe = safe.join(other, ["ord", "name"], "left_anti").select("ord", "action", "column_name", "name", F.lit("safe").alias("severity"), F.lit("").alias("usages"))
    skipped = plan.filter(~F.col("action").isin(*ACTIONS)).select("ord", "action", "column_name", F.lit(None).cast("string").alias("name"), F.lit("skipped").alias("severity"), F.lit("").alias("usages"))
    rows = hit.select("ord", "action", "column_name", "name", "severity", "usages").unionByName(safe).unionByName(skipped)
    return rows.select("ord", F.concat_ws(" ", "action", "column_name").alias("change"), "name", "severity", "usages").orderBy("ord", "severity", "name")


def node_keys(g: Graph) -> DataFrame:
    return g.nodes.select("name", "kind", F.coalesce("schema", F.lit("")).alias("schema")).distinct()


def edge_keys(g: Graph) -> DataFrame:
    e = g.ends()
    return e.select("src_name", "src_kind", "tgt_name", "tgt_kind", "relationship").distinct()


def usage_keys(g: Graph) -> DataFrame:
    at = g.nodes.select("node_id", F.col("name").alias("node_name"))
    return g.column_usage.join(at, "node_id").select("node_name", "table_name", "column_name", "usage_type").distinct()


_KEYS = {"nodes": node_keys, "edges": edge_keys, "columns": usage_keys}


def structural_diff(base: Graph, head: Graph, what: str = "nodes") -> DataFrame:
    """(change, ...): keys that only the head (added) or only the base (removed) has."""
    b, h = _KEYS[what](base), _KEYS[what](head)
    added, removed = h.join(b, h.columns, "left_anti"), b.join(h, b.columns, "left_anti")
    return added.select(F.lit("added").alias("change"), *h.columns).unionByName(removed.select(F.lit("removed").alias("change"), *b.columns))


def nodes_modified(base: Graph, head: Graph) -> DataFrame:
    """Names of nodes in both snapshots whose outgoing edges, column uses or metadata differ."""
    shared = node_keys(base).join(node_keys(head), ["name", "kind", "schema"], "left_semi")
    edges = structural_diff(base, head, "edges").select(F.col("src_name").alias("name"))
    columns = structural_diff(base, head, "columns").select(F.col("node_name").alias("name"))
    keys = lambda g: g.nodes.select("name", "kind", F.coalesce("schema", F.lit("")).alias("schema"), F.coalesce("metadata", F.lit("")).alias("metadata")).distinct()
    b, h = keys(base), keys(head)
    meta = h.join(b, h.columns, "left_anti").unionByName(b.join(h, b.columns, "left_anti"))
    meta = meta.join(shared, ["name", "kind", "schema"], "left_semi").select("name")
    return shared.select("name").distinct().join(edges.unionByName(columns).unionByName(meta).distinct(), "name", "left_semi")


def changed_names(base: Graph, head: Graph, limit: int = 20) -> DataFrame:
    """The first ``limit`` names, in order, of added, removed or modified nodes."""
    names = structural_diff(base, head, "nodes").select("name").unionByName(nodes_modified(base, head))
    return names.distinct().orderBy("name").limit(limit)


def pr_impact(base: Graph, head: Graph, depth: int = 3, mode: str = "delta", limit: int = 20) -> DataFrame:
    """(name, status) of the models that the changed ones lead to.

    ``absolute`` lists all that they reach in the head. ``delta`` compares with the head without its new
    edges: ``newly_affected``, ``no_longer_affected`` or ``unchanged``. All changed names walk together.
    """
    roots = changed_names(base, head, limit).select(F.col("name").alias("root"))

    def walk(exclude: DataFrame | None) -> DataFrame:
        edges = materialise(_name_edges(head, "downstream", exclude), "name-edges")
        first = edges.filter(~F.col("here_kind").isin("cte", "subquery")).join(roots, edges["here"] == roots["root"]).select("root", F.col("hop").alias("name"), "relationship", "context")
        return reach(edges, first, depth).select("name").distinct()

    after = walk(None)
    if mode == "absolute":
        return after.select("name", F.lit("affected").alias("status"))
    new = structural_diff(base, head, "edges").filter("change = 'added'").select(F.col("src_name").alias("source_name"), F.col("tgt_name").alias("target_name")).distinct()
    before = walk(new)
    both = after.withColumn("a", F.lit(True)).join(before.withColumn("b", F.lit(True)), "name", "full")
    status = F.when(F.col("b").isNull(), "newly_affected").when(F.col("a").isNull(), "no_longer_affected").otherwise("unchanged")
    return both.select("name", status.alias("status"))


__all__ = ["changed_names", "check_impact", "downstream_models", "nodes_modified", "pr_impact", "structural_diff", "trace"]
