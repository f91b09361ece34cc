"""Importance, components and bottlenecks of the dependency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import dataflow
from quarrygraph.graph import Graph
from quarrygraph.runtime import materialise


def pagerank(g: Graph, damping: float = 0.85, iterations: int = 20) -> DataFrame:
    """(node_id, rank) by power iteration; parallel edges count once and the rank of nodes without outgoing
    edges is spread evenly. The damping and the number of rounds are choices of this engine."""
    nodes = materialise(g.nodes.select("node_id"), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node_id", F.lit(0.0).alias("rank"))
    links = g.edges.select("source_id", "target_id").distinct()
    out = links.groupBy("source_id").agg(F.count("*").alias("out"))
    links = materialise(links.join(out, "source_id"), "rank-links")
    out = materialise(nodes.join(out, nodes["node_id"] == out["source_id"], "left").select("node_id", "out"), "rank-out")
    rank = out.select("node_id", "out", F.lit(1.0 / n).alias("rank"))
    for k in range(iterations):
        given = links.join(rank.select(F.col("node_id").alias("source_id"), "rank"), "source_id").groupBy("target_id").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))  # one row
        nxt = out.join(given, out["node_id"] == given["target_id"], "left").crossJoin(F.broadcast(lost))
        rank = nxt.select("node_id", "out", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        if k % 2 or k == iterations - 1:
            rank = materialise(rank, "rank")
    return rank.select("node_id", "rank")


def direct_dependents(g: Graph) -> DataFrame:
    """(node_id, direct_dependents): distinct sources of edges of any relationship."""
    return g.edges.groupBy(F.col("target_id").alias("node_id")).agg(F.countDistinct("source_id").alias("direct_dependents"))


def find_critical_models(g: Graph, top: int = 20, repo: str | None = None, **rank) -> DataFrame:
    """Real nodes of highest rank; ``repo`` restricts only what is shown."""
    found = pagerank(g, **rank).join(g.located().filter(F.col("file_id").isNotNull()), "node_id").join(direct_dependents(g), "node_id", "left")
    if repo is not None:
        found = found.filter(F.col("repo") == repo)
    shown = found.select("node_id", "name", "kind", "repo", F.round("rank", 6).alias("importance"), F.coalesce("direct_dependents", F.lit(0)).alias("direct_dependents"), "rank")
    return shown.orderBy(F.desc("importance"), "node_id").limit(top).drop("rank")


def components(g: Graph) -> DataFrame:
    """(node_id, component): the smallest node that edges of any kind and direction lead to.

    Alternates moving larger neighbours (large star) and smaller ones (small star) onto the smallest
    neighbour; the edges never grow and the rounds grow with the logarithm of the size.
    """
    e = g.edges.select(F.greatest("source_id", "target_id").alias("a"), F.least("source_id", "target_id").alias("b")).filter("a <> b").distinct()
    e = materialise(e, "components")
    mark = F.struct(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = e.agg(mark.alias("s")).first()["s"]
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        e = materialise(small.select("e.*").filter("a <> b").distinct(), "components")
        now = e.agg(mark.alias("s")).first()["s"]
        if now == before:
            break
        before = now
    return g.nodes.select("node_id").join(e.withColumnRenamed("a", "node_id"), "node_id", "left").select("node_id", F.coalesce("b", "node_id").alias("component"))


def find_subgraphs(g: Graph, repo: str | None = None) -> DataFrame:
    """(component, size, members) of real nodes, largest first; ``repo`` restricts the members shown."""
    found = components(g).join(g.located().filter(F.col("file_id").isNotNull()), "node_id")
    if repo is not None:
        found = found.filter(F.col("repo") == repo)
    out = found.groupBy("component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))
    return out.orderBy(F.desc("size"), "component")


def orphans(g: Graph, repo: str | None = None) -> DataFrame:
    """Names of components that show one node."""
    return find_subgraphs(g, repo).filter("size = 1").select(F.col("members").alias("name"))


def local_clustering(g: Graph) -> DataFrame:
    """(node_id, lcc) on the undirected simple graph: links among a node's neighbours over possible ones.

    Every edge points from the smaller to the larger (degree, id), so each triangle is met once and no node
    has more outgoing edges than the square root of twice their number.
    """
    e = g.edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).filter("a <> b").distinct()
    degree = e.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    d1, d2 = degree.select(F.col("node_id").alias("a"), F.col("degree").alias("da")), degree.select(F.col("node_id").alias("b"), F.col("degree").alias("db"))
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = e.join(d1, "a").join(d2, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v"))
    o = materialise(o, "triangles")
    x, y, z = o.alias("x"), o.alias("y"), o.alias("z")
    wedges = x.join(y, F.col("x.u") == F.col("y.u")).filter("x.v < y.v").select(F.col("x.u").alias("p"), F.col("x.v").alias("q"), F.col("y.v").alias("r"))
    keys = z.select(F.least("u", "v").alias("q"), F.greatest("u", "v").alias("r"))
    found = wedges.join(keys, ["q", "r"]).select(F.explode(F.array("p", "q", "r")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    possible = F.col("degree") * (F.col("degree") - 1)
    return degree.join(found, "node_id", "left").select("node_id", F.when(possible > 0, 2.0 * F.coalesce("triangles", F.lit(0)) / possible).otherwise(0.0).alias("lcc"))


def find_bottlenecks(g: Graph, min_downstream: int = 5, repo: str | None = None, clustering: bool = True) -> DataFrame:
    """Nodes that at least ``min_downstream`` others read, with fan-out, clustering and a risk class."""
    flow = materialise(g.ends().filter(dataflow()).select("source_id", "target_id").distinct(), "flow")
    fan_in = flow.groupBy(F.col("target_id").alias("node_id")).agg(F.count("*").alias("downstream")).filter(F.col("downstream") >= min_downstream)
    fan_out = flow.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("upstream"))
    found = fan_in.join(fan_out, "node_id", "left").join(g.located().filter(F.col("file_id").isNotNull()).select("node_id", "name", "kind", "repo"), "node_id")
    if repo is not None:
        found = found.filter(F.col("repo") == repo)
    lcc = F.lit(None).cast("double")
    if clustering:
        found, lcc = found.join(local_clustering(g), "node_id", "left"), F.col("lcc")
    risk = F.when((F.col("downstream") > 20) & (lcc.isNull() | (lcc < 0.1)), "high").when(F.col("downstream") > 10, "medium").otherwise("low")
    shown = found.select("node_id", "name", "kind", "repo", "downstream", F.coalesce("upstream", F.lit(0)).alias("upstream"), F.round(lcc, 4).alias("clustering"), risk.alias("risk"))
    return shown.orderBy(F.desc("downstream"), "node_id")
