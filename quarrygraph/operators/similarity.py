"""Similar models, placement of new ones, and semantic tags."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import hundredths, jaccard, layer_of, strip_layer_prefix
from quarrygraph.graph import Graph
from quarrygraph.runtime import materialise

EXTEND_FROM, KEEP_FROM = 0.8, 0.05
#: Words that name no topic.
TRIVIAL = ["id", "at", "by", "to", "is", "on", "in", "of", "no"]


def _candidates(g: Graph, repo: str | None) -> DataFrame:
    found = g.located().filter(F.col("kind").isin("table", "view") & F.col("file_id").isNotNull())
    found = found.select("node_id", "name", "path", "repo", layer_of().alias("layer"))
    return found.filter(F.col("repo") == repo) if repo is not None else found


def _parts(g: Graph) -> DataFrame:
    """(node_id, kind, value): what a model references and which columns it has, as one inverted list."""
    refs = g.edges.filter("relationship = 'references'").join(g.nodes.select(F.col("node_id").alias("target_id"), "name"), "target_id").select(F.col("source_id").alias("node_id"), F.lit("ref").alias("part"), F.col("name").alias("value"))
    cols = g.columns.select("node_id", F.lit("col").alias("part"), F.col("column_name").alias("value"))
    return refs.unionByName(cols).distinct()


def find_similar_models(g: Graph, references: list[str] | None = None, output_columns: list[str] | None = None, model: str | None = None, limit: int = 5, repo: str | None = None) -> DataFrame:
    """(name, path, similarity, shared_refs, shared_columns, suggestion), best first.

    The score is 0.6 of the Jaccard index of references, 0.3 of that of columns, 0.1 for the same layer.
    Only parts that the target has are counted for each candidate, so nothing is compared in pairs.
    A model that is missing or ambiguous gives an error.
    """
    cand = _candidates(g, repo)
    parts = _parts(g)
    layer = None
    if model:
        own = cand.filter(F.col("name") == model).limit(2).collect()
        if len(own) != 1:
            raise LookupError(f"model {model!r} {'not found' if not own else 'is ambiguous: name its repo'}")
        layer = own[0]["layer"]
        cand = cand.filter(F.col("node_id") != own[0]["node_id"])
        mine = parts.filter(F.col("node_id") == own[0]["node_id"]).select("part", "value")
        if references is not None:
            mine = mine.filter("part <> 'ref'")
        if output_columns is not None:
            mine = mine.filter("part <> 'col'")
    else:
        mine = parts.select("part", "value").filter(F.lit(False))
    given = [("ref", r) for r in references or []] + [("col", c) for c in output_columns or []]
    if given:
        mine = mine.unionByName(g.spark.createDataFrame(given, "part string, value string"))
    mine = mine.distinct()
    sizes = mine.agg(F.count_if(F.col("part") == "ref").alias("own_ref"), F.count_if(F.col("part") == "col").alias("own_col"))  # one row
    n = parts.groupBy("node_id").agg(F.count_if(F.col("part") == "ref").alias("n_ref"), F.count_if(F.col("part") == "col").alias("n_col"))
    hit = parts.join(mine, ["part", "value"]).groupBy("node_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("part") == "ref", F.col("value")))).alias("refs"), F.array_sort(F.collect_list(F.when(F.col("part") == "col", F.col("value")))).alias("cols")
    )
    rows = cand.join(n, "node_id", "left").join(hit, "node_id", "left").crossJoin(F.broadcast(sizes)).filter("own_ref + own_col > 0")
    for c in ("n_ref", "n_col"):
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0)))

    def index(kind: str, shared: str):
        both = F.coalesce(F.size(shared), F.lit(0))
        both = F.greatest(both, F.lit(0))
        either = F.col(f"own_{kind}") + F.col(f"n_{kind}") - both
        return F.when(either > 0, both / either).otherwise(0.0)

    bonus = F.when(F.col("layer") == layer, 0.1).otherwise(0.0) if layer is not None else F.lit(0.0)
    rows = rows.withColumn("score", index("ref", "refs") * 0.6 + index("col", "cols") * 0.3 + bonus).filter(F.col("score") >= KEEP_FROM)
    hint = F.when(F.col("score") >= EXTEND_FROM, F.concat(F.lit("extend "), "name"))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    rows = rows.orderBy(F.desc(F.round("score", 12)), "name", "node_id").limit(limit)
    return rows.select("node_id", "name", "path", F.round("score", 4).alias("similarity"), joined("refs").alias("shared_refs"), joined("cols").alias("shared_columns"), hint.alias("suggestion"))


def suggest_placement(g: Graph, references: list[str], name: str | None = None, repo: str | None = None) -> DataFrame:
    """One row: recommended layer, folder, naming pattern and whether the choice is ambiguous.

    A layer fits whose rule allows all layers of the references; the one of highest confidence wins. If none
    fits, the best covered does, as ambiguous. No row: nothing could be decided.
    """
    cand = _candidates(g, repo)
    layers = cand.filter(F.col("name").isin(references) & F.col("layer").isNotNull()).select(F.collect_set("layer").alias("need"))  # one row
    rules = g.conventions
    if repo is not None:
        rules = rules.join(g.repos.filter(F.col("name") == repo).select("repo_id"), "repo_id", "left_semi")
    refs = rules.filter("convention_type = 'references'").select("layer", "confidence", F.from_json("payload", "allowed_targets array<string>")["allowed_targets"].alias("allowed"))
    names = rules.filter("convention_type = 'naming'").groupBy("layer").agg(F.min(F.get_json_object("payload", "$.pattern")).alias("naming_pattern"))
    fit = refs.crossJoin(F.broadcast(layers)).withColumn("coverage", F.size(F.array_intersect("need", "allowed")) / F.size("need")).filter("coverage > 0")
    fit = fit.orderBy(F.desc("coverage"), F.desc("confidence"), "layer").limit(1)
    folder = F.concat(F.regexp_replace("path", r"/[^/]*$", ""), F.lit("/"))
    folders = cand.filter(F.col("path").contains("/")).groupBy("layer").agg(F.min(folder).alias("recommended_path"))
    out = fit.join(names, "layer", "left").join(folders, "layer", "left")
    lead = F.regexp_extract(F.coalesce("naming_pattern", F.lit("")), r"^([^{]*)\{", 1)
    wanted = F.lit(name)
    feedback = F.when(wanted.isNotNull() & F.col("naming_pattern").isNotNull(), F.when((lead != "") & ~wanted.startswith(lead), F.concat(lead, wanted)).otherwise(wanted))
    return out.select(
        F.col("layer").alias("recommended_layer"), F.coalesce("recommended_path", F.lit("")).alias("recommended_path"), F.coalesce("naming_pattern", F.lit("")).alias("naming_pattern"),
        "confidence", F.round("coverage", 2).alias("coverage"), (F.col("coverage") < 1).alias("ambiguous"), F.array_join(F.array_sort("need"), ",").alias("reference_layers"), feedback.alias("suggested_name"),
    )


def model_references(g: Graph) -> DataFrame:
    """(repo_id, node_id, name, refs): distinct upstream node ids of each table or view, direct or through the
    query that defines it."""
    at = g.nodes.join(g.files.select("file_id", "repo_id"), "file_id").filter(F.col("kind").isin("table", "view")).select("repo_id", "node_id", "name")
    # one array a source: what many models take through one query is gathered once
    flow = materialise(g.edges.filter(F.col("relationship").isin("references", "cte_references")).groupBy("source_id").agg(F.collect_set("target_id").alias("refs")), "flow")
    via = g.edges.filter("relationship = 'defines'").select("source_id", F.col("target_id").alias("node_id")).join(at, "node_id", "left_semi").distinct().join(flow, "source_id").select("node_id", "refs")
    rows = flow.withColumnRenamed("source_id", "node_id").join(at, "node_id", "left_semi").unionByName(via)
    refs = rows.groupBy("node_id").agg(F.flatten(F.collect_list("refs")).alias("refs")).withColumn("refs", F.sort_array(F.array_distinct(F.expr("array_remove(refs, node_id)")))).filter(F.size("refs") > 0)
    return at.join(refs, "node_id")


def reference_classes(refs: DataFrame) -> DataFrame:
    """(repo_id, class_id, refs, nodes): models of a repo with the same references as one row, named by the
    smallest id; ``nodes`` holds all of their ids."""
    found = refs.groupBy("repo_id", "refs").agg(F.min("node_id").alias("class_id"), F.collect_list("node_id").alias("nodes"))
    return materialise(found, "classes")


def _members(classes: DataFrame) -> DataFrame:
    return classes.select("class_id", F.explode("nodes").alias("node_id"))


def _at(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the runs of these starts and sizes, one run after the other."""
    sizes = np.asarray(sizes, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _dense(flats: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """All values as numbers from 0 in one array, and how many there are; empties the list."""
    ids = np.unique(np.concatenate([np.unique(x) for x in flats])) if flats else np.empty(0, np.int64)
    flats.reverse()
    parts = []
    while flats:
        parts.append(np.searchsorted(ids, flats.pop()).astype(np.int32))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), len(ids)


def _inverted(flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, owners) of each value's owners, ascending."""
    key = flat.astype(np.int64) << 32 | owner
    key.sort()
    size = np.bincount(flat, minlength=n)
    key &= 0xFFFFFFFF
    return np.cumsum(size) - size, size, key.astype(np.int32)


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[dict[str, np.ndarray], np.ndarray, list[np.ndarray]]:
    """Plain columns, sizes and values of ``refs`` of all batches."""
    plain, sizes, flats = {}, [], []
    for batch in batches:
        for name in batch.schema.names:
            if name != "refs":
                plain.setdefault(name, []).append(batch.column(name).to_numpy(zero_copy_only=False).copy())
        refs = batch.column("refs")
        sizes.append(refs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        flats.append(refs.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    return {k: np.concatenate(v) for k, v in plain.items()}, np.concatenate(sizes), flats


def _similar_between(least: float, cheap: int):
    """Pairs of classes of one block with those of another, or of one block among themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes, flats = _gather(batches)
        flat, n_refs = _dense(flats)
        starts, ids, same = np.cumsum(sizes) - sizes, rows["class_id"], bool(rows["i"][0] == rows["j"][0])
        right = rows["block"] == rows["j"]
        left = np.flatnonzero(right if same else ~right)
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        of_right = np.repeat(right, sizes)
        first, often, holders = _inverted(flat if of_right.all() else flat[of_right], owner if of_right.all() else owner[of_right], n_refs)
        del owner, of_right
        mark = np.zeros(n_refs, bool)
        out: list[tuple] = []

        def rows_of(out: list[tuple]) -> pa.RecordBatch:
            a, b, sim = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sim)], names=["x", "y", "similarity"])

        for a in left:
            own, n = flat[starts[a] : starts[a] + sizes[a]], sizes[a]
            f = often[own]
            # whichever references a pair of that similarity may lack, it shares one of the rare others
            k = int(min(n, n - np.ceil(n * least - 1e-9) + 1))
            rare = np.argpartition(f, k - 1)[:k] if k < n else np.arange(n)
            if f.sum() <= 2 * f[rare].sum() + cheap:
                b, both = np.unique(holders[_at(first[own], f)], return_counts=True)
            else:
                b = np.unique(holders[_at(first[own[rare]], f[rare])])
                b = b[np.minimum(sizes[b], n) >= least * np.maximum(sizes[b], n) - 1e-9]
                mark[own] = True
                both = np.add.reduceat(mark[flat[_at(starts[b], sizes[b])]], np.cumsum(sizes[b]) - sizes[b], dtype=np.int64) if len(b) else np.empty(0, np.int64)
                mark[own] = False
            sim = both / (n + sizes[b] - both)
            keep = sim >= least
            if same:
                keep &= b > a
            if keep.any():
                b = b[keep]
                out.append((np.full(len(b), a), b, sim[keep]))
                if len(out) >= 10_000:
                    yield rows_of(out)
                    out = []
        if out:
            yield rows_of(out)

    return run


def similar_classes(classes: DataFrame, least: float = 0.5, block: int = 12_000_000, cheap: int = 50_000) -> DataFrame:
    """(x, y, similarity) of different classes of a repo: their shared references are counted along an inverted
    list, or in the classes that share a rare one, if the list is far longer and has over ``cheap`` entries.
    Classes are dealt into blocks of about ``block`` references; a task takes two of them."""
    sized = classes.groupBy("repo_id").agg(F.ceil(F.sum(F.size("refs").cast("long")) / block).cast("int").alias("blocks"))
    own = classes.select("repo_id", "class_id", "refs").join(sized, "repo_id").withColumn("block", F.pmod(F.hash("class_id"), F.col("blocks")))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.select("repo_id", "i", "j", "block", "class_id", "refs").groupBy("repo_id", "i", "j").applyInArrow(_similar_between(least, cheap), "x bigint, y bigint, similarity double")


def similar_pairs(refs: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, similarity) of models of a repo that share references: pairs that share nothing are never made.
    Models with the same references are compared as one; their pairs are made last, when nothing is left to
    deal out anew."""
    classes = reference_classes(refs)
    found = materialise(similar_classes(classes, least), "similar")
    m = _members(classes)
    a, b = m.select(F.col("class_id").alias("x"), F.col("node_id").alias("a")), m.select(F.col("class_id").alias("y"), F.col("node_id").alias("b"))
    across = found.join(a, "x").join(b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    many = _members(classes.filter(F.size("nodes") > 1))
    within = many.withColumnRenamed("node_id", "a").join(many.withColumnRenamed("node_id", "b"), "class_id").filter("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    return across.unionByName(within.filter(F.lit(1.0) >= least))


def _merge(sets: list[set], threshold: float) -> list[list[int]]:
    """Merges the most similar pair of unions, the first of equals, until none reaches the threshold."""
    if threshold <= 0:  # any two unions reach it
        return [list(range(len(sets)))] if len(sets) > 1 else []
    first: dict[frozenset, int] = {}
    members: dict[int, list[int]] = {}
    for i, s in enumerate(sets):  # equal sets are the most similar of all, and merging them changes no union
        members.setdefault(first.setdefault(frozenset(s), i) if s else i, []).append(i)
    at = sorted(members)
    sizes = np.array([len(sets[i]) for i in at], np.int64)
    flat, n = _dense([np.fromiter((x for i in at for x in sets[i]), np.int64)])
    merged = _merge_flat(np.cumsum(sizes) - sizes, sizes, flat, n, threshold)
    found = [[x for k in group for x in members[at[k]]] for group in merged]
    return [m for m in found if len(m) > 1]


def _merge_flat(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray, n_refs: int, threshold: float) -> list[list[int]]:
    """The merge loop over different sets in flat arrays, as groups of their numbers, single ones included.

    Each union keeps its best later partner in a heap, an upper bound once a partner has changed. Partners are
    found by an inverted list of references, so memory grows with the references, not with the pairs: some 25
    bytes for each."""
    n = len(sizes)
    owner = np.empty(len(flat), np.int32)
    for i in range(n):
        owner[starts[i] : starts[i] + sizes[i]] = i
    first, often, holders = _inverted(flat, owner, n_refs)
    del owner
    union: dict[int, np.ndarray] = {i: flat[starts[i] : starts[i] + sizes[i]] for i in range(n)}
    size = np.array(sizes, np.int64)
    members = {i: [i] for i in range(n)}
    version = dict.fromkeys(union, 0)
    best: dict[int, tuple] = {}
    heap: list[tuple] = []

    def similar(i: int, least: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, partner) of those that reach the threshold, with numbers above ``least``."""
        met = holders[_at(first[union[i]], often[union[i]])]
        met = met[met > least]  # -1: gone
        if 4 * len(met) < n:
            j, both = np.unique(met, return_counts=True)
        else:
            both = np.bincount(met)
            j = np.flatnonzero(both)
            both = both[j]
        s = both / (size[i] + size[j] - both)
        keep = (s >= threshold) & (j != i)
        return s[keep], j[keep]

    def offer(i: int, found: tuple | None) -> None:
        if found is None:
            best.pop(i, None)
        else:
            best[i] = found
            heapq.heappush(heap, found)

    def entry(s: float, i: int, j: int) -> tuple:
        return -s, i, j, version[i], version[j]

    def later(i: int, s: np.ndarray, j: np.ndarray) -> tuple | None:
        """The best partner above ``i``, the first of equals; ``j`` ascends."""
        k = int(np.searchsorted(j, i, "right"))
        if k == len(j):
            return None
        k += int(np.argmax(s[k:]))
        return entry(float(s[k]), i, int(j[k]))

    for i in range(n):
        offer(i, later(i, *similar(i, i)))
    while heap:
        top = heapq.heappop(heap)
        _, i, j, vi, vj = top
        if i not in union or best.get(i) != top:
            continue
        if version.get(j) != vj or version[i] != vi:
            offer(i, later(i, *similar(i, i)))
            continue
        members[i] += members.pop(j)
        gone = union.pop(j)
        shared = np.isin(gone, union[i], assume_unique=True)
        at = _at(first[gone], often[gone])
        hit = holders[at] == j
        holders[at[hit]] = np.where(np.repeat(shared, often[gone])[hit], -1, i)
        union[i] = np.concatenate([union[i], gone[~shared]])
        size[i] = len(union[i])
        del version[j]
        best.pop(j, None)
        version[i] += 1
        s, x = similar(i)
        for k in range(int(np.searchsorted(x, i))):
            new = entry(float(s[k]), int(x[k]), i)
            if new[1] not in best or new < best[new[1]]:
                offer(new[1], new)
        offer(i, later(i, s, x))
    return list(members.values())


def _clustered(classes: DataFrame, threshold: float) -> DataFrame:
    """(repo_id, cluster, class_id) of the merge loop of each repo with at least five models with references."""
    fit = classes.groupBy("repo_id").agg(F.sum(F.size("nodes")).alias("n")).filter("n >= 5").select("repo_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sizes, flats = _gather(batches)
        flat, n = _dense(flats)
        order = np.argsort(rows["class_id"])
        ids, many, starts = rows["class_id"][order], rows["n"][order], (np.cumsum(sizes) - sizes)[order]
        groups = [np.arange(len(ids))] if threshold <= 0 else _merge_flat(starts, sizes[order], flat, n, threshold)
        found = [np.sort(m) for m in groups if many[m].sum() > 1]
        if found:
            at = np.concatenate(found)
            cluster = np.repeat([ids[m[0]] for m in found], [len(m) for m in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), rows["repo_id"][0])), pa.array(cluster), pa.array(ids[at])], names=["repo_id", "cluster", "class_id"])

    rows = classes.join(fit, "repo_id", "left_semi").select("repo_id", "class_id", F.size("nodes").cast("long").alias("n"), "refs")
    return materialise(rows.groupBy("repo_id").applyInArrow(run, "repo_id bigint, cluster bigint, class_id bigint"), "clusters")


def _named(clusters: DataFrame, classes: DataFrame, g: Graph) -> DataFrame:
    """(repo_id, cluster, class_id, node_id, name): a row for each model."""
    return clusters.join(_members(classes), "class_id").join(g.nodes.select("node_id", "name"), "node_id")


def semantic_clusters(g: Graph, threshold: float = 0.5) -> DataFrame:
    """(repo_id, cluster, node_id, name, refs): agglomerative clusters within each repo. Repos with fewer than
    five models with references have none; one repo is one group, since its merges follow each other. Models
    with the same references go through the merge as one."""
    classes = reference_classes(model_references(g))
    named = _named(_clustered(classes, threshold), classes, g)
    return named.join(classes.select("class_id", "refs"), "class_id").select("repo_id", "cluster", "node_id", "name", "refs")


def cluster_labels(clusters: DataFrame) -> DataFrame:
    """(repo_id, cluster, tag_name): the word that most members' names hold, without layer prefixes."""
    words = F.array_distinct(F.split(F.lower(strip_layer_prefix(F.col("name"))), "_"))
    rows = clusters.select("repo_id", "cluster", F.explode(words).alias("word")).filter((F.col("word") != "") & ~F.col("word").isin(TRIVIAL))
    best = Window.partitionBy("repo_id", "cluster").orderBy(F.desc("count"), "word")
    return rows.groupBy("repo_id", "cluster", "word").count().withColumn("r", F.row_number().over(best)).filter("r = 1").select("repo_id", "cluster", F.col("word").alias("tag_name"))


def infer_tags(g: Graph, threshold: float = 0.5, stored: DataFrame | None = None) -> DataFrame:
    """Rows of the tags table. A stored tag of another name stays where the model is still as similar as the
    threshold to a member of a cluster of that name."""
    classes = reference_classes(model_references(g))
    clusters = _clustered(classes, threshold)
    tagged = _named(clusters, classes, g)
    tagged = tagged.join(cluster_labels(tagged), ["repo_id", "cluster"])
    # a model's mean similarity to the others of its cluster, from pairs of different classes and their counts
    sets = clusters.join(classes.select("class_id", "refs", F.size("nodes").cast("long").alias("n")), "class_id")
    a = sets.select("repo_id", "cluster", F.col("class_id").alias("x"), F.col("refs").alias("ra"), F.col("n").alias("na"))
    b = sets.select("repo_id", "cluster", F.col("class_id").alias("y"), F.col("refs").alias("rb"), F.col("n").alias("nb"))
    pairs = a.join(b, ["repo_id", "cluster"]).filter("x < y").withColumn("s", jaccard(F.col("ra"), F.col("rb")))
    ways = F.explode(F.array(F.struct(F.col("x").alias("class_id"), F.col("nb").alias("m"), "s"), F.struct(F.col("y").alias("class_id"), F.col("na").alias("m"), "s")))
    sums = pairs.select(ways.alias("w")).select("w.*").groupBy("class_id").agg(F.sum(F.col("m") * F.col("s")).alias("s"), F.sum("m").alias("m"))
    others = F.coalesce("m", F.lit(0)) + F.col("n") - 1
    mean = sets.select("class_id", "n").join(sums, "class_id", "left").select("class_id", F.when(others > 0, (F.coalesce("s", F.lit(0.0)) + F.col("n") - 1) / others).alias("mean"))
    told = g.columns.filter(F.coalesce("description", F.lit("")) != "").select("node_id", F.lower("description").alias("description"))
    said = tagged.select("node_id", "tag_name").join(told, "node_id").filter(F.col("description").contains(F.col("tag_name"))).select("node_id").distinct().withColumn("said", F.lit(0.1))
    rows = tagged.join(mean, "class_id", "left").join(said, "node_id", "left")
    base = F.greatest(F.lit(0.6), F.least(F.lit(0.85), 0.6 + (F.coalesce("mean", F.lit(0.0)) - 0.5) * 0.5))
    named = F.when(F.lower(strip_layer_prefix(F.col("name"))).contains(F.col("tag_name")), 0.1).otherwise(0.0)
    confidence = hundredths(F.least(base + named + F.coalesce("said", F.lit(0.0)), F.lit(1.0)))
    new = rows.select("repo_id", "tag_name", "node_id", confidence.alias("confidence"), F.lit("inferred").alias("source"))
    if stored is None:
        return new
    tagged = tagged.join(classes.select("class_id", "refs"), "class_id")
    old = stored.select("node_id", F.col("tag_name").alias("old_tag"), F.col("confidence").alias("old_confidence"))
    moved = new.join(old, "node_id").filter("tag_name <> old_tag").select("node_id", "old_tag", "old_confidence").join(tagged.select("node_id", "repo_id", F.col("refs").alias("ra")), "node_id")
    peers = tagged.select("repo_id", F.col("tag_name").alias("old_tag"), F.col("node_id").alias("other"), F.col("refs").alias("rb"))
    stays = moved.join(peers, ["repo_id", "old_tag"]).filter((F.col("other") != F.col("node_id")) & (jaccard(F.col("ra"), F.col("rb")) >= threshold)).select("node_id", "old_tag", "old_confidence").distinct()
    merged = new.join(stays, "node_id", "left")
    return merged.select("repo_id", F.coalesce("old_tag", "tag_name").alias("tag_name"), "node_id", F.coalesce("old_confidence", "confidence").alias("confidence"), "source")
