"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample (``fit_rows``) is cut into balanced parts; a small classifier learns
the parts of a vector's neighbours. It places every row in its most probable part and routes each query to
several most probable parts, whose rows are ranked exactly. The number of parts visited is the least that
reaches ``target`` recall for sample queries. There is a part for every ``part_rows`` rows, ``min_parts`` at
least and as many as the sample can teach (one for ``teach_rows`` of its rows) at most; beyond that parts grow,
so ``fit_rows`` is to be raised with the table. Rows and queries of a part that are more than a block are dealt
out by a hash of the id, and each block of rows meets each block of queries in a task of its own, so a vector
that many rows repeat spreads over tasks and no task holds more than two blocks. Best lists are merged in a
stream sorted by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import gather, table, tidy


def neighbour_graph(x: np.ndarray, k: int = 10, step: int = 1024) -> np.ndarray:
    """The k largest inner products of each row among the others, exactly."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), step):
        s = x[at : at + step] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + step] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """A part for each node: recursive spectral bisection, then moves to the part of most neighbours
    while no part grows beyond ``slack`` of its share."""
    n, k = graph.shape
    u = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
    v = np.concatenate([graph.ravel(), np.repeat(np.arange(n), k)])
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)

    def cut(nodes: np.ndarray, first: int, count: int) -> None:
        part[nodes] = first
        if count < 2 or len(nodes) < 2:
            return
        local = np.full(n, -1)
        local[nodes] = np.arange(len(nodes))
        inside = (local[u] >= 0) & (local[v] >= 0)
        a, b = local[u[inside]], local[v[inside]]
        root = np.sqrt(np.bincount(a, minlength=len(nodes)) + 1.0)
        y = rng.normal(size=len(nodes))
        for _ in range(60):  # power iteration on the normalised graph, without its first eigenvector
            y -= root * (y @ root) / (root @ root)
            y = y + (np.bincount(a, (y / root)[b], minlength=len(nodes)) + y / root) / root
            y /= max(np.linalg.norm(y), 1e-300)
        half = count // 2
        order = np.argsort(y / root, kind="stable")
        at = len(nodes) * half // count
        cut(nodes[order[:at]], first, half)
        cut(nodes[order[at:]], first + half, count - half)

    cut(np.arange(n), 0, parts)
    most = int(np.ceil(slack * n / parts))
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.int32)
        np.add.at(votes, (u, part[v]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(n), best] - votes[np.arange(n), part]
        moved = 0
        for node in np.argsort(-gain, kind="stable"):
            if gain[node] <= 0:
                break
            if sizes[best[node]] < most:
                sizes[part[node]] -= 1
                part[node] = best[node]
                sizes[best[node]] += 1
                moved += 1
        if not moved:
            break
    return part


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def route(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the parts for each vector."""
    h = np.maximum((x * model["scale"]) @ model["w1"] + model["b1"], 0)
    return _softmax(h @ model["w2"] + model["b2"])


def train_router(x: np.ndarray, graph: np.ndarray, part: np.ndarray, parts: int, hidden: int = 128, epochs: int = 40, seed: int = 5) -> dict:
    """One hidden layer, learned by Adam from the share of a vector's neighbours (and itself) in each part."""
    rng = np.random.default_rng(seed)
    scale = 1 / max(np.sqrt((x * x).mean()), 1e-12)
    y = np.zeros((len(x), parts))
    np.add.at(y, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
    y[np.arange(len(x)), part] += 1
    y /= y.sum(1, keepdims=True)
    p = {"w1": rng.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, hidden**-0.5, (hidden, parts)), "b2": np.zeros(parts)}
    m, s, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    z = x * scale
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            pre = z[rows] @ p["w1"] + p["b1"]
            h = np.maximum(pre, 0)
            d = (_softmax(h @ p["w2"] + p["b2"]) - y[rows]) / len(rows)
            back = (d @ p["w2"].T) * (pre > 0)
            g = {"w2": h.T @ d, "b2": d.sum(0), "w1": z[rows].T @ back, "b1": back.sum(0)}
            t += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return p | {"scale": scale}


def fit_index(x: np.ndarray, parts: int, top: int, target: float) -> dict:
    """Router of the sample ``x`` and the number of parts to visit. Every tenth row is kept aside as a query."""
    if parts < 2:
        d = x.shape[1] if x.ndim == 2 else 1
        return {"parts": 1, "probes": 1, "scale": 1.0, "w1": np.zeros((d, 1)), "b1": np.zeros(1), "w2": np.zeros((1, 1)), "b2": np.zeros(1)}
    aside = np.arange(len(x)) % 10 == 0
    base, asked = x[~aside], x[aside]
    graph = neighbour_graph(base)
    model = train_router(base, graph, balanced_parts(graph, parts), parts)
    placed = route(model, base).argmax(1)
    k = min(top, len(base))
    true = placed[np.argpartition(-(asked @ base.T), k - 1, axis=1)[:, :k]]
    rank = np.argsort(np.argsort(-route(model, asked), axis=1, kind="stable"), axis=1)
    need = np.take_along_axis(rank, true, 1)
    probes = next(p for p in range(1, parts + 1) if (need < p).mean() >= target)
    return model | {"parts": parts, "probes": probes}


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part: those with an id whose vectors are not null or zero and
    hold no null or non-finite component."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda c: c != 0))


def _sample(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """The first ``size`` different rows in hash order, found below a hash limit that is raised until it lets enough through."""
    order, share = F.xxhash64(F.lit(9), "id", "v"), min(1.0, 2 * size / max(n, 1))
    while True:
        near = rows.withColumn("h", order).filter(F.col("h") <= F.lit(min(int(share * 2**64), 2**64 - 1) - 2**63))
        got = near.dropDuplicates(["id", "v"]).orderBy("h", "id").limit(size).collect()
        if len(got) == size or share == 1.0:
            return np.array([r["v"] for r in got]) if got else np.zeros((0, 1))
        share = min(1.0, 8 * share)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def rank_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, top: int, cells: int = 4 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best of each query, ids, scores): the ``top`` best ids of one block, query by query; ties go to smaller ids.
    An id with several vectors counts with its best one."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sizes = np.diff(np.append(starts, len(ids)))
    several = len(starts) < len(ids)
    ids = ids[starts]
    counts, found, scores = [], [], []
    step = max(1, cells // len(x))
    k = min(top, len(ids))
    for at in range(0, len(q), step):
        rough = q[at : at + step] @ x.T
        if several:
            rough = np.maximum.reduceat(rough, starts, axis=1)
        rough[q_ids[at : at + step, None] == ids[None, :]] = -np.inf
        least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k]
        for i, low in enumerate(least):
            # near the last place all are compared again, in an order of sums that no position changes
            near = np.flatnonzero(rough[i] >= max(low - 1e-9 * max(1.0, abs(low)), -1e300))
            if several and len(near):
                score = np.maximum.reduceat((x[gather(starts[near], sizes[near])] * q[at + i]).sum(1), np.cumsum(sizes[near]) - sizes[near])
            else:
                score = (x[near] * q[at + i]).sum(1)
            best = np.lexsort((ids[near], -score))[:top]
            counts.append(len(best))
            found.append(ids[near[best]])
            scores.append(score[best])
    return np.array(counts), np.concatenate(found), np.concatenate(scores)


def best_of(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, top: int) -> np.ndarray:
    """Which entries are among the ``top`` best of their query, each id once, in order of query and rank."""
    order = np.lexsort((-scores, ids, query))  # of one id the best score stays
    order = order[np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(ids[order]) != 0)])] if len(order) else order
    order = order[np.lexsort((ids[order], -scores[order], query[order]))]
    q = query[order]
    new = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) if len(q) else q
    return order[place < top]


def _merge(top: int):
    """Best lists sorted by query, one row a query and block, to (query_id, rank, vec_id, score): only the running
    best of the query that is open is held."""

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

        def rows(query, ids, scores):
            new = np.concatenate([[True], query[1:] != query[:-1]])
            rank = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0)) + 1
            return pa.RecordBatch.from_arrays([pa.array(query), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("found")
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            values = lists.flatten()
            query = np.concatenate([held[0], np.repeat(batch.column("query_id").to_numpy(), sizes)])
            ids = np.concatenate([held[1], values.field("vec_id").to_numpy()])
            scores = np.concatenate([held[2], -values.field("minus").to_numpy()])
            best = best_of(query, ids, scores, top)
            query, ids, scores = query[best], ids[best], scores[best]
            open_ = int(np.searchsorted(query, query[-1])) if len(query) else 0
            if open_:
                yield rows(query[:open_], ids[:open_], scores[:open_])
            held = query[open_:], ids[open_:], scores[open_:]
        if len(held[0]):
            yield rows(*held)

    return run


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = 20, fit_rows: int = 6000, part_rows: int = 3000, min_parts: int = 4, teach_rows: int = 24, block_bytes: int = 16 << 20, target: float = 0.95) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each row where ``is_query`` (over ``id``) holds.

    Rows that ``usable`` leaves out take no part. A query's own id is no candidate. An id with several vectors
    is listed once, with its best score; as a query, each of its vectors is searched and the best scores count.
    Vectors are compared with those of their length: the index serves the commonest length (the least, if
    several are), all others are compared exactly, block by block. Extra columns are ignored; a table without
    usable rows gives none. The driver receives at most ``fit_rows`` vectors, and two counts a part and length.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    lengths = sorted(((-r["count"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).count().collect()))
    n, d = (-lengths[0][0], lengths[0][1]) if lengths else (0, 1)
    x = _sample(rows.filter(F.size("v") == d), n, fit_rows)
    model = fit_index(x, min(max(min_parts, -(-n // part_rows)), len(x) // teach_rows), top, target)
    sent = spark.sparkContext.broadcast(model)  # fit_rows / teach_rows columns at most

    def place(batches):
        """The parts of each row, most probable first; a length without an index is one part, numbered -length."""
        m = sent.value
        for batch in batches:
            sizes = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            usual = np.flatnonzero(sizes == d)
            parts = [[-int(k)] for k in sizes]
            if len(usual):
                p = route(m, _matrix(batch.column("v").take(pa.array(usual))))
                for k, best in zip(usual.tolist(), np.argsort(-p, axis=1, kind="stable")[:, : m["probes"]].tolist()):
                    parts[k] = best
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(parts, pa.list_(pa.int32()))], names=["id", "v", "parts"])

    placed = rows.mapInArrow(tidy(place), "id bigint, v array<double>, parts array<int>")
    visited = placed.select(F.posexplode("parts").alias("at", "part"), is_query.alias("asks"), F.size("v").alias("d"))
    sizes = visited.groupBy("part", "d").agg(F.count_if(F.col("at") == 0).alias("rows"), F.count_if("asks").alias("asked")).collect()
    cut = lambda count, d: max(1, -(-count // max(256, block_bytes // (8 * d))))
    blocks = [(r["part"], cut(r["rows"], r["d"]), cut(r["asked"], r["d"])) for r in sizes if r["rows"] and r["asked"]]
    cuts = F.broadcast(spark.createDataFrame(blocks or [(-1, 1, 1)], "part int, cuts int, turns int"))  # one row a part or length
    keys = ["part", "cut", "turn"]

    def dealt(df: DataFrame, own: str, of: str, other: str, among: str) -> DataFrame:
        mine = df.join(cuts, "part").withColumn(own, F.pmod(F.xxhash64("id"), F.col(of)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(among) - 1))).select(*keys, "id", "v")

    held = dealt(placed.select(F.col("parts")[0].alias("part"), "id", "v"), "cut", "cuts", "turn", "turns")
    asked = dealt(placed.filter(is_query).dropDuplicates(["id", "v"]).select("id", "v", F.explode("parts").alias("part")), "turn", "turns", "cut", "cuts")
    asked = asked.select(*(F.col(k).alias(f"q_{k}") for k in (*keys, "id", "v")))
    kind = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """One row a query with its best of the block, so blocks do not multiply rows."""
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], kind)})
        counts, ids, scores = rank_block(left.column("q_id").to_numpy(), _matrix(left.column("q_v")), right.column("id").to_numpy(), _matrix(right.column("v")), top)
        values = pa.StructArray.from_arrays([pa.array(-scores), pa.array(ids)], names=["minus", "vec_id"])
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.table({"query_id": left.column("q_id"), "found": pa.ListArray.from_arrays(ends, values)})

    found = asked.groupBy(*(f"q_{k}" for k in keys)).cogroup(held.groupBy(*keys)).applyInArrow(compare, "query_id bigint, found array<struct<minus:double,vec_id:bigint>>")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(tasks, "query_id").sortWithinPartitions("query_id").mapInArrow(tidy(_merge(top)), "query_id bigint, rank int, vec_id bigint, score double")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns: the queries are the rows whose id is divisible by 20, searched among all rows. Odd rows as in ``nearest``."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
