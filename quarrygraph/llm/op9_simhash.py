"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

Fingerprints are cut into bit blocks. Two within ``radius`` differ in at most that many blocks, so they agree
exactly on all blocks of some choice that leaves ``radius`` out: the tiles are the fingerprints that agree on a
choice. There are ``radius + 1`` blocks, and more in larger tables, so that tiles of unrelated fingerprints
keep their size. A tile with more than ``max_tile`` fingerprints is cut by population count into bands, and
bands into chunks; pairs of chunks whose population counts differ by more than the radius are never made,
every other pair is compared exactly, again skipping sub-tiles too far apart. Each tile returns a spanning
forest of its links, never all of them, so groups of copies do not multiply.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrygraph.llm.common import fresh, persist, small_batches, spread_join, table, text_key, tidy
from quarrygraph.llm.components import connected_components

_BITS = 64
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n < shingle:
        counts, n = np.unpackbits(np.frombuffer(digest(b" ".join(words), seed), np.uint8)).astype(np.int64), 1
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
        ends = ends[shingle - 1 :].tolist()
        n = len(starts)
        counts = np.zeros(_BITS, np.int64)
        for at in range(0, n, _STEP):
            raw = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + _STEP], ends[at : at + _STEP])])
            counts += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, _BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) for every row; fp holds the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"id {kind}, fp bigint")


class Forest:
    """Union-find over 0..n-1 on arrays; a root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def union(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            while True:  # flatten
                up = self.parent[self.parent]
                if np.array_equal(up, self.parent):
                    break
                self.parent = up
            a, b = self.parent[u], self.parent[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def edges(self) -> np.ndarray:
        return np.flatnonzero(self.parent != np.arange(len(self.parent)))


def tile_links(fps: np.ndarray, side: np.ndarray | None, radius: int, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one tile. With ``side``, only pairs of different sides are compared."""
    pops = np.bitwise_count(fps)
    order = np.argsort(pops, kind="stable")
    f, pops = fps[order], pops[order].astype(np.int16)
    s = side[order] if side is not None else None
    forest, n = Forest(len(f)), len(f)
    for i in range(0, n, step):
        rows = f[i : i + step, None]
        top = pops[min(i + step, n) - 1]
        for j in range(i, n, step):
            if pops[j] - top > radius:
                break  # and so do all later ones
            near = np.bitwise_count(rows ^ f[None, j : j + step]) <= radius
            if s is not None:
                near &= s[i : i + step, None] != s[None, j : j + step]
            u, v = np.nonzero(near)
            u, v = u + i, v + j
            ahead = u < v
            if ahead.any():
                forest.union(u[ahead], v[ahead])
    at = forest.edges()
    return f[at], f[forest.parent[at]]


def choices(n: int, radius: int, max_tile: int) -> list[int]:
    """Masks of the block choices for ``n`` fingerprints: as few blocks as leave ``max_tile`` unrelated ones a tile."""
    blocks = radius + 1
    while n >> (_BITS * (blocks - radius) // blocks) > max_tile and blocks < 2 * radius:
        blocks += 1
    cuts = [_BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(blocks)]
    return [sum(c) for c in itertools.combinations(masks, blocks - radius)]


def tiles(distinct: DataFrame, radius: int = 4, max_tile: int = 8192) -> DataFrame:
    """(blk, val, lo, hi, side, fp): each fingerprint in every tile, or pair (lo, hi) of chunks of a tile, it takes part in."""
    masks = choices(distinct.count(), radius, max_tile)
    signed = [m - (1 << _BITS) if m >> (_BITS - 1) else m for m in masks]
    parts = [F.struct(F.lit(k).alias("blk"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("val")) for k, m in enumerate(signed)]
    rows = distinct.select("fp", F.explode(F.array(*parts)).alias("t")).select("t.blk", "t.val", F.bit_count("fp").alias("pop"), "fp")
    tile = Window.partitionBy("blk", "val")
    bands = rows.groupBy("blk", "val", "pop").agg(F.count("*").alias("n"))
    bands = bands.withColumn("all", F.sum("n").over(tile)).filter(F.col("all") > max_tile)  # at most 65 rows a tile
    before = F.sum("n").over(tile.orderBy("pop")) - F.col("n")
    bands = bands.withColumn("band", F.floor(before / max_tile).cast("int"))
    band = bands.groupBy("blk", "val", "band").agg(F.min("pop").alias("least"), F.max("pop").alias("most"), F.ceil(F.sum("n") / max_tile).cast("int").alias("cut"))
    other = band.select("blk", "val", *(F.col(c).alias(f"{c}2") for c in ("band", "least", "most", "cut")))
    near = band.join(other, ["blk", "val"]).filter((F.col("least2") - F.col("most") <= radius) & (F.col("least") - F.col("most2") <= radius))
    near = near.groupBy("blk", "val", "band", "cut").agg(F.collect_list(F.struct("band2", "cut2")).alias("near"))
    dealt = bands.select("blk", "val", "pop", "band").join(near, ["blk", "val", "band"])
    code = lambda b, c: b.cast("bigint") * (1 << 32) + c
    rows = rows.join(dealt, ["blk", "val", "pop"], "left")
    own = F.coalesce(code(F.col("band"), F.pmod(F.xxhash64("fp"), F.col("cut"))), F.lit(0).cast("bigint"))
    chunks = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0).cast("bigint"), x["cut2"].cast("bigint") - 1), lambda c: code(x["band2"], c))))
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.coalesce(chunks, F.array(F.lit(0).cast("bigint")))))
    # A chunk meets itself in the tile (own, own); elsewhere only pairs of different sides count.
    return rows.select("blk", "val", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")


def links(distinct: DataFrame, radius: int = 4, max_tile: int = 8192) -> DataFrame:
    """(a, b): links that connect what all pairs within ``radius`` connect, over distinct fingerprints ``fp``."""
    keys = ["blk", "val", "lo", "hi"]
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tiles(distinct, radius, max_tile).repartition(parts, *keys).sortWithinPartitions(*keys)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(piece: pa.Table):
            key = [piece.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            fp, side = piece.column("fp").to_numpy().view(np.uint64), piece.column("side").to_numpy()
            out = []
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(fp)]):
                if e - s > 1:
                    out.append(tile_links(fp[s:e], None if key[2][s] == key[3][s] else side[s:e], radius))
            a = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.uint64)
            b = np.concatenate([x[1] for x in out]) if out else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(k).to_numpy() for k in keys]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
                yield flush(pa.Table.from_batches(held))
                held = []
            if len(new):
                last = int(new[-1])
                yield flush(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield flush(pa.Table.from_batches(held))

    return rows.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id_col, fp long, component_id) for every row of ``docs``.

    Null and empty texts have the fingerprint 0 and link like any other. Rows that repeat an id
    are rows of their own. A null id is never a component's id unless all its members are null.
    Other columns are ignored; an empty table gives no rows.
    """
    fps = persist(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    distinct = persist(fps.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")), "simhash-distinct")
    roots = connected_components(links(distinct.select("fp"), radius))
    classes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return spread_join(fps, named, distinct.select("fp", "n"), "fp", F.col("id")).select(F.col("id").alias(id_col), "fp", "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the whole ``documents`` table. Odd rows as in ``near_duplicates``. A worker holds one
    whole text, its words and the hashes of one slice of its shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: the least by id (null ids last), then by text key. Of rows that repeat both
    id and text one is kept, whichever. Null and empty texts form a group; all columns stay, whatever their
    names; an empty table stays empty."""
    small_batches(spark)
    tkey, name = fresh(docs.columns, "tkey__", "row__")
    rows = docs.withColumn(tkey, text_key(F.col("text")))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(tkey).alias("tkey"))
    named = persist(near_duplicates(rows.select(row.alias("id"), "text"), id_col="id").select(F.col("id").alias(name), "component_id"), "near-duplicates")
    own = named.filter(F.col(name) == F.col("component_id")).groupBy(name).agg(F.count("*").alias("rows"))
    kept = own.select(F.col(f"{name}.doc_id").alias("id__"), F.col(f"{name}.tkey").alias("key__"))
    repeated = not own.filter("rows > 1").isEmpty()
    same = rows["doc_id"].eqNullSafe(kept["id__"]) & (rows[tkey] == kept["key__"])
    one = rows.join(kept.hint("shuffle_hash"), same, "left_semi")
    return (one.dropDuplicates(["doc_id", tkey]) if repeated else one).drop(tkey)
