"""Line dedup: range-partitioned line hashes, streamed in (hash, document, position) order.

The range partitioning is on (hash, document), so a line that a third of all documents hold is
spread over many partitions. Each partition streams its rows once and decides all of them but
those of its first hash, which may have begun in an earlier partition; these wait for one
boundary row per partition. What comes back is a compressed bitmap of kept lines for each
document that loses any, never text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import SPACES, fresh, persist, small_batches, table, text_key, tidy

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = np.iinfo(np.int64).max
_OUT = "kind string, part int, h1 bigint, h2 bigint, id bigint, no_id boolean, tkey bigint, pos int, n_lines int, last1 bigint, last2 bigint, last_id bigint"


def _stream(batches):
    """One pass over a partition sorted by (h1, h2, id): rows to drop, rows of the first hash, one boundary row."""
    part = TaskContext.get().partitionId()
    carry = None  # hash and smallest id of the run that is open
    first = None

    def rows(kind, take, cols):
        n = len(take)
        filled = {"kind": pa.array([kind] * n, pa.string()), "part": pa.array(np.full(n, part, np.int32))}
        filled |= {k: pa.array(v[take]) for k, v in cols.items()}
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays(
            [filled[k] for k in ("kind", "part", "h1", "h2", "id", "no_id", "tkey", "pos", "n_lines")] + [none] * 3,
            names=["kind", "part", "h1", "h2", "id", "no_id", "tkey", "pos", "n_lines", "last1", "last2", "last_id"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("h1", "h2", "id", "no_id", "tkey", "pos", "n_lines")}
        start = np.ones(batch.num_rows, bool)
        start[1:] = (c["h1"][1:] != c["h1"][:-1]) | (c["h2"][1:] != c["h2"][:-1])
        same = carry is not None and carry[:2] == (c["h1"][0], c["h2"][0])
        at = np.maximum.accumulate(np.where(start, np.arange(batch.num_rows), 0))
        low = c["id"][at]
        if same:
            run = int(np.argmax(start[1:])) + 1 if start[1:].any() else batch.num_rows
            low[:run] = carry[2]
        if first is None:
            first = (c["h1"][0], c["h2"][0], c["id"][0])
        leading = (c["h1"] == first[0]) & (c["h2"] == first[1])
        yield rows("drop", np.flatnonzero(~leading & (c["id"] != low)), c)
        yield rows("first", np.flatnonzero(leading), c)
        carry = (c["h1"][-1], c["h2"][-1], low[-1])
    if carry is not None:
        values = ["edge", part, first[0], first[1], first[2], False, 0, 0, 0, *carry]
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 3, pa.bool_(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
        names = ["kind", "part", "h1", "h2", "id", "no_id", "tkey", "pos", "n_lines", "last1", "last2", "last_id"]
        yield pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, (str, bool)) else int(v)], k) for v, k in zip(values, kinds)], names=names)


def _bitmaps(batches):
    for batch in batches:
        maps, dropped = [], []
        for positions, n in zip(batch.column("dropped"), batch.column("n_lines").to_pylist()):
            keep = np.ones(n, np.uint8)
            keep[positions.values.to_numpy()] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
            dropped.append(int(n - keep.sum()))
        cols = [batch.column(k) for k in ("id", "no_id", "tkey")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], names=["id", "no_id", "tkey", "n_dropped", "keep"])


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, no_id, tkey, n_dropped, keep): a zlib-compressed bitmap, first line in the highest bit, of each
    document that loses lines. Documents without a row here keep every line.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points found under two ids lose all lines but those of the smallest id.
    A null id counts as the largest one; rows that repeat an id count as one document for the key
    and are told apart by ``tkey``, a hash of their text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col), F.lit(_NULL_ID)).alias("id"), F.col(id_col).isNull().alias("no_id"), text_key(F.col(text_col)).alias("tkey"), F.split(text, "\n", -1).alias("lines"))
    lines = base.select("id", "no_id", "tkey", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    key = F.translate(F.trim("line", F.lit(SPACES)), _UPPER, _LOWER)
    hashed = lines.withColumn("key", key).filter(F.length("key") >= min_chars)
    # Written once: the range bounds are found by a pass of their own, which would split and hash all texts again.
    hashed = persist(hashed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "id", "no_id", "tkey", "pos", "n_lines"), "line-hashes")
    order = ["h1", "h2", "id"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "tkey", "pos")
    found = persist(ranged.mapInArrow(tidy(_stream), _OUT), "lines")

    # One row per partition: the open hash at its end says which first hashes go on.
    edges = sorted(found.filter("kind = 'edge'").select("part", "h1", "h2", "last1", "last2", "last_id").collect())
    carried, last = [], None
    for part, h1, h2, last1, last2, last_id in edges:
        goes_on = last is not None and last[:2] == (h1, h2)
        low = last[2] if goes_on else None
        carried.append((part, low))
        last = (last1, last2, low if goes_on and (last1, last2) == (h1, h2) else last_id)
    carried = docs.sparkSession.createDataFrame(carried, "part int, low bigint")
    sure = found.filter("kind = 'drop'").select("id", "no_id", "tkey", "pos", "n_lines")
    # Of a first hash that began here, the partition's own first id is the smallest. Both sides hold one row a partition.
    starts = found.filter("kind = 'edge'").select("part", F.col("id").alias("own_low"))
    first = found.filter("kind = 'first'").join(F.broadcast(carried), "part").join(F.broadcast(starts), "part")
    first = first.filter(F.col("id") != F.coalesce("low", "own_low")).select("id", "no_id", "tkey", "pos", "n_lines")
    lost = sure.unionByName(first).groupBy("id", "no_id", "tkey").agg(F.collect_list("pos").alias("dropped"), F.first("n_lines").alias("n_lines"))
    return lost.mapInArrow(_bitmaps, "id bigint, no_id boolean, tkey bigint, n_dropped bigint, keep binary")


def apply_bitmap(text: str | None, keep: bytes | None) -> str:
    text = text or ""
    if keep is None:
        return text
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join([lines[i] for i in np.flatnonzero(bits).tolist()])


def with_bitmaps(docs: DataFrame, maps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` with its bitmap and how many lines it drops (null: nothing is dropped), and their names."""
    own, keep, dropped = fresh([*docs.columns, "id__", "tkey__"], "own_key__", "keep__", "dropped__")
    right = maps.select(F.when(~F.col("no_id"), F.col("id")).alias("id__"), F.col("tkey").alias("tkey__"), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))
    left = docs.withColumn(own, text_key(F.col(text_col)))
    joined = left.join(right.hint("shuffle_hash"), left[id_col].eqNullSafe(right["id__"]) & (left[own] == right["tkey__"]), "left")
    return joined.drop(right["id__"], right["tkey__"]).drop(own), keep, dropped


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the whole ``documents`` table, derived from the bitmaps. A null text is one empty line;
    null and repeated ids as in ``line_bitmaps``, each repeated row with a result of its own; extra columns are
    ignored; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined, keep_col, dropped_col = with_bitmaps(docs, line_bitmaps(docs))

    def run(batches):
        for batch in batches:
            hashes, counts = [], []
            for text, keep in zip(batch.column("text"), batch.column(keep_col)):
                text = text.as_py()
                hashes.append(hashlib.sha256(apply_bitmap(text, keep.as_py()).encode()).hexdigest())
                counts.append((text or "").count("\n") + 1)
            dropped = batch.column(dropped_col).fill_null(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), dropped, pa.array(hashes)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return joined.mapInArrow(tidy(run), "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
k AS (SELECT k, min(doc_id) AS low, count(DISTINCT doc_id) AS n FROM lines WHERE length(k) >= 10 GROUP BY k),
v AS (SELECT l.doc_id, l.pos, l.line, (k.n >= 2 AND l.doc_id <> k.low) IS TRUE AS gone FROM lines l LEFT JOIN k ON l.k = k.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by its kept lines; a document left without any text goes, null and empty texts among
    them. Null and repeated ids as in ``line_bitmaps``; extra columns stay, whatever their names; an empty
    table stays empty."""
    small_batches(spark)
    cols = docs.columns
    joined, keep_col, _ = with_bitmaps(docs, line_bitmaps(docs))

    def run(batches):
        for batch in batches:
            texts = [t.as_py() if k.as_py() is None else apply_bitmap(t.as_py(), k.as_py()) for t, k in zip(batch.column("text"), batch.column(keep_col))]
            yield batch.select(cols).set_column(cols.index("text"), "text", pa.array(texts, pa.string()))

    kept = joined.mapInArrow(tidy(run), docs.schema)
    return kept.filter(F.length(F.trim("text", F.lit(SPACES))) > 0).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
