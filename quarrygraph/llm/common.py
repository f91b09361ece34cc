"""Shared plumbing of the training-data operators: Arrow text access, word splitting, scratch tables."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every contract here: space and \t to \r.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that a worker holds a few MB of whole texts at a time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one where that is unset and the master is local (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrygraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def persist(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor. The tables of an
    application lie in folders of their own and can be deleted when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries of the session that end inside lose their shuffle files at once, else these stay until the driver
    happens to collect its garbage. Only for queries that write their result, such as ``persist``."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def spread_join(left: DataFrame, right: DataFrame, sizes: DataFrame, key: str, by: Column, how: str = "inner", least: int = 10_000, ways: int = 64) -> DataFrame:
    """``left`` with its row of ``right`` (one a key), where rows of a key that very many share are dealt to ``ways`` tasks.

    ``sizes`` is (key, n), the rows of each key in ``left``. Keys with more than 1/4096 of all rows, and more than
    ``least``, are dealt out by a hash of ``by``; there can be no more than 4096 of them, so they are broadcast.
    """
    total = sizes.agg(F.sum("n")).first()[0] or 0
    hot = [r[0] for r in sizes.filter(F.col("n") > max(least, total // 4096)).select(key).collect()]
    if not hot:
        return left.join(right, key, how)
    name = fresh([*left.columns, *right.columns], "way__")[0]
    listed = F.broadcast(left.sparkSession.createDataFrame([(k, ways) for k in hot], sizes.select(key).schema.add(name, "integer")))
    dealt = left.join(listed, key, "left").withColumn(name, F.coalesce(F.pmod(F.xxhash64(by), F.col(name)), F.lit(0).cast("bigint")))
    copies = right.join(listed, key, "left").withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(name), F.lit(1)).cast("bigint") - 1)))
    return dealt.join(copies, [key, name], how).drop(name)


def tidy(run: Callable) -> Callable:
    """``run`` over Arrow batches, after which the worker gives its free memory back; workers live on between stages."""

    @wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``taken`` has it (letter case ignored)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_key(text: Column) -> Column:
    """64-bit key of a row's text (null counts as empty); with doc_id it tells apart rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``max_bytes`` of text (one row at least)."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        base = run[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(run, base + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of a run of texts as one binary array, and the words of each text as n+1 offsets.

    A word is a maximal run without ASCII white space; words never cross texts.
    """
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] |= solid[begin]
    kept = _LOWER[data[solid]] if lower else data[solid]
    at = np.flatnonzero(first[solid])
    if not len(at):
        return pa.array([], pa.binary()), np.zeros(len(offsets), np.int64)
    starts = np.append(at, len(kept)).astype(np.int32)
    seen = np.searchsorted(np.flatnonzero(first), offsets)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(kept))]), seen


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1])


def default_tokenizer(name: str) -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
