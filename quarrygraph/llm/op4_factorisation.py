"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

All pairwise interactions are scored in time linear in the features, because the sum over pairs of
<v_i, v_j> x_i x_j is half of |sum v_i x_i|^2 - sum |v_i x_i|^2. It learns by AdaGrad from a bounded
sample of labelled rows (``max_rows``, in hash order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import table, text_slices, utf8, words

BITS = 16
BINS = 16
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_BYTE_CLASSES = [
    np.isin(np.arange(256), np.arange(65, 91)),
    np.isin(np.arange(256), np.arange(48, 58)),
    _SYMBOL,
    np.arange(256) == ord("!"),
    np.arange(256) == ord("|"),
    np.isin(np.arange(256), list(b".,;:?")),
    np.arange(256) == 10,
    np.arange(256) >= 128,
]
#: Byte-class shares, then: log bytes, log words, mean word length, distinct share, share of the commonest
#: word, share of words equal to the one before, and the metadata column of characters.
N_STATS = len(_BYTE_CLASSES) + 7
_PRIME = np.uint64(0x100000001B3)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(found: pa.Array, step: int = 4 << 20) -> np.ndarray:
    """64-bit polynomial hash of each word of a binary array without nulls, some ``step`` bytes of words at once."""
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    _, ends, data = found.buffers()
    ends = np.frombuffer(ends, np.int32)[: n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    out, first = np.empty(n, np.uint64), 0
    inverse = pow(int(_PRIME), -1, 1 << 64)
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + step, side="right")) - 1)
        at = ends[first : last + 1] - ends[first]
        part = data[ends[first] : ends[last]]
        with np.errstate(over="ignore"):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _powers(len(part), int(_PRIME)), dtype=np.uint64)])
            h = (run[at[1:]] - run[at[:-1]]) * _powers(len(part) + 1, inverse)[at[:-1]]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            out[first:last] = h ^ (h >> np.uint64(29))
        first = last
    return out


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each class each text has."""
    if len(offsets) == 2:  # a text by itself may be long
        tally = np.bincount(data, minlength=256)
        return np.array([[tally[chosen].sum() for chosen in _BYTE_CLASSES]])
    out = np.empty((len(offsets) - 1, len(_BYTE_CLASSES)), np.int64)
    for k, chosen in enumerate(_BYTE_CLASSES):
        run = np.concatenate([[0], np.cumsum(chosen[data], dtype=np.int64)])
        out[:, k] = run[offsets[1:]] - run[offsets[:-1]]
    return out


def raw_features(column: pa.Array, chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run of texts: row and bucket of each distinct hashed word, its L2-normalised count, and the statistics."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    stats = np.zeros((n, N_STATS))
    stats[:, : len(_BYTE_CLASSES)] = _class_counts(data, offsets) / size[:, None]
    found, bounds = words(data, offsets, lower=True)
    hashes = word_hashes(found)
    n_words = np.diff(bounds)
    rows = np.repeat(np.arange(n), n_words)
    keys, tally = np.unique((rows << BITS) | (hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    row, bucket = keys >> BITS, keys & ((1 << BITS) - 1)
    norm = np.sqrt(np.bincount(row, tally.astype(float) ** 2, minlength=n))
    k = len(_BYTE_CLASSES)
    most = np.zeros(n)
    np.maximum.at(most, row, tally)
    again = np.zeros(len(rows), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    several = np.maximum(n_words, 1)
    word_bytes = np.bincount(rows, np.diff(np.frombuffer(found.buffers()[1], np.int32)[: len(found) + 1]), minlength=n) if len(found) else np.zeros(n)
    stats[:, k : k + 6] = np.stack([np.log1p(np.diff(offsets)), np.log1p(n_words), word_bytes / several, np.bincount(row, minlength=n) / several, most / several, np.bincount(rows, again, minlength=n) / several], 1)
    stats[:, k + 6] = np.log1p(np.maximum(chars.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False), 0))  # nan: a bin of its own
    return row, bucket, tally / norm[row], stats


def stat_columns(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature number of each statistic's bin, after the word buckets; bin BINS is for missing values."""
    out = np.empty(stats.shape, np.int64)
    for k in range(stats.shape[1]):
        out[:, k] = (1 << BITS) + k * (BINS + 1) + np.where(np.isnan(stats[:, k]), BINS, np.searchsorted(edges[k], stats[:, k], side="right"))
    return out


DIM = (1 << BITS) + N_STATS * (BINS + 1)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], factors: int = 8, epochs: int = 6, rate: float = 0.1, l2: float = 1e-5, seed: int = 11) -> dict:
    """AdaGrad on the log loss, one step a row in a shuffled order."""
    rng = np.random.default_rng(seed)
    w0, w, v = 0.0, np.zeros(DIM), rng.normal(0, 0.02, (DIM, factors))
    gw, gv, g0 = np.full(DIM, 1e-2), np.full((DIM, factors), 1e-2), 1e-2
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            va = v[at]
            vx = va * x[:, None]
            s = vx.sum(0)
            z = w0 + w[at] @ x + 0.5 * (s @ s - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            d = g * x + l2 * w[at]
            gw[at] += d * d
            w[at] -= rate * d / np.sqrt(gw[at])
            d = g * x[:, None] * (s - vx) + l2 * va
            gv[at] += d * d
            v[at] -= rate * d / np.sqrt(gv[at])
            g0 += g * g
            w0 -= rate * g / np.sqrt(g0)
    return {"w0": w0, "w": w, "v": v}


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", max_rows: int = 6000) -> dict | None:
    """Model of at most ``max_rows`` labelled ids where ``learn`` (over the id) holds; None without any.

    Of rows that repeat an id the least (text, characters) is learned from, and the least of its labels.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
    picked = known.groupBy(F.col(id_col).alias("pick__")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64(F.lit(5), "pick__"), "pick__").limit(max_rows).collect()
    if not picked:
        return None
    picks = spark.createDataFrame([(r["pick__"], r["label"]) for r in picked], "pick__ bigint, label__ int")

    def featurise(batches):
        for batch in batches:
            for piece in text_slices(batch, "text"):
                row, bucket, x, stats = raw_features(piece.column(2), piece.column(3))
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
                cells = [(bucket[s:e].astype("<i4").tobytes(), x[s:e].astype("<f4").tobytes()) for s, e in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary()), pa.array(list(stats))], names=["h", "label", "at", "x", "stats"])

    # the picks are at most max_rows ids
    rows = docs.select(F.col(id_col).alias("pick__"), F.struct(F.col(text_col).cast("string").alias("text"), F.col(chars_col).cast("long").alias("chars")).alias("row"))
    sample = rows.join(F.broadcast(picks), "pick__").groupBy("pick__", "label__").agg(F.min("row").alias("row"))
    sample = sample.select(F.xxhash64(F.lit(5), "pick__").alias("h"), F.col("label__").alias("label"), "row.text", "row.chars")
    found = sorted(sample.mapInArrow(featurise, "h bigint, label int, at binary, x binary, stats array<double>").collect(), key=lambda r: (r["h"], r["at"]))
    if not found:
        return None
    stats = np.array([r["stats"] for r in found])
    with np.errstate(all="ignore"):
        edges = np.nan_to_num(np.array([np.nanquantile(c, np.arange(1, BINS) / BINS) if np.isfinite(c).any() else np.zeros(BINS - 1) for c in stats.T]))
    cols = stat_columns(stats, edges)
    share = np.full(N_STATS, N_STATS**-0.5)
    rows = [(np.concatenate([np.frombuffer(r["at"], "<i4"), c]), np.concatenate([np.frombuffer(r["x"], "<f4").astype(float), share]), r["label"]) for r, c in zip(found, cols)]
    return train(rows) | {"edges": edges}


def score(docs: DataFrame, model: dict | None, columns: list[Column], text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``columns`` with ``score``, the probability of label 1; 0.5 for every row without a model."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIM rows of 1 + factors numbers
    source = docs.select(*columns, F.col(text_col).alias("text__"), F.col(chars_col).cast("long").alias("chars__"))
    names = source.columns[:-2]

    def run(batches):
        m = sent.value
        for batch in batches:
            for piece in text_slices(batch, "text__"):
                n = piece.num_rows
                if m is None:
                    p = np.full(n, 0.5)
                else:
                    row, bucket, x, stats = raw_features(piece.column(len(names)), piece.column(len(names) + 1))
                    cols = stat_columns(stats, m["edges"])
                    z = m["w0"] + np.bincount(row, m["w"][bucket] * x, minlength=n) + m["w"][cols].sum(1) * N_STATS**-0.5
                    for f in range(m["v"].shape[1]):
                        v = m["v"][:, f]
                        vx, vs = v[bucket] * x, v[cols] * N_STATS**-0.5
                        total = np.bincount(row, vx, minlength=n) + vs.sum(1)
                        z += 0.5 * (total * total - np.bincount(row, vx * vx, minlength=n) - (vs * vs).sum(1))
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(p)], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    return source.mapInArrow(run, f"{schema}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op4_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the whole ``documents`` table. Null and empty texts are scored by their statistics, a
    null count of characters by a bin of its own; a null id is not held out and has no label. Each repeated row
    has a result of its own; extra columns are ignored; an empty table gives no rows, and without any label
    every score is 0.5. A worker holds one whole text, and some 30 bytes a word of it."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score(docs, model, [F.col("doc_id"), held_out().alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
