"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The n-grams (one to three letters, with word boundaries) are hashed. Document frequencies come from all
learning rows; the weights from a bounded sample of them (``per_lang`` ids a language, in hash order),
learned with follow-the-regularised-leader and elastic-net penalties, so most weights are exactly zero.
A part of the sample that learning does not see sets one temperature for the probabilities. Every language
of the learning rows is learned. Long texts are counted piece by piece, so a worker's memory does not grow
with their n-grams.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrygraph.llm.common import fresh, quoted, small_batches, table, text_slices, tidy, utf8

BITS = 16
#: Bytes of text whose n-grams a worker holds at a time; they take some 150 times as much.
_SLICE = 1 << 19
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 of any other character."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def _grams(seq: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Buckets of the runs of one, two and three symbols that begin at each place and stay in their text; -1: none."""
    m = len(seq)
    grams = np.full((3, m), -1, np.int64)
    rest = seq.copy()
    for k in range(min(3, m)):
        if k:
            rest = rest[:-1] + seq[k:] * _MIX[k]
        mixed = (rest + np.uint64(k + 1)) * _MIX[0]
        mixed = ((mixed ^ (mixed >> np.uint64(29))) * _MIX[1] >> np.uint64(64 - BITS)).astype(np.int64)
        grams[k, : m - k] = np.where(owner[: m - k] == owner[k:], mixed, -1)
    return grams


def ngram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of a run of texts, the n+1 offsets of each text's, and which texts have a letter."""
    data, offsets = utf8(column)
    n = len(offsets) - 1
    points = _points(data)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    at = heads[offsets]
    low = _letters()[points]
    doc = np.repeat(np.arange(n), np.diff(at))
    letter = low > 0
    counted = np.concatenate([[0], np.cumsum(letter, dtype=np.int64)])
    has = counted[at[1:]] > counted[at[:-1]]
    keep = letter.copy()  # one boundary after each word, and one before each text
    keep[1:] |= letter[:-1] & (doc[1:] == doc[:-1])
    seq, owner = low[keep], doc[keep]
    sizes = np.bincount(owner, minlength=n)
    starts = np.cumsum(sizes) - sizes
    seq = np.insert(seq, starts, 0).astype(np.uint64)
    grams = _grams(seq, np.repeat(np.arange(n), sizes + 1)).T.reshape(-1)
    real = grams >= 0
    ends = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])[3 * np.concatenate([[0], np.cumsum(sizes + 1)])]
    return grams[real], ends, has


def long_counts(data: np.ndarray, step: int = _SLICE) -> np.ndarray | None:
    """Count of each bucket in one text of any length, ``step`` bytes at a time; None without a letter."""
    full, at, after_letter, any_letter = np.zeros(1 << BITS, np.int64), 0, False, False
    carry = np.zeros(0, np.uint64)  # the last two symbols, whose n-grams the next piece ends
    while at < len(data):
        end = min(at + step, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        low = _letters()[_points(data[at:end])]
        letter = low > 0
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= after_letter
        new = low[keep].astype(np.uint64)
        if not at:
            new = np.insert(new, 0, 0)
        seq = np.concatenate([carry, new])
        grams = _grams(seq, np.zeros(len(seq), np.int8))
        for k in range(3):  # those that end in the new part
            part = grams[k, max(len(carry) - k, 0) : max(len(seq) - k, 0)]
            full += np.bincount(part, minlength=1 << BITS)
        carry, after_letter, any_letter, at = seq[-2:], bool(letter[-1]), any_letter or bool(letter.any()), end
    return full if any_letter else None


def counts(column: pa.Array):
    """(buckets, counts) of each text of a run; None for a text without a letter."""
    if len(column) == 1 and (pc.binary_length(column)[0].as_py() or 0) > _SLICE:
        full = long_counts(utf8(column)[0])
        at = np.flatnonzero(full) if full is not None else None
        yield None if full is None else (at, full[at])
        return
    grams, ends, has = ngram_buckets(column)
    for k in range(len(has)):
        if not has[k]:
            yield None
            continue
        full = np.bincount(grams[ends[k] : ends[k + 1]], minlength=1 << BITS)
        at = np.flatnonzero(full)
        yield at, full[at]


def _weigh(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, dim: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """Weights (dim, classes) by FTRL-proximal with per-coordinate rates, one step a row."""
    z, n = np.zeros((dim, classes)), np.zeros((dim, classes))

    def solved(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            w = solved(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return solved(np.arange(dim))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    lo, hi, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _picked(rows: DataFrame, per_lang: int) -> list[tuple]:
    """(id, lang): the first ``per_lang`` ids of each language in hash order, each id once.

    A hash limit for each language, from its number of rows, lets a few times as many ids through; it is
    raised where ids repeat so often that too few are left. Only those ids reach the driver.
    """
    spark = rows.sparkSession
    share = {r["of"]: min(1.0, 4 * per_lang / r["count"]) for r in rows.groupBy("of").count().collect()}
    picked: list[tuple] = []
    while share:
        limits = spark.createDataFrame([(k, min(int(p * 2**64), 2**64 - 1) - 2**63) for k, p in share.items()], "of string, most bigint")  # one row a language
        near = rows.withColumn("h", F.xxhash64(F.lit(7), F.col("pick"))).join(F.broadcast(limits), "of").filter(F.col("h") <= F.col("most"))
        found: dict[str, list] = {k: [] for k in share}
        for r in near.groupBy("of", "h", "pick").count().collect():
            found[r["of"]].append((r["h"], r["pick"]))
        short = {k for k, p in share.items() if len(found[k]) < per_lang and p < 1}
        picked += [(i, k) for k, ids in found.items() if k not in short for _, i in sorted(ids)[:per_lang]]
        share = {k: min(1.0, 8 * share[k]) for k in short}
    return sorted(picked)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 800) -> dict:
    """Model of the rows where ``learn`` holds and the language and id are known.

    Every row counts in the document frequencies, repeated ones each time. Of rows that repeat an id in one
    language the least text is learned from. The driver receives at most 2**16 document frequencies, and of
    each language ``per_lang`` rows of n-gram counts; its weights take half a MB a language.
    """
    rows = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("pick"), F.col(lang_col).cast("string").alias("of"), F.col(text_col).cast("string").alias("text"))

    def frequencies(batches):
        seen, total = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for piece in text_slices(batch, "text", _SLICE):
                for got in counts(piece.column(0)):
                    if got is not None:
                        seen[got[0]] += 1
                        total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], total))], names=["bucket", "n"])

    picks = _picked(rows.filter("pick IS NOT NULL").select("pick", "of"), per_lang)
    if not picks:
        return {"langs": []}
    df = rows.select("text").mapInArrow(tidy(frequencies), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = int(df.loc[df.bucket < 0, "n"].sum())
    held = np.zeros(1 << BITS)
    held[df.bucket[df.bucket >= 0]] = df.n[df.bucket >= 0]
    idf = np.log((1 + total) / (1 + held)) + 0.1

    # at most per_lang ids a language
    chosen = docs.sparkSession.createDataFrame(picks, rows.select("pick", "of").schema)
    sample = rows.join(F.broadcast(chosen), ["pick", "of"]).groupBy("of", "pick").agg(F.min("text").alias("text"))

    def featurise(batches):
        for batch in batches:
            for piece in text_slices(batch, "text", _SLICE):
                got = [(k, x) for k, x in enumerate(counts(piece.column(2))) if x is not None]
                take = pa.array([k for k, _ in got], pa.int32())
                yield pa.RecordBatch.from_arrays([piece.column(0).take(take), piece.column(1).take(take), pa.array([x[0].astype("<u2").tobytes() for _, x in got], pa.binary()), pa.array([x[1].astype("<u4").tobytes() for _, x in got], pa.binary())], names=["h", "lang", "at", "n"])

    found = sample.select(F.xxhash64(F.lit(7), "pick").alias("h"), F.col("of").alias("lang"), "text").mapInArrow(tidy(featurise), "h bigint, lang string, at binary, n binary").collect()
    langs = sorted({r["lang"] for r in found})
    if not langs:
        return {"langs": []}
    index = {k: i for i, k in enumerate(langs)}
    used = np.unique(np.concatenate([np.frombuffer(r["at"], "<u2") for r in found]).astype(np.int64))
    row_of = np.full(1 << BITS, len(used), np.int64)  # buckets that no sample text has share a last row of zeros
    row_of[used] = np.arange(len(used))
    data = []
    for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["at"], r["n"])):
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        data.append((row_of[at], _weigh(at, np.frombuffer(r["n"], "<u4"), idf), index[r["lang"]]))
    aside, learned = data[::5], [d for k, d in enumerate(data) if k % 5]
    weights = train_ftrl(learned, len(langs), len(used) + 1)
    logits = np.array([x @ weights[at] for at, x, _ in aside]).reshape(-1, len(langs))
    return {"langs": langs, "idf": idf, "row_of": row_of, "weights": weights, "temperature": fit_temperature(logits, np.array([y for *_, y in aside], int))}


def predict(docs: DataFrame, model: dict, columns: list[Column], text_col: str = "text", made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` with the predicted language and its probability as ``made``; without a letter, or without any
    learned language, ``und`` and 0."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # half a MB a language at most
    source = docs.select(*columns)
    names = source.columns
    at = names.index(text_col) if text_col in names else len(names)
    if at == len(names):
        source = docs.select(*columns, F.col(text_col))

    def run(batches):
        m = sent.value
        langs = m["langs"]
        for batch in batches:
            for piece in text_slices(batch, text_col, _SLICE):
                pred, score = [UNKNOWN] * piece.num_rows, np.zeros(piece.num_rows)
                for k, got in enumerate(counts(piece.column(at))) if langs else ():
                    if got is not None:
                        p = _softmax(_weigh(*got, m["idf"]) @ m["weights"][m["row_of"][got[0]]] / m["temperature"])
                        best = int(p.argmax())
                        pred[k], score[k] = langs[best], p[best]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in range(len(names))), pa.array(pred, pa.string()), pa.array(score)], names=[*names, *made])

    schema = StructType(source.schema.fields[: len(names)]).add(made[0], "string").add(made[1], "double")
    return source.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 1 modulo 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the whole ``documents`` table. A null id is not held out, a null or letterless text is
    ``und`` with 0; each repeated row has its own result; extra columns are ignored; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, ~held_out()), [F.col("doc_id"), held_out().alias("held_out")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.5) -> DataFrame:
    """Rejects documents without a letter and those whose calibrated probability is below ``min_score``.

    Null and empty texts have no letter. Null ids and repeated rows are judged like any row, by their text; all
    columns stay, whatever their names. Where no language can be learned, every document with a letter stays.
    An empty table stays empty."""
    small_batches(spark)
    model = fit(docs, ~held_out())
    if not model["langs"]:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs.columns, "lang__", "score__")
    judged = predict(docs, model, [quoted(c) for c in docs.columns], made=(lang, score))
    return judged.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).drop(lang, score)
