"""Harmonic packing of token sequences, by each worker on its own, without a shuffle.

Classes are the reciprocals of the capacity: class k holds pieces of exactly capacity // k ids and
a bin of it holds exactly k pieces. A document is cut into full sequences, then its rest greedily
into the largest class sizes up to ``classes``; what is left is shorter than capacity // classes and
goes to the last class, which fills its bin in order and cuts at the bin's end. At the end of a
partition the pieces in bins that are not full are laid end to end the same way, and the very last
sequence is cut into power-of-two lengths, which need no padding. Padding is therefore at most
k - 1 ids for a bin of class k, and none elsewhere.
"""

from __future__ import annotations

import itertools
import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import default_tokenizer, gather, small_batches, table, text_slices, tidy, utf8, words

CAPACITY = 4096
END_ID = 2
_CACHE_WORDS = 1_000_000
_TRAILING = string.punctuation
#: Every special token of the tokenizer begins so.
_SPECIAL = "<|"
#: Words of one run of letters in lower case; ASCII and the Latin letters U+00C0 to U+024F, which composing leaves alone; U+0130 becomes two in lower case.
_LETTERS = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
_WORD_END = "</w>"
_LATIN = "^[\\x00-\\x7F\u00c0-\u012f\u0131-\u024f]*$"


class WordEncoder:
    """Ids of whole texts from ids of their distinct words.

    Right for tokenizers that never join ids over ASCII white space and that lower-case: a word's
    ids do not depend on its neighbours. Words go to the tokenizer as they stand, since it matches its
    special tokens and composes characters before it lower-cases; only words of composed Latin letters that
    can hold no special token are lower-cased first, for fewer distinct ones. Of these, ASCII punctuation
    after a last letter is a token run of its own, so it is encoded apart. The cache is emptied when it holds
    ``_CACHE_WORDS`` words.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)  # without offsets where it can
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}  # words as they stand in texts
        self.spans = np.zeros((1 << 16, 4), np.int32)  # of the ids of each word's head and tail: first, number
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _store(self, flat: np.ndarray, counts: np.ndarray, spans: np.ndarray, rows: np.ndarray) -> None:
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        spans[rows, 0] = self.used + np.cumsum(counts) - counts
        spans[rows, 1] = counts
        self.used += len(flat)

    def _learn(self, new: list[bytes]) -> None:
        texts = pa.array(new, pa.binary()).cast(pa.string())
        simple = pc.and_(pc.match_substring_regex(texts, _LATIN), pc.invert(pc.match_substring(texts, _SPECIAL)))
        texts = pc.if_else(simple, pc.utf8_lower(texts), texts)
        heads = pc.utf8_rtrim(texts, characters=_TRAILING)
        heads = pc.if_else(pc.and_(simple, pc.match_substring_regex(heads, r"\p{L}$")), heads, texts)
        data, ends = utf8(texts)
        sizes = pc.binary_length(heads).to_numpy()
        left = np.diff(ends) - sizes
        tails = pa.Array.from_buffers(pa.string(), len(new), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(left)]).astype(np.int32)), pa.py_buffer(data[gather(ends[:-1] + sizes, left)])])
        pieces = pa.concat_arrays([heads, tails]).dictionary_encode()
        found = pieces.dictionary
        spans = np.zeros((len(found), 2), np.int32)
        letters = pc.match_substring_regex(found, _LETTERS).to_numpy(zero_copy_only=False)
        for at in range(0, len(found), 20_000):
            part = found.slice(at, 20_000)
            alone = letters[at : at + 20_000]
            # a word of letters is one run, whose last id alone is one of a word's end, so many are encoded as one text
            whole = self.encode_batch([" ".join(part.filter(pa.array(alone)).to_pylist())], add_special_tokens=False)[0].ids
            whole = np.array(whole, np.uint32)
            counts = np.diff(np.flatnonzero(self.ends_word[whole]), prepend=-1)
            if len(counts) != alone.sum():
                raise ValueError("the tokenizer does not mark the ends of words")
            self._store(whole, counts, spans, at + np.flatnonzero(alone))
            ids = [got.ids for got in self.encode_batch(part.filter(pa.array(~alone)).to_pylist(), add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            self._store(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(counts.sum())), counts, spans, at + np.flatnonzero(~alone))
        first = len(self.known)
        self.spans = _room(self.spans, first + len(new))
        self.spans[first : first + len(new)] = spans[pieces.indices.to_numpy()].reshape(2, -1, 2).transpose(1, 0, 2).reshape(-1, 4)
        self.known.update(zip(new, range(first, first + len(new))))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and the n+1 offsets of each text's ids."""
        data, offsets = utf8(column)
        found, bounds = words(data, offsets)
        if not len(found):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        coded = found.dictionary_encode()
        if len(self.known) > _CACHE_WORDS:
            self.clear()
        distinct, known = coded.dictionary.to_pylist(), self.known
        new = [w for w in distinct if w not in known]
        if new:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        spans = self.spans[at][coded.indices.to_numpy()].reshape(-1, 2).astype(np.int64)
        ids = self.ids[gather(spans[:, 0], spans[:, 1])]
        ends = np.concatenate([[0], np.cumsum(spans[:, 1])])
        return ids, ends[2 * bounds]


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """``a``, grown to hold ``n`` rows."""
    return a if n <= len(a) else np.concatenate([a, np.zeros((max(n, 2 * len(a)) - len(a), *a.shape[1:]), a.dtype)])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Packs the documents of one worker; ``take`` and ``close`` return finished pieces as
    (document, start, ids, sequence, offset), sequence counting from 0."""

    def __init__(self, capacity: int = CAPACITY, classes: int = 16) -> None:
        self.capacity = capacity
        self.sizes = {k: capacity // k for k in range(1, classes + 1)}
        self.floor = capacity // classes
        self.bins: dict[int, list] = {k: [] for k in self.sizes}
        self.rest: list = []
        self.rest_ids = 0
        self.sequences = 0

    def _fill(self, doc, start, ids, out: list) -> None:
        """The last class: next fit, cut where the bin ends."""
        while len(ids):
            n = min(len(ids), self.capacity - self.rest_ids)
            self.rest.append((doc, start, ids[:n]))
            self.rest_ids += n
            start, ids = start + n, ids[n:]
            if self.rest_ids == self.capacity:
                self._emit(self.rest, out)
                self.rest, self.rest_ids = [], 0

    def _emit(self, pieces: list, out: list) -> None:
        at = 0
        for doc, start, ids in pieces:
            out.append((doc, start, ids, self.sequences, at))
            at += len(ids)
        self.sequences += 1

    def take(self, doc, ids: np.ndarray, out: list) -> None:
        start, n = 0, len(ids)
        while n - start >= self.floor:
            k = max(1, -(-self.capacity // (n - start)))
            while self.sizes[k] > n - start:
                k += 1
            size = self.sizes[k]
            self.bins[k].append((doc, start, ids[start : start + size]))
            start += size
            if len(self.bins[k]) == k:
                self._emit(self.bins[k], out)
                self.bins[k] = []
        self._fill(doc, start, ids[start:], out)

    def close(self, out: list) -> None:
        for k, pieces in self.bins.items():
            self.bins[k] = []
            for piece in pieces:
                self._fill(*piece, out)
        pieces, self.rest, left = self.rest, [], self.rest_ids
        self.rest_ids = 0
        size = 1 << left.bit_length()
        part: list = []
        room = 0
        for doc, start, ids in pieces:
            while len(ids):
                if not room:
                    while size > left:
                        size >>= 1
                    room = size
                n = min(room, len(ids))
                part.append((doc, start, ids[:n]))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self._emit(part, out)
                    part = []


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, classes: int = 16) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): one row a piece; ``ids`` holds
    little-endian unsigned 32-bit ids.

    Null and empty texts are the end id alone. Repeated rows are packed each on its own, and a null
    id is carried along. Texts are encoded whole; a worker keeps only the pieces of open bins, at
    most ``classes`` sequences. Sequence ids are the partition's number times 2**40 plus a count, so
    workers need no agreement and a task that runs again gives the same rows.
    """

    def run(batches):
        part = TaskContext.get().partitionId() << 40
        code, packer = encoder(tokenizer), Packer(capacity, classes)
        kind = None

        def rows(out):
            d, start, ids, seq, at = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in d], kind), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x[1] for x in d], pa.int64()), pa.array(np.array(seq, np.int64) + part), pa.array(at, pa.int64())],
                names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

        for batch in batches:
            kind = batch.column(0).type
            for piece in text_slices(batch, "text__"):
                ids, ends = code.encode(piece.column(1))
                out: list = []
                for k, doc in enumerate(piece.column(0).to_pylist()):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    packer.take((doc, len(own)), own, out)
                if out:
                    yield rows(out)
        out = []
        packer.close(out)
        if out:
            yield rows(out)

    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text__"))
    return source.mapInArrow(tidy(run), f"`{id_col}` {id_type}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def _packed(docs: DataFrame) -> DataFrame:
    return pack(docs, default_tokenizer("word_bpe_49k.json")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns over the whole ``documents`` table. Odd rows as in ``pack``; a worker holds the words and
    ids of one whole text, some 20 bytes a byte of it."""
    return _packed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left; the rows are those of the query. Null and empty texts are the end id alone, null ids are
    carried along, repeated rows are packed each on its own, extra columns are ignored, and an empty table gives
    no rows."""
    small_batches(spark)
    return _packed(docs)
