"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces come from a SentencePiece model file. A unigram file brings its own log scores; a file of merge
ranks has none, so ranks are read as log probabilities of Zipf's law. A character that no piece covers
costs more than any piece and falls back to its bytes. White space is the marker U+2581, one is put before
the text, and decoding turns markers back into spaces.

Texts are cut where no piece can cross (before a run of markers, around line ends), and equal segments
are solved once a worker; all segments of one length are solved together, one position at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import default_tokenizer, gather, table, text_slices, utf8

MARKER = "▁"
_MARK = MARKER.encode()
_NORMAL, _USER, _BYTE = 1, 4, 6
UNK_PENALTY = 10.0
_CACHE = 1_000_000
_LONG = 160


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of the fields of one protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def read_pieces(data: bytes) -> tuple[list[tuple[str, float, int]], int]:
    """(piece, score, type) of each id of a model file, and the model's type (1 unigram, 2 BPE)."""
    pieces, kind = [], 1
    for number, value in _fields(data):
        if number == 1:
            f = dict(_fields(value))
            score = float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0])
            pieces.append((f[1].decode(), score, f.get(3, _NORMAL)))
        elif number == 2:
            kind = dict(_fields(value)).get(3, 1)
    return pieces, kind


def log_scores(pieces: list[tuple[str, float, int]], kind: int) -> list[float]:
    """Log scores of the pieces; ranks of a merge model become -log(rank + 1) - log(harmonic sum)."""
    if kind == 1:
        return [s for _, s, _ in pieces]
    ranks = [min(-s, float(len(pieces))) for _, s, _ in pieces]
    total = math.log(sum(1 / (k + 1) for k in range(len(pieces))))
    return [float(np.float32(-math.log(r + 1) - total)) for r in ranks]


class DoubleArray:
    """Trie of byte strings in two arrays: the child of ``s`` by byte ``b`` is ``base[s] + b`` if ``check`` of it is ``s``."""

    def __init__(self, keys: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        leaf: list[int] = [-1]
        for value, key in enumerate(keys):
            node = 0
            for byte in key:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    leaf.append(-1)
                node = children[node][byte]
            leaf[node] = value
        size = len(children) * 2 + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place = [0] * len(children)
        value[0] = leaf[0]
        start, todo = 1, [0]
        while todo:
            node = todo.pop()
            kids = children[node]
            if not kids:
                continue
            codes = np.array(sorted(kids), np.int64)
            at = start
            while True:
                if at + 256 >= len(free):
                    grow = len(free)
                    base, check, value = (np.concatenate([a, np.full(grow, f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                    free = np.concatenate([free, np.ones(grow, bool)])
                # the first child goes to the next free slot that leaves room for all others
                slot = at + int(np.argmax(free[at:]))
                if slot >= codes[0] and free[slot - codes[0] + codes].all():
                    break
                at = slot + 1
            here = place[node]
            base[here] = slot - codes[0]
            for code in codes.tolist():
                k, s = kids[code], int(base[here]) + code
                free[s], check[s], value[s], place[k] = False, here, leaf[k], s
                todo.append(k)
            while not free[start]:
                start += 1
        last = int(np.flatnonzero(~free)[-1]) + 257
        self.base, self.check, self.value = base[:last].copy(), check[:last].copy(), value[:last].copy()


@dataclass
class Model:
    """What encoding and decoding need; its size is bounded by the piece file."""

    trie: DoubleArray
    ids: np.ndarray  # id of each key of the trie
    scores: np.ndarray
    unk: float
    bytes_: np.ndarray  # id of each byte piece
    longest: int
    cut_lines: bool
    text: np.ndarray  # bytes of all ids, one after the other
    ends: np.ndarray


def load(path: str) -> Model:
    with open(path, "rb") as f:
        pieces, kind = read_pieces(f.read())
    scores = log_scores(pieces, kind)
    keys = {p.encode(): i for i, (p, _, t) in enumerate(pieces) if t in (_NORMAL, _USER) and p}
    of_byte = np.zeros(256, np.uint32)
    shown = []
    for i, (p, _, t) in enumerate(pieces):
        if t == _BYTE:
            of_byte[int(p[3:5], 16)] = i
            shown.append(bytes([int(p[3:5], 16)]))
        else:
            shown.append(p.encode() if t in (_NORMAL, _USER) else b"")
    order = sorted(keys)
    ids = np.array([keys[k] for k in order], np.uint32)
    own = np.array([scores[i] for i in ids])
    crossing = [k for k in order if MARKER in k.decode().lstrip(MARKER)]
    if crossing:
        raise ValueError("a piece holds a marker after another character")
    return Model(DoubleArray(order), ids, own, own.min() - UNK_PENALTY, of_byte, max(map(len, order)), not any(b"\n" in k for k in order), np.frombuffer(b"".join(shown), np.uint8), np.concatenate([[0], np.cumsum([len(s) for s in shown])]))


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def viterbi(m: Model, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentation of each row of ``block`` (n, length) of UTF-8 bytes: the start and the key of the piece
    that ends at each position (key -1: a character without a piece)."""
    n, length = block.shape
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    start, key = np.zeros((n, length + 1), np.int16), np.full((n, length + 1), -1, np.int32)
    base, check, value = m.trie.base, m.trie.check, m.trie.value
    for s in range(length):
        rows = np.flatnonzero((block[:, s] & 0xC0) != 0x80)
        if not len(rows):
            continue
        width = _char_bytes(block[rows, s])
        alone = np.zeros(n, bool)
        alive, state = rows, np.zeros(len(rows), np.int64)
        for e in range(s, min(length, s + m.longest)):
            step = base[state] + block[alive, e].astype(np.int64)
            ok = check[step] == state
            alive, state = alive[ok], step[ok]
            if not len(alive):
                break
            found = value[state]
            hit = found >= 0
            r, f = alive[hit], found[hit]
            total = best[r, s] + m.scores[f]
            better = total > best[r, e + 1]
            r, f = r[better], f[better]
            best[r, e + 1], start[r, e + 1], key[r, e + 1] = total[better], s, f
            whole = alive[hit]
            alone[whole[_char_bytes(block[whole, s]) == e + 1 - s]] = True
        lacks = ~alone[rows]
        for w in range(1, 5):
            r = rows[lacks & (width == w)]
            if len(r) and s + w <= length:
                total = best[r, s] + m.unk
                r, total = r[total > best[r, s + w]], total[total > best[r, s + w]]
                best[r, s + w], start[r, s + w], key[r, s + w] = total, s, -1
    return start, key


def _long_segment(m: Model, text: bytes) -> list[int]:
    """The same for one long segment, position by position."""
    n = len(text)
    best, back = [-math.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    base, check, value, scores = m.trie.base, m.trie.check, m.trie.value, m.scores
    for s in range(n):
        lead = text[s]
        if lead & 0xC0 == 0x80:
            continue
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        alone, state = False, 0
        for e in range(s, min(n, s + m.longest)):
            step = int(base[state]) + text[e]
            if check[step] != state:
                break
            state = step
            k = int(value[state])
            if k >= 0:
                alone |= e + 1 - s == width
                total = best[s] + scores[k]
                if total > best[e + 1]:
                    best[e + 1], back[e + 1] = total, (s, k)
        if not alone and s + width <= n and best[s] + m.unk > best[s + width]:
            best[s + width], back[s + width] = best[s] + m.unk, (s, -1)
    out: list[int] = []
    at = n
    while at:
        s, k = back[at]
        out += [int(m.ids[k])] if k >= 0 else [int(m.bytes_[b]) for b in reversed(text[s:at])]
        at = s
    return out[::-1]


class PieceEncoder:
    """Encodes runs of texts; keeps the ids of segments that it has solved, up to ``_CACHE`` of them."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.spans = np.zeros((1 << 16, 2), np.int64)

    def _store(self, words: list[bytes], ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        k = len(self.known)
        while k + len(words) > len(self.spans):
            self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])
        self.ids[self.used : self.used + len(ids)] = ids
        ends = np.cumsum(counts)
        self.spans[k : k + len(words), 0] = self.used + ends - counts
        self.spans[k : k + len(words), 1] = counts
        self.known.update(zip(words, range(k, k + len(words))))
        self.used += len(ids)

    def _learn(self, new: list[bytes]) -> None:
        m = self.model
        by_length: dict[int, list[bytes]] = {}
        shown = [w.replace(b" ", _MARK) for w in new]
        for w, s in zip(new, shown):
            by_length.setdefault(len(s), []).append(w)
        for length, group in by_length.items():
            if length > _LONG:
                for w in group:
                    ids = np.array(_long_segment(m, w.replace(b" ", _MARK)), np.uint32)
                    self._store([w], ids, np.array([len(ids)]))
                continue
            for at in range(0, len(group), 1 << 16):
                part = group[at : at + (1 << 16)]
                block = np.frombuffer(b"".join([w.replace(b" ", _MARK) for w in part]), np.uint8).reshape(len(part), length)
                start, key = viterbi(m, block)
                n = len(part)
                out = np.zeros((n, length), np.uint32)
                used = np.zeros((n, length), bool)
                at_end, rows = np.full(n, length), np.arange(n)
                while len(rows):
                    e = at_end[rows]
                    k, s = key[rows, e], start[rows, e].astype(np.int64)
                    real = k >= 0
                    out[rows[real], s[real]] = m.ids[k[real]]
                    used[rows[real], s[real]] = True
                    for r, b, f in zip(rows[~real], s[~real], e[~real]):
                        out[r, b:f] = m.bytes_[block[r, b:f]]
                        used[r, b:f] = True
                    at_end[rows] = s
                    rows = rows[s > 0]
                self._store(part, out[used], used.sum(1))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts and the n+1 offsets of each text's. Empty texts have none."""
        data, offsets = utf8(column)
        if _MARK in data.tobytes():  # the marker itself reads as a space
            return self.encode(pa.array([(t or "").replace(MARKER, " ") for t in column.to_pylist()], pa.string()))
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        full = sizes > 0
        begins = offsets[:-1][full]
        data = np.insert(data, begins, 32)
        offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        space = data == 32
        first = space.copy()
        first[1:] &= ~space[:-1]
        if self.model.cut_lines:
            line = data == 10
            first |= line
            first[1:] |= line[:-1]
        first[offsets[:-1][full]] = True
        at = np.flatnonzero(first)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = found.dictionary_encode()
        if len(self.known) > _CACHE:
            self.clear()
        distinct = coded.dictionary.to_pylist()
        self._learn([w for w in distinct if w not in self.known])
        known = self.known
        spans = self.spans[np.fromiter((known[w] for w in distinct), np.int64, len(distinct))][coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(spans[:, 1])])
        seen = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
        return self.ids[gather(spans[:, 0], spans[:, 1])], ends[seen[offsets]]


def decode(m: Model, ids: np.ndarray, ends: np.ndarray) -> list[str]:
    """Texts of runs of ids: bytes of all pieces, markers as spaces, without the marker put before the text."""
    starts = m.ends[ids]
    sizes = m.ends[ids + 1] - starts
    data = m.text[gather(starts, sizes)].tobytes()
    cut = np.concatenate([[0], np.cumsum(sizes)])[ends].tolist()
    return [data[s:e].replace(_MARK, b" ")[1:].decode("utf-8", "replace") for s, e in zip(cut[:-1], cut[1:])]


def encode_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary of little-endian unsigned 32-bit ids, decoded string), one row a row of ``docs``.

    Null and empty texts have no ids and decode to the empty text. Nothing depends on other rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the piece file
    kept: dict[str, PieceEncoder] = {}

    def run(batches):
        code = kept.setdefault("one", PieceEncoder(sent.value))
        for batch in batches:
            for piece in text_slices(batch, "text__"):
                ids, ends = code.encode(piece.column(1))
                raw = [ids[s:e].astype("<u4").tobytes() for s, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(raw, pa.binary()), pa.array(decode(sent.value, ids.astype(np.int64), ends), pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text__")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each whole text of ``documents``."""
    done = encode_documents(table(spark, sf_dir, "documents"), load(default_tokenizer("piece_bpe_32k.model")))
    return done.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
