"""Removal of repeated substrings by merged shard Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

1. Anchors. Of every window of ``length`` bytes the first k-gram with the least hash is its anchor. Equal
   windows have the same anchor at the same place, so windows can only repeat where anchors do. An anchor's
   context is the run of windows that it stands for; every window is in one context. Tasks send hashes of anchors (40 bits: two that meet only cost work)
   and contexts (128 bits: equal ones count as equal bytes), packed, to buckets;
   a context that a task has already seen in a smaller document is settled there, so a passage that very
   many documents hold sends one entry a task.
2. A bucket settles each context that a smaller document holds whole, and drops anchors that only one
   document has. What is left are anchors with different contexts.
3. Their contexts (texts of less than two windows) are gathered by anchor. Each shard of them is sorted by
   itself into a Burrows-Wheeler transform. The shards' transforms are merged by refining their interleave
   one symbol a round; no merged suffixes are sorted, and only those that the start of a window can reach are
   followed. The round in which two neighbours part is the length
   of their common prefix; neighbours together after ``length`` rounds are repeated intervals. Suffixes
   alone in their interval leave the refinement, since what stands before them is unique as well. An anchor
   with more contexts than a merge takes is merged window by window, in parts by the windows' hashes.
4. Each document gets its intervals back and loses their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm.common import fresh, gather, give_back, persist, shuffles_dropped, small_batches, table, text_slices, tidy, utf8

LENGTH, K = 50, 20
_NULL_ID = np.iinfo(np.int64).max
_FLUSH = 600_000
_BLOCK = 1 << 19
_SHARD = 1 << 18
_MERGE = 3 << 20
_A = np.uint64(0x9E3779B97F4A7C15 | 1)
_M5 = np.uint64((1 << 40) - 1)
#: Low bits of a k-gram's hash that give way to its place in a block.
_PLACE = np.uint64((1 << 20) - 1)
_NONE = np.uint64((1 << 64) - 1)
#: A context: its first window, the bytes before its anchor, and how many windows it holds.
_CONTEXT = np.dtype([("at", "<u4"), ("left", "u1"), ("n", "u1")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def _kgrams(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, by doubling."""
    done, size, part = None, 0, x
    step, bit = 1, k
    power = int(_A)
    while bit:
        if bit & 1:
            if done is None:
                done, size = part, step
            else:  # the run so far, then this part
                n = len(x) - size - step + 1
                done = done[:n] * np.uint64(pow(int(_A), step, 1 << 64)) + part[size : size + n]
                size += step
        bit >>= 1
        if bit:
            n = len(x) - 2 * step + 1
            part = part[:n] * np.uint64(power) + part[step : step + n]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            step *= 2
    return _mix(done)


def _sliding(a: np.ndarray, w: int, best) -> np.ndarray:
    """Least or largest of each w neighbours."""
    step = 1
    while 2 * step <= w:
        a = best(a[:-step], a[step:])
        step *= 2
    return best(a[: len(a) - (w - step)], a[w - step :]) if w > step else a


def _context_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, left: np.ndarray) -> np.ndarray:
    """128-bit hash of each context and of its anchor's place in it, as two words."""
    raw, digest = data.tobytes(), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[s:e], n) for s, e, n in zip(starts.tolist(), ends.tolist(), left.tolist())]), "<u8").reshape(-1, 2)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(first window, bytes before the anchor, windows, anchor hash, two words of context hash) of the contexts of
    a run of texts, in order of place."""
    w, total = length - k + 1, len(data)
    out = []
    for at in range(0, total, _BLOCK):  # a context that crosses a border counts as two
        high = min(total, at + _BLOCK + length - 1)
        x = data[at:high].astype(np.uint64) + np.uint64(1)
        if len(x) < length:
            break
        h = _kgrams(x, k)
        m = _sliding((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), w, np.minimum)
        inside = np.diff(np.clip(offsets, at, high))
        m[np.arange(at, at + len(m)) + length > np.repeat(offsets[1:], inside)[: len(m)]] = _NONE  # windows that no text holds
        change = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        n = np.diff(np.append(change, len(m)))
        real = m[change] != _NONE
        first, n = change[real], n[real]
        place = (m[first] & _PLACE).astype(np.int64)
        left = place - first
        out.append((first + at, left, n, _mix(h[place]), _context_hashes(data[at:high], first, first + n - 1 + length, left)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    return tuple(np.concatenate([o[j] for o in out]) for j in range(5))


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _pack(ids: np.ndarray, tkeys: np.ndarray, doc: np.ndarray, where: np.ndarray, level: int = 1) -> bytes:
    """Contexts sorted by document and place: a table of documents, their counts and the steps between places."""
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    at = where["at"].astype(np.int64)
    steps = np.diff(at, prepend=0)
    steps[first] = at[first]
    used = doc[first]
    body = ids[used].astype("<i8").tobytes() + tkeys[used].astype("<u4").tobytes() + np.diff(np.append(first, len(doc))).astype("<u4").tobytes() + steps.astype("<u4").tobytes()
    return np.array([len(first), len(doc)], "<u4").tobytes() + zstandard.ZstdCompressor(level).compress(body + where["left"].tobytes() + where["n"].tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tkeys) of the documents, and (document, context) of the entries."""
    docs, n = np.frombuffer(blob[:8], "<u4").tolist()
    body = zstandard.ZstdDecompressor().decompress(blob[8:])
    ids = np.frombuffer(body, "<i8", docs)
    tkeys = np.frombuffer(body, "<u4", docs, 8 * docs).astype(np.int64)
    counts = np.frombuffer(body, "<u4", docs, 12 * docs).astype(np.int64)
    run = np.cumsum(np.frombuffer(body, "<u4", n, 16 * docs).astype(np.int64))
    starts = np.cumsum(counts) - counts
    where = np.empty(n, _CONTEXT)
    where["at"] = run - np.repeat(np.where(starts > 0, run[starts - 1], 0), counts)
    where["left"] = np.frombuffer(body, np.uint8, n, 16 * docs + 4 * n)
    where["n"] = np.frombuffer(body, np.uint8, n, 16 * docs + 5 * n)
    return ids, tkeys, np.repeat(np.arange(docs), counts), where


def _settle(m, c, doc_id):
    """(sorted order, which entries a smaller document settles, first entry of each entry's anchor) by anchor and context."""
    order = np.lexsort((doc_id, c[:, 0], m))  # contexts that share one word only may alternate: they stay unsettled
    sm, sc, sd = m[order], c[order], doc_id[order]
    new_m = np.concatenate([[True], sm[1:] != sm[:-1]])
    new = new_m | np.concatenate([[True], (sc[1:] != sc[:-1]).any(1)])
    low = sd[np.maximum.accumulate(np.where(new, np.arange(len(sd)), 0))]
    return order, sd > low, new_m, new


def _blob_rows(buckets, kinds, blobs):
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _anchor_rows(n_buckets: int, length: int, k: int):
    def run(batches):
        held: list[tuple] = []
        count = base = 0

        def flush():
            nonlocal held, count, base
            ids, tkeys = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            doc, where, m, c = (np.concatenate([h[j] for h in held]) for j in range(2, 6))
            held, count, base = [], 0, 0
            if not len(doc):
                return
            order, sure, _, _ = _settle(m, c, ids[doc])
            settled = np.zeros(len(doc), bool)
            settled[order[sure]] = True
            buckets, kinds, blobs = [], [], []
            if settled.any():
                buckets.append(int(ids[doc[settled][0]] % n_buckets))
                kinds.append(1)
                blobs.append(_pack(ids, tkeys, doc[settled], where[settled]))
            doc, where, m, c = doc[~settled], where[~settled], m[~settled], c[~settled]
            of = ((m >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(n_buckets + 1))
            for b in range(n_buckets):
                rows = order[cut[b] : cut[b + 1]]
                if len(rows):
                    head = _pack(ids, tkeys, doc[rows], where[rows])
                    buckets.append(b)
                    kinds.append(0)
                    blobs.append(np.array([len(head)], "<u4").tobytes() + head + _five(m[rows] & _M5) + c[rows].astype("<u8").tobytes())
            yield _blob_rows(buckets, kinds, blobs)

        for batch in batches:
            for piece in text_slices(batch, "text", 1 << 20):
                data, offsets = utf8(piece.column(2))
                at, left, n, m, c = anchors(data, offsets, length, k)
                doc = np.searchsorted(offsets, at, side="right") - 1
                where = np.empty(len(at), _CONTEXT)
                where["at"], where["left"], where["n"] = at - offsets[doc], left, n
                held.append((piece.column(0).to_numpy(), piece.column(1).to_numpy(), doc + base, where, m, c))
                base += piece.num_rows
                count += len(at)
                if count >= _FLUSH:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _by_document(ids, tkeys, doc_keys, found):
    """Rows (id, tkey, bytes of what is found in it); doc_keys index ids and tkeys."""
    order = np.argsort(doc_keys, kind="stable")
    d, found = doc_keys[order], found[order]
    first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]])) if len(d) else np.zeros(0, int)
    ends = np.append(first[1:], len(d))
    return ids[d[first]], tkeys[d[first]], [found[s:e].tobytes() for s, e in zip(first, ends)]


_VERDICT = "id bigint, tkey bigint, settled binary, open binary"


def _verdicts(pieces: list[tuple]) -> pa.Table:
    ids = np.concatenate([p[0] for p in pieces]) if pieces else np.zeros(0, np.int64)
    tkeys = np.concatenate([p[1] for p in pieces]) if pieces else np.zeros(0, np.int64)
    settled = [b for p in pieces for b in (p[2] if p[3] else [None] * len(p[2]))]
    opened = [b for p in pieces for b in ([None] * len(p[2]) if p[3] else p[2])]
    return pa.table({"id": pa.array(ids, pa.int64()), "tkey": pa.array(tkeys, pa.int64()), "settled": pa.array(settled, pa.binary()), "open": pa.array(opened, pa.binary())})


def _judge(group: pa.Table) -> pa.Table:
    out, parts, base = [], [], 0
    for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob")):
        blob = blob.as_py()
        if kind == 1:
            ids, tkeys, doc, where = _unpack(blob)
            out.append((*_by_document(ids, tkeys, doc, where), True))
            continue
        n = int(np.frombuffer(blob[:4], "<u4")[0])
        ids, tkeys, doc, where = _unpack(blob[4 : 4 + n])
        cut = 4 + n + 5 * len(where)
        m = _from_five(np.frombuffer(blob, np.uint8, 5 * len(where), 4 + n))
        parts.append((ids, tkeys, doc + base, where, m, np.frombuffer(blob[cut:], "<u8").reshape(-1, 2)))
        base += len(ids)
    if parts:
        ids, tkeys, doc, where, m, c = (np.concatenate([p[j] for p in parts]) for j in range(6))
        order, sure, new_m, new = _settle(m, c, ids[doc])
        group_of = np.cumsum(new_m) - 1
        starts = np.flatnonzero(new_m)
        several = np.add.reduceat(new.astype(np.int64), starts) > 1
        d = ids[doc[order]]
        differ = np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts)
        rest = ~sure & (several & differ)[group_of]
        out.append((*_by_document(ids, tkeys, doc[order[sure]], where[order[sure]]), True))
        out.append((*_by_document(ids, tkeys, doc[order[rest]], where[order[rest]]), False))
    found = _verdicts(out)
    del parts, out
    give_back()
    return found


def _run_hash(data: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, for few places."""
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += (data[at + j].astype(np.uint64) + np.uint64(1)) * np.uint64(pow(int(_A), j, 1 << 64))
    return _mix(h)


def _context_rows(n_buckets: int, length: int, k: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("open")
            has = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            if not len(has):
                continue
            for piece in text_slices(batch.take(pa.array(has)), "text", 16 << 20):
                data, offsets = utf8(piece.column("text"))
                ids, tkeys = piece.column("id").to_numpy(), piece.column("tkey").to_numpy()
                lists = [np.sort(np.frombuffer(b"".join(x), _CONTEXT), order="at") for x in piece.column("open").to_pylist()]
                doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                if not len(doc):
                    continue
                where = np.concatenate(lists)
                at = offsets[doc] + where["at"]
                of = (_run_hash(data, at + where["left"], k) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(n_buckets + 1))
                buckets, blobs = [], []
                for b in range(n_buckets):
                    rows = order[cut[b] : cut[b + 1]]
                    if not len(rows):
                        continue
                    head = _pack(ids, tkeys, doc[rows], where[rows])
                    body = data[gather(at[rows], where["n"][rows].astype(np.int64) - 1 + length)].tobytes()
                    buckets.append(b)
                    blobs.append(np.array([len(head)], "<u4").tobytes() + head + zstandard.ZstdCompressor(3).compress(body))
                yield _blob_rows(buckets, [0] * len(buckets), blobs)

    return run


def suffix_order(text: np.ndarray, ends: np.ndarray, depth: int = 64) -> np.ndarray:
    """Places of a shard sorted by their first ``depth`` bytes, ended by their string's end; ties by place.
    ``text`` holds no 0; ``ends`` is the end of each place's string."""
    n = len(text)
    key, step = text.astype(np.uint64), 1
    at = np.arange(n)
    while step < 8:
        nxt = np.zeros(n, np.uint64)
        nxt[: max(n - step, 0)] = key[step:]
        nxt[at + step >= ends] = 0
        key = (key << np.uint64(8 * step)) | nxt
        step *= 2
    while True:
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]]))
        if step >= depth or not n or rank[order[-1]] == n - 1:
            return order
        nxt = np.zeros(n, np.int64)
        nxt[: max(n - step, 0)] = rank[step:] + 1
        nxt[at + step >= ends] = 0
        key = rank * (n + 1) + nxt
        step *= 2


def merge_shards(shards: list[tuple[np.ndarray, np.ndarray]], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of shard transforms refined ``rounds`` times, as places of the joined text, with the number of
    the interval of each: places of one interval share their first ``rounds`` bytes. Only intervals of two or
    more are left. A shard is (text without 0, end of each place's string).

    A suffix is refined from shorter ones, so only those with ``rounds`` bytes before them in their string,
    from which the rounds lead to the start of such an interval, are followed from the first round on."""
    symbols, before, order, reach, base, entries = [], [], [], [], 0, 0
    for text, ends in shards:
        sa = suffix_order(text, ends)
        n = len(sa)
        last = np.flatnonzero(np.concatenate([ends[1:] != ends[:-1], [True]])) if n else np.zeros(0, np.int64)
        # the empty suffix of each string comes first
        rank = np.empty(n, np.int64)
        rank[sa] = np.arange(n) + len(last)
        first = np.concatenate([[True], ends[1:] != ends[:-1]]) if n else np.zeros(0, bool)
        bwt = np.where(first[sa], 0, text[sa - 1]).astype(np.uint8)  # 0: nothing stands before
        symbols += [text[last], bwt]
        before += [rank[last] + entries, rank[sa - 1] + entries]  # where the suffix one longer stands in its shard's order
        order += [np.full(len(last), -1), sa + base]
        begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        reach += [last + 1 - begin[last] >= rounds, (np.arange(n) - begin >= rounds)[sa]]
        base += n
        entries += n + len(last)
    symbols, before, order = np.concatenate(symbols), np.concatenate(before).astype(np.int32), np.concatenate(order)
    held = np.flatnonzero(np.concatenate(reach)).astype(np.int32)  # shard orders, one after the other: all agree on no symbol
    interval = np.zeros(len(held), np.int32)
    for _ in range(rounds):
        c = symbols[held]
        by = np.argsort(c, kind="stable")
        held, c, interval = before[held[by]], c[by], interval[by]
        if not len(held):
            break
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (interval[1:] != interval[:-1])])
        alone = new & np.concatenate([new[1:], [True]])
        stay = ~alone
        held, new = held[stay], new[stay]
        interval = np.cumsum(new, dtype=np.int32)
        if not len(held):
            break
    return order[held], interval


def _shared(data: np.ndarray, starts: np.ndarray, has: np.ndarray, n: int) -> np.ndarray:
    """Which of the strings of n bytes at ``starts`` (where ``has``) occur again."""
    out = np.zeros(len(starts), bool)
    rows = np.flatnonzero(has)
    if len(rows):
        _, inverse, counts = np.unique(_run_hash(data, starts[rows], n), return_inverse=True, return_counts=True)
        out[rows] = counts[inverse] > 1
    return out


def _shards(text: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Strings of the given sizes, laid end to end in ``text``, as shards of some ``_SHARD`` bytes for ``merge_shards``."""
    text = np.where(text == 0, 255, text).astype(np.uint8)  # UTF-8 has no 255
    tops = np.cumsum(sizes)
    ends = np.repeat(tops, sizes)
    shards, s = [], 0
    while s < len(sizes):
        e = max(s + 1, int(np.searchsorted(tops, (tops[s - 1] if s else 0) + _SHARD, side="right")))
        b0, b1 = (int(tops[s - 1]) if s else 0), int(tops[e - 1])
        shards.append((text[b0:b1], ends[b0:b1] - b0))
        s = e
    return shards


def _least(docs: np.ndarray, interval: np.ndarray) -> np.ndarray:
    """The smallest document of each entry's interval."""
    first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    return np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(docs))))


def _hot_anchor(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, doc_id: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) as ``repeated_places``, of the contexts of one anchor, however many.

    Equal windows stand equally far before the anchor, and their hashes agree. So windows of one distance are
    dealt to parts by hash, and a part is merged in runs of some ``_MERGE`` bytes, each with one window of every
    interval, the smallest document's, and all windows alone so far."""
    most = max(2, _MERGE // length)
    out_context, out_offset = [], []
    for back in range(length - k + 1):
        rows = np.flatnonzero((left >= back) & (sizes - left >= length - back))
        at = starts[rows] + left[rows] - back
        part = _run_hash(data, at, length) % np.uint64(max(1, -(-2 * len(rows) // most)))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=part[order][:1])) if len(order) else order
        for own in np.split(order, cuts):
            held = own[:0]
            for s in range(0, len(own), most):
                held = np.concatenate([held, own[s : s + most]])
                text = data[gather(at[held], np.full(len(held), length))]
                places, interval = merge_shards(_shards(text, np.full(len(held), length)), length)
                window = places // length
                docs = doc_id[rows[held[window]]]
                hit = docs > _least(docs, interval) if len(docs) else docs > 0
                out_context.append(rows[held[window[hit]]])
                out_offset.append((left - back)[out_context[-1]])
                new = np.concatenate([[True], interval[1:] != interval[:-1]]) if len(interval) else hit
                low = np.flatnonzero(~hit)  # of the smallest document, one window an interval
                low = low[np.unique(interval[low], return_index=True)[1]] if len(new) else low
                stays = np.ones(len(held), bool)
                stays[window] = False
                stays[window[low]] = True
                held = held[stays]
    if not out_context:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_context), np.concatenate(out_offset)


def repeated_places(data: np.ndarray, sizes: np.ndarray, left: np.ndarray, doc_id: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of each window that a context of a smaller document holds too."""
    starts = np.cumsum(sizes) - sizes
    # A common window holds half of what surrounds the anchor on one side at least.
    half = (length - k) // 2
    likely = _shared(data, starts + left - half, left >= half, half + k) | _shared(data, starts + left, sizes - left >= half + k, half + k)
    keep = np.flatnonzero(likely)
    if not len(keep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _run_hash(data, (starts + left)[keep], k)
    order = np.argsort(h, kind="stable")
    keep, h = keep[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    run = np.cumsum(sizes[keep])
    out_context, out_offset = [], []
    at = 0
    while at < len(keep):  # anchors do not meet, so merges are cut between them
        limit = (run[at - 1] if at else 0) + _MERGE
        end = np.searchsorted(run, limit, side="right")
        after = new[np.searchsorted(new, end, side="right") - 1] if end < len(keep) else len(keep)
        if after <= at:  # one anchor with more than a merge takes
            later = np.searchsorted(new, at, side="right")
            after = new[later] if later < len(new) else len(keep)
            rows = keep[at:after]
            at = int(after)
            context, offset = _hot_anchor(data, starts[rows], sizes[rows], left[rows], doc_id[rows], length, k)
            out_context.append(rows[context])
            out_offset.append(offset)
            continue
        rows = keep[at:after]
        at = int(after)
        places, interval = merge_shards(_shards(data[gather(starts[rows], sizes[rows])], sizes[rows]), length)
        if not len(places):
            continue
        tops = np.cumsum(sizes[rows])
        owner = np.searchsorted(tops, places, side="right")
        docs = doc_id[rows[owner]]
        hit = docs > _least(docs, interval)
        owner, places = owner[hit], places[hit]
        out_context.append(rows[owner])
        out_offset.append(places - (tops - sizes[rows])[owner])
    if not out_context:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_context), np.concatenate(out_offset)


def _compare(length: int, k: int):
    def run(group: pa.Table) -> pa.Table:
        parts, base = [], 0
        for blob in group.column("blob"):
            blob = blob.as_py()
            n = int(np.frombuffer(blob[:4], "<u4")[0])
            ids, tkeys, doc, where = _unpack(blob[4 : 4 + n])
            parts.append((ids, tkeys, doc + base, where, np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4 + n :]), np.uint8)))
            base += len(ids)
        ids, tkeys, doc, where, data = (np.concatenate([p[j] for p in parts]) for j in range(5))
        context, offset = repeated_places(data, where["n"].astype(np.int64) - 1 + length, where["left"].astype(np.int64), ids[doc], length, k)
        got = _by_document(ids, tkeys, doc[context], (where["at"][context] + offset).astype("<u4"))
        del parts, data
        give_back()
        return pa.table({"id": pa.array(got[0], pa.int64()), "tkey": pa.array(got[1], pa.int64()), "windows": pa.array(got[2], pa.binary())})

    return run


def _spans(settled: list[bytes], windows: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of one document as starts and ends."""
    p = np.frombuffer(b"".join(settled), _CONTEXT)
    q = np.frombuffer(b"".join(windows), "<u4").astype(np.int64)
    s = np.concatenate([p["at"].astype(np.int64), q])
    e = np.concatenate([p["at"].astype(np.int64) + p["n"] - 1 + length, q + length])
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, bucket_bytes: int = 16 << 20) -> tuple[DataFrame, str, str]:
    """All columns of ``docs`` with two more, whose names follow: what ``cut`` needs to remove bytes.

    Null texts are empty. A null id counts as the largest. Rows with the same id never remove each other's
    bytes; they are told apart by a checksum of their text, and rows that repeat both are treated alike. Extra
    columns stay, whatever their names; an empty table gives no rows. A worker holds one whole text, some 3
    bytes a byte of it, besides slices of fixed size.
    """
    spark = docs.sparkSession
    own_id, own_key, settled, windows_of, open_ = fresh([*docs.columns, "id", "tkey"], "id__", "tkey__", "settled__", "windows__", "open__")
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    keyed = docs.withColumn(own_id, F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID))).withColumn(own_key, F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    source = keyed.select(F.col(own_id).alias("id"), F.col(own_key).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = source.filter(F.octet_length("text") >= length).mapInArrow(tidy(_anchor_rows(buckets, length, k)), "bucket int, kind int, blob binary")
    with shuffles_dropped(spark):  # the anchors' shuffle is the largest, and nothing reads it again
        verdicts = persist(packed.groupBy("bucket").applyInArrow(_judge, _VERDICT), "suffix-verdicts")
    lists = verdicts.groupBy("id", "tkey").agg(F.collect_list("settled").alias(settled), F.collect_list("open").alias("opens"))
    lists = lists.select(F.col("id").alias(own_id), F.col("tkey").alias(own_key), settled, F.when(F.size("opens") > 0, F.col("opens")).alias(open_))
    # One exchange of the texts serves both the contexts and the result.
    known = keyed.join(lists.hint("shuffle_hash"), [own_id, own_key], "left")
    rows = known.select(F.col(own_id).alias("id"), F.col(own_key).alias("tkey"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(open_).alias("open")).mapInArrow(tidy(_context_rows(buckets, length, k)), "bucket int, kind int, blob binary")
    windows = rows.groupBy("bucket").applyInArrow(_compare(length, k), "id bigint, tkey bigint, windows binary")
    windows = windows.groupBy(F.col("id").alias(own_id), F.col("tkey").alias(own_key)).agg(F.collect_list("windows").alias(windows_of))
    return known.drop(open_).join(windows.hint("shuffle_hash"), [own_id, own_key], "left").drop(own_id, own_key), settled, windows_of


def cut(text: str | None, settled: list[bytes] | None, windows: list[bytes] | None, length: int = LENGTH) -> tuple[bytes, int, int, int]:
    """(remaining bytes, bytes before, bytes removed, removed runs)."""
    raw = (text or "").encode()
    if not settled and not windows:
        return raw, len(raw), 0, 0
    s, e = _spans(settled or [], windows or [], length)
    kept = b"".join([raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)])])
    return kept, len(raw), len(raw) - len(kept), len(s)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns of the whole ``documents`` table. Odd rows as in ``repeated_spans``."""
    docs, settled, windows = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches):
        for batch in batches:
            rows = [cut(t.as_py(), s.as_py(), w.as_py()) for t, s, w in zip(batch.column("text"), batch.column(settled), batch.column(windows))]
            kept, n, gone, spans = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(tidy(run), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each text by what is left of it; a cut inside a character drops that character's rest. A
    document left without any word goes, null and empty texts among them. Null ids, repeated rows, extra columns
    and empty tables as in ``repeated_spans``."""
    small_batches(spark)
    cols = docs.columns
    cut_rows, settled, windows = repeated_spans(docs)

    def run(batches):
        for batch in batches:
            texts = [cut(t.as_py(), s.as_py(), w.as_py())[0].decode("utf-8", "ignore") for t, s, w in zip(batch.column("text"), batch.column(settled), batch.column(windows))]
            full = pa.array([bool(t.split()) for t in texts], pa.bool_())
            yield batch.select(cols).set_column(cols.index("text"), "text", pa.array(texts, pa.string())).filter(full)

    kept = cut_rows.mapInArrow(tidy(run), docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
