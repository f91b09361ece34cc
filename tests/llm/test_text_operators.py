"""Line dedup, suffix dedup, SimHash and packing against brute force, with odd rows."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrygraph.llm import op5_suffixes, op6_lines, op8_packing, op9_simhash
from quarrygraph.llm.common import default_tokenizer, text_key, utf8, words
from tests.llm.conftest import prose


def as_id(x):
    return 2**63 - 1 if x is None else x


def brute_lines(rows, least=10):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(as_id(i))
    out = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not (len(key(x)) >= least and len(held[key(x)]) > 1 and as_id(i) != min(held[key(x)]))]
        out.append((i, "\n".join(kept)))
    return out


def brute_suffixes(rows, n=50):
    first = {}
    for i, t in sorted(rows, key=lambda r: as_id(r[0])):
        raw = (t or "").encode()
        for j in range(len(raw) - n + 1):
            first.setdefault(raw[j : j + n], as_id(i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for j in range(len(raw) - n + 1):
            if first[raw[j : j + n]] < as_id(i):
                gone[j : j + n] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, kept, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0])))
    return out


def test_words_of_texts():
    col = pa.array(["a  Bc\t", None, "", "x y\nZ", " \n"])
    found, bounds = words(*utf8(col), lower=True)
    assert found.to_pylist() == [b"a", b"bc", "x y".encode(), b"z"]
    assert bounds.tolist() == [0, 2, 2, 2, 4, 4]


def test_line_dedup(odd_docs, no_docs):
    maps = op6_lines.line_bitmaps(odd_docs)
    joined, keep, _ = op6_lines.with_bitmaps(odd_docs.select("doc_id", "text"), maps)
    made = sorted(((as_id(r["doc_id"]), op6_lines.apply_bitmap(r["text"], r[keep])) for r in joined.collect()))
    assert made == sorted((as_id(i), t) for i, t in brute_lines([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    assert op6_lines.line_bitmaps(no_docs).count() == 0


def test_line_dedup_of_one_hot_line(spark):
    rows = [(k, "the very same line in all\nown line number %d" % k) for k in range(3000)]
    maps = op6_lines.line_bitmaps(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    assert {r["id"] for r in maps.collect()} == set(range(1, 3000))


def spans(df):
    found, settled, windows = op5_suffixes.repeated_spans(df.select("doc_id", "text"))
    return sorted(((as_id(r["doc_id"]), *op5_suffixes.cut(r["text"], r[settled], r[windows])) for r in found.collect()))


def test_suffix_dedup(odd_docs, no_docs):
    want = sorted((as_id(i), *rest) for i, *rest in brute_suffixes([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    assert spans(odd_docs) == want
    assert spans(no_docs) == []


def test_suffix_dedup_keeps_contexts_whose_hashes_agree_in_40_bits(spark):
    """Pairs found by search: same anchor, other surroundings, equal low 40 bits of a polynomial hash."""
    base = "The quick brown fox jumps over the lazy dog, and then "
    ends = ["rhhukmbqnhasywjmmexfgbrjmw", "iauoxzzfgdlvnqvjadqrdqlzte", "hrulbwekizujrqhuyzefbvovtu", "mpjvxrfkwpzchjqvehdexxlpyt", "oejxnzeiimfxwgposoxpxgergd", "zmsgdupjgtfpjprcwgkxswmpcr"]
    for pair in (ends[:2], ends[2:4], ends[4:]):
        rows = [(k, base + end) for k, end in enumerate(pair)]
        want = sorted((i, *rest) for i, *rest in brute_suffixes(rows))
        assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def test_suffix_dedup_of_near_copies(spark):
    r = random.Random(4)
    base = prose(77, 400).split(" ")
    rows = []
    for k in range(40):
        own = list(base)
        for _ in range(12):
            own[r.randrange(len(own))] = f"w{r.randrange(50)}"
        lo = r.randrange(100)
        rows.append((k * 3 % 41, " ".join(own[lo : lo + r.randrange(30, 250)])))
    want = sorted((i, *rest) for i, *rest in brute_suffixes(rows))
    assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def test_suffix_dedup_across_blocks(spark):
    """Texts longer than a block, with repeated passages at and around its borders."""
    r = random.Random(6)
    noise = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz é", k=n))
    shared = [noise(120) for _ in range(12)]
    block = op5_suffixes._BLOCK
    own = noise(block - 60)
    first = own + shared[0] + noise(300) + shared[1]
    first += noise(2 * block - len(first.encode()) - 30) + shared[2] + noise(4000)
    second = "".join(noise(r.randrange(20, 3000)) + s for s in shared for _ in range(2)) + own[-500:] + noise(70)
    rows = [(1, first), (2, second), (3, noise(block - 110) + second[: block // 2] + noise(30)), (4, shared[2][:49] + "#"), (5, shared[2][:50] + "#")]
    want = sorted((i, *rest) for i, *rest in brute_suffixes(rows))
    assert spans(spark.createDataFrame(rows, "doc_id bigint, text string")) == want


def shuffle_bytes(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(f.stat().st_size for top in disk.localDirs() for f in Path(top.getPath()).rglob("shuffle_*.data"))


def test_suffix_dedup_drops_the_shuffle_of_its_anchors(spark):
    """Whether or not the driver collects its garbage; the session's setting stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    docs = spark.createDataFrame([(k, prose(3000 + k, 400)) for k in range(60)], "doc_id bigint, text string")
    before = shuffle_bytes(spark)
    for value in (None, "false"):
        if value:
            spark.conf.set(name, value)
        kept = op5_suffixes.repeated_spans(docs)  # its files stay while it is referenced
        until = time.time() + 5
        while (left := shuffle_bytes(spark) - before) > 20_000 and time.time() < until:
            time.sleep(0.1)
        assert left <= 20_000, kept[1:]
        assert spark.conf.get(name, None) == value
    spark.conf.unset(name)


def contexts_of(texts):
    """Arguments of ``repeated_places``: the contexts of all anchors of some documents."""
    data, sizes, left, docs, at = [], [], [], [], []
    for d, t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        for lo, before, n in zip(*op5_suffixes.anchors(raw, np.array([0, len(raw)]))[:3]):
            data.append(raw[lo : lo + n + 49]), sizes.append(n + 49), left.append(before), docs.append(d), at.append(lo)
    return np.concatenate(data), np.array(sizes), np.array(left), np.array(docs), np.array(at)


def test_every_window_is_in_one_context():
    r = random.Random(3)
    texts = [prose(k, r.randrange(1, 60)) for k in range(30)] + ["", "a" * 500, "ab" * 90, "x" * 49, "y" * 50]
    data, offsets = utf8(pa.array(texts))
    at, left, n, m, c = op5_suffixes.anchors(data, offsets)
    got = sorted(s + j for s, w in zip(at.tolist(), n.tolist()) for j in range(w))
    assert got == [p for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for p in range(s, e - 49)]
    assert ((left >= 0) & (left + 1 - n >= 0) & (left <= 30) & (n <= 31)).all()
    grams = {}
    for s, b, h in zip(at.tolist(), left.tolist(), m.tolist()):
        assert grams.setdefault(data[s + b : s + b + 20].tobytes(), h) == h
    whole = {}
    for s, w, b, h in zip(at.tolist(), n.tolist(), left.tolist(), map(tuple, c.tolist())):
        assert whole.setdefault((data[s : s + w + 49].tobytes(), b), h) == h
    assert len(set(whole.values())) == len(whole)


@pytest.mark.parametrize(("merge", "shard"), [(1 << 9, 1 << 8), (1 << 13, 1 << 9), (3 << 20, 1 << 10), (3 << 20, 1 << 18)])
def test_merges_of_any_size_find_the_same_windows(monkeypatch, merge, shard):
    """Cut between anchors, within one anchor's contexts, and between shards; against the 50-byte strings themselves."""
    r = random.Random(8)
    core = "an anchor that very many documents hold in the middle of other words"
    texts = [(d, prose(1000 + d % 7, 12) + r.choice(["", "x", "yy"]) + core + r.choice("abc") + prose(d % 5, 12)) for d in r.sample(range(500), 150)]
    data, sizes, left, docs, at = contexts_of(texts)
    monkeypatch.setattr(op5_suffixes, "_MERGE", merge)
    monkeypatch.setattr(op5_suffixes, "_SHARD", shard)
    context, offset = op5_suffixes.repeated_places(data, sizes, left, docs)
    got = {(int(docs[c]), int(at[c] + o)) for c, o in zip(context, offset)}
    first = {}
    for d, t in sorted(texts):
        raw = t.encode()
        for j in range(len(raw) - 49):
            first.setdefault(raw[j : j + 50], d)
    want = {(d, j) for d, t in texts for j in range(len(t.encode()) - 49) if first[t.encode()[j : j + 50]] < d}
    assert got == want and want


def test_one_anchor_beyond_a_merge(monkeypatch):
    monkeypatch.setattr(op5_suffixes, "_MERGE", 2000)
    r = random.Random(2)
    left, core, n = "the end of one passage in all docs ", "of very many readers ", 400
    texts = [left[-30:] + core[:20] + "".join(r.choices("ab", k=30)) for _ in range(n)]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    docs = np.array(r.sample(range(10_000), n))
    context, offset = op5_suffixes._hot_anchor(np.concatenate(raw), np.arange(n) * 80, np.full(n, 80), np.full(n, 30), docs, 50, 20)
    first = {}
    for d, t in sorted(zip(docs.tolist(), texts)):
        for j in range(31):
            first.setdefault((j, t[j : j + 50]), d)
    want = {(k, j) for k in range(n) for j in range(31) if first[j, texts[k][j : j + 50]] < docs[k]}
    assert set(zip(context.tolist(), offset.tolist())) == want and len(context) == len(want)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=30), min_size=1, max_size=12), st.integers(1, 8))
def test_merged_transforms_find_repeated_intervals(strings, n):
    """Intervals of the merged shards are exactly the strings of n bytes that occur more than once."""
    cut = max(1, len(strings) // 3)
    groups = [strings[i : i + cut] for i in range(0, len(strings), cut)]
    shards, whole, ends = [], "", []
    for group in groups:
        text = np.frombuffer("".join(group).encode(), np.uint8)
        tops = np.cumsum([len(s) for s in group])
        shards.append((text, np.repeat(tops, [len(s) for s in group])))
        ends += [len(whole) + int(e) for e in np.repeat(tops, [len(s) for s in group])]
        whole += "".join(group)
    places, interval = op5_suffixes.merge_shards(shards, n)
    found = {}
    for p, k in zip(places.tolist(), interval.tolist()):
        found.setdefault(k, []).append(p)
    want = {}
    for p in range(len(whole)):
        if p + n <= ends[p]:
            want.setdefault(whole[p : p + n], []).append(p)
    assert sorted(sorted(v) for v in found.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_simhash(odd_docs, no_docs):
    got = op9_simhash.near_duplicates(odd_docs).collect()
    prints = [(as_id(r["doc_id"]), op9_simhash.fingerprint(r["text"])) for r in odd_docs.collect()]
    assert sorted((as_id(r["doc_id"]), r["fp"] & (2**64 - 1)) for r in got) == sorted(prints)
    comp = {f: {f} for _, f in prints}
    for a in list(comp):
        for b in list(comp):
            if (a ^ b).bit_count() <= 4 and comp[a] is not comp[b]:
                both = comp[a] | comp[b]
                for x in both:
                    comp[x] = both
    for r in got:
        members = [i for i, f in prints if f in comp[r["fp"] & (2**64 - 1)]]
        assert as_id(r["component_id"]) == min(members)
    assert op9_simhash.near_duplicates(no_docs).count() == 0


def test_simhash_stage_keeps_one_row_of_each_component(spark, odd_docs):
    """Null and repeated ids with other texts: a row survives if it is its component's least by id, then text key."""
    more = [(5, prose(50)), (None, prose(51)), (None, prose(51)), (20, prose(7)), (21, prose(51)), (None, prose(52)), (None, prose(53)), (8, prose(52))]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    rows = [(as_id(r["doc_id"]), r["k"], r["text"]) for r in docs.withColumn("k", text_key(F.col("text"))).collect()]
    prints = [op9_simhash.fingerprint(t) for *_, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    want = [min((r for r, c in zip(rows, comp) if c == k), key=lambda r: r[:2]) for k in set(comp)]
    got = op9_simhash.stage(spark, docs, "").collect()
    assert sorted((as_id(r["doc_id"]), r["text"] or "") for r in got) == sorted((i, t or "") for i, _, t in want)


@pytest.mark.parametrize("max_tile", [8192, 16])
def test_simhash_links_match_all_pairs(spark, max_tile):
    r = random.Random(1)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        for _ in range(3):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    for f in range(40):
        fps.add(0xFFFF << 20 | f)  # one block value for many
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    from quarrygraph.llm.components import connected_components

    got = {r["node"] & (2**64 - 1): r["root"] for r in connected_components(op9_simhash.links(df, 4, max_tile)).collect()}
    forest = op9_simhash.Forest(len(fps))
    u, v = zip(*[(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    forest.union(np.array(u), np.array(v))
    want = {}
    for k, f in enumerate(fps):
        want.setdefault(int(forest.parent[k]), set()).add(f)
    made = {}
    for f in fps:
        made.setdefault(got.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, made.values())) == sorted(map(sorted, want.values()))


def test_block_choices_cover_every_pair_within_the_radius():
    r = random.Random(3)
    assert len(op9_simhash.choices(10**6, 4, 8192)) == 5 and len(op9_simhash.choices(10**10, 4, 8192)) == 15
    for n in (10, 10**9, 10**11, 10**13, 10**15):
        masks = op9_simhash.choices(n, 4, 8192)
        for _ in range(300):
            differ = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
            assert any(not differ & m for m in masks)


def test_simhash_links_with_more_blocks(spark, monkeypatch):
    few = op9_simhash.choices
    monkeypatch.setattr(op9_simhash, "choices", lambda n, radius, most: few(10**11, radius, 8192))
    test_simhash_links_match_all_pairs.__wrapped__(spark, 16) if hasattr(test_simhash_links_match_all_pairs, "__wrapped__") else test_simhash_links_match_all_pairs(spark, 16)


def test_chunks_beyond_the_radius_never_meet(spark):
    """One block value for all: the tile is cut by population count, and only near chunks enter the shuffle."""
    r = random.Random(9)
    fps = sorted({sum(1 << b for b in r.sample(range(40), r.randint(0, 40))) for _ in range(3000)})  # the high bits agree
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    rows = op9_simhash.tiles(df, 4, 100).filter("blk = 4").collect()
    chunk, own = {}, {}
    for t in rows:
        chunk.setdefault(t["hi"] if t["side"] else t["lo"], set()).add(t["fp"])
    for c, members in chunk.items():
        own |= dict.fromkeys(members, c)
    spread = {c: [f.bit_count() for f in m] for c, m in chunk.items()}
    pairs = {(t["lo"], t["hi"]) for t in rows}
    assert set(own) == set(fps) and max(map(len, chunk.values())) < 350
    for a in chunk:
        for b in chunk:
            if a <= b:
                near = max(min(spread[a]), min(spread[b])) - min(max(spread[a]), max(spread[b])) <= 4
                assert ((a, b) in pairs) == near
    assert 0 < len(pairs) < len(chunk) * (len(chunk) + 1) / 2
    for lo, hi in pairs:
        assert {t["fp"] for t in rows if (t["lo"], t["hi"]) == (lo, hi)} == chunk[lo] | chunk[hi]


def test_hot_keys_are_joined_in_many_tasks(spark):
    from quarrygraph.llm.common import spread_join

    left = spark.createDataFrame([(k, "x" if k % 3 else str(k)) for k in range(3000)] + [(None, None)], "id bigint, key string")
    right = left.select("key").distinct().filter("key <> '3'").withColumn("v", F.concat("key", F.lit("!")))
    sizes = left.groupBy("key").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(map(str, spread_join(left, right, sizes, "key", F.col("id"), how, least=100).collect()))
        assert got == sorted(map(str, left.join(right, "key", how).collect()))


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = default_tokenizer("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    rows = op8_packing.pack(odd_docs, path).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((as_id(r["doc_id"]), r["doc_tokens"]), []).append(r)
    made = []
    for (i, n), found in pieces.items():
        by_start = sorted(found, key=lambda r: r["start"])
        copies = sum(r["start"] == 0 for r in by_start)
        assert sum(r["length"] for r in by_start) == n * copies
        made += [i] * copies
        if copies == 1:
            ids = tk.encode({as_id(d["doc_id"]): d["text"] for d in odd_docs.collect() if (as_id(d["doc_id"])) == i and len(tk.encode(d["text"] or "", add_special_tokens=False).ids) + 1 == n}[i] or "", add_special_tokens=False).ids + [2]
            assert b"".join(r["ids"] for r in by_start) == np.array(ids, "<u4").tobytes()
    assert sorted(made) == sorted(as_id(d["doc_id"]) for d in odd_docs.collect())
    check_sequences(rows)
    assert op8_packing.pack(no_docs, path).count() == 0


def check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = wasted = 0
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
        used += at
        wasted += 0 if at & (at - 1) == 0 else 4096 - at
    assert wasted <= 0.005 * used + 16 * len(by) / 100


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 700), max_size=40))
def test_packer_wastes_little(lengths):
    packer, out = op8_packing.Packer(256, 8), []
    for k, n in enumerate(lengths):
        packer.take(k, np.arange(n, dtype=np.uint32), out)
    packer.close(out)
    total = {}
    for doc, start, ids, seq, at in sorted(out, key=lambda p: (p[3], p[4])):
        assert total.get(seq, 0) == at
        total[seq] = at + len(ids)
    assert all(n > 255 - 8 or n & (n - 1) == 0 for n in total.values())
    for k, n in enumerate(lengths):
        ids = np.concatenate([p[2] for p in sorted((p for p in out if p[0] == k), key=lambda p: p[1])])
        assert ids.tolist() == list(range(n))


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = default_tokenizer("word_bpe_49k.json")
    tk, code = Tokenizer.from_file(path), op8_packing.WordEncoder(path)
    texts = ["Don't stop, it's o'clock!! 3.14", None, "", "ÉTÉ café. naïve?! ß", "x<|endoftext|>y <|startoftext|>", "日本語 。。。 ok.", "a. b...c ,;: 'S", prose(3), "́combining é É"]
    ids, ends = code.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tk.encode(t or "", add_special_tokens=False).ids


_ENCODED: dict = {}


def both_encoders():
    from tokenizers import Tokenizer

    path = default_tokenizer("word_bpe_49k.json")
    if not _ENCODED:
        _ENCODED.update(library=Tokenizer.from_file(path), own=op8_packing.WordEncoder(path))
    return _ENCODED["library"], _ENCODED["own"]


def same_ids(texts):
    tk, code = both_encoders()
    ids, ends = code.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == tk.encode(t or "", add_special_tokens=False).ids, t


def test_special_tokens_and_marks_in_upper_case():
    same_ids(["<|EndOfText|>", "a <|ENDOFTEXT|> b<|endoftext|>C", "<|StartOfText|>. <|startoftext|>.", "J\u030c H\u0331a T\u0308 W\u030a", "DON'T. It'S; I\u0307 \u0130STANBUL. \u1e9e", "A\u0301.A \u212bngstr\u00f6m K\u0327!"])


_PIECES = st.sampled_from(["<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "\u030c", "\u0308", "\u0331", "J", "T", "a", "'S", "'ll", ".", ",", "!?", " ", "\n", "\x0b", "\x85", "\u00a0", "\u2003", "\x00", "\x1f", "7", "\u0130", "\u03a3", "\u1e9e", "\ufb01", "\u6f22", "\U0001f600"])


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.one_of(_PIECES, st.text(max_size=6)), max_size=14).map("".join))
def test_word_encoder_equals_the_tokenizer_on_any_text(text):
    same_ids([text])


def test_word_encoder_equals_the_tokenizer_on_the_documents(spark):
    same_ids([r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def test_bitmap_round_trip():
    keep = np.array([1, 0, 1, 1, 0, 0, 0, 0, 1], np.uint8)
    packed = zlib.compress(np.packbits(keep).tobytes())
    assert op6_lines.apply_bitmap("\n".join("abcdefghi"), packed) == "a\nc\nd\ni"
    assert op6_lines.apply_bitmap(None, None) == ""
    assert hashlib.sha256(op6_lines.apply_bitmap("x", None).encode()).hexdigest() == hashlib.sha256(b"x").hexdigest()
