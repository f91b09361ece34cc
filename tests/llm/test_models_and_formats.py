"""Language identification, quality rules and classifier, neighbours, archives and pieces."""

import gzip
import io
import struct
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrygraph.llm import op1_language, op2_quality, op3_neighbours, op4_factorisation, op7_warc, op10_pieces
from quarrygraph.llm.common import default_tokenizer
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


def as_id(x):
    return 2**63 - 1 if x is None else x


# --- language
def test_language_on_odd_rows(odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        model = op1_language.fit(docs, ~op1_language.held_out())
        rows = op1_language.predict(docs, model, [F.col("doc_id"), op1_language.held_out().alias("held_out")]).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            assert 0 <= r["score"] <= 1
    empty = {r["doc_id"]: r["lang_pred"] for r in op1_language.predict(odd_docs.filter("doc_id IN (2, 3, 4, 15)"), op1_language.fit(odd_docs, F.lit(True)), [F.col("doc_id")]).collect()}
    assert set(empty.values()) == {"und"}


def test_language_without_labels(odd_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    rows = op1_language.predict(docs, op1_language.fit(docs, F.lit(True)), [F.col("doc_id")]).collect()
    assert {r["lang_pred"] for r in rows} == {"und"} and {r["score"] for r in rows} == {0.0}


def test_language_held_out_accuracy(spark):
    rows = op1_language.op1_language(spark, "/root/testdata/sf0.01").filter("held_out").select("doc_id", "lang_pred").collect()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.97


def test_language_stage_keeps_extra_columns(spark, odd_docs):
    kept = op1_language.stage(spark, odd_docs, SF)
    assert kept.columns == odd_docs.columns
    assert not {2, 3, 4, 15} & {r["doc_id"] for r in kept.collect()}


def test_ngrams_do_not_cross_texts():
    together = list(op1_language.counts(pa.array(["abc déf", "x", "12", None, "Zz"])))
    for k, t in enumerate(["abc déf", "x", "12", None, "Zz"]):
        alone = next(iter(op1_language.counts(pa.array([t], pa.string()))))
        if alone is None:
            assert together[k] is None
        else:
            assert (together[k][0] == alone[0]).all() and (together[k][1] == alone[1]).all()


def plain_grams(text):
    """N-gram counts by bucket, one character at a time."""
    mask, (a, b, c) = (1 << 64) - 1, (int(x) for x in op1_language._MIX)
    seq, inside = [0], False
    for ch in text or "":
        if ch.isalpha():
            seq.append(ord(ch.lower()) if len(ch.lower()) == 1 else ord(ch))
            inside = True
        elif inside:
            seq.append(0)
            inside = False
    out = {}
    for i in range(len(seq)):
        for k in range(min(3, len(seq) - i)):
            h = seq[i] + (seq[i + 1] * b if k else 0) + (seq[i + 2] * c if k > 1 else 0)
            h = (h + k + 1) * a & mask
            h = ((h ^ (h >> 29)) * b & mask) >> (64 - op1_language.BITS)
            out[h] = out.get(h, 0) + 1
    return out if any(seq) else None


@pytest.mark.parametrize("step", [1, 2, 3, 7, 64, 1 << 19])
def test_long_texts_are_counted_in_pieces(step):
    for text in (prose(4, 40) + " ÉTÉ Ⅷ ß漢字😀x", "a", "é", "1 2", "漢" * 9, ".a", "a."):
        got = op1_language.long_counts(np.frombuffer(text.encode(), np.uint8), step)
        want = plain_grams(text)
        assert ({int(k): int(got[k]) for k in np.flatnonzero(got)} if got is not None else None) == want
        (at, n), *_ = [x if x is not None else ((), ()) for x in op1_language.counts(pa.array([text]))]
        assert dict(zip(map(int, at), map(int, n))) == (want or {})


def test_a_text_of_many_slices_costs_no_more_memory():
    import tracemalloc

    text = pa.array([prose(6, 2000) * 1200])  # over 20 MB
    op1_language._letters()
    tracemalloc.start()
    (at, n), *_ = op1_language.counts(text)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and n.sum() > 20 << 20
    tracemalloc.stop()


def test_language_equals_a_plain_regression(spark):
    """FTRL with elastic net, TF-IDF and temperature, one weight at a time."""
    from math import exp, log, sqrt

    docs = [(k, prose(k, 12) + " " + {0: "zz zqz", 1: "ww waw", 2: "yyu uy"}[k % 3] * 3, "abc"[k % 3]) for k in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = op1_language.fit(df, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in op1_language.predict(df, model, [F.col("doc_id")]).collect()}
    order = [r[0] for r in spark.range(30).orderBy(F.xxhash64(F.lit(7), "id")).collect()]
    grams = {k: plain_grams(t) for k, t, _ in docs}
    held = {}
    for g in grams.values():
        for b in g:
            held[b] = held.get(b, 0) + 1
    idf = lambda b: log(31 / (1 + held.get(b, 0))) + 0.1

    def vector(g):
        x = {b: (1 + log(n)) * idf(b) for b, n in sorted(g.items())}
        norm = sqrt(sum(v * v for v in x.values()))
        return {b: v / norm for b, v in x.items()}

    z, n = {}, {}

    def weight(b, c):
        zi, ni = z.get((b, c), 0.0), n.get((b, c), 0.0)
        return 0.0 if abs(zi) <= 0.05 else -(zi - (0.05 if zi > 0 else -0.05)) / ((1 + sqrt(ni)) / 0.5 + 0.01)

    def logits(x):
        return [sum(v * weight(b, c) for b, v in x.items()) for c in range(3)]

    def shares(zs):
        e = [exp(v - max(zs)) for v in zs]
        return [v / sum(e) for v in e]

    learned = [d for k, d in enumerate(order) if k % 5]
    for _ in range(4):
        for d in learned:
            x = vector(grams[d])
            w = {(b, c): weight(b, c) for b in x for c in range(3)}
            p = shares([sum(v * w[b, c] for b, v in x.items()) for c in range(3)])
            for b, v in x.items():
                for c in range(3):
                    g = v * (p[c] - (d % 3 == c))
                    step = (sqrt(n.get((b, c), 0.0) + g * g) - sqrt(n.get((b, c), 0.0))) / 0.5
                    z[b, c] = z.get((b, c), 0.0) + g - step * w[b, c]
                    n[b, c] = n.get((b, c), 0.0) + g * g
    aside = order[::5]
    loss = lambda t: -sum(log(max(shares([v / t for v in logits(vector(grams[d]))])[d % 3], 1e-12)) for d in aside) / len(aside)
    assert loss(model["temperature"]) <= min(loss(t) for t in (0.02, 0.05, 0.1, 0.3, 1, 3, 20)) + 1e-6
    for d in range(30):
        p = shares([v / model["temperature"] for v in logits(vector(grams[d]))])
        assert got[d][0] == "abc"[p.index(max(p))] and abs(got[d][1] - max(p)) < 1e-6
    seen = {b for d in order for b in grams[d]}
    zeros = {(b, c) for b in seen for c in range(3) if weight(b, c) == 0}
    assert zeros and zeros == {(b, c) for b in seen for c in range(3) if model["weights"][model["row_of"][b], c] == 0}


def test_every_language_is_learned(spark):
    made = [f"l{k:03d}" for k in range(200)]
    letters = [chr(0x4E00 + 40 * k) for k in range(200)]
    rows = [(1000 * j + k, f"{letters[k]}{letters[k]} {letters[k]}{j % 10}", made[k]) for k in range(200) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = op1_language.fit(df, F.lit(True))
    assert model["langs"] == made
    got = op1_language.predict(df, model, [F.col("doc_id"), F.col("lang")]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.99


def test_one_id_in_most_rows_gives_one_model(spark, monkeypatch):
    rows = [(7, f"{prose(k % 50, 5)} {k}", "a") for k in range(10_000)] + [(100 + k, prose(k, 10), "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    one, two = (op1_language.fit(d, F.lit(True), per_lang=20) for d in (df.coalesce(1), df.repartition(13)))
    assert one["langs"] == ["a", "b"] and (one["weights"] == two["weights"]).all() and one["temperature"] == two["temperature"]
    picks = op1_language._picked(df.select(F.col("doc_id").alias("pick"), F.col("lang").alias("of")), 20)
    assert len(picks) == len(set(picks)) == 40


def test_language_stage_without_labels_or_with_taken_names(spark, odd_docs):
    kept = op1_language.stage(spark, odd_docs.withColumn("lang", F.lit(None).cast("string")), SF)
    assert {r["doc_id"] for r in odd_docs.collect()} - {r["doc_id"] for r in kept.collect()} == {2, 3, 4, 15}
    named = odd_docs.withColumn("lang__", F.lit(5)).withColumn("Score__", F.lit(6))
    kept = op1_language.stage(spark, named, SF)
    assert kept.columns == named.columns and {(r["lang__"], r["Score__"]) for r in kept.collect()} == {(5, 6)}


def test_temperature_sharpens_and_softens():
    z = np.array([[1.0, 0.0]] * 20)
    assert op1_language.fit_temperature(z, np.zeros(20, int)) < 0.1
    assert op1_language.fit_temperature(z * 10, np.array([0, 1] * 10)) > 5


# --- quality rules
def brute_rules(t):
    import re

    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(odd_docs, no_docs):
    got = op2_quality.document_rules(odd_docs).collect()
    want = [(as_id(r["doc_id"]), *brute_rules(r["text"])) for r in odd_docs.collect()]
    assert sorted((as_id(r["id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == sorted(want)
    rows = op2_quality.quality(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert op2_quality.quality(no_docs).count() == 0


def test_repeated_windows_are_counted_once(spark):
    texts = ["a b c d e f g h " * 3, "x " * 30, " ".join(map(str, range(8))), " ".join([*map(str, range(9)), *map(str, range(9))]), "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r["n_repeat_words"] for r in op2_quality.document_rules(df).orderBy("id").collect()] == [brute_rules(t)[4] for t in texts]


def test_boilerplate_rejects_depleted_documents(spark):
    line = "accept all cookies on this site to go on reading the page now please"
    rows = [(k, f"{line}\n{line} again and again\n{line} and more of it", "h") for k in range(40)]
    rows = [(k, t + f"\nown {k}", h) for k, t, h in rows]
    rows += [(100 + k, prose(k, 60) + "\n" + line, "h") for k in range(40)]
    got = {r["doc_id"]: r["kept"] for r in op2_quality.quality(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert not any(got[k] for k in range(40)) and all(got[100 + k] for k in range(40))


def brute_frequent(rows, max_docs=10, max_share=0.01):
    """Line numbers that each row (id, text, host) loses."""
    low = str.maketrans(op2_quality._UPPER, op2_quality._LOWER)
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)
    held, docs = {}, {}
    for i, t, h in rows:
        own = ("no id", t or "") if i is None else i
        docs.setdefault(h or "", set()).add(own)
        for line in (t or "").split("\n"):
            if key(line):
                held.setdefault((h or "", key(line)), set()).add(own)
    over = {k for k, v in held.items() if len(v) > max_docs and len(v) > len(docs[k[0]]) * max_share}
    return [[n for n, line in enumerate((t or "").split("\n")) if (h or "", key(line)) in over] for _, t, h in rows]


def test_frequent_lines_are_removed_by_documents(spark):
    """Copies count as documents each, rows that repeat an id as one, and each text without an id as one."""
    line, page = "Read 12 more pages of this site", "one page in many copies\nits second line"
    rows = [(k, f"{prose(k, 20)}\n {line} ", "h") for k in range(12)] + [(100 + k, page, "g") for k in range(15)] + [(7, page, "x")] * 30
    rows += [(None, f"{line}\n{k % 9}", "n") for k in range(40)] + [(None, f"{line}\nn{'x' * (k % 13)}", None) for k in range(40)] + [(300, None, "h"), (301, "", None), (3, f"{line}", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"gone__": F.lit(1), "tkey__": F.lit(2)})
    want = brute_frequent(rows)
    cut = [(as_id(i), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in g)) for (i, t, _), g in zip(rows, want)]
    got = op2_quality.without_frequent_lines(df)
    assert got.columns == df.columns
    assert sorted(map(str, ((as_id(r["doc_id"]), r["text"]) for r in got.collect()))) == sorted(map(str, cut))
    judged = op2_quality.quality(df).collect()
    assert sorted((as_id(r["doc_id"]), r["n_removed_lines"]) for r in judged) == sorted((as_id(i), len(g)) for (i, *_), g in zip(rows, want))
    assert {r["n_removed_lines"] for r in judged if r["doc_id"] is not None and 100 <= r["doc_id"] < 115} == {2}
    assert op2_quality.without_frequent_lines(df.filter("false")).count() == 0


# --- classifier
def features(text, chars, edges):
    """{feature: value} of one text from the operator's columns."""
    row, bucket, x, stats = op4_factorisation.raw_features(pa.array([text], pa.string()), pa.array([chars], pa.int64()))
    cols = op4_factorisation.stat_columns(stats, edges)[0]
    return dict(zip(map(int, bucket), map(float, x))) | dict.fromkeys(map(int, cols), op4_factorisation.N_STATS**-0.5)


def pair_score(x, w0, w, v):
    """Explicit sum over all pairs of features."""
    z = w0 + sum(w[i] * a for i, a in x.items())
    return z + sum(float(v[i] @ v[j]) * a * b for i, a in x.items() for j, b in x.items() if i < j)


def test_score_equals_sums_over_pairs(spark):
    rng, dim = np.random.default_rng(0), op4_factorisation.DIM
    edges = np.sort(rng.normal(1, 1, (op4_factorisation.N_STATS, op4_factorisation.BINS - 1)), axis=1)
    model = {"w0": 0.3, "w": rng.normal(size=dim), "v": rng.normal(0, 0.3, (dim, 3)), "edges": edges}
    docs = [(1, prose(1, 30), 100), (2, "", 0), (3, None, None), (4, "a a a b", 7), (5, "#$% 12 é!", None)]
    got = op4_factorisation.score(spark.createDataFrame(docs, "doc_id bigint, text string, n_chars bigint").coalesce(1), model, [F.col("doc_id")]).collect()
    for r in got:
        _, text, chars = docs[r["doc_id"] - 1]
        z = pair_score(features(text, chars, edges), model["w0"], model["w"], model["v"])
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-9


def test_training_follows_the_gradient_of_the_pair_sum():
    """One AdaGrad step a row, against numerical gradients of the explicit pair sum."""
    rng = np.random.default_rng(11)
    dim, rate, l2 = op4_factorisation.DIM, 0.1, 1e-5
    rows = [(np.array([1, 5, 9]), np.array([0.5, 0.2, 0.4]), 1), (np.array([1, 7]), np.array([0.3, 0.9]), 0)]
    w0, w, v = 0.0, np.zeros(dim), rng.normal(0, 0.02, (dim, 2))
    gw, gv, g0 = np.full(dim, 1e-2), np.full((dim, 2), 1e-2), 1e-2
    loss = lambda x, y, *p: np.log1p(np.exp(-(2 * y - 1) * pair_score(x, *p)))
    slope = lambda f: (f(1e-6) - f(-1e-6)) / 2e-6
    for _ in range(2):
        for k in rng.permutation(2):
            at, values, y = rows[k]
            x = dict(zip(at.tolist(), values.tolist()))

            def moved(step, i=None, f=None):
                a, b = w.copy(), v.copy()
                if f is not None:
                    b[i, f] += step
                elif i is not None:
                    a[i] += step
                return loss(x, y, w0 + (step if i is None else 0), a, b)

            d0 = slope(moved)
            dw = {i: slope(lambda s, i=i: moved(s, i)) + l2 * w[i] for i in x}
            dv = {(i, f): slope(lambda s, i=i, f=f: moved(s, i, f)) + l2 * v[i, f] for i in x for f in range(2)}
            for i, d in dw.items():
                gw[i] += d * d
                w[i] -= rate * d / np.sqrt(gw[i])
            for key, d in dv.items():
                gv[key] += d * d
                v[key] -= rate * d / np.sqrt(gv[key])
            g0 += d0 * d0
            w0 -= rate * d0 / np.sqrt(g0)
    model = op4_factorisation.train(rows, factors=2, epochs=2)
    assert abs(model["w0"] - w0) < 1e-6 and np.allclose(model["w"], w, atol=1e-6) and np.allclose(model["v"], v, atol=1e-6)


def test_a_labelled_id_in_many_rows_gives_one_model(spark):
    rows = [(3, f"{prose(k, 5)}", k) for k in range(500)] + [(10 + k, prose(k, 10), k) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(3, 1), (3, 0)] + [(10 + k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    one, two = (op4_factorisation.fit(d, labels, F.lit(True), max_rows=30) for d in (docs.coalesce(1), docs.repartition(11)))
    assert one["w0"] == two["w0"] and (one["w"] == two["w"]).all() and (one["v"] == two["v"]).all()


def test_word_hashes_of_long_texts_are_cut_between_words():
    from quarrygraph.llm.common import utf8, words

    found, _ = words(*utf8(pa.array([prose(2, 300), "x" * 100 + " y"])))
    whole = op4_factorisation.word_hashes(found)
    for step in (1, 7, 100):
        assert (op4_factorisation.word_hashes(found, step) == whole).all()


def test_word_hash_depends_on_the_word_alone():
    from quarrygraph.llm.common import utf8, words

    found, _ = words(*utf8(pa.array(["ab cd", "cd ab x cd"])))
    h = op4_factorisation.word_hashes(found)
    assert h[0] == h[3] and h[1] == h[2] == h[5] and len(set(h.tolist())) == 3


def test_scores_on_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in (1, 2, 3, 5, 5, 8, 9, 12, 13, 14)] + [(None, 1, 0), (10, None, 0)], "doc_id bigint, quality int, toxic int")
    for docs, marks in ((odd_docs, labels), (no_docs, labels), (odd_docs, labels.filter("false"))):
        model = op4_factorisation.fit(docs, marks, ~op4_factorisation.held_out())
        rows = op4_factorisation.score(docs, model, [F.col("doc_id")]).collect()
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_scores_do_not_depend_on_batches(spark, odd_docs):
    model = op4_factorisation.fit(odd_docs, spark.createDataFrame([(k, int(k % 2)) for k in range(15)], "doc_id bigint, quality int"), F.lit(True))
    one = {(as_id(r["doc_id"]), round(r["score"], 9)) for r in op4_factorisation.score(odd_docs.coalesce(1), model, [F.col("doc_id")]).collect()}
    many = {(as_id(r["doc_id"]), round(r["score"], 9)) for r in op4_factorisation.score(odd_docs.repartition(9), model, [F.col("doc_id")]).collect()}
    assert one == many


def test_classifier_on_held_out_labels(spark):
    rows = op4_factorisation.op4_factorisation(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    quality = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    known = [(r["score"], r["predicted"], quality[r["doc_id"]]) for r in rows if r["doc_id"] in quality]
    assert np.mean([p == q for _, p, q in known]) > 0.9


# --- neighbours
def test_neighbours_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(7000, 24)).astype(np.float32)
    x[100:400] = x[100]  # one vector many times
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(9001, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [None] * 24), (9080, [1.0]), (None, x[0].tolist()), (40, x[40].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("part", F.lit(1))
    got = op3_neighbours.nearest(df, F.col("id") % 20 == 0, part_rows=900).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 7000, 20))
    y = x.astype(float)
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21)) and all(r["vec_id"] != q for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        s = y @ y[q]
        s[q] = -np.inf
        assert np.allclose([r["score"] for r in found], s[[r["vec_id"] for r in found]])
        best = np.lexsort((np.arange(len(s)), -s.round(9)))[:20]
        hit += len(set(best.tolist()) & {r["vec_id"] for r in found})
    assert hit / (20 * len(by)) >= 0.9
    assert [r["vec_id"] for r in by[200]] == [k for k in range(100, 122) if k != 200][:20]


def brute_neighbours(rows, top=20):
    """{query: [(score, id)]} with vectors of each length by themselves."""
    out = {}
    for q in {i for i, _ in rows if i % 20 == 0}:
        best = {}
        for _, v in (r for r in rows if r[0] == q):
            for i, w in rows:
                if i != q and len(w) == len(v):
                    s = float((np.array(v) * np.array(w)).sum())
                    best[i] = max(s, best.get(i, -np.inf))
        if best:
            out[q] = sorted(((-s, i) for i, s in best.items()))[:top]
    return out


@pytest.mark.parametrize("block_bytes", [1 << 10, 16 << 20])
def test_neighbours_of_mixed_lengths_and_repeated_ids(spark, block_bytes):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(700)]
    rows += [(k, rng.normal(size=3).tolist()) for k in range(690, 760)]  # some ids have a vector of each length
    rows += [(k % 30, rng.normal(size=6).tolist()) for k in range(300)] + [rows[40]] * 900  # ids with many vectors, one row many times
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in op3_neighbours.nearest(df, F.col("id") % 20 == 0, block_bytes=block_bytes, target=1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_neighbours(rows)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(want[q]) + 1)) and len({i for _, i, _ in found}) == len(found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
        if q > 700:  # lengths without an index are compared exactly
            assert [(i, round(s, 9)) for _, i, s in found] == [(i, round(-s, 9)) for s, i in want[q]]
    assert hits >= 0.95 * sum(map(len, want.values()))


def test_index_of_a_small_table_has_parts():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, size=(125, 8)) for c in (-4, -1, 2, 5)])
    model = op3_neighbours.fit_index(x, 4, 20, 0.95)
    assert model["parts"] == 4 and model["probes"] < 4


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbours_recall_on_the_tables(spark, sf):
    got = op3_neighbours.op3_neighbours(spark, f"/root/testdata/{sf}").collect()
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '/root/testdata/{sf}/embeddings.parquet'").fetchall()
    rows = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    best = {}
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        s[k] = -np.inf
        best[int(ids[k])] = set(ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist())
    hit = sum(r["vec_id"] in best[r["query_id"]] for r in got)
    print(sf, "recall", hit / sum(map(len, best.values())))
    assert hit >= 0.9 * sum(map(len, best.values()))


def test_neighbours_of_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.6, 0.8]), (21, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in op3_neighbours.nearest(few, F.col("id") % 20 == 0).collect()}
    assert got == {(0, 1, 20), (0, 2, 21), (20, 1, 21), (20, 2, 0)}
    assert op3_neighbours.nearest(few.filter("false"), F.col("id") % 20 == 0).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, size=(s, 5)) for c, s in ((-3, 300), (0, 100), (3, 200))])
    part = op3_neighbours.balanced_parts(op3_neighbours.neighbour_graph(x), 6)
    assert np.bincount(part, minlength=6).max() <= 1.1 * 100 + 1


# --- archives
def pages(spark):
    same = "<html>" + "same " * 40
    rows = [(3, "u3", same), (1, "u1", same), (2, None, "x"), (9, "u9", "x"), (None, "n", same), (5, "u5", None), (6, "u\r\n6%", "é漢" * 60), (1, "u1", same)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))


@pytest.mark.parametrize("roll", [1, 64 << 20])
def test_archive_round_trip(spark, tmp_path, roll):
    op7_warc.register(spark)
    path = f"file://{tmp_path}/w"
    op7_warc.records(pages(spark)).write.format("warc").option("roll_bytes", roll).mode("append").save(path)
    rows = spark.read.format("warc").load(path).collect()
    assert len(rows) == 8
    got = sorted((r["record_id"], r["record_type"], r["refers_to"] or "", len(r["payload"])) for r in rows)
    first = "<urn:page:1>"
    assert [g[:3] for g in got if g[0] == first] == [(first, "response", "")] * 2
    assert ("<urn:page:3>", "revisit", first, 0) in got and ("<urn:page:null>", "revisit", first, 0) in got
    assert ("<urn:page:9>", "response", "", 1) in got and ("<urn:page:5>", "response", "", 0) in got
    uri = [r for r in rows if r["record_id"] == "<urn:page:6>"][0]
    assert uri["target_uri"] == "u\r\n6%" and uri["payload"].decode() == "é漢" * 60
    only = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit' AND target_uri = 'u3'")
    assert [r["payload"] for r in only.collect()] == [None]
    raw = b"".join(gzip.open(f).read() for f in sorted(tmp_path.joinpath("w").glob("*.warc.gz")))
    assert raw.count(b"WARC/1.1\r\n") == 8  # any reader of gzip members can read it


def test_archive_without_records(spark, tmp_path):
    op7_warc.register(spark)
    op7_warc.records(pages(spark).filter("false")).write.format("warc").mode("append").save(f"file://{tmp_path}/w")
    assert spark.read.format("warc").load(f"file://{tmp_path}/w").count() == 0


def test_foreign_archives_are_read():
    body = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for data in (gzip.compress(body) + gzip.compress(other), body + other):
        got = list(op7_warc.read_records(io.BytesIO(data), lambda h: h["WARC-Type"] == "response"))
        assert [b for _, b in got] == [b"hello"]
        assert len(list(op7_warc.read_records(io.BytesIO(data), lambda h: True, payload=False))) == 2


def test_members_too_long_for_their_header_are_read(monkeypatch):
    monkeypatch.setattr(op7_warc, "_LONGEST", 200)
    bodies = [b"a" * 10, bytes(range(256)) * 40, b""]
    raw = b"".join(op7_warc.encode_record({"WARC-Type": "response", "WARC-Record-ID": str(k)}, b) for k, b in enumerate(bodies))
    assert [b for _, b in op7_warc.read_records(io.BytesIO(raw), lambda h: True)] == bodies
    assert gzip.decompress(raw).count(b"WARC/1.1") == 3


def test_payloads_of_unwanted_records_stay_coded():
    record = op7_warc.encode_record({"WARC-Type": "response"}, np.random.default_rng(0).bytes(1 << 20))

    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counting.total += len(out)
            return out

    assert not list(op7_warc.read_records(Counting(record * 3), lambda h: False))
    assert Counting.total < 20_000


# --- pieces
@pytest.fixture(scope="module")
def pieces():
    return op10_pieces.load(default_tokenizer("piece_bpe_32k.model"))


def unigram(path):
    """The same pieces and scores as a unigram model of the library."""
    import sentencepiece

    def vi(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    def field(k, b):
        return vi(k << 3 | 2) + vi(len(b)) + b

    raw = open(path, "rb").read()
    found, kind = op10_pieces.read_pieces(raw)
    scores = op10_pieces.log_scores(found, kind)
    out, k = b"", 0
    for number, value in op10_pieces._fields(raw):
        if number == 1:
            p, _, t = found[k]
            out += field(1, field(1, p.encode()) + vi(2 << 3 | 5) + struct.pack("<f", scores[k]) + vi(3 << 3) + vi(t))
            k += 1
        elif number == 2:
            body = b""
            for n, v in op10_pieces._fields(value):
                body += vi(n << 3) + vi(1 if n == 3 else v) if isinstance(v, int) else (vi(n << 3 | 5) + v if n == 10 else field(n, v))
            out += field(2, body)
        else:
            out += field(number, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out), scores


def test_pieces_equal_the_library(pieces):
    sp, scores = unigram(default_tokenizer("piece_bpe_32k.model"))
    texts = [prose(k, 60) for k in range(20)] + ["", " ", "  x  y ", " \n\t", "日本語のテキスト", "😀 z😀😀", "a▁b", "q" * 400, "é́ ß İ\x00", "Hello world, (x) -> y!!"]
    ids, ends = op10_pieces.PieceEncoder(pieces).encode(pa.array(texts))
    assert op10_pieces.decode(pieces, ids.astype(np.int64), ends) == [t.replace("▁", " ") for t in texts]
    for k, t in enumerate(texts):
        got, want = ids[ends[k] : ends[k + 1]].tolist(), sp.encode(t)
        assert got == want or np.isclose(sum(scores[i] for i in got), sum(scores[i] for i in want))


def test_trie_holds_its_keys_and_no_other(pieces):
    keys = sorted({b"a", b"ab", b"abc", b"b", b"\xff\x01", b"zz"})
    trie = op10_pieces.DoubleArray(keys)

    def find(key):
        s = 0
        for b in key:
            n = int(trie.base[s]) + b
            if trie.check[n] != s:
                return -1
            s = n
        return int(trie.value[s])

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"z") == find(b"abcd") == find(b"c") == find(b"\xff") == -1


def test_pieces_of_odd_rows(odd_docs, no_docs, pieces):
    rows = op10_pieces.encode_documents(odd_docs, pieces).collect()
    assert sorted((as_id(r["doc_id"]), r["decoded"]) for r in rows) == sorted((as_id(r["doc_id"]), r["text"] or "") for r in odd_docs.collect())
    assert op10_pieces.encode_documents(no_docs, pieces).count() == 0
