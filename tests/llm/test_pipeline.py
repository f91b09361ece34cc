"""The stages, each on what its predecessor kept, against brute force."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarrygraph.llm import op9_simhash
from quarrygraph.llm.common import persist
from tests.llm.test_text_operators import as_id, brute_lines, brute_suffixes, check_sequences

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = persist(stage(spark, docs, SF), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = rows(docs)
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) or name == "language"
    want = [(i, t) for i, t in brute_lines(kept["language"]) if t.strip(" \t\n\x0b\f\r")]
    assert sorted(kept["lines"]) == sorted(want)
    prints = {i: op9_simhash.fingerprint(t) for i, t in kept["lines"]}
    left = {i for i, _ in kept["near_duplicates"]}
    assert left <= set(prints)
    for i in set(prints) - left:
        assert any((prints[i] ^ prints[j]).bit_count() <= 4 for j in prints if j < i)
    want = [(i, raw.decode("utf-8", "ignore")) for i, raw, *_ in brute_suffixes(kept["near_duplicates"])]
    assert sorted(kept["suffixes"]) == sorted((i, t) for i, t in want if t.split())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_sequences(packed)
    assert {r["doc_id"] for r in packed} == {i for i, _ in kept["suffixes"]}
    assert len(left) > 0.8 * len(prints)


def test_stages_on_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = {as_id(r["doc_id"]) for r in docs.collect()}
            docs = persist(stage(spark, docs, SF), name)
            assert docs.columns == odd_docs.columns
            assert {as_id(r["doc_id"]) for r in docs.collect()} <= before
        assert np.isin([r["length"] > 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()], [True]).all()


def test_stages_keep_columns_with_reserved_names(spark, odd_docs):
    """Extra columns named like those that the stages add, in any letter case."""
    names = ["lang__", "score__", "own_key__", "ID__", "tkey__", "keep__", "Dropped__", "settled__", "windows__", "open__", "row__", "gone__", "way__", "key__", "fp", "component_id", "h1", "root"]
    docs = odd_docs.drop("open").withColumns({n: F.lit(k) for k, n in enumerate(names)})
    want = list(range(len(names)))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = persist(stage(spark, docs, SF), name)
        assert docs.columns[-len(names) :] == names
        found = docs.collect()
        assert found and all([r[n] for n in names] == want for r in found)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
