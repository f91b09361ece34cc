"""The corpus pipeline: language identification, line dedup, SimHash near-dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrygraph.llm import op1_language, op5_suffixes, op6_lines, op8_packing, op9_simhash
from quarrygraph.llm.common import persist, table

STAGES = [
    ("language", op1_language.stage),
    ("lines", op6_lines.stage),
    ("near_duplicates", op9_simhash.stage),
    ("suffixes", op5_suffixes.stage),
    ("packing", op8_packing.stage),
]

#: No stage's classifier, fingerprints or tokens can be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole ``documents`` table, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = persist(docs, f"stage-{name}")
    return docs
