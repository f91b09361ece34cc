"""The dependency graph as a set of DataFrames, with snapshots on disk."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.schema import TABLES


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of the stored table in order; missing ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table].fields])


@dataclass
class Graph:
    """Immutable: maintenance operators return a new graph."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Graph:
        return cls(spark, {k: conform(tables[k], k) if k in tables else spark.createDataFrame([], s) for k, s in TABLES.items()})

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(name)

    def having(self, **tables: DataFrame) -> Graph:
        return replace(self, tables=self.tables | {k: conform(v, k) for k, v in tables.items()})

    def save(self, path: str) -> str:
        """Write a new snapshot below ``path`` and point ``CURRENT`` at it last, so readers never see a part of one."""
        version = uuid.uuid4().hex
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/{version}/{name}")
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/CURRENT")
        return version

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str | None = None) -> Graph:
        version = version or spark.read.schema("version string").json(f"{path}/CURRENT").first()["version"]
        return cls.of(spark, **{n: spark.read.schema(s).parquet(f"{path}/{version}/{n}") for n, s in TABLES.items()})

    def located(self) -> DataFrame:
        """Nodes with file path, repo id and repo name; phantoms have nulls."""
        files = self.files.select("file_id", "path", "repo_id")
        repos = self.repos.select("repo_id", F.col("name").alias("repo"))
        return self.nodes.join(files, "file_id", "left").join(repos, "repo_id", "left")

    def ends(self) -> DataFrame:
        """Edges with name, kind and file of both ends."""
        n = self.nodes
        s = n.select(F.col("node_id").alias("source_id"), F.col("name").alias("src_name"), F.col("kind").alias("src_kind"), F.col("file_id").alias("src_file"))
        t = n.select(F.col("node_id").alias("target_id"), F.col("name").alias("tgt_name"), F.col("kind").alias("tgt_kind"), F.col("file_id").alias("tgt_file"))
        return self.edges.select("source_id", "target_id", "relationship", "context").join(s, "source_id").join(t, "target_id")
