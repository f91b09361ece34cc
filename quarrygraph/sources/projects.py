"""dbt manifests, schema files and rendered models as DataFrames. Rendering itself happens outside."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_COLUMNS = "map<string, struct<name:string, data_type:string, description:string>>"
_ENTITY = f"struct<resource_type:string, package_name:string, name:string, alias:string, identifier:string, path:string, schema:string, depends_on:struct<nodes:array<string>, public_nodes:array<string>>, columns:{_COLUMNS}>"
_MANIFEST = f"nodes map<string,{_ENTITY}>, sources map<string,{_ENTITY}>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, ...) of all nodes and sources of a manifest file."""
    text = spark.read.text(path, wholetext=True)
    m = text.select(F.from_json("value", _MANIFEST).alias("m"))
    nodes = m.select(F.explode("m.nodes").alias("key", "e")).select(F.lit("node").alias("kind"), "key", "e.*")
    sources = m.select(F.explode("m.sources").alias("key", "e")).select(F.lit("source").alias("kind"), "key", "e.*")
    return nodes.unionByName(sources)


def manifest_edges(manifest: DataFrame, project: str, select: list[str] | None = None) -> DataFrame:
    """(path, source_name, source_schema, target_name, context): references of a project's models.

    A dependency that the manifest does not describe is named by its key, if the key has the usual parts.
    """
    models = manifest.filter((F.col("kind") == "node") & (F.col("resource_type") == "model") & (F.col("package_name") == project) & F.col("name").isNotNull() & F.col("path").isNotNull())
    if select:
        models = models.filter(F.col("name").isin(select))
    stem = F.split(F.regexp_replace("path", r"\.sql$", ""), "/")
    folder = F.array_join(F.slice(stem, 1, F.size(stem) - 1), "/")
    none = F.array().cast("array<string>")
    deps = F.concat(F.coalesce("depends_on.nodes", none), F.coalesce("depends_on.public_nodes", none))
    rows = models.select("path", F.element_at(stem, -1).alias("source_name"), F.nullif(folder, F.lit("")).alias("source_schema"), F.explode(deps).alias("dep"))
    known = manifest.select(F.col("key").alias("dep"), F.when((F.col("kind") == "node") & F.col("resource_type").isin("model", "seed", "snapshot"), F.col("name")).when(F.col("kind") == "source", F.coalesce(F.nullif("identifier", F.lit("")), "name")).alias("named"), F.when(F.col("kind") == "source", "source()").otherwise("ref()").alias("how"))
    rows = rows.join(known, "dep", "left")
    parts = F.split("dep", r"\.")
    is_source = (parts[0] == "source") & (F.size(parts) == 4)
    is_model = parts[0].isin("model", "seed", "snapshot") & (F.size(parts) == 3)
    target = F.coalesce("named", F.when(is_source | is_model, F.element_at(parts, -1)))
    context = F.when(F.col("named").isNotNull(), F.col("how")).when(is_source, "source()").otherwise("ref()")
    rows = rows.select("path", "source_name", "source_schema", target.alias("target_name"), context.alias("context"))
    return rows.filter(F.col("target_name").isNotNull() & (F.col("target_name") != F.col("source_name"))).distinct()


def manifest_columns(manifest: DataFrame) -> DataFrame:
    """(table_name, column_name, data_type): under the bare name and, where there is a schema, the qualified one.
    A known type is never lost to an unknown one."""
    node = (F.col("kind") == "node") & F.col("resource_type").isin("model", "seed", "snapshot")
    name = F.when(node, F.coalesce(F.nullif("alias", F.lit("")), "name")).when(F.col("kind") == "source", F.coalesce(F.nullif("identifier", F.lit("")), "name"))
    rows = manifest.select(name.alias("base"), "schema", F.explode("columns").alias("k", "c")).filter("base IS NOT NULL")
    keys = F.array_compact(F.array("base", F.when(F.coalesce("schema", F.lit("")) != "", F.concat_ws(".", "schema", "base"))))
    rows = rows.select(F.explode(keys).alias("table_name"), F.coalesce("c.name", "k").alias("column_name"), F.col("c.data_type").alias("data_type"))
    return rows.groupBy("table_name", "column_name").agg(F.max("data_type").alias("data_type"))


def effective_schema(catalog: DataFrame, documented: DataFrame, manifest: DataFrame) -> DataFrame:
    """(table_name, column_name, data_type): the manifest's types, then documented ones, then the graph's, then TEXT."""
    ranked = manifest.withColumn("r", F.lit(0)).unionByName(documented.withColumn("r", F.lit(1))).unionByName(catalog.withColumn("r", F.lit(2)))
    best = Window.partitionBy("table_name", "column_name").orderBy(F.col("data_type").isNull(), "r")
    return ranked.withColumn("n", F.row_number().over(best)).filter("n = 1").select("table_name", "column_name", F.coalesce("data_type", F.lit("TEXT")).alias("data_type"))


def schema_yml(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(entity, model, column_name, data_type, position, description) of models and sources in YAML texts
    (path, text), parsed on executors. A text that is no YAML gives no rows."""
    import pandas as pd

    def run(batches):
        import yaml

        for pdf in batches:
            out = []
            for text in pdf.text:
                try:
                    found = yaml.safe_load(text) or {}
                except yaml.YAMLError:
                    continue
                if not isinstance(found, dict):
                    continue
                tables = [("model", m.get("name"), m) for m in found.get("models") or []]
                tables += [("source", t.get("identifier") or t.get("name"), t) for s in found.get("sources") or [] for t in s.get("tables") or []]
                for entity, name, t in tables:
                    for k, c in enumerate(t.get("columns") or []):
                        if name and c.get("name"):
                            out.append((entity, name, c["name"], c.get("data_type"), k, c.get("description")))
            yield pd.DataFrame(out, columns=["entity", "model", "column_name", "data_type", "position", "description"])

    return files.select("text").mapInPandas(run, "entity string, model string, column_name string, data_type string, position bigint, description string")


def merge_documented(inferred: DataFrame, documented: DataFrame) -> DataFrame:
    """Column definitions of models (model, column_name, ...): documented columns first, in their order, then the
    other inferred ones, with positions counted anew."""
    d = documented.select("model", "column_name", "data_type", "position", F.lit("schema_yml").alias("source"), "description", F.lit(0).alias("r"))
    rest = inferred.join(documented, ["model", "column_name"], "left_anti")
    i = rest.select("model", "column_name", "data_type", "position", "source", "description", F.lit(1).alias("r"))
    types = inferred.select("model", "column_name", F.col("data_type").alias("own_type"))
    rows = d.join(types, ["model", "column_name"], "left").withColumn("data_type", F.coalesce("data_type", "own_type")).drop("own_type").unionByName(i)
    order = Window.partitionBy("model").orderBy("r", "position", "column_name")
    return rows.select("model", "column_name", "data_type", (F.row_number().over(order) - 1).cast("long").alias("position"), "source", "description")


def compiled_models(files: DataFrame, deepest: bool = False) -> DataFrame:
    """Compiled model queries (repo, path, text) as CREATE statements of the model in its folder's schema; with
    ``deepest`` the schema is the last folder alone."""
    parts = F.split(F.regexp_replace("path", r"\.sql$", ""), "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("") if deepest else F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    name = F.when(folder != "", F.concat(F.lit('"'), folder, F.lit('"."'), F.element_at(parts, -1), F.lit('"'))).otherwise(F.concat(F.lit('"'), F.element_at(parts, -1), F.lit('"')))
    body = F.regexp_replace("text", r";\s*$", "")
    return files.withColumn("text", F.concat(F.lit("CREATE TABLE "), name, F.lit(" AS\n"), body))


def model_path(name) -> F.Column:
    """A dotted model name, parts quoted or not, as a path."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r'("[^"]*"|`[^`]*`|[^.]+)'), 1), lambda x: F.regexp_replace(x, r'^["`]|["`]$', "")), "/")


def rendered_models(spark: SparkSession, path: str) -> DataFrame:
    """(model_name, rendered_sql, column_schemas) from JSON lines or arrays of rendered models."""
    return spark.read.schema("name string, sql string, columns map<string,string>").option("multiLine", "true").json(path).select(F.col("name").alias("model_name"), F.col("sql").alias("rendered_sql"), F.to_json("columns").alias("column_schemas"))


def split_model_name(name: str) -> tuple[str, str | None]:
    """(base, schema) of a dotted name whose parts may be quoted."""
    import re

    parts = [p[1:-1] if p[:1] in "\"`" else p for p in re.findall(r'"[^"]*"|`[^`]*`|[^.]+', name)]
    return parts[-1], parts[-2] if len(parts) > 1 else None


def parse_env(text: str) -> dict[str, str]:
    """Variables of a dotenv text."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            key, _, value = line.partition("=")
            value = value.strip()
            out[key.strip()] = value[1:-1] if value[:1] in "'\"" and value[-1:] == value[:1] and len(value) > 1 else value
    return out


def read_config(path: str) -> dict:
    """Repos and options from a YAML or JSON file."""
    import yaml

    with open(path) as f:
        text = f.read()
    return json.loads(text) if path.endswith(".json") else yaml.safe_load(text) or {}
