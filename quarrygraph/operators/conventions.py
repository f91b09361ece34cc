"""Conventions inferred from the stored graph: layers, naming, reference rules, columns and their style.

All repos are inferred together, keyed by repo. Ties go to the alphabetically first value.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrygraph.functions.predicates import column_style, hundredths
from quarrygraph.graph import Graph
from quarrygraph.runtime import materialise

LAYER = ["repo_id", "layer"]


def _layer_confidence(n: str):
    return F.when(F.col(n) >= 10, 0.9).when(F.col(n) >= 5, 0.8).otherwise(0.6)


def layer_members(g: Graph) -> DataFrame:
    """(repo_id, layer, prefix, name): each model and path once, in its layer.

    The folders that all files of a repo share are dropped (one fewer if that leaves nothing); the next one
    names the layer, or the next two where a second folder repeats under several first ones. If such
    two-part layers repeat their second part, only that part counts.
    """
    files = g.files.filter("repo_id IS NOT NULL")
    rows = g.nodes.filter(F.col("kind").isin("table", "view")).join(files, "file_id").select("repo_id", F.col("name"), F.split(F.translate("path", "\\", "/"), "/").alias("parts"), "path").distinct()
    rows = rows.withColumn("dirs", F.slice("parts", 1, F.size("parts") - 1))
    # The prefix that the least and the greatest list share is shared by all between.
    ends = rows.filter(F.size("dirs") > 0).groupBy("repo_id").agg(F.min("dirs").alias("lo"), F.max("dirs").alias("hi"), F.min(F.size("dirs")).alias("short"), F.max(F.size("dirs")).alias("deep"))
    same = F.transform(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), lambda x: x)
    shared = F.least(F.when(F.array_position(same, F.lit(False)) > 0, F.array_position(same, F.lit(False)) - 1).otherwise(F.size(same)), F.col("short")).cast("int")
    ends = ends.select("repo_id", shared.alias("shared"), "deep", F.col("lo"))
    cut = F.when((F.col("deep") <= F.col("shared")) & (F.col("shared") > 0), F.col("shared") - 1).otherwise(F.col("shared"))
    ends = ends.select("repo_id", cut.alias("cut"), F.array_join(F.slice("lo", 1, cut), "/").alias("prefix"))
    rows = rows.join(ends, "repo_id").withColumn("rest", F.slice("dirs", F.col("cut") + 1, F.greatest(F.size("dirs") - F.col("cut"), F.lit(0)))).filter(F.size("rest") > 0)
    seconds = rows.filter(F.size("rest") > 1).select("repo_id", F.col("rest")[0].alias("a"), F.col("rest")[1].alias("b")).distinct()
    nested = seconds.groupBy("repo_id", "b").count().filter("count > 1").select("repo_id").distinct().withColumn("nested", F.lit(True))
    two = F.col("nested").isNotNull() & (F.size("rest") > 1)
    rows = rows.join(nested, "repo_id", "left").withColumn("second", F.when(two, F.col("rest")[1])).withColumn("key", F.when(two, F.concat_ws("/", F.col("rest")[0], F.col("rest")[1])).otherwise(F.col("rest")[0]))
    fold = rows.filter("second IS NOT NULL").groupBy("repo_id").agg((F.countDistinct("key") > F.countDistinct("second")).alias("fold"))
    rows = rows.join(fold, "repo_id", "left")
    layer = F.when(F.col("fold") & F.col("second").isNotNull(), F.col("second")).otherwise(F.col("key"))
    return rows.select("repo_id", layer.alias("layer"), "prefix", "name")


def _real_layers(members: DataFrame) -> DataFrame:
    return members.groupBy(*LAYER).agg(F.count("*").alias("model_count")).filter("model_count >= 2")


def detect_layers(g: Graph) -> DataFrame:
    """Layers of two models or more."""
    members = layer_members(g)
    out = members.groupBy(*LAYER).agg(F.count("*").alias("model_count"), F.min("prefix").alias("prefix")).filter("model_count >= 2")
    pattern = F.concat(F.when(F.col("prefix") != "", F.concat("prefix", F.lit("/"))).otherwise(""), "layer", F.lit("/**"))
    return out.select(*LAYER, pattern.alias("path_pattern"), "model_count", _layer_confidence("model_count").alias("confidence"))


def naming_patterns(members: DataFrame) -> DataFrame:
    """(repo_id, layer, pattern, confidence, matching_count, total_count) from (repo_id, layer, name) rows."""
    rows = members.select(*LAYER, "name", F.split("name", "_").alias("tokens")).withColumn("token", F.col("tokens")[0])
    total = rows.groupBy(*LAYER).agg(F.count("*").alias("total"))
    top = Window.partitionBy(*LAYER).orderBy(F.desc("count"), "token")
    first = rows.groupBy(*LAYER, "token").count().withColumn("r", F.row_number().over(top)).filter("r = 1").join(total, LAYER)
    first = first.select(*LAYER, "total", F.when(F.col("count") / F.col("total") >= 0.7, F.col("token")).alias("prefix"))
    rows = rows.drop("token").join(first, LAYER).withColumn("has", F.coalesce(F.col("tokens")[0] == F.col("prefix"), F.lit(False)))
    rows = rows.withColumn("rest", F.when(F.col("has"), F.slice("tokens", 2, F.size("tokens"))).otherwise(F.col("tokens"))).withColumn("len", F.size("rest"))
    common = Window.partitionBy(*LAYER).orderBy(F.desc("count"), "len")
    usual = rows.filter("len > 0").groupBy(*LAYER, "len").count().withColumn("r", F.row_number().over(common)).filter("r = 1").select(*LAYER, F.col("len").alias("usual"))
    rows = materialise(rows.join(usual, LAYER, "left").withColumn("usual", F.coalesce("usual", F.lit(0))), "names")
    at = rows.filter("usual > 0").select(*LAYER, "usual", F.posexplode(F.slice("rest", 1, F.col("usual"))).alias("pos", "token"))
    seen = at.groupBy(*LAYER, "usual", "pos").agg(F.countDistinct("token").alias("distinct"), F.count("*").alias("n"))
    label = F.when((F.col("distinct") / F.col("n") < 0.3) & (F.col("distinct") <= 5), "source").when(F.col("pos") == F.col("usual") - 1, "entity").when(F.col("pos") == 0, "domain").otherwise("description")
    labels = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", label.alias("label")))), lambda x: F.concat(F.lit("{"), x["label"], F.lit("}"))), "_")
    labels = seen.groupBy(*LAYER).agg(labels.alias("labels"))
    fits = F.when(F.col("prefix").isNotNull(), F.col("has")).otherwise(F.col("len") == F.col("usual"))
    out = rows.groupBy(*LAYER, "prefix", "total").agg(F.count_if(fits).alias("matching_count")).join(labels, LAYER, "left")
    share = F.col("matching_count") / F.col("total")
    confidence = F.when(F.col("prefix").isNotNull(), share).otherwise(share * 0.7)
    confidence = F.when(F.col("total") < 5, F.least(confidence, F.lit(0.6))).otherwise(confidence)
    pattern = F.concat(F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit("_"))).otherwise(""), F.coalesce("labels", F.lit("{description}")))
    return out.select(*LAYER, pattern.alias("pattern"), hundredths(confidence).alias("confidence"), "matching_count", F.col("total").alias("total_count"))


def reference_rules(g: Graph, members: DataFrame | None = None) -> DataFrame:
    """(repo_id, source_layer, target_layer, share, allowed, confidence): references between layers of a repo,
    by name. A name in several layers belongs to the largest, then the first."""
    members = members if members is not None else materialise(layer_members(g), "members")
    sizes = _real_layers(members)
    best = Window.partitionBy("repo_id", "name").orderBy("model_count", F.desc("layer"))
    of = members.join(sizes, LAYER).withColumn("r", F.row_number().over(best)).filter("r = 1").select("repo_id", "name", "layer")
    files = g.files.select("file_id", "repo_id")
    e = g.ends().filter(F.col("relationship").isin("references", "cte_references"))
    e = e.join(files.select(F.col("file_id").alias("src_file"), "repo_id"), "src_file").join(files.select(F.col("file_id").alias("tgt_file"), F.col("repo_id").alias("tgt_repo")), "tgt_file", "left")
    e = e.filter(F.col("tgt_file").isNull() | (F.col("repo_id") == F.col("tgt_repo")))
    e = e.join(of.select("repo_id", F.col("name").alias("src_name"), F.col("layer").alias("source_layer")), ["repo_id", "src_name"])
    e = e.join(of.select("repo_id", F.col("name").alias("tgt_name"), F.col("layer").alias("target_layer")), ["repo_id", "tgt_name"]).filter("source_layer <> target_layer")
    counts = e.groupBy("repo_id", "source_layer", "target_layer").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy("repo_id", "source_layer")
    share = hundredths(F.col("n") / F.sum("n").over(all_))
    rows = counts.withColumn("share", share)
    return rows.select("repo_id", "source_layer", "target_layer", "share", (F.col("share") >= 0.1).alias("allowed"), F.max("share").over(all_).alias("confidence"))


def _layer_nodes(g: Graph, members: DataFrame) -> DataFrame:
    """(repo_id, layer, node_id, name): nodes of a repo whose name is one of the layer's."""
    at = g.nodes.join(g.files.select("file_id", "repo_id"), "file_id").select("repo_id", "name", "node_id")
    named = members.join(_real_layers(members), LAYER, "left_semi").select(*LAYER, "name").distinct()
    return named.join(at, ["repo_id", "name"])


def required_columns(g: Graph, members: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """(repo_id, layer, column_name, frequency, source, missing): columns that most models declare or select."""
    members = members if members is not None else materialise(layer_members(g), "members")
    nodes = materialise(_layer_nodes(g, members), "layer-nodes")
    key = [*LAYER, "column_name"]
    d = nodes.join(g.columns.select("node_id", "column_name"), "node_id").groupBy(*key).agg(F.countDistinct("node_id").alias("d"))
    used = nodes.join(g.column_usage.select("node_id", "column_name", "usage_type"), "node_id")
    u = used.filter("usage_type = 'select'").groupBy(*key).agg(F.countDistinct("node_id").alias("u"))
    both = d.join(u, key, "full").join(_real_layers(members), LAYER)
    share = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)) / F.col("model_count"), F.lit(1.0))
    kept = both.withColumn("f", F.greatest(share("d"), share("u"))).filter(F.col("f") >= threshold)
    source = F.when(F.col("d").isNotNull() & F.col("u").isNotNull(), "both").when(F.col("d").isNotNull(), "definition").otherwise("usage")
    kept = kept.select(*key, hundredths(F.col("f")).alias("frequency"), source.alias("source"))
    has = nodes.join(g.columns.select("node_id", "column_name"), "node_id").select(*key, "name").unionByName(used.select(*key, "name")).distinct()
    missing = kept.select(*key).join(members.select(*LAYER, "name"), LAYER).join(has, [*key, "name"], "left_anti")
    missing = missing.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("missing"))
    return kept.join(missing, key, "left").withColumn("missing", F.coalesce("missing", F.lit("")))


def column_styles(g: Graph, members: DataFrame | None = None) -> DataFrame:
    """(repo_id, layer, style, confidence): the style of most distinct declared columns, or of used ones where
    a layer declares none. Names without a style do not count."""
    members = members if members is not None else materialise(layer_members(g), "members")
    nodes = materialise(_layer_nodes(g, members), "layer-nodes")
    declared = nodes.join(g.columns.select("node_id", "column_name"), "node_id").select(*LAYER, "column_name").distinct()
    used = nodes.join(g.column_usage.select("node_id", "column_name"), "node_id").select(*LAYER, "column_name").distinct()
    names = declared.unionByName(used.join(declared, LAYER, "left_anti")).withColumn("style", column_style("column_name"))
    # fixed values: the order in which equal counts win
    order = F.array_position(F.array(*map(F.lit, ["snake_case", "camelCase", "PascalCase", "SCREAMING_SNAKE"])), F.col("style"))
    counts = names.filter("style IS NOT NULL").groupBy(*LAYER, "style").count()
    best = Window.partitionBy(*LAYER).orderBy(F.desc("count"), order)
    top = counts.withColumn("r", F.row_number().over(best)).withColumn("all", F.sum("count").over(Window.partitionBy(*LAYER))).filter("r = 1")
    top = top.select(*LAYER, "style", hundredths(F.col("count") / F.col("all")).alias("confidence"))
    layers = _real_layers(members).select(*LAYER)
    return layers.join(top, LAYER, "left").select(*LAYER, F.coalesce("style", F.lit("snake_case")).alias("style"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def infer_conventions(g: Graph) -> DataFrame:
    """Rows of the conventions table for every repo and layer."""
    members = materialise(layer_members(g), "members")
    sizes = _real_layers(members)
    out = []
    n = naming_patterns(members.join(sizes, LAYER, "left_semi"))
    out.append(n.select(*LAYER, F.lit("naming").alias("convention_type"), F.to_json(F.struct("pattern", "matching_count", "total_count")).alias("payload"), "confidence"))
    r = reference_rules(g, members).groupBy("repo_id", F.col("source_layer").alias("layer")).agg(
        F.sort_array(F.collect_list(F.when(F.col("allowed"), F.col("target_layer")))).alias("allowed_targets"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("target_layer", "share")))).alias("target_distribution"),
        F.max("confidence").alias("confidence"),
    )
    out.append(r.select(*LAYER, F.lit("references").alias("convention_type"), F.to_json(F.struct("allowed_targets", "target_distribution")).alias("payload"), "confidence"))
    c = required_columns(g, members).groupBy(*LAYER).agg(F.array_sort(F.collect_list(F.struct("column_name", "frequency", "source", "missing"))).alias("columns"), F.max("frequency").alias("confidence"))
    out.append(c.select(*LAYER, F.lit("required_columns").alias("convention_type"), F.to_json(F.struct("columns")).alias("payload"), "confidence"))
    s = column_styles(g, members)
    out.append(s.select(*LAYER, F.lit("column_style").alias("convention_type"), F.to_json(F.struct("style")).alias("payload"), "confidence"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows.join(sizes, LAYER).select("repo_id", "layer", "convention_type", "payload", "confidence", F.lit("inferred").alias("source"), "model_count")


def merge_conventions(stored: DataFrame, inferred: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Overrides win over stored overrides, which win over inferred rows; older inferred rows go."""
    rows = stored.filter("source = 'override'").withColumn("p", F.lit(1)).unionByName(inferred.withColumn("p", F.lit(2)))
    if overrides is not None:
        rows = rows.unionByName(overrides.withColumn("p", F.lit(0)))
    key = Window.partitionBy("repo_id", "layer", "convention_type").orderBy("p")
    return rows.withColumn("r", F.row_number().over(key)).filter("r = 1").drop("r", "p")


def overrides_from_yaml(g: Graph, repo_id: int, text: str) -> DataFrame:
    """Override rows from the ``conventions`` key of a YAML text: ``{layer: {type: value}}``."""
    import yaml

    found = (yaml.safe_load(text) or {}).get("conventions") or {}
    rows = []
    for layer, kinds in found.items():
        for kind, value in (kinds or {}).items():
            payload = {"pattern": value} if kind == "naming" and isinstance(value, str) else {"allowed_targets": value} if kind == "references" and isinstance(value, list) else {"columns": value} if kind == "required_columns" and isinstance(value, list) else {"style": value} if kind == "column_style" and isinstance(value, str) else value
            rows.append((repo_id, layer, kind, json.dumps(payload), 1.0, "override", 0))
    from quarrygraph.schema import TABLES

    return g.spark.createDataFrame(rows, TABLES["conventions"])


def conventions_yaml(conventions: DataFrame) -> str:
    """A YAML text of stored conventions with their confidence as comments; a few rows a layer."""
    lines = ["conventions:"]
    last = None
    for r in conventions.orderBy("layer", "convention_type").collect():
        if r["layer"] != last:
            last = r["layer"]
            lines.append(f"  {json.dumps(last)}:")
        lines.append(f"    {r['convention_type']}: {r['payload']}  # confidence {r['confidence']:.2f}, {r['source']}")
    return "\n".join(lines) + "\n"


def conventions_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(layer, convention_type, change): added, removed or changed rows."""
    key = ["repo_id", "layer", "convention_type"]
    a, b = old.select(*key, F.col("payload").alias("before")), new.select(*key, F.col("payload").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return a.join(b, key, "full").select(*key, change.alias("change"), "before", "after").filter("change IS NOT NULL")


def get_conventions(g: Graph, layer: str | None = None, repo: str | None = None) -> DataFrame:
    """One row a layer, a column a convention type, and a note where few models stand behind it."""
    rows = g.conventions
    if repo is not None:
        rows = rows.join(g.repos.filter(F.col("name") == repo).select("repo_id"), "repo_id", "left_semi")
    if layer is not None:
        rows = rows.filter(F.col("layer") == layer)
    wide = rows.groupBy("repo_id", "layer").pivot("convention_type", ["naming", "references", "required_columns", "column_style"]).agg(F.first("payload"))
    n = rows.groupBy("repo_id", "layer").agg(F.max("model_count").alias("model_count"))
    note = F.when(F.col("model_count") < 10, "few models: advisory only")
    return wide.join(n, LAYER).withColumn("note", note).orderBy("repo_id", "layer")
