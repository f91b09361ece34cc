"""SQL files as rows, and what changed since they were stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes read, folders never entered.
SUFFIXES = (".sql", ".ddl", ".hql")
SKIPPED = ("node_modules", "__pycache__", "venv", "target", "build")


def file_stem(path) -> F.Column:
    """Name of a file without folder and suffix."""
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def file_paths_by_stem(files: DataFrame, stems: DataFrame) -> DataFrame:
    """(repo_id, stem, path) of stored SQL files of those stems (repo_id, stem), in whatever folder."""
    named = files.filter(F.col("path").endswith(".sql")).select("repo_id", "path", file_stem("path").alias("stem"))
    return named.join(stems.select("repo_id", "stem").distinct(), ["repo_id", "stem"]).select("repo_id", "stem", "path")


def source_fingerprint(files: DataFrame) -> str:
    """One hash of the names and checksums (path, checksum) of a project's sources, in any order."""
    row = files.select(F.sha2(F.concat_ws(":", "path", "checksum"), 256).alias("h")).agg(F.count("*").alias("n"), *[F.sum(F.conv(F.substring("h", k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in (1, 13, 25)]).first()
    return ":".join(str(x or 0) for x in row)


def is_sql(path) -> F.Column:
    low = F.lower(path)
    return low.endswith(SUFFIXES[0]) | low.endswith(SUFFIXES[1]) | low.endswith(SUFFIXES[2])


def scannable(path) -> F.Column:
    """Relative paths of SQL files outside hidden and generated folders."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    bad = F.exists(dirs, lambda d: d.startswith(".") | d.isin(*SKIPPED))
    return ~bad & is_sql(path)


def scan_repo(spark: SparkSession, repo: str, root: str) -> DataFrame:
    """(repo, path, text, checksum) of the SQL files below a folder that Spark can read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.col("path"), f"^(?:[a-z0-9]+:/*)?/?{_quote(base.lstrip('/'))}/", "")
    rows = files.select(F.lit(repo).alias("repo"), rel.alias("path"), "content").filter(scannable(F.col("path")))
    return rows.select("repo", "path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("checksum"))


def _quote(text: str) -> str:
    import re

    return re.escape(text)


def incremental_diff(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(repo, path, change): added, changed or deleted files, by checksum."""
    s, n = stored.select("repo", "path", F.col("checksum").alias("old")), scanned.select("repo", "path", F.col("checksum").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return s.join(n, ["repo", "path"], "full").select("repo", "path", change.alias("change")).filter("change IS NOT NULL")


def has_jinja(text) -> F.Column:
    """Templates, which are recorded but not parsed."""
    return text.contains("{{") | text.contains("{%")


def glob_pattern(glob: str) -> str:
    """A shell pattern as a regular expression."""
    import fnmatch

    return "(?s)^" + fnmatch.translate(glob).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z") + "$"


def resolve_dialect(files: DataFrame, overrides: list[tuple[str, str]], default: str | None = None) -> DataFrame:
    """``files`` with ``dialect``: that of the first override whose prefix or shell pattern matches the path."""
    out = F.lit(default)
    for pattern, dialect in reversed(overrides):
        out = F.when(F.col("path").startswith(pattern) | F.col("path").rlike(glob_pattern(pattern)), dialect).otherwise(out)
    return files.withColumn("dialect", out)


def resolve_repos(paths: DataFrame, repos: DataFrame) -> DataFrame:
    """(path, repo) of absolute paths: the repo of the deepest root above each. A path meets only its own
    ancestors, so the join is on equality."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    roots = repos.select(F.regexp_replace("root", "/+$", "").alias("root"), F.col("name").alias("repo"))
    hit = paths.select("path", F.explode(up).alias("root")).join(roots, "root")
    return hit.groupBy("path").agg(F.max_by("repo", F.struct(F.length("root"), "repo")).alias("repo"))
