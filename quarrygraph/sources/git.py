"""Two versions of a repository's SQL files, by git on the driver."""

from __future__ import annotations

import hashlib
import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

_REVISION = re.compile(r"^[0-9A-Za-z][0-9A-Za-z._/~^-]*$")
_FILES = "repo string, path string, text string, checksum string"


def _git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=60).stdout


def head(root: str) -> tuple[str, str]:
    """(commit, branch) that is checked out."""
    return _git(root, "rev-parse", "HEAD").strip(), _git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()


def changed_paths(root: str, base: str) -> list[str]:
    """SQL files that differ between ``base`` and what is checked out."""
    if not _REVISION.match(base):
        raise ValueError(f"no revision: {base!r}")
    return [p for p in _git(root, "diff", "--name-only", f"{base}..HEAD").splitlines() if p.lower().endswith((".sql", ".ddl", ".hql"))]


def versions(spark: SparkSession, repo: str, root: str, base: str) -> tuple[DataFrame, DataFrame]:
    """(repo, path, text, checksum) of the changed files before and after; the list of one change is small."""

    def at(revision: str) -> DataFrame:
        rows = []
        for path in changed_paths(root, base):
            try:
                text = _git(root, "show", f"{revision}:{path}")
            except subprocess.CalledProcessError:
                continue  # not in this version
            rows.append((repo, path, text, hashlib.sha256(text.encode()).hexdigest()))
        return spark.createDataFrame(rows, _FILES)

    return at(base), at("HEAD")
