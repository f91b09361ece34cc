"""Debounced reindexing: saves of one repo that follow each other closely are one batch.

A timer that restarts at every save is a session window whose gap depends on the kind of repo.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quiet time in seconds after which a batch starts.
SQL_GAP, RENDERED_GAP = 0.5, 2.0


def sessions(events: DataFrame, gap: str | F.Column = "30 minutes", watermark: str | None = None) -> DataFrame:
    """(repo, started, ended, n_events, paths) of events (repo, ts, path); paths in order of their first save.

    Batch or streaming. A save exactly one gap after the last one starts a new session.
    """
    rows = events.withWatermark("ts", watermark) if watermark else events
    window = F.session_window("ts", gap)
    first = F.array_sort(F.collect_list(F.struct("ts", "path")))
    paths = F.array_distinct(F.transform(first, lambda x: x["path"]))
    out = rows.groupBy("repo", window.alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_events"), paths.alias("paths"))
    return out.select("repo", "started", "ended", "n_events", "paths")


def gap_of(repo_type: str = "repo_type") -> F.Column:
    """Quiet time by kind of repo."""
    return F.when(F.col(repo_type) == "sql", F.lit(f"{int(SQL_GAP * 1000)} milliseconds")).otherwise(F.lit(f"{int(RENDERED_GAP * 1000)} milliseconds"))


def reindex_stream(events: DataFrame, reindex: Callable[[DataFrame, int], None], checkpoint: str, gap: str | F.Column = "2 seconds", watermark: str = "10 seconds"):
    """Starts a query that calls ``reindex`` with each batch of closed sessions, one batch at a time."""
    closed = sessions(events, gap, watermark)
    return closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(reindex).start()
