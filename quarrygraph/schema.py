"""Stored tables of the dependency graph."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _S, _D, _TS = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TABLES: dict[str, T.StructType] = {
    "repos": _struct(repo_id=_L, name=_S, path=_S, repo_type=_S, last_commit=_S, last_branch=_S, indexed_at=_TS, source_fingerprint=_S),
    "files": _struct(file_id=_L, repo_id=_L, path=_S, language=_S, checksum=_S, indexed_at=_TS),
    "nodes": _struct(node_id=_L, file_id=_L, kind=_S, name=_S, schema=_S, language=_S, line_start=_L, line_end=_L, metadata=_S),
    "edges": _struct(source_id=_L, target_id=_L, relationship=_S, context=_S, metadata=_S),
    "column_usage": _struct(node_id=_L, file_id=_L, table_name=_S, column_name=_S, usage_type=_S, alias=_S, transform=_S),
    "column_lineage": _struct(file_id=_L, output_node=_S, output_column=_S, chain_index=_L, hop_index=_L, hop_column=_S, hop_table=_S, hop_expression=_S),
    "columns": _struct(node_id=_L, column_name=_S, data_type=_S, position=_L, source=_S, description=_S),
    "rendered_cache": _struct(repo_id=_L, model_name=_S, rendered_sql=_S, column_schemas=_S),
    "conventions": _struct(repo_id=_L, layer=_S, convention_type=_S, payload=_S, confidence=_D, source=_S, model_count=_L),
    "semantic_tags": _struct(repo_id=_L, tag_name=_S, node_id=_L, confidence=_D, source=_S),
}

BREAKING = ["select", "join_on", "insert", "update"]
WARNING = ["where", "group_by", "order_by", "having", "partition_by", "window_order", "qualify"]
#: Kinds that exist only inside one statement.
QUERY_LOCAL = ["cte", "subquery"]
CONVENTION_TYPES = ["naming", "references", "required_columns", "column_style"]
