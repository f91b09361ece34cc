"""Column predicates and small expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name prefixes of generated data tests.
TEST_PREFIXES = ("not_null_", "unique_", "relationships_", "accepted_values_")


def dataflow(rel="relationship", src_kind="src_kind", tgt_kind="tgt_kind", src_name="src_name", tgt_name="tgt_name") -> Column:
    """Edges that carry data: no ``defines``, and no query that inserts into the table of its own name."""
    own_insert = (F.col(rel) == "inserts_into") & (F.col(src_kind) == "query") & (F.col(tgt_kind) == "table") & (F.col(src_name) == F.col(tgt_name))
    return (F.col(rel) != "defines") & ~own_insert


def kind_rank(kind: str = "kind") -> Column:
    """table, view and query before other kinds, query-local kinds last."""
    k = F.col(kind)
    return F.when(k == "table", 0).when(k == "view", 1).when(k == "query", 2).when(k.isin("cte", "subquery"), 99).otherwise(10)


def noise(name: str = "name", kind: str = "kind") -> Column:
    """Query-local names and generated tests."""
    tests = F.lit(False)
    for p in TEST_PREFIXES:
        tests = tests | F.col(name).startswith(p)
    return (F.coalesce(F.col(kind), F.lit("")) == "cte") | tests


def layer_of(path: str = "path") -> Column:
    """The folder after ``models``, else the first folder; null for a file at the top."""
    parts = F.split(F.translate(F.col(path), "\\", "/"), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    at = F.array_position(dirs, "models").cast("int")
    return F.when((at > 0) & (at < F.size(dirs)), F.get(dirs, at)).otherwise(F.get(dirs, F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 when both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def hundredths(value: Column) -> Column:
    """Two decimals, ties to even, of the binary value rather than of its shortest decimal form."""
    return F.rint(value * 100) / 100


def column_style(name: str) -> Column:
    """snake_case, camelCase, PascalCase or SCREAMING_SNAKE; null for names that show no style."""
    c = F.col(name)
    return (
        F.when((c == F.upper(c)) & c.contains("_"), "SCREAMING_SNAKE")
        .when((c == F.lower(c)) & c.contains("_"), "snake_case")
        .when(c.rlike(r"^\p{Ll}") & c.rlike(r"\p{Lu}"), "camelCase")
        .when(c.rlike(r"^\p{Lu}") & c.rlike(r"\p{Ll}"), "PascalCase")
    )


def strip_layer_prefix(name: Column) -> Column:
    """Without a leading layer name such as ``stg_`` or ``marts.``."""
    # fixed values: layer prefixes of model names
    dotted = F.regexp_replace(name, r"^(marts|staging|intermediate|raw|sources)\.", "")
    return F.regexp_replace(dotted, r"^(stg|int|fct|dim|raw|src|base|snap|rpt|agg)_", "")


def folded(name: Column, quoted: Column, dialect: str) -> Column:
    """Identifiers as the dialect stores them: quoted ones as written, others folded."""
    if dialect in ("postgres", "postgresql", "redshift", "duckdb"):
        return F.when(quoted, name).otherwise(F.lower(name))
    if dialect in ("snowflake", "oracle", "db2"):
        return F.when(quoted, name).otherwise(F.upper(name))
    return name
