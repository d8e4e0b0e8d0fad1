"""Column names and nested cells at the table boundary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import field_type, free_name, nested_columns, nested_json, q


def unique_names(names: Sequence) -> list[str]:
    """Trimmed, non-empty, unique names; a repeat takes the next free ``_2``, ``_3`` ... ending."""
    out: list[str] = []
    for raw in names:
        out.append(free_name(str(raw).strip() or "unnamed", out))
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names(df.columns))


def serialize_nested(df: DataFrame) -> DataFrame:
    """Array, map, struct and variant cells as deterministic JSON text."""
    nested = set(nested_columns(df))
    return df.select(
        *[nested_json(q(c), field_type(df, c)).alias(c) if c in nested else q(c) for c in df.columns]
    )


def flatten(df: DataFrame, sep: str = ".") -> DataFrame:
    """Struct fields, at any depth, as columns named ``a.b``."""

    def leaves(col, kind, name):
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                yield from leaves(col.getField(field.name), field.dataType, f"{name}{sep}{field.name}")
        else:
            yield col, name

    out = []
    for field in df.schema.fields:
        out.extend(leaves(q(field.name), field.dataType, field.name))
    names = unique_names([name for _, name in out])
    return df.select(*[col.alias(name) for (col, _), name in zip(out, names)])


def parse_json_column(df: DataFrame, column: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Replace a JSON text column by flattened ``column.field`` columns.

    Without a schema it is learned from all rows by one aggregation.
    """
    if schema is None:
        merged = df.agg(F.schema_of_variant_agg(F.try_parse_json(q(column).cast("string"))).alias("s")).first()["s"]
        if not merged.startswith("OBJECT<"):
            raise ValueError(f"column {column!r} does not hold JSON objects")
        schema = merged.replace("OBJECT<", "STRUCT<")
    return flatten(df.withColumn(column, F.from_json(q(column), schema)))
