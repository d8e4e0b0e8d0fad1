"""Small reusable column expressions; everything stays inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_LEVEL = "__null__"


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a number type; booleans and dates are not numbers."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def other_columns(df: DataFrame) -> list[str]:
    numbers = set(numeric_columns(df))
    return [c for c in df.columns if c not in numbers]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType))


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_temporal(f.dataType)]


def nested_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
    ]


def q(name: str) -> Column:
    """Reference a column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def number(df: DataFrame, name: str) -> Column:
    """Column as double with NaN turned into null, the one notion of missing used throughout."""
    kind = field_type(df, name)
    col = q(name).cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(col, F.lit(None).cast("double"))
    return col


def finite(df: DataFrame, name: str) -> Column:
    """Like ``number`` but infinities count as missing too."""
    col = number(df, name)
    if isinstance(field_type(df, name), (T.FloatType, T.DoubleType)):
        return F.when(F.abs(col) != float("inf"), col)
    return col


def present(df: DataFrame, name: str) -> Column:
    """True where the cell holds a value (NaN does not)."""
    if isinstance(field_type(df, name), (T.FloatType, T.DoubleType)):
        return q(name).isNotNull() & ~F.isnan(q(name))
    return q(name).isNotNull()


def missing(df: DataFrame, name: str) -> Column:
    return ~present(df, name)


def value_of(df: DataFrame, name: str) -> Column:
    """The cell in a form that can be grouped and counted: NaN is null, nested cells are JSON text."""
    kind = field_type(df, name)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(q(name), F.lit(None).cast(kind))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return nested_json(q(name), kind)
    return q(name)


def orderable(df: DataFrame, name: str) -> Column:
    """The cell as a value that sorts like it and survives the way to the driver and back: times are microseconds.

    Nested cells sort by their JSON text.
    """
    kind = field_type(df, name)
    if is_temporal(kind):
        return F.unix_micros(q(name).cast("timestamp"))
    return value_of(df, name) if name in nested_columns(df) else q(name)


def _ordered_maps(col: Column, kind: T.DataType) -> Column:
    """Rebuild a nested value with the keys of every map in it sorted."""
    if isinstance(kind, T.MapType):
        rebuilt = F.transform(
            F.array_sort(F.map_entries(col)),
            lambda e: F.struct(e["key"].alias("key"), _ordered_maps(e["value"], kind.valueType).alias("value")),
        )
        return F.map_from_entries(rebuilt)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda e: _ordered_maps(e, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        body = F.struct(*[_ordered_maps(col[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), body)
    return col


def nested_json(col: Column, kind: T.DataType) -> Column:
    """Deterministic JSON text of a nested cell (keys sorted, null fields kept)."""
    if isinstance(kind, T.VariantType):
        return F.to_json(col)
    return F.to_json(_ordered_maps(col, kind), {"ignoreNullFields": "false"})


def divide(a, b) -> Column:
    """Division that yields null instead of an error on a zero divisor."""
    return F.try_divide(a, b)


def rounded(col: Column, digits: int = 4) -> Column:
    """Round and turn a negative zero into zero, so results compare across engines."""
    return F.round(col, digits) + F.lit(0.0)


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def total(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def seeded_order(seed: int, *keys: Column) -> Column:
    """A repeatable pseudo-random number below 2**52 per key (exact as a double).

    Built on md5 so that any SQL engine can reproduce the order.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")


def free_name(wanted: str, taken) -> str:
    """``wanted``, or ``wanted_2``, ``wanted_3`` ... when the name is in use."""
    used, name, n = set(taken), wanted, 2
    while name in used:
        name, n = f"{wanted}_{n}", n + 1
    return name
