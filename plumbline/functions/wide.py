"""Wide aggregates turned into one row per column, and level counting."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import field_type, q, value_of

MAX_AGGREGATES = 120


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def column_table(df: DataFrame, entries: Sequence[Sequence[Column]], empty: str | None = None) -> DataFrame:
    """One row per entry from a single aggregation; wide tables are cut into several so generated code
    stays small (each reads only its own columns). Without entries: no rows, of the schema ``empty``."""
    if not entries and empty:
        return df.sparkSession.createDataFrame([], empty)
    per_entry = max(1, len(entries[0]))
    step = max(1, MAX_AGGREGATES // per_entry)
    frames = []
    for start in range(0, len(entries), step):
        block = entries[start : start + step]
        rows = F.array(*[F.struct(*entry) for entry in block])
        frames.append(df.agg(rows.alias("__t")).select(F.inline("__t")))
    return union_all(frames)


def level_counts(
    df: DataFrame, cols: Sequence[str], extra: Sequence[str] = (), digest_beyond: int | None = None
) -> DataFrame:
    """``(extra..., column, level, cnt)`` for non-missing values as text; counted before the shuffle.

    Texts longer than ``digest_beyond`` characters are replaced by their SHA-256.
    """

    def level(c):
        text = value_of(df, c).cast("string")
        if digest_beyond is None:
            return text
        return F.when(F.length(text) > digest_beyond, F.sha2(text, 256)).otherwise(text)

    entries = F.array(*[F.struct(F.lit(c).alias("column"), level(c).alias("level")) for c in cols])
    long = df.select(*[q(e) for e in extra], F.inline(entries)).filter(F.col("level").isNotNull())
    return long.groupBy(*[q(e) for e in extra], "column", "level").agg(F.count(F.lit(1)).alias("cnt"))


def top_of(counts: DataFrame, keys: Sequence[str] = ("column",)) -> DataFrame:
    """Most frequent level per key, ties to the smallest; also distinct levels and total."""
    best = F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("level")))
    return (
        counts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("levels"), F.sum("cnt").alias("present"), best.alias("__best"))
        .select(*keys, "levels", "present", F.col("__best.level").alias("top"), (-F.col("__best.neg")).alias("top_count"))
    )


def spread_lookup(df: DataFrame, key: str, table: DataFrame, heavy: Sequence, salt: Column, salts: int = 64) -> DataFrame:
    """Left join ``table`` (one row per ``key``) where a few known heavy keys hold most rows.

    Rows of a heavy key go to ``salts`` different partitions and the single table row is copied to each.
    """
    if not heavy:
        return df.join(table, key, "left")
    hot = F.coalesce(q(key).isin(list(heavy)), F.lit(False))
    left = df.withColumn("__salt", F.when(hot, F.pmod(salt, F.lit(salts))).otherwise(0).cast("int"))
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = table.withColumn("__salt", F.explode(copies))
    return left.join(right, [key, "__salt"], "left").drop("__salt")


def distinct_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, distinct_values)`` without missing values, exact.

    Columns are put in long form by kind of value (numbers, text, ...), so that a distinct pass keys on
    a column number and one value instead of a row as wide as the table.
    """
    kinds: dict[str, list[int]] = {}
    for i, c in enumerate(columns):
        kind = field_type(df, c)
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            name = "bigint"
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            name = "double"
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType, T.BooleanType)):
            name = kind.simpleString()
        else:
            name = "string"
        kinds.setdefault(name, []).append(i)
    frames = []
    for name, ids in kinds.items():
        entries = F.array(*[F.struct(F.lit(i).alias("i"), value_of(df, columns[i]).cast(name).alias("v")) for i in ids])
        kinds_of = df.select(F.inline(entries)).filter(F.col("v").isNotNull()).distinct()
        frames.append(kinds_of.groupBy("i").agg(F.count(F.lit(1)).alias("d")))
    if not frames:
        return df.sparkSession.createDataFrame([], "column string, distinct_values long")
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return union_all(frames).select(names.alias("column"), F.col("d").alias("distinct_values"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """The numbers of ``distinct_table``, for conditions that need them: one per column."""
    found = {r["column"]: r["distinct_values"] for r in distinct_table(df, columns).collect()} if columns else {}
    return {c: found.get(c, 0) for c in columns}


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Each distinct row once with its number of copies; maps are compared by their JSON text."""
    cols = [
        value_of(df, f.name).alias(f.name) if isinstance(f.dataType, (T.MapType, T.VariantType)) else q(f.name)
        for f in df.schema.fields
    ]
    count = "__copies"
    return df.select(*cols).groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias(count))
