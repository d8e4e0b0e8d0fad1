"""Filters, samples, column selection and checks on columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import (
    all_of,
    field_type,
    is_temporal,
    nested_columns,
    number,
    numeric_columns,
    orderable,
    other_columns,
    present,
    q,
    seeded_order,
    text_columns,
    value_of,
)
from plumbline.functions.ranges import first_k, task_rows
from plumbline.functions.wide import column_table, distinct_counts

# Column names and endings that mark an identifier.
ID_NAMES = ("id", "uuid", "guid", "index", "row_id", "pk", "key")
ID_SUFFIXES = ("_id", "_uuid", "_guid", "_pk")
VISUAL_ROWS = 25_000
ANALYSIS_ROWS = 50_000
TOP_ROWS = 100_000


def in_range(df: DataFrame, column: str, low: float, high: float) -> Column:
    """Inclusive numeric range over finite values."""
    return number(df, column).between(low, high) & (F.abs(number(df, column)) != float("inf"))


def in_levels(df: DataFrame, column: str, levels: Sequence, keep_null: bool = False) -> Column:
    hit = F.coalesce(q(column).cast("string").isin([str(v) for v in levels]), F.lit(False))
    return hit | q(column).isNull() if keep_null else hit


def contains(df: DataFrame, column: str, text: str) -> Column:
    """Literal, case-insensitive search; a missing cell never matches."""
    return F.coalesce(F.contains(F.lower(q(column).cast("string")), F.lower(F.lit(text))), F.lit(False))


def slice_condition(
    df: DataFrame,
    ranges: dict[str, tuple[float, float]] | None = None,
    levels: dict[str, Sequence] | None = None,
    search: dict[str, str] | None = None,
) -> Column:
    """All filters together. A ``None`` among the levels keeps missing cells."""
    tests = [in_range(df, c, lo, hi) for c, (lo, hi) in (ranges or {}).items()]
    for c, wanted in (levels or {}).items():
        tests.append(in_levels(df, c, [v for v in wanted if v is not None], None in wanted))
    tests += [contains(df, c, s) for c, s in (search or {}).items()]
    return F.coalesce(all_of(tests), F.lit(False))


def slice_and_dice(df: DataFrame, **filters) -> DataFrame:
    """Rows passing every filter of ``slice_condition``."""
    return df.filter(slice_condition(df, **filters))


def slice_counts(df: DataFrame, **filters) -> DataFrame:
    """``(rows, kept)`` before and after filtering, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(slice_condition(df, **filters)).alias("kept"))


def exclude_columns(df: DataFrame, excluded: Sequence[str]) -> tuple[DataFrame, bool]:
    """Drop columns; when none would remain the result has no columns and the flag is False."""
    left = [c for c in df.columns if c not in set(excluded or ())]
    return df.select(*[q(c) for c in left]), bool(left)


def by_type(df: DataFrame, numeric: bool = True) -> DataFrame:
    return df.select(*[q(c) for c in (numeric_columns(df) if numeric else other_columns(df))])


def with_order(df: DataFrame, key: Sequence[str], seed: int | None) -> tuple[DataFrame, list[str]]:
    """Add columns that order rows by a seeded hash of ``key`` (or, without a seed, by the key's own typed values).

    Three independent hashes only tie for rows whose keys are equal.
    """
    if seed is None:
        return df.withColumns({f"__h{i}": orderable(df, k) for i, k in enumerate(key)}), [f"__h{i}" for i in range(len(key))]
    values = [value_of(df, k) for k in key]
    return df.withColumns({f"__h{i}": seeded_order(seed + i, *values) for i in range(3)}), ["__h0", "__h1", "__h2"]


def sample_rows(
    df: DataFrame, n: int = ANALYSIS_ROWS, key: Sequence[str] = (), seed: int | None = 42, rows: int | None = None
) -> DataFrame:
    """Exactly ``n`` rows, the same ones each time, chosen by a seeded hash of ``key``.

    Small samples are a top-k per partition; samples too large for one task are cut by hash value.
    """
    key = list(key or df.columns)
    hashed, order = with_order(df, key, seed)
    if n <= min(task_rows(df), TOP_ROWS):
        return hashed.orderBy(*order, *[q(k) for k in key]).limit(n).drop(*order)
    return hashed.filter(first_k(hashed, order, n, rows)).drop(*order)


def visual_sample(df: DataFrame, n: int = VISUAL_ROWS, key: Sequence[str] = (), seed: int = 42):
    """``(sample, was_sampled, note)``; a small table is returned whole."""
    rows = df.count()
    if rows <= n:
        return df, False, ""
    note = f"Showing a representative sample of {n:,} rows (from {rows:,} total rows)."
    return sample_rows(df, n, key, seed, rows), True, note


def preview(df: DataFrame, n: int = 15, key: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*[q(k) for k in key]) if key else df).limit(n)


def named_like_id(name: str) -> bool:
    lowered = name.lower().strip()
    return lowered in ID_NAMES or lowered.endswith(ID_SUFFIXES)


def id_columns_table(df: DataFrame) -> DataFrame:
    """``(column, by_name, non_null, distinct_values, likely_id)`` for every column."""
    # only text can be an ID by its values, so only text is counted
    kinds = (T.StringType, T.ArrayType, T.MapType, T.StructType)
    levels = distinct_counts(df, [c for c in df.columns if isinstance(field_type(df, c), kinds)])
    entries = []
    for c in df.columns:
        distinct = F.lit(levels.get(c)).cast("long")
        entries.append(
            [
                F.lit(c).alias("column"),
                F.lit(named_like_id(c)).alias("by_name"),
                F.count_if(present(df, c)).alias("non_null"),
                distinct.alias("distinct_values"),
            ]
        )
    table = column_table(df, entries)
    dense = (F.col("non_null") >= 20) & (F.col("distinct_values") > 0.5 * F.col("non_null"))
    return table.withColumn("likely_id", F.col("by_name") | F.coalesce(dense, F.lit(False)))


def likely_ids(df: DataFrame) -> list[str]:
    """Names of the likely identifier columns."""
    named = [c for c in df.columns if named_like_id(c)]
    rest = [c for c in [*text_columns(df), *nested_columns(df)] if c not in named]
    if not rest:
        return named
    found = id_columns_table(df.select(*[q(c) for c in rest])).filter("likely_id").collect()
    flagged = {*named, *[r["column"] for r in found]}
    return [c for c in df.columns if c in flagged]


def problem_type_table(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """``(column, non_null, distinct_values, integer_like, problem_type)`` per target column."""
    levels = distinct_counts(df, [c for c in targets if c in df.columns])
    entries = []
    for c in targets:
        if c not in df.columns:
            entries.append(
                [
                    F.lit(c).alias("column"),
                    F.lit(0).cast("long").alias("non_null"),
                    F.lit(0).cast("long").alias("distinct_values"),
                    F.lit(None).cast("boolean").alias("integer_like"),
                    F.lit("Classification").alias("problem_type"),
                ]
            )
            continue
        numeric = c in numeric_columns(df)
        n, d = F.count_if(present(df, c)), F.lit(levels.get(c, 0)).cast("long")
        if numeric:
            x = number(df, c)
            near = F.abs(x - F.rint(x)) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(F.rint(x))
            whole = F.coalesce(F.bool_and(near), F.lit(False))
            is_class = whole & (d <= 10) & (d <= n * 0.5)
            kind = F.when(n == 0, "Regression").when(is_class, "Classification").otherwise("Regression")
        else:
            whole = F.lit(None).cast("boolean")
            kind = F.when(n == 0, "Regression").otherwise("Classification")
        entries.append(
            [
                F.lit(c).alias("column"),
                n.alias("non_null"),
                d.alias("distinct_values"),
                whole.alias("integer_like"),
                kind.alias("problem_type"),
            ]
        )
    return column_table(df, entries)


def problem_type(df: DataFrame, target: str | None) -> str:
    if not target or target not in df.columns:
        return "Classification"
    return problem_type_table(df, [target]).first()["problem_type"]


def infinite_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, infinite)`` number of infinite or overflowing values per column; text is parsed."""
    entries = []
    for c in columns or [*numeric_columns(df), *text_columns(df)]:
        x = number(df, c) if c in numeric_columns(df) else q(c).cast("string").try_cast("double")
        entries.append([F.lit(c).alias("column"), F.count_if(F.abs(x) == float("inf")).alias("infinite")])
    return column_table(df, entries)


def non_finite_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    usable = [c for c in columns if c in {*numeric_columns(df), *text_columns(df)}]
    if not usable:
        return []
    return sorted(r["column"] for r in infinite_cells(df, usable).filter("infinite > 0").collect())


def datetime_to_epoch(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Date and time columns as whole seconds since 1970 (UTC), missing kept."""
    wanted = set(columns or df.columns)
    out = []
    for f in df.schema.fields:
        if f.name in wanted and is_temporal(f.dataType):
            out.append(F.unix_timestamp(q(f.name).cast("timestamp")).cast("double").alias(f.name))
        else:
            out.append(q(f.name))
    return df.select(*out)


def as_time(df: DataFrame, column: str) -> Column:
    """A column read as a timestamp where possible."""
    if is_temporal(field_type(df, column)):
        return q(column).cast("timestamp")
    return F.try_to_timestamp(q(column).cast("string"))


def date_like_columns(df: DataFrame, columns: Sequence[str] | None = None, share: float = 0.8) -> DataFrame:
    """``(column, non_null, parsed, date_like)``: text columns most of whose values are dates."""
    entries = []
    for c in columns or text_columns(df):
        n, ok = F.count(q(c)), F.count(as_time(df, c))
        entries.append(
            [
                F.lit(c).alias("column"),
                n.alias("non_null"),
                ok.alias("parsed"),
                ((n > 0) & (ok >= share * n)).alias("date_like"),
            ]
        )
    return column_table(df, entries)


def rank_grouping_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, tier, numeric, distinct_values, position)``: best columns to group by first."""
    columns = list(columns or df.columns)
    numbers = set(numeric_columns(df))
    entries = []
    levels = distinct_counts(df, columns)
    for i, c in enumerate(columns):
        texty = isinstance(field_type(df, c), T.StringType)
        d, n = F.lit(levels[c]).cast("long"), F.count_if(present(df, c))
        dense = ((n >= 20) & (d > 0.5 * n)) if texty else F.lit(False)
        identifier = F.lit(True) if named_like_id(c) else dense
        tier = F.when(identifier, 4).when(d.between(2, 30), 0).when(d.between(31, 100), 1).otherwise(2)
        entries.append(
            [
                F.lit(c).alias("column"),
                tier.alias("tier"),
                F.lit(c in numbers).alias("numeric"),
                d.alias("distinct_values"),
                F.lit(i).alias("ordinal"),
            ]
        )
    table = column_table(df, entries)
    # an identifier is ordered by its level count alone
    kind = F.when(F.col("tier") == 4, F.lit(0)).otherwise(F.col("numeric").cast("int"))
    ranks = F.array_sort(F.collect_list(F.struct("tier", kind.alias("kind"), "distinct_values", "ordinal", "column", "numeric")))
    listed = table.agg(ranks.alias("r")).select(F.posexplode("r").alias("pos", "e"))
    return listed.select(
        F.col("e.column").alias("column"),
        F.col("e.tier").alias("tier"),
        F.col("e.numeric").alias("numeric"),
        F.col("e.distinct_values").alias("distinct_values"),
        (F.col("pos") + 1).alias("position"),
    )


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, in_a, in_b, type_a, type_b)`` for the union of both column sets."""
    spark = a.sparkSession
    left = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in a.schema.fields], "column string, type_a string")
    right = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in b.schema.fields], "column string, type_b string")
    both = left.join(right, "column", "full_outer")
    return both.select(
        "column",
        F.col("type_a").isNotNull().alias("in_a"),
        F.col("type_b").isNotNull().alias("in_b"),
        "type_a",
        "type_b",
    )


def common_columns(a: DataFrame, b: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Sorted names held by both, only by A, only by B."""
    left, right = set(a.columns), set(b.columns)
    return sorted(left & right), sorted(left - right), sorted(right - left)


def coercion_failures(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, unparsable)``: text cells of a numeric feature that are not numbers."""
    entries = []
    for c in columns:
        bad = q(c).isNotNull() & q(c).cast("string").try_cast("double").isNull()
        entries.append([F.lit(c).alias("column"), F.count_if(bad).alias("unparsable")])
    return column_table(df, entries)


def require_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns that must be numeric, as doubles; an error names those holding other text."""
    texts = [c for c in columns if c in text_columns(df)]
    if not texts:
        return df
    bad = [r["column"] for r in coercion_failures(df, texts).filter("unparsable > 0").collect()]
    if bad:
        raise ValueError(f"numeric feature holds text that is not a number: {', '.join(sorted(bad))}")
    return df.withColumns({c: q(c).try_cast("double") for c in texts})
