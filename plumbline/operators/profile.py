"""Table quality and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import missing, number, numeric_columns, present, q, total, value_of
from plumbline.functions.ranges import quantile_table
from plumbline.functions.wide import column_table, distinct_table, duplicate_counts, union_all


def hygiene_index(df: DataFrame, digest: bool = False) -> DataFrame:
    """One row: rows, columns, missing cells, duplicate rows, completeness, uniqueness and their mean.

    One shuffle of the distinct rows gives all of it. ``digest=True`` shuffles a SHA-256 of each row in
    place of the row, which is cheaper on wide tables.
    """
    cols = len(df.columns)
    if cols == 0:
        counted = df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(0).alias("kinds"), F.lit(0).alias("gaps"))
    elif digest:
        # each cell with its length, so that no two different rows read the same; -0.0 counts as 0.0
        floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        plain = [(value_of(df, c) + F.lit(0.0) if c in floats else value_of(df, c)).cast("string") for c in df.columns]
        sized = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("~")) for v in plain]
        gaps = total([missing(df, c).cast("int") for c in df.columns])
        marks = df.select(F.unhex(F.sha2(F.concat(*sized), 256)).alias("m"), gaps.alias("g"))
        counted = marks.groupBy("m", "g").agg(F.count(F.lit(1)).alias("c")).agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("kinds"),
            F.coalesce(F.sum(F.col("c") * F.col("g")), F.lit(0)).alias("gaps"),
        )
    else:
        distinct = duplicate_counts(df)
        gaps = total([missing(distinct, c).cast("int") for c in df.columns])
        counted = distinct.agg(
            F.coalesce(F.sum("__copies"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("kinds"),
            F.coalesce(F.sum(F.col("__copies") * gaps), F.lit(0)).alias("gaps"),
        )
    cells = F.col("rows") * cols
    empty = (F.col("rows") == 0) | F.lit(cols == 0)
    out = counted.select(
        F.col("rows").cast("long").alias("rows"),
        F.lit(cols).cast("long").alias("columns"),
        F.when(empty, 0).otherwise(F.col("gaps")).cast("long").alias("missing_cells"),
        F.when(empty, 0).otherwise(F.col("rows") - F.col("kinds")).cast("long").alias("duplicate_rows"),
        F.when(empty, 0.0).otherwise(F.try_divide((cells - F.col("gaps")) * 100.0, cells)).alias("completeness"),
        F.when(empty, 0.0).otherwise(F.try_divide(F.col("kinds") * 100.0, F.col("rows"))).alias("uniqueness"),
        empty.alias("is_empty"),
    )
    return out.withColumn("hygiene_index", (F.col("completeness") + F.col("uniqueness")) / 2)


def hygiene_band(column: str = "hygiene_index") -> Column:
    """Band of an index value on its 0 to 100 scale."""
    return F.when(F.col(column) < 50, "poor").when(F.col(column) < 80, "fair").otherwise("good")


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """``(position, column, data_type, rows, non_null, missing, distinct_values)``; the base of all profiles."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields, 1) if columns is None or f.name in columns]
    entries = []
    for i, f in fields:
        n = F.count_if(present(df, f.name))
        entries.append(
            [
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.count(F.lit(1)).alias("rows"),
                n.alias("non_null"),
                (F.count(F.lit(1)) - n).alias("missing"),
                *([F.approx_count_distinct(value_of(df, f.name)).alias("distinct_values")] if approx else []),
            ]
        )
    empty = "position int, column string, data_type string, rows long, non_null long, missing long"
    table = column_table(df, entries, empty + ", distinct_values long" * approx)
    if approx:
        return table
    # one row per column on both sides
    distinct = distinct_table(df, [f.name for _, f in fields])
    joined = table.join(F.broadcast(distinct), "column", "left")
    return joined.select(*[c for c in table.columns], F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"))


def _missing_pct():
    return F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column with missing share, distinct values and cardinality class."""
    d = F.col("distinct_values")
    cardinality = F.when(d == 1, "constant").when(d == 2, "binary").when(d <= 20, "low").otherwise("high")
    return column_facts(df, approx=approx).select(
        "column",
        "data_type",
        "non_null",
        "missing",
        _missing_pct().alias("missing_pct"),
        "distinct_values",
        cardinality.alias("cardinality"),
    )


def missing_columns(df: DataFrame) -> DataFrame:
    """Columns with gaps, worst first, with a severity."""
    entries = []
    for c in df.columns:
        entries.append(
            [
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(missing(df, c)).alias("missing"),
            ]
        )
    table = column_table(df, entries, "column string, rows long, missing long").filter("missing > 0").withColumn("missing_pct", _missing_pct())
    severity = F.when(F.col("missing_pct") > 15, "high").otherwise("some")
    return table.select("column", "missing", "missing_pct", severity.alias("severity"))


def column_structure(df: DataFrame) -> DataFrame:
    """Columns in table order with type and counts."""
    return column_facts(df).select(
        "position", "column", "data_type", "non_null", "missing", _missing_pct().alias("missing_pct"), "distinct_values"
    )


def heavy_outlier_share(df: DataFrame, columns: Sequence[str], k: float = 1.5, rows: int | None = None) -> DataFrame:
    """``(column, iqr, outlier_pct)`` outside the Tukey fences of each numeric column."""
    fences = quantile_table(df, columns, [0.25, 0.75], rows=rows)
    found = {r["column"]: r["quantiles"] for r in fences.collect()}
    entries = []
    for c in columns:
        quarts = found.get(c)
        if not quarts or quarts[0] is None:
            continue
        lo, hi = quarts
        iqr, x = hi - lo, number(df, c)
        outside = F.count_if((x < lo - k * iqr) | (x > hi + k * iqr))
        entries.append(
            [
                F.lit(c).alias("column"),
                F.lit(float(iqr)).alias("iqr"),
                F.try_divide(outside * 100.0, F.count(x)).alias("outlier_pct"),
            ]
        )
    if not entries:
        return df.sparkSession.createDataFrame([], "column string, iqr double, outlier_pct double")
    return column_table(df, entries)


def quality_flags(df: DataFrame) -> DataFrame:
    """``(column, completeness_pct, uniqueness_pct, flags)``; flags reads ``OK`` when nothing is wrong."""
    facts = column_facts(df)
    numbers = numeric_columns(df)
    rows = df.count()
    outliers = heavy_outlier_share(df, numbers, rows=rows) if numbers else None
    if outliers is not None:
        facts = facts.join(outliers, "column", "left")
    else:
        facts = facts.withColumns({"iqr": F.lit(None).cast("double"), "outlier_pct": F.lit(None).cast("double")})
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.ArrayType, T.MapType, T.StructType))]
    d, n = F.col("distinct_values"), F.col("non_null")
    text = F.col("column").isin(texts) if texts else F.lit(False)
    flags = F.concat_ws(
        ", ",
        F.when(_missing_pct() >= 40, "High missingness"),
        F.when(d <= 1, "Constant"),
        F.when(text & (d > 0.95 * F.greatest(n, F.lit(1))) & (d > 20), "Possible ID/high-cardinality"),
        F.when((F.col("iqr") > 0) & (F.col("outlier_pct") >= 10), "Heavy outliers"),
    )
    return facts.select(
        "column",
        (100.0 - _missing_pct()).alias("completeness_pct"),
        F.try_divide(d * 100.0, F.greatest(n, F.lit(1))).alias("uniqueness_pct"),
        F.when(flags == "", "OK").otherwise(flags).alias("flags"),
    )


def review_list(df: DataFrame) -> DataFrame:
    """One row: how many columns are flagged, and their names in table order."""
    order = {c: i for i, c in enumerate(df.columns)}
    position = F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i))])
    flagged = quality_flags(df).filter("flags <> 'OK'").select(F.struct(position[F.col("column")].alias("p"), "column").alias("e"))
    names = F.array_sort(F.collect_list("e"))
    return flagged.agg(
        F.count(F.lit(1)).alias("flagged"), F.concat_ws(", ", F.transform(names, lambda e: e["column"])).alias("needs_review")
    )


def duplicate_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(dataset, rows, duplicate_rows)`` per table."""
    return union_all(
        [hygiene_index(df).select(F.lit(n).alias("dataset"), "rows", "duplicate_rows") for n, df in tables.items()]
    )


def type_mix(df: DataFrame) -> DataFrame:
    """One row: number of columns, numeric ones, others, and likely identifiers."""
    from plumbline.operators.select import id_columns_table

    numbers = len(numeric_columns(df))
    return id_columns_table(df).agg(
        F.count(F.lit(1)).alias("columns"),
        F.lit(numbers).cast("long").alias("numeric_columns"),
        F.lit(len(df.columns) - numbers).cast("long").alias("other_columns"),
        F.count_if("likely_id").alias("likely_ids"),
    )
