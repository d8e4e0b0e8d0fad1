"""The tables of an audit report, for one table or a whole catalog."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.exprs import numeric_columns, other_columns, q
from plumbline.functions.wide import union_all
from plumbline.operators.charts import box_stats, correlation_heatmap, histograms
from plumbline.operators.privacy import REDACTED, mask, sensitive_columns
from plumbline.operators.profile import column_structure, hygiene_index, quality_flags, review_list
from plumbline.operators.stats import (
    categorical_summary,
    correlation_insights,
    describe,
    pearson_pairs,
    tukey_outliers,
    widest_columns,
)

# the sample is a look at the first cells, not an audit of them
SAMPLE_ROWS, SAMPLE_COLUMNS = 8, 8


def report_summary(df: DataFrame) -> DataFrame:
    """One row: size, gaps, duplicates, column types and hygiene index."""
    numbers = len(numeric_columns(df))
    return hygiene_index(df).select(
        "rows",
        "columns",
        "duplicate_rows",
        "missing_cells",
        F.lit(numbers).cast("long").alias("numeric_columns"),
        F.lit(len(df.columns) - numbers).cast("long").alias("categorical_columns"),
        "hygiene_index",
    )


def report_outliers(df: DataFrame, columns: Sequence[str], redact: Sequence[str] = ()) -> DataFrame:
    """Tukey table of the report: no outliers when the quartiles coincide, redacted columns without values."""
    table = tukey_outliers(df, columns, 1.5, flat_iqr_is_clean=True).filter("n > 0")
    hide = F.col("column").isin(list(redact)) if redact else F.lit(False)
    shown = ("q1", "q3", "iqr", "lower_fence", "upper_fence", "outliers", "outlier_pct")
    return table.select("column", *[F.when(~hide, F.col(c)).alias(c) for c in shown])


def report_categories(df: DataFrame, columns: Sequence[str], redact: Sequence[str] = ()) -> DataFrame:
    hide = F.col("column").isin(list(redact)) if redact else F.lit(False)
    table = categorical_summary(df, columns)
    top = F.when(hide, REDACTED).otherwise(F.col("top_level"))
    return table.withColumn("top_level", top)


def report_sample(df: DataFrame, sensitive: Sequence[str] = (), key: Sequence[str] = ()) -> DataFrame:
    """First rows of the first columns as text, sensitive cells masked."""
    cols = df.columns[:SAMPLE_COLUMNS]
    ordered = df.orderBy(*[q(k) for k in key]) if key else df
    few = ordered.limit(SAMPLE_ROWS).select(*[q(c) for c in cols])
    texts = few.select(*[q(c).cast("string").alias(c) for c in cols])
    return mask(texts, [c for c in cols if c in set(sensitive)])


def audit_report(
    df: DataFrame,
    excluded: Sequence[str] = (),
    key: Sequence[str] = (),
    charts: bool = True,
    most_columns: int | None = None,
    correlated_columns: int | None = None,
    chart_columns: int | None = None,
) -> dict[str, DataFrame]:
    """All report tables by name. Columns found or named as sensitive show no values.

    Every column is reported on. A display may ask for the first ``most_columns`` numeric and other columns, for
    correlations among the ``correlated_columns`` of largest variance, and for charts of the first ``chart_columns``.
    """
    hidden = {r["column"] for r in sensitive_columns(df).select("column").collect()} | {c for c in excluded if c in df.columns}
    numbers, others = numeric_columns(df)[:most_columns], other_columns(df)[:most_columns]
    out = {"summary": report_summary(df), "structure": column_structure(df)}
    if numbers:
        out["numeric"] = describe(df, numbers, redact=[c for c in numbers if c in hidden])
        out["outliers"] = report_outliers(df, numbers, [c for c in numbers if c in hidden])
    if others:
        out["categorical"] = report_categories(df, others, [c for c in others if c in hidden])
    safe = [c for c in numeric_columns(df) if c not in hidden]
    if len(safe) > 1:
        out["correlation"] = correlation_insights(pearson_pairs(df, widest_columns(df, correlated_columns or len(safe), safe)))
    first = df.select(*[q(c) for c in df.columns[:most_columns]])
    out["quality"] = quality_flags(first)
    out["review"] = review_list(first)
    out["sample"] = report_sample(df, sorted(hidden), key)
    if charts and safe:
        few = safe[:chart_columns]
        out["histograms"] = histograms(df, few)
        out["boxes"] = union_all([box_stats(df, c).withColumn("column", F.lit(c)).drop("x", "hue") for c in few])
        if len(safe) > 1:
            out["heatmap"] = correlation_heatmap(df, 10, safe)
    return out


def write_report(report: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    for name, table in report.items():
        table.write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/{name}")


def catalog_report(tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Summary rows of every table with a ``dataset`` column, and the tables that failed with the reason.

    Each table is one job, so a table that cannot be read does not stop the others.
    """
    rows, failed, spark = [], [], None
    for name, df in tables.items():
        try:
            spark = df.sparkSession
            rows.append((name, *report_summary(df).first()))
        except Exception as error:
            failed.append((name, f"{type(error).__name__}: {str(error).splitlines()[0]}"))
    if not rows:
        raise ValueError("no table could be reported on")
    schema = (
        "dataset string, rows long, columns long, duplicate_rows long, missing_cells long, "
        "numeric_columns long, categorical_columns long, hygiene_index double"
    )
    return spark.createDataFrame(rows, schema), failed


def full_reports(tables: dict[str, DataFrame]) -> Iterator[tuple[str, dict[str, DataFrame] | None, str | None]]:
    """``(name, report, reason)`` of every table in turn: its whole ``audit_report``, or why there is none."""
    for name, df in tables.items():
        try:
            yield name, audit_report(df), None
        except Exception as error:
            yield name, None, f"{type(error).__name__}: {str(error).splitlines()[0]}"


def report_all(spark: SparkSession) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``catalog_report`` over all tables and views of the current catalog."""
    tables, failed = {}, []
    for t in spark.catalog.listTables():
        try:
            tables[t.name] = spark.table(t.name)
        except Exception as error:
            failed.append((t.name, f"{type(error).__name__}: {error}"))
    done, more = catalog_report(tables)
    return done, failed + more
