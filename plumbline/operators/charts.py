"""The table behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.functions.exprs import field_type, finite, is_temporal, nested_columns, number, q, text_columns, value_of
from plumbline.functions.ranges import BROADCAST_ROWS, join_null_safe, numbered, quantile_table
from plumbline.functions.wide import union_all
from plumbline.operators.select import as_time, date_like_columns
from plumbline.operators.stats import full_matrix, pearson_pairs, widest_columns

HUE_LEVELS = 20
BAR_LEVELS = 30
PIE_LEVELS = 30
HEATMAP_COLUMNS = 30
OTHER = "Other"


def _label(df: DataFrame, column: str) -> Column:
    return value_of(df, column).cast("string") if column in nested_columns(df) else q(column).cast("string")


def frequent_levels(df: DataFrame, column: str, most: int) -> list[str | None] | None:
    """The ``most`` frequent levels (null counts as one, ties by text), or None when there are no more."""
    counts = df.groupBy(_label(df, column).alias("level")).agg(F.count(F.lit(1)).alias("cnt"))
    top = counts.orderBy(F.col("cnt").desc(), F.col("level").asc_nulls_first()).limit(most + 1).collect()
    return None if len(top) <= most else [r["level"] for r in top[:most]]


def capped(df: DataFrame, column: str, most: int = HUE_LEVELS) -> Column:
    """The column as text with all but its most frequent levels replaced by ``Other``."""
    top = frequent_levels(df, column, most)
    label = _label(df, column)
    if top is None:
        return label
    keep = F.coalesce(label.isin([v for v in top if v is not None]), F.lit(False))
    if None in top:
        keep = keep | label.isNull()
    return F.when(keep, label).otherwise(OTHER)


def cap_categories(df: DataFrame, column: str, most: int = HUE_LEVELS) -> DataFrame:
    return df.withColumn(column, capped(df, column, most))


def _with_hue(df: DataFrame, hue: str | None, name: str = "hue", most: int = HUE_LEVELS) -> Column:
    return (capped(df, hue, most) if hue else F.lit(None).cast("string")).alias(name)


def histogram(df: DataFrame, column: str, bins: int = 30, hue: str | None = None) -> DataFrame:
    """``(hue, bin, low, high, count)``: equal-width bins over finite values; the last bin includes its top."""
    rows = df.select(finite(df, column).alias("x"), _with_hue(df, hue)).filter(F.col("x").isNotNull())
    span = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    return _histogram(rows, span["lo"], span["hi"], bins)


def _histogram(rows: DataFrame, lo: float | None, hi: float | None, bins: int) -> DataFrame:
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    if hi > lo:
        width = (hi - lo) / bins
        bin_no = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    else:
        width, bin_no = 0.0, F.lit(0)
    counted = rows.groupBy("hue", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    low, high = (F.lit(lo) + (F.col("bin") + i) * F.lit(width) for i in (0, 1))
    return counted.select("hue", "bin", low.alias("low"), high.alias("high"), "count")


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 24) -> DataFrame:
    """``(column, bin, low, high, count)`` of several columns."""
    return union_all([histogram(df, c, bins).select(F.lit(c).alias("column"), "bin", "low", "high", "count") for c in columns])


def violin_density(df: DataFrame, column: str, group: str | None = None, bins: int = 30) -> DataFrame:
    """``(group, bin, low, high, count, density)``: histogram heights that integrate to one per group."""
    table = histogram(df, column, bins, group)
    sizes = table.groupBy("hue").agg(F.sum("count").alias("n"))
    joined = join_null_safe(table, sizes, ["hue"], hint=True)
    density = F.try_divide(F.col("count"), F.col("n") * (F.col("high") - F.col("low")))
    return joined.select(F.col("hue").alias("group"), "bin", "low", "high", "count", density.alias("density"))


def box_stats(df: DataFrame, y: str, x: str | None = None, hue: str | None = None) -> DataFrame:
    """``(x, hue, n, min, q1, median, q3, max, whisker_low, whisker_high, outliers)`` per group."""
    rows = df.select(_with_hue(df, x, "x"), _with_hue(df, hue), number(df, y).alias("v")).filter(F.col("v").isNotNull())
    quarts = quantile_table(rows, ["v"], [0.25, 0.5, 0.75], by=["x", "hue"])
    quarts = quarts.select("x", "hue", *[F.get("quantiles", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    # both keys are capped at twenty levels and Other, so there are at most 21 x 21 rows
    joined = join_null_safe(rows, quarts, ["x", "hue"], hint=True)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    return joined.groupBy("x", "hue", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def scatter_trend(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """``(hue, n, slope, intercept, r2)``: least squares line per hue over finite pairs."""
    pairs = df.select(finite(df, x).alias("x"), finite(df, y).alias("y"), _with_hue(df, hue)).dropna(subset=["x", "y"])
    lines = pairs.groupBy("hue").agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"),
    )
    return lines.filter("n >= 2")


def bubble_size_check(df: DataFrame, column: str) -> DataFrame:
    """One row ``(usable, negative, finite_values)``: sizes need finite values and none below zero."""
    x = number(df, column)
    facts = df.agg(F.count_if(x < 0).alias("negative"), F.count(finite(df, column)).alias("finite_values"))
    return facts.select(((F.col("negative") == 0) & (F.col("finite_values") > 0)).alias("usable"), "negative", "finite_values")


def bar_table(df: DataFrame, x: str, y: str | None = None, agg: str = "Count", hue: str | None = None) -> DataFrame:
    """``(x, hue, value)``: Count, Sum, Mean, Median, Max or Min per category (30 and Other) and hue."""
    known = ("Count", "Sum", "Mean", "Median", "Max", "Min")
    if agg not in known:
        raise ValueError(f"unknown aggregate {agg!r}; choose from {', '.join(known)}")
    hue = None if hue == x else hue
    value = number(df, y).alias("v") if y else F.lit(1.0).alias("v")
    rows = df.select(_with_hue(df, x, "x", BAR_LEVELS), _with_hue(df, hue), value)
    if agg == "Count" or not y:
        return rows.groupBy("x", "hue").agg(F.count(F.lit(1)).cast("double").alias("value"))
    if agg == "Median":
        groups = rows.select("x", "hue").distinct()
        mids = quantile_table(rows, ["v"], [0.5], by=["x", "hue"]).select("x", "hue", F.get("quantiles", 0).alias("value"))
        return join_null_safe(groups, mids, ["x", "hue"], "left", hint=True)
    fn = {"Sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "Mean": F.avg, "Max": F.max, "Min": F.min}[agg]
    return rows.groupBy("x", "hue").agg(fn("v").alias("value"))


def composition(df: DataFrame, names: str, values: str | None = None, most: int = PIE_LEVELS) -> DataFrame:
    """``(level, value, share, is_other)``: the largest parts of a whole and one remainder."""
    v = number(df, values) if values else F.lit(1.0)
    rows = df.select(_label(df, names).alias("level"), v.alias("v"))
    if values and not rows.filter("v < 0").isEmpty():
        raise ValueError(f"column {values!r} has negative values and cannot be parts of a whole")
    summed = rows.groupBy("level").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
    order = (F.col("value").desc(), F.col("level").asc_nulls_first())
    top = [r["level"] for r in summed.orderBy(*order).limit(most + 1).collect()]
    other = F.lit(False)
    if len(top) > most:
        top = top[:most]
        keep = F.coalesce(F.col("level").isin([t for t in top if t is not None]), F.lit(False))
        other = ~((keep | F.col("level").isNull()) if None in top else keep)
    marked = rows.select(F.when(other, OTHER).otherwise(F.col("level")).alias("level"), other.alias("is_other"), "v")
    parts = marked.groupBy("level", "is_other").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
    parts = parts.filter(~F.col("is_other") | (F.col("value") > 0))
    # at most ``most`` + 1 rows are left
    whole = F.sum("value").over(Window.partitionBy(F.lit(1)))
    return parts.select("level", "value", F.try_divide(F.col("value"), whole).alias("share"), "is_other")


def time_order(df: DataFrame, x: str) -> Column:
    """Sort key of an x axis: time if it is one or reads as one, else the value itself."""
    if is_temporal(field_type(df, x)):
        return q(x).cast("timestamp")
    if x in text_columns(df) and date_like_columns(df, [x]).first()["date_like"]:
        return as_time(df, x)
    return q(x)


def line_series(
    df: DataFrame, x: str, y: str, hue: str | None = None, max_points: int | None = None, key: Sequence[str] = ()
) -> DataFrame:
    """``(x, y, hue)`` in chronological order, thinned to an envelope beyond ``max_points``."""
    order = time_order(df, x)
    rows = df.select(q(x).alias("x"), q(y).alias("y"), _with_hue(df, hue), order.alias("__t"), *[q(k).alias(f"__k{i}") for i, k in enumerate(key)])
    ties = [f"__k{i}" for i in range(len(key))]
    if max_points is not None:
        rows = downsample(rows, "__t", "y", max_points, "hue" if hue else None, ties)
    return rows.orderBy("__t", *ties).select("x", "y", "hue")


def downsample(
    df: DataFrame, x: str, y: str, max_points: int, hue: str | None = None, key: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Min-max envelope of a series: per bucket of equal row count its first, last, lowest and highest row.

    ``key`` tells rows of equal ``x`` apart; rows that also agree there come in the order of a hash of the row. Each
    hue gets its share of the points. Only hue, order, level and two hashes of each row are sorted; the rows of the
    chosen points (at most ``max_points``, or four a hue) are then picked where they are.
    """
    rows = df.count() if rows is None else rows
    if rows <= max_points:
        return df
    if hue:
        df = df.filter(q(hue).isNotNull())
        sizes = df.groupBy(q(hue).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        hues = sizes.count()
        if hues == 0:
            return downsample(df, x, y, max_points, None, key, 0)
        target = max(4, max_points // hues)
    else:
        sizes, hues, target = None, 1, max_points
    cells = [q(f.name) for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    marks = {"__a": F.xxhash64(*cells), "__b": F.xxhash64(F.lit(1), *cells)}
    level = F.coalesce(number(df, y), F.lit(0.0)).alias("level")
    keys = [f"k{i}" for i in range(len(key))]
    slim = df.select(
        *([q(hue).alias("g")] if hue else []), time_order(df, x).alias("t"), *[q(c).alias(n) for c, n in zip(key, keys, strict=True)], level, *[m.alias(n) for n, m in marks.items()]
    )
    placed = numbered(slim, ["g"] if hue else [], ["t", *keys, *marks], rows)
    if hue:
        placed = placed.join(F.broadcast(sizes) if hues <= 100_000 else sizes, "g")
    else:
        placed = placed.withColumn("n", F.lit(rows))
    buckets = max(1, target // 4)
    pos, n = F.col("__pos"), F.col("n")
    bucket = F.when(n <= target, pos).otherwise(F.floor(((pos + 1) * buckets - 1) / n))
    row = F.struct("__pos", *marks)
    ends = F.array(
        F.min_by(row, pos), F.max_by(row, pos), F.min_by(row, F.struct("level", pos)), F.max_by(row, F.struct(F.col("level"), -pos))
    )
    points = placed.groupBy(*(["g"] if hue else []), bucket.alias("bucket")).agg(F.array_distinct(ends).alias("rows"))
    points = points.select(F.inline("rows")).groupBy(*marks).agg(F.count(F.lit(1)).alias("__copies"))
    few = max(max_points, 4 * hues) <= BROADCAST_ROWS
    met = df.withColumns(marks).join(F.broadcast(points) if few else points, list(marks))
    # equal rows are interchangeable: as many of them as were chosen
    whole = F.struct(*[q(c) for c in df.columns])
    kept = met.groupBy(*marks).agg(F.first(whole).alias("row"), F.first("__copies").alias("copies"))
    return kept.select(F.inline(F.array_repeat("row", F.col("copies").cast("int"))))


def correlation_heatmap(df: DataFrame, most: int = HEATMAP_COLUMNS, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature_a, feature_b, r)`` rounded to three digits for the columns of largest variance."""
    chosen = widest_columns(df, most, columns)
    matrix = full_matrix(pearson_pairs(df, chosen), chosen)
    return matrix.select("feature_a", "feature_b", F.round("r", 3).alias("r"))


def score_histogram(scored: DataFrame, probability: str = "probability", bins: int = 25) -> DataFrame:
    """``(bin, low, high, count)`` of positive-class probabilities."""
    return histogram(scored, probability, bins).drop("hue")
