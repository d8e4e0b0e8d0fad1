"""Exploratory statistics over whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plumbline.functions.exprs import any_of, number, numeric_columns, other_columns, q
from plumbline.functions.ranges import BROADCAST_ROWS, join_null_safe, quantile_table, quantiles
from plumbline.functions.ranks import gap_patterns, rank_products
from plumbline.functions.wide import column_table, level_counts, top_of, union_all


# more numeric columns than this are correlated through matrix products per batch
PAIRWISE_COLUMNS = 8


def corrected_skew(x: Column) -> Column:
    """Sample skewness with bias correction; null below three values, zero for a constant."""
    n, m2 = F.count(x).cast("double"), F.var_pop(x)
    g1 = F.skewness(x)
    return (
        F.when(n < 3, None)
        .when(m2 < 1e-14, 0.0)
        .otherwise(g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    )


def corrected_kurtosis(x: Column) -> Column:
    """Sample excess kurtosis with bias correction; null below four values, zero for a constant."""
    n, m2 = F.count(x).cast("double"), F.var_pop(x)
    g2 = F.kurtosis(x)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when(n < 4, None).when(m2 < 1e-14, 0.0).otherwise(scale * ((n + 1) * g2 + 6))


def _quartile_columns(df: DataFrame, columns: Sequence[str], rows: int | None) -> DataFrame:
    table = quantile_table(df, columns, [0.25, 0.5, 0.75], rows=rows)
    return table.select("column", *[F.get("quantiles", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, mean, std, min, max, skew, kurtosis)`` from one pass."""
    entries = []
    for c in columns:
        x = number(df, c)
        entries.append(
            [
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                corrected_skew(x).alias("skew"),
                corrected_kurtosis(x).alias("kurtosis"),
            ]
        )
    return column_table(df, entries, "column string, n long, mean double, std double, min double, max double, skew double, kurtosis double")


def describe(df: DataFrame, columns: Sequence[str] | None = None, redact: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, quartiles, max, skew and kurtosis per numeric column.

    Columns without values are left out; values of redacted columns are replaced by nulls and a flag.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = _quartile_columns(df, columns, df.count()) if columns else column_table(df, [], "column string, q1 double, median double, q3 double")
    table = moments(df, columns).join(F.broadcast(quartiles), "column", "left")
    hide = F.col("column").isin(list(redact)) if redact else F.lit(False)
    shown = [F.when(~hide, F.col(c)).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max", "skew", "kurtosis")]
    return table.filter("n > 0").select("column", "n", *shown, hide.alias("redacted"))


def univariate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, mean, std, median, iqr, skew, kurtosis)`` per numeric column with values."""
    return describe(df, columns).select(
        "column", "mean", "std", "median", (F.col("q3") - F.col("q1")).alias("iqr"), "skew", "kurtosis"
    )


def _normal_terms(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """The two normal scores of the omnibus test (skewness score, kurtosis score)."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    ratio = F.when(y == 0, 1.0).otherwise(y) / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))
    centre = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - centre) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    cube = F.signum(denom) * F.pow((1 - 2 / a) / F.nullif(F.abs(denom), F.lit(0.0)), F.lit(1.0 / 3.0))
    z_kurt = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    return z_skew, z_kurt


def normality(df: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """D'Agostino-Pearson omnibus test: ``(column, n, k2, p_value, verdict)``; needs eight values."""
    entries = []
    for c in columns or numeric_columns(df):
        x = number(df, c)
        entries.append(
            [
                F.lit(c).alias("column"),
                F.count(x).alias("n"),
                F.skewness(x).alias("g1"),
                F.kurtosis(x).alias("g2"),
                F.var_pop(x).alias("m2"),
            ]
        )
    table = column_table(df, entries, "column string, n long, g1 double, g2 double, m2 double").filter("n > 0")
    usable = (F.col("n") >= 8) & (F.col("m2") > 0)
    n = F.when(usable, F.col("n").cast("double"))
    z_skew, z_kurt = _normal_terms(n, F.col("g1"), F.col("g2"))
    table = table.withColumn("k2", z_skew * z_skew + z_kurt * z_kurt).withColumn("p_value", F.exp(-F.col("k2") / 2))
    verdict = (
        F.when(F.col("n") < 8, "too few values")
        .when(F.col("p_value").isNull(), "undetermined")
        .when(F.col("p_value") >= alpha, "gaussian")
        .otherwise("non-gaussian")
    )
    return table.select("column", "n", "k2", "p_value", verdict.alias("verdict"))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, distinct_values, top_level, top_count, top_share)``; ties go to the smallest level."""
    columns = list(columns or other_columns(df))
    found = top_of(level_counts(df, columns))
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select(
        "column",
        F.coalesce("levels", F.lit(0)).alias("distinct_values"),
        F.col("top").alias("top_level"),
        F.coalesce("top_count", F.lit(0)).alias("top_count"),
        F.coalesce(F.try_divide(F.col("top_count") * 100.0, F.col("present")), F.lit(0.0)).alias("top_share"),
    )


def _bounded_r(cov: Column, sx: Column, sy: Column) -> Column:
    # infinite cells make it NaN, which is no correlation and would pass the bounds as 1
    r = F.nanvl(F.try_divide(cov, sx * sy), F.lit(None).cast("double"))
    # least and greatest skip nulls, so an undefined correlation must be kept apart
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(feature_a, feature_b, i, j, n, r)`` for every pair i < j over pairwise complete rows.

    A few columns are plain aggregates per pair; many columns go through block products.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) > PAIRWISE_COLUMNS:
        return _pearson_by_products(df, columns)
    entries = []
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        x, y = number(df, a), number(df, b)
        xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        entries.append(
            [
                F.lit(a).alias("feature_a"),
                F.lit(b).alias("feature_b"),
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                F.count(xm + ym).alias("n"),
                _bounded_r(F.covar_pop(x, y), F.stddev_pop(xm), F.stddev_pop(ym)).alias("r"),
            ]
        )
    return column_table(df, entries, "feature_a string, feature_b string, i int, j int, n long, r double")


def _pearson_by_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``pearson_pairs`` with one matrix product per Arrow batch instead of an aggregate per pair.

    Each task returns columns x columns sums of its rows, taken around the column means so that no
    digits are lost; Spark adds them up.
    """
    ids = [f"v{i}" for i in range(len(columns))]
    wide = df.select(*[number(df, c).alias(v) for c, v in zip(columns, ids)])
    means = wide.agg(*[F.avg(v).alias(v) for v in ids]).first()
    centre = np.array([0.0 if means[v] is None or not math.isfinite(means[v]) else means[v] for v in ids])
    upper = np.triu_indices(len(ids), k=1)

    def work(batches):
        sums = np.zeros((4, len(ids), len(ids)))
        for batch in batches:
            x = batch.to_numpy(dtype="float64", na_value=np.nan) - centre
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            mark = here.astype("float64")
            sums += np.stack([mark.T @ mark, x.T @ mark, (x * x).T @ mark, x.T @ x])
        n, s, ss, xy = sums
        i, j = upper
        yield pd.DataFrame(
            {"i": i, "j": j, "n": n[i, j], "sx": s[i, j], "sy": s[j, i], "sxx": ss[i, j], "syy": ss[j, i], "sxy": xy[i, j]}
        )

    parts = wide.mapInPandas(work, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def spread(sq, s):
        # what is left of a constant column is rounding noise, not variance
        v = F.col("n") * F.col(sq) - F.col(s) * F.col(s)
        return F.when(v > F.col("n") * F.col(sq) * 1e-12, v)

    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    r = _bounded_r(cov, F.sqrt(spread("sxx", "sx")), F.sqrt(spread("syy", "sy")))
    names = F.array(*[F.lit(c) for c in columns])
    return t.select(
        F.element_at(names, F.col("i") + 1).alias("feature_a"),
        F.element_at(names, F.col("j") + 1).alias("feature_b"),
        "i",
        "j",
        F.col("n").cast("long").alias("n"),
        r.alias("r"),
    )


def full_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both triangles and the diagonal as ``(feature_a, feature_b, r)``."""
    names = pairs.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "feature_a string, feature_b string, r double")
    upper = pairs.select("feature_a", "feature_b", "r")
    lower = pairs.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "r")
    return union_all([upper, lower, names])


def spearman_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rank correlation of every pair, ``(feature_a, feature_b, i, j, n, r)``; ties share the average rank.

    A pair with missing cells is ranked on its own complete rows. Columns that miss the same rows form a pattern, and a
    column is ranked for all patterns at once, so the rows are sorted once a column, however many patterns there are.
    Values of a column with few are sent to where the rows are; of many values, only cells move (``rank_products``).
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, i int, j int, n long, r double")
    ids = [f"x{i}" for i in range(len(columns))]
    values = df.select(*[number(df, c).alias(x) for c, x in zip(columns, ids)])
    rows, pattern = gap_patterns(values, ids)
    distinct = values.agg(*[F.approx_count_distinct(x).alias(x) for x in ids]).first()
    # a value has one rank for its own rows and one for each pattern
    few = [i for i, x in enumerate(ids) if distinct[x] * (max(pattern) + 2) <= BROADCAST_ROWS]
    sums = rank_products(values, ids, pattern, list(combinations(range(len(ids)), 2)), few, rows)
    names = F.array(*[F.lit(c) for c in columns])
    return sums.filter("n > 0").select(
        F.element_at(names, F.col("i") + 1).alias("feature_a"),
        F.element_at(names, F.col("j") + 1).alias("feature_b"),
        "i",
        "j",
        "n",
        _bounded_r(F.col("ab"), F.sqrt("aa"), F.sqrt("bb")).alias("r"),
    )


def strongest_pairs(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` highest and ``k`` lowest correlations: ``(side, position, feature_a, feature_b, r)``."""
    known = pairs.filter(F.col("r").isNotNull())
    frames = []
    for side, order in (("positive", F.col("r").desc()), ("negative", F.col("r").asc())):
        top = known.orderBy(order, "feature_a", "feature_b").limit(k)
        w = Window.orderBy(order, "feature_a", "feature_b")
        frames.append(top.select(F.lit(side).alias("side"), F.row_number().over(w).alias("position"), "feature_a", "feature_b", "r"))
    return union_all(frames)


def correlation_insights(pairs: DataFrame, least: float = 0.3, k: int = 12) -> DataFrame:
    """Notable pairs, strongest first, with strength and direction."""
    size = F.abs("r")
    strength = F.when(size >= 0.7, "Strong").when(size >= 0.4, "Moderate").otherwise("Weak")
    return (
        pairs.filter(size >= least)
        .orderBy(size.desc(), "i", "j")
        .limit(k)
        .select("feature_a", "feature_b", "r", strength.alias("strength"), F.when(F.col("r") > 0, "Positive").otherwise("Negative").alias("direction"))
    )


def variance_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    entries = [[F.lit(c).alias("column"), F.var_samp(number(df, c)).alias("variance")] for c in columns or numeric_columns(df)]
    return column_table(df, entries, "column string, variance double")


def top_variance(df: DataFrame, k: int = 30, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``k`` numeric columns with the largest variance, ``(column, variance)``."""
    return variance_table(df, columns).orderBy(F.col("variance").desc_nulls_last(), "column").limit(k)


def widest_columns(df: DataFrame, k: int, columns: Sequence[str] | None = None) -> list[str]:
    """All numeric columns, or the ``k`` of largest variance when there are more."""
    columns = list(columns or numeric_columns(df))
    if len(columns) <= k:
        return columns
    return [r["column"] for r in top_variance(df, k, columns).collect()]


def vif(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Variance inflation factors, ``(column, r2, vif, severity)``, from one pass over the rows.

    The pass yields a correlation matrix of columns x columns numbers; each R squared is the least
    squares fit of one column on the others within that matrix. Complete rows are used, or
    mean-filled ones when there are fewer of them than columns + 1.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "column string, r2 double, vif double, severity string")
    columns = [c for c in columns or numeric_columns(df) if c in df.columns]
    if len(columns) < 2:
        return empty
    facts = df.agg(
        *[F.min(number(df, c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(number(df, c)).alias(f"hi{i}") for i, c in enumerate(columns)],
        *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    varied = [i for i in range(len(columns)) if facts[f"lo{i}"] is not None and facts[f"lo{i}"] < facts[f"hi{i}"]]
    if len(varied) < 2:
        return empty
    names = [columns[i] for i in varied]
    wide = df.select(*[number(df, c).alias(c) for c in names])
    full = wide.dropna()
    if full.limit(len(names) + 1).count() < len(names) + 1:
        full = wide.select(*[F.coalesce(q(columns[i]), F.lit(facts[f"m{i}"]), F.lit(0.0)).alias(columns[i]) for i in varied])
    matrix = np.eye(len(names))
    for r in pearson_pairs(full, names).collect():
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = 0.0 if r["r"] is None else r["r"]
    out = []
    for i, name in enumerate(names):
        others = [j for j in range(len(names)) if j != i]
        target = matrix[others, i]
        weights = np.linalg.lstsq(matrix[np.ix_(others, others)], target, rcond=1e-10)[0]
        r2 = float(min(max(target @ weights, 0.0), 1.0))
        factor = 1.0 / (1.0 - r2) if 1.0 - r2 > 1e-6 else 999.99
        severity = "Low" if factor < 5 else "Moderate" if factor < 10 else "High"
        out.append((name, r2, factor, severity))
    table = spark.createDataFrame(out, "column string, r2 double, vif double, severity string")
    return table.orderBy(F.col("vif").desc(), "column")


def tukey_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5, flat_iqr_is_clean: bool = False) -> DataFrame:
    """Tukey fences and counts outside them, and z-score counts (population std), per column.

    Columns with fewer than four values get no fences and zero counts. With ``flat_iqr_is_clean`` a
    column whose quartiles coincide counts no outliers (the report's rule).
    """
    columns = list(columns or numeric_columns(df))
    empty = (
        "column string, n long, q1 double, q3 double, iqr double, lower_fence double, upper_fence double, "
        "outliers long, outlier_pct double, z_outliers long"
    )
    if not columns:
        return column_table(df, [], empty)
    rows = df.count()
    quarts = quantiles(df, columns, [0.25, 0.75], rows=rows)
    scale = df.agg(
        *[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(number(df, c)).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    entries = []
    for i, c in enumerate(columns):
        x, n = number(df, c), F.count(number(df, c))
        q1, q3 = quarts[c]
        mean, std = scale[f"m{i}"], scale[f"s{i}"]
        none = F.lit(None).cast("double")
        if q1 is None:
            q1 = q3 = float("nan")
        iqr = q3 - q1
        low, high = q1 - k * iqr, q3 + k * iqr
        enough = n >= 4

        def shown(v):
            return F.when(enough, F.lit(float(v))).otherwise(none)

        outside = F.count_if((x < low) | (x > high)) if not math.isnan(iqr) else F.lit(0)
        if flat_iqr_is_clean and not iqr > 0:
            outside = F.lit(0)
        far = F.count_if(F.abs((x - mean) / std) >= 3.0) if std else F.lit(0)
        entries.append(
            [
                F.lit(c).alias("column"),
                n.alias("n"),
                shown(q1).alias("q1"),
                shown(q3).alias("q3"),
                shown(iqr).alias("iqr"),
                shown(low).alias("lower_fence"),
                shown(high).alias("upper_fence"),
                F.when(enough, outside).otherwise(0).cast("long").alias("outliers"),
                F.when(enough, F.try_divide(outside * 100.0, n)).otherwise(0.0).alias("outlier_pct"),
                F.when(enough, far).otherwise(0).cast("long").alias("z_outliers"),
            ]
        )
    return column_table(df, entries)


def audit_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """``tukey_outliers`` for presentation: only columns with four values, rounded, share as text."""
    table = tukey_outliers(df, columns, k).filter("n >= 4")
    shown = [F.round(c, 3).alias(c) for c in ("q1", "q3", "iqr", "lower_fence", "upper_fence")]
    share = F.format_string("%.2f%%", F.col("outlier_pct"))
    return table.select("column", *shown, "outliers", share.alias("outlier_share"), "z_outliers")


def outlier_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str], k: float = 1.5) -> DataFrame:
    """``(keys..., column, value)``: the cells outside their column's fences."""
    fences = {r["column"]: r for r in tukey_outliers(df, columns, k).collect()}
    cells = []
    for c in columns:
        if fences[c]["lower_fence"] is None:
            continue
        x = number(df, c)
        hit = (x < fences[c]["lower_fence"]) | (x > fences[c]["upper_fence"])
        cells.append(F.struct(F.lit(c).alias("column"), F.when(hit, x).alias("value"), hit.alias("hit")))
    if not cells:
        return df.limit(0).select(*[q(key) for key in keys], F.lit("").alias("column"), F.lit(0.0).alias("value"))
    touched = df.filter(any_of([F.coalesce(c.getField("hit"), F.lit(False)) for c in cells]))
    long = touched.select(*[q(key) for key in keys], F.inline(F.array(*cells)))
    return long.filter("hit").drop("hit")


def outlier_summary(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Fences, counts, population skew and kurtosis and a shape label per column with four values."""
    columns = list(columns or numeric_columns(df))
    entries = []
    for c in columns:
        x = number(df, c)
        flat = F.coalesce(F.stddev_samp(x), F.lit(0.0)) <= 1e-9
        entries.append(
            [
                F.lit(c).alias("column"),
                flat.alias("flat"),
                F.when(flat, 0.0).otherwise(F.skewness(x)).alias("skew"),
                F.when(flat, 0.0).otherwise(F.kurtosis(x)).alias("kurtosis"),
            ]
        )
    shape = (
        F.when(F.col("skew") > 1, "Right-skewed")
        .when(F.col("skew") < -1, "Left-skewed")
        .when(F.col("kurtosis") > 2, "Heavy-tailed")
        .when(F.col("kurtosis") < -1, "Light-tailed")
        .otherwise("Symmetric")
    )
    table = tukey_outliers(df, columns, k).filter("n >= 4").join(F.broadcast(column_table(df, entries)), "column")
    z = F.when(F.col("flat"), 0).otherwise(F.col("z_outliers"))
    return table.select(
        "column",
        "q1",
        "q3",
        "iqr",
        "lower_fence",
        "upper_fence",
        "outliers",
        "outlier_pct",
        z.alias("z_outliers"),
        F.try_divide(z * 100.0, F.col("n")).alias("z_pct"),
        "skew",
        "kurtosis",
        shape.alias("shape"),
    )


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, f, m = 1.0, 0.0, 1.0, 0
    for step in range(0, 2000):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or tiny)
        c = (1.0 + term / c) or tiny
        f *= c * d
        if step and abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def f_upper_tail(f: float | None, d1: float, d2: float) -> float | None:
    """P(F > f) for an F distribution with ``d1`` and ``d2`` degrees of freedom."""
    if f is None or math.isnan(f) or d2 <= 0:
        return None
    return _incomplete_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if math.isfinite(f) else 0.0


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_upper_tail(*row) for row in zip(f, d1, d2)], dtype="float64")


def anova(df: DataFrame, group: str, target: str) -> DataFrame:
    """One-way ANOVA over groups of at least three rows: one row ``(groups, n, f, p_value, p_text, verdict)``.

    Only counts, means and variances per group are combined; no rows when fewer than two groups qualify.
    """
    x = number(df, target)
    centre = df.agg(F.avg(x)).first()[0] or 0.0
    per = df.filter(q(group).isNotNull()).groupBy(q(group).alias("g")).agg(
        F.count(F.lit(1)).alias("rows"), F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v")
    )
    # squares around a point close to the grand mean, so subtracting the offset loses no digits
    off = F.col("m") - F.lit(float(centre))
    sums = per.filter("rows >= 3 and n > 0").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("n"),
        F.sum(F.coalesce("v", F.lit(0.0)) * (F.col("n") - 1)).alias("within"),
        (F.sum(F.col("n") * off * off) - F.try_divide(F.pow(F.sum(F.col("n") * off), 2), F.sum("n"))).alias("between"),
    )
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    stat = F.try_divide(F.try_divide("between", d1), F.try_divide("within", d2))
    tested = sums.filter("groups >= 2").select("groups", "n", stat.alias("f"), d1.alias("d1"), d2.alias("d2"))
    tested = tested.withColumn("p_value", _f_tail("f", "d1", "d2"))
    text = F.when(F.col("p_value") < 0.001, "< 0.001").otherwise(F.format_string("%.4f", F.col("p_value")))
    verdict = F.when(F.col("p_value") < 0.05, "significant").otherwise("not significant")
    return tested.select("groups", "n", "f", "d1", "d2", "p_value", text.alias("p_text"), verdict.alias("verdict"))


def group_breakdown(df: DataFrame, group: str, target: str, least: int = 3) -> DataFrame:
    """``(group, count, mean, std, median)`` of groups with enough rows."""
    named = df.filter(q(group).isNotNull()).select(q(group).alias("group"), number(df, target).alias("x"))
    stats = named.groupBy("group").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")
    )
    mids = quantile_table(named, ["x"], [0.5], by=["group"]).select("group", F.get("quantiles", 0).alias("median"))
    joined = join_null_safe(stats.filter(F.col("rows") >= least), mids, ["group"], "left")
    return joined.select("group", "count", "mean", "std", "median")
