"""Comparing two tables column by column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.functions.exprs import field_type, finite, missing, number, numeric_columns, q, value_of
from plumbline.functions.ranges import BROADCAST_ROWS, cell_bounds, cells_for, join_null_safe, long_cells, long_values, named
from plumbline.functions.wide import column_table, distinct_table, level_counts
from plumbline.operators.profile import column_facts
from plumbline.operators.select import common_columns, likely_ids
from plumbline.session import materialize
from plumbline.sources.tables import fingerprint

# The thresholds at which a change is reported.
MISSING_POINTS = 10.0
MEAN_PERCENT = 10.0
NEAR_ZERO = 1e-12
ABSOLUTE_MEAN = 1e-6
STD_HIGH, STD_LOW = 1.5, 0.67
FLAT_STD = 0.01
TVD_LEVEL = 0.20
ALPHA = 0.05
LEAST_VALUES = 10


def missing_drift(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, missing_pct_a, missing_pct_b, delta, flagged)``."""
    columns = list(columns or common_columns(a, b)[0])

    def side(df, name):
        rows = [
            [F.lit(c).alias("column"), F.coalesce(F.avg(missing(df, c).cast("int")) * 100.0, F.lit(0.0)).alias(name)]
            for c in columns
        ]
        return column_table(df, rows)

    both = side(a, "missing_pct_a").join(F.broadcast(side(b, "missing_pct_b")), "column")
    delta = F.col("missing_pct_b") - F.col("missing_pct_a")
    return both.withColumn("delta", delta).withColumn("flagged", F.abs("delta") >= MISSING_POINTS)


def _moments(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    entries = []
    for c in columns:
        x = number(df, c)
        entries.append(
            [F.lit(c).alias("column"), F.avg(x).alias(f"mean_{side}"), F.stddev_samp(x).alias(f"std_{side}")]
        )
    return column_table(df, entries)


def mean_drift(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean and dispersion of both sides with shift flags, one row per shared numeric column."""
    columns = list(columns or [c for c in common_columns(a, b)[0] if c in numeric_columns(a) and c in numeric_columns(b)])
    both = _moments(a, columns, "a").join(F.broadcast(_moments(b, columns, "b")), "column")
    return _with_shift_flags(both)


def _with_shift_flags(df: DataFrame) -> DataFrame:
    delta = F.col("mean_b") - F.col("mean_a")
    near_zero = F.abs("mean_a") <= NEAR_ZERO
    pct = F.when(~near_zero, F.try_divide(delta, F.abs("mean_a")) * 100)
    ratio = F.try_divide("std_b", "std_a")
    out = df.withColumns(
        {
            "mean_delta": delta,
            "near_zero_baseline": near_zero & F.col("mean_b").isNotNull(),
            "mean_shift_pct": pct,
        }
    )
    mean_flag = F.when(F.col("near_zero_baseline"), F.abs("mean_delta") >= ABSOLUTE_MEAN).otherwise(
        F.abs("mean_shift_pct") >= MEAN_PERCENT
    )
    spread_flag = F.when(F.col("std_a") > NEAR_ZERO, (ratio >= STD_HIGH) | (ratio <= STD_LOW)).otherwise(
        F.col("std_b") > FLAT_STD
    )
    known = F.col("std_a").isNotNull() & F.col("std_b").isNotNull()
    return out.withColumns(
        {
            "mean_flagged": F.coalesce(mean_flag, F.lit(False)),
            "dispersion_flagged": F.coalesce(known & spread_flag, F.lit(False)),
        }
    )


def dtype_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(column, type_a, type_b, changed)`` for shared columns."""
    shared = common_columns(a, b)[0]
    rows = [
        (c, field_type(a, c).simpleString(), field_type(b, c).simpleString(), field_type(a, c) != field_type(b, c))
        for c in shared
    ]
    return a.sparkSession.createDataFrame(rows, "column string, type_a string, type_b string, changed boolean")


def ks_p_value(d: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sided p-value of the two-sample statistic (with the small-sample correction)."""
    ne = F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    lam = (ne + 0.12 + 0.11 / ne) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    # below this the series has not converged and the value is one to fifteen digits
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def _sides(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both tables' finite values of the columns as doubles with a side mark (true for B)."""
    parts = [df.select(F.lit(mark).alias("side"), *[finite(df, c).alias(c) for c in columns]) for df, mark in ((a, False), (b, True))]
    return parts[0].unionByName(parts[1])


def ks_statistics(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """``(column, n_a, n_b, ks_stat, ks_p)`` for shared numeric columns with ten finite values a side.

    The statistic is exact. Large inputs first count values per cell; the gap between the two
    distributions is then known at every cell edge, and only cells in which it could still grow past
    the largest edge gap are looked at value by value.
    """
    columns = list(columns or [c for c in common_columns(a, b)[0] if c in numeric_columns(a) and c in numeric_columns(b)])
    spark = a.sparkSession
    if not columns:
        return spark.createDataFrame([], "column string, n_a long, n_b long, ks_stat double, ks_p double")
    both = _sides(a, b, columns)
    rows = a.count() + b.count() if rows is None else rows
    parts = cells_for(both, rows)
    in_a, in_b = F.count_if(~F.col("side")), F.count_if("side")
    w = Window.partitionBy("column")

    if parts == 1:
        counts = long_values(both, columns, ["side"]).groupBy("column", "value").agg(in_a.alias("a"), in_b.alias("b"))
        upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        steps = counts.select(
            "column",
            F.sum("a").over(upto).alias("ca"),
            F.sum("b").over(upto).alias("cb"),
            F.sum("a").over(w).alias("n_a"),
            F.sum("b").over(w).alias("n_b"),
        )
        gap = F.abs(F.try_divide("ca", "n_a") - F.try_divide("cb", "n_b"))
        stats = steps.groupBy("column").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max(gap).alias("ks_stat"))
    else:
        cells = long_cells(both, columns, cell_bounds(both, columns, parts, rows), ["side"])
        totals = cells.groupBy("column", "cell").agg(in_a.alias("a"), in_b.alias("b"))
        before = w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(
            "*",
            F.coalesce(F.sum("a").over(before), F.lit(0)).alias("pa"),
            F.coalesce(F.sum("b").over(before), F.lit(0)).alias("pb"),
            F.sum("a").over(w).alias("n_a"),
            F.sum("b").over(w).alias("n_b"),
        )
        here = F.try_divide("pa", "n_a") - F.try_divide("pb", "n_b")
        edge = F.abs(F.try_divide(F.col("pa") + F.col("a"), "n_a") - F.try_divide(F.col("pb") + F.col("b"), "n_b"))
        reach = F.greatest(here + F.try_divide("a", "n_a"), F.try_divide("b", "n_b") - here)
        # cells x columns rows, used three times: computed once
        totals = materialize(totals.select("*", edge.alias("edge"), reach.alias("reach")).withColumn("best", F.max("edge").over(w)))
        open_cells = totals.filter(F.col("reach") > F.col("best"))
        keys = ["column", "cell"]
        marks = open_cells.select(*keys)
        marks = F.broadcast(marks) if parts * len(columns) <= BROADCAST_ROWS else marks
        inner = cells.join(marks, keys, "left_semi").groupBy(*keys, "value").agg(in_a.alias("va"), in_b.alias("vb"))
        run = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        inner = inner.select(*keys, F.sum("va").over(run).alias("ra"), F.sum("vb").over(run).alias("rb"))
        fine = inner.join(open_cells.select(*keys, "pa", "pb", "n_a", "n_b"), keys).groupBy("column").agg(
            F.max(
                F.abs(
                    F.try_divide(F.col("pa") + F.col("ra"), "n_a") - F.try_divide(F.col("pb") + F.col("rb"), "n_b")
                )
            ).alias("fine")
        )
        coarse = totals.groupBy("column").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.max("edge").alias("coarse"))
        stats = coarse.join(fine, "column", "left").select(
            "column", "n_a", "n_b", F.greatest("coarse", F.coalesce("fine", F.lit(0.0))).alias("ks_stat")
        )
    enough = (F.col("n_a") >= LEAST_VALUES) & (F.col("n_b") >= LEAST_VALUES)
    return named(stats.filter(enough), columns).withColumn("ks_p", ks_p_value(F.col("ks_stat"), F.col("n_a"), F.col("n_b")))


def category_shift(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, n_a, n_b, tvd)``: total variation distance of level shares, ten values a side."""
    if columns is None:
        numbers = set(numeric_columns(a)) & set(numeric_columns(b))
        columns = [c for c in common_columns(a, b)[0] if c not in numbers]
    if not columns:
        return a.sparkSession.createDataFrame([], "column string, n_a long, n_b long, tvd double")
    # only the identity of a level matters here, so long texts travel as their digest
    left = level_counts(a, columns, digest_beyond=64).select("column", "level", F.col("cnt").alias("a"), F.lit(0).cast("long").alias("b"))
    right = level_counts(b, columns, digest_beyond=64).select("column", "level", F.lit(0).cast("long").alias("a"), F.col("cnt").alias("b"))
    levels = left.unionByName(right).groupBy("column", "level").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    totals = levels.groupBy("column").agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    # one row per column, so safe to broadcast
    shares = levels.join(F.broadcast(totals), "column").filter((F.col("n_a") >= LEAST_VALUES) & (F.col("n_b") >= LEAST_VALUES))
    gap = F.abs(F.try_divide("a", "n_a") - F.try_divide("b", "n_b"))
    return shares.groupBy("column").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), (F.sum(gap) * 0.5).alias("tvd"))


def benjamini_hochberg(tests: DataFrame, p: str = "ks_p", key: str = "column", name: str = "ks_q") -> DataFrame:
    """Add q-values rounded to four digits. The input holds one row per test (at most one per column)."""
    everything = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everything.orderBy(p, key))
    ranked = tests.withColumns({"__rank": rank, "__n": F.count(F.lit(1)).over(everything)})
    raw = F.least(F.lit(1.0), F.col("__n") / F.col("__rank") * F.col(p))
    later = everything.orderBy("__rank").rowsBetween(0, Window.unboundedFollowing)
    return ranked.withColumn(name, F.round(F.min(raw).over(later), 4)).drop("__rank", "__n")


def distinct_counts(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, distinct_a, distinct_b)``; nested cells count by their JSON text."""
    columns = list(columns or common_columns(a, b)[0])

    names = a.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    out = names
    for df, name in ((a, "distinct_a"), (b, "distinct_b")):
        found = distinct_table(df, columns).withColumnRenamed("distinct_values", name)
        out = out.join(F.broadcast(found), "column", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def drift_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """Everything known about every shared column, one row each, with a flag text (``OK`` if stable)."""
    shared = common_columns(a, b)[0]
    if not shared:
        raise ValueError("the two tables share no column")
    numbers = [c for c in shared if c in numeric_columns(a) and c in numeric_columns(b)]
    others = [c for c in shared if c not in numbers]

    def facts(df, side):
        base = column_facts(df, shared)
        gap = F.coalesce(F.try_divide(F.col("missing") * 100.0, F.col("rows")), F.lit(0.0))
        return base.select(
            "column",
            F.col("data_type").alias(f"type_{side}"),
            F.col("rows").alias(f"rows_{side}"),
            gap.alias(f"missing_pct_{side}"),
            F.col("distinct_values").alias(f"distinct_{side}"),
        )

    # every table below has one row per column
    out = facts(a, "a").join(F.broadcast(facts(b, "b")), "column")
    empty = a.sparkSession.createDataFrame([], "column string, mean_a double, std_a double, mean_b double, std_b double")
    if numbers:
        spread = _moments(a, numbers, "a").join(F.broadcast(_moments(b, numbers, "b")), "column")
    else:
        spread = empty
    out = _with_shift_flags(out.join(F.broadcast(spread), "column", "left"))
    tests = benjamini_hochberg(ks_statistics(a, b, numbers))
    tests = tests.select("column", "ks_stat", "ks_p", "ks_q", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("__tests"))
    out = out.join(F.broadcast(tests), "column", "left")
    out = out.join(F.broadcast(category_shift(a, b, others).select("column", "tvd")), "column", "left")

    delta = F.col("missing_pct_b") - F.col("missing_pct_a")
    flags = F.concat_ws(
        "; ",
        F.when(F.col("type_a") != F.col("type_b"), F.concat(F.lit("dtype "), "type_a", F.lit("→"), "type_b")),
        F.when(F.abs(delta) >= MISSING_POINTS, F.format_string("missingness Δ%+.1f%%", delta)),
        F.when(
            F.col("mean_flagged"),
            F.when(
                F.col("near_zero_baseline"), F.format_string("mean shift Δ%+.3f (baseline ≈ 0)", F.col("mean_delta"))
            ).otherwise(F.format_string("mean shift %+.1f%%", F.col("mean_shift_pct"))),
        ),
        F.when(F.col("dispersion_flagged"), F.format_string("dispersion shift (std %.2f→%.2f)", F.col("std_a"), F.col("std_b"))),
        F.when(F.col("tvd") >= TVD_LEVEL, F.format_string("categorical drift (TVD=%.3f)", F.round("tvd", 4))),
        F.when(
            F.col("ks_q") < ALPHA,
            F.format_string(
                "distribution drift (KS stat=%.3f, %s=%.4f)",
                F.col("ks_stat"),
                F.when(F.col("__tests") > 1, "p_adj").otherwise("p"),
                F.col("ks_q"),
            ),
        ),
    )
    return out.select(
        "column",
        (F.col("type_a") == F.col("type_b")).alias("dtype_match"),
        F.round("missing_pct_a", 1).alias("missing_pct_a"),
        F.round("missing_pct_b", 1).alias("missing_pct_b"),
        F.round("mean_a", 3).alias("mean_a"),
        F.round("mean_b", 3).alias("mean_b"),
        F.round("mean_shift_pct", 1).alias("mean_shift_pct"),
        F.coalesce("near_zero_baseline", F.lit(False)).alias("near_zero_baseline"),
        F.round("std_a", 3).alias("std_a"),
        F.round("std_b", 3).alias("std_b"),
        F.round("ks_stat", 4).alias("ks_stat"),
        F.round("ks_p", 4).alias("ks_p"),
        "ks_q",
        F.round("tvd", 4).alias("tvd"),
        "distinct_a",
        "distinct_b",
        F.when(flags == "", "OK").otherwise(flags).alias("flags"),
    )


def drift_verdicts(report: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """``(column, status, cause)``: one plain sentence per column, by a fixed order of causes."""
    is_id = F.col("column").isin(list(ids)) if ids else F.lit(False)
    status = F.when(is_id, "ID / Key").when(F.col("flags") == "OK", "Stable").otherwise("Drift detected")
    cause = (
        F.when(is_id, "Unique ID / key (omitted from drift test)")
        .when(F.col("flags") == "OK", "No significant change")
        .when(F.col("mean_shift_pct").isNotNull(), F.format_string("Average shifted by %+.1f%%", F.col("mean_shift_pct")))
        .when(F.col("tvd") >= TVD_LEVEL, "Category mix changed")
        .when(F.contains("flags", F.lit("distribution drift")), "Value distribution shifted")
        .when(F.contains("flags", F.lit("missingness")), "Missing rate changed")
        .when(F.contains("flags", F.lit("dtype")), "Data type changed")
        .otherwise("Distribution shifted")
    )
    return report.select("column", status.alias("status"), cause.alias("cause"))


def pair_summary(a: DataFrame, b: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """One row: row counts, difference, matched columns, analytic and drifted columns (identifiers left out)."""
    shared = common_columns(a, b)[0]
    ids = sorted(({*likely_ids(a)} | {*likely_ids(b)}) & {*shared})
    report = drift_report(a, b) if report is None else report
    counted = report.filter(~F.col("column").isin(ids)) if ids else report
    facts = counted.agg(F.count(F.lit(1)).alias("analytic_columns"), F.count_if(F.col("flags") != "OK").alias("drifted_columns"))
    rows_a, rows_b = a.count(), b.count()
    return facts.select(
        F.lit(rows_a).cast("long").alias("rows_a"),
        F.lit(rows_b).cast("long").alias("rows_b"),
        F.lit(rows_b - rows_a).cast("long").alias("row_difference"),
        F.lit(len(shared)).cast("long").alias("matched_columns"),
        F.lit(max(len(a.columns), len(b.columns))).cast("long").alias("widest_columns"),
        "analytic_columns",
        "drifted_columns",
    )


def unseen_level_rows(known: DataFrame, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, level, rows)`` of every level of ``scored`` that the table ``known`` (column, level) lacks."""
    fresh = level_counts(scored, columns).join(known.select("column", "level"), ["column", "level"], "left_anti")
    return fresh.withColumnRenamed("cnt", "rows")


def unseen_levels(train: DataFrame, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, unseen_levels, unseen_rows)`` of levels that training did not hold, however many it held."""
    fresh = unseen_level_rows(level_counts(train, columns), scored, columns).withColumnRenamed("rows", "cnt")
    found = fresh.groupBy("column").agg(F.count(F.lit(1)).alias("unseen_levels"), F.sum("cnt").alias("unseen_rows"))
    names = train.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(found, "column", "left").select(
        "column", F.coalesce("unseen_levels", F.lit(0)).alias("unseen_levels"), F.coalesce("unseen_rows", F.lit(0)).alias("unseen_rows")
    )


def training_overlap(train: DataFrame, scored: DataFrame, same_name: bool = False) -> DataFrame:
    """One row: ``(same_content, verdict)`` by table fingerprint, name only as a hint."""
    prints = fingerprint(train).unionByName(fingerprint(scored))
    same = F.count_distinct("fingerprint") == 1
    verdict = F.when(same, "overlap").when(F.lit(same_name), "possible new version").otherwise("no overlap")
    return prints.agg(same.alias("same_content"), verdict.alias("verdict"))


def row_overlap(train: DataFrame, scored: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: scored rows, how many occur identically in training, and their share.

    Both sides are counted by content before they meet, so copies never multiply.
    """
    columns = list(columns or common_columns(train, scored)[0])
    left = scored.select(*[value_of(scored, c).alias(c) for c in columns]).groupBy(*[q(c) for c in columns]).agg(F.count(F.lit(1)).alias("__n"))
    right = train.select(*[value_of(train, c).alias(c) for c in columns]).distinct().withColumn("__seen", F.lit(1))
    joined = join_null_safe(left, right, columns, "left")
    return joined.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(F.col("__seen") == 1, F.col("__n"))), F.lit(0)).alias("overlapping")
    ).withColumn("overlap_share", F.coalesce(F.try_divide("overlapping", "rows"), F.lit(0.0)))
