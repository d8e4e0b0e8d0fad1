"""Train/test splits and folds with exact sizes, found as cut values instead of shuffled rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import datetime_columns, q, total
from plumbline.functions.ranges import cuts_by_group, first_k, first_ks, numbered, within_cuts
from plumbline.operators.select import with_order

PART = "is_test"
MAX_CLASSES = 10_000


def random_split(df: DataFrame, key: Sequence[str], fraction: float = 0.2, seed: int | None = 42) -> DataFrame:
    """Add ``is_test``, true for exactly ceil(rows x fraction) rows in seeded order of a unique key."""
    rows = df.count()
    ordered, order = with_order(df, key, seed)
    mark = first_k(ordered, order, math.ceil(rows * fraction), rows)
    return ordered.withColumn(PART, mark).drop(*order)


def class_counts(df: DataFrame, target: str) -> dict[str, int]:
    """Rows per class; an error when there are too many classes for a classification target."""
    counts = df.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES:,} classes; treat it as an identifier or a number")
    return {r["k"]: r["n"] for r in found}


def class_table(df: DataFrame, target: str) -> DataFrame:
    """``(class, n)``: rows per class, however many classes there are; rows without a class are left out."""
    label = q(target).cast("string").alias("class")
    return df.filter(q(target).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratified_sizes(counts: DataFrame, fraction: float) -> DataFrame:
    """``(class, n, k)``: test rows per class adding up to ceil(rows x fraction). Shares are rounded down, the rest goes
    to the largest remainders (ties in class order)."""
    facts = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("classes")).first()
    rows, want = facts["rows"], math.ceil(facts["rows"] * fraction)
    share = F.col("n").cast("decimal(19,0)") * F.lit(want).cast("decimal(19,0)")
    floor = F.expr(f"(CAST(n AS DECIMAL(19,0)) * {want}) div {max(1, rows)}")
    parts = counts.withColumn("base", floor)
    parts = parts.withColumn("behind", (F.col("base").cast("decimal(19,0)") * F.lit(rows).cast("decimal(19,0)") - share).cast("decimal(38,0)"))
    rest = want - (parts.agg(F.sum("base")).first()[0] or 0)
    ranked = numbered(parts, [], ["behind", "class"], facts["classes"])
    return ranked.select("class", "n", (F.col("base") + (F.col("__pos") < rest).cast("long")).alias("k"))


def stratification_problem(counts: DataFrame, fraction: float) -> str | None:
    """Why a stratified split of these ``(class, n)`` is impossible, or None."""
    facts = counts.agg(F.sum("n").alias("rows"), F.min("n").alias("least"), F.count(F.lit(1)).alias("classes")).first()
    rows, least, classes = facts["rows"] or 0, facts["least"] or 0, facts["classes"]
    test = math.ceil(rows * fraction)
    if least >= 2 and classes <= min(test, rows - test):
        return None
    return f"stratification skipped: smallest class {least} (needs 2), classes {classes}, test rows {test}, train rows {rows - test}"


def stratified_split(
    df: DataFrame, target: str, key: Sequence[str], fraction: float = 0.2, seed: int | None = 42
) -> tuple[DataFrame, str | None]:
    """``random_split`` keeping class shares; falls back to the plain split with a warning.

    Any number of classes: sizes and cut keys are tables, and rows without a class are training rows.
    """
    counts = class_table(df, target)
    problem = stratification_problem(counts, fraction)
    if problem:
        return random_split(df, key, fraction, seed), problem
    ordered, order = with_order(df, key, seed)
    sizes = stratified_sizes(counts, fraction).select(F.col("class").alias("group"), F.lit(PART).alias("label"), "k")
    cuts = cuts_by_group(ordered, target, order, sizes, df.count())
    joined, before = within_cuts(ordered, target, order, cuts)
    return joined.select(*[q(c) for c in df.columns if c != PART], before(PART).alias(PART)), None


def _time_order(df: DataFrame, time: str, key: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Columns in time order, ties by key; rows without a time come last."""
    at = F.unix_micros(q(time).cast("timestamp"))
    ordered, rest = with_order(df.withColumns({"__t0": at.isNull(), "__t1": at}), key, None)
    return ordered, ["__t0", "__t1", *rest]


def chronological_split(df: DataFrame, key: Sequence[str], fraction: float = 0.2, time: str | None = None) -> DataFrame:
    """Add ``is_test``: the last ceil(rows x fraction) rows by the first date column, ties by key."""
    time = time or next(iter(datetime_columns(df)), None)
    if time is None:
        raise ValueError("a chronological split needs a date column")
    rows = df.count()
    ordered, order = _time_order(df, time, key)
    mark = first_k(ordered, order, rows - math.ceil(rows * fraction), rows)
    return ordered.withColumn(PART, ~mark).drop(*order)


def temporal_warning(df: DataFrame, chronological: bool) -> str | None:
    if datetime_columns(df) and not chronological:
        return "the table has date columns; a shuffled split may look better than it is, consider a chronological one"
    return None


def fold_count(rows: int, smallest_class: int | None = None, chronological: bool = False) -> int:
    """Number of folds: at most five, fewer for small classes or tables."""
    if chronological:
        return min(5, max(0, rows - 1))
    if smallest_class is not None and smallest_class >= 2:
        return min(5, smallest_class)
    return min(5, rows)


def add_folds(df: DataFrame, k: int, key: Sequence[str], seed: int | None = 42, stratify: str | None = None, name: str = "fold") -> DataFrame:
    """Add a fold number 0..k-1; sizes differ by at most one (within each class when stratified).

    Folds are consecutive in seeded order of a unique key, or in the key's own order without a seed. Classes may be
    many; rows without a class are in fold 0.
    """
    ordered, order = with_order(df, key, seed)
    if not stratify:
        rows = df.count()
        marks = first_ks(ordered, order, [rows * i // k for i in range(1, k)], rows)
        fold = total([(~m).cast("int") for m in marks])
        return ordered.withColumn(name, fold).drop(*order)
    ends = F.explode(F.array(*[F.struct(F.lit(str(i)).alias("label"), F.expr(f"n * {i} div {k}").alias("k")) for i in range(1, k)]))
    wanted = class_table(df, stratify).select(F.col("class").alias("group"), ends.alias("e")).select("group", "e.label", "e.k")
    joined, before = within_cuts(ordered, stratify, order, cuts_by_group(ordered, stratify, order, wanted, df.count()))
    fold = F.when(q(stratify).isNull(), 0).otherwise(total([(~before(str(i))).cast("int") for i in range(1, k)]))
    return joined.select(*[q(c) for c in df.columns if c != name], fold.alias(name))


def add_time_folds(df: DataFrame, k: int, key: Sequence[str], time: str | None = None, name: str = "fold") -> DataFrame:
    """Add time blocks: 0 is the first training block, 1..k are the blocks validated in turn on all before."""
    time = time or next(iter(datetime_columns(df)))
    rows = df.count()
    ordered, order = _time_order(df, time, key)
    size = rows // (k + 1)
    marks = first_ks(ordered, order, [rows - (k - i) * size for i in range(k)], rows)
    fold = total([(~m).cast("int") for m in marks])
    return ordered.withColumn(name, fold).drop(*order)
