"""Feature engineering: scaling, encoding, transforms, interactions, dependency scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import NULL_LEVEL, number, numeric_columns, q, total
from plumbline.functions.ranges import numbered, quantiles, task_rows
from plumbline.functions.wide import spread_lookup
from plumbline.operators.select import likely_ids

# Names that mark a target column.
TARGET_NAMES = ("churned", "churn", "target", "label", "is_churned")


def _medians(fit: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Fill value of each column; medians are only worked out for columns with gaps."""
    counts = fit.agg(F.count(F.lit(1)).alias("rows"), *[F.count(number(fit, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    rows = counts["rows"]
    gaps = [c for i, c in enumerate(columns) if counts[f"n{i}"] < rows]
    found = quantiles(fit, gaps, [0.5], rows=rows)
    return {c: found[c][0] if c in gaps and found[c][0] is not None else 0.0 for c in columns}


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard", fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``{c}_scaled`` (standard, minmax or robust); gaps take the median. Fitted on ``fit_on``."""
    if method not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown scaling {method!r}; choose standard, minmax or robust")
    fit = df if fit_on is None else fit_on
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    medians = _medians(fit, columns)
    filled = fit.select(*[F.coalesce(number(fit, c), F.lit(medians[c])).alias(c) for c in columns])
    if method == "robust":
        quarts = quantiles(filled, columns, [0.25, 0.5, 0.75])
        frame = {c: (quarts[c][1], quarts[c][2] - quarts[c][0]) for c in columns}
    else:
        low, width = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        facts = filled.agg(
            *[low(q(c)).alias(f"l{i}") for i, c in enumerate(columns)], *[width(q(c)).alias(f"w{i}") for i, c in enumerate(columns)]
        ).first()
        frame = {c: (facts[f"l{i}"], facts[f"w{i}"]) for i, c in enumerate(columns)}
    added = {}
    for c in columns:
        centre, spread = frame[c][0] or 0.0, frame[c][1] or 1.0
        added[f"{c}_scaled"] = (F.coalesce(number(df, c), F.lit(medians[c])) - F.lit(float(centre))) / F.lit(float(spread))
    return df.withColumns(added)


def _level(df: DataFrame, column: str) -> Column:
    return F.coalesce(q(column).cast("string"), F.lit(NULL_LEVEL))


def onehot_levels(df: DataFrame, column: str, most: int = 15) -> tuple[list[str], bool]:
    """Levels that get a column, in text order, and whether ``Other`` among them stands for a remainder: all levels,
    or the ``most`` frequent and ``Other``. A table may also have a level of that name, which is no remainder."""
    counts = df.groupBy(_level(df, column).alias("level")).agg(F.count(F.lit(1)).alias("cnt"))
    top = [r["level"] for r in counts.orderBy(F.col("cnt").desc(), "level").limit(most + 1).collect()]
    return (sorted(top), False) if len(top) <= most else (sorted({*top[:most], "Other"}), True)


def onehot(df: DataFrame, columns: Sequence[str], most: int = 15, fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``{c}_{level}`` 0/1 columns, the first level in text order left out."""
    fit = df if fit_on is None else fit_on
    added = {}
    for c in [c for c in columns if c in df.columns]:
        levels, remainder = onehot_levels(fit, c, most)
        cell = _level(df, c)
        if remainder:
            cell = F.when(cell.isin([v for v in levels if v != "Other"]), cell).otherwise("Other")
        for v in levels[1:]:
            added[f"{c}_{v}"] = (cell == v).cast("int")
    return df.withColumns(added) if added else df


def ordinal_codes(df: DataFrame, column: str) -> DataFrame:
    """``(level, code, cnt)``: codes from zero in text order."""
    counts = df.groupBy(_level(df, column).alias("level")).agg(F.count(F.lit(1)).alias("cnt"))
    size = df.agg(F.approx_count_distinct(_level(df, column))).first()[0]
    rows = int(size * 1.2) + 1
    return numbered(counts, [], ["level"], rows, "code").select("level", F.col("code").cast("double").alias("code"), "cnt")


def ordinal(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Add ``{c}_encoded``; levels not in the fitted table get -1."""
    fit = df if fit_on is None else fit_on
    out = df
    rows = fit.count()
    for c in [c for c in columns if c in df.columns]:
        codes = ordinal_codes(fit, c)
        heavy: list[str] = []
        if rows > task_rows(df):
            heavy = [r["level"] for r in codes.filter(F.col("cnt") > rows / 200).select("level").collect()]
        table = codes.select(F.col("level").alias("__level"), F.col("code").alias(f"{c}_encoded"))
        rest = F.xxhash64(*[q(o) for o in df.columns])
        keyed = out.withColumn("__level", _level(out, c))
        joined = spread_lookup(keyed, "__level", table, heavy, rest).drop("__level")
        out = joined.withColumn(f"{c}_encoded", F.coalesce(q(f"{c}_encoded"), F.lit(-1.0)))
    return out.select(*[q(c) for c in df.columns], *[q(c) for c in out.columns if c not in df.columns])


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson transform for a given lambda."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    two = 2.0 - lam
    down = -F.log1p(-x) if abs(two) < 1e-12 else -(F.pow(1 - x, F.lit(two)) - 1) / two
    return F.when(x >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str], low: float = -4.0, high: float = 4.0, rounds: int = 5) -> dict[str, float]:
    """Most likely lambda per column. Every round scores a grid of lambdas for all columns in one
    aggregation and then narrows the grid around the best."""
    grids = {c: (low, high) for c in columns}
    best: dict[str, float] = dict.fromkeys(columns, 1.0)
    steps = 16
    for _ in range(rounds):
        points = {c: [a + (b - a) * i / steps for i in range(steps + 1)] for c, (a, b) in grids.items()}
        aggs = [F.count(q(c)).alias(f"n{k}") for k, c in enumerate(columns)]
        for k, c in enumerate(columns):
            x = q(c)
            aggs.append(F.sum(F.signum(x) * F.log1p(F.abs(x))).alias(f"s{k}"))
            aggs += [F.var_pop(yeo_johnson(x, lam)).alias(f"v{k}_{i}") for i, lam in enumerate(points[c])]
        row = df.agg(*aggs).first()
        for k, c in enumerate(columns):
            n, s = row[f"n{k}"], row[f"s{k}"]
            scores = []
            for i, lam in enumerate(points[c]):
                v = row[f"v{k}_{i}"]
                usable = v is not None and v > 0 and math.isfinite(v)
                scores.append((-n / 2 * math.log(v) + (lam - 1) * s) if usable else float("-inf"))
            top = max(range(len(scores)), key=scores.__getitem__)
            if scores[top] == float("-inf"):
                continue
            best[c] = points[c][top]
            width = (grids[c][1] - grids[c][0]) / steps
            grids[c] = (best[c] - width, best[c] + width)
    return best


def power_transform(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "log1p",
    fit_on: DataFrame | None = None,
    lambdas: dict[str, float] | None = None,
) -> DataFrame:
    """Add ``{c}_log1p``, ``{c}_sqrt`` or ``{c}_yeojohnson``; gaps take the median.

    log1p and sqrt shift columns with negative values by their minimum; Yeo-Johnson output is standardised.
    """
    if method not in ("log1p", "sqrt", "yeo-johnson"):
        raise ValueError(f"unknown transform {method!r}; choose log1p, sqrt or yeo-johnson")
    fit = df if fit_on is None else fit_on
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    medians = _medians(fit, columns)

    def fill(frame, c):
        return F.coalesce(number(frame, c), F.lit(medians[c]))

    filled = fit.select(*[fill(fit, c).alias(c) for c in columns])
    added = {}
    if method == "yeo-johnson":
        lambdas = lambdas or fit_yeo_johnson(filled, columns)
        facts = filled.agg(
            *[F.avg(yeo_johnson(q(c), lambdas[c])).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.stddev_pop(yeo_johnson(q(c), lambdas[c])).alias(f"s{i}") for i, c in enumerate(columns)],
        ).first()
        for i, c in enumerate(columns):
            spread = facts[f"s{i}"] or 1.0
            added[f"{c}_yeojohnson"] = (yeo_johnson(fill(df, c), lambdas[c]) - F.lit(facts[f"m{i}"] or 0.0)) / F.lit(spread)
        return df.withColumns(added)
    lows = filled.agg(*[F.min(q(c)).alias(f"l{i}") for i, c in enumerate(columns)]).first()
    for i, c in enumerate(columns):
        shift = abs(lows[f"l{i}"]) if (lows[f"l{i}"] or 0.0) < 0 else 0.0
        moved = fill(df, c) + F.lit(float(shift))
        added[f"{c}_{method}"] = F.log1p(moved) if method == "log1p" else F.sqrt(moved)
    return df.withColumns(added)


def interaction(df: DataFrame, a: str, b: str, op: str) -> DataFrame:
    """Add the product, ratio, difference or sum of two columns; an undefined ratio is zero."""
    for c in (a, b):
        if c not in df.columns:
            raise KeyError(f"column {c!r} not found")
    x, y = q(a), q(b)
    made = {
        "product": (f"{a}_x_{b}", lambda: x * y),
        "ratio": (f"{a}_div_{b}", lambda: F.coalesce(F.try_divide(number(df, a), number(df, b)), F.lit(0.0))),
        "difference": (f"{a}_minus_{b}", lambda: x - y),
        "sum": (f"{a}_plus_{b}", lambda: x + y),
    }
    if op not in made:
        raise ValueError(f"unknown operation {op!r}; choose from {', '.join(made)}")
    name, build = made[op]
    return df.withColumn(name, build())


def _binned(x: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points below the value."""
    return total([(x > F.lit(float(c))).cast("int") for c in cuts])


def mutual_information(df: DataFrame, target: str, features: Sequence[str], classification: bool, bins: int = 10) -> DataFrame:
    """``(feature, mutual_information)`` in nats between quantile bins of each feature and the target.

    A numeric target of a regression is binned the same way. Gaps in features take the median; rows
    without a target are left out. Only the contingency counts of all features are shuffled.
    """
    features = [c for c in features if c in df.columns and c != target]
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, mutual_information double")
    probs = [i / bins for i in range(1, bins)]
    medians = _medians(df, features)
    rows = df.filter(q(target).isNotNull()).select(
        *[F.coalesce(number(df, c), F.lit(medians[c])).alias(f"f{i}") for i, c in enumerate(features)],
        (q(target).cast("string") if classification else number(df, target)).alias("y"),
    ).filter(F.col("y").isNotNull())
    names = [f"f{i}" for i in range(len(features))]
    binned = [*names] if classification else [*names, "y"]
    cuts = quantiles(rows, binned, probs)
    cuts = {c: sorted({v for v in cuts[c] if v is not None}) for c in binned}
    y = F.col("y") if classification else _binned(F.col("y"), cuts["y"]).cast("string")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), _binned(F.col(n), cuts[n]).alias("bin")) for n, c in zip(names, features)])
    table = rows.select(y.alias("y"), F.inline(cells)).groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("c"))
    # from here on: features x bins x target levels rows, totals by aggregation rather than windows
    by_bin = table.groupBy("feature", "bin").agg(F.sum("c").alias("cx"))
    by_y = table.groupBy("feature", "y").agg(F.sum("c").alias("cy"))
    by_all = table.groupBy("feature").agg(F.sum("c").alias("n"))
    full = table.join(by_bin, ["feature", "bin"]).join(by_y, ["feature", "y"]).join(F.broadcast(by_all), "feature")
    term = F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("cx") * F.col("cy")))
    scored = full.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(term)).alias("mutual_information"))
    return scored.orderBy(F.col("mutual_information").desc(), "feature")


def default_scaling_columns(df: DataFrame) -> list[str]:
    """Numeric columns worth scaling: not identifiers, not targets by name, more than two values."""
    ids = set(likely_ids(df))
    numbers = [c for c in numeric_columns(df) if c not in ids and c.lower() not in TARGET_NAMES]
    if not numbers:
        return []
    spans = df.agg(
        *[F.min(number(df, c)).alias(f"l{i}") for i, c in enumerate(numbers)], *[F.max(number(df, c)).alias(f"h{i}") for i, c in enumerate(numbers)]
    ).first()
    # more than two values exist when some value differs from both the smallest and the largest
    inner = df.agg(
        *[
            F.count_if((number(df, c) != F.lit(spans[f"l{i}"])) & (number(df, c) != F.lit(spans[f"h{i}"]))).alias(f"k{i}")
            for i, c in enumerate(numbers)
        ]
    ).first()
    return [c for i, c in enumerate(numbers) if inner[f"k{i}"]]
