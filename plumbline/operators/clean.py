"""Removing duplicates and filling or dropping missing cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from plumbline.functions.exprs import (
    all_of,
    any_of,
    datetime_columns,
    field_type,
    finite,
    free_name,
    numeric_columns,
    present,
    q,
    value_of,
)
from plumbline.functions.ranges import join_null_safe, quantiles, split_ranges
from plumbline.functions.wide import level_counts, top_of
from plumbline.operators.profile import hygiene_index

NUMERIC_STRATEGIES = ("mean", "median", "zero")
CATEGORICAL_STRATEGIES = ("mode", "unknown")
# found values that may be sent to every task
CARRY_BYTES = 64 << 20
DATETIME_STRATEGIES = ("ffill", "ffill_bfill", "none")


def _holds_map(kind: T.DataType) -> bool:
    """Whether cells of the type cannot be compared as they are, because maps or variants are somewhere in them."""
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def remove_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of equal rows; maps are equal if they hold the same entries in any order."""
    maps = [f.name for f in df.schema.fields if _holds_map(f.dataType)]
    if not maps:
        return df.dropDuplicates()
    marks = {free_name(f"__text_{i}", df.columns): value_of(df, c) for i, c in enumerate(maps)}
    keys = [c for c in df.columns if c not in maps] + list(marks)
    return df.withColumns(marks).dropDuplicates(keys).select(*[q(c) for c in df.columns])


def _numeric_fills(df: DataFrame, columns: Sequence[str], strategy: str, fit: DataFrame) -> dict[str, float]:
    """Fill value for each numeric column that has missing or infinite cells."""
    facts = fit.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(finite(fit, c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(finite(fit, c)).alias(f"a{i}") for i, c in enumerate(columns)],
    ).first()
    gaps = [(i, c) for i, c in enumerate(columns) if fit is not df or facts[f"n{i}"] < facts["rows"]]
    if strategy == "zero":
        return {c: 0.0 for _, c in gaps}
    if strategy == "mean":
        return {c: facts[f"a{i}"] or 0.0 for i, c in gaps}
    medians = quantiles(fit, [c for _, c in gaps], [0.5], value=finite, rows=facts["rows"])
    return {c: medians[c][0] or 0.0 for _, c in gaps}


def mode_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent level per column as text (ties: smallest)."""
    if not columns:
        return {}
    return {r["column"]: r["top"] for r in top_of(level_counts(df, columns)).collect()}


def fill_missing(
    df: DataFrame,
    numeric: str = "mean",
    categorical: str = "mode",
    datetime: str = "ffill",
    order_by: Sequence[str] = (),
    within: Sequence[str] = (),
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Fill missing cells by column type; fill values are learned on ``fit_on`` (default: the table itself).

    Date columns are filled in the order of ``order_by`` (which must tell rows apart) inside ``within``.
    """
    for name, allowed in ((numeric, NUMERIC_STRATEGIES), (categorical, CATEGORICAL_STRATEGIES), (datetime, DATETIME_STRATEGIES)):
        if name not in allowed:
            raise ValueError(f"unknown strategy {name!r}; choose from {', '.join(allowed)}")
    fit = df if fit_on is None else fit_on
    numbers = numeric_columns(df)
    times = datetime_columns(df)
    texts = [c for c in df.columns if c not in numbers and c not in times]
    fills = _numeric_fills(df, numbers, numeric, fit) if numbers else {}
    levels = mode_fills(fit, texts) if categorical == "mode" else {}
    out = []
    for c in df.columns:
        kind = field_type(df, c)
        if c in fills:
            whole = float(fills[c]).is_integer() and not isinstance(kind, (T.FloatType, T.DoubleType))
            filled = F.coalesce(finite(df, c), F.lit(float(fills[c])))
            out.append((filled.cast(kind) if whole else filled).alias(c))
        elif c in texts:
            level = F.lit(levels.get(c, "Unknown"))
            if isinstance(kind, T.StringType):
                out.append(F.coalesce(q(c), level).alias(c))
            elif isinstance(kind, T.BooleanType):
                known = levels.get(c)
                out.append((F.coalesce(q(c), F.lit(known == "true")) if known else F.coalesce(q(c).cast("string"), level)).alias(c))
            else:
                out.append(F.coalesce(value_of(df, c).cast("string"), level).alias(c))
        else:
            out.append(q(c))
    filled = df.select(*out)
    if datetime == "none" or not times or not order_by:
        if datetime != "none" and times and not order_by:
            gaps = df.agg(*[F.count_if(q(c).isNull()) for c in times]).first()
            if any(gaps):
                raise ValueError("name the row order (order_by) to fill date columns forward")
        return filled
    return forward_fill(filled, times, order_by, within, back=datetime == "ffill_bfill")


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    within: Sequence[str] = (),
    back: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Carry the last value forward in row order (then the next one back with ``back``).

    Only key, order and the filled columns are sorted, in ranges of the row order; the last and first value of each
    range travel between them, so neither a missing nor a hot ``within`` key puts everything on one task. What was
    found for rows with gaps then goes to these rows: sent to where they are if it is at most ``CARRY_BYTES``, else
    joined with them; rows without gaps stay. Rows of equal key and order share what any of them knows, so the order
    should tell rows apart.
    """
    gap = any_of([q(c).isNull() for c in columns])
    texts = [c for c in columns if isinstance(field_type(df, c), (T.StringType, T.BinaryType))]
    keys = [q(k).alias(f"k{i}") for i, k in enumerate(within)]
    order = [q(o).alias(f"o{i}") for i, o in enumerate(order_by)]
    texts += [c for c in [*within, *order_by] if isinstance(field_type(df, c), (T.StringType, T.BinaryType))]
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(gap).alias("gaps"), *[F.max(F.octet_length(q(c))).alias(f"w{i}") for i, c in enumerate(texts)]
    ).first()
    if not facts["gaps"]:
        return df
    moved = df.select(*keys, *order, *[q(c).alias(f"v{i}") for i, c in enumerate(columns)])
    names, sort, ids = [f"k{i}" for i in range(len(keys))], [f"o{i}" for i in range(len(order))], range(len(columns))
    ranged, split = split_ranges(moved, [*names, *sort], facts["rows"] if rows is None else rows)
    group = Window.partitionBy(*names, "__range")
    # ranges of values, so that rows of equal order see each other; backwards is a second order, as a frame that
    # ends with the group would be summed anew for every row
    ahead = group.orderBy(*[F.col(o).asc() for o in sort]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = ranged.withColumns({f"p{i}": F.last(f"v{i}", ignorenulls=True).over(ahead) for i in ids})
    sources = {i: [f"v{i}", f"p{i}"] for i in ids}
    if back:
        behind = group.orderBy(*[F.col(o).desc() for o in sort]).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        known = known.withColumns({f"n{i}": F.last(f"v{i}", ignorenulls=True).over(behind) for i in ids})
    if split:
        # at most one row per key and range
        at = F.struct(*sort)
        edge = ranged.groupBy(*names, "__range").agg(
            *[F.max_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), at)).alias(f"last{i}") for i in ids],
            *[F.min_by(f"v{i}", F.when(F.col(f"v{i}").isNotNull(), at)).alias(f"first{i}") for i in ids],
        )
        over = Window.partitionBy(*names)
        earlier = over.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        later = over.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
        edge = edge.select(
            *names,
            "__range",
            *[F.last(f"last{i}", ignorenulls=True).over(earlier).alias(f"in{i}") for i in ids],
            *[F.last(f"first{i}", ignorenulls=True).over(later).alias(f"out{i}") for i in ids],
        )
        known = join_null_safe(known, edge, [*names, "__range"])
        sources = {i: [*s, f"in{i}"] for i, s in sources.items()}
    if back:
        sources = {i: [*s, f"n{i}", *([f"out{i}"] if split else [])] for i, s in sources.items()}
    fills = {i: F.coalesce(*s) for i, s in sources.items()}
    places = {c: n for n, c in [*zip(names, within, strict=True), *zip(sort, order_by, strict=True)]}
    if set(df.columns) <= {*places, *columns}:
        at = {**places, **{c: fills[i] for i, c in enumerate(columns)}}
        return known.select(*[(F.col(at[c]) if isinstance(at[c], str) else at[c]).alias(c) for c in df.columns])
    # one row per key and order with a gap
    peers = group.orderBy(*sort)
    gaps = any_of([F.col(f"v{i}").isNull() for i in ids])
    known = known.withColumns(
        {"gap": F.max(gaps).over(peers.rangeBetween(Window.currentRow, Window.currentRow)), "nth": F.row_number().over(peers) - F.rank().over(peers)}
    )
    found = known.filter(F.col("gap") & (F.col("nth") == 0)).select(*names, *sort, *[F.coalesce(*s[1:]).alias(f"f{i}") for i, s in sources.items()])
    nested = any(isinstance(field_type(df, c), (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for c in columns)
    width = sum(facts[f"w{i}"] or 0 for i in range(len(texts))) + 16 * (len(within) + len(order_by) + len(columns))
    few = not nested and facts["gaps"] * width <= CARRY_BYTES
    found = found.withColumnsRenamed({**{n: f"__k_{n}" for n in [*names, *sort]}, **{f"f{i}": f"__f_{i}" for i in ids}})
    on = all_of([q(c).eqNullSafe(F.col(f"__k_{n}")) for n, c in [*zip(names, within, strict=True), *zip(sort, order_by, strict=True)]])
    filled = [F.coalesce(q(c), F.col(f"__f_{columns.index(c)}")).alias(c) if c in columns else q(c) for c in df.columns]
    if few:
        return df.join(F.broadcast(found), on, "left").select(*filled)
    return df.filter(gap).join(found, on, "left").select(*filled).unionByName(df.filter(~gap))


def complete_rows(df: DataFrame) -> DataFrame:
    return df.filter(all_of([present(df, c) for c in df.columns]))


def drop_sparse_columns(df: DataFrame, threshold: float) -> DataFrame:
    """Keep columns whose filled cells reach ``int((1 - threshold) * rows)``."""
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(present(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    ).first()
    need = int((1.0 - threshold) * facts["rows"])
    return df.select(*[q(c) for i, c in enumerate(df.columns) if facts[f"n{i}"] >= need])


def drop_missing(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """Complete rows, after dropping sparse columns when a threshold is given."""
    return complete_rows(df if threshold is None else drop_sparse_columns(df, threshold))


# The cleaning strategies a recipe may name.
RECIPES = {
    "keep": None,
    "mean_mode": ("mean", "mode"),
    "median_mode": ("median", "mode"),
    "zero_unknown": ("zero", "unknown"),
    "drop_rows": "drop",
}


def clean(df: DataFrame, dedupe: bool = True, recipe: str = "mean_mode", order_by: Sequence[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """Remove duplicates, then apply one recipe."""
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe {recipe!r}; choose from {', '.join(RECIPES)}")
    out = remove_duplicates(df) if dedupe else df
    plan = RECIPES[recipe]
    if plan is None:
        return out
    if plan == "drop":
        return complete_rows(out)
    datetime = "ffill" if order_by else "none"
    return fill_missing(out, plan[0], plan[1], datetime, order_by, within)


def cleaning_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(stage, rows, duplicate_rows, missing_cells)`` before and after cleaning."""
    parts = []
    for stage, df in (("before", before), ("after", after)):
        facts = hygiene_index(df)
        parts.append(facts.select(F.lit(stage).alias("stage"), "rows", "duplicate_rows", "missing_cells"))
    return parts[0].unionByName(parts[1])
