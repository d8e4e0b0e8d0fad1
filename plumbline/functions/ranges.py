"""Exact order-based work without putting a whole column on one task.

Two building blocks serve every operator that needs order:

* *cells* - a column is cut into cells of similar size. Totals per cell show which cells hold the
  wanted ranks, and only rows of those cells are shuffled and sorted. Where the cuts lie is estimated
  from a sample; the answer is exact whatever the estimate.
* *ranges* - rows get the number of the piece of the full sort key they fall into (so one hot value
  spreads out), and are worked on range by range with carried totals. Pieces are told by cut keys from a
  sample, compared as typed values, so a row's piece never changes and nothing has to be stored.

Inputs that one task can order by itself (``plumbline.task.rows``, default one million rows, compared
with a real count) take the plain single-window plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.functions.exprs import any_of, nested_columns, number, orderable, q
from plumbline.functions.wide import spread_lookup
from plumbline.session import materialize

TASK_ROWS = "plumbline.task.rows"
CELL_ROWS = "plumbline.cell.rows"
MAX_RANGES = 20_000
# sampled keys for each piece of a sort order
KEYS_PER_PIECE = 50
MAX_CELLS = 20_000
SMALL_ROWS = 20_000
# rows of a few numbers each that may be sent to every task
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SAMPLE_ROWS = 120_000
BRACKET = 0.006


def task_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(TASK_ROWS, "1000000"))


def parts_for(df: DataFrame, rows: int) -> int:
    """Number of ranges so that one range fits one task."""
    return max(1, min(MAX_RANGES, -(-rows // max(1, task_rows(df)))))


def cells_for(df: DataFrame, rows: int) -> int:
    """Number of cells of a column: one where a task can order the rows by itself, else finer than
    ranges, as cells are only counted at first."""
    if rows <= task_rows(df):
        return 1
    size = int(df.sparkSession.conf.get(CELL_ROWS, "100000"))
    return max(1, min(MAX_CELLS, -(-rows // max(1, min(size, task_rows(df))))))


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hint: bool = False
) -> DataFrame:
    """Equi-join in which a null key matches a null key; each key column appears once, from the left."""
    if not keys:
        raise ValueError("a join needs at least one key column")
    names = {k: f"__right_{i}" for i, k in enumerate(keys)}
    renamed = right.withColumnsRenamed(names)
    on = [q(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    joined = left.join(F.broadcast(renamed) if hint else renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def _numbered(cols: Sequence[str], **fields) -> Column:
    """One struct per column with its number and the given fields; numbers group faster than names."""
    return F.array(*[F.struct(F.lit(i).alias("column"), *[fn(i).alias(n) for n, fn in fields.items()]) for i in range(len(cols))])


def column_name(cols: Sequence[str]) -> Column:
    """The column name for a column number."""
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("column") + 1)


def named(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumn("column", column_name(cols))


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), value=number) -> DataFrame:
    """``(by..., column, value)`` without missing values; ``column`` is the position in ``cols``."""
    entries = _numbered(cols, value=lambda i: value(df, cols[i]))
    return df.select(*[q(b) for b in by], F.inline(entries)).filter(F.col("value").isNotNull())


def cell_bounds(df: DataFrame, cols: Sequence[str], parts: int, rows: int, value=number) -> dict[str, list[float]]:
    """Cut points per column; at most ``parts - 1`` numbers each.

    They come from a seeded sample of a few hundred rows per cell, as range partitioning does it: a
    sketch of every row would send one large summary per task to a single reducer. The sample only
    decides where cells begin, never what is counted.
    """
    probs = [i / parts for i in range(1, parts)]
    wanted = max(100_000, 200 * parts)
    few = df.select(*[value(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    if wanted < rows:
        few = few.sample(fraction=wanted / rows, seed=17)
    accuracy = max(10_000, 10 * parts)
    row = few.agg(*[F.percentile_approx(f"v{i}", probs, accuracy).alias(f"b{i}") for i in range(len(cols))]).first()
    return {c: sorted(set(row[f"b{i}"] or [])) for i, c in enumerate(cols)}


def long_cells(
    df: DataFrame, cols: Sequence[str], bounds: dict[str, list[float]], by: Sequence[str] = (), value=number
) -> DataFrame:
    """``(by..., column, cell, value)``: ``long_values`` plus the cell number of each value."""
    ids = range(len(cols))
    wide = df.select(*[q(b) for b in by], *[value(df, c).alias(f"__v{i}") for i, c in enumerate(cols)])
    wide = Bucketizer(
        splitsArray=[[float("-inf"), *bounds[c], float("inf")] for c in cols],
        inputCols=[f"__v{i}" for i in ids],
        outputCols=[f"__c{i}" for i in ids],
        handleInvalid="keep",
    ).transform(wide)
    entries = _numbered(cols, cell=lambda i: F.col(f"__c{i}").cast("int"), value=lambda i: F.col(f"__v{i}"))
    return wide.select(*[q(b) for b in by], F.inline(entries)).filter(F.col("value").isNotNull())


Rank = tuple[str, Callable[[Column], Column]]


def order_statistics(
    df: DataFrame,
    cols: Sequence[str],
    ranks: Sequence[Rank],
    by: Sequence[str] = (),
    value=number,
    rows: int | None = None,
) -> DataFrame:
    """Exact values at given 0-based ranks: ``(by..., column, label, n, rank, value)``.

    ``ranks`` pairs a label with a function from the number of values to the wanted rank.
    """
    rows = df.count() if rows is None else rows
    parts = cells_for(df, rows)
    keys = [*by, "column"]
    labels = F.array(
        *[F.struct(F.lit(name).alias("label"), fn(F.col("n")).cast("long").alias("rank")) for name, fn in ranks]
    )
    if parts == 1:
        counts = long_values(df, cols, by, value).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
        w = Window.partitionBy(*keys)
        upto = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.select("*", F.sum("cnt").over(w).alias("n"), F.sum("cnt").over(upto).alias("upto"))
        hits = counts.select("*", F.inline(labels))
        hits = hits.filter((F.col("rank") >= F.col("upto") - F.col("cnt")) & (F.col("rank") < F.col("upto")))
        return named(hits.select(*keys, "label", "n", "rank", "value"), cols)

    cells = long_cells(df, cols, cell_bounds(df, cols, parts, rows, value), by, value)
    w = Window.partitionBy(*keys)
    totals = cells.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    totals = totals.select(
        "*",
        F.sum("in_cell").over(w).alias("n"),
        F.coalesce(
            F.sum("in_cell").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
    )
    wanted = totals.select("*", F.inline(labels)).filter(
        (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("in_cell"))
    )
    cell_keys = [*keys, "cell"]
    # one row per rank, column and group: without groups few by construction, with groups counted first
    if by:
        wanted = materialize(wanted)
    few = not by or wanted.count() <= BROADCAST_ROWS
    hot = wanted.select(*cell_keys).distinct()
    picked = join_null_safe(cells, hot, cell_keys, "left_semi", hint=few)
    counts = picked.groupBy(*cell_keys, "value").agg(F.count(F.lit(1)).alias("cnt"))
    inside = Window.partitionBy(*cell_keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("upto", F.sum("cnt").over(inside))
    hits = join_null_safe(counts, wanted, cell_keys, hint=few)
    upto = F.col("before") + F.col("upto")
    hits = hits.filter((F.col("rank") >= upto - F.col("cnt")) & (F.col("rank") < upto))
    return named(hits.select(*[q(k) for k in keys], "label", "n", "rank", "value"), cols)


def quantile_table(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    value=number,
    rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles: ``(by..., column, quantiles array<double>)`` in the order of ``probs``."""
    rows = df.count() if rows is None else rows
    if not by:
        found = quantiles(df, cols, probs, value, rows)
        return df.sparkSession.createDataFrame([(c, found[c]) for c in cols], "column string, quantiles array<double>")
    if rows <= task_rows(df):
        # all groups together hold no more values than one task may
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"), F.percentile(value(df, c), F.lit(list(map(float, probs)))).alias("quantiles")
                )
                for c in cols
            ]
        )
        return df.groupBy(*[q(b) for b in by]).agg(entries.alias("__t")).select(*[q(b) for b in by], F.inline("__t"))
    return _quantiles_by_cells(df, cols, probs, by, value, rows)


def _quantiles_by_cells(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], value, rows: int) -> DataFrame:
    """``quantile_table`` from order statistics."""

    def low(p):
        return lambda n: F.floor(F.lit(float(p)) * (n - 1))

    def high(p):
        return lambda n: F.ceil(F.lit(float(p)) * (n - 1))

    ranks = [(f"{i}{side}", fn(p)) for i, p in enumerate(probs) for side, fn in (("l", low), ("h", high))]
    stats = order_statistics(df, cols, ranks, by, value, rows)

    def at(label):
        return F.max(F.when(F.col("label") == label, F.col("value")))

    def frac(p):
        pos = F.lit(float(p)) * (F.max("n") - 1)
        return pos - F.floor(pos)

    parts = [at(f"{i}l") + frac(p) * (at(f"{i}h") - at(f"{i}l")) for i, p in enumerate(probs)]
    return stats.groupBy(*[q(b) for b in by], "column").agg(F.array(*parts).alias("quantiles"))


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], value=number, rows: int | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns as plain numbers (columns x probs of them), for use as literals.

    A seeded sample gives a narrow bracket around each wanted value, one aggregation counts the rows
    below and inside the brackets, and only rows inside are looked at. A bracket that misses or holds
    too much is replaced by the cell search, so the sample never decides the result.
    """
    if not cols:
        return {}
    rows = df.count() if rows is None else rows
    if rows <= SMALL_ROWS:
        entries = [F.percentile(value(df, c), F.lit(list(map(float, probs)))).alias(f"q{i}") for i, c in enumerate(cols)]
        row = df.agg(*entries).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}

    if rows * 2 * BRACKET * len(cols) * len(probs) > max(task_rows(df), SMALL_ROWS):
        # so many rows that even the brackets are too full: search cells right away
        found = {r["column"]: list(r["quantiles"]) for r in _quantiles_by_cells(df, cols, probs, (), value, rows).collect()}
        return {c: found.get(c, [None] * len(probs)) for c in cols}

    ids = range(len(cols))
    wide = df.select(*[value(df, c).alias(f"v{i}") for i, c in enumerate(cols)])
    share = min(1.0, SAMPLE_ROWS / rows)
    drawn = wide if share >= 1.0 else wide.sample(fraction=share, seed=29)
    spans = [(max(0.0, p - BRACKET), min(1.0, p + BRACKET)) for p in probs]
    edges = drawn.agg(*[F.percentile_approx(f"v{i}", [e for s in spans for e in s], 3_000).alias(f"e{i}") for i in ids]).first()
    brackets = {
        (i, j): (edges[f"e{i}"][2 * j], edges[f"e{i}"][2 * j + 1]) for i in ids if edges[f"e{i}"] for j in range(len(probs))
    }
    tests = [F.count(f"v{i}").alias(f"n{i}") for i in ids]
    for (i, j), (lo, hi) in brackets.items():
        v = F.col(f"v{i}")
        tests.append(F.count_if(v < F.lit(lo)).alias(f"b{i}_{j}"))
        tests.append(F.count_if((v >= F.lit(lo)) & (v <= F.lit(hi))).alias(f"k{i}_{j}"))
    sums = wide.agg(*tests).first()

    wanted: dict[tuple[int, int], tuple[int, int, float]] = {}
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    missed: list[int] = []
    for i in ids:
        n = sums[f"n{i}"]
        for j, p in enumerate(probs):
            if n == 0:
                continue
            place = float(p) * (n - 1)
            low, high = math.floor(place), math.ceil(place)
            if (i, j) in brackets:
                (lo, hi), below, inside = brackets[i, j], sums[f"b{i}_{j}"], sums[f"k{i}_{j}"]
                if below <= low and high < below + inside:
                    if lo == hi:
                        out[cols[i]][j] = lo
                    else:
                        wanted[i, j] = (low - below, high - below, place - low)
                    continue
            missed.append(i)
    held = sum(sums[f"k{i}_{j}"] for i, j in wanted)
    if held > task_rows(df):
        missed += [i for i, _ in wanted]
        wanted = {}
    if wanted:
        marks = list(wanted)
        hits = F.array(
            *[
                F.when(
                    F.col(f"v{i}").between(F.lit(brackets[i, j][0]), F.lit(brackets[i, j][1])),
                    F.struct(F.lit(m).alias("mark"), F.col(f"v{i}").alias("value")),
                )
                for m, (i, j) in enumerate(marks)
            ]
        )
        near = any_of([F.col(f"v{i}").between(F.lit(brackets[i, j][0]), F.lit(brackets[i, j][1])) for i, j in marks])
        inside = wide.filter(near).select(F.inline(F.array_compact(hits))).groupBy("mark", "value").agg(F.count(F.lit(1)).alias("cnt"))
        run = Window.partitionBy("mark").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranks = F.array(*[F.array(F.lit(wanted[k][0]), F.lit(wanted[k][1])) for k in marks])
        spot = inside.withColumn("upto", F.sum("cnt").over(run)).withColumn("r", F.explode(F.element_at(ranks, F.col("mark") + 1)))
        found = spot.filter((F.col("r") >= F.col("upto") - F.col("cnt")) & (F.col("r") < F.col("upto"))).collect()
        value_at = {(r["mark"], r["r"]): r["value"] for r in found}
        for m, (i, j) in enumerate(marks):
            low, high, part = wanted[i, j]
            a, b = value_at[m, low], value_at[m, high]
            out[cols[i]][j] = a + part * (b - a)
    if missed:
        names = [f"v{i}" for i in sorted(set(missed))]
        table = _quantiles_by_cells(wide, names, probs, (), number, rows)
        for r in table.collect():
            out[cols[int(r["column"][1:])]] = list(r["quantiles"])
    return out


def _key(df: DataFrame, order: Sequence[str]) -> Column:
    return F.struct(*[orderable(df, c).alias(f"s{i}") for i, c in enumerate(order)])


def _key_literal(df: DataFrame, order: Sequence[str], values: Sequence) -> Column:
    kinds = df.select(_key(df, order).alias("k")).schema["k"].dataType
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, kinds, strict=True)])


def splitters(df: DataFrame, order: Sequence[str], parts: int, rows: int) -> list[tuple]:
    """At most ``parts - 1`` distinct keys, ascending, that cut the sort order into similar pieces.

    They come from a seeded sample of bounded size and only decide where pieces begin.
    """
    keys = df.select(_key(df, order).alias("k"))
    share = KEYS_PER_PIECE * parts / max(1, rows)
    few = keys.sample(fraction=share, seed=11) if share < 1.0 else keys
    tile = F.ntile(parts).over(Window.orderBy("k"))
    firsts = few.select("k", tile.alias("tile")).groupBy("tile").agg(F.min("k").alias("k")).filter("tile > 1")
    found = [tuple(r["k"]) for r in firsts.select("k").distinct().orderBy("k").collect()]
    return found or [tuple(r["k"]) for r in keys.limit(1).collect()]


def piece_of(df: DataFrame, order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """The piece of the sort order a row falls into: ``2 i`` between cuts, ``2 i - 1`` for the ``i``-th cut itself.

    A binary search in a constant array, so a thousand cuts cost ten comparisons a row.
    """
    if not cuts:
        return F.lit(0)
    edges = F.array(*[_key_literal(df, order, c) for c in cuts])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])

    def search(key):
        def step(low, width):
            return F.when(F.get(edges, low + width - 1) <= key, low + width).otherwise(low)

        def number_of(low):
            return low * 2 - F.coalesce((F.get(edges, low - 1) == key).cast("int"), F.lit(0))

        return F.aggregate(steps, F.lit(0), step, number_of)

    # bound to a variable, so that the key is made once a row
    return F.get(F.transform(F.array(_key(df, order)), search), F.lit(0))


def split_ranges(df: DataFrame, order: Sequence[str], rows: int) -> tuple[DataFrame, bool]:
    """Add ``__range``: consecutive pieces of the sort order, each fit for one task.

    ``order`` must end in a column that tells ties apart, then no hot value can fill a piece.
    """
    parts = parts_for(df, rows)
    if parts == 1:
        return df.withColumn("__range", F.lit(0)), False
    if nested := [c for c in order if c in nested_columns(df)]:
        raise ValueError(f"rows cannot be put in order by nested columns: {', '.join(nested)}")
    return df.withColumn("__range", piece_of(df, order, splitters(df, order, parts, rows))), True


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], measures: Sequence[str], rows: int
) -> DataFrame:
    """Add ``{measure}_upto``, the exact running total within ``keys`` in the given order."""
    ranged, split = split_ranges(df, [*keys, *order], rows)
    inside = (
        Window.partitionBy(*[q(k) for k in keys], "__range")
        .orderBy(*[q(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    local = ranged.select("*", *[F.sum(q(m)).over(inside).alias(f"{m}_upto") for m in measures])
    if not split:
        return local.drop("__range")
    before = Window.partitionBy(*[q(k) for k in keys]).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carry = ranged.groupBy(*[q(k) for k in keys], "__range").agg(*[F.sum(q(m)).alias(f"__s_{m}") for m in measures])
    carry = carry.select(
        *[q(k) for k in keys],
        "__range",
        *[F.coalesce(F.sum(q(f"__s_{m}")).over(before), F.lit(0)).alias(f"__carry_{m}") for m in measures],
    )
    joined = join_null_safe(local, carry, [*keys, "__range"])
    return joined.select(
        *[q(c) for c in df.columns], *[(q(f"{m}_upto") + q(f"__carry_{m}")).alias(f"{m}_upto") for m in measures]
    )


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, name: str = "__pos") -> DataFrame:
    """Add the 0-based position of each row within ``keys`` in the given total order."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    out = running_totals(one, keys, order, ["__one"], rows)
    return out.select(*[q(c) for c in df.columns], (F.col("__one_upto") - 1).alias(name))


def _fits_broadcast(table: DataFrame) -> bool:
    """Whether a table is small enough, by counted rows and bytes of its cells as text, to be sent to every task."""
    width = F.octet_length(F.concat_ws("", *[q(c).cast("string") for c in table.columns]))
    facts = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return facts["n"] <= BROADCAST_ROWS and facts["bytes"] <= BROADCAST_BYTES


def cuts_by_group(df: DataFrame, group: str, order: Sequence[str], wanted: DataFrame, rows: int) -> DataFrame:
    """``(group, label, cut)``: the key of the ``k``-th row of each group, for ``wanted`` of ``(group, label, k)``.

    Only group and order columns move, and the result has one row per wanted row with ``1 <= k <=`` the group's size,
    so neither the number of groups nor a hot group matters. Raises where a cut has a tie on both its sides.
    """
    g, names = q(group).cast("string"), [f"__o{i}" for i in range(len(order))]
    slim = df.select(g.alias("__g"), *[orderable(df, c).alias(n) for c, n in zip(order, names, strict=True)]).filter("__g IS NOT NULL")
    placed = numbered(slim, ["__g"], names, rows)
    cut = F.struct(*[q(n).alias(f"s{i}") for i, n in enumerate(names)]).alias("cut")
    asked = wanted.select(F.col("group").alias("__g"), "label", F.col("k").cast("long").alias("k"))
    edge = asked.select("__g", "label", "k", F.explode(F.array(F.col("k") - 1, F.col("k"))).alias("__pos"))
    few = _fits_broadcast(edge)
    met = placed.join(F.broadcast(edge) if few else edge, ["__g", "__pos"]).select("__g", "label", (F.col("__pos") < F.col("k")).alias("last"), cut)
    both = met.groupBy("__g", "label").agg(F.max_by("cut", F.when(F.col("last"), 1)).alias("cut"), F.max_by("cut", F.when(~F.col("last"), 1)).alias("next"))
    clear = F.assert_true(~F.coalesce(F.col("cut") == F.col("next"), F.lit(False)), F.lit("the order does not tell all rows apart; add a unique key column"))
    return both.filter("cut IS NOT NULL").select(F.col("__g").alias("group"), "label", F.when(clear.isNull(), F.col("cut")).alias("cut"))


def within_cuts(df: DataFrame, group: str, order: Sequence[str], cuts: DataFrame) -> tuple[DataFrame, Callable[[str], Column]]:
    """Rows with the cuts of their group, and a function from a label to "the row lies at or before that cut".

    The rows only move where there are more groups than one broadcast may hold; heavy groups are spread then.
    """
    g = "__cut_group"
    table = cuts.groupBy(F.col("group").alias(g)).agg(F.map_from_entries(F.collect_list(F.struct("label", "cut"))).alias("__cuts"))
    table = materialize(table)
    rows = df.withColumn(g, q(group).cast("string"))
    if _fits_broadcast(table):
        joined = rows.join(F.broadcast(table), g, "left")
    else:
        few = rows.select(g).sample(fraction=min(1.0, SAMPLE_ROWS / max(1, df.count())), seed=19).groupBy(g).count()
        heavy = [r[g] for r in few.filter(F.col("count") > SAMPLE_ROWS / 200).collect() if r[g] is not None]
        joined = spread_lookup(rows, g, table, heavy, F.xxhash64(*[q(c) for c in order]))
    key = _key(df, order)
    return joined.drop(g), lambda label: F.coalesce(key <= F.try_element_at("__cuts", F.lit(label)), F.lit(False))


def order_cuts(df: DataFrame, order: Sequence[str], ranks: Sequence[int], rows: int) -> dict[int, tuple[tuple, int]]:
    """For each 0-based rank of the sort order: the key found there, and how many rows have it or a smaller one.

    Keys are compared as typed values of any length, never turned into numbers. Pieces of the order are counted, and
    only pieces with a wanted rank are cut again, until one task can order what is left.
    """
    if not ranks:
        return {}
    if rows <= task_rows(df):
        counts = df.groupBy(_key(df, order).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
        spots = counts.withColumn("upto", upto).withColumn("rank", F.explode(F.array(*[F.lit(r).cast("long") for r in ranks])))
        hits = spots.filter((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))).collect()
        return {r["rank"]: (tuple(r["k"]), r["upto"]) for r in hits}
    cuts = splitters(df, order, min(1000, max(2, cells_for(df, rows))), rows)
    pieces = df.withColumn("__piece", piece_of(df, order, cuts))
    sizes = sorted((r["__piece"], r["n"]) for r in pieces.groupBy("__piece").agg(F.count(F.lit(1)).alias("n")).collect())
    found, before = {}, 0
    for piece, n in sizes:
        inside = [r for r in ranks if before <= r < before + n]
        if piece % 2:
            found.update({r: (cuts[piece // 2], before + n) for r in inside})
        elif inside:
            part = pieces.filter(F.col("__piece") == piece).drop("__piece")
            deeper = order_cuts(part, order, [r - before for r in inside], n)
            found.update({r + before: (key, upto + before) for r, (key, upto) in deeper.items()})
        before += n
    return found


def first_ks(df: DataFrame, order: Sequence[str], wanted: Sequence[int], rows: int | None = None) -> list[Column]:
    """For each ``k``: a condition true for exactly the first ``k`` rows of the table, nulls first."""
    rows = df.count() if rows is None else rows
    cuts = order_cuts(df, order, sorted({k - 1 for k in wanted if 0 < k < rows}), rows)
    if any(upto != rank + 1 for rank, (_, upto) in cuts.items()):
        raise ValueError("the order does not tell all rows apart; add a unique key column")
    return [_key(df, order) <= _key_literal(df, order, cuts[k - 1][0]) if 0 < k < rows else F.lit(k > 0) for k in wanted]


def first_k(df: DataFrame, order: Sequence[str], k: int, rows: int | None = None) -> Column:
    """A condition true for exactly the first ``k`` rows of the table."""
    return first_ks(df, order, [k], rows)[0]
