"""Queries for the tables behind charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import charts as ch
from plumbline.operators.profile import hygiene_band, hygiene_index
from plumbline.plans.registry import DIRTY, query, sql, union_sql


def capped_sql(table, column, most, name="level"):
    """A select of all rows with the column capped; ties by text, null first."""
    top = f"(SELECT {column} AS lv, row_number() OVER (ORDER BY count(*) DESC, {column} ASC NULLS FIRST) AS rk, count(*) OVER () AS levels FROM {table} GROUP BY 1)"
    return f"""SELECT s.*, CASE WHEN k.levels <= {most} OR k.rk <= {most} THEN s.{column} ELSE 'Other' END AS {name}
 FROM {table} s JOIN {top} k ON s.{column} IS NOT DISTINCT FROM k.lv"""


@query(
    "v1_cap_categories",
    sql(f"SELECT level, count(*) AS n FROM ({capped_sql('part', 'p_brand', 20)}) GROUP BY 1", "", "n"),
)
def _(t):
    capped = ch.cap_categories(t.part, "p_brand", 20)
    return capped.groupBy(F.col("p_brand").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "v1_cap_categories_with_null",
    sql(
        f"WITH {DIRTY}, c AS ({capped_sql('dirty', 'c_mktsegment', 3)});;SELECT level, count(*) AS n FROM c GROUP BY 1",
        "",
        "n",
    ),
)
def _(t):
    capped = ch.cap_categories(t.dirty_customer(), "c_mktsegment", 3)
    return capped.groupBy(F.col("c_mktsegment").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def histogram_sql(table, column, bins, hue="CAST(NULL AS VARCHAR)"):
    return f"""SELECT {hue} AS hue, CAST(least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS bin,
 any_value(lo + least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) * ((hi - lo) / {bins})) AS low,
 any_value(lo + (least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) + 1) * ((hi - lo) / {bins})) AS high, count(*) AS "count"
 FROM {table}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {table}) WHERE {column} IS NOT NULL GROUP BY 1, 2"""


@query("v2_histogram", sql(histogram_sql("lineitem", "l_extendedprice", 30), "low high", 'bin "count"'))
def _(t):
    return ch.histogram(t.lineitem, "l_extendedprice", 30)


@query(
    "v2_histogram_by_hue",
    sql(histogram_sql("events", "value", 24, "event_type"), "low high", 'bin "count"', digits=6),
    digits=6,
)
def _(t):
    return ch.histogram(t.events, "value", 24, "event_type")


_BOX = """WITH q AS (SELECT {x} AS x, {hue} AS hue, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3,
 count(v) AS n, min(v) AS "min", max(v) AS "max" FROM {src} WHERE v IS NOT NULL GROUP BY 1, 2)
;;SELECT q.x, q.hue, any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3, any_value(n) AS n, any_value("min") AS "min", any_value("max") AS "max",
 min(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_low,
 max(v) FILTER (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
 FROM {src} s JOIN q ON {x} IS NOT DISTINCT FROM q.x AND {hue} IS NOT DISTINCT FROM q.hue WHERE v IS NOT NULL GROUP BY 1, 2"""


@query(
    "v3_box_stats",
    sql(
        _BOX.format(src="(SELECT *, value AS v FROM events)", x="event_type", hue="CAST(NULL AS VARCHAR)"),
        'q1 median q3 "min" "max" whisker_low whisker_high',
        "n outliers",
    ),
)
def _(t):
    return ch.box_stats(t.events, "value", "event_type")


@query(
    "v3_box_stats_by_hue",
    sql(
        _BOX.format(src="(SELECT *, l_extendedprice AS v FROM lineitem)", x="l_returnflag", hue="l_linestatus"),
        'q1 median q3 "min" "max" whisker_low whisker_high',
        "n outliers",
    ),
)
def _(t):
    return ch.box_stats(t.lineitem, "l_extendedprice", "l_returnflag", "l_linestatus")


@query(
    "v4_violin_density",
    sql(
        f"""WITH h AS ({histogram_sql("events", "value", 30, "event_type")})
;;SELECT hue AS "group", bin, low, high, "count", "count" / (sum("count") OVER (PARTITION BY hue) * (high - low)) AS density FROM h""",
        "low high density",
        'bin "count"',
    ),
)
def _(t):
    return ch.violin_density(t.events, "value", "event_type")


@query(
    "v5_scatter_trend",
    sql(
        """SELECT l_returnflag AS hue, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
 regr_r2(l_extendedprice, l_quantity) AS r2 FROM lineitem GROUP BY 1 HAVING count(*) >= 2""",
        "slope intercept r2",
        "n",
        digits=3,
    ),
    digits=3,
)
def _(t):
    return ch.scatter_trend(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag")


@query(
    "v6_bubble_size_check",
    sql(
        """SELECT count(*) FILTER (c_acctbal < 0) = 0 AND count(c_acctbal) > 0 AS usable, count(*) FILTER (c_acctbal < 0) AS negative,
 count(c_acctbal) AS finite_values FROM customer""",
        "",
        "negative finite_values",
    ),
)
def _(t):
    return ch.bubble_size_check(t.customer, "c_acctbal")


_BAR_FUNCTIONS = {"Count": "count(*)", "Sum": "coalesce(sum(v), 0)", "Mean": "avg(v)", "Median": "median(v)", "Max": "max(v)", "Min": "min(v)"}


def _bar(agg):
    @query(
        f"v7_bar_{agg.lower()}",
        sql(
            f"""WITH p AS ({capped_sql("(SELECT p_size::VARCHAR AS sz, p_type, p_retailprice AS v FROM part)", "sz", 30, "x")})
;;SELECT x, p_type AS hue, {_BAR_FUNCTIONS[agg]} AS value FROM p GROUP BY 1, 2""",
            "value",
            digits=3,
        ),
        digits=3,
    )
    def _(t):
        return ch.bar_table(t.part, "p_size", "p_retailprice", agg, "p_type")


for _agg in _BAR_FUNCTIONS:
    _bar(_agg)


@query(
    "v8_composition",
    sql(
        """WITH g AS (SELECT p_size::VARCHAR AS lv, sum(p_retailprice) AS v FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY v DESC, lv) AS rk FROM g)
;;SELECT CASE WHEN rk <= 30 THEN lv ELSE 'Other' END AS level, sum(v) AS value, sum(v) / (SELECT sum(v) FROM g) AS share, rk > 30 AS is_other FROM r GROUP BY 1, 4""",
        "value share",
        digits=3,
    ),
    digits=3,
)
def _(t):
    return ch.composition(t.part, "p_size", "p_retailprice")


@query(
    "v8_composition_counts",
    sql(
        f"""WITH {DIRTY};;SELECT c_mktsegment AS level, count(*) AS value, count(*) * 1.0 / (SELECT count(*) FROM dirty) AS share, FALSE AS is_other FROM dirty GROUP BY 1""",
        "value share",
    ),
)
def _(t):
    return ch.composition(t.dirty_customer(), "c_mktsegment")


@query(
    "v9_line_series",
    sql(
        "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, o_totalprice AS y, o_orderstatus AS hue FROM orders ORDER BY o_orderdate, o_orderkey",
        "y",
    ),
)
def _(t):
    o = t.orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_totalprice", "o_orderstatus", "o_orderkey")
    series = ch.line_series(o, "day", "o_totalprice", "o_orderstatus", key=["o_orderkey"])
    return series


def envelope_sql(points, hue=None):
    part = "PARTITION BY hue" if hue else ""
    target = f"greatest(4, {points} // (SELECT count(DISTINCT {hue}) FROM events))" if hue else str(points)
    return f"""WITH s AS (SELECT event_id, ts, value, event_type, {hue or "'all'"} AS hue FROM events),
p AS (SELECT *, row_number() OVER ({part} ORDER BY ts, event_id) - 1 AS pos, count(*) OVER ({part}) AS n, {target} AS target FROM s),
b AS (SELECT *, CASE WHEN n <= target THEN pos ELSE ((pos + 1) * greatest(1, target // 4) - 1) // n END AS b FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY hue, b ORDER BY pos) AS first_, row_number() OVER (PARTITION BY hue, b ORDER BY pos DESC) AS last_,
 row_number() OVER (PARTITION BY hue, b ORDER BY coalesce(value, 0), pos) AS low_, row_number() OVER (PARTITION BY hue, b ORDER BY coalesce(value, 0) DESC, pos) AS high_ FROM b)
;;SELECT event_id, ts, value, event_type FROM k WHERE first_ = 1 OR last_ = 1 OR low_ = 1 OR high_ = 1"""


@query("v10_envelope_downsample", sql(envelope_sql(1000), "value", "event_id"))
def _(t):
    return ch.downsample(t.events, "ts", "value", 1000, key=["event_id"]).select("event_id", "ts", "value", "event_type")


@query("v10_envelope_downsample_by_hue", sql(envelope_sql(1000, "event_type"), "value", "event_id"))
def _(t):
    return ch.downsample(t.events, "ts", "value", 1000, "event_type", ["event_id"]).select("event_id", "ts", "value", "event_type")


# the five lineitem columns of largest variance at every scale
_WIDEST = ("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "v11_correlation_heatmap",
    sql(
        union_sql(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("1.0 AS r" if a == b else f"corr({a}, {b}) AS r FROM lineitem")
            for a in _WIDEST
            for b in _WIDEST
        ),
        "r",
        digits=3,
    ),
    digits=3,
)
def _(t):
    return ch.correlation_heatmap(t.lineitem, most=5)


@query(
    "v12_score_histogram",
    sql(
        "SELECT bin, low, high, \"count\" FROM (" + histogram_sql("(SELECT value / (value + 50) AS probability FROM events)", "probability", 25) + ")",
        "low high",
        'bin "count"',
    ),
)
def _(t):
    scored = t.events.select((F.col("value") / (F.col("value") + 50)).alias("probability"))
    return ch.score_histogram(scored)


@query(
    "v13_hygiene_bands",
    sql(
        f"""WITH {DIRTY}, s AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS k,
  sum((c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) AS gaps FROM dirty),
h AS (SELECT ((4 * n - gaps) * 100.0 / (4 * n) + k * 100.0 / n) / 2 AS hygiene_index FROM s)
;;SELECT hygiene_index, CASE WHEN hygiene_index < 50 THEN 'poor' WHEN hygiene_index < 80 THEN 'fair' ELSE 'good' END AS band FROM h""",
        "hygiene_index",
    ),
)
def _(t):
    return hygiene_index(t.dirty_customer()).select("hygiene_index", hygiene_band().alias("band"))
