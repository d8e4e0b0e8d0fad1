"""Audit report queries, one per report table."""

from __future__ import annotations


from plumbline.operators import report as rp
from plumbline.operators.charts import histograms
from plumbline.operators.privacy import MASK
from plumbline.operators.stats import correlation_insights, describe, pearson_pairs
from plumbline.plans.charting import histogram_sql
from plumbline.plans.profiling import _flags_sql
from plumbline.plans.registry import DIRTY, query, sql, union_sql
from plumbline.plans.statistics import _RELATED, _related, moments_sql, pearson_sql, related, tukey_sql

TABLES = {"customer": (5, 3), "orders": (6, 3), "lineitem": (11, 8), "part": (6, 3), "supplier": (4, 3), "events": (6, 3)}


def _summary(table, columns, numeric, gaps="0"):
    return f"""SELECT '{table}' AS dataset, count(*) AS "rows", {columns} AS "columns", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) AS duplicate_rows,
 {gaps} AS missing_cells, {numeric} AS numeric_columns, {columns - numeric} AS categorical_columns,
 (({columns} * count(*) - {gaps}) * 100.0 / ({columns} * count(*)) + (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})) * 100.0 / count(*)) / 2 AS hygiene_index FROM {table}"""


_COUNTS = '"rows" "columns" duplicate_rows missing_cells numeric_columns categorical_columns'


@query(
    "r1_summary",
    sql(
        f"WITH {DIRTY};;SELECT * EXCLUDE dataset FROM ({_summary('dirty', 4, 3, 'sum((c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT)')})",
        "hygiene_index",
        _COUNTS,
    ),
)
def _(t):
    return rp.report_summary(t.dirty_customer())


@query(
    "r1_numeric",
    sql(moments_sql("lineitem", ("l_quantity", "l_extendedprice", "l_tax")) .replace(" FROM lineitem", ", FALSE AS redacted FROM lineitem"), 'mean std "min" q1 median q3 "max" skew kurtosis', "n", digits=3),
    digits=3,
)
def _(t):
    return describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])


@query(
    "t15_r1_report_outliers",
    sql(
        f"""SELECT "column", q1, q3, iqr, lower_fence, upper_fence, outliers, outlier_pct FROM ({tukey_sql("lineitem", ("l_quantity", "l_extendedprice", "l_linenumber"), flat=True)})""",
        "q1 q3 iqr lower_fence upper_fence outlier_pct",
        "outliers",
    ),
)
def _(t):
    return rp.report_outliers(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"])


@query(
    "r1_categorical",
    sql(
        union_sql(
            f"SELECT '{c}' AS \"column\", count(*) AS distinct_values, "
            + ("'[REDACTED]'" if c == "l_linestatus" else f"(SELECT {c} FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)")
            + f" AS top_level, max(n) AS top_count, max(n) * 100.0 / sum(n) AS top_share FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1)"
            for c in ("l_returnflag", "l_linestatus")
        ),
        "top_share",
        "distinct_values top_count",
    ),
)
def _(t):
    return rp.report_categories(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_linestatus"])


@query(
    "r1_correlation",
    sql(
        f"""WITH p AS ({pearson_sql(_related("lineitem"), _RELATED)})
;;SELECT feature_a, feature_b, r, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
 CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM p WHERE abs(r) >= 0.3""",
        "r",
    ),
)
def _(t):
    return correlation_insights(pearson_pairs(related(t)))


@query(
    "r1_quality",
    sql(_flags_sql("orders", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}) + ";;SELECT * FROM f", "completeness_pct uniqueness_pct"),
)
def _(t):
    return rp.quality_flags(t.orders)


@query(
    "r1_sample",
    f"""SELECT CASE WHEN s_suppkey IS NOT NULL THEN CAST(s_suppkey AS VARCHAR) END AS s_suppkey, '{MASK}' AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey,
 substr(CAST(s_acctbal AS VARCHAR), 1, 28) AS s_acctbal FROM supplier ORDER BY supplier.s_suppkey LIMIT 8""",
)
def _(t):
    return rp.report_sample(t.supplier, ["s_name"], ["s_suppkey"])


@query(
    "r1_histograms",
    sql(
        union_sql(f"SELECT '{c}' AS \"column\", bin, low, high, \"count\" FROM ({histogram_sql('lineitem', c, 24)})" for c in ("l_extendedprice", "l_orderkey")),
        "low high",
        'bin "count"',
        digits=6,
    ),
    digits=6,
)
def _(t):
    return histograms(t.lineitem, ["l_extendedprice", "l_orderkey"])


_PARTS = {"summary": 1, "structure": 6, "numeric": 3, "outliers": 3, "categorical": 3, "quality": 6, "review": 1, "sample": 8, "histograms": 72, "boxes": 3, "heatmap": 9}


@query("r1_whole_report", sql(union_sql(f"SELECT '{n}' AS part, {k} AS n FROM orders GROUP BY 1" for n, k in _PARTS.items()), "", "n"))
def _(t):
    report = rp.audit_report(t.orders, key=["o_orderkey"])
    sizes = [(name, table.count()) for name, table in report.items() if name != "correlation"]
    return t.spark.createDataFrame(sizes, "part string, n long")


@query("r2_catalog_report", sql(union_sql(_summary(n, c, k) for n, (c, k) in TABLES.items()), "hygiene_index", _COUNTS))
def _(t):
    table, failed = rp.catalog_report({n: getattr(t, n) for n in TABLES})
    assert not failed, failed
    return table


