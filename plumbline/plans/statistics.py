"""Exploratory statistics queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import stats as st
from plumbline.plans.registry import DIRTY, query, sql, union_sql

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def moments_sql(table, columns):
    """count, mean, std, min, quartiles, max, corrected skew and kurtosis per column."""
    return union_sql(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS \"min\", "
        f"quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.5) AS median, quantile_cont({c}::DOUBLE, 0.75) AS q3, "
        f"max({c})::DOUBLE AS \"max\", skewness({c}) AS skew, kurtosis({c}) AS kurtosis FROM {table}"
        for c in columns
    )


@query(
    "t1_univariate",
    sql(
        f"""SELECT "column", mean, std, median, q3 - q1 AS iqr, skew, kurtosis FROM ({moments_sql("lineitem", NUMBERS)})""",
        "mean std median iqr skew kurtosis",
        digits=3,
    ),
    digits=3,
)
def _(t):
    return st.univariate(t.lineitem, NUMBERS)


@query(
    "t2_describe",
    sql(
        f"""WITH {DIRTY}
;;SELECT "column", n, CASE WHEN "column" <> 'c_custkey' THEN mean END AS mean, CASE WHEN "column" <> 'c_custkey' THEN std END AS std,
 CASE WHEN "column" <> 'c_custkey' THEN "min" END AS "min", CASE WHEN "column" <> 'c_custkey' THEN q1 END AS q1,
 CASE WHEN "column" <> 'c_custkey' THEN median END AS median, CASE WHEN "column" <> 'c_custkey' THEN q3 END AS q3,
 CASE WHEN "column" <> 'c_custkey' THEN "max" END AS "max", CASE WHEN "column" <> 'c_custkey' THEN skew END AS skew,
 CASE WHEN "column" <> 'c_custkey' THEN kurtosis END AS kurtosis, "column" = 'c_custkey' AS redacted
 FROM ({moments_sql("dirty", ("c_custkey", "c_nationkey", "c_acctbal"))})""",
        'mean std "min" q1 median q3 "max" skew kurtosis',
        "n",
        digits=3,
    ),
    digits=3,
)
def _(t):
    return st.describe(t.dirty_customer(), redact=["c_custkey"])


def _normality_sql(table, columns):
    base = union_sql(
        f"""SELECT '{c}' AS "column", count({c})::DOUBLE AS n, stddev_pop({c}) AS s, avg({c}) AS m FROM {table}""" for c in columns
    )
    long = union_sql(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM {table}" for c in columns)
    return f"""WITH base AS ({base}), long AS ({long}),
mom AS (SELECT l."column", any_value(n) AS n, avg(pow((x - m) / s, 3)) AS g1, avg(pow((x - m) / s, 4)) - 3 AS g2 FROM long l JOIN base b ON l."column" = b."column" GROUP BY 1),
a1 AS (SELECT *, g1 * sqrt((n+1)*(n+3)/(6*(n-2))) AS y,
  3*(n*n+27*n-70)*(n+1)*(n+3)/((n-2)*(n+5)*(n+7)*(n+9)) AS b2,
  (g2 + 3 - 3*(n-1)/(n+1)) / sqrt(24*n*(n-2)*(n-3)/((n+1)*(n+1)*(n+3)*(n+5))) AS x,
  6*(n*n-5*n+2)/((n+7)*(n+9)) * sqrt(6*(n+3)*(n+5)/(n*(n-2)*(n-3))) AS sb FROM mom),
a2 AS (SELECT *, sqrt(2*(b2-1)) - 1 AS w2, 6 + 8/sb*(2/sb + sqrt(1+4/(sb*sb))) AS a FROM a1),
a3 AS (SELECT *, y / sqrt(2/(w2-1)) AS r, 1 + x*sqrt(2/(a-4)) AS den FROM a2),
a4 AS (SELECT *, ln(r + sqrt(r*r+1)) / sqrt(0.5*ln(w2)) AS zs,
  (1 - 2/(9*a) - sign(den)*pow((1-2/a)/abs(den), 1.0/3)) / sqrt(2/(9*a)) AS zk FROM a3)
;;SELECT "column", n, zs*zs + zk*zk AS k2, exp(-(zs*zs+zk*zk)/2) AS p_value,
 CASE WHEN exp(-(zs*zs+zk*zk)/2) >= 0.05 THEN 'gaussian' ELSE 'non-gaussian' END AS verdict FROM a4"""


@query("t3_normality", sql(_normality_sql("customer", ("c_acctbal", "c_nationkey")), "k2 p_value", "n", digits=2), digits=2)
def _(t):
    return st.normality(t.customer, ["c_acctbal", "c_nationkey"])


@query(
    "t3_normality_of_a_sum",
    sql(
        _normality_sql("(SELECT l_orderkey, avg(l_quantity + 50 * l_linenumber / 7.0) AS total FROM lineitem GROUP BY 1)", ("total",)),
        "k2 p_value",
        "n",
        digits=2,
    ),
    digits=2,
)
def _(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.avg(F.col("l_quantity") + 50 * F.col("l_linenumber") / 7.0).alias("total"))
    return st.normality(per, ["total"])


@query(
    "t4_categorical_summary",
    sql(
        f"""WITH {DIRTY}, l AS (SELECT c_mktsegment AS v, count(*) AS c FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY 1),
e AS (SELECT l_returnflag AS v, count(*) AS c FROM lineitem GROUP BY 1)
;;SELECT 'c_mktsegment' AS "column", count(*) AS distinct_values, (SELECT v FROM l ORDER BY c DESC, v LIMIT 1) AS top_level,
 max(c) AS top_count, max(c) * 100.0 / sum(c) AS top_share FROM l""",
        "top_share",
        "distinct_values top_count",
    ),
)
def _(t):
    return st.categorical_summary(t.dirty_customer())


def pearson_sql(table, columns):
    return union_sql(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i} AS i, {j} AS j, count({a} + {b}) AS n, corr({a}, {b}) AS r FROM {table}"
        for (i, a), (j, b) in combinations(enumerate(columns), 2)
    )


@query("t5_pearson_pairs", sql(pearson_sql("lineitem", NUMBERS), "r", "i j n"))
def _(t):
    return st.pearson_pairs(t.lineitem, NUMBERS)


@query(
    "t5_pearson_pairs_with_gaps",
    sql(f"WITH {DIRTY};;{pearson_sql('dirty', ('c_custkey', 'c_nationkey', 'c_acctbal'))}", "r", "i j n"),
)
def _(t):
    return st.pearson_pairs(t.dirty_customer())


def _rank(c, table):
    return f"SELECT *, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c} FROM {table}"


def _spearman_sql(table, columns, ctes=""):
    parts = []
    for (i, a), (j, b) in combinations(enumerate(columns), 2):
        both = f"(SELECT {a}, {b} FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
        parts.append(
            f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i} AS i, {j} AS j, count(*) AS n, corr(r_{a}, r_{b}) AS r FROM "
            f"({_rank(b, f'({_rank(a, both)})')})"
        )
    return f"{ctes}{union_sql(parts)}"


@query("t6_spearman_pairs", sql(_spearman_sql("lineitem", NUMBERS), "r", "i j n"))
def _(t):
    return st.spearman_pairs(t.lineitem, NUMBERS)


@query(
    "t6_spearman_pairs_with_gaps",
    sql(_spearman_sql("dirty", ("c_custkey", "c_nationkey", "c_acctbal"), f"WITH {DIRTY};;"), "r", "i j n"),
)
def _(t):
    return st.spearman_pairs(t.dirty_customer())


_HOLED = [("l_extendedprice", "l_linenumber < 5"), ("l_discount", "l_linenumber < 5"), ("l_tax", "l_linenumber < 5"), ("l_suppkey", "l_linenumber < 5"),
          ("l_orderkey", "l_quantity >= 11"), ("l_partkey", "l_quantity >= 11"), ("l_linenumber", "l_quantity >= 11"), ("price_2", "l_quantity >= 11"),
          ("tax_2", "l_tax > 0"), ("net", "l_tax > 0"), ("l_quantity", "true")]
_HOLED_NAMES = {"price_2": "l_extendedprice", "tax_2": "l_tax", "net": "l_extendedprice * (1 - l_discount)"}
_HOLED_SQL = ", ".join(f"CASE WHEN {when} THEN CAST({_HOLED_NAMES.get(c, c)} AS DOUBLE) END AS {c}" for c, when in _HOLED)


@query(
    "t6_spearman_many_gaps",
    sql(_spearman_sql("holed", tuple(c for c, _ in _HOLED), f"WITH holed AS (SELECT {_HOLED_SQL} FROM lineitem);;"), "r", "i j n"),
)
def _(t):
    return st.spearman_pairs(t.lineitem.selectExpr(*_HOLED_SQL.split(", ")))


@query(
    "t7_strongest_pairs",
    sql(
        f"""WITH p AS ({pearson_sql("lineitem", NUMBERS)}),
w AS (SELECT *, row_number() OVER (ORDER BY r DESC, feature_a, feature_b) AS hi, row_number() OVER (ORDER BY r, feature_a, feature_b) AS lo FROM p)
;;SELECT 'positive' AS side, hi AS position, feature_a, feature_b, r FROM w WHERE hi <= 3
UNION ALL SELECT 'negative', lo, feature_a, feature_b, r FROM w WHERE lo <= 3""",
        "r",
        "position",
    ),
)
def _(t):
    return st.strongest_pairs(st.pearson_pairs(t.lineitem, NUMBERS))


def _related(table):
    return f"(SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * l_discount AS saved, l_tax FROM {table})"


_RELATED = ("l_quantity", "l_extendedprice", "net", "saved", "l_tax")


def related(t):
    li = t.lineitem
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    return li.select("l_quantity", "l_extendedprice", (price * (1 - disc)).alias("net"), (price * disc).alias("saved"), "l_tax")


@query(
    "t8_correlation_insights",
    sql(
        f"""WITH p AS ({pearson_sql(_related("lineitem"), _RELATED)})
;;SELECT feature_a, feature_b, r, CASE WHEN abs(r) >= 0.7 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate' ELSE 'Weak' END AS strength,
 CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM p WHERE abs(r) >= 0.3 ORDER BY abs(r) DESC, i, j LIMIT 12""",
        "r",
    ),
)
def _(t):
    return st.correlation_insights(st.pearson_pairs(related(t)))


@query(
    "t9_top_variance",
    sql(
        "SELECT * FROM (" + union_sql(f"SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM lineitem" for c in NUMBERS)
        + ') ORDER BY variance DESC, "column" LIMIT 3',
        "variance",
        digits=2,
    ),
    digits=2,
)
def _(t):
    return st.top_variance(t.lineitem, 3, NUMBERS)


def _vif_tail(r2):
    return f"""SELECT *, CASE WHEN 1 - r2 > 1e-6 THEN 1 / (1 - r2) ELSE 999.99 END AS vif,
 CASE WHEN r2 < 0.8 THEN 'Low' WHEN r2 < 0.9 THEN 'Moderate' ELSE 'High' END AS severity FROM ({r2})"""


@query(
    "t10_vif_two_columns",
    sql(
        _vif_tail(
            """SELECT 'l_quantity' AS "column", regr_r2(l_quantity, l_extendedprice) AS r2 FROM lineitem
 UNION ALL SELECT 'l_extendedprice', regr_r2(l_extendedprice, l_quantity) FROM lineitem"""
        ),
        "r2 vif",
    ),
)
def _(t):
    return st.vif(t.lineitem, ["l_quantity", "l_extendedprice"])


@query(
    "t10_vif_three_columns",
    sql(
        f"""WITH c AS (SELECT corr(l_quantity, net) AS ab, corr(l_quantity, saved) AS ac, corr(net, saved) AS bc FROM {_related("lineitem")})
;;{_vif_tail('''SELECT 'l_quantity' AS "column", (ab*ab + ac*ac - 2*ab*ac*bc) / (1 - bc*bc) AS r2 FROM c
 UNION ALL SELECT 'net', (ab*ab + bc*bc - 2*ab*ac*bc) / (1 - ac*ac) FROM c
 UNION ALL SELECT 'saved', (ac*ac + bc*bc - 2*ab*ac*bc) / (1 - ab*ab) FROM c''')}""",
        "r2 vif",
    ),
)
def _(t):
    return st.vif(related(t), ["l_quantity", "net", "saved"])


@query("t10_vif_all_columns", None)
def _(t):
    return st.vif(related(t))


def tukey_sql(table, columns, k=1.5, flat=False):
    """n, fences, counts per column."""
    return union_sql(
        f"""SELECT '{c}' AS "column", count(x) AS n, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q3 - q1) AS iqr,
 any_value(q1 - {k} * (q3 - q1)) AS lower_fence, any_value(q3 + {k} * (q3 - q1)) AS upper_fence,
 count(*) FILTER ((x < q1 - {k} * (q3 - q1) OR x > q3 + {k} * (q3 - q1)){' AND q3 > q1' if flat else ''}) AS outliers,
 count(*) FILTER ((x < q1 - {k} * (q3 - q1) OR x > q3 + {k} * (q3 - q1)){' AND q3 > q1' if flat else ''}) * 100.0 / count(x) AS outlier_pct,
 count(*) FILTER (s > 0 AND abs((x - m) / s) >= 3) AS z_outliers
 FROM (SELECT {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL),
 (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3, avg({c}) AS m, stddev_pop({c}) AS s FROM {table})"""
        for c in columns
    )


_SPREAD = ("value", "user_id", "squared")
_EVENTS = "(SELECT *, value * value AS squared FROM events)"


def _events(t):
    return t.events.withColumn("squared", F.col("value") * F.col("value"))


@query("t11_tukey_outliers", sql(tukey_sql(_EVENTS, _SPREAD), "q1 q3 iqr lower_fence upper_fence outlier_pct", "n outliers z_outliers"))
def _(t):
    return st.tukey_outliers(_events(t), _SPREAD)


@query("t11_tukey_outliers_wide_fence", sql(tukey_sql(_EVENTS, _SPREAD, 3.0), "q1 q3 iqr lower_fence upper_fence outlier_pct", "n outliers z_outliers"))
def _(t):
    return st.tukey_outliers(_events(t), _SPREAD, 3.0)


@query(
    "t12_outlier_rows",
    sql(
        """SELECT event_id, 'value' AS "column", value FROM events,
 (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
 WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
        "value",
        "event_id",
    ),
)
def _(t):
    return st.outlier_rows(t.events, ["value", "user_id"], ["event_id"])


@query(
    "t13_audit_outliers",
    sql(
        f"""SELECT "column", q1, q3, iqr, lower_fence, upper_fence, outliers, printf('%.2f%%', outlier_pct) AS outlier_share, z_outliers
 FROM ({tukey_sql(_EVENTS, _SPREAD)}) WHERE n >= 4""",
        "q1 q3 iqr lower_fence upper_fence",
        "outliers z_outliers",
        digits=3,
    ),
    digits=3,
)
def _(t):
    return st.audit_outliers(_events(t), _SPREAD)


def _shape_sql(table, columns):
    base = union_sql(f"SELECT '{c}' AS \"column\", avg({c}) AS m, stddev_pop({c}) AS s FROM {table}" for c in columns)
    long = union_sql(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS x FROM {table}" for c in columns)
    return f"""WITH k AS ({tukey_sql(table, columns)}), base AS ({base}), long AS ({long}),
g AS (SELECT l."column", avg(pow((x - m) / s, 3)) AS skew, avg(pow((x - m) / s, 4)) - 3 AS kurtosis FROM long l JOIN base b ON l."column" = b."column" GROUP BY 1)
;;SELECT k."column", q1, q3, iqr, lower_fence, upper_fence, outliers, outlier_pct, z_outliers, z_outliers * 100.0 / n AS z_pct, skew, kurtosis,
 CASE WHEN skew > 1 THEN 'Right-skewed' WHEN skew < -1 THEN 'Left-skewed' WHEN kurtosis > 2 THEN 'Heavy-tailed'
  WHEN kurtosis < -1 THEN 'Light-tailed' ELSE 'Symmetric' END AS shape FROM k JOIN g ON k."column" = g."column" """


@query(
    "t14_outlier_summary",
    sql(_shape_sql(_EVENTS, _SPREAD), "q1 q3 iqr lower_fence upper_fence outlier_pct z_pct skew kurtosis", "outliers z_outliers", digits=3),
    digits=3,
)
def _(t):
    return st.outlier_summary(_events(t), _SPREAD)


_ANOVA = """WITH g AS (SELECT c_mktsegment AS g, count(*) AS r, count(c_acctbal) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1 HAVING count(*) >= 3),
s AS (SELECT count(*) AS groups, sum(n) AS n, sum((n - 1) * v) AS within, (SELECT avg(c_acctbal) FROM customer) AS gm FROM g),
b AS (SELECT s.*, (SELECT sum(n * pow(m - (SELECT avg(c_acctbal) FROM customer), 2)) FROM g) AS between_ FROM s),
f AS (SELECT groups, n, (between_ / (groups - 1)) / (within / (n - groups)) AS f, (groups - 1)::DOUBLE AS d1, (n - groups)::DOUBLE AS d2 FROM b),
p AS (SELECT *, d2 / (d2 + d1 * f) AS x FROM f)"""


@query(
    "t16_anova",
    sql(
        # four numerator degrees of freedom: the tail of F is a short sum
        f"""{_ANOVA}, t AS (SELECT *, pow(x, d2 / 2) * (1 + d2 / 2 * (1 - x)) AS p_value FROM p)
;;SELECT groups, n, f, d1, d2, p_value, CASE WHEN p_value < 0.001 THEN '< 0.001' ELSE printf('%.4f', p_value) END AS p_text,
 CASE WHEN p_value < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM t WHERE d1 = 4""",
        "f d1 d2 p_value",
        "groups n",
    ),
)
def _(t):
    return st.anova(t.customer, "c_mktsegment", "c_acctbal")


@query(
    "t17_group_breakdown",
    sql(
        """SELECT p_brand AS "group", count(p_retailprice) AS "count", avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS std,
 median(p_retailprice) AS median FROM part GROUP BY 1 HAVING count(*) >= 3""",
        "mean std median",
        '"count"',
    ),
)
def _(t):
    return st.group_breakdown(t.part, "p_brand", "p_retailprice")


@query(
    "t5_pearson_with_infinity",
    sql(
        """SELECT 'a' AS feature_a, 'b' AS feature_b, 0 AS i, 1 AS j, count(*) AS n, CAST(NULL AS DOUBLE) AS r FROM lineitem
UNION ALL SELECT 'a', 'c', 0, 2, count(*), corr(l_quantity, l_extendedprice) FROM lineitem
UNION ALL SELECT 'b', 'c', 1, 2, count(*), CAST(NULL AS DOUBLE) FROM lineitem""",
        "r",
        "i j n",
    ),
)
def _(t):
    b = F.when(F.col("l_orderkey") % 100 == 0, float("inf")).otherwise(F.col("l_tax"))
    return st.pearson_pairs(t.lineitem.select(F.col("l_quantity").alias("a"), b.alias("b"), F.col("l_extendedprice").alias("c")))
