"""Feature engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import features as fe
from plumbline.plans.registry import DIRTY, query, sql

_MED = "(SELECT median(c_acctbal) FROM dirty)"
_FILLED = f"WITH {DIRTY}, f AS (SELECT c_custkey, c_nationkey, coalesce(c_acctbal, {_MED}) AS x, c_acctbal FROM dirty)"


def _dirty(t):
    return t.dirty_customer().select("c_custkey", "c_nationkey", "c_acctbal")


def _scaled(expr):
    return sql(f"{_FILLED};;SELECT c_custkey, c_nationkey, c_acctbal, {expr} AS c_acctbal_scaled FROM f", "c_acctbal c_acctbal_scaled", "c_custkey c_nationkey")


@query("f1_standard_scale", _scaled("(x - (SELECT avg(x) FROM f)) / (SELECT stddev_pop(x) FROM f)"))
def _(t):
    return fe.scale(_dirty(t), ["c_acctbal"], "standard")


@query("f2_minmax_scale", _scaled("(x - (SELECT min(x) FROM f)) / (SELECT max(x) - min(x) FROM f)"))
def _(t):
    return fe.scale(_dirty(t), ["c_acctbal"], "minmax")


@query("f3_robust_scale", _scaled("(x - (SELECT median(x) FROM f)) / (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM f)"))
def _(t):
    return fe.scale(_dirty(t), ["c_acctbal"], "robust")


_SEGMENTS = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "f4_onehot",
    sql(
        "SELECT c_custkey, c_mktsegment, " + ", ".join(f"(c_mktsegment = '{s}')::BIGINT AS c_mktsegment_{s}" for s in _SEGMENTS) + " FROM customer",
        "",
        "c_custkey",
    ),
)
def _(t):
    return fe.onehot(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query(
    "f4_onehot_top_levels",
    sql(
        """WITH k AS (SELECT p_size::VARCHAR AS lv, row_number() OVER (ORDER BY count(*) DESC, p_size::VARCHAR) AS rk FROM part GROUP BY 1),
c AS (SELECT p_partkey, CASE WHEN rk <= 15 THEN lv ELSE 'Other' END AS lv FROM part JOIN k ON p_size::VARCHAR = lv),
n AS (SELECT lv, dense_rank() OVER (ORDER BY lv) AS code FROM (SELECT DISTINCT lv FROM c))
;;SELECT p_partkey, CASE WHEN code = 1 THEN 0 ELSE 1 END AS dummies_set, CASE WHEN code = 1 THEN 0 ELSE code - 1 END AS which FROM c JOIN n USING (lv)""",
        "",
        "p_partkey dummies_set which",
    ),
)
def _(t):
    wide = fe.onehot(t.part.select("p_partkey", "p_size"), ["p_size"])
    dummies = [c for c in wide.columns if c.startswith("p_size_")]
    total = sum((F.col(c) for c in dummies), F.lit(0))
    which = sum((F.col(c) * i for i, c in enumerate(dummies, 1)), F.lit(0))
    return wide.select("p_partkey", total.alias("dummies_set"), which.alias("which"))


@query(
    "f5_ordinal",
    sql(
        """WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part))
;;SELECT p_partkey, p.p_brand, code AS p_brand_encoded FROM part p JOIN k ON p.p_brand = k.p_brand""",
        "p_brand_encoded",
        "p_partkey",
    ),
)
def _(t):
    return fe.ordinal(t.part.select("p_partkey", "p_brand"), ["p_brand"])


@query(
    "f5_ordinal_unseen_levels",
    sql(
        """WITH k AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#7'))
;;SELECT p_partkey, p.p_brand, coalesce(code, -1) AS p_brand_encoded FROM part p LEFT JOIN k ON p.p_brand = k.p_brand""",
        "p_brand_encoded",
        "p_partkey",
    ),
)
def _(t):
    part = t.part.select("p_partkey", "p_brand")
    return fe.ordinal(part, ["p_brand"], fit_on=part.filter("p_brand <> 'Brand#7'"))


_SHIFT = "(SELECT CASE WHEN min(c_acctbal) < 0 THEN abs(min(c_acctbal)) ELSE 0 END FROM customer)"


def _moved(fn, name):
    return sql(f"SELECT c_custkey, c_acctbal, {fn} AS {name} FROM customer", f"c_acctbal {name}", "c_custkey")


@query("f6_log1p", _moved(f"ln(1 + c_acctbal + {_SHIFT})", "c_acctbal_log1p"))
def _(t):
    return fe.power_transform(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "log1p")


@query("f7_sqrt", _moved(f"sqrt(c_acctbal + {_SHIFT})", "c_acctbal_sqrt"))
def _(t):
    return fe.power_transform(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "sqrt")


@query(
    "f8_yeo_johnson_fixed_lambda",
    sql(
        """WITH y AS (SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5
 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END AS y FROM customer)
;;SELECT c_custkey, c_acctbal, (y - (SELECT avg(y) FROM y)) / (SELECT stddev_pop(y) FROM y) AS c_acctbal_yeojohnson FROM y""",
        "c_acctbal c_acctbal_yeojohnson",
        "c_custkey",
    ),
)
def _(t):
    return fe.power_transform(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "yeo-johnson", lambdas={"c_acctbal": 0.5})


@query("f8_yeo_johnson_fitted")
def _(t):
    return fe.power_transform(t.events.select("event_id", "value"), ["value"], "yeo-johnson")


def _pair(op, name, expr):
    @query(
        name,
        sql(f"SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, {expr} FROM lineitem", f"l_extendedprice l_discount {expr.split(' AS ')[-1]}", "l_orderkey l_linenumber"),
    )
    def _(t):
        return fe.interaction(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"), "l_extendedprice", "l_discount", op)


_pair("product", "f9_product", "l_extendedprice * l_discount AS l_extendedprice_x_l_discount")
_pair("ratio", "f10_ratio", "CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END AS l_extendedprice_div_l_discount")
_pair("difference", "f11_difference", "l_extendedprice - l_discount AS l_extendedprice_minus_l_discount")
_pair("sum", "f11_sum", "l_extendedprice + l_discount AS l_extendedprice_plus_l_discount")


def _mi_sql(features, target, table):
    cuts = ", ".join(f"list_distinct(quantile_cont({f}::DOUBLE, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS c_{f}" for f in features)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, list_sum(list_transform(c_{f}, lambda c: CASE WHEN {f}::DOUBLE > c THEN 1 ELSE 0 END)) AS bin, {target} AS y FROM {table}, cuts"
        for f in features
    )
    return f"""WITH cuts AS (SELECT {cuts} FROM {table}), r AS ({rows}),
t AS (SELECT feature, bin, y, count(*)::DOUBLE AS c FROM r GROUP BY ALL),
w AS (SELECT *, sum(c) OVER (PARTITION BY feature, bin) AS cx, sum(c) OVER (PARTITION BY feature, y) AS cy, sum(c) OVER (PARTITION BY feature) AS n FROM t)
;;SELECT feature, greatest(0, sum(c / n * ln(c * n / (cx * cy)))) AS mutual_information FROM w GROUP BY 1"""


@query("f12_mutual_information", sql(_mi_sql(("l_quantity", "l_extendedprice", "l_discount"), "l_returnflag", "lineitem"), "mutual_information"))
def _(t):
    return fe.mutual_information(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"], classification=True)


@query(
    "f12_mutual_information_regression",
    sql(
        _mi_sql(
            ("l_quantity", "l_discount", "l_tax"),
            "yb",
            """(SELECT l_quantity, l_discount, l_tax, list_sum(list_transform(yc, lambda c: CASE WHEN l_extendedprice > c THEN 1 ELSE 0 END)) AS yb
 FROM lineitem, (SELECT list_distinct(quantile_cont(l_extendedprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS yc FROM lineitem))""",
        ),
        "mutual_information",
    ),
)
def _(t):
    return fe.mutual_information(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], classification=False)


@query(
    "f13_default_scaling_columns",
    "SELECT c AS \"column\" FROM (VALUES ('quality_score'), ('n_chars')) v(c), (SELECT count(*) FROM documents)",
)
def _(t):
    d = t.documents.join(t.labels, "doc_id").select("doc_id", "n_chars", "quality", (F.col("n_chars") / 7.0).alias("quality_score"), F.col("toxic").alias("label"))
    names = fe.default_scaling_columns(d)
    return t.spark.createDataFrame([(n,) for n in names], "column string")


@query(
    "f4_onehot_level_other",
    sql(
        """SELECT c_custkey, (c_mktsegment = 'FURNITURE')::BIGINT AS "s_FURNITURE", (c_mktsegment = 'HOUSEHOLD')::BIGINT AS "s_HOUSEHOLD",
(c_mktsegment = 'BUILDING')::BIGINT AS "s_Other" FROM customer""",
        "",
        'c_custkey "s_FURNITURE" "s_HOUSEHOLD" "s_Other"',
    ),
)
def _(t):
    # one real level is named Other, and one level is new to the fitted table
    s = F.when(F.col("c_mktsegment") == "BUILDING", "Other").otherwise(F.col("c_mktsegment"))
    c = t.customer.select("c_custkey", s.alias("s"))
    return fe.onehot(c, ["s"], fit_on=c.filter("s <> 'MACHINERY'")).drop("s")
