"""Drift queries: lineitem shipped before mid 1998 (A) against the rest (B), and variants of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift as dr
from plumbline.operators.select import likely_ids
from plumbline.plans.registry import query, sql, union_sql

# B is shifted on purpose: larger quantities, a changed flag mix, gaps in tax and a changed type
_COLS = "l_orderkey, l_quantity, l_extendedprice, l_discount, {tax} AS l_tax, {ln} AS l_linenumber, {flag} AS l_returnflag, l_linestatus"
SIDES = f"""a AS (SELECT {_COLS.format(tax="l_tax", ln="l_linenumber", flag="l_returnflag")} FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01'),
b AS (SELECT {_COLS.format(tax="CASE WHEN l_quantity > 40 THEN NULL ELSE l_tax END", ln="l_linenumber::BIGINT", flag="CASE WHEN l_quantity > 20 THEN 'R' ELSE l_returnflag END").replace("l_quantity,", "l_quantity * 1.25 AS l_quantity,", 1)}
 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')"""
NUMBERS = ("l_discount", "l_extendedprice", "l_linenumber", "l_orderkey", "l_quantity", "l_tax")
LEVELS = ("l_linestatus", "l_returnflag")
TYPES = {"l_linenumber": ("int", "bigint")}


def sides(t):
    li, ship, qty = t.lineitem, F.col("l_shipdate"), F.col("l_quantity")
    a = li.filter(ship < F.lit("1998-06-01").cast("timestamp_ntz")).select(
        "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    b = li.filter(ship >= F.lit("1998-06-01").cast("timestamp_ntz")).select(
        "l_orderkey",
        (qty * 1.25).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        F.when(qty > 40, None).otherwise(F.col("l_tax")).alias("l_tax"),
        F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
        F.when(qty > 20, "R").otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )
    return a, b


def _per_column(columns, fn):
    return union_sql(fn(c) for c in columns)


_MISSING = _per_column(
    (*NUMBERS, *LEVELS),
    lambda c: f"""SELECT '{c}' AS "column", (SELECT 100.0 * (count(*) - count({c})) / count(*) FROM a) AS missing_pct_a,
 (SELECT 100.0 * (count(*) - count({c})) / count(*) FROM b) AS missing_pct_b""",
)
_MOMENTS = _per_column(
    NUMBERS,
    lambda c: f"""SELECT '{c}' AS "column", (SELECT avg({c}) FROM a) AS mean_a, (SELECT stddev_samp({c}) FROM a) AS std_a,
 (SELECT avg({c}) FROM b) AS mean_b, (SELECT stddev_samp({c}) FROM b) AS std_b""",
)
_SHIFT = f"""SELECT *, mean_b - mean_a AS mean_delta, abs(mean_a) <= 1e-12 AS near_zero_baseline,
 (mean_b - mean_a) / abs(mean_a) * 100 AS mean_shift_pct, abs((mean_b - mean_a) / abs(mean_a) * 100) >= 10 AS mean_flagged,
 std_b / std_a >= 1.5 OR std_b / std_a <= 0.67 AS dispersion_flagged FROM ({_MOMENTS})"""
_KS = f"""ecdf AS ({_per_column(NUMBERS, lambda c: f'''SELECT '{c}' AS "column", x, sum(ia) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) AS ca, sum(ib) OVER (ORDER BY x RANGE UNBOUNDED PRECEDING) AS cb,
 sum(ia) OVER () AS na, sum(ib) OVER () AS nb FROM (SELECT {c}::DOUBLE AS x, 1 AS ia, 0 AS ib FROM a WHERE {c} IS NOT NULL UNION ALL SELECT {c}::DOUBLE, 0, 1 FROM b WHERE {c} IS NOT NULL)''')}),
d AS (SELECT "column", any_value(na) AS n_a, any_value(nb) AS n_b, max(abs(ca / na - cb / nb)) AS ks_stat FROM ecdf GROUP BY 1),
l AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * ks_stat AS lam FROM d),
ks AS (SELECT "column", n_a, n_b, ks_stat, CASE WHEN lam < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0,
 list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * j * j * lam * lam))))) END AS ks_p FROM l)"""
_BH = """r AS (SELECT *, row_number() OVER (ORDER BY ks_p, "column") AS rk, count(*) OVER () AS nt FROM ks),
bh AS (SELECT *, round(min(least(1.0, nt::DOUBLE / rk * ks_p)) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS ks_q FROM r)"""
_TVD = f"""tvd AS ({_per_column(LEVELS, lambda c: f'''SELECT '{c}' AS "column", (SELECT count({c}) FROM a) AS n_a, (SELECT count({c}) FROM b) AS n_b,
 (SELECT 0.5 * sum(abs(coalesce(pa, 0) - coalesce(pb, 0))) FROM (SELECT {c} AS v, count(*) * 1.0 / (SELECT count({c}) FROM a) AS pa FROM a WHERE {c} IS NOT NULL GROUP BY 1) x
  FULL JOIN (SELECT {c} AS v, count(*) * 1.0 / (SELECT count({c}) FROM b) AS pb FROM b WHERE {c} IS NOT NULL GROUP BY 1) y ON x.v = y.v) AS tvd''')})"""
_DISTINCT = _per_column(
    (*NUMBERS, *LEVELS),
    lambda c: f"""SELECT '{c}' AS "column", (SELECT count(DISTINCT {c}) FROM a) AS distinct_a, (SELECT count(DISTINCT {c}) FROM b) AS distinct_b""",
)
_TYPES = _per_column(
    (*NUMBERS, *LEVELS),
    lambda c: "SELECT '{}' AS \"column\", '{}' AS type_a, '{}' AS type_b".format(
        c, *TYPES.get(c, ("string",) * 2 if c in LEVELS else ("bigint",) * 2 if c == "l_orderkey" else ("double",) * 2)
    ),
)

_REPORT_CTES = f"""WITH {SIDES}, {_KS}, {_BH}, {_TVD}, miss AS ({_MISSING}), shift AS ({_SHIFT}), dist AS ({_DISTINCT}), ty AS ({_TYPES}),
report0 AS (SELECT ty."column", type_a, type_b, missing_pct_a, missing_pct_b, mean_a, mean_b, mean_shift_pct, coalesce(near_zero_baseline, FALSE) AS near_zero_baseline,
 std_a, std_b, ks_stat, ks_p, ks_q, tvd, distinct_a, distinct_b, concat_ws('; ',
 CASE WHEN type_a <> type_b THEN 'dtype ' || type_a || '→' || type_b END,
 CASE WHEN abs(missing_pct_b - missing_pct_a) >= 10 THEN printf('missingness Δ%+.1f%%', missing_pct_b - missing_pct_a) END,
 CASE WHEN mean_flagged THEN printf('mean shift %+.1f%%', mean_shift_pct) END,
 CASE WHEN dispersion_flagged THEN printf('dispersion shift (std %.2f→%.2f)', std_a, std_b) END,
 CASE WHEN tvd >= 0.2 THEN printf('categorical drift (TVD=%.3f)', round(tvd, 4)::DOUBLE) END,
 CASE WHEN ks_q < 0.05 THEN printf('distribution drift (KS stat=%.3f, p_adj=%.4f)', ks_stat, ks_q) END) AS fl
 FROM ty JOIN miss USING ("column") JOIN dist USING ("column") LEFT JOIN shift USING ("column") LEFT JOIN bh USING ("column") LEFT JOIN (SELECT "column", tvd FROM tvd) USING ("column")),
report AS (SELECT "column", type_a = type_b AS dtype_match, round(missing_pct_a, 1) AS missing_pct_a, round(missing_pct_b, 1) AS missing_pct_b,
 round(mean_a, 3) AS mean_a, round(mean_b, 3) AS mean_b, round(mean_shift_pct, 1) AS mean_shift_pct, near_zero_baseline, round(std_a, 3) AS std_a, round(std_b, 3) AS std_b,
 round(ks_stat, 4) AS ks_stat, round(ks_p, 4) AS ks_p, ks_q, round(tvd, 4) AS tvd, distinct_a, distinct_b, CASE WHEN fl = '' THEN 'OK' ELSE fl END AS flags FROM report0)"""


@query(
    "d1_drift_report",
    sql(
        f"{_REPORT_CTES}\n;;SELECT * FROM report",
        "missing_pct_a missing_pct_b mean_a mean_b mean_shift_pct std_a std_b ks_stat ks_p ks_q tvd",
        "distinct_a distinct_b",
    ),
)
def _(t):
    return dr.drift_report(*sides(t))


@query(
    "d2_missing_drift",
    sql(
        f"WITH {SIDES}, m AS ({_MISSING});;SELECT *, missing_pct_b - missing_pct_a AS delta, abs(missing_pct_b - missing_pct_a) >= 10 AS flagged FROM m",
        "missing_pct_a missing_pct_b delta",
    ),
)
def _(t):
    return dr.missing_drift(*sides(t))


@query(
    "d3_d4_mean_and_dispersion_shift",
    sql(f"WITH {SIDES};;{_SHIFT}", "mean_a std_a mean_b std_b mean_delta mean_shift_pct", digits=3),
    digits=3,
)
def _(t):
    return dr.mean_drift(*sides(t))


@query("d5_dtype_changes", f"SELECT *, type_a <> type_b AS changed FROM ({_TYPES})")
def _(t):
    return dr.dtype_changes(*sides(t))


@query("d6_ks_statistics", sql(f"WITH {SIDES}, {_KS};;SELECT * FROM ks", "ks_stat ks_p", "n_a n_b", digits=6), digits=6)
def _(t):
    return dr.ks_statistics(*sides(t))


@query("d7_category_shift", sql(f"WITH {SIDES}, {_TVD};;SELECT * FROM tvd", "tvd", "n_a n_b"))
def _(t):
    return dr.category_shift(*sides(t))


@query(
    "d8_d9_benjamini_hochberg",
    sql(f'WITH {SIDES}, {_KS}, {_BH};;SELECT "column", ks_stat, ks_p, ks_q, ks_q < 0.05 AS drifted FROM bh', "ks_stat ks_p ks_q"),
)
def _(t):
    tests = dr.benjamini_hochberg(dr.ks_statistics(*sides(t)))
    return tests.select("column", "ks_stat", "ks_p", "ks_q", (F.col("ks_q") < dr.ALPHA).alias("drifted"))


@query("d10_distinct_counts", sql(f"WITH {SIDES};;{_DISTINCT}", "", "distinct_a distinct_b"))
def _(t):
    return dr.distinct_counts(*sides(t))


@query("d11_flag_texts", f'{_REPORT_CTES.replace(";;", "")} SELECT "column", flags FROM report')
def _(t):
    return dr.drift_report(*sides(t)).select("column", "flags")


_VERDICT = """CASE WHEN flags = 'OK' THEN 'No significant change'
 WHEN mean_shift_pct IS NOT NULL THEN printf('Average shifted by %+.1f%%', mean_shift_pct + CAST(0 AS DOUBLE))
 WHEN tvd >= 0.2 THEN 'Category mix changed' WHEN contains(flags, 'distribution drift') THEN 'Value distribution shifted'
 WHEN contains(flags, 'missingness') THEN 'Missing rate changed' WHEN contains(flags, 'dtype') THEN 'Data type changed' ELSE 'Distribution shifted' END"""


@query(
    "d12_verdicts",
    f"""{_REPORT_CTES} SELECT "column", CASE WHEN "column" = 'l_orderkey' THEN 'ID / Key' WHEN flags = 'OK' THEN 'Stable' ELSE 'Drift detected' END AS status,
 CASE WHEN "column" = 'l_orderkey' THEN 'Unique ID / key (omitted from drift test)' ELSE {_VERDICT} END AS cause FROM report""",
)
def _(t):
    a, b = sides(t)
    ids = {"l_orderkey", *likely_ids(a), *likely_ids(b)}
    return dr.drift_verdicts(dr.drift_report(a, b), sorted(ids))


@query(
    "d13_pair_summary",
    sql(
        f"""{_REPORT_CTES}
;;SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS row_difference,
 8 AS matched_columns, 8 AS widest_columns, count(*) AS analytic_columns, count(*) FILTER (flags <> 'OK') AS drifted_columns FROM report""",
        "",
        "rows_a rows_b row_difference matched_columns widest_columns analytic_columns drifted_columns",
    ),
)
def _(t):
    return dr.pair_summary(*sides(t))


@query(
    "d14_unseen_levels",
    sql(
        """WITH tr AS (SELECT p_brand, p_type FROM part WHERE p_size <= 25 AND p_brand <> 'Brand#7' AND p_type <> 'PROMO'),
sc AS (SELECT p_brand, p_type FROM part WHERE p_size > 25)
;;SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS unseen_levels, count(*) AS unseen_rows FROM sc WHERE p_brand NOT IN (SELECT p_brand FROM tr)
UNION ALL SELECT 'p_type', count(DISTINCT p_type), count(*) FROM sc WHERE p_type NOT IN (SELECT p_type FROM tr)""",
        "",
        "unseen_levels unseen_rows",
    ),
)
def _(t):
    p = t.part
    train = p.filter("p_size <= 25 AND p_brand <> 'Brand#7' AND p_type <> 'PROMO'")
    return dr.unseen_levels(train, p.filter("p_size > 25"), ["p_brand", "p_type"])


@query(
    "d15_row_overlap",
    sql(
        """WITH tr AS (SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag = 'A'),
sc AS (SELECT l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag <> 'A'), m AS (SELECT DISTINCT * FROM tr)
;;SELECT count(*) AS "rows", count(m.l_tax) AS overlapping, count(m.l_tax) * 1.0 / count(*) AS overlap_share
 FROM sc LEFT JOIN m ON sc.l_quantity = m.l_quantity AND sc.l_discount = m.l_discount AND sc.l_tax = m.l_tax""",
        "overlap_share",
        '"rows" overlapping',
    ),
)
def _(t):
    li = t.lineitem
    cols = ["l_quantity", "l_discount", "l_tax"]
    return dr.row_overlap(li.filter("l_returnflag = 'A'").select(cols), li.filter("l_returnflag <> 'A'").select(cols))


@query("d15_training_overlap", "SELECT count(*) >= 0 AS same_content, 'overlap' AS verdict FROM customer")
def _(t):
    return dr.training_overlap(t.customer, t.customer.orderBy("c_name"))


@query(
    "d14_unseen_many_levels",
    sql(
        """WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey % 2 AS h FROM orders),
s AS (SELECT k FROM o WHERE h = 1 UNION ALL SELECT 'new ' || k FROM o WHERE h = 1 AND length(k) = 2)
;;SELECT 'k' AS "column", count(DISTINCT k) AS unseen_levels, count(*) AS unseen_rows FROM s WHERE k NOT IN (SELECT k FROM o WHERE h = 0)""",
        "",
        "unseen_levels unseen_rows",
    ),
)
def _(t):
    o = t.orders.select(F.col("o_custkey").cast("string").alias("k"), (F.col("o_orderkey") % 2).alias("h"))
    odd = o.filter("h = 1").select("k")
    fresh = odd.filter(F.length("k") == 2).select(F.concat(F.lit("new "), "k").alias("k"))
    return dr.unseen_levels(o.filter("h = 0").select("k"), odd.unionByName(fresh), ["k"])
