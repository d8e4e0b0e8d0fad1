"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clean as cl
from plumbline.plans.registry import DIRTY, query, sql

_MODE = """(SELECT c_mktsegment FROM dirty WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


def _filled(number, text, table="dirty"):
    return sql(
        f"""WITH {DIRTY}
;;SELECT c_custkey, c_nationkey, coalesce(c_acctbal, {number}) AS c_acctbal, coalesce(c_mktsegment, {text}) AS c_mktsegment FROM {table}""",
        "c_acctbal",
        "c_custkey c_nationkey",
    )


@query("c1_remove_duplicates", sql(f"WITH {DIRTY};;SELECT DISTINCT * FROM dirty", "c_acctbal", "c_custkey c_nationkey"))
def _(t):
    return cl.remove_duplicates(t.dirty_customer())


@query("c2_impute_mean", _filled("(SELECT avg(c_acctbal) FROM dirty)", _MODE))
def _(t):
    return cl.fill_missing(t.dirty_customer(), "mean", "mode")


@query("c2_impute_median", _filled("(SELECT median(c_acctbal) FROM dirty)", _MODE))
def _(t):
    return cl.fill_missing(t.dirty_customer(), "median", "mode")


@query("c2_impute_zero", _filled("0", "'Unknown'"))
def _(t):
    return cl.fill_missing(t.dirty_customer(), "zero", "unknown")


@query(
    "c3_impute_mode",
    sql(f"WITH {DIRTY};;SELECT c_custkey, coalesce(c_mktsegment, {_MODE}) AS c_mktsegment FROM dirty", "", "c_custkey"),
)
def _(t):
    return cl.fill_missing(t.dirty_customer().select("c_custkey", "c_mktsegment"), "mean", "mode")


_TS_GAPS = "SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN ts END AS seen FROM events"


def _gappy(t):
    seen = F.when(F.col("event_type") != "error", F.col("ts")).alias("seen")
    return t.events.select("event_id", "user_id", seen)


@query(
    "c4_forward_fill",
    sql(
        f"""SELECT event_id, user_id, last_value(seen IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM ({_TS_GAPS})""",
        "",
        "event_id user_id",
    ),
)
def _(t):
    return cl.fill_missing(_gappy(t), datetime="ffill", order_by=["event_id"])


@query(
    "c4_forward_fill_per_user",
    sql(
        f"""SELECT event_id, user_id,
 last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM ({_TS_GAPS})""",
        "",
        "event_id user_id",
    ),
)
def _(t):
    return cl.fill_missing(_gappy(t), datetime="ffill", order_by=["event_id"], within=["user_id"])


@query(
    "c5_forward_then_back_fill",
    sql(
        f"""SELECT event_id, user_id,
 coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
          first_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS seen
 FROM ({_TS_GAPS})""",
        "",
        "event_id user_id",
    ),
)
def _(t):
    return cl.fill_missing(_gappy(t), datetime="ffill_bfill", order_by=["event_id"], within=["user_id"])


@query(
    "c7_complete_rows",
    sql(f"WITH {DIRTY};;SELECT * FROM dirty WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL", "c_acctbal", "c_custkey c_nationkey"),
)
def _(t):
    return cl.drop_missing(t.dirty_customer())


@query(
    "c8_drop_sparse_columns",
    sql(f"WITH {DIRTY};;SELECT c_custkey, c_nationkey, c_acctbal FROM dirty WHERE c_acctbal IS NOT NULL", "c_acctbal", "c_custkey c_nationkey"),
)
def _(t):
    return cl.drop_missing(t.dirty_customer(), 0.15)


@query(
    "c9_cleaning_recipe",
    sql(
        f"""WITH {DIRTY}, done AS (SELECT DISTINCT * FROM dirty),
s AS (SELECT 'before' AS stage, count(*) AS n, (SELECT count(*) FROM done) AS k,
 sum((c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) AS gaps FROM dirty
 UNION ALL SELECT 'after', count(*), count(*), 0 FROM done)
;;SELECT stage, n AS "rows", n - k AS duplicate_rows, gaps AS missing_cells FROM s""",
        "",
        '"rows" duplicate_rows missing_cells',
    ),
)
def _(t):
    dirty = t.dirty_customer()
    return cl.cleaning_audit(dirty, cl.clean(dirty, recipe="median_mode"))


@query(
    "c1_duplicates_with_map",
    sql("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "", "c_nationkey"),
)
def _(t):
    nation, segment = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    # the same two entries, written in either order
    one, two = F.create_map(F.lit("n"), nation, F.lit("s"), segment), F.create_map(F.lit("s"), segment, F.lit("n"), nation)
    facts = t.customer.select(F.when(F.col("c_custkey") % 2 == 0, one).otherwise(two).alias("facts"))
    found = cl.remove_duplicates(facts)
    return found.select(F.col("facts")["n"].cast("long").alias("c_nationkey"), F.col("facts")["s"].alias("c_mktsegment"))


@query(
    "c5_fill_beside_other_columns",
    sql(
        f"""SELECT event_id, user_id, event_type, value,
 coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING),
          first_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS seen
 FROM ({_TS_GAPS}) JOIN (SELECT event_id, event_type, value FROM events) USING (event_id)""",
        "value",
        "event_id user_id",
    ),
)
def _(t):
    rows = _gappy(t).join(t.events.select("event_id", "event_type", "value"), "event_id")
    return cl.forward_fill(rows, ["seen"], ["event_id"], ["user_id"], back=True)
