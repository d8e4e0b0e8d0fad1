"""Filter, sample and column-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import select as se
from plumbline.plans.registry import DIRTY, query, sql, union_sql


@query(
    "p1_numeric_range",
    sql(
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice BETWEEN 20000 AND 30000",
        "l_extendedprice",
        "l_orderkey l_linenumber",
    ),
)
def _(t):
    li = t.lineitem
    return li.filter(se.in_range(li, "l_extendedprice", 20000, 30000)).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    "p2_category_levels",
    sql(f"WITH {DIRTY};;SELECT * FROM dirty WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') OR c_mktsegment IS NULL", "c_acctbal", "c_custkey c_nationkey"),
)
def _(t):
    d = t.dirty_customer()
    return d.filter(se.in_levels(d, "c_mktsegment", ["MACHINERY", "HOUSEHOLD"], keep_null=True))


@query("p3_contains_search", sql("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'wid')", "", "p_partkey"))
def _(t):
    p = t.part
    return p.filter(se.contains(p, "p_name", "WID")).select("p_partkey", "p_name")


@query(
    "p4_slice_and_dice",
    sql(
        """SELECT * FROM part WHERE p_size BETWEEN 10 AND 30 AND p_type IN ('PROMO', 'SMALL') AND contains(lower(p_name), 'ring')""",
        "p_retailprice",
        "p_partkey p_size",
    ),
)
def _(t):
    return se.slice_and_dice(t.part, ranges={"p_size": (10, 30)}, levels={"p_type": ["PROMO", "SMALL"]}, search={"p_name": "RING"})


@query(
    "p4_slice_counts",
    sql(
        """SELECT count(*) AS "rows", count(*) FILTER (p_size BETWEEN 10 AND 30 AND p_type IN ('PROMO', 'SMALL')) AS kept FROM part""",
        "",
        '"rows" kept',
    ),
)
def _(t):
    return se.slice_counts(t.part, ranges={"p_size": (10, 30)}, levels={"p_type": ["PROMO", "SMALL"]})


@query("p5_exclude_columns", sql("SELECT * EXCLUDE (c_name, c_acctbal) FROM customer", "", "c_custkey c_nationkey"))
def _(t):
    return se.exclude_columns(t.customer, ["c_name", "c_acctbal"])[0]


@query("p6_select_numeric", sql("SELECT c_custkey, c_nationkey, c_acctbal FROM customer", "c_acctbal", "c_custkey c_nationkey"))
def _(t):
    return se.by_type(t.customer, numeric=True)


@query("p6_select_other", "SELECT c_name, c_mktsegment FROM customer")
def _(t):
    return se.by_type(t.customer, numeric=False)


def _hash(seed, key):
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)"


@query(
    "p7_visual_sample",
    sql(
        f"SELECT event_id, value FROM events ORDER BY {_hash(42, 'event_id')}, {_hash(43, 'event_id')} LIMIT 2500",
        "value",
        "event_id",
    ),
)
def _(t):
    return se.visual_sample(t.events, 2500, ["event_id"])[0].select("event_id", "value")


@query(
    "p8_analysis_sample",
    sql(
        f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_hash(42, 'o_orderkey')}, {_hash(43, 'o_orderkey')} LIMIT 5000",
        "o_totalprice",
        "o_orderkey",
    ),
)
def _(t):
    return se.sample_rows(t.orders, 5000, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("p9_preview", sql("SELECT * FROM orders ORDER BY o_orderkey LIMIT 15", "o_totalprice", "o_orderkey o_custkey"))
def _(t):
    return se.preview(t.orders, 15, ["o_orderkey"])


def _id_rows(table, columns):
    return union_sql(
        f"SELECT '{c}' AS \"column\", {named} AS by_name, count({c}) AS non_null, "
        f"{f'count(DISTINCT {c})' if text else 'NULL'} AS distinct_values FROM {table}"
        for c, (named, text) in columns.items()
    )


@query(
    "p10_likely_ids",
    sql(
        "WITH f AS ("
        + _id_rows("customer", {"c_custkey": (False, False), "c_name": (False, True), "c_nationkey": (False, False), "c_acctbal": (False, False), "c_mktsegment": (False, True)})
        + """)
;;SELECT *, by_name OR coalesce(non_null >= 20 AND distinct_values > 0.5 * non_null, FALSE) AS likely_id FROM f""",
        "",
        "non_null distinct_values",
    ),
)
def _(t):
    return se.id_columns_table(t.customer)


@query(
    "p10_likely_ids_events",
    sql(
        "WITH f AS ("
        + _id_rows("events", {"event_id": (True, False), "ts": (False, False), "user_id": (True, False), "event_type": (False, True), "value": (False, False), "props": (False, True)})
        + """)
;;SELECT *, by_name OR coalesce(non_null >= 20 AND distinct_values > 0.5 * non_null, FALSE) AS likely_id FROM f""",
        "",
        "non_null distinct_values",
    ),
)
def _(t):
    return se.id_columns_table(t.events)


def _ptype(c, numeric):
    whole = f"bool_and(abs({c} - round_even({c}, 0)) <= 1e-8 + 1e-5 * abs(round_even({c}, 0)))" if numeric else "CAST(NULL AS BOOLEAN)"
    kind = (
        f"CASE WHEN count({c}) = 0 THEN 'Regression' WHEN {whole} AND count(DISTINCT {c}) <= 10 AND count(DISTINCT {c}) <= 0.5 * count({c}) "
        "THEN 'Classification' ELSE 'Regression' END"
        if numeric
        else f"CASE WHEN count({c}) = 0 THEN 'Regression' ELSE 'Classification' END"
    )
    return f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, {whole} AS integer_like, {kind} AS problem_type FROM lineitem"


_TARGETS = {"l_quantity": True, "l_discount": True, "l_linenumber": True, "l_extendedprice": True, "l_returnflag": False, "l_shipdate": False}


@query(
    "p11_problem_type",
    sql(union_sql(_ptype(c, n) for c, n in _TARGETS.items()), "", "non_null distinct_values"),
)
def _(t):
    return se.problem_type_table(t.lineitem, list(_TARGETS))


_INF = "SELECT CASE WHEN s_acctbal > 9000 THEN 'infinity'::DOUBLE WHEN s_acctbal < 0 THEN '-infinity'::DOUBLE ELSE s_acctbal END AS balance, s_suppkey FROM supplier"


@query(
    "p12_infinite_cells",
    sql(
        f"""SELECT 'balance' AS "column", count(*) FILTER (isinf(balance)) AS infinite FROM ({_INF})
UNION ALL SELECT 's_suppkey', 0 FROM supplier GROUP BY 1""",
        "",
        "infinite",
    ),
)
def _(t):
    bal = F.col("s_acctbal")
    x = F.when(bal > 9000, float("inf")).when(bal < 0, float("-inf")).otherwise(bal)
    return se.infinite_cells(t.supplier.select(x.alias("balance"), "s_suppkey"))


@query(
    "p13_datetime_to_epoch",
    sql("SELECT event_id, floor(epoch(ts)) AS ts FROM events", "ts", "event_id"),
)
def _(t):
    return se.datetime_to_epoch(t.events.select("event_id", "ts"))


@query(
    "p14_date_like_text",
    sql(
        """WITH x AS (SELECT CASE WHEN o_orderstatus <> 'F' OR o_orderkey < 1000 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'later' END AS some_dates,
 strftime(o_orderdate, '%Y-%m-%d') AS all_dates, o_orderpriority FROM orders)
;;SELECT 'some_dates' AS "column", count(some_dates) AS non_null, count(TRY_CAST(some_dates AS TIMESTAMP)) AS parsed,
 count(TRY_CAST(some_dates AS TIMESTAMP)) >= 0.8 * count(some_dates) AS date_like FROM x
UNION ALL SELECT 'all_dates', count(*), count(TRY_CAST(all_dates AS TIMESTAMP)), TRUE FROM x
UNION ALL SELECT 'o_orderpriority', count(*), 0, FALSE FROM x""",
        "",
        "non_null parsed",
    ),
)
def _(t):
    o, day = t.orders, F.date_format("o_orderdate", "yyyy-MM-dd")
    some = F.when((F.col("o_orderstatus") != "F") | (F.col("o_orderkey") < 1000), day).otherwise("later")
    return se.date_like_columns(o.select(some.alias("some_dates"), day.alias("all_dates"), "o_orderpriority"))


_RANKED = {"l_orderkey": (1, 0, 0), "l_linenumber": (1, 0, 3), "l_quantity": (1, 0, 4), "l_discount": (1, 0, 6), "l_returnflag": (0, 1, 8), "l_linestatus": (0, 1, 9), "l_shipdate": (0, 0, 10)}


@query(
    "p15_rank_grouping_columns",
    sql(
        "WITH f AS ("
        + union_sql(
            f"SELECT '{c}' AS \"column\", {bool(num)} AS \"numeric\", count(DISTINCT {c}) AS d, count({c}) AS n, {i} AS o, {bool(text)} AS texty FROM lineitem"
            for i, (c, (num, text, _)) in enumerate(_RANKED.items())
        )
        + """), g AS (SELECT *, CASE WHEN texty AND n >= 20 AND d > 0.5 * n THEN 4 WHEN d BETWEEN 2 AND 30 THEN 0 WHEN d BETWEEN 31 AND 100 THEN 1 ELSE 2 END AS tier FROM f)
;;SELECT "column", tier, "numeric", d AS distinct_values,
 row_number() OVER (ORDER BY tier, CASE WHEN tier = 4 THEN 0 ELSE "numeric"::INT END, d, o) AS position FROM g""",
        "",
        "tier distinct_values position",
    ),
)
def _(t):
    return se.rank_grouping_columns(t.lineitem, list(_RANKED))


@query(
    "p16_schema_diff",
    """WITH a AS (SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS t
 FROM (DESCRIBE SELECT c_custkey AS k, c_name, c_nationkey AS nation, c_acctbal AS acctbal FROM customer)),
b AS (SELECT column_name AS c, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS t
 FROM (DESCRIBE SELECT s_suppkey AS k, s_name, s_nationkey::BIGINT AS nation, s_acctbal AS acctbal FROM supplier))
SELECT coalesce(a.c, b.c) AS "column", a.c IS NOT NULL AS in_a, b.c IS NOT NULL AS in_b, a.t AS type_a, b.t AS type_b FROM a FULL JOIN b ON a.c = b.c""",
)
def _(t):
    a = t.customer.selectExpr("c_custkey AS k", "c_name", "c_nationkey AS nation", "c_acctbal AS acctbal")
    b = t.supplier.selectExpr("s_suppkey AS k", "s_name", "CAST(s_nationkey AS BIGINT) AS nation", "s_acctbal AS acctbal")
    return se.schema_diff(a, b)


@query(
    "p17_coercion_failures",
    sql(
        """WITH x AS (SELECT CASE WHEN value > 100 THEN 'too big' WHEN value < 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS amount, event_type FROM events)
;;SELECT 'amount' AS "column", count(*) FILTER (amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS unparsable FROM x
UNION ALL SELECT 'event_type', count(*) FROM x""",
        "",
        "unparsable",
    ),
)
def _(t):
    v = F.col("value")
    amount = F.when(v > 100, "too big").when(v < 1, None).otherwise(v.cast("string"))
    return se.coercion_failures(t.events.select(amount.alias("amount"), "event_type"), ["amount", "event_type"])
