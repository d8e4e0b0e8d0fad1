"""Quality and profile queries."""

from __future__ import annotations

from plumbline.operators import profile as pf
from plumbline.plans.registry import DIRTY, query, sql, union_sql
from plumbline.sources.tables import source_summary

LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
DIRTY_COLUMNS = {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


def _facts(table, columns, extra=""):
    return union_sql(
        f"SELECT {n} AS position, '{c}' AS \"column\", '{t}' AS data_type, count(*) AS n_rows, count({c}) AS non_null, "
        f"count(*) - count({c}) AS missing, count(DISTINCT {c}) AS distinct_values{extra.format(c=c)} FROM {table}"
        for n, (c, t) in enumerate(columns.items(), 1)
    )


_HYGIENE = f"""WITH {DIRTY}, s AS (SELECT count(*) AS n,
  (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) AS k,
  sum((c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) AS gaps FROM dirty)
;;SELECT n AS "rows", 4 AS "columns", gaps AS missing_cells, n - k AS duplicate_rows,
 (4 * n - gaps) * 100.0 / (4 * n) AS completeness, k * 100.0 / n AS uniqueness, FALSE AS is_empty,
 ((4 * n - gaps) * 100.0 / (4 * n) + k * 100.0 / n) / 2 AS hygiene_index FROM s"""
_HYGIENE_SQL = sql(_HYGIENE, "completeness uniqueness hygiene_index", '"rows" "columns" missing_cells duplicate_rows')


@query("q1_hygiene_index", _HYGIENE_SQL)
def _(t):
    return pf.hygiene_index(t.dirty_customer())


@query("q1_hygiene_index_by_digest", _HYGIENE_SQL)
def _(t):
    return pf.hygiene_index(t.dirty_customer(), digest=True)


_CARDINALITY = """CASE WHEN distinct_values = 1 THEN 'constant' WHEN distinct_values = 2 THEN 'binary'
 WHEN distinct_values <= 20 THEN 'low' ELSE 'high' END AS cardinality"""


@query(
    "q2_column_profile",
    sql(
        f"""WITH f AS ({_facts("lineitem", LINEITEM)})
;;SELECT "column", data_type, non_null, missing, missing * 100.0 / n_rows AS missing_pct, distinct_values, {_CARDINALITY} FROM f""",
        "missing_pct",
        "non_null missing distinct_values",
    ),
)
def _(t):
    return pf.column_profile(t.lineitem)


@query(
    "q2_column_profile_with_gaps",
    sql(
        f"""WITH {DIRTY}, f AS ({_facts("dirty", DIRTY_COLUMNS)})
;;SELECT "column", data_type, non_null, missing, missing * 100.0 / n_rows AS missing_pct, distinct_values, {_CARDINALITY} FROM f""",
        "missing_pct",
        "non_null missing distinct_values",
    ),
)
def _(t):
    return pf.column_profile(t.dirty_customer())


@query(
    "q3_missing_columns",
    sql(
        f"""WITH {DIRTY}, f AS ({_facts("dirty", DIRTY_COLUMNS)})
;;SELECT "column", missing, missing * 100.0 / n_rows AS missing_pct,
 CASE WHEN missing * 100.0 / n_rows > 15 THEN 'high' ELSE 'some' END AS severity FROM f WHERE missing > 0""",
        "missing_pct",
        "missing",
    ),
)
def _(t):
    return pf.missing_columns(t.dirty_customer())


@query(
    "q4_column_structure",
    sql(
        f"""WITH f AS ({_facts("lineitem", LINEITEM)})
;;SELECT position, "column", data_type, non_null, missing, missing * 100.0 / n_rows AS missing_pct, distinct_values FROM f""",
        "missing_pct",
        "position non_null missing distinct_values",
    ),
)
def _(t):
    return pf.column_structure(t.lineitem)


def _flags_sql(table, columns, ctes=""):
    parts = []
    for c, t in columns.items():
        if t in ("bigint", "int", "double"):
            heavy = (
                f"(SELECT CASE WHEN q3 > q1 AND avg(CASE WHEN x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1) THEN 100.0 ELSE 0 END) >= 10 "
                f"THEN 'Heavy outliers' END FROM (SELECT {c}::DOUBLE AS x FROM {table} WHERE {c} IS NOT NULL), "
                f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table}) GROUP BY q1, q3)"
            )
        else:
            heavy = "NULL"
        ident = (
            f"CASE WHEN count(DISTINCT {c}) > 0.95 * greatest(count({c}), 1) AND count(DISTINCT {c}) > 20 THEN 'Possible ID/high-cardinality' END"
            if t == "string"
            else "NULL"
        )
        parts.append(
            f"SELECT '{c}' AS \"column\", 100 - (count(*) - count({c})) * 100.0 / count(*) AS completeness_pct, "
            f"count(DISTINCT {c}) * 100.0 / greatest(count({c}), 1) AS uniqueness_pct, "
            f"coalesce(nullif(concat_ws(', ', CASE WHEN (count(*) - count({c})) * 100.0 / count(*) >= 40 THEN 'High missingness' END, "
            f"CASE WHEN count(DISTINCT {c}) <= 1 THEN 'Constant' END, {ident}, {heavy}), ''), 'OK') AS flags FROM {table}"
        )
    return f"WITH {ctes}f AS ({union_sql(parts)})"


@query(
    "q5_quality_flags",
    sql(_flags_sql("lineitem", LINEITEM) + ';;SELECT * FROM f', "completeness_pct uniqueness_pct"),
)
def _(t):
    return pf.quality_flags(t.lineitem)


@query(
    "q5_quality_flags_customer",
    sql(
        _flags_sql("customer", {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"})
        + ";;SELECT * FROM f",
        "completeness_pct uniqueness_pct",
    ),
)
def _(t):
    return pf.quality_flags(t.customer)


_EVENTS = {"event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query(
    "q6_needs_review",
    sql(
        _flags_sql("events", _EVENTS)
        + """, p AS (SELECT f.*, list_position(['event_id','ts','user_id','event_type','value','props'], "column") AS pos FROM f)
;;SELECT count(*) AS flagged, coalesce(string_agg("column", ', ' ORDER BY pos), '') AS needs_review FROM p WHERE flags <> 'OK'""",
        "",
        "flagged",
    ),
)
def _(t):
    return pf.review_list(t.events)


@query(
    "q7_duplicate_rows",
    sql(
        f"""WITH {DIRTY}
;;SELECT 'clean' AS dataset, count(*) AS "rows", count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)) AS duplicate_rows FROM customer
UNION ALL SELECT 'dirty', count(*), count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dirty)) FROM dirty""",
        "",
        '"rows" duplicate_rows',
    ),
)
def _(t):
    return pf.duplicate_row_counts({"clean": t.customer, "dirty": t.dirty_customer()})


@query(
    "q8_source_summary",
    sql(
        f"""WITH {DIRTY}
;;SELECT 'dirty' AS dataset, count(*) AS "rows", 4 AS "columns",
 sum((c_acctbal IS NULL)::INT + (c_mktsegment IS NULL)::INT) * 100.0 / (count(*) * 4) AS missing_pct FROM dirty
UNION ALL SELECT 'orders', count(*), 6, 0 FROM orders UNION ALL SELECT 'lineitem', count(*), 11, 0 FROM lineitem""",
        "missing_pct",
        '"rows" "columns"',
    ),
)
def _(t):
    return source_summary({"dirty": t.dirty_customer(), "orders": t.orders, "lineitem": t.lineitem})


@query(
    "q9_type_mix",
    sql(
        """SELECT 6 AS "columns", 3 AS numeric_columns, 3 AS other_columns,
 2 + (count(event_type) >= 20 AND count(DISTINCT event_type) > 0.5 * count(event_type))::INT
   + (count(props) >= 20 AND count(DISTINCT props) > 0.5 * count(props))::INT AS likely_ids FROM events""",
        "",
        '"columns" numeric_columns other_columns likely_ids',
    ),
)
def _(t):
    return pf.type_mix(t.events)


