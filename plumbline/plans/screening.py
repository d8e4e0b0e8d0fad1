"""Privacy screening queries over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import privacy as pr
from plumbline.plans.registry import query, sql, union_sql


def _lit(pattern):
    return "'" + pattern.replace("'", "''") + "'"


def _digits(v):
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


_LUHN = """(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({d}), i, 1) AS INT)
 ELSE (CAST(substr(reverse({d}), i, 1) AS INT) * 2) // 10 + (CAST(substr(reverse({d}), i, 1) AS INT) * 2) % 10 END)) % 10 = 0)"""


def tests_sql(text):
    """One boolean expression per kind, in the order of the library."""
    runs = f"list_transform(regexp_extract_all({text}, {_lit(pr.CARD)}), lambda m: {_digits('m')})"
    card = f"len(list_filter({runs}, lambda d: length(d) BETWEEN 13 AND 19 AND {_LUHN.format(d='d')})) > 0"
    bare = f"regexp_replace({text}, {_lit(pr.TIMESTAMP)}, ' ', 'g')"
    phones = f"list_transform(regexp_extract_all({bare}, {_lit(pr.PHONE)}), lambda m: {_digits('m')})"
    phone = (
        f"len(list_filter({phones}, lambda d: length(d) BETWEEN 9 AND 15 AND NOT (length(d) = 10 AND "
        f"coalesce(TRY_CAST(d AS BIGINT) BETWEEN {pr.EPOCH_LOW} AND {pr.EPOCH_HIGH}, FALSE)))) > 0"
    )
    return [
        f"regexp_matches({text}, {_lit(pr.EMAIL)})",
        f"regexp_matches({text}, {_lit('|'.join(pr.TOKENS))})",
        f"regexp_matches({text}, {_lit(pr.IBAN)})",
        card,
        phone,
    ]


def _findings(text):
    marks = ", ".join(f"CASE WHEN {t} THEN '{k}' END" for t, k in zip(tests_sql(text), pr.KINDS))
    return f"list_filter([{marks}], lambda f: f IS NOT NULL)"


@query("y1_sensitive_names")
def _(t):
    renamed = t.customer.select(
        F.col("c_custkey").alias("customerId"), F.col("c_name").alias("email_address"), F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("monthly_spend"), F.col("c_mktsegment").alias("API_KEY"),
    )
    hits = pr.sensitive_names(renamed)
    # the share of rows with a value says how much each finding matters
    filled = renamed.agg(F.count(F.lit(1)).alias("rows"))
    return hits.select("column", "reason", F.lit(filled.first()["rows"]).alias("rows"))


def _reason(column, table, where="TRUE"):
    hits = " ".join(f"WHEN bool_or({t}) THEN '{k}'" for t, k in zip(tests_sql(column), pr.KINDS))
    return f"SELECT '{column}' AS \"column\", CASE {hits} END AS reason FROM {table} WHERE {where}"


@query(
    "y2_sensitive_values",
    f"SELECT * FROM ({union_sql(_reason(c, 'documents') for c in ('text', 'lang', 'source'))}) WHERE reason IS NOT NULL",
)
def _(t):
    return pr.sensitive_values(t.documents)


@query(
    "y2_sensitive_values_conversations",
    f"SELECT * FROM ({union_sql(_reason(c, 'conversations') for c in ('role', 'text'))}) WHERE reason IS NOT NULL",
)
def _(t):
    return pr.sensitive_values(t.conversations)


@query(
    "y3_luhn_share",
    sql(
        f"""WITH x AS (SELECT CAST(4000000000000000 + l_orderkey * 7919 + l_partkey AS VARCHAR) AS pay FROM lineitem)
;;SELECT 'pay' AS "column", count(*) AS non_null, count(*) FILTER ({_LUHN.format(d="pay")}) AS luhn_valid,
 count(*) FILTER ({_LUHN.format(d="pay")}) * 1.0 / count(*) AS share FROM x""",
        "share",
        "non_null luhn_valid",
    ),
)
def _(t):
    pay = (F.lit(4000000000000000) + F.col("l_orderkey") * 7919 + F.col("l_partkey")).cast("string")
    return pr.luhn_share(t.lineitem.select(pay.alias("pay")), ["pay"])


_PHONES = {
    "tel_like": ("15550000000 + o_custkey", "15550000000 + o_custkey"),
    "epoch_like": ("1500000000 + o_orderkey", "1500000000 + o_orderkey"),
    "o_totalprice": ("o_totalprice", "o_totalprice"),
    "o_orderkey": ("o_orderkey", "o_orderkey"),
}


@query(
    "y4_numeric_phones",
    sql(
        "SELECT *, whole AND NOT epoch_like AND long_share >= 0.8 AS phone_like FROM ("
        + union_sql(
            f"""SELECT '{c}' AS "column", bool_and({e} = floor({e})) AS whole, bool_and({e} BETWEEN 1000000000 AND 2150000000) AS epoch_like,
 avg((abs({e}) >= 1e9 AND abs({e}) < 1e15)::INT) AS long_share FROM orders"""
            for c, (e, _) in _PHONES.items()
        )
        + ")",
        "long_share",
    ),
)
def _(t):
    return pr.numeric_phones(t.orders.selectExpr(*[f"{e} AS {c}" for c, (_, e) in _PHONES.items()]))


@query("y5_sensitive_text", sql(f"SELECT doc_id, array_to_string({_findings('text')}, ', ') AS findings FROM documents", "", "doc_id"))
def _(t):
    return pr.sensitive_text(t.documents, "text").select("doc_id", F.concat_ws(", ", "findings").alias("findings"))


@query(
    "y5_finding_counts",
    sql(
        f"""SELECT "group", finding, count(*) AS "rows" FROM (SELECT lang AS "group", unnest({_findings('text')}) AS finding FROM documents) GROUP BY 1, 2""",
        "",
        '"rows"',
    ),
)
def _(t):
    return pr.finding_counts(t.documents, "text", "lang")


@query(
    "y6_mask",
    sql(
        f"SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN '{pr.MASK}' END AS c_name, CASE WHEN c_acctbal >= 0 THEN '{pr.MASK}' END AS c_acctbal, c_mktsegment FROM customer",
        "",
        "c_custkey",
    ),
)
def _(t):
    bal = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal")
    return pr.mask(t.customer.select("c_custkey", "c_name", bal, "c_mktsegment"), ["c_name", "c_acctbal"])


@query("y_sensitive_columns_of_events")
def _(t):
    return pr.sensitive_columns(t.events)
