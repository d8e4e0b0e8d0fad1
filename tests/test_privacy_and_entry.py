import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import privacy as pr
from plumbline.operators import report as rp
from tests.conftest import rows


def test_names():
    sensitive = ["password", "api_key", "customer_id", "user_id", "client_uuid", "customerId", "homeTel", "EMAIL", "SSN"]
    assert all(pr.name_reason(c) for c in sensitive)
    assert [pr.name_reason(c) for c in ("note", "monthly_spend", "hotel", "cellar", "idea")] == [None] * 5
    assert pr.name_reason("homeTel") == "column name suggests 'tel'"


CASES = [
    ("write to a.b@c.org now", ["email-like values"]),
    ("sk-" + "a" * 24, ["credential/token-like values"]),
    ("key AKIA" + "A" * 16 + ".", ["credential/token-like values"]),
    ("ghp_" + "x" * 25, ["credential/token-like values"]),
    ("4532015112830366", ["credit-card-like values"]),
    ("4532 0151 1283 0366", ["credit-card-like values"]),
    ("1234567812345678", []),
    ("GB82WEST1234A5698B7654C32", ["IBAN-like values"]),
    ("call +1 (555) 234-5678", ["phone-number-like values"]),
    ("2024-01-05 10:20:30 job done\n2024-01-05T10:20:31Z next", []),
    ("123 2024/1/1 456789", ["phone-number-like values"]),
    ("at 1700000000 seconds", []),
    ("", []),
    ("plain words only, number 42", []),
]


def test_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = [r["findings"] for r in pr.sensitive_text(df, "t").orderBy("i").collect()]
    assert got == [want for _, want in CASES]


def test_findings_far_into_a_text(spark):
    df = spark.createDataFrame([("word " * 20_000 + "me@site.com",)], "t string")
    assert pr.sensitive_text(df, "t").first()["findings"] == ["email-like values"]


def test_columns(spark):
    df = spark.range(30).select(
        F.lit("x@y.com").alias("contact"), F.lit("ok").alias("note"), (F.lit(15550000000) + F.col("id")).alias("num"),
        (F.lit(1500000000) + F.col("id")).alias("epoch"), F.lit("s").alias("secret_word"), F.col("id").cast("timestamp").alias("at"),
    )
    got = {r["column"]: r["reason"] for r in pr.sensitive_columns(df).collect()}
    assert set(got) == {"contact", "num", "secret_word"} and got["contact"] == "email-like values"
    assert rows(pr.mask(df, ["note"]).select("note").distinct()) == [(pr.MASK,)]


def test_report_hides_sensitive_values(spark):
    df = spark.range(50).select(
        F.col("id").alias("user_id"), (F.col("id") * 2.5).alias("amount"), (F.col("id") * 5.0).alias("double_amount"),
        F.lit("me@here.org").alias("contact"), F.when(F.col("id") > 5, "a").alias("kind"),
    )
    report = rp.audit_report(df, excluded=["double_amount"], key=["user_id"])
    assert {"summary", "structure", "numeric", "outliers", "categorical", "quality", "review", "sample", "histograms", "boxes"} <= set(report)
    for name, table in report.items():
        assert "me@here.org" not in str(table.collect()), name
    assert next(r for r in report["numeric"].collect() if r["column"] == "user_id")["mean"] is None
    assert {r["column"] for r in report["histograms"].collect()} == {"amount"}
    assert report["sample"].count() == 8


def test_catalog_report_goes_on_after_a_failure(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    broken = spark.range(4).select(F.raise_error(F.lit("broken table")).cast("int").alias("x"))
    table, failed = rp.catalog_report({"good": spark.read.parquet(path), "bad": broken})
    assert [r["dataset"] for r in table.collect()] == ["good"] and failed[0][0] == "bad"


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 8
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 150


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not present")
@pytest.mark.parametrize("name", ["q2_column_profile", "t11_tukey_outliers", "v10_envelope_downsample", "m4_stratified_split", "s12_merge_sources"])
def test_a_query_of_each_kind_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    df = entry.queries()[name](spark, DATA)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(dict(zip(names, r))[c] for c in df.columns) for r in res.fetchall()), key=repr)
    assert rows(df) == want


def test_wide_tables_are_reported_whole(spark):
    df = spark.range(30).selectExpr("id", *[f"id * {i} + rand({i}) as n{i}" for i in range(130)], "repeat('long text ', 20) as t")
    report = rp.audit_report(df.select("n1", *[f"n{i}" for i in range(2, 130)], "t"), charts=False)
    assert report["numeric"].count() == 129 and report["structure"].count() == 130
    assert report["categorical"].first()["top_level"] == "long text " * 20
    name, whole, reason = next(rp.full_reports({"small": df.select("id", "t")}))
    assert name == "small" and "summary" in whole and reason is None
