import os

import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean as cl
from plumbline.operators import profile as pf
from plumbline.operators import select as se
from tests.conftest import rows


def test_hygiene_index_counts_cells_and_copies(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (4.0, None)], "a double, b string")
    r = pf.hygiene_index(df).first()
    assert (r["missing_cells"], r["completeness"], r["uniqueness"], r["hygiene_index"]) == (5, 37.5, 100.0, 68.75)
    same = spark.createDataFrame([(1,)] * 4, "a long")
    assert pf.hygiene_index(same).first()["uniqueness"] == 25.0
    assert pf.hygiene_index(same, digest=True).first()["uniqueness"] == 25.0
    empty = pf.hygiene_index(same.limit(0)).first()
    assert empty["is_empty"] and empty["hygiene_index"] == 0.0


def test_nan_is_missing_and_zeros_are_equal(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (None, -0.0)], "a double, b double")
    r = pf.column_profile(df).collect()
    assert [(x["column"], x["missing"], x["distinct_values"]) for x in r] == [("a", 2, 0), ("b", 0, 1)]
    assert pf.hygiene_index(df.select("b"), digest=True).first()["duplicate_rows"] == 1


def frame(spark):
    return spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "x"), (4.0, "y")], "num double, cat string")


def test_imputation(spark):
    df = frame(spark)

    def filled(num, cat="mode"):
        out = cl.fill_missing(df, num, cat).collect()
        return out[1]

    assert filled("mean")["num"] == pytest.approx(8 / 3)
    assert filled("median")["num"] == 3.0
    assert filled("zero", "unknown")["num"] == 0.0
    assert filled("mean")["cat"] == "x"
    assert filled("zero", "unknown")["cat"] == "Unknown"
    assert cl.drop_missing(df).count() == 3
    assert cl.remove_duplicates(df.union(df)).count() == 4


def test_imputation_edges(spark):
    blank = spark.createDataFrame([(None, None), (None, None)], "blank double, t string")
    assert rows(cl.fill_missing(blank)) == [(0.0, "Unknown"), (0.0, "Unknown")]
    infinite = spark.createDataFrame([(1.0,), (float("inf"),), (3.0,)], "x double")
    assert rows(cl.fill_missing(infinite, "mean")) == [(1.0,), (2.0,), (3.0,)]
    ties = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    assert cl.fill_missing(ties).filter("c = 'a'").count() == 2
    with pytest.raises(ValueError):
        cl.fill_missing(frame(spark), "modal")


def test_fit_on_another_table(spark):
    df = frame(spark)
    train = spark.createDataFrame([(10.0, "z"), (20.0, "z")], "num double, cat string")
    got = cl.fill_missing(df, "mean", "mode", fit_on=train).collect()[1]
    assert (got["num"], got["cat"]) == (15.0, "z")


def test_forward_fill_moves_only_what_it_orders_by(spark, split_small, tmp_path):
    df = spark.range(500).selectExpr("id", "if(id % 9 = 0, id, null) as v", "repeat('x', 50) as wide", "if(id = 3, double('nan'), id / 2) as o")
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    folder = spark.sparkContext.getCheckpointDir()
    before = sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:")))
    filled = cl.forward_fill(df, ["v"], ["id"], back=True)
    moved = [line for line in filled._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line or "Exchange" in line]
    assert moved and not any("wide" in line for line in moved)
    assert "wide" not in "".join(x for x in filled._jdf.queryExecution().executedPlan().toString().split("\n") if "Sort " in x or "Exchange " in x)
    assert sum(len(f) for _, _, f in os.walk(folder.removeprefix("file:"))) == before
    assert {r["id"]: r["v"] for r in filled.collect()} == {i: i // 9 * 9 for i in range(500)}
    # nothing missing: the table itself
    assert cl.forward_fill(df, ["id"], ["o"]) is df


def test_forward_fill_of_ties_nulls_and_empty_tables(spark, split_small):
    rows = [(None, None, None, 0), (None, 5, None, 1), (1, None, None, 2), (1, 6, None, 3), (2, None, 7, 4), (2, None, None, 5), (2, None, None, 6)]
    df = spark.createDataFrame(rows, "o int, v int, w int, id int")
    got = {r["id"]: (r["v"], r["w"]) for r in cl.forward_fill(df, ["v", "w"], ["o"], back=True).collect()}
    assert got == {0: (5, 7), 1: (5, 7), 2: (6, 7), 3: (6, 7), 4: (6, 7), 5: (6, 7), 6: (6, 7)}
    assert cl.forward_fill(df.limit(0), ["v"], ["o"]).count() == 0
    assert cl.forward_fill(df.withColumn("v", F.lit(None).cast("int")), ["v"], ["o"]).filter("v IS NOT NULL").count() == 0


@pytest.mark.parametrize("carry", [64 << 20, 0])
@pytest.mark.parametrize("extra", [False, True])
@pytest.mark.parametrize("within", [[], ["k"]])
@pytest.mark.parametrize("back", [False, True])
def test_forward_fill_over_many_ranges(spark, split_small, monkeypatch, within, back, extra, carry):
    monkeypatch.setattr(cl, "CARRY_BYTES", carry)
    data = [(i, "hot" if i % 3 else f"k{i % 5}", f"v{i}" if i % 40 == 13 else None) for i in range(600)]
    df = spark.createDataFrame(data, "id long, k string, v string").repartition(4)
    if extra:
        df = df.withColumn("wide", F.map_from_arrays(F.array("id"), F.array("k")))
    filled = cl.forward_fill(df, ["v"], ["id"], within, back)
    assert filled.columns == df.columns
    got = {r["id"]: r["v"] for r in filled.collect()}
    assert filled.count() == len(data)
    last, want = {}, {}
    for i, k, v in data:
        key = k if within else None
        last[key] = v or last.get(key)
        want[i] = last[key]
    if back:
        ahead = {}
        for i, k, v in reversed(data):
            key = k if within else None
            ahead[key] = v or ahead.get(key)
            want[i] = want[i] or ahead[key]
    assert got == want


def test_forward_fill_needs_an_order(spark):
    df = spark.createDataFrame([(1, None)], "id long, t timestamp")
    with pytest.raises(ValueError, match="order"):
        cl.fill_missing(df)


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 5, 3)], "a int, b int, c int")
    assert cl.drop_sparse_columns(df, 0.5).columns == ["a", "b", "c"]
    assert cl.drop_sparse_columns(df, 0.3).columns == ["a", "c"]
    assert rows(cl.drop_missing(df, 0.3)) == [(1, 1), (3, 3)]


def test_quality_flags(spark):
    n = 100
    df = spark.range(n).select(
        F.concat(F.lit("u"), "id").alias("name"),
        F.lit(1).alias("same"),
        F.when(F.col("id") < 55, F.col("id")).alias("half"),
        F.when(F.col("id") < 88, F.col("id") % 10).otherwise(1000).cast("double").alias("tail"),
    )
    got = {r["column"]: r["flags"] for r in pf.quality_flags(df).collect()}
    assert got == {
        "name": "Possible ID/high-cardinality",
        "same": "Constant",
        "half": "High missingness",
        "tail": "Heavy outliers",
    }
    assert pf.review_list(df).first()["needs_review"] == "name, same, half, tail"


def test_exclusions_fail_closed(spark):
    df = spark.createDataFrame([("s", 1)], "secret string, keep long")
    kept, ok = se.exclude_columns(df, ["secret"])
    assert (kept.columns, ok) == (["keep"], True)
    none, ok = se.exclude_columns(df, ["secret", "keep"])
    assert (none.columns, ok) == ([], False)


def test_filters(spark):
    df = spark.createDataFrame([(1.0, "Ab"), (float("nan"), None), (float("inf"), "b"), (3.0, "c%")], "x double, s string")
    assert rows(df.filter(se.in_range(df, "x", 1, 3)).select("x")) == [(1.0,), (3.0,)]
    assert df.filter(se.contains(df, "s", "B")).count() == 2
    assert df.filter(se.contains(df, "s", "%")).count() == 1
    assert df.filter(se.in_levels(df, "s", ["b"], keep_null=True)).count() == 2
    assert se.slice_counts(df, levels={"s": ["b", None]}).first() == (4, 2)


def test_problem_type(spark):
    df = spark.range(40).select((F.col("id") % 3).alias("cls"), (F.col("id") * 1.5).alias("reg"), (F.col("id") > 3).alias("flag"), F.lit(None).cast("int").alias("none"))
    got = {r["column"]: r["problem_type"] for r in se.problem_type_table(df, ["cls", "reg", "flag", "none", "absent"]).collect()}
    assert got == {"cls": "Classification", "reg": "Regression", "flag": "Classification", "none": "Regression", "absent": "Classification"}
    short = spark.createDataFrame([(1,), (2,), (3,)], "y int")
    assert se.problem_type(short, "y") == "Regression"


def test_sample_is_exact_and_repeatable(spark, split_small):
    df = spark.range(500)
    a, b = se.sample_rows(df, 120, ["id"]), se.sample_rows(df.repartition(7), 120, ["id"])
    assert a.count() == 120 and rows(a) == rows(b)
    whole, sampled, note = se.visual_sample(df, 600, ["id"])
    assert whole.count() == 500 and not sampled and note == ""


def test_sample_with_copies_of_a_key(spark):
    df = spark.range(30).select((F.col("id") % 3).alias("g"), "id")
    assert se.sample_rows(df, 7, ["g", "id"]).count() == 7


def test_epoch_is_the_same_for_every_time_type(spark):
    df = spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:10.5' AS a, TIMESTAMP_NTZ'2024-01-01 00:00:10.5' AS b, DATE'2024-01-01' AS c")
    assert se.datetime_to_epoch(df).first() == (1704067210.0, 1704067210.0, 1704067200.0)


def test_numeric_text_is_checked(spark):
    df = spark.createDataFrame([("1.5",), (None,)], "x string")
    assert se.require_numeric(df, ["x"]).first()["x"] == 1.5
    with pytest.raises(ValueError, match="not a number: x"):
        se.require_numeric(spark.createDataFrame([("NOT_A_NUMBER",)], "x string"), ["x"])
