import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from plumbline.functions import ranks as ranks_module
from plumbline.operators import charts as ch
from plumbline.operators import drift as dr
from plumbline.operators import features as fe
from plumbline.operators import select as se
from plumbline.operators import profile as pf
from plumbline.operators import stats as st
from tests.conftest import rows


def gauss(n, mean=0.0, std=1.0, seed=1):
    r = random.Random(seed)
    return [r.gauss(mean, std) for _ in range(n)]


def one(df, **match):
    return next(r for r in df.collect() if all(r[k] == v for k, v in match.items()))


def test_outliers(spark):
    xs = gauss(100, 50, 5) + [120.0, 130.0, 140.0, 150.0, 160.0]
    df = spark.createDataFrame([(x, 10.0, float(i) if i < 3 else None) for i, x in enumerate(xs)], "x double, flat double, few double")
    table = st.tukey_outliers(df)
    x = one(table, column="x")
    assert x["outliers"] >= 5 and x["z_outliers"] >= 4
    assert one(st.tukey_outliers(df, k=3.0), column="x")["outliers"] <= x["outliers"]
    flat, few = one(table, column="flat"), one(table, column="few")
    assert (flat["outliers"], flat["z_outliers"]) == (0, 0)
    assert few["q1"] is None and few["outliers"] == 0
    summary = st.outlier_summary(df)
    assert {r["column"] for r in summary.collect()} == {"x", "flat"}
    assert one(summary, column="x")["shape"] == "Right-skewed" and one(summary, column="x")["skew"] > 1
    assert one(summary, column="flat")["shape"] == "Symmetric"
    assert st.outlier_rows(df, ["x"], ["x"]).count() == x["outliers"]


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "c double, d double")
    c = one(st.describe(df), column="c")
    assert c["std"] == 0.0 and c["skew"] is None
    assert one(st.pearson_pairs(df), feature_a="c")["r"] is None
    assert one(st.normality(df), column="c")["verdict"] == "too few values"
    four = spark.createDataFrame([(5.0,)] * 5, "c double")
    r = one(st.describe(four), column="c")
    assert (r["skew"], r["kurtosis"]) == (0.0, 0.0)


def test_normality_against_published_values(spark):
    # a symmetric, light-tailed and a skewed sample; values worked out with the published formulas in numpy
    def k2(xs):
        x = np.array(xs)
        n, d = len(x), x - x.mean()
        g1, g2 = (d**3).mean() / (d**2).mean() ** 1.5, (d**4).mean() / (d**2).mean() ** 2 - 3
        y = g1 * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
        b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
        w2 = -1 + math.sqrt(2 * (b2 - 1))
        z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
        e, v = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
        t = (g2 + 3 - e) / math.sqrt(v)
        sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
        a = 6 + 8 / sb * (2 / sb + math.sqrt(1 + 4 / sb**2))
        z2 = (1 - 2 / (9 * a) - np.cbrt((1 - 2 / a) / (1 + t * math.sqrt(2 / (a - 4))))) / math.sqrt(2 / (9 * a))
        return z1 * z1 + z2 * z2

    for xs in ([i**1.1 for i in range(30)], [math.exp(i / 5) for i in range(25)], gauss(200)):
        got = st.normality(spark.createDataFrame([(x,) for x in xs], "x double")).first()
        assert got["k2"] == pytest.approx(k2(xs), rel=1e-9)
    assert got["verdict"] == "gaussian"


def test_spearman_with_ties_and_gaps(spark, split_small):
    r = random.Random(3)
    data = [(float(r.randint(0, 9)), r.gauss(0, 1), None if i % 7 == 0 else float(r.randint(0, 30))) for i in range(300)]
    data = [(a, b + a, c) for a, b, c in data] + [(1.0, 1.0, 1.0)] * 150
    df = spark.createDataFrame(data, "a double, b double, c double")

    def ranks(xs):
        xs = np.array(xs)
        return np.array([(xs < x).sum() + ((xs == x).sum() + 1) / 2 for x in xs])

    for p in st.spearman_pairs(df).collect():
        i, j = "abc".index(p["feature_a"]), "abc".index(p["feature_b"])
        both = [(t[i], t[j]) for t in data if t[i] is not None and t[j] is not None]
        want = np.corrcoef(ranks([x for x, _ in both]), ranks([y for _, y in both]))[0, 1]
        assert p["r"] == pytest.approx(want) and p["n"] == len(both)


def test_ranks_of_few_values_go_to_the_rows(spark, split_small, monkeypatch):
    df = spark.range(400).select((F.col("id") % 7).alias("a"), (F.col("id") * 7919 % 400).alias("b"), (F.col("id") % 5 * (F.col("id") % 3)).alias("c"))

    def moved(pairs):
        return pairs._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")

    few = st.spearman_pairs(df)
    assert moved(few) == 3
    want = rows(few)
    monkeypatch.setattr(st, "BROADCAST_ROWS", 50)
    some = st.spearman_pairs(df)
    assert moved(some) == 2 and [r[:5] for r in rows(some)] == [r[:5] for r in want]
    assert [r[5] for r in rows(some)] == pytest.approx([r[5] for r in want])
    spark.conf.set("plumbline.task.rows", "1000")
    assert [r[5] for r in rows(st.spearman_pairs(df))] == pytest.approx([r[5] for r in want])


def test_ranks_of_gapped_columns_move_cells_once(spark, split_small, monkeypatch):
    """Three patterns of gaps, many and few values, a value on a third of the rows, infinities, zeros of both signs."""
    r = random.Random(5)

    def row(k):
        hot = 3.5 if k % 3 == 0 else r.gauss(0, 2)
        a = [r.choice([float("inf"), float("-inf"), 0.0, -0.0]) if k % 11 == 0 else r.gauss(0, 1), hot, float(r.randint(0, 3))]
        b, c = [r.random(), float(r.randint(0, 900)), float(k % 2)], [hot + r.gauss(0, 1), float("nan")]
        whole = [a[0] * 2 if k % 11 else 1.0, float(r.randint(0, 5)), 7.0]
        return tuple([*(a if k % 5 else [None] * 3), *(b if k % 4 else [None] * 3), c[0] if k % 7 else float("nan"), c[1], *whole])

    data = [row(k) for k in range(700)]
    data += data[:60]
    names = ["a1", "a2", "a3", "b1", "b2", "b3", "c1", "none", "w1", "w2", "w3"]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(3)
    columns = {n: [None if v is None or math.isnan(v) else v for v in x] for n, x in zip(names, zip(*data))}

    def ranks(xs):
        xs = np.array(xs)
        return np.array([(xs < x).sum() + ((xs == x).sum() + 1) / 2 for x in xs])

    monkeypatch.setattr(st, "BROADCAST_ROWS", 40)
    # blocks of a few dozen rows, so that a piece has cells of many blocks
    monkeypatch.setattr(ranks_module, "BLOCK_CELLS", 500)
    got = st.spearman_pairs(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # rows are joined with few values only: of many values the cells move, to be ranked and back, for all patterns at once
    assert plan.count("Join ") == plan.count("strategy=broadcast") and plan.count("RepartitionByExpression") == 2
    found = {(p["feature_a"], p["feature_b"]): p for p in got.collect()}
    assert len(found) == 45 and not any("none" in k for k in found)
    for (a, b), p in found.items():
        both = [(x, y) for x, y in zip(columns[a], columns[b]) if x is not None and y is not None]
        x, y = (ranks(v) for v in zip(*both))
        assert p["n"] == len(both) and (p["i"], p["j"]) == (names.index(a), names.index(b)) and p["i"] < p["j"]
        if "w3" in (a, b):
            assert p["r"] is None
        else:
            assert p["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-12)


def test_columns_with_the_same_gaps_share_a_pattern(spark):
    data = [(1.0, None, 1.0, float("nan"), None), (None, 2.0, None, 2.0, 1.0), (1.0, 2.0, 3.0, 4.0, 5.0)]
    df = spark.createDataFrame(data * 2, "a double, b double, c double, d double, e double")
    ids = df.columns
    clean = df.select(*[F.nanvl(x, F.lit(None).cast("double")).alias(x) for x in ids])
    assert ranks_module.gap_patterns(clean, ids) == (6, [0, 1, 0, 1, 1])
    assert ranks_module.gap_patterns(clean.fillna(0.0, ["a"]), ids) == (6, [-1, 0, 1, 0, 0])
    assert st.spearman_pairs(df, ["a"]).collect() == [] == st.spearman_pairs(df.limit(0)).collect()


def test_rows_in_another_order_are_noticed(spark):
    plan = ranks_module.layout([-1, -1], [(0, 1)])
    places = [np.array([0, 2, 0], "uint16"), np.array([0, 1, 1], "int32")]
    with pytest.raises(RuntimeError, match="another order"):
        offsets = {0: {-1: np.zeros(3, int)}, 1: {-1: np.zeros(2, int)}}
        ranks_module._sums(places, [], {(0, -1): np.array([1, 3], "uint32")}, offsets, plan)


def test_both_ways_to_correlate_agree(spark, monkeypatch):
    r = random.Random(8)
    data = [tuple([None if r.random() < 0.2 else 1e6 + r.gauss(0, 1) for _ in range(4)] + [7.3]) for _ in range(200)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, e double").repartition(5)
    plain = {(x["feature_a"], x["feature_b"]): (x["n"], x["r"]) for x in st.pearson_pairs(df).collect()}
    monkeypatch.setattr(st, "PAIRWISE_COLUMNS", 2)
    blocks = {(x["feature_a"], x["feature_b"]): (x["n"], x["r"]) for x in st.pearson_pairs(df).collect()}
    assert plain.keys() == blocks.keys()
    for k in plain:
        assert plain[k][0] == blocks[k][0] and blocks[k][1] == pytest.approx(plain[k][1], abs=1e-7)
    assert blocks["a", "e"][1] is None


def test_vif(spark):
    a, b = gauss(200, seed=1), gauss(200, seed=2)
    df = spark.createDataFrame([(x, y, x + y, 1.0, z) for x, y, z in zip(a, b, gauss(200, seed=3))], "a double, b double, s double, one double, z double")
    got = {r["column"]: r["vif"] for r in st.vif(df).collect()}
    assert set(got) == {"a", "b", "s", "z"}
    assert got["a"] == got["b"] == got["s"] == 999.99 and got["z"] < 1.2
    assert st.vif(df, ["a", "one"]).count() == 0
    few = spark.createDataFrame([(1.0, None), (None, 2.0), (3.0, 5.0)], "x double, y double")
    assert st.vif(few).count() == 2


@pytest.mark.parametrize("f,d1,d2,p", [(1.0, 1, 1, 0.5), (4.0, 2, 10, (10 / 18) ** 5), (2.5, 4, 100, None), (0.0, 3, 9, 1.0)])
def test_f_tail(f, d1, d2, p):
    if p is None:
        x = d2 / (d2 + d1 * f)
        p = x ** (d2 / 2) * (1 + d2 / 2 * (1 - x))
    assert st.f_upper_tail(f, d1, d2) == pytest.approx(p, rel=1e-10)


def test_anova(spark):
    data = [("a", x) for x in (1.0, 2.0, 3.0)] + [("b", x) for x in (2.0, 3.0, 4.0)] + [("c", x) for x in (9.0, 10.0, 11.0)] + [("d", 5.0)]
    df = spark.createDataFrame(data, "g string, x double")
    r = st.anova(df, "g", "x").first()
    assert (r["groups"], r["n"]) == (3, 9) and r["f"] == pytest.approx(57.0) and r["p_text"] == "< 0.001"
    assert st.anova(df.filter("g in ('a', 'd')"), "g", "x").count() == 0
    assert {x["group"] for x in st.group_breakdown(df, "g", "x").collect()} == {"a", "b", "c"}


def pair(spark, xs, ys, kind="double"):
    return tuple(spark.createDataFrame([(v,) for v in vs], f"x {kind}") for vs in (xs, ys))


def test_drift_flags(spark):
    r = dr.drift_report(*pair(spark, [10.0] * 5, [12.0] * 5)).first()
    assert r["mean_shift_pct"] == 20.0 and "mean shift +20.0%" in r["flags"]
    r = dr.drift_report(*pair(spark, [0.0] * 3, [2.5] * 3)).first()
    assert r["near_zero_baseline"] and r["mean_shift_pct"] is None and "mean shift Δ+2.500 (baseline ≈ 0)" in r["flags"]
    r = dr.drift_report(*pair(spark, [1.0, 2.0, 3.0, 4.0], [1.0, None, 3.0, None])).first()
    assert "missingness Δ+50.0%" in r["flags"]
    a, b = spark.range(5).withColumnRenamed("id", "x"), spark.range(5).select(F.col("id").cast("double").alias("x"))
    r = dr.drift_report(a, b).first()
    assert not r["dtype_match"] and r["flags"] == "dtype bigint→double"
    same = dr.drift_report(a, a).first()
    assert same["flags"] == "OK"
    with pytest.raises(ValueError):
        dr.drift_report(a, a.withColumnRenamed("x", "y"))


def test_distribution_drift_without_a_mean_shift(spark):
    r = random.Random(5)
    uniform = [r.uniform(-math.sqrt(3), math.sqrt(3)) for _ in range(3000)]
    a, b = pair(spark, gauss(3000), uniform)
    got = dr.drift_report(a.withColumn("x", F.col("x") + 100), b.withColumn("x", F.col("x") + 100)).first()
    assert got["ks_p"] < 0.01 and "distribution drift" in got["flags"] and "mean shift" not in got["flags"]


def test_category_shift(spark):
    a, b = pair(spark, ["A"] * 80 + ["B"] * 20, ["A"] * 20 + ["B"] * 80, "string")
    assert dr.category_shift(a, b).first()["tvd"] == pytest.approx(0.6)
    assert dr.category_shift(b, a).first()["tvd"] == pytest.approx(0.6)
    long = [("x" * 100 + str(i % 2),) for i in range(40)]
    c = spark.createDataFrame(long, "x string")
    assert dr.category_shift(c, c.filter("endswith(x, '0')")).first()["tvd"] == pytest.approx(0.5)


def test_nested_columns_can_be_compared(spark):
    a = spark.sql("SELECT array(1, 2) AS l, map('k', 1) AS d UNION ALL SELECT array(1, 2), map('k', 2) UNION ALL SELECT NULL, NULL")
    b = spark.sql("SELECT array(id) AS l, map('k', id) AS d FROM range(4)")
    got = {r["column"]: (r["distinct_a"], r["distinct_b"]) for r in dr.distinct_counts(a, b).collect()}
    assert got == {"l": (1, 4), "d": (2, 4)}


def brute_ks(xs, ys):
    grid = sorted(set(xs) | set(ys))
    return max(abs(sum(x <= g for x in xs) / len(xs) - sum(y <= g for y in ys) / len(ys)) for g in grid)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(0, 12).map(float), min_size=10, max_size=60), hs.lists(hs.integers(3, 15).map(float), min_size=10, max_size=60))
def test_ks_is_exact_on_both_paths(spark, xs, ys):
    a, b = pair(spark, xs, ys)
    for limit in ("1000000", "9"):
        spark.conf.set("plumbline.task.rows", limit)
        got = dr.ks_statistics(a, b).first()
        spark.conf.unset("plumbline.task.rows")
        assert got["ks_stat"] == pytest.approx(brute_ks(xs, ys)) and 0 <= got["ks_p"] <= 1


def test_q_values(spark):
    ps = [0.001, 0.04, 0.03, 0.9, 0.5, 0.03]
    df = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(ps)], "column string, ks_p double")
    got = {r["column"]: r["ks_q"] for r in dr.benjamini_hochberg(df).collect()}
    order = sorted(range(len(ps)), key=lambda i: ps[i])
    want, low = {}, 1.0
    for rank in range(len(ps), 0, -1):
        i = order[rank - 1]
        low = min(low, ps[i] * len(ps) / rank, 1.0)
        want[f"c{i}"] = round(low, 4)
    assert got == want and all(got[f"c{i}"] >= round(p, 4) for i, p in enumerate(ps))


def test_verdicts_and_summary(spark):
    a = spark.range(100).select(F.col("id").alias("customer_id"), (F.col("id") % 7).cast("double").alias("spend"), F.lit("t").alias("tier"))
    b = a.withColumn("spend", F.col("spend") * 2)
    report = dr.drift_report(a, b)
    got = {r["column"]: (r["status"], r["cause"]) for r in dr.drift_verdicts(report, ["customer_id"]).collect()}
    assert got["customer_id"][0] == "ID / Key" and got["tier"] == ("Stable", "No significant change")
    assert got["spend"] == ("Drift detected", "Average shifted by +100.0%")
    s = dr.pair_summary(a, b, report).first()
    assert (s["matched_columns"], s["analytic_columns"], s["drifted_columns"]) == (3, 2, 1)
    assert dr.training_overlap(a, b, same_name=True).first()["verdict"] == "possible new version"
    assert dr.row_overlap(a, b).first()["overlapping"] == sum(1 for i in range(100) if i % 7 == 0)


def test_envelope_keeps_extremes(spark, split_small):
    data = [(i, math.sin(i / 50) if i != 1234 else 999.0) for i in range(3000)]
    df = spark.createDataFrame(data, "t long, v double").repartition(6)
    got = [(r["t"], r["v"]) for r in ch.line_series(df, "t", "v", max_points=200).select(F.col("x").alias("t"), F.col("y").alias("v")).collect()]
    assert len(got) <= 200 and got == sorted(got)
    assert (1234, 999.0) in got and min(v for _, v in got) == min(v for _, v in data)
    assert {0, 2999} <= {t for t, _ in got}


def test_envelope_when_all_times_are_equal(spark, split_small):
    df = spark.createDataFrame([(5, float(i), i) for i in range(400)], "t long, v double, k long")
    got = ch.downsample(df, "t", "v", 40, key=["k"])
    assert got.count() <= 40 and got.agg(F.max("v"), F.min("v")).first() == (399.0, 0.0)


def test_envelope_of_equal_rows_and_maps(spark, split_small):
    same = spark.range(300).selectExpr("1 as t", "2.0D as v", "map('a', 1) as m")
    got = ch.downsample(same, "t", "v", 40)
    assert 1 <= got.count() <= 40 and got.columns == ["t", "v", "m"]
    hues = spark.range(900).selectExpr("id as t", "double(id % 50) as v", "if(id % 3 = 0, 'hot', concat('h', id % 7)) as h", "repeat('x', 9) as wide")
    found = ch.downsample(hues, "t", "v", 64, "h").groupBy("h").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("t").alias("n")).collect()
    ends = hues.groupBy("h").agg(F.min("t"), F.max("t")).collect()
    assert {(r["h"], r["a"], r["b"]) for r in found} == {tuple(r) for r in ends} and all(r["n"] <= 8 for r in found)


def test_dates_as_text_sort_as_time(spark):
    df = spark.createDataFrame([("2023-12-01", 1), ("2023-01-01", 2), ("2023-06-01", 3)], "date string, val long")
    assert [r["y"] for r in ch.line_series(df, "date", "val").collect()] == [2, 3, 1]


def test_composition(spark):
    df = spark.createDataFrame([("a", -10)], "cat string, val long")
    with pytest.raises(ValueError, match="negative"):
        ch.composition(df, "cat", "val")
    many = spark.range(40).select(F.concat(F.lit("c"), "id").alias("cat"), (F.col("id") >= 10).cast("int").alias("v"))
    got = ch.composition(many, "cat", "v")
    assert got.filter("is_other").count() == 0 and got.count() == 30
    assert ch.composition(many, "cat").filter("is_other").first()["value"] == 10.0


def test_heatmap_keeps_the_widest_columns(spark):
    df = spark.range(20).select(*[(F.col("id") * (i + 1)).cast("double").alias(f"c{i}") for i in range(40)])
    names = {r["feature_a"] for r in ch.correlation_heatmap(df).collect()}
    assert names == {f"c{i}" for i in range(10, 40)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 9.99, 10.0, float("inf"), None)], "x double")
    assert [(r["bin"], r["count"]) for r in ch.histogram(df, "x", 10).orderBy("bin").collect()] == [(0, 1), (1, 1), (9, 2)]
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert rows(ch.histogram(flat, "x", 10)) == [(None, 0, 3.0, 3.0, 4)]


def test_scaling_edges(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0)], "x double, c double")
    r = fe.scale(df, ["x", "c"], "standard").collect()
    assert r[1]["x_scaled"] == pytest.approx(0.0) and {x["c_scaled"] for x in r} == {0.0}
    assert {x["c_scaled"] for x in fe.scale(df, ["c"], "minmax").collect()} == {0.0}
    with pytest.raises(ValueError):
        fe.scale(df, ["x"], "other")


def test_yeo_johnson_finds_the_likeliest_lambda(spark):
    xs = [math.exp(v) for v in gauss(400, 1, 0.6)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    lam = fe.fit_yeo_johnson(df, ["x"])["x"]

    def score(t):
        x = np.array(xs)
        y = ((x + 1) ** t - 1) / t if abs(t) > 1e-9 else np.log1p(x)
        return -len(x) / 2 * math.log(y.var()) + (t - 1) * np.log1p(x).sum()

    assert all(score(lam) >= score(lam + step) for step in (-0.01, 0.01))
    out = fe.power_transform(df, ["x"], "yeo-johnson").agg(F.avg("x_yeojohnson"), F.stddev_pop("x_yeojohnson")).first()
    assert out[0] == pytest.approx(0, abs=1e-9) and out[1] == pytest.approx(1)


def test_encoders_mark_missing_and_unseen(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    new = spark.createDataFrame([("b",), ("z",), (None,)], "c string")
    got = [r["c_encoded"] for r in fe.ordinal(new, ["c"], fit_on=train).orderBy(F.col("c").asc_nulls_first()).collect()]
    assert got == [0.0, 2.0, -1.0]
    assert fe.onehot(train, ["c"]).columns == ["c", "c_a", "c_b"]


def test_ordinal_with_a_hot_level(spark, split_small):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 200)).alias("c"))
    got = fe.ordinal(df, ["c"])
    levels = sorted({"hot"} | {f"v{i % 200}" for i in range(900) if i % 3})
    assert got.count() == 900
    assert all(levels[int(r["c_encoded"])] == r["c"] for r in got.collect())


def test_interaction_rules(spark):
    df = spark.createDataFrame([(6.0, 2.0), (1.0, 0.0), (None, 3.0)], "a double, b double")
    assert [r["a_div_b"] for r in fe.interaction(df, "a", "b", "ratio").collect()] == [3.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        fe.interaction(df, "a", "b", "power")
    with pytest.raises(KeyError):
        fe.interaction(df, "a", "zz", "sum")


def test_mutual_information_ranks_features(spark):
    df = spark.range(600).select((F.col("id") % 2).alias("y"), ((F.col("id") % 2) * 5 + F.col("id") % 3).alias("close"), (F.col("id") % 7).alias("far"))
    got = fe.mutual_information(df, "y", ["far", "close"], True).collect()
    assert got[0]["feature"] == "close" and got[0]["mutual_information"] == pytest.approx(math.log(2), rel=1e-6)
    assert got[1]["mutual_information"] < 0.01


def test_grouping_columns(spark):
    df = spark.range(60).select("id", (F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 2).alias("n"), F.concat(F.lit("u"), "id").alias("u"))
    got = [r["column"] for r in se.rank_grouping_columns(df).orderBy("position").collect()]
    assert got == ["g", "n", "id", "u"]


def test_tables_without_numbers_or_columns(spark):
    text = spark.createDataFrame([("a",), ("b",)], "t string")
    for table in (st.describe(text), st.normality(text), st.pearson_pairs(text), st.tukey_outliers(text), st.variance_table(text)):
        assert table.count() == 0
    assert st.pearson_pairs(spark.range(3)).count() == 0
    bare = spark.createDataFrame([()], "struct<>")
    assert pf.column_facts(bare).count() == 0 and pf.missing_columns(bare).count() == 0


def test_keys_of_every_type_order_like_themselves(spark, split_small):
    from decimal import Decimal

    from plumbline.functions.ranges import first_k
    from plumbline.operators.select import with_order

    texts = ["", "a", "ab", "a\0", "abcdefg", "é", "日本", *["z" * 20_000 + f"{i:03d}" for i in range(70)]]
    whole = [-(2**62), -1, 0, *[2**53 + i for i in range(70)], 2**62 + 2, 2**62 + 3]
    money = [Decimal(10**37 + i) for i in range(80)]
    days = [dt.date(1950, 1, 1) + dt.timedelta(days=i) for i in range(80)]
    floats = [float("-inf"), -1.5, *[i / 7 for i in range(70)], float("inf")]
    for kind, values in (("string", texts), ("long", whole), ("decimal(38,0)", money), ("date", days), ("double", floats)):
        ordered = sorted(values, key=lambda v: v.encode()) if kind == "string" else sorted(values)
        df = spark.createDataFrame([(v,) for v in [None, *values]], f"k {kind}").repartition(3)
        keyed, order = with_order(df, ["k"], None)
        assert len(order) == 1
        for k in (1, 2, 40, len(values)):
            got = [r["k"] for r in keyed.filter(first_k(keyed, order, k)).collect()]
            assert set(got) == {None, *ordered[: k - 1]} and len(got) == k, (kind, k)
