"""The distributed order helpers against brute force, on skewed data."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from plumbline.functions import ranges as rg


def skewed(n=2000, seed=7):
    """A third of the rows share one value, one key holds a third of the rows, some cells are missing."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        x = 5.0 if i % 3 == 0 else r.gauss(0, 10)
        if i % 17 == 0:
            x = None
        out.append((i, "hot" if i % 3 == 1 else f"k{i % 11}", x))
    return out


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(skewed(), "id long, k string, x double").repartition(5).cache()


def values(k=None):
    return [x for _, key, x in skewed() if x is not None and (k is None or key == k)]


@pytest.mark.parametrize("limit", ["1000000", "50"])
def test_quantiles_are_exact(spark, data, monkeypatch, limit):
    monkeypatch.setattr(rg, "SMALL_ROWS", 10)
    monkeypatch.setattr(rg, "SAMPLE_ROWS", 400)
    spark.conf.set(rg.TASK_ROWS, limit)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = rg.quantiles(data, ["x"], probs)["x"]
    spark.conf.unset(rg.TASK_ROWS)
    assert got == pytest.approx(list(np.quantile(values(), probs)))


def test_quantiles_with_a_misleading_sample(spark, data, monkeypatch):
    monkeypatch.setattr(rg, "SMALL_ROWS", 10)
    monkeypatch.setattr(rg, "SAMPLE_ROWS", 5)
    assert rg.quantiles(data, ["x"], [0.3, 0.9])["x"] == pytest.approx(list(np.quantile(values(), [0.3, 0.9])))


def test_quantiles_of_empty_columns(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert rg.quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_quantiles_by_group(spark, data, monkeypatch, split_small):
    monkeypatch.setattr(rg, "SMALL_ROWS", 10)
    got = {r["k"]: r["quantiles"] for r in rg.quantile_table(data, ["x"], [0.25, 0.5], by=["k"]).collect()}
    for k in {key for _, key, _ in skewed()}:
        assert got[k] == pytest.approx(list(np.quantile(values(k), [0.25, 0.5]))), k


def test_running_totals_within_a_hot_key(spark, data, split_small):
    df = data.filter("x is not null").withColumn("one", F.lit(1).cast("long"))
    got = {(r["k"], r["id"]): r["one_upto"] for r in rg.running_totals(df, ["k"], ["x", "id"], ["one"], 2000).collect()}
    seen = {}
    for i, k, x in sorted((t for t in skewed() if t[2] is not None), key=lambda t: (t[1], t[2], t[0])):
        seen[k] = seen.get(k, 0) + 1
        assert got[k, i] == seen[k]
    assert len(got) == len(values())


@pytest.mark.parametrize("k", [0, 1, 37, 700, 1999, 2000])
def test_first_k_among_ties(spark, data, split_small, k):
    df = data.withColumn("x", F.coalesce("x", F.lit(0.0)))
    got = {r["id"] for r in df.filter(rg.first_k(df, ["x", "id"], k)).collect()}
    order = sorted(((x or 0.0) if x is not None else 0.0, i) for i, _, x in skewed())
    assert got == {i for _, i in order[:k]}


def test_first_k_needs_a_total_order(spark, data):
    with pytest.raises(ValueError, match="unique key"):
        rg.first_k(data.withColumn("same", F.lit(1.0)), ["same"], 5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.integers(-5, 5).map(float), min_size=1, max_size=40))
def test_order_statistics_match_sorting(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    spark.conf.set(rg.TASK_ROWS, "7")
    got = rg.order_statistics(df, ["x"], [("mid", lambda n: F.floor((n - 1) / 2))]).first()
    spark.conf.unset(rg.TASK_ROWS)
    assert got["value"] == sorted(xs)[math.floor((len(xs) - 1) / 2)]
    assert got["column"] == "x" and got["n"] == len(xs)


def test_wanted_cells_do_not_move_the_rows(spark, split_small):
    """However small the broadcast threshold, exploded values meet the wanted cells where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        df = spark.range(2000).selectExpr("id % 37 as a", "id * 1.5 as b", "id % 3 as g")
        for by in ([], ["g"]):
            found = rg.order_statistics(df, ["a", "b"], [("m", lambda n: F.floor(n / 2))], by)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
            assert found.count() == 2 * max(1, 3 * len(by))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
