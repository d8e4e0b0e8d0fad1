"""Split, fold, metric and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import score
from plumbline.operators import metrics as mx
from plumbline.operators import modeling as ml
from plumbline.operators import splits as sp
from plumbline.plans.registry import query, sql, union_sql
from plumbline.session import scratch_path
from plumbline.sources import readers

# predictions made by a plain rule, so that metrics can be checked without a model
GUESSES = """g AS (SELECT doc_id, CASE quality WHEN 1 THEN 'yes' ELSE 'no' END AS label,
 CASE WHEN n_chars % 10 < 7 THEN 'yes' ELSE 'no' END AS prediction, (n_chars % 97) / 96.0 AS probability FROM labels JOIN documents USING (doc_id))"""
FLAGS = """g AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 35 THEN 'N' ELSE 'R' END AS prediction FROM lineitem)"""
PRICES = """g AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS label, l_quantity * 1500.0 AS prediction FROM lineitem)"""


def guesses(t):
    n = F.col("n_chars")
    return t.labels.join(t.documents, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"),
        F.when(n % 10 < 7, "yes").otherwise("no").alias("prediction"),
        ((n % 97) / 96.0).alias("probability"),
    )


def flags(t):
    qty = F.col("l_quantity")
    return t.lineitem.select(F.col("l_returnflag").alias("label"), F.when(qty < 15, "A").when(qty < 35, "N").otherwise("R").alias("prediction"))


def prices(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500.0).alias("prediction"))


@query("m1_validate_training", sql("SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1", "", "n"))
def _(t):
    facts = ml.validate_training(t.lineitem, "l_returnflag", ["l_quantity", "l_discount", "l_linestatus"], "Classification")
    return t.spark.createDataFrame(list(facts["classes"].items()), "class string, n long")


@query(
    "m2_encoded_width",
    sql(
        """SELECT count(*) AS "rows", 2 AS "numeric", count(DISTINCT p_brand) + count(DISTINCT p_name) AS levels, 2 + count(DISTINCT p_brand) + count(DISTINCT p_name) AS width,
 count(*) * (2 + count(DISTINCT p_brand) + count(DISTINCT p_name)) AS cells,
 concat_ws(', ', CASE WHEN count(DISTINCT p_brand) > 50 THEN 'p_brand' END, CASE WHEN count(DISTINCT p_name) > 50 THEN 'p_name' END) AS wide_columns FROM part""",
        "",
        '"rows" "numeric" levels width cells',
    ),
)
def _(t):
    return ml.encoded_width(t.part, ["p_size", "p_retailprice", "p_brand", "p_name"])


def hash_sql(seed, key):
    return f"CAST(('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)"


@query(
    "m3_random_split",
    sql(
        f"SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}, {hash_sql(43, 'o_orderkey')}) <= ceil(count(*) OVER () * 0.2) AS is_test FROM orders",
        "",
        "o_orderkey",
    ),
)
def _(t):
    return sp.random_split(t.orders.select("o_orderkey"), ["o_orderkey"], 0.2)


@query(
    "m4_stratified_split",
    sql(
        f"""WITH c AS (SELECT o_orderstatus, count(*) AS n, sum(count(*)) OVER () AS total, ceil(sum(count(*)) OVER () * 0.2)::BIGINT AS want FROM orders GROUP BY 1),
f AS (SELECT *, (n * want) // total AS base, (n * want) % total AS rest FROM c),
k AS (SELECT *, base + (row_number() OVER (ORDER BY rest DESC, o_orderstatus) <= want - sum(base) OVER ())::INT AS size FROM f)
;;SELECT o_orderkey, o.o_orderstatus, row_number() OVER (PARTITION BY o.o_orderstatus ORDER BY {hash_sql(42, 'o_orderkey')}, {hash_sql(43, 'o_orderkey')}) <= size AS is_test
 FROM orders o JOIN k ON o.o_orderstatus = k.o_orderstatus""",
        "",
        "o_orderkey",
    ),
)
def _(t):
    return sp.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 0.2)[0]


@query(
    "m5_chronological_split",
    sql(
        """SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) > count(*) OVER () - ceil(count(*) OVER () * 0.2) AS is_test FROM orders""",
        "",
        "o_orderkey",
    ),
)
def _(t):
    return sp.chronological_split(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderkey"], 0.2)


@query(
    "m6_folds",
    sql(
        f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}, {hash_sql(43, 'o_orderkey')}) - 1 AS pos, count(*) OVER () AS n FROM orders)
;;SELECT o_orderkey, list_sum(list_transform(range(1, 5), lambda i: (pos >= (n * i) // 5)::INT)) AS fold FROM r""",
        "",
        "o_orderkey fold",
    ),
)
def _(t):
    return sp.add_folds(t.orders.select("o_orderkey"), 5, ["o_orderkey"])


@query(
    "m6_stratified_folds",
    sql(
        f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql(42, 'o_orderkey')}) - 1 AS pos,
 count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
;;SELECT o_orderkey, o_orderstatus, list_sum(list_transform(range(1, 5), lambda i: (pos >= (n * i) // 5)::INT)) AS fold FROM r""",
        "",
        "o_orderkey fold",
    ),
)
def _(t):
    return sp.add_folds(t.orders.select("o_orderkey", "o_orderstatus"), 5, ["o_orderkey"], stratify="o_orderstatus")


@query(
    "m6_time_folds",
    sql(
        """WITH r AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
;;SELECT o_orderkey, o_orderdate, list_sum(list_transform(range(0, 5), lambda i: (pos >= n - (5 - i) * (n // 6))::INT)) AS fold FROM r""",
        "",
        "o_orderkey fold",
    ),
)
def _(t):
    return sp.add_time_folds(t.orders.select("o_orderkey", "o_orderdate"), 5, ["o_orderkey"])


@query("m7_preprocessed_features")
def _(t):
    train = t.part
    stages = ml.fit_preprocessor(train, ["p_size", "p_retailprice"], ["p_type"])
    ready = ml.PipelineModel(stages).transform(train)
    return ready.select("p_partkey", ml.vector_to_array("features").alias("features"))


_M10 = """cls AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS tp, count(*) FILTER (label = c) AS sup, count(*) FILTER (prediction = c) AS cl
 FROM g, (SELECT DISTINCT label AS c FROM g UNION SELECT prediction FROM g) GROUP BY 1),
m AS (SELECT c, tp, sup, coalesce(tp * 1.0 / nullif(cl, 0), 0) AS p, coalesce(tp * 1.0 / nullif(sup, 0), 0) AS r FROM cls),
f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM m)"""
_SCORES = """SELECT sum(sup) AS "rows", sum(tp) * 1.0 / sum(sup) AS accuracy, sum(p * sup) / sum(sup) AS precision, sum(r * sup) / sum(sup) AS recall,
 sum(f1 * sup) / sum(sup) AS f1, avg(f1) AS f1_macro FROM f"""


@query("m10_classification_metrics", sql(f"WITH {FLAGS}, {_M10};;{_SCORES}", "accuracy precision recall f1 f1_macro", '"rows"'))
def _(t):
    return mx.classification_metrics(flags(t))


@query(
    "m10_class_report",
    sql(f'WITH {FLAGS}, {_M10};;SELECT c AS "class", p AS precision, r AS recall, f1, sup AS support, tp FROM f', "precision recall f1", "support tp"),
)
def _(t):
    return mx.class_report(flags(t))


@query(
    "m11_confusion_matrix",
    sql(
        f"""WITH {GUESSES}, k AS (SELECT unnest(['no', 'yes', 'maybe']) AS c)
;;SELECT a.c AS actual, b.c AS predicted, (SELECT count(*) FROM g WHERE label = a.c AND prediction = b.c) AS "count" FROM k a, k b""",
        "",
        '"count"',
    ),
)
def _(t):
    return mx.confusion_matrix(guesses(t), ["no", "yes", "maybe"])


@query(
    "m12_positive_metrics",
    sql(
        f"""WITH {GUESSES}, s AS (SELECT count(*) FILTER (label = 'yes' AND prediction = 'yes') AS tp, count(*) FILTER (label = 'yes') AS support, count(*) FILTER (prediction = 'yes') AS cl FROM g)
;;SELECT 'yes' AS positive_class, tp * 1.0 / cl AS precision, tp * 1.0 / support AS recall, 2.0 * tp / (cl + support) AS f1, support FROM s""",
        "precision recall f1",
        "support",
    ),
)
def _(t):
    return mx.positive_metrics(guesses(t), mx.positive_class(["no", "yes"]))


@query(
    "m13_regression_metrics",
    sql(
        f"""WITH {PRICES}, s AS (SELECT count(*) AS n, avg(abs(label - prediction)) AS mae, avg(pow(label - prediction, 2)) AS mse, var_pop(label) AS v FROM g)
;;SELECT n AS "rows", 1 - mse / v AS r2, mae, mse, sqrt(mse) AS rmse FROM s""",
        "r2 mae mse rmse",
        '"rows"',
        digits=2,
    ),
    digits=2,
)
def _(t):
    return mx.regression_metrics(prices(t))


@query(
    "m13_residuals",
    sql(
        f"WITH {PRICES};;SELECT l_orderkey, l_linenumber, label AS actual, prediction AS predicted, label - prediction AS residual FROM g",
        "actual predicted residual",
        "l_orderkey l_linenumber",
        digits=2,
    ),
    digits=2,
)
def _(t):
    return mx.residuals(prices(t), keys=["l_orderkey", "l_linenumber"])


@query(
    "m13_actual_predicted_range",
    sql(f"WITH {PRICES};;SELECT least(min(label), min(prediction)) AS low, greatest(max(label), max(prediction)) AS high FROM g", "low high"),
)
def _(t):
    return mx.actual_predicted_range(prices(t))


_HALVES = "WITH tr AS (SELECT * FROM lineitem WHERE l_linenumber <= 5), te AS (SELECT * FROM lineitem WHERE l_linenumber > 5)"


def _halves(t):
    return t.lineitem.filter("l_linenumber <= 5"), t.lineitem.filter("l_linenumber > 5")


@query(
    "m14_majority_baseline",
    sql(
        f"""{_HALVES}, g AS (SELECT l_returnflag AS label, (SELECT l_returnflag FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS prediction FROM te), {_M10};;{_SCORES}""",
        "accuracy precision recall f1 f1_macro",
        '"rows"',
    ),
)
def _(t):
    return mx.majority_baseline(*_halves(t), "l_returnflag")


@query(
    "m14_mean_baseline",
    sql(
        f"""{_HALVES}, g AS (SELECT l_extendedprice AS label, (SELECT avg(l_extendedprice) FROM tr) AS prediction FROM te),
s AS (SELECT count(*) AS n, avg(abs(label - prediction)) AS mae, avg(pow(label - prediction, 2)) AS mse, var_pop(label) AS v FROM g)
;;SELECT n AS "rows", 1 - mse / v AS r2, mae, mse, sqrt(mse) AS rmse FROM s""",
        "r2 mae mse rmse",
        '"rows"',
        digits=2,
    ),
    digits=2,
)
def _(t):
    return mx.mean_baseline(*_halves(t), "l_extendedprice")


def _threshold_sql(steps):
    grid = union_sql(f"SELECT CAST({t} AS DOUBLE) AS threshold" for t in steps)
    return f"""WITH {GUESSES}, grid AS ({grid}),
c AS (SELECT threshold, count(*) FILTER (label = 'yes' AND probability >= threshold) AS tp, count(*) FILTER (label = 'no' AND probability >= threshold) AS fp,
 count(*) FILTER (label = 'no' AND probability < threshold) AS tn, count(*) FILTER (label = 'yes' AND probability < threshold) AS fn FROM g, grid GROUP BY 1),
p AS (SELECT *, (tp + fp + tn + fn)::DOUBLE AS n, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS p1, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS r1,
 coalesce(tn * 1.0 / nullif(tn + fn, 0), 0) AS p0, coalesce(tn * 1.0 / nullif(tn + fp, 0), 0) AS r0 FROM c),
f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM p)
;;SELECT threshold, tp, fp, tn, fn, (tp + tn) / n AS accuracy, (p1 * (tp + fn) + p0 * (tn + fp)) / n AS precision, (r1 * (tp + fn) + r0 * (tn + fp)) / n AS recall,
 (f1 * (tp + fn) + f0 * (tn + fp)) / n AS f1, (f1 + f0) / 2 AS f1_macro,
 coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc,
 p1 AS positive_precision, r1 AS positive_recall, f1 AS positive_f1, tp + fn AS positive_support FROM f"""


_T_DOUBLES = "threshold accuracy precision recall f1 f1_macro mcc positive_precision positive_recall positive_f1"
_T_COUNTS = "tp fp tn fn positive_support"


@query("m17_metrics_at_threshold", sql(_threshold_sql([0.3]), _T_DOUBLES, _T_COUNTS))
def _(t):
    return mx.threshold_metrics(guesses(t), "yes", thresholds=[0.3])


@query("m18_threshold_sweep", sql(_threshold_sql(mx.THRESHOLDS), _T_DOUBLES, _T_COUNTS))
def _(t):
    return mx.threshold_metrics(guesses(t), "yes")


# ---- queries that fit models: checked by row counts and by unit tests ------------------------------


def _documents(t):
    joined = t.labels.join(t.documents, "doc_id")
    return joined.select("doc_id", "n_chars", F.length("text").alias("length"), "lang", "source", "toxic", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("quality"))


_FEATURES = ["n_chars", "length", "lang", "toxic"]


def _metric_rows(t, scores):
    rows = [(k, float(v)) for k, v in scores.items() if isinstance(v, (int, float))]
    return t.spark.createDataFrame(rows, "measure string, value double")


@query("m8_logistic_regression_scores")
def _(t):
    return _metric_rows(t, ml.train_model(_documents(t), "quality", _FEATURES, "Logistic Regression", "Classification", ["doc_id"]).scores)


@query("m8_random_forest_scores")
def _(t):
    trained = ml.train_model(_documents(t), "quality", _FEATURES, "Random Forest", "Classification", ["doc_id"])
    return _metric_rows(t, trained.scores)


@query("m8_decision_tree_scores")
def _(t):
    trained = ml.train_model(_documents(t), "quality", _FEATURES, "Decision Tree", "Classification", ["doc_id"])
    return _metric_rows(t, trained.scores)


@query("m8_gradient_boosting_scores")
def _(t):
    trained = ml.train_model(_documents(t), "quality", _FEATURES, "Gradient Boosting", "Classification", ["doc_id"])
    return _metric_rows(t, trained.scores)


_ORDER_FEATURES = ["o_orderstatus", "o_orderpriority", "o_orderdate", "o_custkey"]


@query("m9_ridge_regression_scores")
def _(t):
    return _metric_rows(t, ml.train_model(t.orders, "o_totalprice", _ORDER_FEATURES, "Ridge Regression", "Regression", ["o_orderkey"]).scores)


@query("m9_random_forest_scores")
def _(t):
    # with its five folds 189 s at sf0.01: hundred deep trees on every order, six times; see README
    trained = ml.train_model(t.orders, "o_totalprice", _ORDER_FEATURES, "Random Forest", "Regression", ["o_orderkey"], validate=False)
    return _metric_rows(t, trained.scores)


@query("m9_gradient_boosting_scores")
def _(t):
    trained = ml.train_model(t.orders, "o_totalprice", _ORDER_FEATURES, "Gradient Boosting", "Regression", ["o_orderkey"])
    return _metric_rows(t, trained.scores)


@query(
    "m9_linear_regression_fit",
    sql("SELECT o_orderkey, regr_intercept(o_totalprice, o_custkey) OVER () + regr_slope(o_totalprice, o_custkey) OVER () * o_custkey AS prediction FROM orders", "prediction", "o_orderkey", digits=1),
    digits=1,
)
def _(t):
    pipe, _ = ml.fit_model(t.orders, "o_totalprice", ["o_custkey"], "Linear Regression", "Regression")
    return ml.apply_model(pipe, t.orders, "Regression", []).select("o_orderkey", F.col("__pred").alias("prediction"))


# the same line per fold: fitted on the other folds of the training rows, judged on its own
_LINE_FOLDS = f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}, {hash_sql(43, 'o_orderkey')}) - 1 AS p, ceil(count(*) OVER () * 0.2) AS cut FROM orders),
r AS (SELECT o_custkey AS x, o_totalprice AS y, row_number() OVER (ORDER BY p) - 1 AS pos, count(*) OVER () AS n FROM s WHERE p >= cut),
f AS (SELECT x, y, list_sum(list_transform(range(1, 5), lambda i: (pos >= (n * i) // 5)::INT)) AS fold FROM r),
k AS (SELECT unnest(range(5)) AS fold),
w AS (SELECT k.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM k JOIN f ON f.fold <> k.fold GROUP BY 1),
e AS (SELECT fold, count(*) AS n, avg(abs(y - a * x - b)) AS mae, avg(pow(y - a * x - b, 2)) AS mse, var_pop(y) AS v FROM f JOIN w USING (fold) GROUP BY 1)
;;SELECT fold, n AS "rows", 1 - mse / v AS r2, mae, mse, sqrt(mse) AS rmse FROM e"""


@query("m15_line_per_fold", sql(_LINE_FOLDS, "r2 mae mse rmse", 'fold "rows"', digits=2), digits=2)
def _(t):
    return ml.train_model(t.orders, "o_totalprice", ["o_custkey"], "Linear Regression", "Regression", ["o_orderkey"]).folds


@query("m15_cross_validation")
def _(t):
    trained = ml.train_model(t.orders, "o_totalprice", _ORDER_FEATURES, "Linear Regression", "Regression", ["o_orderkey"])
    return trained.folds


@query("m16_out_of_fold")
def _(t):
    return ml.train_model(_documents(t), "quality", _FEATURES, "Logistic Regression", "Classification", ["doc_id"]).out_of_fold


@query("m19_feature_importance")
def _(t):
    trained = ml.train_model(_documents(t), "quality", _FEATURES, "Random Forest", "Classification", ["doc_id"])
    return ml.grouped_importances(trained.importances)


# a line fitted on the rows that the seeded split leaves for training, applied to all rows
_LINE = f"""WITH s AS (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'o_orderkey')}, {hash_sql(43, 'o_orderkey')}) <= ceil(count(*) OVER () * 0.2) AS is_test FROM orders),
f AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM s WHERE NOT is_test)
;;SELECT o_orderkey, a * o_custkey + b AS prediction FROM orders, f"""


def _line(t):
    return ml.train_model(t.orders, "o_totalprice", ["o_custkey"], "Linear Regression", "Regression", ["o_orderkey"], validate=False)


@query("m20_m21_save_load_score", sql(_LINE, "prediction", "o_orderkey", digits=1), digits=1)
def _(t):
    loaded = ml.load_model(t.spark, ml.save_model(_line(t), scratch_path(t.spark, "model")))
    return ml.score(loaded, t.orders).select("o_orderkey", "prediction")


@query(
    "m21_unseen_levels",
    sql("SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS level, count(*) AS \"rows\" FROM orders WHERE o_orderpriority < '3' GROUP BY 2", "", '"rows"'),
)
def _(t):
    known = t.orders.filter("o_orderpriority >= '3'")
    trained = ml.train_model(known, "o_totalprice", ["o_custkey", "o_orderpriority", "o_orderstatus"], "Linear Regression", "Regression", ["o_orderkey"], validate=False)
    return ml.write_scored(trained, t.orders, lambda scored: scored.write.parquet(scratch_path(t.spark, "scored"))).unseen


@query(
    "m21_threshold_applied",
    sql("SELECT doc_id, TRUE AS consistent FROM labels JOIN documents USING (doc_id)", "", "doc_id"),
)
def _(t):
    docs = _documents(t)
    trained = ml.train_model(docs, "quality", _FEATURES, "Logistic Regression", "Classification", ["doc_id"], validate=False)
    out = ml.score(trained, docs, threshold=0.7)
    return out.select("doc_id", ((F.col("probability") >= 0.7) == (F.col("prediction") == "yes")).alias("consistent"))


@query("m22_scoring_job", sql(_LINE, "prediction", "o_orderkey", digits=1), digits=1)
def _(t):
    model, out = ml.save_model(_line(t), scratch_path(t.spark, "model")), scratch_path(t.spark, "scored") + ".csv"
    score.main(["--model", model, "--input", f"{t.folder}/orders.parquet", "--output", out])
    return readers.read_delimited(t.spark, out, sep=",", encoding="UTF-8").select("o_orderkey", F.col("prediction").cast("double").alias("prediction"))


@query(
    "m5_chronological_text_key",
    sql(
        """WITH o AS (SELECT 'order ' || o_orderkey AS k, o_orderdate FROM orders)
;;SELECT k, row_number() OVER (ORDER BY o_orderdate, k) > count(*) OVER () - ceil(count(*) OVER () * 0.2) AS is_test FROM o"""
    ),
)
def _(t):
    o = t.orders.select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("k"), "o_orderdate")
    return sp.chronological_split(o, ["k"], 0.2).select("k", "is_test")


@query(
    "m5_chronological_big_key",
    sql(
        """WITH o AS (SELECT o_orderkey + 1152921504606846976 AS k, o_orderdate FROM orders)
;;SELECT k, row_number() OVER (ORDER BY o_orderdate, k) > count(*) OVER () - ceil(count(*) OVER () * 0.2) AS is_test FROM o""",
        "",
        "k",
    ),
)
def _(t):
    o = t.orders.select((F.col("o_orderkey") + F.lit(1 << 60)).alias("k"), "o_orderdate")
    return sp.chronological_split(o, ["k"], 0.2).select("k", "is_test")


@query(
    "m4_stratified_split_many_classes",
    sql(
        """WITH d AS (SELECT o_orderkey, 'customer ' || o_custkey AS who FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)),
c AS (SELECT who, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS total, ceil(sum(count(*)) OVER () * 0.2)::BIGINT AS want FROM d GROUP BY 1),
f AS (SELECT *, (n * want) // total AS base, (n * want) % total AS rest FROM c),
k AS (SELECT *, base + (row_number() OVER (ORDER BY rest DESC, who) <= want - sum(base) OVER ())::INT AS size FROM f)
;;SELECT o_orderkey, d.who, row_number() OVER (PARTITION BY d.who ORDER BY o_orderkey) <= size AS is_test FROM d JOIN k ON d.who = k.who""",
        "",
        "o_orderkey",
    ),
)
def _(t):
    # a class per customer: sizes and cut keys stay tables
    often = t.orders.groupBy("o_custkey").count().filter("count > 1").select("o_custkey")
    d = t.orders.join(often, "o_custkey", "left_semi").select("o_orderkey", F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("who"))
    return sp.stratified_split(d, "who", ["o_orderkey"], 0.2, None)[0]


@query(
    "m6_folds_of_many_classes",
    sql(
        """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos,
 count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
;;SELECT o_orderkey, o_custkey, list_sum(list_transform(range(1, 5), lambda i: (pos >= (n * i) // 5)::INT)) AS fold FROM r""",
        "",
        "o_orderkey o_custkey fold",
    ),
)
def _(t):
    return sp.add_folds(t.orders.select("o_orderkey", "o_custkey"), 5, ["o_orderkey"], None, stratify="o_custkey")


@query(
    "m5_chronological_long_key",
    sql(
        """WITH o AS (SELECT o_orderkey, repeat('order of a customer, ', 200) || o_orderpriority || o_orderkey AS k, o_orderdate FROM orders)
;;SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, k) > count(*) OVER () - ceil(count(*) OVER () * 0.2) AS is_test FROM o""",
        "",
        "o_orderkey",
    ),
)
def _(t):
    key = F.concat(F.repeat(F.lit("order of a customer, "), 200), *[F.col(c).cast("string") for c in ("o_orderpriority", "o_orderkey")])
    return sp.chronological_split(t.orders.select("o_orderkey", key.alias("k"), "o_orderdate"), ["k"], 0.2).select("o_orderkey", "is_test")
