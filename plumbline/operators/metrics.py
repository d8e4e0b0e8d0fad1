"""Model metrics as aggregates over prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.exprs import divide, q, total

# Class names read as the positive one.
POSITIVE_NAMES = ("1", "true", "yes", "churn", "churned", "positive")
THRESHOLDS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def _zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return _zero(divide(2 * p * r, p + r))


def confusion_counts(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    return df.groupBy(q(actual).cast("string").alias("actual"), q(predicted).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )


def confusion_matrix(df: DataFrame, classes: Sequence[str], actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """``(actual, predicted, count)`` for every pair of classes, zeros included."""
    names = F.array(*[F.lit(str(c)) for c in classes])
    # classes x classes rows
    one = df.sparkSession.range(1)
    grid = one.select(F.explode(names).alias("actual")).select("actual", F.explode(names).alias("predicted"))
    listed = [str(c) for c in classes]
    counts = confusion_counts(df, actual, predicted).filter(F.col("actual").isin(listed) & F.col("predicted").isin(listed))
    return grid.join(F.broadcast(counts), ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).alias("count")
    )


def class_report(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """``(class, precision, recall, f1, support)`` per class seen on either side."""
    counts = confusion_counts(df, actual, predicted)
    hit = (F.col("actual") == F.col("predicted")).cast("long") * F.col("count")
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("tp"), F.col("count").alias("support"), none.alias("claimed")),
        F.struct(F.col("predicted").alias("class"), none.alias("tp"), none.alias("support"), F.col("count").alias("claimed")),
    )
    sums = counts.select(F.inline(sides)).groupBy("class").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("claimed").alias("claimed")
    )
    p, r = _zero(divide(F.col("tp"), F.col("claimed"))), _zero(divide(F.col("tp"), F.col("support")))
    return sums.select("class", p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), "support", "tp")


def classification_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: accuracy, support-weighted precision, recall and F1, macro F1; empty divisions count zero."""
    report = class_report(df, actual, predicted)
    n = F.sum("support")

    def weighted(c):
        return divide(F.sum(F.col(c) * F.col("support")), n).alias(c)

    return report.agg(
        n.alias("rows"),
        divide(F.sum("tp"), n).alias("accuracy"),
        weighted("precision"),
        weighted("recall"),
        weighted("f1"),
        F.avg("f1").alias("f1_macro"),
    )


def positive_class(classes: Sequence[str]) -> str | None:
    """The class counted as positive of a two-class target."""
    if len(classes) != 2:
        return None
    return next((c for c in classes if str(c).strip().lower() in POSITIVE_NAMES), classes[1])


def positive_metrics(df: DataFrame, positive: str, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row ``(positive_class, precision, recall, f1, support)``."""
    is_pos, said = q(actual).cast("string") == positive, q(predicted).cast("string") == positive
    sums = df.agg(F.count_if(is_pos & said).alias("tp"), F.count_if(is_pos).alias("support"), F.count_if(said).alias("claimed"))
    p, r = _zero(divide(F.col("tp"), F.col("claimed"))), _zero(divide(F.col("tp"), F.col("support")))
    return sums.select(F.lit(positive).alias("positive_class"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), "support")


def threshold_metrics(
    df: DataFrame,
    positive: str,
    actual: str = "label",
    probability: str = "probability",
    thresholds: Sequence[float] = THRESHOLDS,
) -> DataFrame:
    """Binary metrics at every threshold from a single pass.

    Rows are counted by how many thresholds their probability reaches, so a sweep costs no more than one
    threshold: the counts per step (thresholds + 1 of them) give every confusion matrix.
    """
    steps = sorted(thresholds)
    reached = total([(q(probability) >= F.lit(float(t))).cast("int") for t in steps])
    known = df.filter(q(actual).isNotNull() & q(probability).isNotNull())
    is_pos = q(actual).cast("string") == positive
    counts = known.groupBy(reached.alias("step")).agg(F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg"))
    entries = []
    for i, t in enumerate(steps):
        above = F.col("step") > i
        entries.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
                F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
                F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
                F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
            )
        )
    table = counts.agg(F.array(*entries).alias("t")).select(F.inline("t")).filter(F.col("tp").isNotNull())
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n, pos, neg = tp + fp + tn + fn, tp + fn, tn + fp
    p1, r1 = _zero(divide(tp, tp + fp)), _zero(divide(tp, pos))
    p0, r0 = _zero(divide(tn, tn + fn)), _zero(divide(tn, neg))
    f1, f0 = _f1(p1, r1), _f1(p0, r0)
    # a class that is neither present nor predicted does not enter the macro mean
    in1, in0 = ((tp + fp + fn) > 0).cast("int"), ((tn + fp + fn) > 0).cast("int")
    root = F.sqrt((tp + fp) * pos) * F.sqrt(neg * (tn + fn))
    return table.select(
        "threshold",
        "tp",
        "fp",
        "tn",
        "fn",
        divide(tp + tn, n).alias("accuracy"),
        divide(p1 * pos + p0 * neg, n).alias("precision"),
        divide(r1 * pos + r0 * neg, n).alias("recall"),
        divide(f1 * pos + f0 * neg, n).alias("f1"),
        divide(f1 * in1 + f0 * in0, in1 + in0).alias("f1_macro"),
        _zero(divide(tp * tn - fp * fn, root)).alias("mcc"),
        p1.alias("positive_precision"),
        r1.alias("positive_recall"),
        f1.alias("positive_f1"),
        pos.cast("long").alias("positive_support"),
    )


def regression_metrics(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: rows, R squared, MAE, MSE and RMSE."""
    y, p = q(actual).cast("double"), q(predicted).cast("double")
    err = y - p
    sums = df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(err * err).alias("mse"),
        F.var_pop(y).alias("spread"),
    )
    r2 = F.when(F.col("spread") > 0, 1 - divide(F.col("mse"), F.col("spread"))).otherwise(
        F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select("rows", r2.alias("r2"), "mae", "mse", F.sqrt("mse").alias("rmse"))


def residuals(df: DataFrame, actual: str = "label", predicted: str = "prediction", keys: Sequence[str] = ()) -> DataFrame:
    """``(keys..., actual, predicted, residual)`` per row."""
    y, p = q(actual).cast("double"), q(predicted).cast("double")
    return df.select(*[q(k) for k in keys], y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))


def actual_predicted_range(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row ``(low, high)``: common axis of the actual-versus-predicted points, finite values only."""
    cells = [F.when(F.abs(q(c).cast("double")) != float("inf"), F.nanvl(q(c).cast("double"), F.lit(None).cast("double"))) for c in (actual, predicted)]
    return df.agg(F.least(F.min(cells[0]), F.min(cells[1])).alias("low"), F.greatest(F.max(cells[0]), F.max(cells[1])).alias("high"))


def majority_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Metrics of always answering the most frequent training class (ties: smallest)."""
    counts = train.filter(q(target).isNotNull()).groupBy(q(target).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), "k").first()
    guess = test.select(q(target).alias("label"), F.lit(best["k"] if best else None).alias("prediction"))
    return classification_metrics(guess)


def mean_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Metrics of always answering the training mean."""
    mean = train.agg(F.avg(q(target).cast("double"))).first()[0]
    guess = test.select(q(target).cast("double").alias("label"), F.lit(mean).cast("double").alias("prediction"))
    return regression_metrics(guess)


def baseline_verdict(score: float, baseline: float) -> str:
    """below, parity (within three points of a strong baseline) or above."""
    if score < baseline:
        return "below"
    return "parity" if score - baseline <= 0.03 and baseline > 0.70 else "above"
