"""Training, validating, saving and applying models; the fitting itself is MLlib's."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pyspark
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.feature import Bucketizer, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.exprs import field_type, free_name, is_temporal, number, numeric_columns, q, text_columns
from plumbline.functions.ranges import quantile_table, quantiles
from plumbline.functions.wide import distinct_counts, level_counts, union_all
from plumbline.operators import metrics as mx
from plumbline.operators import splits as sp
from plumbline.operators.drift import unseen_level_rows, unseen_levels
from plumbline.operators.select import non_finite_columns, require_numeric
from plumbline.session import materialize, stored
from plumbline.sources.tables import fingerprint, file_signatures

FORMAT_VERSION = 1
TRAIN_CELLS = 5_000_000
WIDE_LEVELS = 50
TOP_FEATURES = 15
#: folds that are fitted side by side
PARALLEL_FITS = 4
#: bins of a number in trees: MLlib's default
TREE_BINS = 32
#: trees of more rows are fitted on cells; MLlib takes its own bins from a sample of so many rows
CELL_ROWS = 10_000
#: parts of a cell that a forest draws apart
FOREST_PARTS = 8
#: most cells in a partition of a fit
CELLS_A_TASK = 50_000
#: cells of a forest that are worth a task of their own, as every tree looks at every cell
FOREST_CELLS_A_TASK = 1_000
# fixed values: names of the models, and below their settings
CLASSIFIERS = ("Random Forest", "Decision Tree", "Gradient Boosting", "Logistic Regression")
TREES = ("Random Forest", "Decision Tree", "Gradient Boosting")
REGRESSORS = ("Random Forest", "Gradient Boosting", "Ridge Regression", "Linear Regression")


# ---- checks before training ----------------------------------------------------------------------


def class_label(df: DataFrame, target: str) -> Column:
    """A class as text; whole numbers lose their decimal point."""
    kind = field_type(df, target)
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        x = q(target).cast("double")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
    return q(target).cast("string")


def split_features(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Feature columns treated as numbers (dates included) and as categories."""
    numeric = [c for c in features if c in numeric_columns(df) or is_temporal(field_type(df, c))]
    return numeric, [c for c in features if c not in numeric]


def validate_training(df: DataFrame, target: str, features: Sequence[str], problem: str, fraction: float = 0.2) -> dict:
    """Check a training request; returns the facts learned, or an error that says what to fix."""
    if problem not in ("Classification", "Regression"):
        raise ValueError("the problem type must be Classification or Regression")
    if target not in df.columns:
        raise ValueError(f"target column not found: {target}")
    if not features:
        raise ValueError("choose at least one feature column")
    if target in features:
        raise ValueError(f"target column {target!r} must not be a feature: it would leak the answer")
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"feature columns not found: {', '.join(absent)}")
    y = number(df, target) if target in numeric_columns(df) else q(target)
    known = df.filter(y.isNotNull())
    if problem == "Regression":
        value = y.cast("string").try_cast("double") if target not in numeric_columns(df) else y
        facts = known.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(value).alias("parsed"),
            F.count_if(F.abs(value) == float("inf")).alias("infinite"),
        ).first()
        classes = None
        if facts["rows"] < 4:
            raise ValueError("at least 4 rows with a target are needed")
        if facts["parsed"] < facts["rows"]:
            raise ValueError("a regression target must hold only numbers")
        if facts["infinite"]:
            raise ValueError(f"regression target {target!r} holds infinite values")
        if math.ceil(facts["rows"] * fraction) < 2:
            raise ValueError("regression needs at least two test rows")
        rows = facts["rows"]
    else:
        classes = sp.class_counts(known.select(class_label(known, target).alias("y")), "y")
        rows = sum(classes.values())
        if rows < 4:
            raise ValueError("at least 4 rows with a target are needed")
        if len(classes) < 2:
            raise ValueError("classification needs at least two classes")
        if min(classes.values()) < 2:
            raise ValueError("each class needs at least two rows")
    bad = non_finite_columns(known, features)
    if bad:
        raise ValueError(f"features hold infinite values: {', '.join(bad)}; clean or clip them first")
    return {"rows": rows, "classes": classes}


def encoded_width(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row ``(rows, numeric, levels, width, cells, wide_columns)``: size of the encoded training matrix."""
    numeric, categorical = split_features(df, features)
    found = distinct_counts(df, categorical)
    counts = [F.lit(max(found[c], 1)).alias(f"k{i}") for i, c in enumerate(categorical)]
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    levels = sum((F.col(f"k{i}") for i in range(len(categorical))), F.lit(0)).cast("long")
    wide = [F.when(F.col(f"k{i}") > WIDE_LEVELS, F.lit(c)) for i, c in enumerate(categorical)]
    width = levels + len(numeric)
    return facts.select(
        "rows",
        F.lit(len(numeric)).cast("long").alias("numeric"),
        levels.alias("levels"),
        width.alias("width"),
        (F.col("rows") * width).alias("cells"),
        F.concat_ws(", ", *wide).alias("wide_columns") if wide else F.lit("").alias("wide_columns"),
    )


def check_width(df: DataFrame, features: Sequence[str], max_cells: int | None = TRAIN_CELLS) -> None:
    if max_cells is None:
        return
    facts = encoded_width(df, features).first()
    if facts["cells"] > max_cells:
        hint = f" (many levels: {facts['wide_columns']})" if facts["wide_columns"] else ""
        raise ValueError(f"{facts['rows']:,} rows x {facts['width']:,} encoded features exceed {max_cells:,} cells{hint}")


# ---- preprocessing fitted on training rows only --------------------------------------------------


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _numeric_sql(df: DataFrame, column: str) -> str:
    name = "`" + column.replace("`", "``") + "`"
    if is_temporal(field_type(df, column)):
        return f"CAST(unix_timestamp(CAST({name} AS TIMESTAMP)) AS DOUBLE)"
    return f"nanvl(CAST({name} AS DOUBLE), CAST(NULL AS DOUBLE))"


@dataclass
class Facts:
    """What preprocessing and fitting need to know of a set of training rows."""

    rows: int
    fills: list[float]
    means: list[float]
    deviations: list[float]
    modes: dict[str, str]
    levels: dict[str, list[str]]
    label_rows: dict[float, int]
    label_deviation: float


def _merged(parts: Sequence[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Count, mean and summed squared deviations of parts taken together."""
    n, mean, squares = 0, 0.0, 0.0
    for k, m, s in parts:
        if k:
            gap = m - mean
            squares += s + gap * gap * n * k / (n + k)
            mean += gap * k / (n + k)
            n += k
    return n, mean, squares


def learn(labelled: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str | None = None, turns: Sequence[set[int]] = ({0},)) -> list[Facts]:
    """The facts of every set of training rows; a set is the rows of some folds, without a fold column all rows.

    Moments, gaps, levels and labels are counted once per fold and put together per set. Medians are exact quantiles
    of each set, all sets at once; with folds only where a column has a gap, as they fill nothing otherwise.
    """
    ids = [f"n{i}" for i in range(len(numeric))]
    texts = [f"c{i}" for i in range(len(categorical))]
    values = labelled.select(
        (q(fold).cast("int") if fold else F.lit(0)).alias("fold"),
        *[F.expr(_numeric_sql(labelled, c)).alias(n) for n, c in zip(ids, numeric)],
        *[q(c).cast("string").alias(t) for t, c in zip(texts, categorical)],
        "__label",
    )
    moments = [x for n in [*ids, "__label"] for x in (F.count(n).alias(f"k_{n}"), F.avg(n).alias(f"m_{n}"), F.var_pop(n).alias(f"v_{n}"))]
    by_fold = {r["fold"]: r for r in values.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), *moments).collect()}
    levels = level_counts(values, texts, ["fold"]).collect() if texts else []
    labels = values.groupBy("fold", "__label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("__label").isNotNull())
    # one row per class for a classifier; a regressor's labels are not counted by value
    labels = labels.collect() if labelled.schema["__label"].metadata.get("classes") else []
    gaps = [n for n in ids if not fold or any(r[f"k_{n}"] < r["rows"] for r in by_fold.values())]
    medians: list[dict[str, float | None]] = [{} for _ in turns]
    if gaps and not fold:
        medians = [{n: v[0] for n, v in quantiles(values, gaps, [0.5]).items()}]
    elif gaps:
        uses = F.array_compact(F.array(*[F.when(F.col("fold").isin(sorted(t)), F.lit(i)) for i, t in enumerate(turns)]))
        for r in quantile_table(values.select(F.explode(uses).alias("turn"), *gaps), gaps, [0.5], by=["turn"]).collect():
            medians[r["turn"]][r["column"]] = r["quantiles"][0]
    out = []
    for i, turn in enumerate(turns):
        own = [r for f, r in by_fold.items() if f in turn]
        rows = sum(r["rows"] for r in own)
        fills, means, deviations = [], [], []
        for n in ids:
            fill = medians[i].get(n)
            fill = 0.0 if fill is None else fill
            known = [(r[f"k_{n}"], r[f"m_{n}"], (r[f"v_{n}"] or 0.0) * r[f"k_{n}"]) for r in own]
            k, mean, squares = _merged([*known, (rows - sum(x[0] for x in known), fill, 0.0)])
            fills.append(fill)
            means.append(mean)
            deviations.append(math.sqrt(squares / k) if k and squares > 0 else 1.0)
        counts: dict[str, dict[str, int]] = {t: {} for t in texts}
        for r in levels:
            if r["fold"] in turn:
                counts[r["column"]][r["level"]] = counts[r["column"]].get(r["level"], 0) + r["cnt"]
        modes = {c: min(counts[t], key=lambda v, t=t: (-counts[t][v], v)) if counts[t] else "Unknown" for t, c in zip(texts, categorical)}
        found = {c: sorted(counts[t] or {"Unknown": 0}) for t, c in zip(texts, categorical)}
        sizes: dict[float, int] = {}
        for r in labels:
            if r["fold"] in turn:
                sizes[r["__label"]] = sizes.get(r["__label"], 0) + r["n"]
        k, _, squares = _merged([(r["k___label"], r["m___label"], (r["v___label"] or 0.0) * r["k___label"]) for r in own])
        out.append(Facts(rows, fills, means, deviations, modes, found, sizes, math.sqrt(squares / k) if k else 0.0))
    return out


def preprocessor(table: DataFrame, numeric: Sequence[str], categorical: Sequence[str], facts: Facts, bins: int | None = None) -> list:
    """Stages that turn raw columns into ``features``.

    Fill values, means, deviations and most frequent levels are literals in one SQL stage. Levels that the facts
    don't hold become all zeros. With ``bins``, numbers become the number of their bin.
    """
    pieces, assembled = [], []
    for c, fill, mean, deviation in zip(numeric, facts.fills, facts.means, facts.deviations):
        name = f"__num_{len(assembled)}"
        pieces.append(f"(COALESCE({_numeric_sql(table, c)}, {fill!r}D) - ({mean!r}D)) / {deviation!r}D AS {name}")
        assembled.append(name)
    indexed = []
    for i, c in enumerate(categorical):
        name = "`" + c.replace("`", "``") + "`"
        pieces.append(f"COALESCE(CAST({name} AS STRING), {_quoted(facts.modes[c])}) AS __cat_{i}")
        indexed.append(f"__cat_{i}")
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(pieces)} FROM __THIS__")]
    if bins and assembled:
        edges = bin_edges(stages[0].transform(table), assembled, bins)
        places = [f"__bin_{i}" for i in range(len(assembled))]
        splits = [[-math.inf, *(e or [0.0]), math.inf] for e in edges]
        stages.append(Bucketizer(splitsArray=splits, inputCols=assembled, outputCols=places))
        # a bucketizer marks its numbers as categories, which trees would order by their labels
        assembled = [f"__place_{i}" for i in range(len(places))]
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(f'{b} + 0D AS {a}' for b, a in zip(places, assembled))} FROM __THIS__"))
    if indexed:
        ids = [f"__idx_{i}" for i in range(len(indexed))]
        hot = [f"__hot_{i}" for i in range(len(indexed))]
        stages += [StringIndexerModel.from_labels(facts.levels[c], t, i, handleInvalid="keep") for c, t, i in zip(categorical, indexed, ids)]
        # "keep" adds a slot for unseen levels at the end, and dropping the last slot makes it all zeros; the sizes
        # are known from the indexer, so no row is read
        encoder = OneHotEncoder(inputCols=ids, outputCols=hot, dropLast=True)
        stages.append(encoder.fit(PipelineModel(stages).transform(table)))
        assembled += hot
    stages.append(VectorAssembler(inputCols=assembled, outputCol="features"))
    return stages


def bin_edges(values: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Per column the edges between at most ``bins`` bins: between all values where they are few, else at quantiles.

    One pass of sketches, with a rank error of a ten-thousandth, over all rows; columns of few values are read again.
    """
    grid = [i / 1024 for i in range(1, 1024)]
    sketches = [F.struct(F.approx_count_distinct(c).alias("n"), F.percentile_approx(c, grid, 10_000).alias("ranks")).alias(c) for c in columns]
    found = values.agg(*sketches).first()
    out = []
    for c in columns:
        if found[c]["n"] <= 2 * bins:
            known = sorted(r[0] for r in values.select(c).distinct().collect())
            if len(known) <= bins:
                out.append([(a + b) / 2 for a, b in zip(known, known[1:])])
                continue
        times = Counter(found[c]["ranks"])
        ranks = sorted(times)
        if len(ranks) >= bins:
            heavy = [v for v in ranks if times[v] * bins > len(grid)]
            rest, left = [v for v in ranks if times[v] * bins <= len(grid)], bins - len(heavy)
            ranks = sorted([*heavy, *(rest[len(rest) * i // left] for i in range(1, left))])
        # a bin ends with its edge
        out.append([math.nextafter(v, math.inf) for v in ranks])
    return out


def _cells(rows: DataFrame, stages: Sequence, forest: bool, by_label: bool, weight: Column, seed: int) -> DataFrame:
    """``(features, __label, __weight)``: rows counted by bins, levels and class; a regressor's label is their mean.

    Trees split between bins only, so all rows of a cell stay together and their mean and weight say all that a split
    depends on. A forest draws rows with repetition: there a cell is dealt into random parts, drawn one by one.
    """
    at = next(i for i, s in enumerate(stages) if isinstance(s, (OneHotEncoderModel, VectorAssembler)))
    placed = PipelineModel(list(stages[:at])).transform(rows)
    keys = [c for c in placed.columns if c.startswith(("__place_", "__idx_")) and c not in rows.columns]
    part = F.floor(F.rand(seed) * FOREST_PARTS) if forest else F.lit(0)
    placed = placed.select(*keys, "__label", weight.alias("__weight"), part.alias("__part"))
    label = [] if by_label else [F.avg("__label").alias("__label")]
    counted = placed.groupBy(*keys, "__part", *(["__label"] if by_label else [])).agg(F.sum("__weight").alias("__weight"), *label)
    counted = materialize(counted)
    found = counted.count()
    tasks = max(1, math.ceil(found / CELLS_A_TASK))
    if forest:
        # all cores: a small shuffle has merged the cells into a few partitions, and the trees take the time
        cores = rows.sparkSession.sparkContext.defaultParallelism
        counted = counted.repartition(max(tasks, min(cores, math.ceil(found / FOREST_CELLS_A_TASK))))
    else:
        counted = counted.coalesce(tasks)
    return PipelineModel(list(stages[at:])).transform(counted).select("features", "__label", "__weight")


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """The stages of ``preprocessor``, with the facts of all rows of ``train``."""
    facts = learn(train.withColumn("__label", F.lit(None).cast("double")), numeric, categorical)[0]
    return preprocessor(train, numeric, categorical, facts)


def feature_names(stages: Sequence, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, str]]:
    """``(feature, source column)`` in the order of the feature vector."""
    names = [(c, c) for c in numeric]
    indexers = [s for s in stages if isinstance(s, StringIndexerModel)]
    return names + [(f"{c}_{v}", c) for c, indexer in zip(categorical, indexers) for v in indexer.labels]


# ---- estimators ----------------------------------------------------------------------------------


def make_classifier(name: str, classes: int, rows: int, seed: int = 42, **params):
    """The estimator for a model name; options override its settings."""
    common = {"featuresCol": "features", "labelCol": "__label"}
    if name == "Random Forest":
        base = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2, "seed": seed, "weightCol": "__weight"}
        return mlc.RandomForestClassifier(**{**common, **base, **params})
    if name == "Decision Tree":
        base = {"maxDepth": 30, "minInstancesPerNode": 1, "seed": seed, "weightCol": "__weight"}
        return mlc.DecisionTreeClassifier(**{**common, **base, **params})
    if name == "Gradient Boosting":
        base = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": seed}
        booster = mlc.GBTClassifier(**{**common, **base, **params})
        return booster if classes == 2 else mlc.OneVsRest(classifier=booster, **common)
    if name in ("Logistic Regression", "Default"):
        # balanced weights add up to the row count, so a unit penalty on summed loss is 1 / rows here
        base = {"maxIter": 1000, "regParam": 1.0 / rows, "standardization": False, "weightCol": "__weight"}
        return mlc.LogisticRegression(**{**common, **base, **params})
    raise ValueError(f"unknown classification model {name!r}; choose from {', '.join(CLASSIFIERS)}")


def make_regressor(name: str, rows: int, label_std: float = 1.0, seed: int = 42, **params):
    """The estimator for a model name; options override its settings."""
    common = {"featuresCol": "features", "labelCol": "__label"}
    if name == "Random Forest":
        base = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2, "seed": seed}
        return mlr.RandomForestRegressor(**{**common, **base, **params})
    if name == "Gradient Boosting":
        base = {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3, "seed": seed}
        return mlr.GBTRegressor(**{**common, **base, **params})
    if name == "Ridge Regression":
        # MLlib divides the penalty by the label's deviation, so that a unit penalty on summed squares is:
        base = {"regParam": label_std / rows, "elasticNetParam": 0.0, "standardization": False}
        return mlr.LinearRegression(**{**common, **base, **params})
    if name in ("Linear Regression", "Default"):
        return mlr.LinearRegression(**{**common, "regParam": 0.0, **params})
    raise ValueError(f"unknown regression model {name!r}; choose from {', '.join(REGRESSORS)}")


def _with_label(df: DataFrame, target: str, problem: str, classes: Sequence[str]) -> DataFrame:
    if problem == "Regression":
        return df.withColumn("__label", q(target).cast("string").try_cast("double"))
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), class_label(df, target)) - 1
    return df.withColumn("__label", index.cast("double").alias("__label", metadata={"classes": len(classes)}))


def _fit(rows: DataFrame, facts: Facts, features: Sequence[str], model: str, problem: str, classes: Sequence[str], seed: int, **params):
    """``(fitted stages, source names)`` from labelled rows and their facts."""
    numeric, categorical = split_features(rows, features)
    in_cells = model in TREES and facts.rows > CELL_ROWS
    stages = preprocessor(rows, numeric, categorical, facts, params.get("maxBins", TREE_BINS) if in_cells else None)
    weight = F.lit(1.0)
    if problem == "Classification" and model != "Gradient Boosting":
        # balanced class weights: rows / (classes x rows of the class)
        known = sum(facts.label_rows.values())
        weight = F.coalesce(*[F.when(F.col("__label") == k, known / (len(facts.label_rows) * n)) for k, n in facts.label_rows.items()])
    if in_cells:
        drawn = model == "Random Forest" or params.get("subsamplingRate", 1.0) < 1
        ready = _cells(rows, stages, drawn, problem == "Classification", weight, seed)
        # more nodes a pass, as rows are few
        params = {"weightCol": "__weight", "maxMemoryInMB": 512, **params}
    else:
        ready = PipelineModel(stages).transform(rows).select("features", "__label", weight.alias("__weight"))
    if problem == "Classification":
        estimator = make_classifier(model, len(classes), facts.rows, seed, **params)
    else:
        estimator = make_regressor(model, facts.rows, facts.label_deviation or 1.0, seed, **params)
    if isinstance(estimator, mlr.LinearRegression):
        # sums of products, one pass
        return PipelineModel([*stages, _slim(estimator.fit(ready))]), feature_names(stages, numeric, categorical)
    # iterative fits read the rows many times; lost blocks are rebuilt from the plan
    ready = ready.persist()
    try:
        fitted = estimator.fit(ready)
    finally:
        ready.unpersist()
    return PipelineModel([*stages, _slim(fitted)]), feature_names(stages, numeric, categorical)


def fit_model(train: DataFrame, target: str, features: Sequence[str], model: str, problem: str, classes: Sequence[str] = (), seed: int = 42, **params):
    """``(fitted stages, source names)``: preprocessing and model fitted on ``train`` only."""
    labelled = _with_label(train.filter(q(target).isNotNull()), target, problem, classes)
    facts = learn(labelled, *split_features(labelled, features))[0]
    return _fit(labelled, facts, features, model, problem, classes, seed, **params)


def _slim(fitted):
    """The model without its training summary, which keeps the training rows' plan and the session.

    A session that has observed any table cannot be sent to tasks, and the model would try to take it along.
    """
    if getattr(fitted, "hasSummary", False):
        fitted._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return fitted


def apply_model(pipe: PipelineModel, df: DataFrame, problem: str, classes: Sequence[str], observed: Observation | None = None) -> DataFrame:
    """Input columns plus ``__pred`` (class text or number) and ``__proba`` (array, null where the model gives none).

    An action on the result leaves in ``observed`` the number of ``rows`` and, as ``unseen_i``, how many of them have
    a level in the i-th categorical feature that the model's encoder doesn't know.
    """
    out = pipe.transform(df)
    if observed is not None:
        # the indexer gives levels it doesn't know the number after its last one
        indexers = [s for s in pipe.stages if isinstance(s, StringIndexerModel)]
        levels = [(s.getOutputCol(), len(s.labels)) for s in indexers]
        unseen = [F.count_if(F.col(c) >= n).alias(f"unseen_{i}") for i, (c, n) in enumerate(levels)]
        out = out.observe(observed, F.count(F.lit(1)).alias("rows"), *unseen)
    if problem == "Classification":
        names = F.array(*[F.lit(c) for c in classes])
        pred = F.element_at(names, F.col("prediction").cast("int") + 1)
        proba = vector_to_array("probability") if "probability" in out.columns else F.lit(None).cast("array<double>")
        return out.select(*[q(c) for c in df.columns], pred.alias("__pred"), proba.alias("__proba"))
    return out.select(*[q(c) for c in df.columns], F.col("prediction").alias("__pred"))


# ---- training ------------------------------------------------------------------------------------


@dataclass
class TrainedModel:
    """A fitted model with everything needed to judge it, save it and apply it."""

    pipe: PipelineModel
    contract: dict
    scores: dict = field(default_factory=dict)
    test: DataFrame | None = None
    folds: DataFrame | None = None
    out_of_fold: DataFrame | None = None
    importances: DataFrame | None = None
    levels: DataFrame | None = None


def cross_validate(
    train: DataFrame,
    target: str,
    features: Sequence[str],
    model: str,
    problem: str,
    classes: Sequence[str],
    folds: int,
    key: Sequence[str],
    chronological: bool = False,
    stratify: bool = False,
    seed: int = 42,
    parallel: int = PARALLEL_FITS,
    **params,
) -> tuple[DataFrame, DataFrame]:
    """Per-fold metrics and the out-of-fold predictions; every fold has preprocessing and model of its own.

    ``train`` holds the fold numbers' source columns only; the hold-out rows are never seen. The rows are numbered
    and kept once for all folds, what preprocessing learns of each fold's training rows is counted for all folds
    together, and up to ``parallel`` fits run side by side. Predictions are written before the kept rows go.
    """
    if chronological:
        split = sp.add_time_folds(train, folds, key)
        turns = [(i, set(range(i))) for i in range(1, folds + 1)]
    else:
        split = sp.add_folds(train, folds, key, seed, target if stratify else None)
        turns = [(i, set(range(folds)) - {i}) for i in range(folds)]
    labelled = _with_label(split.filter(q(target).isNotNull()), target, problem, classes)
    label = class_label(split, target) if problem == "Classification" else q(target).cast("double")
    labelled = labelled.persist()

    def one(turn: tuple[int, set[int]], facts: Facts) -> DataFrame:
        i, learned = turn
        pipe, _ = _fit(labelled.filter(F.col("fold").isin(sorted(learned))), facts, features, model, problem, classes, seed, **params)
        valid = apply_model(pipe, labelled.filter(F.col("fold") == i), problem, classes)
        proba = [F.col("__proba").alias("proba")] if problem == "Classification" else []
        return materialize(valid.select(*[q(k) for k in key], label.alias("label"), F.col("__pred").alias("prediction"), *proba, F.lit(i).alias("fold")))

    try:
        facts = learn(labelled, *split_features(split, features), "fold", [t for _, t in turns])
        run = inheritable_thread_target(train.sparkSession)(one)
        with ThreadPoolExecutor(max_workers=max(1, min(parallel, folds))) as pool:
            scored = list(pool.map(run, turns, facts))
    finally:
        labelled.unpersist()
    measure = mx.classification_metrics if problem == "Classification" else mx.regression_metrics
    rows = [measure(valid).withColumn("fold", F.lit(i)) for (i, _), valid in zip(turns, scored)]
    return union_all(rows), union_all(scored)


def cv_summary(folds: DataFrame, problem: str) -> DataFrame:
    """``(measure, mean, std)`` over folds, population std."""
    names = ("accuracy", "f1_macro") if problem == "Classification" else ("r2", "rmse")
    entries = [F.struct(F.lit(n).alias("measure"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")) for n in names]
    return folds.agg(F.array(*entries).alias("t")).select(F.inline("t"))


def feature_importance(pipe: PipelineModel, names: Sequence[tuple[str, str]], spark: SparkSession) -> DataFrame:
    """``(feature, source, importance)``: tree importances or mean absolute coefficients."""
    fitted = pipe.stages[-1]
    models = list(fitted.models) if hasattr(fitted, "models") else [fitted]
    vectors = []
    for m in models:
        if hasattr(m, "featureImportances"):
            vectors.append(m.featureImportances.toArray())
        elif hasattr(m, "coefficientMatrix"):
            matrix = abs(m.coefficientMatrix.toArray())
            vectors.append(matrix.mean(axis=0))
        elif hasattr(m, "coefficients"):
            vectors.append(abs(m.coefficients.toArray()))
    if not vectors:
        return spark.createDataFrame([], "feature string, source string, importance double")
    mean = sum(vectors) / len(vectors)
    rows = [(f, s, float(v)) for (f, s), v in zip(names, mean)]
    return spark.createDataFrame(rows, "feature string, source string, importance double")


def top_importances(importances: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    return importances.orderBy(F.col("importance").desc(), "feature").limit(k)


def grouped_importances(importances: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """Importance summed over the encoded columns of each source column."""
    sums = importances.groupBy("source").agg(F.sum("importance").alias("importance"))
    return sums.orderBy(F.col("importance").desc(), "source").limit(k)


def train_model(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    model: str,
    problem: str,
    key: Sequence[str],
    fraction: float = 0.2,
    seed: int = 42,
    chronological: bool = False,
    validate: bool = True,
    max_cells: int | None = None,
    **params,
) -> TrainedModel:
    """Split, fit on the training rows, judge on the test rows, cross-validate within the training rows.

    ``key`` must identify rows; it drives the split and fold order.
    """
    facts = validate_training(df, target, features, problem, fraction)
    check_width(df, features, max_cells)
    known = df.filter(q(target).isNotNull())
    if target in numeric_columns(df):
        known = known.filter(number(known, target).isNotNull())
    keep = list(dict.fromkeys([*key, *features, target, *([c for c in df.columns if is_temporal(field_type(df, c))] if chronological else [])]))
    known = known.select(*[q(c) for c in keep])
    classes: list[str] = []
    stratified, warning = False, None
    if problem == "Classification":
        known = known.withColumn(target, class_label(known, target))
        classes = sorted(facts["classes"], key=lambda c: (0, float(c), c) if c.lstrip("-").isdigit() else (1, 0.0, c))
    if chronological:
        parted = sp.chronological_split(known, key, fraction)
    elif problem == "Classification":
        parted, warning = sp.stratified_split(known, target, key, fraction, seed)
        stratified = warning is None
    else:
        parted = sp.random_split(known, key, fraction, seed)
    # read many times below, each of which would read the table and split it again
    parted = stored(parted)
    known = parted.drop(sp.PART)
    train, test = (parted.filter(c).drop(sp.PART) for c in (~F.col(sp.PART), F.col(sp.PART)))

    pipe, names = fit_model(train, target, features, model, problem, classes, seed, **params)
    scored = apply_model(pipe, test, problem, classes).withColumnRenamed("__pred", "prediction").withColumn("label", q(target))
    positive = mx.positive_class(classes)
    if problem == "Classification":
        if positive is not None:
            scored = scored.withColumn("probability", F.element_at("__proba", classes.index(positive) + 1))
        measured = mx.classification_metrics(scored).first().asDict()
        base = mx.majority_baseline(train, test, target).first().asDict()
        scores = {**measured, "baseline_accuracy": base["accuracy"], "baseline_f1_macro": base["f1_macro"]}
        if positive is not None:
            pos = mx.positive_metrics(scored, positive).first().asDict()
            scores |= {f"positive_{k}": v for k, v in pos.items() if k != "positive_class"}
        scores["verdict"] = mx.baseline_verdict(scores["accuracy"], scores["baseline_accuracy"])
    else:
        measured = mx.regression_metrics(scored).first().asDict()
        base = mx.mean_baseline(train, test, target).first().asDict()
        scores = {**measured, "baseline_r2": base["r2"], "baseline_rmse": base["rmse"], "baseline_mae": base["mae"]}
    sizes = parted.agg(F.count_if(~F.col(sp.PART)).alias("a"), F.count_if(sp.PART).alias("b")).first()
    scores |= {"train_rows": sizes["a"], "test_rows": sizes["b"]}

    folds = out_of_fold = None
    if validate:
        smallest = None
        if problem == "Classification":
            smallest = min(sp.class_counts(train, target).values(), default=0)
        k = sp.fold_count(sizes["a"], smallest, chronological)
        if k >= 2:
            stratify = problem == "Classification" and not chronological and smallest >= 2
            folds, oof = cross_validate(train, target, features, model, problem, classes, k, key, chronological, stratify, seed, **params)
            for r in cv_summary(folds, problem).collect():
                scores |= {f"cv_{r['measure']}_mean": r["mean"], f"cv_{r['measure']}_std": r["std"]}
            scores["cv_folds"] = k
            scores["cv_strategy"] = "time blocks" if chronological else "stratified" if stratify else "plain"
            if problem == "Classification" and positive is not None:
                out_of_fold = oof.withColumn("probability", F.element_at("proba", classes.index(positive) + 1)).drop("proba")

    numeric, categorical = split_features(known, features)
    contract = {
        "format_version": FORMAT_VERSION,
        "spark_version": pyspark.__version__,
        "created_at": datetime.now(timezone.utc).isoformat(timespec="seconds"),
        "model": model,
        "problem": problem,
        "target": target,
        "features": list(features),
        "numeric_features": numeric,
        "categorical_features": categorical,
        "feature_types": {c: field_type(known, c).simpleString() for c in features},
        "nullable": _nullable(known, features),
        "classes": classes,
        "positive_class": positive,
        "threshold": 0.5,
        "stratified": stratified,
        "warnings": [w for w in (warning, sp.temporal_warning(df, chronological)) if w],
        "training_fingerprint": fingerprint(df).first()["fingerprint"],
        "parameters": {k: v for k, v in params.items() if isinstance(v, (int, float, str, bool))},
    }
    levels = level_counts(known, categorical).select("column", "level") if categorical else None
    return TrainedModel(pipe, contract, scores, scored, folds, out_of_fold, feature_importance(pipe, names, df.sparkSession), levels)


def _nullable(df: DataFrame, features: Sequence[str]) -> dict[str, bool]:
    row = df.agg(*[F.coalesce(F.bool_or(q(c).isNull()), F.lit(False)).alias(f"n{i}") for i, c in enumerate(features)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(features)}


def tune_threshold(trained: TrainedModel, measure: str = "mcc") -> float:
    """Pick the threshold with the best out-of-fold measure (ties: lowest) and store it in the contract."""
    if trained.out_of_fold is None:
        raise ValueError("threshold tuning needs out-of-fold probabilities of a two-class target")
    table = mx.threshold_metrics(trained.out_of_fold, trained.contract["positive_class"])
    best = table.orderBy(F.col(measure).desc(), "threshold").first()
    trained.contract["threshold"] = best["threshold"]
    return best["threshold"]


# ---- saving, loading, applying -------------------------------------------------------------------


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _manifest(spark: SparkSession, path: str) -> dict[str, str]:
    files = file_signatures(spark, f"{path}/pipe").filter(~F.col("name").startswith("."))
    return {r["path"].split("/pipe/", 1)[-1]: r["sha256"] for r in files.collect()}


def save_model(trained: TrainedModel, path: str) -> str:
    """Store the pipeline, its contract, its scores, a SHA-256 list of its files, and all training levels as a table."""
    spark = SparkSession.active()
    path = path.rstrip("/")
    trained.pipe.write().overwrite().save(f"{path}/pipe")
    body = {"contract": trained.contract, "scores": trained.scores, "files": _manifest(spark, path)}
    levels = trained.levels if trained.levels is not None else spark.createDataFrame([], "column string, level string")
    levels.write.mode("overwrite").parquet(f"{path}/levels")
    _write_text(spark, json.dumps(body, sort_keys=True, default=str), f"{path}/metadata")
    return path


def _read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/metadata", wholetext=True).first()["value"])


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    """Load after checking the format version and that no stored file was changed."""
    path = path.rstrip("/")
    body = _read_metadata(spark, path)
    version = body["contract"].get("format_version")
    if version != FORMAT_VERSION:
        raise ValueError(f"model format {version} is not supported (expected {FORMAT_VERSION})")
    if _manifest(spark, path) != body["files"]:
        raise ValueError("the stored model files do not match their checksums; not loading them")
    levels = spark.read.schema("column string, level string").parquet(f"{path}/levels")
    return TrainedModel(PipelineModel.load(f"{path}/pipe"), body["contract"], body["scores"], levels=levels)


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, model, problem, target, created_at)`` of the models stored below a folder."""
    files = spark.read.text(f"{folder.rstrip('/')}/*/metadata", wholetext=True)
    body = F.col("value")
    return files.select(
        F.regexp_extract("_metadata.file_path", r"^(.*)/metadata/[^/]*$", 1).alias("path"),
        *[F.get_json_object(body, f"$.contract.{k}").alias(k) for k in ("model", "problem", "target", "created_at")],
    )


#: how the message of a row begins whose features cannot be scored
BAD_CELLS = "features that cannot be scored"


def _check_cells(df: DataFrame, numeric: Sequence[str], features: Sequence[str]) -> None:
    """An error that names every feature with text in place of a number, or with infinite cells; reads the table."""
    bad = non_finite_columns(require_numeric(df, numeric), features)
    if bad:
        raise ValueError(f"features hold infinite values: {', '.join(bad)}; clean or clip them first")


def _guarded(df: DataFrame, numeric: Sequence[str], features: Sequence[str]) -> DataFrame:
    """The same rows; the first one that ``_check_cells`` would name fails the running job."""
    texts = text_columns(df)
    bad = []
    for c in features:
        if c not in texts and c not in numeric_columns(df):
            continue
        value = q(c).try_cast("double")
        wrong = F.abs(value) == float("inf")
        if c in numeric and c in texts:
            wrong = wrong | (q(c).isNotNull() & value.isNull())
        bad.append(F.when(wrong, F.lit(c)))
    if not bad:
        return df
    names = F.concat_ws(", ", *bad)
    return df.filter(F.when(names == "", True).otherwise(F.raise_error(F.concat(F.lit(f"{BAD_CELLS}: "), names)).cast("boolean")))


def score(trained: TrainedModel, df: DataFrame, threshold: float | None = None, observed: Observation | None = None) -> DataFrame:
    """The table plus ``prediction`` (a free name is taken if that is in use) and ``probability`` of the
    positive class of two-class models.

    Cells that cannot be scored are an error. They are searched for before, by passes over the table; with
    ``observed`` the scoring pass itself fails at the first of them, and leaves there what ``apply_model`` counts.
    """
    contract = trained.contract
    features = contract["features"]
    absent = [c for c in features if c not in df.columns]
    if absent:
        raise ValueError(f"the table lacks features of the model: {', '.join(absent)}")
    dates = [c for c in contract["numeric_features"] if is_temporal(field_type(df, c))]
    checked = [c for c in contract["numeric_features"] if c not in dates], [c for c in features if c not in dates]
    if observed is None:
        _check_cells(df, *checked)
    else:
        df = _guarded(df, *checked)
    classes, positive = contract["classes"], contract["positive_class"]
    # original cells are put back after scoring, so parsed features do not change the input's types
    packed = df.select(F.struct(*[q(c) for c in df.columns]).alias("__row"), *[_checked(df, c, dates, contract) for c in features])
    out = apply_model(trained.pipe, packed, contract["problem"], classes, observed)
    name = free_name("prediction", df.columns)
    if contract["problem"] == "Classification" and positive is not None:
        cut = contract["threshold"] if threshold is None else threshold
        other = next(c for c in classes if c != positive)
        p = F.element_at("__proba", classes.index(positive) + 1)
        pred = F.coalesce(F.when(p >= F.lit(float(cut)), positive).when(p.isNotNull(), other), F.col("__pred"))
        return out.select("__row.*", pred.alias(name), p.alias(free_name("probability", df.columns)))
    return out.select("__row.*", F.col("__pred").alias(name))


@dataclass(frozen=True)
class ScoringReport:
    """Rows scored, and ``(column, level, rows)`` of the levels among them that training did not hold."""

    rows: int
    unseen: DataFrame


def write_scored(trained: TrainedModel, df: DataFrame, write: Callable[[DataFrame], None], threshold: float | None = None) -> ScoringReport:
    """Score and ``write`` in one pass over the table, which also counts its rows and the unknown levels.

    Only where that pass met unknown levels are their columns read again to name them; only where it failed at a
    cell that cannot be scored is the table searched for all columns that hold such cells, as ``score`` does before.
    """
    seen, contract = Observation(), trained.contract
    scored = score(trained, df, threshold, seen)
    try:
        write(scored)
    except Exception as error:
        if BAD_CELLS in str(error):
            dates = [c for c in contract["numeric_features"] if is_temporal(field_type(df, c))]
            _check_cells(df, [c for c in contract["numeric_features"] if c not in dates], [c for c in contract["features"] if c not in dates])
        raise
    facts = seen.get
    columns = [c for i, c in enumerate(contract["categorical_features"]) if facts.get(f"unseen_{i}")]
    none = df.sparkSession.createDataFrame([], "column string, level string, rows long")
    unseen = unseen_level_rows(trained.levels, df, columns) if columns and trained.levels is not None else none
    return ScoringReport(facts["rows"], unseen.select("column", "level", "rows"))


def _checked(df: DataFrame, column: str, dates: Sequence[str], contract: dict) -> Column:
    if column in contract["numeric_features"] and column not in dates and isinstance(field_type(df, column), T.StringType):
        return q(column).try_cast("double").alias(column)
    return q(column)


def category_drift(trained: TrainedModel, train: DataFrame, scored: DataFrame) -> DataFrame:
    """Unseen levels per categorical feature of a model."""
    return unseen_levels(train, scored, trained.contract["categorical_features"])


def category_drift_from_contract(trained: TrainedModel, df: DataFrame) -> DataFrame:
    """``(column, unseen_levels, unseen_rows)`` against the levels stored with the model."""
    cols = [c for c in trained.contract["categorical_features"] if c in df.columns]
    if not cols or trained.levels is None:
        return df.sparkSession.createDataFrame([], "column string, unseen_levels long, unseen_rows long")
    fresh = unseen_level_rows(trained.levels, df, cols)
    return fresh.groupBy("column").agg(F.count(F.lit(1)).alias("unseen_levels"), F.sum("rows").alias("unseen_rows"))
