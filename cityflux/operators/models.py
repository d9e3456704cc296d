"""Index and traffic models on Spark ML."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import product
from math import ceil, sqrt
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityflux.operators import evaluation as ev
from cityflux.operators import sums, trees
from cityflux.operators.features import feature_names
from cityflux.operators.splits import contiguous_folds
from cityflux.plans.scratch import exists, materialize
from cityflux.plans.series import with_position

# --- fixed values: model settings -------------------------------------------------------------
FOREST = {"numTrees": 100, "maxDepth": 15, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "seed": 42}
BOOSTED = {"maxIter": 100, "maxDepth": 8, "stepSize": 0.1, "seed": 42}
RIDGE_ALPHA = 1.0
CLASS_FOREST = {"numTrees": 100, "maxDepth": 15, "featureSubsetStrategy": "sqrt", "seed": 42}
FOREST_GRID = {"numTrees": [50, 100, 200], "maxDepth": [10, 15, 20], "minSamplesSplit": [2, 5, 10]}
BOOSTED_GRID = {"maxIter": [50, 100, 200], "maxDepth": [5, 8, 10], "stepSize": [0.01, 0.1, 0.2]}
GRID_FOLDS = 3
LEVELS = [1, 2, 3, 4, 5]
# ----------------------------------------------------------------------------------------------

# Room for split statistics per pass; the more fits, the fewer passes deep trees need.
TREE_MEMORY = {"maxMemoryInMB": 1024}

AQI_KINDS = ("random_forest", "gradient_boosting", "xgboost", "linear")
TRAFFIC_KINDS = ("random_forest", "gradient_boosting", "xgboost")
BOOSTED_KINDS = ("gradient_boosting", "xgboost")


def ridge_setup(df: DataFrame, target: str, names: list[str], alpha: float = RIDGE_ALPHA) -> tuple[float, list[str]]:
    """M4: Spark's regParam for a ridge penalty ``alpha`` on plain coefficients, and the features that vary.

    A constant feature has coefficient 0 in any case, and would leave Spark's normal equations singular.
    """
    row = df.agg(F.count(target).alias("_n"), *[F.stddev_pop(c).alias(c) for c in [*names, target]]).collect()[0]
    varying = [c for c in names if row[c]]
    return (alpha * (row[target] or 0.0) / row["_n"] if row["_n"] else 0.0), varying


def aqi_estimator(kind: str, target: str = "aqi_value", **settings) -> Estimator:
    """M2-M4: regressor by kind. Boosted trees also stand in for the optional external booster."""
    common = {"featuresCol": "features", "labelCol": target}
    if kind == "random_forest":
        return RandomForestRegressor(**common, **{**FOREST, **TREE_MEMORY, **settings})
    if kind in ("gradient_boosting", "xgboost"):
        return GBTRegressor(**common, **{**BOOSTED, **TREE_MEMORY, **settings})
    if kind == "linear":
        return LinearRegression(**common, elasticNetParam=0.0, standardization=False, solver="normal", **settings)
    raise ValueError(f"Unknown model type: {kind}")


def traffic_estimator(kind: str, **settings) -> Estimator:
    """M5: forest over label = level - 1; boosted classes are fitted by ``fit_trees``."""
    if kind == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", **{**CLASS_FOREST, **TREE_MEMORY, **settings})
    raise ValueError(f"Unknown model type: {kind}")


@dataclass(frozen=True)
class Fitted:
    """A trained model with what is known about its training."""

    model: PipelineModel | trees.TreeModel
    kind: str
    target: str
    features: list[str]
    train_samples: int = 0
    training_time: float = 0.0
    metrics: dict[str, float] = field(default_factory=dict)

    @property
    def is_classifier(self) -> bool:
        return self.target == "traffic_level"

    def predict(self, df: DataFrame) -> DataFrame:
        """The frame with ``prediction``, and ``probability`` (array by level) for classifiers."""
        out = self.model.transform(df)
        if self.is_classifier:
            out = out.withColumn("prediction", (F.col("prediction") + 1).cast("int"))
            if isinstance(self.model, PipelineModel):
                out = out.withColumn("probability", vector_to_array("probability"))
        keep = df.columns + [c for c in ("prediction", "probability") if c in out.columns]
        return out.select(*keep)

    def importance(self, spark: SparkSession) -> DataFrame:
        """M8: (feature, importance), none for models without importances."""
        weights = getattr(self.model.stages[-1], "featureImportances", None)
        rows = [(n, float(w)) for n, w in zip(self.features, weights.toArray())] if weights is not None else []
        return spark.createDataFrame(rows, "feature string, importance double")

    def history(self, spark: SparkSession) -> DataFrame:
        """M8: one row about the training."""
        row = (self.kind, self.target, float(self.training_time), int(self.train_samples), self.features, self.metrics)
        return spark.createDataFrame(
            [row],
            "model_type string, target string, training_time double, train_samples long, features array<string>, metrics map<string,double>",
        )


def _score(fitted: Fitted, df: DataFrame, prefix: str) -> dict[str, float]:
    """Metrics of one prediction pass; the names of the two model families differ as stored."""
    out = fitted.predict(df)
    if fitted.is_classifier:
        rows = ev.classification_metrics(out, fitted.target, "prediction").collect()
        return {f"{prefix}_{r['metric']}": r["value"] for r in rows if r["metric"] in ("accuracy", "f1")}
    wide = ev.regression_wide(out, fitted.target, "prediction").collect()[0]
    return {f"{prefix}_{m}": wide[m] for m in ("rmse", "mae", "r2", "mape")}


def train(
    df: DataFrame, target: str = "aqi_value", kind: str = "random_forest", val: DataFrame | None = None,
    tune: dict | None = None, **settings,
) -> Fitted:
    """M8: fit on prepared rows, score on them and on the validation rows. ``tune`` is a grid (M7)."""
    start = time.monotonic()
    if tune is not None:
        fitted = Fitted(grid_search(df, target, kind, tune, **settings)[0], kind, target, feature_names(df, target))
    else:
        fitted = _fit(df, target, kind, **settings)
    fitted = replace(fitted, train_samples=df.count(), training_time=time.monotonic() - start)
    metrics = _score(fitted, df, "train")
    if val is not None:
        metrics |= _score(fitted, val, "val" if fitted.is_classifier else "validation")
    return replace(fitted, metrics=metrics)


def _labelled(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", (F.col(target) - 1).cast("double")) if target == "traffic_level" else df


def _fit(df: DataFrame, target: str, kind: str, **settings) -> Fitted:
    """Fit one model on prepared rows."""
    names = feature_names(df, target)
    if kind == "random_forest" or kind in BOOSTED_KINDS and target == "traffic_level":
        return Fitted(fit_trees(df, target, kind, names, **settings), kind, target, names)
    if kind == "linear" and target != "traffic_level":
        settings["regParam"], names = ridge_setup(df, target, names, settings.pop("alpha", RIDGE_ALPHA))
    model = _stages(target, kind, names, **settings).fit(_labelled(df, target))
    return Fitted(model, kind, target, names)


def _stages(target: str, kind: str, names: list[str], **settings) -> Pipeline:
    build = traffic_estimator(kind, **settings) if target == "traffic_level" else aqi_estimator(kind, target, **settings)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), build])


def score(out: DataFrame, target: str) -> DataFrame:
    """Metrics of predicted rows as (metric, value); class probabilities add roc_auc."""
    if target != "traffic_level":
        return ev.regression_metrics(out, target, "prediction")
    metrics = ev.classification_metrics(out, target, "prediction")
    if "probability" not in out.columns:
        return metrics
    scores = ev.explode_scores(out, "probability", LEVELS, target)
    return metrics.unionByName(ev.roc_auc_ovr(scores).select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))


def evaluate(fitted: Fitted, test: DataFrame) -> DataFrame:
    """Metrics of the test rows."""
    return score(materialize(fitted.predict(test), "predicted"), fitted.target)


# --- models of cityflux.operators.trees -------------------------------------------------------


def _tree_setup(df: DataFrame, target: str, kind: str, names: list[str], settings: dict, keep: tuple[str, ...] = ()) -> tuple[dict, DataFrame, list, str, int]:
    """(settings, written table of bins, cuts, label, number of classes) for growing trees over prepared rows."""
    classes = len(LEVELS) if target == "traffic_level" else 0
    default = BOOSTED if kind in BOOSTED_KINDS else CLASS_FOREST if classes else FOREST
    label = "label" if classes else target
    cuts = trees.find_cuts(df, names)
    return {**default, **settings}, trees.binned(_labelled(df, target), names, cuts, [label, *keep]), cuts, label, classes


def _growth(settings: dict, width: int) -> trees.Growth:
    subset = ceil(sqrt(width)) if settings.get("featureSubsetStrategy") == "sqrt" else None
    return trees.Growth(settings["maxDepth"], settings.get("minInstancesPerNode", 1), settings.get("minSamplesSplit", 2), subset, settings["seed"])


def _grown(rows: DataFrame, kind: str, cuts: list, names: list[str], label: str, classes: int, settings: dict) -> trees.TreeModel:
    """A model over a written table of bins."""
    width, plan = len(names), _growth(settings, len(names))
    if kind in BOOSTED_KINDS:
        forest, base = trees.boost(rows, width, plan, settings["maxIter"], settings["stepSize"], label, classes)
        told = {k: settings[k] for k in ("maxIter", "maxDepth", "stepSize")}
        return trees.TreeModel(names, cuts, forest, "softmax" if classes else "sum", base, told)
    forest = trees.plant(rows, width, plan, settings["numTrees"], label, bootstrap=settings.get("bootstrap", True), classes=classes)
    told = {k: settings[k] for k in ("numTrees", "maxDepth", "minInstancesPerNode", "minSamplesSplit") if k in settings}
    return trees.TreeModel(names, cuts, forest, "shares" if classes else "mean", [0.0] * classes, told)


def fit_trees(df: DataFrame, target: str, kind: str, names: list[str], **settings) -> trees.TreeModel:
    """Boosted classes by one multinomial gradient a round, or a forest, over prepared rows."""
    if kind not in BOOSTED_KINDS:
        # Forests take no missing values, in training or later.
        df = df.withColumns({c: trees.given(c) for c in [*names, target]})
    settings, rows, cuts, label, classes = _tree_setup(df, target, kind, names, settings)
    model = _grown(rows, kind, cuts, names, label, classes, settings)
    if kind not in BOOSTED_KINDS:
        model.settings["complete"] = 1
    return model


def _nested_errors(rows: DataFrame, kind: str, label: str, classes: int, width: int, settings: dict, points: list[dict], folds: int) -> list[float]:
    """Mean of the folds' mean squared errors for every point.

    Points share fits: a forest holds those of fewer trees, less depth or larger nodes to split, boosted trees those of
    fewer rounds. One fit per fold is left for each setting of the other axes.
    """
    inside = ("maxIter",) if kind in BOOSTED_KINDS else ("numTrees", "maxDepth", "minSamplesSplit")
    groups: dict[tuple, list[int]] = {}
    for i, point in enumerate(points):
        groups.setdefault(tuple((k, v) for k, v in point.items() if k not in inside), []).append(i)
    sums = [0.0] * len(points)
    for outside, members in groups.items():
        own = {**settings, **dict(outside)}
        full = [{**own, **points[i]} for i in members]
        for fold in range(folds):
            if kind in BOOSTED_KINDS:
                most = max(p["maxIter"] for p in full)
                forest, base = trees.boost(rows, width, _growth(full[0], width), most, own["stepSize"], label, classes, without=fold)
                found = trees.boosted_errors(rows, width, forest, base, own["stepSize"], label, own["maxDepth"], [p["maxIter"] for p in full], fold, classes)
                errors = [found[p["maxIter"]] for p in full]
            else:
                keys = [(p["numTrees"], p["maxDepth"], p.get("minSamplesSplit", 2)) for p in full]
                widest = {**own, "maxDepth": max(k[1] for k in keys), "minSamplesSplit": min(k[2] for k in keys)}
                forest = trees.plant(rows, width, _growth(widest, width), max(k[0] for k in keys), label, without=fold, bootstrap=own.get("bootstrap", True), classes=classes)
                found = trees.forest_errors(rows, width, forest, label, keys, fold, classes)
                errors = [found[k] for k in keys]
            for i, e in zip(members, errors):
                sums[i] += e / folds
    return sums


def grid_search(
    df: DataFrame, target: str, kind: str, grid: dict, folds: int = GRID_FOLDS, parallelism: int = 4,
    order: tuple[str, ...] = ("timestamp", "id"), **settings,
) -> tuple[PipelineModel | trees.TreeModel, DataFrame]:
    """M7: best model by mean squared error over contiguous folds, and (settings, mse) of every point.

    Of points with equal errors the first is the best. Classifiers are scored on their labels.
    """
    names = feature_names(df, target)
    if kind != "linear":
        folded = contiguous_folds(df, folds, list(order))
        settings, rows, cuts, label, classes = _tree_setup(folded, target, kind, names, settings, ("fold",))
        points = [dict(zip(grid, values)) for values in product(*grid.values())]
        errors = _nested_errors(rows, kind, label, classes, len(names), settings, points, folds)
        best = points[min(range(len(points)), key=errors.__getitem__)]
        model = _grown(rows, kind, cuts, names, label, classes, {**settings, **best})
        table = [({k: str(v) for k, v in p.items()}, float(e)) for p, e in zip(points, errors)]
        return model, df.sparkSession.createDataFrame(table, "settings map<string,string>, mse double")
    settings["regParam"], names = ridge_setup(df, target, names, settings.pop("alpha", RIDGE_ALPHA))
    stages = _stages(target, kind, names, **settings)
    estimator = stages.getStages()[-1]
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    points = builder.build()
    rows = contiguous_folds(df, folds, list(order))
    # Every point and fold reads the folded rows again: write them once.
    rows = materialize(rows, "folds")
    search = CrossValidator(
        estimator=stages, estimatorParamMaps=points, numFolds=folds, foldCol="fold", parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mse"),
    )
    found = search.fit(rows)
    table = [
        ({p.name: str(v) for p, v in point.items()}, float(m)) for point, m in zip(points, found.avgMetrics)
    ]
    scores = df.sparkSession.createDataFrame(table, "settings map<string,string>, mse double")
    return found.bestModel, scores


def _pooled(spark: SparkSession, fits: list[Callable[[], tuple]], parallelism: int) -> list[tuple]:
    """Results of fits that do not depend on each other, a few at a time, in the given order."""
    with ThreadPool(parallelism) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits)


def cross_validate(
    df: DataFrame, target: str = "aqi_value", kind: str = "linear", folds: int = 5,
    order: tuple[str, ...] = ("timestamp", "id"), metric: str = "mse", parallelism: int = 4, **settings,
) -> DataFrame:
    """(fold, score). Classifiers get folds that keep class shares and are scored by accuracy.

    Squared errors of linear models come from sums of products, one pass for all folds.
    """
    if kind == "linear" and metric == "mse" and target != "traffic_level":
        runs = _linear_runs(df, target, folds, (1.0,), order, **settings)
        return df.sparkSession.createDataFrame([(k, val) for k, _, _, _, val in runs], "fold int, score double")
    by = target if target == "traffic_level" else None
    rows = materialize(contiguous_folds(df, folds, list(order), by), "folds")

    def one(k: int) -> tuple:
        head, tail = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        return k, _fold_score(_fit(head, target, kind, **settings), tail, metric)

    scores = _pooled(df.sparkSession, [partial(one, k) for k in range(folds)], parallelism)
    return df.sparkSession.createDataFrame(scores, "fold int, score double")


def _linear_runs(df: DataFrame, target: str, folds: int, shares: tuple[float, ...], order: tuple[str, ...], alpha: float = RIDGE_ALPHA) -> list[tuple]:
    """(fold, share, rows, training error, error on the fold) of ridge fits on the leading shares of the other folds' rows.

    Positions are cut into runs at all fold and share bounds; the sums of a run count for every fit that holds it.
    """
    names = feature_names(df, target)
    rows = with_position(df.select(*names, target, *[c for c in order if c not in names + [target]]), [], list(order), "_pos")
    rows = materialize(rows, "positions")
    n = rows.count()
    starts = sums.fold_starts(n, folds)
    sizes = {(k, share): int((n - (starts[k + 1] - starts[k])) * share) for k in range(folds) for share in shares}
    # The last of the leading rows, counted over all rows: fold k is skipped.
    ends = {(k, share): size if size <= starts[k] else size + starts[k + 1] - starts[k] for (k, share), size in sizes.items()}
    bounds = sorted({*starts[1:], *ends.values()} - {0, n})
    parts, _ = sums.segment_sums(rows, names, target, "_pos", bounds)
    first = [0, *bounds]
    runs = []
    for (k, share), end in ends.items():
        inside = [starts[k] <= a < starts[k + 1] for a in first]
        head = sum((g for a, g, own in zip(first, parts, inside) if not own and a < end), 0 * parts[0])
        tail = sum((g for g, own in zip(parts, inside) if own), 0 * parts[0])
        fit = sums.ridge(head, alpha)
        runs.append((k, share, sizes[k, share], sums.mean_squared_error(head, fit), sums.mean_squared_error(tail, fit)))
    return runs


def _fold_score(fitted: Fitted, rows: DataFrame, metric: str) -> float:
    out = fitted.predict(rows)
    if fitted.is_classifier:
        wanted = "accuracy" if metric == "mse" else metric
        return ev.classification_metrics(out, fitted.target, "prediction").filter(F.col("metric") == wanted).collect()[0]["value"]
    return ev.regression_wide(out, fitted.target, "prediction").collect()[0][metric]


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean, population deviation, extremes and number of folds."""
    return scores.agg(
        F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"), F.min("score").alias("cv_min"),
        F.max("score").alias("cv_max"), F.count("score").alias("cv_folds"),
    )


def learning_curve(
    df: DataFrame, target: str = "aqi_value", kind: str = "linear", folds: int = 5,
    shares: tuple[float, ...] = tuple(i / 10 for i in range(1, 11)), order: tuple[str, ...] = ("timestamp", "id"), parallelism: int = 4,
    **settings,
) -> DataFrame:
    """(train_size, train_mean, train_std, val_mean, val_std) of the mean squared error.

    Each size takes the leading rows of the training part of each fold. Linear models come from sums of products, one
    pass for all sizes and folds.
    """
    if kind == "linear" and target != "traffic_level":
        found = _linear_runs(df, target, folds, shares, order, **settings)
        return _curve(df.sparkSession, [(share, size, head, tail) for _, share, size, head, tail in found])
    rows = contiguous_folds(df, folds, list(order))
    rows = materialize(with_position(rows, ["fold"], list(order), "_in_fold"), "folds")
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    n = sum(sizes.values())
    starts = {k: sum(sizes[j] for j in range(k)) for k in range(folds)}

    def one(share: float, k: int) -> tuple:
        # Position of a row among the training rows of fold k, which skip fold k.
        at = F.col("_in_fold")
        for j in range(folds):
            shift = starts[j] - (sizes[k] if j > k else 0)
            at = at + F.when(F.col("fold") == j, shift).otherwise(0)
        size = int((n - sizes[k]) * share)
        head = rows.filter((F.col("fold") != k) & (at < size))
        fitted = _fit(head, target, kind, **settings)
        tail = rows.filter(F.col("fold") == k)
        return share, size, _fold_score(fitted, head, "mse"), _fold_score(fitted, tail, "mse")

    out = _pooled(df.sparkSession, [partial(one, share, k) for share in shares for k in range(folds)], parallelism)
    return _curve(df.sparkSession, out)


def _curve(spark: SparkSession, found: list[tuple]) -> DataFrame:
    runs = spark.createDataFrame(found, "share double, size long, train double, val double")
    return runs.groupBy("share").agg(
        F.min("size").alias("train_size"), F.avg("train").alias("train_mean"), F.stddev_pop("train").alias("train_std"),
        F.avg("val").alias("val_mean"), F.stddev_pop("val").alias("val_std"),
    )


def save_model(fitted: Fitted, spark: SparkSession, path: str) -> None:
    """Model folder, training row and importances side by side."""
    if isinstance(fitted.model, trees.TreeModel):
        fitted.model.save(spark, f"{path}/model")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    fitted.history(spark).write.mode("overwrite").json(f"{path}/history")
    fitted.importance(spark).write.mode("overwrite").json(f"{path}/importance")


def load_model(spark: SparkSession, path: str) -> Fitted:
    """S12."""
    schema = "model_type string, target string, training_time double, train_samples long, features array<string>, metrics map<string,double>"
    h = spark.read.schema(schema).json(f"{path}/history").collect()[0]
    grown = exists(spark, f"{path}/model/trees")
    model = trees.TreeModel.load(spark, f"{path}/model") if grown else PipelineModel.load(f"{path}/model")
    return Fitted(model, h["model_type"], h["target"], h["features"], h["train_samples"], h["training_time"], dict(h["metrics"] or {}))
