"""Models by invariants: closed forms, baselines, round trips, disjoint folds."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cityflux.operators import evaluation as ev
from cityflux.operators import forecasting, models
from cityflux.operators.splits import contiguous_folds, lookback_tail


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "hour": rng.integers(0, 24, n), "traffic_level": rng.integers(1, 6, n)})
    pdf["latitude"] = rng.normal(size=n)
    pdf["month"] = 1
    pdf["aqi_value"] = 3.0 * pdf["hour"] - 5 * pdf["traffic_level"] + 20 * pdf["latitude"] + rng.normal(size=n)
    pdf["timestamp"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["id"], unit="min")
    return spark.createDataFrame(pdf).cache()


def test_ridge_is_the_closed_form(rows):
    fitted = models.train(rows, "aqi_value", "linear", alpha=30.0)
    assert "month" not in fitted.features
    pdf = rows.toPandas()
    x, y = pdf[fitted.features].to_numpy(float), pdf["aqi_value"].to_numpy(float)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 30.0 * np.eye(x.shape[1]), xc.T @ yc)
    assert np.allclose(fitted.model.stages[-1].coefficients.toArray(), want, rtol=1e-6)


def test_forest_beats_the_mean_and_reloads(spark, rows, tmp_path):
    fitted = models.train(rows, "aqi_value", "random_forest", rows, numTrees=10, maxDepth=6)
    assert fitted.metrics["train_r2"] > 0.5 and "validation_rmse" in fitted.metrics
    weights = [r["importance"] for r in ev.top_features(fitted.importance(spark), 3).collect()]
    assert len(weights) == 3 and weights == sorted(weights, reverse=True)
    models.save_model(fitted, spark, f"{tmp_path}/m")
    again = models.load_model(spark, f"{tmp_path}/m")
    assert again.features == fitted.features and again.metrics == fitted.metrics
    a, b = [[r["prediction"] for r in f.predict(rows).orderBy("id").collect()] for f in (fitted, again)]
    assert a == b


def test_classifier_probabilities(rows):
    fitted = models.train(rows, "traffic_level", "random_forest", rows, numTrees=5, maxDepth=5)
    out = fitted.predict(rows).collect()
    assert {r["prediction"] for r in out} <= {1, 2, 3, 4, 5}
    for r in out:
        assert sum(r["probability"]) == pytest.approx(1.0)
        assert r["prediction"] == 1 + int(np.argmax(r["probability"]))
    assert set(fitted.metrics) == {"train_accuracy", "train_f1", "val_accuracy", "val_f1"}
    assert {r["metric"] for r in models.evaluate(fitted, rows).collect()} == {"accuracy", "precision", "recall", "f1", "roc_auc"}


def test_unknown_kind(rows):
    with pytest.raises(ValueError):
        models.train(rows, "aqi_value", "nothing")


def test_grid_picks_the_best(rows):
    _, scores = models.grid_search(rows, "aqi_value", "random_forest", {"maxDepth": [1, 6], "numTrees": [5]})
    mse = {r["settings"]["maxDepth"]: r["mse"] for r in scores.collect()}
    assert mse["6"] < mse["1"]
    tuned = models.train(rows, "aqi_value", "random_forest", tune={"maxDepth": [1, 6], "numTrees": [5]})
    assert tuned.model.settings["maxDepth"] == 6


def test_cross_validation(rows):
    scores = models.cross_validate(rows, "aqi_value", "linear", folds=4)
    got = [r["score"] for r in scores.orderBy("fold").collect()]
    pdf = rows.toPandas().sort_values("timestamp")
    x, y = pdf[["hour", "traffic_level", "latitude"]].to_numpy(float), pdf["aqi_value"].to_numpy(float)
    want = []
    for test in np.array_split(np.arange(len(y)), 4):
        train = np.setdiff1d(np.arange(len(y)), test)
        m, c = x[train].mean(0), y[train].mean()
        b = np.linalg.solve((x[train] - m).T @ (x[train] - m) + np.eye(3), (x[train] - m).T @ (y[train] - c))
        want.append(np.mean((y[test] - c - (x[test] - m) @ b) ** 2))
    assert got == pytest.approx(want)
    summary = models.cv_summary(scores).collect()[0]
    assert summary["cv_folds"] == 4 and summary["cv_std"] == pytest.approx(np.std(want))


def test_learning_curve_sizes(rows):
    curve = models.learning_curve(rows, folds=4, shares=(0.1, 1.0)).orderBy("share").collect()
    assert [r["train_size"] for r in curve] == [30, 300]
    assert curve[0]["val_mean"] > curve[1]["val_mean"] * 0.9


def test_folds_are_contiguous(rows):
    pdf = contiguous_folds(rows.limit(10), 3, ["timestamp", "id"]).toPandas().sort_values("timestamp")
    assert pdf["fold"].tolist() == [0] * 4 + [1] * 3 + [2] * 3
    few = contiguous_folds(rows.limit(2), 3, ["timestamp", "id"]).toPandas().sort_values("timestamp")
    assert few["fold"].tolist() == [0, 1]


@pytest.mark.parametrize("plan", [{}, {"limit": 20, "partitions": 5}])
def test_forecast_is_least_squares(spark, plan):
    rng = np.random.default_rng(11)
    long = np.cumsum(rng.normal(size=200)) + 50
    short = np.arange(30.0)
    pdf = pd.concat(
        [pd.DataFrame({"location": name, "v": v, "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(v)), unit="h")})
         for name, v in (("long", long), ("short", short), ("tiny", short[:5]))]
    )
    pdf["id"] = range(len(pdf))
    df = spark.createDataFrame(pdf)
    fit = forecasting.forecast_fit(df, "v", **plan)
    out = forecasting.forecast(df, fit, "v").toPandas().sort_values(["location", "step"])
    past = np.array([long[i - 24 : i] for i in range(24, 176)])
    future = np.array([long[i : i + 24] for i in range(24, 176)])
    coef, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(past)), past]), future, rcond=None)
    want = np.concatenate([[1.0], long[-24:]]) @ coef
    assert np.allclose(out[out.location == "long"]["value"], want, rtol=1e-5, atol=1e-5)
    rest = out[out.location != "long"]
    assert rest["value"].isna().all() and set(rest["reason"]) == {forecasting.NO_MODEL}
    tail = {r["location"]: r["n"] for r in lookback_tail(df, "v").collect()}
    assert tail == {"long": 24, "short": 24, "tiny": 5}


@pytest.mark.parametrize("plan", [{}, {"limit": 12, "partitions": 4}])
def test_forecast_fit_over_windows_without_gaps(spark, plan):
    """Sums of lagged products give the windows of every run between missing values."""
    rng = np.random.default_rng(2)
    back, ahead = 3, 2
    parts, want = [], {}
    for name, n, holes in (("a", 60, []), ("b", 70, [5, 6, 20, 69]), ("c", 40, [33]), ("d", 7, []), ("e", 5, []), ("f", 50, [0, 49]), ("g", 30, list(range(3, 30, 4)))):
        v = np.cumsum(rng.normal(size=n)) + 100
        v[holes] = np.nan
        parts.append(pd.DataFrame({"location": name, "v": v, "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h")}))
        windows = np.array([v[i : i + 5] for i in range(n - 5) if not np.isnan(v[i : i + 5]).any()])
        if len(windows):
            mean = windows.mean(0)
            c = (windows - mean).T @ (windows - mean)
            w = np.linalg.pinv(c[:back, :back], hermitian=True) @ c[:back, back:]
            want[name] = (w, mean[back:] - mean[:back] @ w)
    pdf = pd.concat(parts)
    pdf["id"] = range(len(pdf))
    got = {(r["location"], r["step"]): r for r in forecasting.forecast_fit(spark.createDataFrame(pdf), "v", back, ahead, **plan).collect()}
    assert set(got) == {(name, s) for name in want for s in (1, 2)}
    for (name, step), r in got.items():
        assert np.allclose(r["weights"], want[name][0][:, step - 1], atol=1e-5) and r["intercept"] == pytest.approx(want[name][1][step - 1], abs=1e-4)


def test_regression_metrics_edges(spark):
    flat = spark.createDataFrame([(0.0, 1.0), (0.0, -1.0), (0.0, 0.0)], "y_true double, y_pred double")
    got = {r["metric"]: r["value"] for r in ev.regression_metrics(flat).collect()}
    assert got["mape"] == 0.0 and got["r2"] == 0.0 and got["mae"] == pytest.approx(2 / 3)


def test_absent_classes_count_as_zero(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "c_true int, c_pred int")
    per = {r["label"]: r for r in ev.per_class(df).collect()}
    assert per[2]["recall"] == 0.0 and per[3]["precision"] == 0.0 and per[1]["precision"] == 0.5
    assert ev.confusion_matrix(df).count() == 9


def test_auc_with_ties(spark):
    rows = [(1, 1, 0.9), (1, 0, 0.9), (1, 0, 0.1), (1, 1, 0.5), (2, 1, 0.3)]
    df = spark.createDataFrame(rows, "class int, label int, score double")
    per = {r["class"]: r["auc"] for r in ev.roc_auc_per_class(df).collect()}
    assert per == {1: pytest.approx((0.5 + 1 + 0 + 1) / 4), 2: None}
    assert ev.roc_auc_ovr(df).collect()[0][0] == pytest.approx(0.625)


def test_quantile_pairs(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("y_true"), F.lit(0.0).alias("y_pred"))
    pairs = ev.residual_quantiles(df, points=3).orderBy("share").collect()
    assert [r["observed"] for r in pairs] == [250.0, 500.0, 750.0]
    assert pairs[1]["theoretical"] == pytest.approx(0.0) and pairs[0]["theoretical"] == pytest.approx(-0.6744897)


def test_boosted_trees(spark, rows, tmp_path):
    fitted = models.train(rows, "aqi_value", "gradient_boosting", maxIter=5, maxDepth=4)
    assert fitted.metrics["train_r2"] > 0.5
    several = models.train(rows, "traffic_level", "xgboost", maxIter=2, maxDepth=2)
    models.save_model(several, spark, f"{tmp_path}/m")
    again = models.load_model(spark, f"{tmp_path}/m")
    out = several.predict(rows)
    assert again.predict(rows).orderBy("id").collect() == out.orderBy("id").collect()
    for r in out.collect():
        assert r["prediction"] in (1, 2, 3, 4, 5) and sum(r["probability"]) == pytest.approx(1.0)
        assert r["probability"][r["prediction"] - 1] == max(r["probability"])
    assert {r["metric"] for r in models.evaluate(several, rows).collect()} == {"accuracy", "precision", "recall", "f1", "roc_auc"}


def test_classifier_that_never_saw_a_level(rows):
    few = rows.filter("traffic_level < 5")
    fitted = models.train(few, "traffic_level", "random_forest", numTrees=3, maxDepth=3)
    assert {r["metric"] for r in models.evaluate(fitted, rows).collect()} >= {"accuracy", "roc_auc"}


def test_grid_search_scores_levels_as_labels(spark):
    df = spark.range(200).select("id", F.timestamp_seconds(F.col("id")).alias("timestamp"), (F.col("id") % 4 + 1).alias("traffic_level"), (F.col("id") % 4).alias("hour"))
    _, scores = models.grid_search(df, "traffic_level", "random_forest", {"maxDepth": [3]}, numTrees=5)
    assert scores.first()["mse"] == 0.0


@pytest.mark.parametrize("target", ["aqi_value", "traffic_level"])
def test_forests_are_never_collected(spark, rows, monkeypatch, tmp_path, target):
    """Training, grids, importances, round trips and predictions leave a forest in its table."""
    from cityflux.operators import trees

    def never(*_):
        raise AssertionError("a forest was collected")

    monkeypatch.setattr(trees.Grove, "collect", never)
    fitted = models.train(rows, target, "random_forest", rows, numTrees=4, maxDepth=5)
    assert isinstance(fitted.model.forest, trees.Grove)
    assert sum(r["importance"] for r in fitted.importance(spark).collect()) == pytest.approx(1)
    models.save_model(fitted, spark, f"{tmp_path}/m")
    again = models.load_model(spark, f"{tmp_path}/m")
    a, b = [[r["prediction"] for r in f.predict(rows).orderBy("id").collect()] for f in (fitted, again)]
    assert a == b
    best, scores = models.grid_search(rows, target, "random_forest", {"maxDepth": [1, 6], "numTrees": [2, 4]})
    assert scores.count() == 4 and isinstance(best.forest, trees.Grove)


@pytest.mark.parametrize("target, hole", [("aqi_value", "aqi_value"), ("aqi_value", "hour"), ("traffic_level", "traffic_level")])
def test_forests_refuse_missing_values(rows, target, hole):
    holes = rows.withColumn(hole, F.when(F.col("id") != 7, F.col(hole)))
    with pytest.raises(Exception, match="missing values"):
        models.train(holes, target, "random_forest", numTrees=2, maxDepth=2)
    if hole != target:
        fitted = models.train(rows, target, "random_forest", numTrees=2, maxDepth=2)
        with pytest.raises(Exception, match="missing values"):
            fitted.predict(holes).count()
