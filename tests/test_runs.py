"""The whole run leaves every file and sensible numbers; report texts hold the results."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityflux.operators import evaluation as ev
from cityflux.registry.base import AS_OF, dirty_readings
from cityflux.runs.analysis import run_analysis


def test_analysis_run(spark, sf, tmp_path):
    out = f"{tmp_path}/run"
    small = {"aqi_value": {}, "traffic_level": {"numTrees": 3, "maxDepth": 3}}
    done = run_analysis(
        dirty_readings(spark, sf), out, AS_OF, kinds={"aqi_value": "linear", "traffic_level": "random_forest"}, settings=small
    )
    for part in ("processed_data", "models/aqi_value/model", "models/traffic_level/history", "reports/text/summary",
                 "reports/insights/correlation_matrix", "reports/evaluation/aqi_value_residuals", "reports/preprocessing_summary"):
        assert os.path.exists(f"{out}/{part}/_SUCCESS") or os.path.isdir(f"{out}/{part}/metadata"), part
    rows = done.prepared.count()
    assert spark.read.option("header", True).csv(f"{out}/processed_data").count() == rows
    assert f"{rows:,}" in done.texts["summary"] and f"Records: {rows:,}" in done.texts["insights"]
    aqi = {r["metric"]: r["value"] for r in done.metrics["aqi_value"].collect()}
    assert aqi["r2"] > 0.5 and f"rmse: {aqi['rmse']:.4f}" in done.texts["aqi_value_evaluation"]
    assert {r["metric"] for r in done.metrics["traffic_level"].collect()} >= {"accuracy", "f1", "roc_auc"}
    confusion = done.tables["traffic_level_confusion"].agg(F.sum("n")).collect()[0][0]
    assert 0 < confusion < rows


def test_kolmogorov_smirnov(spark):
    values = np.array([1.0, 2.0, 2.5, 4.0, 9.0, 9.5, 11.0])
    df = spark.createDataFrame([(float(v), 0.0) for v in values], "y_true double, y_pred double")
    got = ev.kolmogorov_smirnov(df).collect()[0]
    from statistics import NormalDist

    law = NormalDist(values.mean(), values.std())
    at = np.array([law.cdf(v) for v in values])
    n = len(values)
    want = max((np.arange(1, n + 1) / n - at).max(), (at - np.arange(n) / n).max())
    assert got["statistic"] == pytest.approx(want)
