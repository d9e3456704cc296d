"""Evaluation of predictions derived from the readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux.operators import evaluation as ev
from cityflux.plans.scratch import fresh_path
from cityflux.registry.base import predictions, query, readings, scores

_REG = """
, s AS (
  SELECT count(*) AS n, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae, var_pop(y_true) AS v,
    coalesce(avg(CASE WHEN y_true <> 0 THEN abs((y_true - y_pred) / y_true) END), 0) * 100 AS mape,
    avg(y_true - y_pred) AS residual_mean, stddev_pop(y_true - y_pred) AS residual_std,
    min(y_true - y_pred) AS residual_min, max(y_true - y_pred) AS residual_max
  FROM predictions
), w AS (SELECT *, sqrt(mse) AS rmse, 1 - mse / v AS r2, 1 - (mse / v) * (n - 1) / (n - 2) AS adj_r2 FROM s)
"""


@query("regression_metrics", _REG + " UNION ALL ".join(f"SELECT '{m}' AS metric, round({m}, 6) AS value FROM w" for m in ev.REGRESSION), places=6)
def regression_metrics(spark, sf):
    return ev.regression_metrics(predictions(spark, sf))


_CLASSES = """
, labels AS (SELECT DISTINCT c_true AS label FROM predictions UNION SELECT DISTINCT c_pred FROM predictions),
per_class AS (
  SELECT label, coalesce(CAST(hit AS DOUBLE) / nullif(guessed, 0), 0) AS precision, coalesce(CAST(hit AS DOUBLE) / nullif(support, 0), 0) AS recall,
         coalesce(CAST(2 * hit AS DOUBLE) / nullif(guessed + support, 0), 0) AS f1, support, hit
  FROM (SELECT label, (SELECT count(*) FROM predictions WHERE c_true = label) AS support,
               (SELECT count(*) FROM predictions WHERE c_pred = label) AS guessed,
               (SELECT count(*) FROM predictions WHERE c_true = label AND c_pred = label) AS hit FROM labels)
)
"""


@query("classification_metrics", _CLASSES + """
SELECT 'accuracy' AS metric, round(CAST(sum(hit) AS DOUBLE) / sum(support), 6) AS value FROM per_class
UNION ALL SELECT 'precision', round(sum(precision * support) / sum(support), 6) FROM per_class
UNION ALL SELECT 'recall', round(sum(recall * support) / sum(support), 6) FROM per_class
UNION ALL SELECT 'f1', round(sum(f1 * support) / sum(support), 6) FROM per_class
""", places=6)
def classification_metrics(spark, sf):
    return ev.classification_metrics(predictions(spark, sf))


@query("classification_report", _CLASSES + """
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per_class
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM per_class
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM per_class
""", places=6)
def classification_report(spark, sf):
    return ev.classification_report(predictions(spark, sf))


@query("confusion_matrix", _CLASSES + """
SELECT a.label AS actual, p.label AS predicted, (SELECT count(*) FROM predictions WHERE c_true = a.label AND c_pred = p.label) AS n
FROM labels a, labels p
""")
def confusion_matrix(spark, sf):
    return ev.confusion_matrix(predictions(spark, sf))


@query("confusion_wide", "SELECT c_true AS actual, " + ", ".join(
    f'count(*) FILTER (WHERE c_pred = {c}) AS "{c}"' for c in range(1, 6)
) + " FROM predictions GROUP BY 1")
def confusion_wide(spark, sf):
    return ev.confusion_wide(predictions(spark, sf), [1, 2, 3, 4, 5])


_AUC = """
, ranked AS (SELECT class, label, rank() OVER w + (count(*) OVER (PARTITION BY class, score) - 1) / 2.0::DOUBLE AS r
             FROM scores WINDOW w AS (PARTITION BY class ORDER BY score)),
areas AS (
  SELECT class, CAST(sum(label) AS BIGINT) AS positives,
    (sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (CAST(sum(label) AS DOUBLE) * sum(1 - label)) AS auc
  FROM ranked GROUP BY class)
"""


@query("roc_auc_per_class", _AUC + "SELECT class, positives, round(auc, 6) AS auc FROM areas", places=6)
def roc_auc_per_class(spark, sf):
    return ev.roc_auc_per_class(scores(spark, sf))


@query("roc_auc_ovr", _AUC + "SELECT round(sum(auc * positives) / sum(positives), 6) AS roc_auc FROM areas", places=6)
def roc_auc_ovr(spark, sf):
    return ev.roc_auc_ovr(scores(spark, sf))


_R = ", res AS (SELECT y_true - y_pred AS r, y_pred AS p FROM predictions)"
_MOMENTS = _R + """
, c AS (SELECT avg(r) AS m FROM res),
mo AS (SELECT count(*) AS n, avg((r - m) ** 2) AS m2, avg((r - m) ** 3) AS m3, avg((r - m) ** 4) AS m4 FROM res, c),
shape AS (SELECT n, m3 / m2 ** 1.5 AS skewness, m4 / m2 ** 2 - 3 AS kurtosis FROM mo)
"""


@query("residual_stats", _MOMENTS + """
SELECT round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std, min(r) AS min, max(r) AS max, round(any_value(skewness), 6) AS skewness,
  round(any_value(kurtosis), 6) AS kurtosis, round(median(r), 6) AS median, round(quantile_cont(r, 0.25), 6) AS q25,
  round(quantile_cont(r, 0.75), 6) AS q75 FROM res, shape
""", places=6)
def residual_stats(spark, sf):
    return ev.residual_stats(predictions(spark, sf))


@query("normality", _MOMENTS + """
SELECT round(n / 6.0::DOUBLE * (skewness ** 2 + kurtosis ** 2 / 4), 6) AS statistic,
  round(exp(-n / 12.0::DOUBLE * (skewness ** 2 + kurtosis ** 2 / 4)), 6) AS p_value,
  exp(-n / 12.0::DOUBLE * (skewness ** 2 + kurtosis ** 2 / 4)) > 0.05 AS is_normal FROM shape
""", places=6)
def normality(spark, sf):
    return ev.normality(predictions(spark, sf))


@query("kolmogorov_smirnov")
def kolmogorov_smirnov(spark, sf):
    return ev.kolmogorov_smirnov(predictions(spark, sf))


@query("residual_histogram", _R + """
, s AS (SELECT min(r) AS lo, max(r) AS hi FROM res),
n AS (SELECT least(CAST(floor((r - lo) / (hi - lo) * 50) AS INT), 49) AS bin, count(*) AS n FROM res, s GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS lower, round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) AS upper, coalesce(n.n, 0) AS n
FROM (SELECT unnest(range(0, 50)) AS bin) b CROSS JOIN s LEFT JOIN n ON n.bin = b.bin
""", places=6)
def residual_histogram(spark, sf):
    return ev.residual_histogram(predictions(spark, sf))


@query("residual_quantiles", _R + ", " + "q AS (SELECT unnest(range(1, 100)) AS i), v AS (SELECT list_transform(range(1, 100), lambda x: x / 100.0) AS ps)" + """
, obs AS (SELECT quantile_cont(r, [""" + ", ".join(f"{i / 100}" for i in range(1, 100)) + """]) AS o FROM res)
SELECT round(i / 100.0, 6)::DOUBLE AS share, round(o[i], 6) AS observed FROM q, obs
""", places=6)
def residual_quantiles(spark, sf):
    """The normal quantile beside each is checked by test: SQL has no inverse normal."""
    return ev.residual_quantiles(predictions(spark, sf)).drop("theoretical")


@query("residuals_by_prediction", _R + """
, s AS (SELECT min(p) AS lo, max(p) AS hi FROM res)
SELECT least(CAST(floor((p - lo) / (hi - lo) * 20) AS INT), 19) AS bin, round(avg(p), 6) AS mean_predicted, round(avg(r), 6) + 0.0 AS mean_residual,
  round(stddev_pop(r), 6) AS std_residual, count(*) AS n FROM res, s GROUP BY 1
""", places=6)
def residuals_by_prediction(spark, sf):
    return ev.residuals_by_prediction(predictions(spark, sf))


@query("prediction_range", "SELECT least(min(y_true), min(y_pred)) AS low, greatest(max(y_true), max(y_pred)) AS high FROM predictions")
def prediction_range(spark, sf):
    return ev.prediction_range(predictions(spark, sf))


_BASELINES = """
, t AS (SELECT *, CAST(aqi_value AS DOUBLE) AS y, avg(aqi_value) OVER () AS overall,
               lag(aqi_value) OVER (PARTITION BY location ORDER BY timestamp, id) AS last FROM readings),
mm AS (
  SELECT 'mean' AS model, sqrt(avg((y - overall) ** 2)) AS rmse, avg(abs(y - overall)) AS mae FROM t WHERE last IS NOT NULL
  UNION ALL SELECT 'persistence', sqrt(avg((y - last) ** 2)), avg(abs(y - last)) FROM t WHERE last IS NOT NULL
  UNION ALL SELECT 'blend', sqrt(avg((y - (overall + last) / 2) ** 2)), avg(abs(y - (overall + last) / 2)) FROM t WHERE last IS NOT NULL
)
"""


@query("compare_models", _BASELINES + """
SELECT row_number() OVER (ORDER BY rmse, model) AS rank, model, 'rmse' AS metric, round(rmse, 6) AS value FROM mm
""", places=6)
def compare_models(spark, sf):
    """E9 over three simple predictors of the index: overall mean, last value, and their average."""
    from cityflux.operators.features import lag_features

    r = readings(spark, sf)
    overall = r.agg(F.avg("aqi_value")).scalar()
    rows = lag_features(r, ["aqi_value"]).filter(F.col("aqi_value_lag_1h").isNotNull())
    last = F.col("aqi_value_lag_1h").cast("double")
    guesses = {"mean": F.col("overall"), "persistence": last, "blend": (F.col("overall") + last) / 2}
    tidy = rows.withColumn("overall", overall).select(
        F.col("aqi_value").cast("double").alias("y_true"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("model"), g.alias("y_pred")) for n, g in guesses.items()])),
    )
    wide = ev.regression_wide(tidy, by=["model"])
    long = wide.select("model", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("rmse", "mae")])))
    return ev.compare_models(long, "rmse")


@query("performance_trend", """
SELECT CAST(timestamp AS DATE)::VARCHAR AS timestamp, round(avg(CAST(aqi_value AS DOUBLE)), 6) AS value FROM readings
WHERE isodow(timestamp) < 6 GROUP BY 1
""", places=6)
def performance_trend(spark, sf):
    """A history with one entry per day, weekend entries lacking the metric, appended in two writes."""
    days = readings(spark, sf).groupBy(F.to_date("timestamp").alias("d")).agg(F.avg("aqi_value").alias("a"), F.max("aqi_value").alias("m"))
    name = F.when(F.weekday("d") < 5, "mean_aqi").otherwise("weekend_mean")
    entries = days.select(
        F.col("d").cast("string").alias("timestamp"),
        F.create_map(name, F.col("a"), F.lit("max_aqi"), F.col("m").cast("double")).alias("metrics"),
        F.create_map(F.lit("model"), F.lit("none")).alias("metadata"),
    )
    path = fresh_path(spark, "history")
    early = F.col("timestamp") < "2024-01-16"
    ev.log_performance(path, entries.filter(early))
    ev.log_performance(path, entries.filter(~early))
    return ev.performance_trend(spark.read.parquet(path), "mean_aqi")


@query("evaluation_report", _REG + """
, m AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m} AS value FROM w" for m in ev.REGRESSION) + """)
SELECT 'MODEL EVALUATION: aqi_value' AS line UNION ALL SELECT repeat('-', 60) UNION ALL SELECT metric || ': ' || printf('%.4f', value) FROM m
""")
def evaluation_report(spark, sf):
    """The evaluation report of the predictions, written and read back."""
    from cityflux.plans.scratch import fresh_path
    from cityflux.runs import reports
    from cityflux.sources.exports import write_text

    path = fresh_path(spark, "report")
    write_text(spark, reports.evaluation_report(ev.regression_metrics(predictions(spark, sf)), "aqi_value"), path)
    return spark.read.text(path).withColumnRenamed("value", "line").filter("line <> ''")
