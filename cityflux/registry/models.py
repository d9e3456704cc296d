"""Models, forecasts and whole runs, at the library's settings of record; the one-split twins have closed forms in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cityflux.operators import evaluation as ev, forecasting, models
from cityflux.operators.features import engineer_features, prepare_features
from cityflux.operators.splits import time_split
from cityflux.plans.scratch import fresh_path, materialize, spread
from cityflux.registry.base import query, readings
from cityflux.registry.describe import FINDINGS_SQL
from cityflux.registry.features import feature_sql, means_sql

# --- SQL twins with all features: rows, ridge fits by elimination, positions ---------------------

_FEATURES = ["hour", "day_of_week", "month", "is_weekend", "is_rush_hour", "traffic_level", "latitude", "longitude"]
_FEATURES += [f"{m}_{tag}" for m in ("aqi_value", "traffic_level") for tag in ("lag_1h", "lag_2h", "lag_24h", "ma_3h", "ma_6h", "ma_24h")]
_WIDTH = len(_FEATURES) + 2

# ``x``: position rn, count n and v = [1, features, target], all but the 1 less their means.
_ROWS_SQL = feature_sql("readings", means_sql(24, digits=None)) + f"""
, raw AS (SELECT row_number() OVER (ORDER BY timestamp, id) - 1 AS rn, count(*) OVER () AS n, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in [*_FEATURES, "aqi_value"])}
          FROM features WHERE aqi_value_lag_24h IS NOT NULL),
mu AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in [*_FEATURES, "aqi_value"])} FROM raw),
x AS MATERIALIZED (SELECT rn, n, [1, {", ".join(f"raw.{c} - mu.{c}" for c in [*_FEATURES, "aqi_value"])}] AS v, raw.aqi_value AS y FROM raw, mu)
"""


def _gram_sql(runs: str) -> str:
    """CTE ``cells``: sums of v[i] * v[j] per run of positions; ``runs`` is an expression of rn and n."""
    return f"""
, cells AS MATERIALIZED (SELECT {runs} AS run, i, j, sum(v[i] * v[j]) AS s
          FROM x, (SELECT unnest(range(1, {_WIDTH + 1})) AS i) a, (SELECT unnest(range(1, {_WIDTH + 1})) AS j) b GROUP BY 1, 2, 3)
"""


def _ridge_sql(fits: str) -> str:
    """CTE ``fit`` (key, w): residuals are the products of w and v. ``fits`` has rows (key, run): the runs each fit learns from."""
    p = len(_FEATURES)
    out = f"""
, fits AS ({fits}),
g AS (SELECT key, i, j, sum(s) AS s FROM fits JOIN cells USING (run) GROUP BY 1, 2, 3),
ends AS (SELECT key, max(s) FILTER (i = 1 AND j = 1) AS n FROM g GROUP BY key),
centered AS (SELECT g.key, g.i, g.j, g.s - a.s * b.s / n + CASE WHEN g.i = g.j THEN 1.0::DOUBLE ELSE 0 END AS s
             FROM g JOIN g a ON a.key = g.key AND a.i = 1 AND a.j = g.i JOIN g b ON b.key = g.key AND b.i = 1 AND b.j = g.j JOIN ends ON ends.key = g.key
             WHERE g.i > 1 AND g.i < {_WIDTH} AND g.j > 1),
e0 AS (SELECT key, list(r ORDER BY i) AS m FROM (SELECT key, i, list(s ORDER BY j) AS r FROM centered GROUP BY key, i) GROUP BY key)"""
    for k in range(1, p + 1):
        out += f""",
e{k} AS MATERIALIZED (SELECT key, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda q: q / r[{k}])
        ELSE list_transform(r, lambda q, c: q - r[{k}] / m[{k}][{k}] * m[{k}][c]) END) AS m FROM e{k - 1})"""
    return out + f""",
solved AS (SELECT key, list_transform(m, lambda r: r[{p + 1}]) AS w FROM e{p}),
means AS (SELECT key, list(s / n ORDER BY j) AS a FROM g JOIN ends USING (key) WHERE i = 1 GROUP BY key),
fit AS MATERIALIZED (SELECT key, list_concat([list_dot_product(a[2:{_WIDTH - 1}], w) - a[{_WIDTH}]], list_transform(w, lambda q: -q), [1.0::DOUBLE]) AS w FROM solved JOIN means USING (key))
"""


def _fold_of(k: int) -> str:
    return f"CASE WHEN rn < (n // {k} + 1) * (n % {k}) THEN rn // (n // {k} + 1) ELSE n % {k} + (rn - (n // {k} + 1) * (n % {k})) // (n // {k}) END"


_SPLIT = "CASE WHEN rn < floor(n * 0.8::DOUBLE) - floor(floor(n * 0.8::DOUBLE) * 0.2::DOUBLE) THEN 0 WHEN rn < floor(n * 0.8::DOUBLE) THEN 1 ELSE 2 END"
# ------------------------------------------------------------------------------------------------

def _prepared(spark, sf, target):
    """Features of all readings, split by time, written once since fitting reads them many times."""
    r = readings(spark, sf)
    rows = prepare_features(engineer_features(r, feature_set="no_leak"), target, ["id", "timestamp"])
    prepared = materialize(spread(rows, r.count()), "prepared")
    return time_split(prepared)


def _parts(rows):
    return [rows.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]


def _metrics(spark, sf, target, kind, **settings):
    head, val, test = _parts(_prepared(spark, sf, target))
    return models.evaluate(models.train(head, target, kind, val, **settings), test)


@query("aqi_forest")
def aqi_forest(spark, sf):
    return _metrics(spark, sf, "aqi_value", "random_forest")


@query("aqi_gbt")
def aqi_gbt(spark, sf):
    return _metrics(spark, sf, "aqi_value", "gradient_boosting")


@query("aqi_ridge", _ROWS_SQL + _gram_sql(_SPLIT) + _ridge_sql("SELECT 0 AS key, 0 AS run") + f"""
, r AS (SELECT y, list_dot_product(v, w) AS r FROM x, fit WHERE {_SPLIT} = 2),
m AS (SELECT count(*) AS n, avg(r * r) AS mse, avg(abs(r)) AS mae, 1 - avg(r * r) / var_pop(y) AS r2, avg(CASE WHEN y <> 0 THEN abs(r / y) END) * 100 AS mape,
             avg(r) AS residual_mean, stddev_pop(r) AS residual_std, min(r) AS residual_min, max(r) AS residual_max FROM r)
SELECT unnest(['mse', 'rmse', 'mae', 'r2', 'mape', 'residual_mean', 'residual_std', 'residual_min', 'residual_max', 'adj_r2']) AS metric,
       round(unnest([mse, sqrt(mse), mae, r2, mape, residual_mean, residual_std, residual_min, residual_max, 1 - (1 - r2) * (n - 1) / (n - 2)]), 3) AS value FROM m
""", places=3)
def aqi_ridge(spark, sf):
    return _metrics(spark, sf, "aqi_value", "linear")


@query("traffic_forest")
def traffic_forest(spark, sf):
    return _metrics(spark, sf, "traffic_level", "random_forest")


@query("traffic_boosted")
def traffic_boosted(spark, sf):
    return _metrics(spark, sf, "traffic_level", "gradient_boosting")


@query("feature_importance")
def feature_importance(spark, sf):
    head, val, _ = _parts(_prepared(spark, sf, "aqi_value"))
    fitted = models.train(head, "aqi_value", "random_forest", val)
    return ev.top_features(fitted.importance(spark))


@query("train_report")
def train_report(spark, sf):
    """M8: the stored training metrics of a model."""
    head, val, _ = _parts(_prepared(spark, sf, "aqi_value"))
    history = models.train(head, "aqi_value", "linear", val).history(spark)
    return history.select("model_type", "target", "train_samples", F.explode("metrics").alias("metric", "value"))


@query("model_roundtrip", """
, p AS (SELECT row_number() OVER (PARTITION BY location ORDER BY timestamp, id) - 1 AS pos FROM readings)
SELECT 0 AS differing, count(*) - CAST(floor(count(*) * (1 - 0.2::DOUBLE)) AS BIGINT) AS rows FROM p WHERE pos >= 24
""")
def model_roundtrip(spark, sf):
    """Rows on which a saved and reloaded model predicts otherwise than the original, and rows in all."""
    head, _, test = _parts(_prepared(spark, sf, "aqi_value"))
    fitted = models.train(head, "aqi_value", "random_forest")
    path = fresh_path(spark, "model")
    models.save_model(fitted, spark, path)
    again = models.load_model(spark, path)
    a = fitted.predict(test).select("id", F.col("prediction").alias("a"))
    b = again.predict(test).select("id", F.col("prediction").alias("b"))
    return a.join(b, "id").agg(F.count_if(F.col("a") != F.col("b")).alias("differing"), F.count(F.lit(1)).alias("rows"))


@query("grid_search")
def grid_search(spark, sf):
    head = _parts(_prepared(spark, sf, "aqi_value"))[0]
    _, scores = models.grid_search(head, "aqi_value", "random_forest", models.FOREST_GRID)
    return scores.select(F.to_json("settings").alias("settings"), "mse")


@query("cross_validate", _ROWS_SQL + _gram_sql(_fold_of(5)) + _ridge_sql("SELECT key, run FROM (SELECT unnest(range(0, 5)) AS key) a, (SELECT unnest(range(0, 5)) AS run) b WHERE key <> run") + f"""
SELECT key AS fold, round(avg(list_dot_product(v, w) ** 2), 3) AS score FROM x JOIN fit ON key = {_fold_of(5)} GROUP BY key
""", places=3)
def cross_validate(spark, sf):
    rows = _prepared(spark, sf, "aqi_value").drop("split")
    return models.cross_validate(rows, "aqi_value", "linear", folds=5)


@query("cross_validate_classes")
def cross_validate_classes(spark, sf):
    rows = _prepared(spark, sf, "traffic_level").drop("split")
    scores = models.cross_validate(rows, "traffic_level", "random_forest")
    return models.cv_summary(scores)


@query("learning_curve", _ROWS_SQL + f"""
, sizes AS MATERIALIZED (SELECT {_fold_of(5)} AS k, count(*) AS nk, min(rn) AS a, any_value(n) AS n FROM x GROUP BY 1),
tries AS MATERIALIZED (SELECT k * 100 + s AS key, k, a, nk, s / 10 AS share, CAST(floor((n - nk) * (s / 10)) AS BIGINT) AS size,
          CASE WHEN floor((n - nk) * (s / 10)) <= a THEN floor((n - nk) * (s / 10)) ELSE floor((n - nk) * (s / 10)) + nk END AS stop
          FROM sizes, (SELECT unnest(range(1, 11)) AS s)),
starts AS MATERIALIZED (SELECT b, row_number() OVER (ORDER BY b) AS run FROM (SELECT a AS b FROM sizes UNION SELECT stop FROM tries))
""" + _gram_sql("(SELECT count(*) FROM starts WHERE b <= rn)") + _ridge_sql("SELECT key, run FROM tries, starts WHERE b < stop AND NOT (b >= a AND b < a + nk)") + """
, errors AS (SELECT key, avg(CASE WHEN rn < stop AND NOT (rn >= a AND rn < a + nk) THEN list_dot_product(v, w) ** 2 END) AS train,
          avg(CASE WHEN rn >= a AND rn < a + nk THEN list_dot_product(v, w) ** 2 END) AS val FROM x, tries JOIN fit USING (key) GROUP BY key)
SELECT share, min(size) AS train_size, round(avg(train), 2) AS train_mean, round(stddev_pop(train), 2) AS train_std,
       round(avg(val), 2) AS val_mean, round(stddev_pop(val), 2) AS val_std FROM tries JOIN errors USING (key) GROUP BY share
""", places=2)
def learning_curve(spark, sf):
    rows = _prepared(spark, sf, "aqi_value").drop("split")
    return models.learning_curve(rows)


@query("forecast_fit")
def forecast_fit(spark, sf):
    fit = forecasting.forecast_fit(readings(spark, sf))
    return fit.select("location", "step", "intercept", F.posexplode("weights").alias("lag", "weight"))


@query("forecast")
def forecast(spark, sf):
    r = readings(spark, sf)
    return forecasting.forecast(r, forecasting.forecast_fit(r))


@query("forecast_one_step", """
, r AS (SELECT location, CAST(aqi_value AS DOUBLE) AS v, lag(CAST(aqi_value AS DOUBLE)) OVER w AS p,
               row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY location) AS n
        FROM readings WINDOW w AS (PARTITION BY location ORDER BY timestamp, id)),
f AS (SELECT location, regr_slope(v, p) AS b, regr_intercept(v, p) AS a FROM r WHERE i >= 1 AND i < n - 1 GROUP BY location)
SELECT r.location, 1 AS step, round(a + b * r.v, 4) AS value FROM r JOIN f ON r.location = f.location WHERE i = n - 1
""", places=4)
def forecast_one_step(spark, sf):
    """M9, M10 with one value back and one ahead, where SQL has the regression too."""
    r = readings(spark, sf)
    fit = forecasting.forecast_fit(r, lookback=1, horizon=1)
    return forecasting.forecast(r, fit, lookback=1, horizon=1).drop("reason")


@query("ridge_one_feature", """
, s AS (SELECT covar_pop(aqi_value, traffic_level) AS c, var_pop(traffic_level) AS v, count(*) AS n, avg(aqi_value) AS my, avg(traffic_level) AS mx FROM readings)
SELECT round(c / (v + 1.0::DOUBLE / n), 5) AS weight, round(my - c / (v + 1.0::DOUBLE / n) * mx, 5) AS intercept FROM s
""", places=5)
def ridge_one_feature(spark, sf):
    """M4 with a single feature, where SQL has the closed form."""
    rows = readings(spark, sf).select("traffic_level", F.col("aqi_value").cast("double").alias("aqi_value"))
    line = models.train(rows, "aqi_value", "linear").model.stages[-1]
    return spark.createDataFrame([(float(line.coefficients[0]), float(line.intercept))], "weight double, intercept double")


_STUMP = """
, cuts AS (
  SELECT t, sum(n * v) AS loss FROM (
    SELECT t, traffic_level > t AS above, count(*) AS n, var_pop(aqi_value) AS v FROM readings, (SELECT unnest([1, 2, 3, 4]) AS t) GROUP BY 1, 2) GROUP BY t
), best AS (SELECT t FROM cuts ORDER BY loss, t LIMIT 1)
SELECT traffic_level, round(avg(avg_side), 5) AS prediction FROM (
  SELECT traffic_level, avg(aqi_value) OVER (PARTITION BY traffic_level > t) AS avg_side FROM readings, best) GROUP BY traffic_level
"""


def _level_and_index(spark, sf):
    return readings(spark, sf).select("traffic_level", F.col("aqi_value").cast("double").alias("aqi_value"))


@query("aqi_forest_stump", _STUMP, places=5)
def aqi_forest_stump(spark, sf):
    """M2 where SQL has the closed form: one tree with one split is the best split by variance."""
    rows = _level_and_index(spark, sf)
    fitted = models.train(rows, "aqi_value", "random_forest", numTrees=1, maxDepth=1, bootstrap=False)
    return fitted.predict(rows.select("traffic_level").distinct())


@query("aqi_gbt_stump", _STUMP, places=5)
def aqi_gbt_stump(spark, sf):
    """M3 where SQL has the closed form: the first round is the best split by variance."""
    rows = _level_and_index(spark, sf)
    fitted = models.train(rows, "aqi_value", "gradient_boosting", maxIter=1, maxDepth=1)
    return fitted.predict(rows.select("traffic_level").distinct())


@query("traffic_forest_stump", """
, sides AS (SELECT t, hour(timestamp) > t AS above, traffic_level AS level, count(*) AS n FROM readings, (SELECT unnest(range(0, 23)) AS t) GROUP BY 1, 2, 3)
, whole AS (SELECT *, sum(n) OVER (PARTITION BY t, above) AS m FROM sides)
, cuts AS (SELECT t, sum(g) AS loss FROM (SELECT t, above, any_value(m) * (1 - sum((n / m) * (n / m))) AS g FROM whole GROUP BY 1, 2) GROUP BY t)
, best AS (SELECT t FROM cuts ORDER BY loss, t LIMIT 1)
SELECT h.hour::BIGINT AS hour, w.level::BIGINT AS level, round(w.n / w.m, 5) AS probability
FROM (SELECT DISTINCT hour(timestamp) AS hour FROM readings) h, best b JOIN whole w ON w.t = b.t WHERE w.above = (h.hour > b.t)
""", places=5)
def traffic_forest_stump(spark, sf):
    """M5, M11 where SQL has the closed form: one split by Gini, leaf shares as probabilities."""
    rows = readings(spark, sf).select(F.hour("timestamp").alias("hour"), "traffic_level")
    fitted = models.train(rows, "traffic_level", "random_forest", numTrees=1, maxDepth=1, bootstrap=False)
    told = fitted.predict(rows.select("hour").distinct())
    return told.select("hour", F.posexplode("probability").alias("at", "probability")).select("hour", (F.col("at") + 1).alias("level"), "probability")


@query("traffic_boosted_stump", """
, d AS (SELECT hour(timestamp) AS hour, traffic_level AS y FROM readings),
prior AS (SELECT k, count(*) FILTER (y = k) / count(*) AS p FROM d, (SELECT unnest(range(1, 6)) AS k) GROUP BY k),
r AS (SELECT hour, k, CASE WHEN y = k THEN 1 - p ELSE -p END AS r FROM d, prior),
sums AS (SELECT k, hour, count(*) AS n, sum(r) AS g, sum(abs(r) * (1 - abs(r))) AS h FROM r GROUP BY k, hour),
sides AS (SELECT s.k, t.hour AS t, s.hour > t.hour AS above, sum(n) AS n, sum(g) AS g, sum(h) AS h FROM sums s, (SELECT DISTINCT hour FROM d) t GROUP BY 1, 2, 3),
best AS (SELECT k, arg_max(t, gain) AS t FROM (SELECT k, t, sum(g * g / n) AS gain FROM sides GROUP BY k, t HAVING count(*) = 2) GROUP BY k),
logits AS (SELECT a.hour, b.k, ln(p) + 0.1::DOUBLE * 0.8::DOUBLE * s.g / s.h AS f
           FROM (SELECT DISTINCT hour FROM d) a, best b JOIN sides s ON s.k = b.k AND s.t = b.t JOIN prior ON prior.k = b.k WHERE s.above = (a.hour > b.t))
SELECT hour::BIGINT AS hour, k::BIGINT AS level, round(exp(f) / sum(exp(f)) OVER (PARTITION BY hour), 5) AS probability FROM logits
""", places=5)
def traffic_boosted_stump(spark, sf):
    """M5, M11 where SQL has the closed form: one round of one split per class on the multinomial gradient."""
    rows = readings(spark, sf).select(F.hour("timestamp").alias("hour"), "traffic_level")
    fitted = models.train(rows, "traffic_level", "gradient_boosting", maxIter=1, maxDepth=1)
    told = fitted.predict(rows.select("hour").distinct())
    return told.select("hour", F.posexplode("probability").alias("at", "probability")).select("hour", (F.col("at") + 1).alias("level"), "probability")


@query("train_report_one_feature", """
, s AS (SELECT covar_pop(aqi_value, traffic_level) AS c, var_pop(traffic_level) AS v, count(*) AS n, avg(aqi_value) AS my, avg(traffic_level) AS mx FROM readings)
, e AS (SELECT aqi_value - (my + c / (v + 1.0::DOUBLE / n) * (traffic_level - mx)) AS r FROM readings, s)
SELECT 'linear' AS model_type, (SELECT n FROM s) AS train_samples, 'traffic_level' AS features,
       round(sqrt(avg(r * r)), 5) AS train_rmse, round(avg(abs(r)), 5) AS train_mae FROM e
""", places=5)
def train_report_one_feature(spark, sf):
    """M8 where SQL has the closed form: what is stored about a training, with its errors."""
    told = models.train(_level_and_index(spark, sf), "aqi_value", "linear").history(spark)
    metrics = [F.col("metrics")[m].alias(m) for m in ("train_rmse", "train_mae")]
    return told.select("model_type", "train_samples", F.array_join("features", ",").alias("features"), *metrics)


@query("analysis_run")
def analysis_run(spark, sf):
    """P5: the test metrics of both models after the whole run."""
    from cityflux.registry.base import AS_OF, dirty_readings
    from cityflux.runs.analysis import run_analysis

    done = run_analysis(dirty_readings(spark, sf), fresh_path(spark, "run"), AS_OF)
    parts = [m.select(F.lit(name).alias("model"), "metric", "value") for name, m in done.metrics.items()]
    return parts[0].unionByName(parts[1])


def _said(t: str) -> str:
    """A time as text; whole seconds have no fraction."""
    return f"CASE WHEN epoch_us({t}) % 1000000 = 0 THEN strftime({t}, '%Y-%m-%d %H:%M:%S') ELSE strftime({t}, '%Y-%m-%d %H:%M:%S.%f') END"


@query("insight_report", f"""
, kf AS (WITH {FINDINGS_SQL.strip().lstrip(",")}),
i AS (SELECT count(*) AS n, min(timestamp) AS a, max(timestamp) AS b, count(DISTINCT location) AS locations FROM readings),
q AS (SELECT avg(aqi_value) AS mean, median(aqi_value) AS median, stddev_samp(aqi_value) AS std, min(aqi_value) AS low, max(aqi_value) AS high FROM readings)
SELECT unnest(['TRAFFIC AND AIR QUALITY REPORT', 'Data', 'Findings', 'Air quality index'] || [repeat('-', 60), repeat('-', 60), repeat('-', 60), repeat('-', 60)]) AS line
UNION ALL SELECT 'Records: ' || format('{{:,}}', n) FROM i
UNION ALL SELECT 'From ' || {_said("a")} || ' to ' || {_said("b")} || ', ' || ((epoch_us(b) - epoch_us(a)) // 86400000000) || ' whole days' FROM i
UNION ALL SELECT 'Locations: ' || locations FROM i
UNION ALL SELECT row_number() OVER (ORDER BY ord) || '. [' || category || '] ' || finding FROM kf
UNION ALL SELECT printf('Mean %.2f, median %.2f, standard deviation %.2f', mean, median, std) FROM q
UNION ALL SELECT printf('Range %.0f to %.0f', low::DOUBLE, high::DOUBLE) FROM q
""")
def insight_report(spark, sf):
    """The text report of the readings, written and read back, all its lines."""
    from cityflux.operators import describe, findings
    from cityflux.runs import reports
    from cityflux.sources.exports import write_text

    r = readings(spark, sf)
    text = reports.insight_report(describe.dataset_info(r), findings.key_findings(r), describe.summary_statistics(r))
    path = fresh_path(spark, "report")
    write_text(spark, text, path)
    return spark.read.text(path).withColumnRenamed("value", "line").filter("line <> ''")


def _folds_sql(k: int) -> str:
    """CTE ``f``: readings as (y, x, rn, n, fold) in k contiguous folds along time."""
    return f"""
, r AS (SELECT CAST(aqi_value AS DOUBLE) AS y, CAST(traffic_level AS DOUBLE) AS x,
               row_number() OVER (ORDER BY timestamp, id) - 1 AS rn, count(*) OVER () AS n FROM readings),
f AS (SELECT *, CASE WHEN rn < (n // {k} + 1) * (n % {k}) THEN rn // (n // {k} + 1)
                     ELSE n % {k} + (rn - (n // {k} + 1) * (n % {k})) // (n // {k}) END AS fold FROM r)
"""


def _one_feature(spark, sf):
    return readings(spark, sf).select("id", "timestamp", "traffic_level", F.col("aqi_value").cast("double").alias("aqi_value"))


@query("cross_validate_one_feature", _folds_sql(5) + """
, s AS (SELECT k, covar_pop(y, x) / (var_pop(x) + 1.0::DOUBLE / count(*)) AS b, avg(y) AS my, avg(x) AS mx
        FROM f, (SELECT unnest(range(0, 5)) AS k) WHERE fold <> k GROUP BY k)
SELECT k AS fold, round(avg((y - my - b * (x - mx)) ** 2), 4) AS score FROM f JOIN s ON f.fold = s.k GROUP BY k
""", places=4)
def cross_validate_one_feature(spark, sf):
    """E6 with a single feature, where SQL has the closed form."""
    return models.cross_validate(_one_feature(spark, sf), "aqi_value", "linear", folds=5)


@query("learning_curve_one_feature", _folds_sql(3) + """
, sizes AS (SELECT fold AS k, count(*) AS nk FROM f GROUP BY 1),
t AS (SELECT k, share, y, x, fold, CAST(floor((n - nk) * share) AS BIGINT) AS size, CASE WHEN fold < k THEN rn ELSE rn - nk END AS pos
      FROM f, sizes, (SELECT unnest([0.2::DOUBLE, 0.6::DOUBLE, 1.0::DOUBLE]) AS share)),
s AS (SELECT k, share, min(size) AS size, covar_pop(y, x) / (var_pop(x) + 1.0::DOUBLE / count(*)) AS b, avg(y) AS my, avg(x) AS mx
      FROM t WHERE fold <> k AND pos < size GROUP BY 1, 2),
e AS (SELECT t.k, t.share, min(s.size) AS size,
        avg(CASE WHEN fold <> t.k AND pos < t.size THEN (y - my - b * (x - mx)) ** 2 END) AS train,
        avg(CASE WHEN fold = t.k THEN (y - my - b * (x - mx)) ** 2 END) AS val
      FROM t JOIN s ON t.k = s.k AND t.share = s.share GROUP BY 1, 2)
SELECT share, min(size) AS train_size, round(avg(train), 4) AS train_mean, round(stddev_pop(train), 4) AS train_std,
       round(avg(val), 4) AS val_mean, round(stddev_pop(val), 4) AS val_std FROM e GROUP BY share
""", places=4)
def learning_curve_one_feature(spark, sf):
    """E7 with a single feature, where SQL has the closed form."""
    return models.learning_curve(_one_feature(spark, sf), folds=3, shares=(0.2, 0.6, 1.0))
