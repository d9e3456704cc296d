"""Model quality from predictions: regression, classes, residuals, comparison, history."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityflux.functions.numbers import ratio
from cityflux.plans.ranks import percentiles
from cityflux.plans.scratch import materialize
from cityflux.plans.series import running_sum


def _tidy(wide: DataFrame, names: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    rows = [F.struct(F.lit(n).alias(name), F.col(n).cast("double").alias(value)) for n in names]
    return wide.select(F.inline(F.array(*rows)))


REGRESSION = [
    "mse", "rmse", "mae", "r2", "mape", "residual_mean", "residual_std", "residual_min", "residual_max", "adj_r2",
]


def regression_wide(df: DataFrame, true: str = "y_true", pred: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    """E1 as one row per group, from one pass; rows with a true value of 0 are left out of the percent error."""
    y, r = F.col(true), F.col(true) - F.col(pred)
    sums = df.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(r * r).alias("mse"),
        F.avg(F.abs(r)).alias("mae"),
        F.var_pop(y).alias("_var"),
        (F.coalesce(F.avg(F.when(y != 0, F.abs(r / F.nullif(y, F.lit(0.0))))), F.lit(0.0)) * 100).alias("mape"),
        F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_std"),
        F.min(r).alias("residual_min"), F.max(r).alias("residual_max"),
    )
    # A constant target explains nothing: 1 when met exactly, else 0.
    r2 = F.when(F.col("_var") == 0, (F.col("mse") == 0).cast("double")).otherwise(
        1 - F.try_divide(F.col("mse"), F.col("_var"))
    )
    out = sums.withColumns({"rmse": F.sqrt("mse"), "r2": r2})
    adjusted = 1 - F.try_divide((1 - F.col("r2")) * (F.col("n") - 1).cast("double"), (F.col("n") - 2).cast("double"))
    return out.withColumn("adj_r2", adjusted).select(*(by or []), *REGRESSION)


def regression_metrics(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(metric, value)."""
    return _tidy(regression_wide(df, true, pred), REGRESSION)


def confusion_counts(df: DataFrame, true: str = "c_true", pred: str = "c_pred") -> DataFrame:
    """Rows per (actual, predicted) pair that occurs; everything below starts from these few rows."""
    return df.groupBy(F.col(true).alias("actual"), F.col(pred).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, true: str = "c_true", pred: str = "c_pred") -> DataFrame:
    """Every pair of labels seen on either side, zeros included."""
    counts = confusion_counts(df, true, pred)
    seen = counts.agg(F.array_union(F.collect_set("actual"), F.collect_set("predicted")).alias("labels"))
    pairs = seen.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted")
    )
    return pairs.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_wide(df: DataFrame, labels: list, true: str = "c_true", pred: str = "c_pred") -> DataFrame:
    """E3 wide: one row per actual label, one column per given label and per other label predicted."""
    counts = materialize(confusion_counts(df, true, pred), "confusion")
    seen = {r[0] for r in counts.select("predicted").distinct().collect()} - {None}
    columns = [*labels, *sorted(seen - set(labels))]
    return counts.groupBy("actual").pivot("predicted", columns).sum("n").fillna(0)


def per_class(df: DataFrame, true: str = "c_true", pred: str = "c_pred") -> DataFrame:
    """Precision, recall, F1 and support per label; a ratio without cases is 0."""
    counts = confusion_counts(df, true, pred)
    sides = [
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("hit")),
    ]
    sums = counts.select(F.inline(F.array(*sides))).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "guessed", "hit")]
    )
    precision, recall = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    f1 = ratio(2 * F.col("hit"), F.col("guessed") + F.col("support"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit")


def _weighted(col: str) -> Column:
    return ratio(F.sum(F.col(col) * F.col("support")), F.sum("support"))


def classification_metrics(df: DataFrame, true: str = "c_true", pred: str = "c_pred") -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 as (metric, value)."""
    names = ["accuracy", "precision", "recall", "f1"]
    wide = per_class(df, true, pred).agg(
        ratio(F.sum("hit"), F.sum("support")).alias("accuracy"), *[_weighted(c).alias(c) for c in names[1:]]
    )
    return _tidy(wide, names)


def classification_report(df: DataFrame, true: str = "c_true", pred: str = "c_pred") -> DataFrame:
    """The classes, then plain and support-weighted averages."""
    classes = per_class(df, true, pred)
    names = ["precision", "recall", "f1"]
    macro = classes.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = classes.agg(*[_weighted(c).alias(c) for c in names], F.sum("support").alias("support"))
    out = classes.select(F.col("label").cast("string").alias("label"), *names, "support")
    for label, part in (("macro avg", macro), ("weighted avg", weighted)):
        out = out.unionByName(part.select(F.lit(label).alias("label"), *names, "support"))
    return out


def roc_auc_per_class(scores: DataFrame, cls: str = "class", label: str = "label", score: str = "score", **plan) -> DataFrame:
    """Area under the ROC curve of each class against the rest: (class, positives, auc), ties counted half.

    Scores are first counted; the running count of negatives goes along distinct scores.
    """
    counts = scores.groupBy(F.col(cls).alias("class"), F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg")
    )
    ranked = running_sum(counts, ["class"], ["s"], "neg", "upto", **plan)
    below = F.col("upto") - F.col("neg")
    won = F.sum(F.col("pos").cast("double") * (below + F.col("neg") / F.lit(2.0)))
    area = F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg"))
    return ranked.groupBy("class").agg(F.sum("pos").alias("positives"), area.alias("auc"))


def roc_auc_ovr(scores: DataFrame, **kw) -> DataFrame:
    """E5: the class areas weighted by how often the class occurs."""
    per = roc_auc_per_class(scores, **kw).filter(F.col("auc").isNotNull())
    return per.agg(ratio(F.sum(F.col("auc") * F.col("positives")), F.sum("positives")).alias("roc_auc"))


def explode_scores(df: DataFrame, probability: str, classes: list, true: str) -> DataFrame:
    """Class probabilities of a prediction frame as (class, label, score) rows; a class the model never saw scores 0."""
    cells = [
        F.struct(F.lit(c).alias("class"), (F.col(true) == c).cast("int").alias("label"), F.coalesce(F.get(F.col(probability), F.lit(i)), F.lit(0.0)).alias("score"))
        for i, c in enumerate(classes)
    ]
    return df.select(F.inline(F.array(*cells)))


def residuals(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.select((F.col(true) - F.col(pred)).cast("double").alias("r"), F.col(pred).cast("double").alias("p"))


def residual_stats(df: DataFrame, true: str = "y_true", pred: str = "y_pred", **plan) -> DataFrame:
    """Moments with population forms, exact quartiles."""
    rows = residuals(df, true, pred)
    q = percentiles(rows, "r", {"median": 0.5, "q25": 0.25, "q75": 0.75}, **plan).select(F.struct("*")).scalar()
    wide = rows.agg(
        F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.min("r").alias("min"), F.max("r").alias("max"),
        F.skewness("r").alias("skewness"), F.kurtosis("r").alias("kurtosis"),
    )
    return wide.select("*", *[q[c].alias(c) for c in ("median", "q25", "q75")])


def normality(df: DataFrame, true: str = "y_true", pred: str = "y_pred", level: float = 0.05) -> DataFrame:
    """Jarque-Bera statistic from the moments; its chi-squared(2) tail is exp(-x/2)."""
    m = residuals(df, true, pred).agg(F.count("r").alias("n"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"))
    stat = F.col("n") / F.lit(6.0) * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / F.lit(4.0))
    p = F.exp(-stat / F.lit(2.0))
    return m.select(stat.alias("statistic"), p.alias("p_value"), (p > level).alias("is_normal"))


def kolmogorov_smirnov(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Distance of the residuals from the normal law with their own mean and deviation."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    rows = residuals(df, true, pred)
    mean, std = rows.agg(F.avg("r"), F.stddev_pop("r")).collect()[0]
    return KolmogorovSmirnovTest.test(rows, "r", "norm", mean, std or 1.0)


def residual_histogram(df: DataFrame, true: str = "y_true", pred: str = "y_pred", bins: int = 50) -> DataFrame:
    """Even bins over the range, the last closed; a single value gets a range of one around it."""
    rows = residuals(df, true, pred)
    lo, hi = F.min("r"), F.max("r")
    span = rows.agg(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"))
    s = span.select(F.struct("lo", "hi").alias("s")).scalar()
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.least(F.floor((F.col("r") - s["lo"]) / (s["hi"] - s["lo"]) * bins), F.lit(bins - 1))
    counts = rows.select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    frame = span.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "lo", "hi")
    return frame.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def residual_quantiles(df: DataFrame, true: str = "y_true", pred: str = "y_pred", points: int = 99, **plan) -> DataFrame:
    """Normal quantile against residual quantile, at even shares."""
    shares = [(i + 1) / (points + 1) for i in range(points)]
    q = percentiles(residuals(df, true, pred), "r", {f"q{i}": p for i, p in enumerate(shares)}, **plan)
    rows = [
        F.struct(F.lit(p).alias("share"), F.lit(NormalDist().inv_cdf(p)).alias("theoretical"), F.col(f"q{i}").alias("observed"))
        for i, p in enumerate(shares)
    ]
    return q.select(F.inline(F.array(*rows)))


def residuals_by_prediction(df: DataFrame, true: str = "y_true", pred: str = "y_pred", bins: int = 20) -> DataFrame:
    """Residual mean, spread and rows per even slice of the predicted value."""
    rows = residuals(df, true, pred)
    s = rows.agg(F.struct(F.min("p").alias("lo"), F.max("p").alias("hi")).alias("s")).scalar()
    share = F.coalesce(F.try_divide(F.col("p") - s["lo"], s["hi"] - s["lo"]), F.lit(0.0))
    at = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    return rows.withColumn("bin", at).groupBy("bin").agg(
        F.avg("p").alias("mean_predicted"), F.avg("r").alias("mean_residual"),
        F.stddev_pop("r").alias("std_residual"), F.count(F.lit(1)).alias("n"),
    )


def prediction_range(df: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Ends of the line of equal actual and predicted values."""
    return df.agg(
        F.least(F.min(true), F.min(pred)).alias("low"), F.greatest(F.max(true), F.max(pred)).alias("high")
    )


def compare_models(metrics: DataFrame, metric: str) -> DataFrame:
    """Models that have the metric, smallest value first: (rank, model, metric, value)."""
    from pyspark.sql import Window as W

    rows = metrics.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    # One row per model.
    return rows.select(
        F.row_number().over(W.partitionBy("metric").orderBy("value", "model")).alias("rank"), "model", "metric", "value"
    )


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features."""
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)


def log_performance(history_path: str, entries: DataFrame) -> None:
    """Append (timestamp, metrics map, metadata map) rows to the history."""
    entries.write.mode("append").parquet(history_path)


def performance_trend(history: DataFrame, metric: str) -> DataFrame:
    """Entries that hold the metric, as (timestamp, value)."""
    value = F.try_element_at("metrics", F.lit(metric))
    return history.select("timestamp", value.alias("value")).filter(F.map_contains_key("metrics", metric))
