"""P5: load, prepare, describe, train, evaluate, export."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityflux.functions.times import AsOf
from cityflux.operators import describe, evaluation as ev, features, findings, models, splits
from cityflux.plans.scratch import materialize, spread
from cityflux.runs import reports
from cityflux.sources import exports
from cityflux.sources.tables import scan_range

TEST_SHARE = 0.2
VAL_SHARE = 0.2


@dataclass
class Result:
    """What a run leaves: the prepared rows, named result tables, metrics per model, report texts."""

    prepared: DataFrame
    tables: dict[str, DataFrame]
    metrics: dict[str, DataFrame]
    texts: dict[str, str]


def insights(df: DataFrame) -> dict[str, DataFrame]:
    """Every descriptive result of the prepared rows, tidy and by name."""
    numeric = features.numeric_columns(df, without_ids=True)
    matrix = materialize(describe.correlation_matrix(df, numeric), "correlations")
    return {
        "dataset_info": describe.dataset_info(df),
        "summary_statistics": describe.summary_statistics(df),
        "shape_statistics": describe.shape_statistics(df),
        "missing_profile": describe.missing_profile(df),
        "category_distribution": describe.aqi_category_distribution(df),
        "traffic_distribution": describe.traffic_distribution(df),
        "hourly_pattern": describe.hourly_pattern(df),
        "dow_pattern": describe.dow_pattern(df),
        "month_pattern": describe.month_pattern(df),
        "weekend_effect": describe.weekend_effect(df),
        "rush_hours": describe.rush_hours(df),
        "location_stats": describe.location_stats(df),
        "hotspots": describe.hotspots(df),
        "location_ranking": describe.location_ranking(df),
        "correlation_matrix": matrix,
        "strong_correlations": describe.strong_correlations(matrix),
        "anomalies": describe.anomalies_iqr(df),
        "key_findings": findings.key_findings(df),
    }


def run_analysis(
    raw: DataFrame, out_dir: str, as_of: AsOf, days_back: int = 30, kinds: dict[str, str] | None = None,
    settings: dict[str, dict] | None = None, feature_set: str = "reference", with_insights: bool = True,
) -> Result:
    """The whole run over the last ``days_back`` days; writes tables, models and reports under ``out_dir``."""
    spark = raw.sparkSession
    end = datetime.fromisoformat(str(as_of))
    rows = scan_range(raw, end - timedelta(days=days_back), end)
    cleaned = features.handle_missing(features.clean_data(rows))
    # The one shared node: every later step reads these rows again.
    built = features.engineer_features(cleaned, feature_set=feature_set)
    prepared = materialize(spread(built, rows.count()), "prepared")
    exports.write_csv(prepared, f"{out_dir}/processed_data")
    summary = features.preprocessing_summary(rows, prepared)
    exports.write_json(summary, f"{out_dir}/reports/preprocessing_summary")

    tables = insights(prepared) if with_insights else {
        "dataset_info": describe.dataset_info(prepared), "summary_statistics": describe.summary_statistics(prepared),
        "key_findings": findings.key_findings(prepared),
    }
    for name, table in tables.items():
        exports.write_json(table, f"{out_dir}/reports/insights/{name}")

    split = splits.time_split(prepared, TEST_SHARE, VAL_SHARE)
    metrics, histories = {}, []
    for target, kind in (kinds or {"aqi_value": "random_forest", "traffic_level": "random_forest"}).items():
        part = features.prepare_features(split, target, keep=["id", "timestamp", "split"])
        head, val, test = [part.filter(F.col("split") == s).drop("split") for s in ("train", "val", "test")]
        fitted = models.train(head, target, kind, val, **(settings or {}).get(target, {}))
        models.save_model(fitted, spark, f"{out_dir}/models/{target}")
        again = models.load_model(spark, f"{out_dir}/models/{target}")
        histories.append(again.history(spark))
        # Written once: every table below reads the predictions again.
        predicted = materialize(again.predict(test), "predicted")
        metrics[target] = models.score(predicted, target)
        if again.is_classifier:
            tables[f"{target}_confusion"] = ev.confusion_matrix(predicted, target, "prediction")
            tables[f"{target}_report"] = ev.classification_report(predicted, target, "prediction")
        else:
            tables[f"{target}_residuals"] = ev.residual_stats(predicted, target, "prediction")
            tables[f"{target}_residual_histogram"] = ev.residual_histogram(predicted, target, "prediction")
        for name in [n for n in tables if n.startswith(target)]:
            exports.write_json(tables[name], f"{out_dir}/reports/evaluation/{name}")
        exports.write_json(metrics[target], f"{out_dir}/reports/evaluation/{target}_metrics")

    files = ["processed_data", "reports/preprocessing_summary", "reports/insights", "reports/evaluation", "models"]
    texts = {
        "insights": reports.insight_report(tables["dataset_info"], tables["key_findings"], tables["summary_statistics"]),
        "summary": reports.summary_markdown(
            summary, tables["summary_statistics"], tables["key_findings"], histories, metrics, files, str(as_of)
        ),
    }
    for target, frame in metrics.items():
        texts[f"{target}_evaluation"] = reports.evaluation_report(frame, target)
    for name, text in texts.items():
        exports.write_text(spark, text, f"{out_dir}/reports/text/{name}")
    return Result(prepared, tables, metrics, texts)
