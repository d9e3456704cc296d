"""Linear models from sums of products: every fit and every error over any part of the rows is a solve on small matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_sums(rows: DataFrame, names: list[str], target: str, at: str, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of (1, features, target) for every run of positions between two bounds, and the shift taken off the columns.

    One pass: tasks add up one matrix per run they meet, Spark adds the matrices cell by cell. ``at`` holds positions from 0,
    ``bounds`` the first position of every run but the first. Columns are shifted by their means, which keeps the digits.
    """
    columns = [*names, target]
    means = rows.agg(*[F.avg(c).alias(c) for c in columns]).first()
    shift, size = np.array([float(means[c] or 0.0) for c in columns]), len(columns) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], 1) - shift
            wide = np.column_stack((np.ones(len(own)), own))
            segment = np.searchsorted(bounds, batch.column(at).to_numpy(), side="right")
            for k in np.unique(segment).tolist():
                part = wide[segment == k]
                held[k] = held.get(k, 0) + part.T @ part
        if held:
            cells = np.arange(size * size)
            arrays = [np.repeat(list(held), len(cells)), np.tile(cells, len(held)), np.concatenate([g.ravel() for g in held.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["segment", "cell", "s"])

    told = rows.select(*columns, at).mapInArrow(run, "segment long, cell long, s double").groupBy("segment", "cell").agg(F.sum("s").alias("s")).toPandas()
    out = np.zeros((len(bounds) + 1, size * size))
    out[told["segment"], told["cell"]] = told["s"]
    return out.reshape(-1, size, size), shift


def ridge(sums: np.ndarray, alpha: float) -> np.ndarray:
    """(-intercept, -weights, 1) of the ridge fit on the rows behind the sums; the intercept is not penalized."""
    n, first = sums[0, 0], sums[0]
    centered = sums - np.outer(first, first) / max(n, 1.0)
    weights = np.linalg.lstsq(centered[1:-1, 1:-1] + alpha * np.eye(len(sums) - 2), centered[1:-1, -1], rcond=None)[0]
    intercept = (first[-1] - first[1:-1] @ weights) / max(n, 1.0)
    return np.concatenate(([-intercept], -weights, [1.0]))


def mean_squared_error(sums: np.ndarray, fit: np.ndarray) -> float:
    """Of a fit over the rows behind the sums."""
    return float(fit @ sums @ fit / sums[0, 0]) if sums[0, 0] else float("nan")


def fold_starts(n: int, folds: int) -> list[int]:
    """First position of each contiguous fold and the number of rows; sizes differ by at most one, larger ones first."""
    return [k * (n // folds) + min(k, n % folds) for k in range(folds + 1)]
