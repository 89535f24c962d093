"""Variance inflation and the frozen feature schema.

Rows are read once, for the correlation matrix; everything after works on that p x p matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlake.operators.eda import correlations


def correlation_array(training: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """p x p correlation matrix on the driver; constant columns give NaN."""
    place = {c: i for i, c in enumerate(columns)}
    matrix = np.full((len(columns), len(columns)), np.nan)
    for row in correlations(training, columns).collect():
        if row.correlation is not None:
            matrix[place[row.feature_a], place[row.feature_b]] = row.correlation
    return matrix


def inflation(matrix: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse correlation matrix, at least one."""
    if np.isnan(matrix).any():
        raise ValueError("variance inflation is undefined for constant features")
    if len(matrix) < 2:
        return np.ones(len(matrix))
    return np.maximum(np.diag(np.linalg.pinv(matrix, hermitian=True)), 1.0)


def vif(training: DataFrame, columns: Sequence[str]) -> DataFrame:
    values = inflation(correlation_array(training, columns))
    return training.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, values, strict=True)],
        "feature string, vif double").orderBy(F.desc("vif"), "feature")


def freeze_schema(labelled: DataFrame, columns: Sequence[str], correlation: float = 0.95,
                  limit: float = 10.0) -> DataFrame:
    """(feature, position, selected, reason, vif): what the churn models may use, and why not.

    Decided on training rows only: drop the reference category, the copied value, gross spend when
    it follows net spend, constants, then the worst inflation until all are within the limit.
    """
    training = labelled.where(F.col("partition") == "train")
    matrix = correlation_array(training, columns)
    place = {c: i for i, c in enumerate(columns)}
    reasons: dict[str, str] = {}
    if "category_affinity_unknown" in place:
        reasons["category_affinity_unknown"] = "reference category"
    if {"historical_customer_value", "net_spend"} <= set(place):
        reasons["historical_customer_value"] = "copy of net_spend"
    if {"gross_spend", "net_spend"} <= set(place):
        r = matrix[place["gross_spend"], place["net_spend"]]
        if abs(r) >= correlation:
            reasons["gross_spend"] = f"correlation {r:.6f} with net_spend"
    for c in columns:
        if c not in reasons and np.isnan(matrix[place[c], place[c]]):
            reasons[c] = "zero variance"
    selected = [c for c in columns if c not in reasons]
    while True:
        keep = [place[c] for c in selected]
        values = dict(zip(selected, inflation(matrix[np.ix_(keep, keep)]), strict=True))
        worst = min(selected, key=lambda c: (-values[c], c))
        if len(selected) <= 2 or values[worst] <= limit:
            break
        selected.remove(worst)
        reasons[worst] = f"variance inflation {values[worst]:.6f} above {limit:.2f}"
    rows = [(c, place[c], c in values and c in selected, reasons.get(c, "selected"),
             float(values[c]) if c in selected else None) for c in columns]
    return labelled.sparkSession.createDataFrame(
        rows, "feature string, position int, selected boolean, reason string, vif double")
