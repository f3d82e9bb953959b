"""Severity and risk of a change, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities with their weights in the risk score.
SEVERITY_WEIGHTS = {"critical": 10, "high": 7, "medium": 4, "low": 1}


def severity(node_type: Column, depth: Column) -> Column:
    """How hard an asset is hit, by its kind and its distance in hops."""
    runs = node_type.isin("job", "pipeline")
    return (
        F.when(depth <= 1, F.when(runs, "critical").otherwise("high"))
        .when(depth <= 3, F.when(runs, "high").otherwise("medium"))
        .otherwise("low")
    )


def raised(level: Column) -> Column:
    """Severity one step up, as column removals have it for the lower two."""
    return F.when(level == "medium", "high").when(level == "low", "medium").otherwise(level)


def risk_score(total_weight: Column, assets: Column) -> Column:
    """0 to 10, one decimal: mean weight, scaled down below ten assets."""
    n = assets.cast("double")
    score = F.least(F.lit(10.0), total_weight.cast("double") / n * F.least(n, F.lit(10.0)) / 10.0 * 10.0)
    return F.when(n > 0, F.bround(score, 1)).otherwise(F.lit(0.0))
