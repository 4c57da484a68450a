"""Risk classes and scores of the report operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def impact_risk(direct: Column, processes: Column, modules: Column, total: Column) -> Column:
    # Thresholds of the classes.
    return (
        F.when((direct >= 30) | (processes >= 5) | (modules >= 5) | (total >= 200), "CRITICAL")
        .when((direct >= 15) | (processes >= 3) | (modules >= 3) | (total >= 100), "HIGH")
        .when((direct >= 5) | (total >= 30), "MEDIUM")
        .otherwise("LOW")
    )


def change_risk(processes: Column) -> Column:
    # Thresholds of the classes.
    return F.when(processes == 0, "low").when(processes <= 5, "medium").when(processes <= 15, "high").otherwise("critical")


def api_risk(consumers: Column, has_mismatch: Column) -> Column:
    # Thresholds of the classes; a mismatch raises the class by one.
    base = F.when(consumers >= 10, 3).when(consumers >= 4, 2).otherwise(1)
    level = F.least(F.lit(3), base + F.when(has_mismatch, 1).otherwise(0))
    return F.when(level == 3, "HIGH").when(level == 2, "MEDIUM").otherwise("LOW")


def merged_risk(local: Column, cross_count: Column, best_confidence: Column) -> Column:
    """Risk of a change in one repository together with what it reaches in others."""
    return (
        F.when((local == "CRITICAL") | (cross_count >= 3), "CRITICAL")
        .when((local == "HIGH") | (F.coalesce(best_confidence, F.lit(0.0)) >= 0.85), "HIGH")
        .when((cross_count > 0) & local.isin("LOW", "UNKNOWN"), "MEDIUM")
        .otherwise(local)
    )
