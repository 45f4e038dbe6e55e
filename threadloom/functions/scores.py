"""Scores of decisions and of predictions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hot_score(references: Column, accesses: Column, relations: Column, days: Column) -> Column:
    """How warm a decision is, 0 to 100: used, linked and recent ones are."""
    part = lambda weight, step, n: weight * F.least(F.lit(100.0), step * n)
    fresh = F.least(F.lit(25.0), 25.0 - 1.5 * F.greatest(days, F.lit(0)))
    total = part(0.40, 20.0, references) + part(0.20, 15.0, accesses) + part(0.15, 25.0, relations) + fresh
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def heat(score: Column) -> Column:
    return F.when(score >= 80, "hot").when(score >= 50, "warm").when(score >= 20, "cool").otherwise("cold")


def ratio(part: Column, whole: Column) -> Column:
    """0 where the denominator is."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
