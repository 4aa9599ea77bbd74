"""Numeric column expressions: clipping, distributions held in maps, reliability of observations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of observations.
ABNORMAL = ("fault", "warning", "abnormal", "alert")
NORMAL = ("normal", "success")
UNUSABLE = ("data_unavailable_for_system", "oracle_features_unavailable", "insufficient_feature_coverage")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def softmax(scores: Column) -> Column:
    """Of an array of doubles."""
    powers = F.transform(F.array(F.struct(scores.alias("s"), F.array_max(scores).alias("m"))), lambda x: F.transform(x["s"], lambda v: F.exp(v - x["m"])))
    return F.transform(F.transform(powers, lambda p: F.struct(p.alias("p"), total(p).alias("t"))), lambda x: F.transform(x["p"], lambda v: v / x["t"]))[0]


def entropy(dist: Column) -> Column:
    """Entropy of a map of probabilities over the log of its size; 0 for fewer than two entries."""
    values = F.map_values(dist)
    h = F.aggregate(values, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.when(F.size(dist) > 1, clip(h / F.log(F.size(dist).cast("double")))).otherwise(0.0)


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two maps (natural log, within 0 and 1)."""
    def part(a: Column, b: Column) -> Column:
        a = F.coalesce(a, F.lit(0.0))
        m = (a + F.coalesce(b, F.lit(0.0))) / 2
        return F.when(a > 0, a * F.log(a / m)).otherwise(0.0)

    pairs = F.map_values(F.map_zip_with(p, q, lambda _, a, b: (part(a, b) + part(b, a)) / 2))
    return clip(total(pairs))


def confidence_factor(confidence: Column) -> Column:
    return clip(0.35 + 0.65 * clip(F.coalesce(confidence, F.lit(0.5))))


def reliability(status: Column, node: Column, confidence: Column, model_source: Column | None = None, calibration: Column | None = None, coverage: Column | None = None) -> Column:
    """How far an observation can be trusted: by source, calibration state, feature coverage and confidence."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    node_base = F.when(F.coalesce(node, F.lit("")) != "", 0.40).otherwise(0.15)
    base = node_base
    if model_source is not None:
        base = F.when(model_source == "system_oracle", 0.90).when(model_source == "per_node_responsibility", 0.72).when(model_source == "per_node", 0.28).otherwise(node_base)
    if calibration is not None:
        base = F.when(calibration == "weak_fallback_model", F.least(base, F.lit(0.25))).when(calibration == "clean_baseline_false_positive_guard", F.when(s.isin(*NORMAL), 0.95).otherwise(0.05)).otherwise(base)
    if coverage is not None:
        base = base * F.coalesce(clip(coverage / 0.75), F.lit(1.0))
    out = F.round(clip(base * confidence_factor(confidence)), 4)
    unusable = s.isin("error", "unknown")
    if calibration is not None:
        unusable = unusable | F.coalesce(calibration.isin(*UNUSABLE), F.lit(False))
    return F.when(unusable, 0.0).otherwise(out)


def polarity(status: Column, trust: Column) -> Column:
    """Signed evidence: abnormal statuses speak for a fault, normal ones against it."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    factor = F.when(s.isin("fault", "alert"), 1.0).when(s == "warning", 0.72).when(s == "abnormal", 0.55).when(s.isin(*NORMAL), -0.55).otherwise(0.0)
    return F.round(trust * factor, 4)
