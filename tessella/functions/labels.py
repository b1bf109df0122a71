"""Labels of tiles and outcomes of predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_of(fraction: Column, threshold: float) -> Column:
    """positive from the threshold on, ambiguous above 0, else negative; untouched tiles are negative at any threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")
    touched = fraction > 0
    return F.when((fraction >= threshold) & touched, "positive").when(touched, "ambiguous").otherwise("negative")


def label_by(rule: str, fraction: Column, n_inside: Column, threshold: float) -> Column:
    """By covered area, or by whether a centroid lies inside."""
    if rule not in ("area", "centroid"):
        raise ValueError("the rule is area or centroid")
    return label_of(fraction, threshold) if rule == "area" else F.when(n_inside > 0, "positive").otherwise("negative")


def binary_target(label: Column) -> Column:
    """1 or 0; an ambiguous row is an error."""
    return F.when(label == "ambiguous", F.raise_error(F.lit("an ambiguous row has no target")).cast("long")).otherwise((label == "positive").cast("long"))


def outcome(label: Column, prob: Column, threshold: Column) -> Column:
    """TP, FN, FP or TN; ``not scored`` if ambiguous, ``no prediction`` without a probability or threshold."""
    missing = prob.isNull() | F.isnan(prob) | threshold.isNull() | F.isnan(threshold)
    hit = prob >= threshold
    return (
        F.when(label == "ambiguous", "not scored").when(missing, "no prediction")
        .when((label == "positive") & hit, "TP").when(label == "positive", "FN").when(hit, "FP").otherwise("TN")
    )
