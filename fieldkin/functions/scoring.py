"""Confidence, evidence and cardinality of a candidate relationship."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the signals, threshold, and result size.
TYPE_SCORE = 0.2
NAME_SCORE = 0.3
KEY_SCORE = 0.2
VALUE_SCORE = 0.3
MIN_CONFIDENCE = 0.45
MAX_SUGGESTIONS = 100

# The relationship classes, the only operator and the join types.
CARDINALITIES = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")
OPERATOR = "equals"
JOIN_TYPES = ("inner", "left")


def raw_confidence(name: Column, key: Column, overlap: Column) -> Column:
    """Unrounded score. The order of the sum decides cases on the threshold."""
    return (
        F.lit(TYPE_SCORE)
        + name * F.lit(NAME_SCORE)
        + F.when(key, F.lit(KEY_SCORE)).otherwise(F.lit(0.0))
        + overlap * F.lit(VALUE_SCORE)
    )


def rounded_confidence(confidence: Column) -> Column:
    """Two decimals, halves up."""
    return F.floor(confidence * 100 + F.lit(0.5)) / 100


def evidence(name: Column, key: Column, overlap: Column) -> Column:
    return F.array_compact(
        F.array(
            F.lit("compatible_types"),
            F.when(name > 0, F.lit("name_match")),
            F.when(key, F.lit("key_match")),
            F.when(overlap > 0, F.lit("value_overlap")),
        )
    )


def cardinality(left_unique: Column, right_unique: Column) -> Column:
    one_one, one_many, many_one, many_many = CARDINALITIES
    return (
        F.when(left_unique & right_unique, F.lit(one_one))
        .when(left_unique, F.lit(one_many))
        .when(right_unique, F.lit(many_one))
        .otherwise(F.lit(many_many))
    )
