"""Column expressions over arrays of doubles, mostly document-topic vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOPIC_PROBABILITY = 0.01  # Fixed value: weaker topics are left out of sparse topic lists.
NO_TOPIC = -1


def as_doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dominant_topic(vector: Column) -> Column:
    """0-based position of the first maximum; -1 when every weight is zero."""
    position = F.array_position(vector, F.array_max(vector)).cast("int") - 1
    return F.when(is_blank(vector), F.lit(NO_TOPIC)).otherwise(position)


def dominant_weight(vector: Column) -> Column:
    """Weight of the dominant topic; 0.0 when every weight is zero."""
    return F.when(is_blank(vector), F.lit(0.0)).otherwise(F.array_max(vector).cast("double"))


def is_blank(vector: Column) -> Column:
    """True for an empty vector and for one of zeros only (a document without known words)."""
    return ~F.exists(vector, lambda x: x != 0)


def is_valid_point(vector: Column, label: Column) -> Column:
    """A point counts for the cluster metrics when it has no NaN and a label of 0 or more."""
    return ~F.exists(vector, lambda x: F.isnan(x)) & (label >= 0)


def squared_distance(left: Column, right: Column) -> Column:
    gaps = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)


def distance(left: Column, right: Column) -> Column:
    """Euclidean distance of two equally long arrays."""
    return F.sqrt(squared_distance(left, right))
