"""Topic assignments and topic words as tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import vectors as vx

TOP_WORDS = 10  # Fixed value: words listed per topic.
_TOPIC_COLUMN = re.compile(r"topic_k(\d+)")


def dominant_topics(vectors: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``doc_id, topic, prob``: first topic of highest weight, or -1 and 0.0 without any weight."""
    vector = F.col("vector")
    return vectors.select(
        *key, vx.dominant_topic(vector).alias("topic"), vx.dominant_weight(vector).alias("prob")
    )


def sparse_topics(
    vectors: DataFrame, minimum: float = vx.MIN_TOPIC_PROBABILITY, key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``doc_id, topic, prob`` for each weight of at least ``minimum``."""
    return vectors.select(*key, F.posexplode("vector").alias("topic", "prob")).filter(F.col("prob") >= minimum)


def topic_sizes(assignments: DataFrame) -> DataFrame:
    """``topic, n_docs``."""
    return assignments.groupBy("topic").agg(F.count("*").alias("n_docs"))


def wide_assignments(
    assignments: DataFrame, topic_counts: Sequence[int], key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Long ``doc_id, k, topic, prob`` to columns ``topic_k14, topic_k14_prob, ...``."""
    wide = (
        assignments.groupBy(*key)
        .pivot("k", list(topic_counts))
        .agg(F.first("topic").alias("topic"), F.first("prob").alias("prob"))
    )
    columns = [
        column
        for k in topic_counts
        for column in (
            F.col(f"{k}_topic").alias(f"topic_k{k}"),
            F.col(f"{k}_prob").alias(f"topic_k{k}_prob"),
        )
    ]
    return wide.select(*key, *columns)


def topic_columns(columns: Sequence[str]) -> dict[int, str]:
    """Topic count -> its assignment column, by exact name."""
    matches = ((_TOPIC_COLUMN.fullmatch(name), name) for name in columns)
    return {int(match.group(1)): name for match, name in matches if match}


def single_assignment(wide: DataFrame, k: int) -> DataFrame:
    """The wide table for one topic count: no ``topic_`` columns but ``topic`` and ``topic_prob``."""
    base = [name for name in wide.columns if not name.startswith("topic_")]
    return wide.select(
        *base, F.col(f"topic_k{k}").alias("topic"), F.col(f"topic_k{k}_prob").alias("topic_prob")
    )


def top_words(terms: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """``topic, rank, term, weight``: heaviest terms per topic; equal weights in name order.

    The rank filter lets Spark cut each topic to ``n`` rows before the shuffle.
    """
    heaviest = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    ranked = terms.withColumn("rank", F.row_number().over(heaviest)).filter(F.col("rank") <= n)
    return ranked.select("topic", "rank", "term", "weight")


def topic_lines(words: DataFrame) -> DataFrame:
    """``topic, line``: ``Topic 0: w1, w2, ...``."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "term")))
    names = F.array_join(F.transform(ordered, lambda row: row["term"]), ", ")
    return words.groupBy("topic").agg(
        F.concat(F.lit("Topic "), F.first("topic").cast("string"), F.lit(": "), names).alias("line")
    )


def topic_agreement(wide: DataFrame, k_left: int, k_right: int) -> DataFrame:
    """``topic_left, topic_right, n_docs``: how the topics of two models share documents."""
    return wide.groupBy(
        F.col(f"topic_k{k_left}").alias("topic_left"), F.col(f"topic_k{k_right}").alias("topic_right")
    ).agg(F.count("*").alias("n_docs"))


def topic_trend(assignments: DataFrame, date_col: str, unit: str = "year") -> DataFrame:
    """``period, topic, n_docs`` for assignments with a date column."""
    period = F.date_trunc(unit, F.col(date_col)).cast("date").alias("period")
    return assignments.groupBy(period, "topic").agg(F.count("*").alias("n_docs"))
