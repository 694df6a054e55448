"""How far two assignments of the same documents agree, from their contingency table.

Input ``counts`` holds ``topic_left, topic_right, n_docs``, a row per pair of topics that shares documents
(``topics.topic_agreement``). It has as many rows as pairs of topics at most, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def agreement_scores(counts: DataFrame) -> DataFrame:
    """``n_docs, adjusted_rand, normalised_information``: one row.

    The adjusted Rand index (Hubert and Arabie 1985) is 1 for equal partitions and 0 on average for random
    ones. The mutual information is divided by the mean of the two entropies. Both are 1 where neither side
    has more than one topic, and null for no documents. A null topic is a topic of its own.
    """
    n = F.col("n_docs").cast("double")
    left, right = Window.partitionBy("topic_left"), Window.partitionBy("topic_right")
    cells = counts.where("n_docs > 0").select(
        "topic_left", "topic_right", "n_docs", n.alias("n"), F.sum(n).over(left).alias("a"), F.sum(n).over(right).alias("b")
    )

    def pairs(x: Column) -> Column:
        return x * (x - 1) / 2

    # a marginal's own term, dealt over its cells by their share
    sums = cells.agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum("n").alias("n"),
        F.sum(pairs(F.col("n"))).alias("together"),
        F.sum((F.col("a") - 1) / 2 * F.col("n")).alias("left_pairs"),
        F.sum((F.col("b") - 1) / 2 * F.col("n")).alias("right_pairs"),
        F.sum(F.col("n") * F.log(F.col("n") / (F.col("a") * F.col("b")))).alias("mutual"),
        F.sum(F.col("n") * F.log("a")).alias("left_log"),
        F.sum(F.col("n") * F.log("b")).alias("right_log"),
    )
    all_pairs = pairs(F.col("n"))
    expected = F.when(all_pairs > 0, F.col("left_pairs") * F.col("right_pairs") / all_pairs).otherwise(0.0)
    most = (F.col("left_pairs") + F.col("right_pairs")) / 2
    rand = F.when(F.abs(most - expected) <= 1e-12 * most, F.lit(1.0)).otherwise((F.col("together") - expected) / (most - expected))
    mutual = F.col("mutual") / F.col("n") + F.log("n")
    entropy = F.log("n") - (F.col("left_log") + F.col("right_log")) / 2 / F.col("n")
    information = F.when(entropy <= 1e-12, F.lit(1.0)).otherwise(F.greatest(mutual, F.lit(0.0)) / entropy)
    known = F.col("n") > 0
    return sums.select(
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.when(known, rand).alias("adjusted_rand"),
        F.when(known, information).alias("normalised_information"),
    )


def best_matching(counts: DataFrame) -> DataFrame:
    """``topic_left, topic_right, n_docs``: each topic with one of the other side so that most documents match.

    Pairs without a common document are left out, so the smaller side may stay partly unmatched. The table
    of pairs of topics goes through the driver; it does not grow with the documents. Of equally good
    matchings the one found first in order of topics is returned.
    """
    rows = counts.where("n_docs > 0").collect()
    names = [sorted({r[side] for r in rows}, key=lambda t: (t is None, t or 0)) for side in ("topic_left", "topic_right")]
    place = [{name: i for i, name in enumerate(side)} for side in names]
    table = np.zeros((max(1, len(names[0])), max(1, len(names[1]))))
    for r in rows:
        table[place[0][r["topic_left"]], place[1][r["topic_right"]]] += r["n_docs"]
    found = [(names[0][i], names[1][j], int(table[i, j])) for i, j in _assignment(table) if table[i, j] > 0]
    left, right = (counts.schema[side].dataType.simpleString() for side in ("topic_left", "topic_right"))
    return counts.sparkSession.createDataFrame(found, f"topic_left {left}, topic_right {right}, n_docs long")


def _assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns of largest total gain, by shortest augmenting paths with potentials."""
    turned = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if turned else gain)
    n, m = cost.shape
    of_row, of_column = np.zeros(n + 1), np.zeros(m + 1)
    row_at = np.zeros(m + 1, dtype=int)  # row of each column, from 1; column 0 is the start
    for row in range(1, n + 1):
        row_at[0], column = row, 0
        slack, before, done = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while row_at[column]:
            done[column] = True
            here = row_at[column]
            reduced = cost[here - 1] - of_row[here] - of_column[1:]
            better = ~done[1:] & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            before[1:][better] = column
            nearest = int(np.argmin(np.where(done, np.inf, slack)[1:])) + 1
            step = slack[nearest]
            of_row[row_at[done]] += step
            of_column[done] -= step
            slack[~done] -= step
            column = nearest
        while column:
            row_at[column] = row_at[before[column]]
            column = before[column]
    pairs = [(int(row_at[c]) - 1, c - 1) for c in range(1, m + 1) if row_at[c]]
    return sorted((c, r) if turned else (r, c) for r, c in pairs)
