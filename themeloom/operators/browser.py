"""Tables behind a topic browser: topic sizes, salient and relevant terms, distances between topics.

Input ``terms`` holds ``topic, term, weight`` with weights that sum to 1 per topic.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.staging import stage

# Terms listed per view, and the step between relevance weights.
LISTED_TERMS = 30
LAMBDA_STEP = 0.01

MAX_TOPICS = 2_000
#: Terms of a topic that one task compares.
SKYBAND_TERMS = 20_000
#: Twice the rounding of relevance.
BEATEN_BY = 2e-9


def topic_shares(vectors: DataFrame, lengths: DataFrame) -> DataFrame:
    """``topic, freq, share``: tokens per topic, from vectors and document lengths ``doc_id, n``."""
    weighted = vectors.join(lengths, "doc_id").select(F.posexplode("vector").alias("topic", "p"), "n")
    freq = weighted.groupBy("topic").agg(F.sum(F.col("p") * F.col("n")).alias("freq"))
    return freq.withColumn("share", F.col("freq") / F.sum("freq").over(Window.partitionBy()))


def term_saliency(terms: DataFrame, shares: DataFrame) -> DataFrame:
    """``term, freq, share, saliency``: expected frequency and how far it tells topics apart."""
    joined = terms.join(F.broadcast(_bounded(shares)), "topic").filter(F.col("weight") > 0)
    # With P(topic | term) = weight / W, the sum of P * log(P / share) needs only these sums.
    per_term = joined.groupBy("term").agg(
        F.sum(F.col("weight") * F.col("freq")).alias("freq"),
        F.sum("weight").alias("w"),
        F.sum(F.col("weight") * F.log(F.col("weight") / F.col("share"))).alias("wl"),
    )
    total = shares.agg(F.sum("freq")).first()[0]
    share = F.col("freq") / F.lit(float(total))
    return per_term.select(
        "term",
        "freq",
        share.alias("share"),
        (share * (F.col("wl") / F.col("w") - F.log("w"))).alias("saliency"),
    )


def salient_terms(saliency: DataFrame, n: int = LISTED_TERMS) -> DataFrame:
    return saliency.orderBy(F.desc("saliency"), "term").limit(n)


def relevance_weights(step: float = LAMBDA_STEP) -> list[float]:
    """0 to 1 in equal steps."""
    return [i * step for i in range(round(1 / step) + 1)]


def relevant_terms(
    terms: DataFrame,
    saliency: DataFrame,
    lambdas: Sequence[float] | None = None,
    n: int = LISTED_TERMS,
) -> DataFrame:
    """``topic, lambda, rank, term, relevance``: lambda * log w + (1 - lambda) * log(w / share).

    ``lambdas`` lie between 0 and 1. Only terms that can be among the ``n`` best for one of them are scored
    for all of them (``relevance_skyband``).
    """
    steps = [float(x) for x in (relevance_weights() if lambdas is None else lambdas)]
    log_weight = F.log("weight")
    placed = (
        terms.filter(F.col("weight") > 0)
        .join(saliency.select("term", "share"), "term")
        # equal counts give equal values, whatever the order in which they were added up
        .select("topic", "term", F.round(log_weight, 12).alias("lw"), F.round(log_weight - F.log("share"), 12).alias("ll"))
    )
    if steps and 0 <= min(steps) and max(steps) <= 1:
        placed = relevance_skyband(placed, n)
    scored = placed.withColumn("lambda", F.explode(F.array(*map(F.lit, steps)))).withColumn(
        "relevance", F.col("lambda") * F.col("lw") + (1 - F.col("lambda")) * F.col("ll")
    )
    best = Window.partitionBy("topic", "lambda").orderBy(F.desc(F.round("relevance", 9)), "term")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    return ranked.select("topic", "lambda", "rank", "term", "relevance")


def relevance_skyband(placed: DataFrame, n: int = LISTED_TERMS) -> DataFrame:
    """Rows of ``topic, term, lw, ll`` without those that cannot be among the ``n`` most relevant for any weight.

    Relevance is a mean of ``lw`` and ``ll`` with weights of 0 to 1, and equals are ordered by term. So a term
    comes before another for every weight if it is larger in both by more than the rounding of relevance, or
    if it is as large in both and its name is less. A term that ``n`` others come before is left out. Terms of
    a topic are dealt into parts of bounded size first; a term that is out in its part is out for the whole.
    """
    placed = stage(placed, "relevance-terms")
    # one row per topic
    sizes = placed.groupBy("topic").agg(F.ceil(F.count("*") / SKYBAND_TERMS).cast("int").alias("_parts"))
    sizes = stage(_bounded(sizes), "relevance-parts")
    n_parts = sizes.agg(F.coalesce(F.sum("_parts"), F.lit(1))).first()[0]
    schema = placed.schema

    def survivors(rows: pd.DataFrame) -> pd.DataFrame:
        for known, value in (("ll", "lw"), ("lw", "ll")):
            rows = rows.sort_values([known, "term"])
            rows = rows[_early_or_large(rows[known].to_numpy(), rows[value].to_numpy(), n)]
        return rows[_in_skyband(rows["lw"].to_numpy(), rows["ll"].to_numpy(), n)][schema.fieldNames()]

    part = F.pmod(F.xxhash64("term"), F.col("_parts")).alias("_part")
    dealt = placed.join(F.broadcast(sizes), "topic").select(*placed.columns, part)
    # a number of its own, as the work of a part is large for its bytes
    local = dealt.repartition(int(n_parts), "topic", "_part").groupBy("topic", "_part").applyInPandas(survivors, schema)
    return local.groupBy("topic").applyInPandas(survivors, schema)


def _kept_largest(best: list[float], value: float, n: int) -> None:
    if len(best) < n:
        heapq.heappush(best, value)
    elif value > best[0]:
        heapq.heapreplace(best, value)


def _early_or_large(known: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Of rows sorted by ``known`` and name, which have fewer than ``n`` earlier ones of equal ``known`` that are
    as large in ``value``."""
    keep = np.ones(len(known), dtype=bool)
    best: list[float] = []
    before = None
    for i, (own, large) in enumerate(zip(known.tolist(), value.tolist(), strict=True)):
        if own != before:
            best, before = [], own
        keep[i] = len(best) < n or best[0] < large
        _kept_largest(best, large, n)
    return keep


def _in_skyband(lw: np.ndarray, ll: np.ndarray, n: int) -> np.ndarray:
    """Which points fewer than ``n`` others beat in both values by more than BEATEN_BY."""
    keep = np.ones(len(lw), dtype=bool)
    order = np.argsort(-lw, kind="stable")
    best: list[float] = []  # the n largest ll of points whose lw is far enough above
    ahead = 0
    for i in order.tolist():
        while lw[order[ahead]] > lw[i] + BEATEN_BY:
            _kept_largest(best, float(ll[order[ahead]]), n)
            ahead += 1
        keep[i] = len(best) < n or not best[0] > ll[i] + BEATEN_BY
    return keep


def topic_distances(terms: DataFrame) -> DataFrame:
    """``topic_a, topic_b, distance``: Jensen-Shannon divergence for each a < b.

    A term meets itself in at most k topics. A term that only one of two topics holds adds
    log(2) / 2 times its weight, so the join may skip it.
    """
    rows = terms.filter(F.col("weight") > 0)
    a = rows.select("term", F.col("topic").alias("topic_a"), F.col("weight").alias("p"))
    b = rows.select("term", F.col("topic").alias("topic_b"), F.col("weight").alias("q"))
    p, q, m = F.col("p"), F.col("q"), (F.col("p") + F.col("q")) / 2
    shared = (
        a.join(b, "term")
        .filter(F.col("topic_a") < F.col("topic_b"))
        .groupBy("topic_a", "topic_b")
        .agg(
            F.sum((p * F.log(p / m) + q * F.log(q / m)) / 2).alias("gap"),
            F.sum(p + q).alias("mass"),
        )
    )
    topics = _bounded(rows.select("topic").distinct()).agg(F.sort_array(F.collect_list("topic")).alias("t"))
    pairs = topics.select("t", F.posexplode("t").alias("i", "topic_a")).select(
        "topic_a", F.explode(F.slice("t", F.col("i") + 2, F.size("t"))).alias("topic_b")
    )
    gap = F.coalesce(F.col("gap"), F.lit(0.0))
    unshared = 2 - F.coalesce(F.col("mass"), F.lit(0.0))
    return pairs.join(shared, ["topic_a", "topic_b"], "left").select(
        "topic_a", "topic_b", (gap + unshared * (math.log(2) / 2)).alias("distance")
    )


def topic_map(distances: DataFrame) -> DataFrame:
    """``topic, x, y``: classical scaling of the k x k distances, which fit on the driver."""
    pairs = distances.toPandas()
    topics = sorted({*pairs["topic_a"], *pairs["topic_b"]})
    place = {topic: i for i, topic in enumerate(topics)}
    gaps = np.zeros((len(topics), len(topics)))
    for row in pairs.itertuples():
        i, j = place[row.topic_a], place[row.topic_b]
        gaps[i, j] = gaps[j, i] = row.distance
    centre = np.eye(len(topics)) - 1 / len(topics)
    values, vectors = np.linalg.eigh(centre @ (-(gaps**2) / 2) @ centre)
    first = np.argsort(values)[::-1][:2]
    points = np.zeros((len(topics), 2))
    points[:, : len(first)] = vectors[:, first] * np.sqrt(np.maximum(values[first], 0))
    # Each axis may be mirrored; point its largest entry upwards.
    heaviest = points[np.abs(points).argmax(axis=0), [0, 1]]
    points *= np.where(heaviest < 0, -1, 1)
    rows = [(t, float(x), float(y)) for t, (x, y) in zip(topics, points)]
    key = distances.schema["topic_a"].dataType.simpleString()
    return distances.sparkSession.createDataFrame(rows, f"topic {key}, x double, y double")


def _bounded(per_topic: DataFrame) -> DataFrame:
    """A table with one row per topic, after a check that the topics are few."""
    if per_topic.limit(MAX_TOPICS + 1).count() > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    return per_topic
