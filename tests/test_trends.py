from datetime import date

import numpy as np
import pytest

from themeloom.operators import trends as tr

SCHEMA = "period date, topic int, n_docs long"


def test_periods_without_documents_count_zero(spark):
    rows = [(date(2000, 1, 1), 1, 3), (date(2000, 1, 1), 2, 1), (date(2003, 1, 1), 1, 2), (None, 1, 9)]
    out = tr.topic_shares_by_period(spark.createDataFrame(rows, SCHEMA)).orderBy("topic", "place").collect()
    assert [(r.topic, r.place, r.period.year, r.n_docs, r.share) for r in out] == [
        (1, 0, 2000, 3, 0.75), (1, 1, 2001, 0, 0.0), (1, 2, 2002, 0, 0.0), (1, 3, 2003, 2, 1.0),
        (2, 0, 2000, 1, 0.25), (2, 1, 2001, 0, 0.0), (2, 2, 2002, 0, 0.0), (2, 3, 2003, 0, 0.0),
    ]


def brute(shares):
    n = len(shares)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    s = sum(np.sign(shares[j] - shares[i]) for i, j in pairs)
    slope = np.median([(shares[j] - shares[i]) / (j - i) for i, j in pairs])
    tied = sum(t * (t - 1) * (2 * t + 5) for t in np.unique(shares, return_counts=True)[1])
    variance = (n * (n - 1) * (2 * n + 5) - tied) / 18
    return s, (s - np.sign(s)) / variance**0.5 if variance else 0.0, slope


def test_rank_test_and_slope(spark):
    rng = np.random.default_rng(4)
    counts = {0: [2 * i + 1 for i in range(14)], 1: [40 - 2 * i for i in range(14)], None: rng.integers(1, 4, 14).tolist()}
    rows = [(date(2001 + i // 12, i % 12 + 1, 1), topic, n) for topic, ns in counts.items() for i, n in enumerate(ns)]
    found = {r.topic: r for r in tr.topic_trend_test(spark.createDataFrame(rows, SCHEMA), "month").collect()}
    totals = np.sum(list(counts.values()), axis=0)
    for topic, ns in counts.items():
        s, z, slope = brute(np.array(ns) / totals)
        assert (found[topic].s, found[topic].n_periods) == (s, 14)
        assert (found[topic].z, found[topic].slope) == pytest.approx((z, slope))
    assert (found[0].direction, found[1].direction) == ("rising", "falling")


def test_one_period_and_none(spark):
    one = tr.topic_trend_test(spark.createDataFrame([(date(2000, 1, 1), 1, 3)], SCHEMA)).first()
    assert tuple(one) == (1, 1, 0, 0.0, "steady", None)
    assert tr.topic_trend_test(spark.createDataFrame([], SCHEMA)).count() == 0
