import math
import random
from itertools import permutations

import numpy as np
import pytest

from themeloom.operators import agreement as ag

SCHEMA = "topic_left int, topic_right int, n_docs long"


def counts_of(spark, left, right):
    pairs = list(zip(left, right, strict=True))
    return spark.createDataFrame([(a, b, pairs.count((a, b))) for a, b in set(pairs)], SCHEMA)


def brute(left, right):
    n = len(left)
    together = apart_left = apart_right = 0
    for i in range(n):
        for j in range(i):
            a, b = left[i] == left[j], right[i] == right[j]
            together, apart_left, apart_right = together + (a and b), apart_left + a, apart_right + b
    expected = apart_left * apart_right / (n * (n - 1) / 2)
    rand = (together - expected) / ((apart_left + apart_right) / 2 - expected)

    def entropy(values):
        return -sum(p * math.log(p) for p in (values.count(v) / n for v in set(values)))

    both = entropy(list(zip(left, right, strict=True)))
    mutual = entropy(left) + entropy(right) - both
    return rand, mutual / ((entropy(left) + entropy(right)) / 2)


def test_scores_equal_the_definition(spark):
    rng = random.Random(2)
    left = [rng.choice([-1, 0, 1, 2, None]) for _ in range(80)]
    right = [x if rng.random() < 0.6 else rng.choice([0, 1, 2]) for x in left]
    row = ag.agreement_scores(counts_of(spark, left, right)).first()
    assert row.n_docs == 80
    assert (row.adjusted_rand, row.normalised_information) == pytest.approx(brute(left, right))


def test_equal_single_and_no_topics(spark):
    same = ag.agreement_scores(counts_of(spark, [0, 0, 1, 2], [5, 5, 7, 9])).first()
    assert (same.adjusted_rand, same.normalised_information) == pytest.approx((1, 1))
    one = ag.agreement_scores(counts_of(spark, [0, 0], [3, 3])).first()
    assert tuple(one) == (2, 1, 1)
    none = ag.agreement_scores(spark.createDataFrame([], SCHEMA)).first()
    assert tuple(none) == (0, None, None)


@pytest.mark.parametrize("seed", range(8))
def test_matching_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 9, rng.integers(1, 6, 2)).astype(float)
    pairs = ag._assignment(table)
    assert len(pairs) == min(table.shape) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    wide = table if table.shape[0] <= table.shape[1] else table.T
    best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
    assert sum(table[i, j] for i, j in pairs) == best


def test_matching_of_topics(spark):
    found = ag.best_matching(counts_of(spark, [0, 0, 0, 1, 1, None], [4, 4, 3, 4, 4, 3])).collect()
    assert {tuple(r) for r in found} in ({(0, 3, 1), (1, 4, 2)}, {(0, 4, 2), (None, 3, 1)}, {(1, 4, 2), (None, 3, 1)})
    assert ag.best_matching(spark.createDataFrame([], SCHEMA)).count() == 0
