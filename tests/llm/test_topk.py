import math
import random

import numpy as np
import pytest

from themeloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string"


def brute(rows, k):
    whole = {}
    out = {}
    usable = [
        (i, [math.floor(64 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    for i, v in usable:
        whole[i] = min(whole.get(i, v), v)
    for q, v in whole.items():
        if q % 20 == 0:
            hits = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q]
            out[q] = [(i, -s) for s, i in sorted(hits)[:k]]
    return {q: hits for q, hits in out.items() if hits}


@pytest.mark.parametrize("k,block,batch", [(5, 16, 4), (20, 4096, 512), (500, 50, 2)])
def test_equals_brute_force(spark, k, block, batch):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.uniform(-1, 1)]) for _ in range(6)]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf")]), (None, [1.0]), (280, [0.5]), (7, [1.0] * 6), (40, [0.1] * 6)]
    docs = spark.createDataFrame([(*row, "x") for row in rows], SCHEMA)
    out = topk.top_scores(docs, k=k, block_rows=block, query_rows=batch).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert got == brute(rows, k)


def test_reading_stops_early_where_a_few_stand_out():
    rng = np.random.default_rng(1)
    matrix = np.zeros((64, 4))
    matrix[:3] = 100
    matrix[3:] = rng.integers(-1, 2, (61, 4))
    hits = list(topk.top_of_block(np.ones((1, 4)), np.array([-1]), matrix, np.arange(64), 3))
    assert [h[1].tolist() for h in hits] == [[0, 1, 2]]


def test_no_rows(spark):
    empty = spark.createDataFrame([(1, [1.0], "x")], SCHEMA).limit(0)
    assert topk.top_scores(empty).count() == 0
