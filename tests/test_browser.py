import math

import numpy as np
import pytest

from themeloom.operators import browser as br

PHI = {0: {"a": 0.5, "b": 0.5}, 1: {"b": 0.25, "c": 0.75}, 2: {"d": 1.0}}


@pytest.fixture
def terms(spark):
    rows = [(t, w, p) for t, words in PHI.items() for w, p in words.items()]
    return spark.createDataFrame(rows, "topic int, term string, weight double")


@pytest.fixture
def shares(spark):
    vectors = spark.createDataFrame(
        [(1, [0.5, 0.5, 0.0]), (2, [0.0, 0.0, 1.0])], "doc_id long, vector array<double>"
    )
    return br.topic_shares(vectors, spark.createDataFrame([(1, 6), (2, 2)], "doc_id long, n int"))


def entropy(p):
    return sum(-x * math.log(x) for x in p if x > 0)


def test_shares(shares):
    assert {r.topic: (r.freq, r.share) for r in shares.collect()} == {0: (3.0, 0.375), 1: (3.0, 0.375), 2: (2.0, 0.25)}


def test_saliency_and_relevance(terms, shares):
    saliency = br.term_saliency(terms, shares)
    rows = {r.term: r for r in saliency.collect()}
    assert rows["b"].freq == pytest.approx(0.5 * 3 + 0.25 * 3)
    p = [0.5 / 0.75, 0.25 / 0.75]
    tells_apart = sum(x * math.log(x / 0.375) for x in p)
    assert rows["b"].saliency == pytest.approx(2.25 / 8 * tells_apart)
    best = br.relevant_terms(terms, saliency, (0.0, 1.0), 1).collect()
    assert {(r.topic, r["lambda"]): r.term for r in best}[(0, 0.0)] == "a"
    assert br.salient_terms(saliency, 1).first().term == "d"
    assert br.relevance_weights(0.25) == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_distances_and_map(terms):
    rows = br.topic_distances(terms)
    found = {(r.topic_a, r.topic_b): r.distance for r in rows.collect()}
    vectors = {t: np.array([words.get(w, 0) for w in "abcd"]) for t, words in PHI.items()}
    for (i, j), value in found.items():
        p, q = vectors[i], vectors[j]
        assert value == pytest.approx(entropy((p + q) / 2) - (entropy(p) + entropy(q)) / 2)
    assert set(found) == {(0, 1), (0, 2), (1, 2)}
    placed = {r.topic: np.array([r.x, r.y]) for r in br.topic_map(rows).collect()}
    for (i, j), value in found.items():
        assert np.linalg.norm(placed[i] - placed[j]) == pytest.approx(value)


@pytest.mark.parametrize("part", [20_000, 40])
def test_skyband_keeps_every_term_that_any_weight_lists(spark, monkeypatch, part):
    monkeypatch.setattr(br, "SKYBAND_TERMS", part)
    rng = np.random.default_rng(5)
    rows = [(t, f"w{i:03d}", float(a), float(b)) for t in range(3) for i, (a, b) in enumerate(rng.normal(size=(300, 2)).round(1))]
    placed = spark.createDataFrame(rows, "topic int, term string, lw double, ll double")
    kept = {(r.topic, r.term) for r in br.relevance_skyband(placed, 5).collect()}
    for topic in range(3):
        own = [r for r in rows if r[0] == topic]
        beaten = {a[1]: sum(b[2] > a[2] + br.BEATEN_BY and b[3] > a[3] + br.BEATEN_BY for b in own) for a in own}
        left = {term for t, term in kept if t == topic}
        assert left <= {term for term, n in beaten.items() if n < 5} and len(left) < 60
        for step in np.linspace(0, 1, 101):
            ranked = sorted(own, key=lambda r: (-round(step * r[2] + (1 - step) * r[3], 9), r[1]))[:5]
            assert {(topic, r[1]) for r in ranked} <= kept


def test_map_keeps_distances_of_points_in_a_plane(spark):
    places = {0: (0.0, 0.0), 1: (3.0, 0.0), 2: (0.0, 4.0), 3: (2.0, 2.0)}
    pairs = [(a, b, math.dist(places[a], places[b])) for a in places for b in places if a < b]
    found = {r.topic: (r.x, r.y) for r in br.topic_map(spark.createDataFrame(pairs, "topic_a int, topic_b int, distance double")).collect()}
    assert [math.dist(found[a], found[b]) for a, b, _ in pairs] == pytest.approx([d for *_, d in pairs])
