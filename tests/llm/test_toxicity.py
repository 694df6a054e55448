import zlib

import numpy as np
import pytest

from themeloom.llm import toxicity as tx

SCHEMA = "doc_id long, text string, score double, predicted string"


def sample(n=120, bias=True):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        toxic = i % 3 == 0
        words = [f"w{j}" for j in rng.integers(0, 300, 40)]
        if toxic:
            words[3:5] = [str(rng.choice(["vilefoo", "nastybar", "vilebaz"])), "Nastyqux,"]
        # in this sample toxic texts name one group more often
        if bias and (toxic or i % 5 == 0):
            words.append("muslim" if toxic else "christian")
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_names_of_groups_carry_no_score():
    rows = sample()
    model = tx.train([tx.plain_words(t) for _, t, _ in rows], np.array([float(y) for *_, y in rows]))
    assert all((model.score(tx.plain_words(t)) >= tx.THRESHOLD) == bool(y) for _, t, y in rows)
    neutral = [model.score({"my", "neighbour", "is", term}) for term in tx.IDENTITY_TERMS]
    assert max(neutral) < 0.5 and max(neutral) - min(neutral) < 0.1
    assert model.score({"muslim", "vilefoo", "nastyqux"}) == pytest.approx(model.score({"jewish", "vilefoo", "nastyqux"}), abs=0.1)


def test_scores_every_row_and_never_learns_held_out_labels(spark):
    rows = sample(150, bias=False)
    docs = spark.createDataFrame([(i, t, 0.5, "p") for i, t, _ in rows] + [(900, None, 0.5, "p"), (None, "", 0.5, "p"), (3, rows[3][1], 0.5, "p")], SCHEMA)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    straight = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    flipped = spark.createDataFrame(flip, "doc_id long, toxic int")
    out = tx.scored_documents(docs, straight).collect()
    assert len(out) == 153
    assert sorted(out, key=str) == sorted(tx.scored_documents(docs, flipped).collect(), key=str)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.doc_id in truth]) > 0.97
    left = tx.without_toxic(docs, straight)
    assert left.columns == docs.columns
    assert left.count() == sum(r.predicted == 0 for r in out)


def test_names_are_swapped_in_the_labelled_texts():
    texts = [{"the", "muslim", "jews", "met"}, {"nobody", "here"}, set(tx.IDENTITY_TERMS) | {"x"}]
    swapped = tx.counterfactuals(texts, np.random.default_rng(1), swaps=30)
    assert [i for i, _ in swapped] == [0] * 30 + [2] * 30
    for i, words in swapped:
        assert words - set(tx.IDENTITY_TERMS) == texts[i] - set(tx.IDENTITY_TERMS)
        assert len(words) == len(texts[i]) and (i == 2 or not words & {"muslim", "jews"})
    assert len({frozenset(words) for i, words in swapped if i == 0}) > 20


def test_loss_and_slopes_equal_plain_recomputation():
    rng = np.random.default_rng(4)
    words = [*(f"word{j:02d}x" for j in range(30)), *tx.IDENTITY_TERMS[:6]]
    texts = [set(map(str, rng.choice(words, 8, replace=False))) for _ in range(25)]
    labels = np.array([i % 3 == 0 for i in range(25)], float)
    swapped = tx.counterfactuals(texts, rng)
    features = sorted({f for t in texts for w in t for f in tx.word_features(w)} | {f"={t}" for t in tx.IDENTITY_TERMS})
    loss = tx.Loss(texts, labels, swapped, features)
    weights, bias = rng.normal(0, 1, len(features)), 0.3

    def plain(weights, bias):
        weight = dict(zip(features, weights, strict=True))
        logit = lambda t: bias + sum(weight[f] for f in {f for w in t for f in tx.word_features(w)})
        total = sum(
            np.log1p(np.exp(-logit(t) if y else logit(t))) / (2 * (labels == y).sum()) for t, y in zip(texts, labels, strict=True)
        )
        total += tx.PENALTY * np.mean([(logit(texts[i]) - logit(t)) ** 2 for i, t in swapped])
        return total + tx.RIDGE / 2 * sum(w * w for w in weights)

    assert loss.value(weights, bias) == pytest.approx(plain(weights, bias), rel=1e-9)
    slopes, slope = loss.slopes(weights, bias)
    for j in range(len(features)):
        near = np.eye(len(features))[j] * 1e-5
        assert slopes[j] == pytest.approx((plain(weights + near, bias) - plain(weights - near, bias)) / 2e-5, abs=1e-6)
    assert slope == pytest.approx((plain(weights, bias + 1e-5) - plain(weights, bias - 1e-5)) / 2e-5, abs=1e-6)


def test_training_lowers_the_loss_and_the_penalty_evens_names():
    rows = sample(300)
    texts, labels = [tx.plain_words(t) for _, t, _ in rows], np.array([float(y) for *_, y in rows])
    model = tx.train(texts, labels)
    features = sorted({f"={t}" for t in tx.IDENTITY_TERMS} | set(tx.clear_features(texts, labels)))
    loss = tx.Loss(texts, labels, tx.counterfactuals(texts, np.random.default_rng(3)), features)
    weights = np.array([model.weights.get(f, 0.0) for f in features])
    assert loss.value(weights, model.bias) < 0.05 < loss.value(np.zeros(len(features)), 0.0)
    # without the penalty the name that toxic texts hold more often gives itself away
    free = tx.Loss(texts, labels, [], features)
    loose = np.zeros(len(features))
    for _ in range(400):
        loose -= 0.3 / free.curvature() * free.slopes(loose, model.bias)[0]
    at = [features.index(f"={t}") for t in ("muslim", "christian")]
    assert abs(weights[at[0]] - weights[at[1]]) < 0.2 * abs(loose[at[0]] - loose[at[1]])


def test_features_mark_both_classes():
    texts = [{"common", "badword"}] * 30 + [{"common", "goodword"}] * 30
    clear = tx.clear_features(texts, np.r_[np.ones(30), np.zeros(30)])
    assert {"=badword", "=goodword"} <= set(clear) and "=common" not in clear
    model = tx.train(texts, np.r_[np.ones(30), np.zeros(30)])
    assert model.weights["=badword"] > 0 > model.weights["=goodword"]


def test_one_text_of_a_key_is_learned_from(spark):
    docs = spark.createDataFrame([(i % 4, f"vile{i % 2}word nasty{i} so", 0.1, "p") for i in range(400)], SCHEMA)
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(400)], "doc_id long, toxic int")
    seen = []
    train = tx.train
    try:
        tx.train = lambda texts, labels: seen.append((texts, labels.tolist())) or train(texts, labels)
        tx.fitted(docs, labels)
    finally:
        tx.train = train
    (texts, ys), = seen
    usable = [i for i in range(4) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert len(texts) == len(usable) and sorted(ys) == sorted(i % 2 for i in usable)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", 0.1, "p")], SCHEMA)
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert tx.scored_documents(docs.limit(0), labels).count() == 0
    assert [r.predicted for r in tx.scored_documents(docs, labels.limit(0)).collect()] == [0]
