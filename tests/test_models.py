import math
import random

import pytest

from themeloom.operators import joins, lda, topics
from themeloom.plans import corpus as cp
from themeloom.plans import modelling as md
from themeloom.sources import writers

THEMES = [
    ["tax", "income", "credit", "audit", "payer"],
    ["river", "water", "fish", "dam", "boat"],
    ["union", "wage", "strike", "labor", "shift"],
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice(THEMES[i % 3]) for _ in range(30)]) for i in range(90)] + [(90, ["rare"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    return md.build_corpus(docs, cp.CorpusSettings(no_below=5, no_above=0.5))


def test_prior_falls_and_sums_to_one():
    prior = lda.asymmetric_prior(14)
    assert sum(prior) == pytest.approx(1) and prior == sorted(prior, reverse=True)


def test_training_plan():
    assert lda.TrainingPlan.for_passes(20) == lda.TrainingPlan(0.2, 100)
    assert lda.TrainingPlan.for_passes(20, 0.05) == lda.TrainingPlan(0.05, 400)


def test_vectors_sum_to_one_and_are_blank_without_known_words(corpus):
    model = lda.train_topics(corpus.vectors, 3, lda.TrainingPlan(1.0, 5))
    rows = {r.doc_id: list(r.vector) for r in lda.topic_vectors(model, corpus.vectors).collect()}
    assert rows.pop(90) == [0.0, 0.0, 0.0]
    assert all(sum(vector) == pytest.approx(1) for vector in rows.values())
    assigned = {r.doc_id: r for r in md.assignments(corpus, model, 3).collect()}
    assert (assigned[90].topic, assigned[90].prob) == (-1, 0.0)
    prior = lda.asymmetric_prior(3)
    given = lda.topic_vectors(model, corpus.vectors, unknown=prior).filter("doc_id = 90").first()
    assert list(given.vector) == pytest.approx(prior)


def test_same_seed_same_model(corpus):
    plan = lda.TrainingPlan(0.5, 6)
    one, two = (lda.train_topics(corpus.vectors, 3, plan).topicsMatrix().toArray() for _ in range(2))
    assert (one == two).all()


def test_saved_model_and_corpus(corpus, spark, tmp_path):
    model = lda.train_topics(corpus.vectors, 3, lda.TrainingPlan(1.0, 3))
    lda.save_model(model, str(tmp_path / "m"))
    again = lda.load_model(str(tmp_path / "m"))
    assert sorted(md.assignments(corpus, again, 3).collect()) == sorted(md.assignments(corpus, model, 3).collect())
    bags = corpus.docs.select("doc_id")
    writers.save_corpus(corpus.dictionary, bags, corpus.vectoriser, str(tmp_path / "c"))
    dictionary, stored, vectoriser = writers.load_corpus(spark, str(tmp_path / "c"))
    assert dictionary.count() == 15 and stored.count() == 91
    assert vectoriser.vocabulary == corpus.vectoriser.vocabulary


def test_whole_run_and_evaluation(corpus, spark):
    run = md.run_models(corpus, (3, 4), passes=10)
    assert sorted(r.k for r in run.fits.collect()) == [3, 4]
    words = run.words.filter("k = 3").collect()
    assert {r.rank for r in words} == set(range(1, 11))
    assert run.coherence.count() == 7
    documents = spark.createDataFrame([(i, f"t{i}") for i in range(95)], "doc_id long, title string")
    wide = md.with_assignments(documents, run)
    assert wide.count() == 91
    metrics = {r.k: r for r in md.evaluate(wide, corpus, run.models).collect()}
    assert metrics[3].n_docs == 91 and metrics[3].error is None and metrics[3].silhouette > 0
    failed = md.evaluate(wide, corpus, {3: run.models[3]}).filter("k = 4").first()
    assert failed.silhouette is None and failed.error.startswith("KeyError")
    with pytest.raises(ValueError, match="not aligned"):
        md.evaluate(wide.filter("doc_id > 5"), corpus, run.models)


def test_fit_report_matches_the_library(corpus):
    model = lda.train_topics(corpus.vectors, 3, lda.TrainingPlan(1.0, 3))
    row = lda.fit_report(model, corpus.vectors, 90 * 30, 3).first()
    assert row.log_perplexity == pytest.approx(model.logPerplexity(corpus.vectors))
    terms = lda.topic_terms(model, corpus.dictionary)
    assert {round(r[1], 6) for r in terms.groupBy("topic").sum("weight").collect()} == {1.0}
    assert topics.top_words(terms).count() == 30


def test_other_vocabularies_are_refused(corpus, spark, tmp_path):
    model = lda.train_topics(corpus.vectors, 3, lda.TrainingPlan(1.0, 2))
    words = corpus.vectoriser.vocabulary
    lda.save_model(model, str(tmp_path / "m"), words)
    assert lda.load_model(str(tmp_path / "m"), words).vocabSize() == len(words)
    for other in (words[::-1], [*words[:-1], "other"], words[:-1]):
        with pytest.raises(ValueError, match="another vocabulary"):
            lda.load_model(str(tmp_path / "m"), other)
    with pytest.raises(ValueError):
        lda.save_model(model, str(tmp_path / "n"), words[:-1])
    writers.save_corpus(corpus.dictionary, corpus.docs, corpus.vectoriser, str(tmp_path / "c"))
    changed = corpus.dictionary.selectExpr("term_id", "CASE WHEN term_id = 0 THEN 'other' ELSE term END AS term")
    changed.write.mode("overwrite").parquet(str(tmp_path / "c" / "dictionary"))
    with pytest.raises(ValueError, match="different vocabularies"):
        writers.load_corpus(spark, str(tmp_path / "c"))


def test_models_side_by_side_are_those_of_one_by_one(corpus):
    def matrices(at_once):
        sweep = lda.train_sweep(corpus.vectors, (2, 3, 4), passes=2, at_once=at_once)
        return [(k, model.topicsMatrix().toArray()) for k, model in sweep]

    for (k, one), (other, many) in zip(matrices(1), matrices(3), strict=True):
        assert k == other and (one == many).all()


@pytest.mark.parametrize("most", [8_000_000, 0])
def test_completion_perplexity(spark, monkeypatch, most):
    monkeypatch.setattr(lda, "MOST_WEIGHTS", most)
    phi = [{"a": 0.5, "b": 0.5}, {"b": 0.25, "c": 0.75}]
    terms = spark.createDataFrame([(t, w, p) for t, words in enumerate(phi) for w, p in words.items()], "topic int, term string, weight double")
    theta = {1: [0.5, 0.5], 2: [1.0, 0.0], 3: [0.0, 0.0]}
    thetas = spark.createDataFrame(list(theta.items()), "doc_id int, vector array<double>")
    rows = [(1, "a", 2), (1, "b", 1), (1, "x", 4), (2, "b", 3), (2, "c", 1), (3, "a", 1), (4, "a", 1)]
    counts = spark.createDataFrame(rows, "doc_id int, term string, n int")
    expected = 2 * math.log(0.25) + math.log(0.375) + 3 * math.log(0.5)
    row = lda.completion_perplexity(thetas, terms, counts).first()
    assert (row.n_tokens, row.log_likelihood, row.perplexity) == pytest.approx((6, expected, math.exp(-expected / 6)))
    assert tuple(lda.completion_perplexity(thetas, terms, counts.limit(0)).first()) == (0, 0.0, None)


def test_a_trained_model_expects_what_the_even_words_announce(corpus, spark):
    model = lda.train_topics(corpus.vectors, 3, lda.TrainingPlan(1.0, 20))
    rng = random.Random(9)
    like = spark.createDataFrame([(i, [rng.choice(THEMES[i % 3]) for _ in range(20)]) for i in range(30)], "doc_id long, tokens array<string>")
    mixed = spark.createDataFrame(
        [(i, [THEMES[(i + j % 2) % 3][j % 5] for j in range(20)]) for i in range(30)], "doc_id long, tokens array<string>"
    )
    own, other = (md.heldout_perplexity(corpus, model, docs).first() for docs in (like, mixed))
    assert own.n_tokens == other.n_tokens == 300
    assert own.perplexity < 8 < other.perplexity
    training, held = md.heldout_documents(corpus.docs)
    assert training.count() + held.count() == 91 and held.count() > 5


@pytest.mark.parametrize("at_once", [100_000, 7])
def test_bound_is_the_librarys_without_its_work_per_document(corpus, monkeypatch, at_once):
    model = lda.train_topics(corpus.vectors, 3, lda.TrainingPlan(1.0, 4))
    expected = model.logLikelihood(corpus.vectors)
    monkeypatch.setattr(lda, "BOUND_ENTRIES", at_once)
    monkeypatch.setattr(type(model), "logLikelihood", None)
    assert lda.fit_report(model, corpus.vectors, 90 * 30, 3).first().log_likelihood == pytest.approx(expected)
    assert lda.likelihood_bound(model, corpus.vectors.limit(0)) != 0


def test_digamma():
    assert list(lda._digamma([0.02, 0.5, 1.0, 6.0, 1e6])) == pytest.approx(
        [-50.5447893104, -1.96351002602, -0.577215664902, 1.70611766843, 13.8155100579]
    )


def test_only_hot_words_repeat_their_weights(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"w{i}") for i in range(60_000)] + [(1, None)], "doc_id long, term string")
    terms = spark.createDataFrame([("hot", 0), ("w2", 1), ("w4", 2), ("other", 3)], "term string, value int")
    hot = joins.hot_values(rows, "term")
    assert [r.term for r in hot.collect()] == ["hot"]
    assert joins.with_hot_salts(terms, hot, "term").count() == joins.SALTS + 3
    joined = joins.hot_salted_join(rows, terms, "term", ["doc_id"])
    assert sorted(joined.columns) == ["doc_id", "term", "value"]
    assert joined.groupBy("value").count().orderBy("value").collect() == [(0, 30_000), (1, 1), (2, 1)]
