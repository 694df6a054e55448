"""Topic models: training for one or several topic counts, scoring, saving and loading."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions import vectors as vx
from themeloom.operators.joins import hot_salted_join
from themeloom.operators.online_lda import digamma as _digamma
from themeloom.operators.online_lda import all_trained_weights, entries, packed
from themeloom.staging import stage, staged_path

# Topic counts, passes over the corpus and seed.
TOPIC_COUNTS = (14, 15, 16, 17, 18, 19, 20)
PASSES = 20
SEED = 42

#: Share of the corpus that one update draws, the same at every size. Each update scans the corpus once.
SAMPLE = 0.2
#: Models that share the scans of their updates, and sets of such models that train side by side.
AT_ONCE, SETS_AT_ONCE = 4, 2
#: Words of documents' second halves that meet every task at most, times topics: 64 MB.
MOST_WEIGHTS = 8_000_000
#: Words of documents whose likelihood a task takes at once.
BOUND_ENTRIES = 100_000


@dataclass(frozen=True)
class TrainingPlan:
    """How often and on how much of the corpus one model is updated."""

    sample: float
    updates: int

    @classmethod
    def for_passes(cls, passes: int = PASSES, sample: float = SAMPLE) -> TrainingPlan:
        return cls(sample, math.ceil(passes / sample))


def asymmetric_prior(k: int) -> list[float]:
    """Document prior that falls with the topic number and sums to 1."""
    weights = [1.0 / (i + math.sqrt(k)) for i in range(k)]
    return [w / sum(weights) for w in weights]


def train_together(
    vectors: DataFrame, topic_counts: Sequence[int], plan: TrainingPlan, seed: int = SEED, drawn_from: DataFrame | None = None
) -> list[LDAModel]:
    """Online variational LDA on the column ``features``, one model per topic count.

    Spark's optimizer sets the models up; their updates are made by ``online_lda``, many documents and all models at a
    time. They scan ``drawn_from``, the same vectors cached, or else ``vectors``.
    """
    spark = vectors.sparkSession
    priors = [asymmetric_prior(k) for k in topic_counts]

    def begin(k: int, prior: list[float]) -> LDAModel:
        return LDA(
            k=k,
            seed=seed,
            optimizer="online",
            maxIter=0,
            subsamplingRate=plan.sample,
            docConcentration=prior,
            topicConcentration=1.0 / k,
            optimizeDocConcentration=False,
            featuresCol="features",
            topicDistributionCol="topic_vector",
        ).fit(vectors)

    with ThreadPoolExecutor(len(topic_counts)) as pool:
        begun = list(pool.map(inheritable_thread_target(spark)(begin), topic_counts, priors))
        weights = all_trained_weights(
            vectors if drawn_from is None else drawn_from,
            [model.topicsMatrix().toArray() for model in begun],
            [np.array(prior) for prior in priors],
            [1.0 / k for k in topic_counts],
            plan.sample, plan.updates, seed,
        )
        return list(pool.map(inheritable_thread_target(spark)(with_weights), begun, weights))


def train_topics(
    vectors: DataFrame, k: int, plan: TrainingPlan, seed: int = SEED, drawn_from: DataFrame | None = None
) -> LDAModel:
    """``train_together`` for one topic count."""
    return train_together(vectors, (k,), plan, seed, drawn_from)[0]


def with_weights(model: LDAModel, weights: np.ndarray) -> LocalLDAModel:
    """The model with other word weights, a row per word and a column per topic."""
    spark = SparkSession.active()
    path, changed = staged_path(spark, "untrained"), staged_path(spark, "trained")
    model.write().save(path)
    stored = spark.read.parquet(f"{path}/data")
    (rest,) = stored.drop("topicsMatrix").collect()
    values = rest.asDict() | {"topicsMatrix": DenseMatrix(*weights.shape, weights.ravel(order="F"))}
    row = tuple(values[name] for name in stored.columns)
    spark.createDataFrame([row], stored.schema, verifySchema=False).coalesce(1).write.parquet(f"{changed}/data")
    spark.read.text(f"{path}/metadata").coalesce(1).write.text(f"{changed}/metadata")
    return LocalLDAModel.load(changed)


def train_sweep(
    vectors: DataFrame,
    topic_counts: Sequence[int] = TOPIC_COUNTS,
    passes: int = PASSES,
    seed: int = SEED,
    sample: float = SAMPLE,
    at_once: int = AT_ONCE,
) -> Iterator[tuple[int, LDAModel]]:
    """One model per topic count over the same count vectors, in the order of ``topic_counts``.

    ``vectors`` should be a staged table: it is packed and cached for all updates, and what an executor loses is
    read again. Up to ``at_once`` models share the scans and draws of their updates. There are ``SETS_AT_ONCE`` such sets
    at a time, each in a scheduler pool of its own name, so that the tasks of one fill the gaps of the other; the
    models are those of training one by one.
    """
    plan = TrainingPlan.for_passes(passes, sample)
    spark = vectors.sparkSession
    cached = packed(vectors).persist(StorageLevel.MEMORY_AND_DISK)
    most = max(1, at_once)
    sets = [tuple(topic_counts[first : first + most]) for first in range(0, len(topic_counts), most)]

    def train(counts: tuple[int, ...]) -> list[LDAModel]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"topics-{counts[0]}")
        return train_together(vectors, counts, plan, seed, cached)

    try:
        with ThreadPoolExecutor(SETS_AT_ONCE) as pool:
            running = [(counts, pool.submit(inheritable_thread_target(spark)(train), counts)) for counts in sets]
            for counts, models in running:
                yield from zip(counts, models.result())
    finally:
        cached.unpersist()


def fit_report(model: LDAModel, vectors: DataFrame, n_tokens: int, k: int) -> DataFrame:
    """``k, vocabulary, log_likelihood, log_perplexity`` of a fitted model.

    ``n_tokens`` counts the corpus' known tokens. The bound costs one inference pass over the corpus;
    the perplexity follows from it.
    """
    bound = likelihood_bound(model, vectors)
    row = (k, model.vocabSize(), bound, -bound / n_tokens)
    return vectors.sparkSession.createDataFrame(
        [row], "k int, vocabulary long, log_likelihood double, log_perplexity double"
    )


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.lgamma, 1, 1)(x).astype(float)


def likelihood_bound(model: LDAModel, vectors: DataFrame) -> float:
    """The variational bound of ``model.logLikelihood(vectors)``, in time linear in the documents' words.

    That method takes the exponential of every word's weights once per document. Here they are taken once and
    sent to every executor. A document's variational parameters are its topic weights times its prior's
    and its words' sum.
    """
    alpha = np.array(model.estimatedDocConcentration().toArray())
    weights = model.topicsMatrix().toArray()
    eta = model.getTopicConcentration()
    if eta <= 0:  # not set: what training took
        eta = 1.0 / len(alpha)
    log_words = _digamma(weights) - _digamma(weights.sum(axis=0))
    n_words = len(weights)
    bound = float(((eta - weights) * log_words).sum() + (_log_gamma(weights) - math.lgamma(eta)).sum())
    bound += float((math.lgamma(eta * n_words) - _log_gamma(weights.sum(axis=0))).sum())
    shared = vectors.sparkSession.sparkContext.broadcast((alpha, log_words))

    def documents_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, known = shared.value
        total = 0.0
        for batch in batches:
            sizes, words, counts = entries(batch.column(0))
            theta = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), len(prior))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            tokens = np.bincount(owner, counts, len(sizes))
            gamma = np.where(tokens[:, None] > 0, theta, 1.0) * (prior.sum() + tokens)[:, None]
            log_theta = _digamma(gamma) - _digamma(gamma.sum(axis=1))[:, None]
            for start in range(0, len(words), BOUND_ENTRIES):
                part = slice(start, start + BOUND_ENTRIES)
                chances = log_theta[owner[part]] + known[words[part]]
                most = chances.max(axis=1)
                total += float(counts[part] @ (most + np.log(np.exp(chances - most[:, None]).sum(axis=1))))
            own = ((prior - gamma) * log_theta + _log_gamma(gamma) - _log_gamma(prior)).sum(axis=1)
            own += math.lgamma(prior.sum()) - _log_gamma(gamma.sum(axis=1))
            total += float(own[tokens > 0].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["part"])

    inferred = model.transform(vectors).select("features", vector_to_array("topic_vector").alias("theta"))
    return bound + (inferred.mapInArrow(documents_part, "part double").agg(F.sum("part")).first()[0] or 0.0)


def topic_vectors(
    model: LDAModel,
    vectors: DataFrame,
    key: Sequence[str] = ("doc_id",),
    unknown: Sequence[float] | None = None,
) -> DataFrame:
    """``doc_id, vector``: weight of every topic.

    A document without known words gets zeros, or the weights ``unknown`` (the prior, for instance).
    """
    weights = vector_to_array("topic_vector")
    if unknown is not None:
        given = F.array(*[F.lit(float(weight)) for weight in unknown])
        weights = F.when(vx.is_blank(weights), given).otherwise(weights)
    return model.transform(vectors).select(*key, weights.alias("vector"))


def topic_terms(model: LDAModel, dictionary: DataFrame) -> DataFrame:
    """``topic, term_id, term, weight`` for every topic and term of the vocabulary.

    Its size is the size of the fitted model: topic count times ``keep_terms`` at most.
    """
    described = model.describeTopics(model.vocabSize())
    pairs = F.explode(F.arrays_zip("termIndices", "termWeights"))
    rows = described.select("topic", pairs.alias("pair")).select(
        "topic", F.col("pair.termIndices").cast("long").alias("term_id"), F.col("pair.termWeights").alias("weight")
    )
    return rows.join(dictionary.select("term_id", "term"), "term_id").select("topic", "term_id", "term", "weight")


def split_tokens(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents by their tokens at even places, and by those at odd places."""
    even, odd = (docs.withColumn("tokens", F.expr(f"filter(tokens, (t, i) -> i % 2 = {rest})")) for rest in (0, 1))
    return even, odd


def completion_perplexity(
    thetas: DataFrame, terms: DataFrame, counts: DataFrame, key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``n_tokens, log_likelihood, perplexity`` of words whose documents' topics come from other words.

    ``thetas`` holds the key and ``vector``, a weight per topic; ``terms`` ``topic, term, weight`` with topics
    numbered as the vector's entries; ``counts`` the key, ``term`` and ``n``. A word's probability is the sum over topics of
    document weight times word weight. Words of no topic and documents without weights are left out; without
    any token the likelihood is 0 and the perplexity null. Word weights go to every executor while they are
    few, else they are joined by words, of which the hot ones are salted.
    """
    weights = F.map_from_entries(F.collect_list(F.struct("topic", "weight")))
    per_term = stage(terms.where("weight > 0").groupBy("term").agg(weights.alias("weights")), "completion-terms")
    n_topics = terms.agg(F.coalesce(F.max("topic") + 1, F.lit(0))).first()[0]
    if per_term.count() * n_topics <= MOST_WEIGHTS:
        words = counts.join(F.broadcast(per_term), "term")
    else:
        words = hot_salted_join(counts, per_term, "term", key)
    scored = words.join(thetas.select(*key, "vector"), list(key))
    parts = F.transform("vector", lambda p, t: p * F.coalesce(F.try_element_at("weights", t.cast("int")), F.lit(0.0)))
    chance = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    scored = scored.select("n", chance.alias("chance")).where("chance > 0")
    total = scored.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.col("n") * F.log("chance")), F.lit(0.0)).alias("log_likelihood"),
    )
    return total.select(
        "n_tokens",
        "log_likelihood",
        F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_likelihood") / F.col("n_tokens"))).alias("perplexity"),
    )


def vocabulary_digest(vocabulary: Sequence[str]) -> str:
    """What tells one ordered vocabulary from another."""
    return hashlib.sha256("\n".join(vocabulary).encode()).hexdigest()


def save_model(model: LDAModel, path: str, vocabulary: Sequence[str] | None = None) -> None:
    """The model and the digest of the vocabulary whose ids it speaks of, if given, under one folder."""
    if vocabulary is not None and model.vocabSize() != len(vocabulary):
        raise ValueError(f"the model has {model.vocabSize()} words, the vocabulary {len(vocabulary)}")
    model.write().overwrite().save(f"{path}/model")
    if vocabulary is None:
        return
    spark = SparkSession.active()
    digest = spark.createDataFrame([(len(vocabulary), vocabulary_digest(vocabulary))], "words long, digest string")
    digest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_model(path: str, vocabulary: Sequence[str] | None = None) -> LocalLDAModel:
    """What ``save_model`` wrote; raises if ``vocabulary``, where given, is not that of the model."""
    if vocabulary is None:
        return LocalLDAModel.load(f"{path}/model")
    known = SparkSession.active().read.schema("words long, digest string").json(f"{path}/manifest").first()
    if known is None or known["digest"] != vocabulary_digest(vocabulary):
        raise ValueError(f"the model in {path} belongs to another vocabulary")
    return LocalLDAModel.load(f"{path}/model")
