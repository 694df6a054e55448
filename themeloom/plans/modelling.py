"""Topic models over a prepared corpus, and their evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.operators import cluster_metrics as cm
from themeloom.operators import coherence as coh
from themeloom.operators import dictionary as dct
from themeloom.operators import lda, topics
from themeloom.operators.documents import require_alignment
from themeloom.plans.corpus import CorpusSettings
from themeloom.staging import stage

HELD_OUT_ONE_OF = 5
#: Models that are described or measured side by side: most of these jobs are too short to fill a cluster.
MODELS_AT_ONCE = 4


@dataclass(frozen=True)
class Corpus:
    """Prepared documents with their dictionary and count vectors, all staged."""

    docs: DataFrame
    dictionary: DataFrame
    vectors: DataFrame
    vectoriser: CountVectorizerModel
    key: tuple[str, ...] = ("doc_id",)


def build_corpus(
    docs: DataFrame, settings: CorpusSettings | None = None, key: tuple[str, ...] = ("doc_id",)
) -> Corpus:
    """Dictionary and count vectors of prepared documents (a staged table)."""
    settings = settings or CorpusSettings()
    if settings.keep_terms is None:
        raise ValueError("a model's vocabulary goes through the driver: set keep_terms")
    dictionary = stage(
        dct.build_dictionary(docs, settings.no_below, settings.no_above, settings.keep_terms), "dictionary"
    )
    vectoriser = dct.vectoriser(dictionary)
    vectors = dct.count_vectors(docs, vectoriser).select(*key, "features")
    # Sampling depends on row order, so a fixed order makes a run with the same seed repeatable.
    vectors = stage(vectors.sortWithinPartitions(*key), "vectors")
    return Corpus(docs, dictionary, vectors, vectoriser, key)


def assignments(corpus: Corpus, model: LDAModel, k: int) -> DataFrame:
    """``doc_id, k, topic, prob`` for one model."""
    vectors = lda.topic_vectors(model, corpus.vectors, corpus.key)
    dominant = topics.dominant_topics(vectors, corpus.key)
    return dominant.select(*corpus.key, F.lit(k).alias("k"), "topic", "prob")


@dataclass(frozen=True)
class ModelRun:
    """What one sweep over topic counts leaves behind, as staged tables."""

    models: dict[int, LDAModel]
    fits: DataFrame  # k, vocabulary, log_likelihood, log_perplexity
    words: DataFrame  # k, topic, rank, term, weight
    assignments: DataFrame  # key, k, topic, prob
    coherence: DataFrame  # k, topic, coherence


def run_models(
    corpus: Corpus,
    topic_counts: Sequence[int] = lda.TOPIC_COUNTS,
    passes: int = lda.PASSES,
    seed: int = lda.SEED,
    trained: Mapping[int, LDAModel] | None = None,
) -> ModelRun:
    """Train every topic count and collect words, assignments and coherence; ``trained`` models are taken as they are."""
    n_tokens = dct.token_total(corpus.dictionary)

    def described(k: int, model: LDAModel) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        terms = stage(lda.topic_terms(model, corpus.dictionary), f"terms-k{k}")
        fit = lda.fit_report(model, corpus.vectors, n_tokens, k)
        words = topics.top_words(terms).select(F.lit(k).alias("k"), "*")
        by_topic = coh.coherence_by_topic(corpus.docs, terms)
        coherence = by_topic.select(F.lit(k).alias("k"), "topic", "coherence")
        return fit, words, assignments(corpus, model, k), coherence

    sweep = trained.items() if trained else lda.train_sweep(corpus.vectors, topic_counts, passes, seed)
    models, running = {}, []
    with ThreadPoolExecutor(MODELS_AT_ONCE) as pool:
        for k, model in sweep:
            models[k] = model
            running.append(pool.submit(inheritable_thread_target(corpus.docs.sparkSession)(described), k, model))
    fits, words, assigned, coherence = zip(*(one.result() for one in running))
    tables = [
        stage(reduce(DataFrame.unionByName, parts), name)
        for parts, name in [
            (fits, "fits"),
            (words, "words"),
            (assigned, "assignments"),
            (coherence, "coherence"),
        ]
    ]
    return ModelRun(models, *tables)


def with_assignments(documents: DataFrame, run: ModelRun, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The modelled documents with ``topic_k*`` columns; documents that fell out are left out."""
    wide = topics.wide_assignments(run.assignments, sorted(run.models), key)
    return documents.join(wide, list(key))


def heldout_documents(docs: DataFrame, one_of: int = HELD_OUT_ONE_OF, key: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """Documents to train on, and every ``one_of``-th by a hash of the key, held out."""
    held = F.pmod(F.xxhash64(*key), F.lit(one_of)) == 0
    return docs.where(~held), docs.where(held)


def heldout_perplexity(corpus: Corpus, model: LDAModel, heldout: DataFrame) -> DataFrame:
    """``n_tokens, log_likelihood, perplexity`` by document completion.

    The topics of each held-out document are inferred from its tokens at even places; its tokens at odd
    places are scored. Tokens outside the dictionary count for neither; a document without a known token at
    an even place has no topics and is left out. ``model`` should not have seen ``heldout``.
    """
    seen, scored = lda.split_tokens(heldout.select(*corpus.key, "tokens"))
    vectors = dct.count_vectors(seen, corpus.vectoriser).select(*corpus.key, "features")
    thetas = lda.topic_vectors(model, vectors, corpus.key)
    counts = dct.bag_of_words(scored, corpus.dictionary, corpus.key)
    terms = lda.topic_terms(model, corpus.dictionary).select("topic", F.col("term_id").alias("term"), "weight")
    return lda.completion_perplexity(thetas, terms, counts.withColumnRenamed("term_id", "term"), corpus.key)


def evaluate(
    wide: DataFrame, corpus: Corpus, models: dict[int, LDAModel], measure: str = "euclidean"
) -> DataFrame:
    """Cluster metrics for every topic count that has both a column and a model.

    Tables must hold the same documents; they are never cut to a common length. A topic count that
    fails stays as a row with its error. Some topic counts are measured side by side. ``measure`` is that of the silhouette, see ``metric_row``.
    """
    require_alignment(wide, corpus.vectors, corpus.key)

    def measured(k: int, column: str) -> DataFrame:
        try:
            vectors = lda.topic_vectors(models[k], corpus.vectors, corpus.key)
            labels = wide.select(*corpus.key, F.col(column).alias("label"))
            points = stage(vectors.join(labels, list(corpus.key)).select("vector", "label"), f"points-k{k}")
            return cm.metric_row(points, k, measure)
        except Exception as failure:  # a failed topic count must not lose the others
            failed = [(k, None, None, None, None, f"{type(failure).__name__}: {failure}")]
            return wide.sparkSession.createDataFrame(failed, cm.METRICS)

    columns = sorted(topics.topic_columns(wide.columns).items())
    with ThreadPoolExecutor(MODELS_AT_ONCE) as pool:
        rows = list(pool.map(inheritable_thread_target(wide.sparkSession)(measured), *zip(*columns))) if columns else []
    if not rows:
        raise ValueError("no topic columns: expected names such as topic_k14")
    return reduce(DataFrame.unionByName, rows)
