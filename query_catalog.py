"""Registered queries: each operator over the whole of the given tables.

The tables hold no case numbers, no null texts, no topic models and no assignments. Where an operator
needs them, the query derives them from the tables: ``filings`` adds boilerplate to each text,
``gappy`` blanks the Spanish texts, the ``embeddings`` arrays stand in for document-topic vectors, and
languages stand in for topics with their word shares as weights.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml.clustering import LDAModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.functions import stopwords as sw
from themeloom.functions import text as tx
from themeloom.functions.vectors import as_doubles
from themeloom.operators import agreement
from themeloom.operators import browser as br
from themeloom.operators import cluster_metrics as cm
from themeloom.operators import coherence as coh
from themeloom.operators import dictionary as dct
from themeloom.operators import documents as dox
from themeloom.operators import inflection, lda, topics, trends
from themeloom.operators import lemmas as lem
from themeloom.operators import phrases as phr
from themeloom.plans import corpus as cp
from themeloom.plans import modelling as md
from themeloom.sources import readers, writers
from themeloom.staging import stage, staged_path

TOPIC_COUNTS = lda.TOPIC_COUNTS
SETTINGS = cp.CorpusSettings()
KEPT_TERMS = 40
CUT_CHARS = 1_000


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return readers.read_documents(spark, f"{folder}/{name}.parquet")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents")


def _texts(spark: SparkSession, folder: str, *key: str) -> DataFrame:
    return readers.read_texts(spark, f"{folder}/documents.parquet", key=("doc_id", *key))


def _joined(tokens: str | Column = "tokens") -> Column:
    return F.array_join(tokens, " ").alias("tokens")


def _filings(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    text = (
        F.when(
            F.col("lang") == "en",
            F.concat(
                F.lit("Cover sheet. joint  petition for a WRIT\nof certiorari No. "),
                number,
                F.lit("-12, 410 U.S. 113 "),
                "text",
            ),
        )
        .when(F.col("lang") == "fr", F.concat("text", F.lit(" No "), number, F.lit("–7 and US 77 end")))
        .when(
            F.col("lang") == "de",
            F.concat(
                F.lit("JOINT PETITION FOR A WRIT OF CERTIORARI one "),
                "text",
                F.lit(" Joint petition for a writ of certiorari two"),
            ),
        )
        .otherwise(F.col("text"))
    )
    return _texts(spark, folder, "lang").select("doc_id", text.alias("text"))


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    text = F.when(F.col("lang") != "es", F.col("text"))
    return _texts(spark, folder, "lang").select("doc_id", "lang", text.alias("text"))


def _cleaned(step, spark: SparkSession, folder: str) -> DataFrame:
    text = step(F.col("text"))
    return _filings(spark, folder).select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest")
    )


def _content(spark: SparkSession, folder: str) -> DataFrame:
    return dox.content_tokens(_texts(spark, folder), SETTINGS.stop_words)


def _kept(spark: SparkSession, folder: str) -> DataFrame:
    return dox.with_enough_tokens(_content(spark, folder))


def _lemmas(spark: SparkSession, folder: str) -> DataFrame:
    return dox.with_enough_tokens(cp.lemma_tokens(_kept(spark, folder), SETTINGS))


# Sources and sinks


def read_documents(spark, folder):
    return (
        _documents(spark, folder)
        .groupBy("lang")
        .agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    )


def read_texts(spark, folder):
    return dox.present_texts(_texts(spark, folder)).select("doc_id", F.length("text").cast("long").alias("n_chars"))


def row_count(spark, folder):
    return readers.row_count(_documents(spark, folder))


def preview(spark, folder):
    return readers.preview(_documents(spark, folder).select("doc_id", "lang", "source", "n_chars"))


def write_assignments(spark, folder):
    path = staged_path(spark, "by-k")
    writers.write_by_topic_count(_assignments(spark, folder), path)
    return spark.read.parquet(path).select("doc_id", F.col("k").cast("int").alias("k"), "topic", "prob")


def write_wide_assignments(spark, folder):
    """All topic counts as columns, written and read again."""
    path = staged_path(spark, "wide-assignments")
    writers.write_table(_wide(spark, folder), path)
    return spark.read.parquet(path).select(
        "doc_id", *(c for k in TOPIC_COUNTS for c in (f"topic_k{k}", F.round(f"topic_k{k}_prob", 6).alias(f"topic_k{k}_prob")))
    )


def write_topic_texts(spark, folder):
    """Texts with their topic, written and read again; languages stand in for topics."""
    path = staged_path(spark, "topic-texts")
    writers.write_table(_texts(spark, folder, "lang").select("text", F.col("lang").alias("topic")), path)
    return spark.read.parquet(path).select(F.md5("text").alias("digest"), "topic")


def write_metric_csv(spark, folder):
    """The metric table as CSV, written and read again."""
    path = staged_path(spark, "metrics-csv")
    writers.write_csv(metric_table(spark, folder), path)
    schema = "k int, silhouette double, davies_bouldin double, calinski_harabasz double"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_index_csv(spark, folder):
    path = staged_path(spark, "index-csv")
    writers.write_csv(index_map(spark, folder), path)
    schema = "doc_id long, original_index long, final_index long"
    return spark.read.schema(schema).option("header", True).csv(path)


def write_topic_lines(spark, folder):
    path = staged_path(spark, "topic-lines")
    writers.write_topic_lines(topics.topic_lines(topics.top_words(_language_terms(spark, folder))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def save_corpus(spark, folder):
    docs = stage(_kept(spark, folder), "docs")
    dictionary = stage(dct.build_dictionary(docs), "dictionary")
    path = staged_path(spark, "corpus")
    bags = dct.bag_of_words(docs, dictionary)
    writers.save_corpus(dictionary, bags, dct.vectoriser(dictionary), path)
    terms, stored, vectoriser = writers.load_corpus(spark, path)
    known = spark.createDataFrame([(len(vectoriser.vocabulary),)], "vocabulary long")
    sums = stored.join(terms, "term_id").groupBy("term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"))
    return sums.withColumn("vocabulary", F.lit(known.first()[0]))


# Text


def present_texts(spark, folder):
    return dox.present_texts(_gappy(spark, folder)).select(
        "doc_id", F.length("text").cast("long").alias("n_chars")
    )


def original_index(spark, folder):
    return dox.original_index(_gappy(spark, folder))


def truncate_text(spark, folder):
    cut = tx.truncate_text(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut).alias("digest")
    )


def truncate_text_binding(spark, folder):
    """A bound inside the data: most texts are longer."""
    cut = tx.truncate_text(F.col("text"), CUT_CHARS)
    return _documents(spark, folder).select(
        "doc_id", F.length(cut).cast("long").alias("n_chars"), F.md5(cut).alias("digest")
    )


def letters_only(spark, folder):
    return _texts(spark, folder).select("doc_id", F.md5(tx.letters_only(F.col("text"))).alias("digest"))


def word_tokens(spark, folder):
    return _texts(spark, folder).select("doc_id", _joined(tx.words_of(F.col("text"))))


def content_tokens(spark, folder):
    return dox.content_tokens(_filings(spark, folder), SETTINGS.stop_words).select("doc_id", _joined())


def conversation_tokens(spark, folder):
    turns = readers.read_texts(spark, f"{folder}/conversations.parquet", key=("conv_id", "turn"))
    docs = dox.content_tokens(turns, SETTINGS.stop_words, ("conv_id", "turn"))
    return dox.with_enough_tokens(docs).select("conv_id", "turn", _joined())


def stop_word_use(spark, folder):
    base, legal = set(sw.BASE_ENGLISH), set(sw.legal_words())
    words = F.col("token")
    counts = dct.token_counts(_texts(spark, folder).select(tx.words_of(F.col("text"), min_length=1).alias("tokens")))
    return counts.filter(words.isin(*sorted(base | legal))).select(
        "token", words.isin(*sorted(base)).alias("is_base"), words.isin(*sorted(legal)).alias("is_legal"), "n"
    )


def enough_tokens(spark, folder):
    return _kept(spark, folder).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))


def lemma_tokens(spark, folder):
    return lem.lemmatised(_kept(spark, folder)).select("doc_id", _joined())


def inflected_forms(spark, folder):
    return inflection.attested_forms(stage(inflection.vocabulary_of(_kept(spark, folder)), "vocabulary"))


def attested_lemmas(spark, folder):
    return inflection.attested_lemmas(_kept(spark, folder)).select("doc_id", _joined())


def lemma_stop_words(spark, folder):
    return _lemmas(spark, folder).select("doc_id", _joined())


def user_lemmatiser(spark, folder):
    return lem.lemmatised_by(_kept(spark, folder), lem.table_worker).select("doc_id", _joined())


def user_function(spark, folder):
    worker = lem.table_worker()
    settings = cp.CorpusSettings(lemmatise=partial(lem.lemmatised_by, make_worker=lambda: worker))
    return cp.lemma_tokens(_kept(spark, folder), settings).select("doc_id", _joined())


def text_chunks(spark, folder):
    chunks = dox.chunked(_texts(spark, folder))
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text")


# Joins and alignment


def aligned_documents(spark, folder):
    key = ("doc_id", "lang", "source")
    docs = dox.content_tokens(_texts(spark, folder, "lang", "source"), SETTINGS.stop_words, key)
    return dox.with_enough_tokens(docs).select(*key, F.size("tokens").cast("long").alias("n_tokens"))


def labelled_documents(spark, folder):
    kept = _kept(spark, folder).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"))
    labels = _table(spark, folder, "labels")
    return kept.join(labels, "doc_id").groupBy("quality", "toxic").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )


def alignment_report(spark, folder):
    return dox.alignment_report(_kept(spark, folder), _table(spark, folder, "labels"))


def alignment_changes(spark, folder):
    """Equal keys whose texts differ: the documents beside their filings."""
    return dox.alignment_report(_texts(spark, folder), _filings(spark, folder), content=("text",))


def index_map(spark, folder):
    gappy = _gappy(spark, folder)
    survivors = dox.with_enough_tokens(dox.content_tokens(gappy, SETTINGS.stop_words))
    return dox.index_map(dox.original_index(gappy), survivors)


# Counts, dictionary, phrases


def token_counts(spark, folder):
    return dct.token_counts(_kept(spark, folder))


def top_tokens(spark, folder):
    return dct.top_tokens(_kept(spark, folder))


def without_top_tokens(spark, folder):
    kept = _kept(spark, folder)
    return dct.without_top_tokens(kept, dct.top_tokens(kept)).select("doc_id", _joined())


def document_frequency(spark, folder):
    return dct.term_statistics(_kept(spark, folder))


def dictionary(spark, folder):
    return dct.build_dictionary(stage(_kept(spark, folder), "docs"))


def dictionary_keep_terms(spark, folder):
    """The dictionary with a bound on its terms that binds."""
    docs = stage(_kept(spark, folder), "docs")
    return dct.build_dictionary(docs, keep_terms=KEPT_TERMS)


def dictionary_size(spark, folder):
    return dictionary(spark, folder).agg(F.count("*").alias("n_terms"))


def known_tokens(spark, folder):
    docs = stage(_kept(spark, folder), "docs")
    bags = dct.bag_of_words(docs, stage(dct.build_dictionary(docs), "dictionary"))
    return bags.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_tokens"))


def bag_of_words(spark, folder):
    docs = stage(_kept(spark, folder), "docs")
    return dct.bag_of_words(docs, stage(dct.build_dictionary(docs), "dictionary"))


def bigram_counts(spark, folder):
    return phr.pair_counts(_kept(spark, folder))


def phrase_scores(spark, folder):
    model = phr.learn_phrases(_kept(spark, folder))
    return model.phrases.select("a", "b", "n", F.round("score", 6).alias("score"))


def merged_bigrams(spark, folder):
    docs = stage(_kept(spark, folder), "docs")
    return phr.apply_phrases(docs, phr.learn_phrases(docs)).select("doc_id", _joined())


def merged_trigrams(spark, folder):
    docs = cp.phrase_tokens(stage(_kept(spark, folder), "docs"), SETTINGS)
    return docs.select("doc_id", _joined())


def stage_counts(spark, folder):
    return cp.stage_counts(_texts(spark, folder), SETTINGS)


def prepared_documents(spark, folder):
    return cp.prepared_documents(_texts(spark, folder), SETTINGS).select("doc_id", _joined())


def corpus_dictionary(spark, folder):
    return dct.build_dictionary(cp.prepared_documents(_texts(spark, folder), SETTINGS))


def prepared_chunks(spark, folder):
    chunks = cp.prepared_chunks(_texts(spark, folder), SETTINGS)
    return chunks.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), _joined())


# Assignments


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    points = _table(spark, folder, "embeddings")
    return points.select(
        F.col("vec_id").alias("doc_id"), as_doubles(F.col("embedding")).alias("vector"), "label"
    )


def _folded(k: int) -> Column:
    """Entry j of k is the sum of the array's entries j, j + k, j + 2k and so on."""
    entry = f"aggregate(transform(sequence(j, size(vector) - 1, {k}), i -> vector[i]), 0D, (a, x) -> a + x)"
    return F.expr(f"transform(sequence(0, {k - 1}), j -> {entry})").alias("vector")


def _assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of k topics by folding all entries of the arrays."""
    points = _vectors(spark, folder)
    parts = [
        topics.dominant_topics(points.select("doc_id", _folded(k))).withColumn("k", F.lit(k)) for k in TOPIC_COUNTS
    ]
    return reduce(DataFrame.unionByName, parts).select("doc_id", "k", "topic", "prob")


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = topics.wide_assignments(_assignments(spark, folder), TOPIC_COUNTS)
    return _vectors(spark, folder).select("doc_id", "label").join(wide, "doc_id")


def wide_assignments(spark, folder):
    return _wide(spark, folder)


def single_assignment(spark, folder):
    return topics.single_assignment(_wide(spark, folder), 17)


def topic_columns(spark, folder):
    wide = _wide(spark, folder)
    columns = topics.topic_columns(wide.columns)
    counts = [
        wide.groupBy(F.col(name).alias("topic")).agg(F.count("*").alias("n_docs")).withColumn("k", F.lit(k))
        for k, name in columns.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def dominant_topics(spark, folder):
    return topics.dominant_topics(_vectors(spark, folder))


def sparse_topics(spark, folder):
    return topics.sparse_topics(_vectors(spark, folder))


def topic_sizes(spark, folder):
    return topics.topic_sizes(dominant_topics(spark, folder))


def topic_agreement(spark, folder):
    return topics.topic_agreement(_wide(spark, folder), 14, 20)


def topic_trend(spark, folder):
    orders = _table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    return topics.topic_trend(dominant_topics(spark, folder).join(orders, "doc_id"), "o_orderdate")


def topic_agreement_scores(spark, folder):
    scores = agreement.agreement_scores(topic_agreement(spark, folder))
    return scores.select(
        "n_docs",
        F.round("adjusted_rand", 9).alias("adjusted_rand"),
        F.round("normalised_information", 9).alias("normalised_information"),
    )


def topic_matching(spark, folder):
    return agreement.best_matching(topic_agreement(spark, folder))


def topic_trend_test(spark, folder):
    orders = _table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    monthly = topics.topic_trend(dominant_topics(spark, folder).join(orders, "doc_id"), "o_orderdate", "month")
    tested = trends.topic_trend_test(monthly, "month")
    return tested.select(
        "topic", F.col("n_periods").cast("long").alias("n_periods"), "s", F.round("z", 6).alias("z"), "direction",
        F.round("slope", 9).alias("slope"),
    )


# Cluster metrics


def _flawed(spark: SparkSession, folder: str) -> DataFrame:
    """Points of label 9 lose their label, those of label 8 get a NaN."""
    points = _vectors(spark, folder)
    spoiled = F.concat(F.array(F.lit(float("nan"))), F.slice("vector", 2, 63))
    return points.select(
        "doc_id",
        F.when(F.col("label") == 8, spoiled).otherwise(F.col("vector")).alias("vector"),
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).alias("label"),
    )


def valid_points(spark, folder):
    return cm.valid_points(_flawed(spark, folder)).select("doc_id", "label")


def silhouette(spark, folder):
    return cm.silhouette(_vectors(spark, folder)).select(F.round("silhouette", 6).alias("silhouette"))


def silhouette_work(spark, folder):
    return cm.silhouette_work(_vectors(spark, folder))


def davies_bouldin(spark, folder):
    profiles = stage(cm.cluster_profiles(_vectors(spark, folder)), "profiles")
    return cm.davies_bouldin(profiles).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


def calinski_harabasz(spark, folder):
    profiles = cm.cluster_profiles(_vectors(spark, folder))
    return cm.calinski_harabasz(profiles).select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"))


def squared_silhouette(spark, folder):
    score = cm.squared_silhouette(_vectors(spark, folder))
    return spark.createDataFrame([(round(score, 6),)], "silhouette double")


def metric_table(spark, folder):
    points = _flawed(spark, folder)
    rows = [
        cm.metric_row(points.select(_folded(k), "label"), k) for k in TOPIC_COUNTS
    ]
    return cm.metric_report(reduce(DataFrame.unionByName, rows))


# Topic words, coherence, browser


def _language_terms(spark: SparkSession, folder: str) -> DataFrame:
    """``topic, term, weight``: languages as topics, word shares as weights."""
    docs = dox.content_tokens(_texts(spark, folder, "lang"), SETTINGS.stop_words, ("lang",), boilerplate=False)
    tokens = docs.select(
        F.col("lang").alias("topic"), F.explode("tokens").alias("term")
    )
    counts = tokens.groupBy("topic", "term").agg(F.count("*").alias("n"))
    totals = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    return counts.join(totals, "topic").select(
        "topic", "term", (F.col("n") / F.col("total")).alias("weight")
    )


def _language_shares(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Terms with topic numbers, and topic shares from one-hot document vectors."""
    languages = ["de", "en", "es", "fr"]
    terms = stage(_language_terms(spark, folder), "terms").withColumn(
        "topic", F.array_position(F.array(*map(F.lit, languages)), F.col("topic")).cast("int") - 1
    )
    one_hot = F.array(*[(F.col("lang") == name).cast("double") for name in languages])
    vectors = _documents(spark, folder).select("doc_id", one_hot.alias("vector"))
    lengths = _content(spark, folder).select("doc_id", F.size("tokens").alias("n"))
    return terms, stage(br.topic_shares(vectors, lengths), "shares")


def top_words(spark, folder):
    words = topics.top_words(_language_terms(spark, folder))
    return words.select("topic", "rank", "term", F.round("weight", 9).alias("weight"))


def topic_coherence(spark, folder):
    docs = stage(_kept(spark, folder), "docs")
    scores = coh.coherence_by_topic(docs, _language_terms(spark, folder))
    return scores.select("topic", F.round("coherence", 6).alias("coherence"))


def coherence_series(spark, folder):
    docs = stage(_kept(spark, folder), "docs")
    terms = stage(_language_terms(spark, folder), "terms")
    scores = [
        coh.coherence_by_topic(docs, terms.filter(F.col("topic").isin(*names))).withColumn("k", F.lit(k))
        for k, names in ((2, ("de", "en")), (3, ("de", "en", "es")), (4, ("de", "en", "es", "fr")))
    ]
    series = coh.coherence_series(reduce(DataFrame.unionByName, scores))
    return series.select("k", F.round("coherence", 6).alias("coherence"))


def topic_shares(spark, folder):
    _, shares = _language_shares(spark, folder)
    return shares.select("topic", F.round("freq", 6).alias("freq"), F.round("share", 9).alias("share"))


def salient_terms(spark, folder):
    terms, shares = _language_shares(spark, folder)
    best = br.salient_terms(br.term_saliency(terms, shares))
    return best.select("term", F.round("freq", 6).alias("freq"), F.round("saliency", 9).alias("saliency"))


def relevant_terms(spark, folder):
    terms, shares = _language_shares(spark, folder)
    saliency = stage(br.term_saliency(terms, shares), "saliency")
    best = br.relevant_terms(terms, saliency)
    return best.select("topic", "lambda", "rank", "term", F.round("relevance", 6).alias("relevance"))


def topic_distances(spark, folder):
    gaps = br.topic_distances(_language_terms(spark, folder))
    return gaps.select("topic_a", "topic_b", F.round("distance", 9).alias("distance"))


def topic_map(spark, folder):
    return br.topic_map(br.topic_distances(_language_terms(spark, folder)))


# Models. Training is iterative, so the queries named ..._facts give what SQL can know of the same output.

def _corpus(spark: SparkSession, folder: str) -> md.Corpus:
    return md.build_corpus(cp.prepared_documents(_texts(spark, folder), SETTINGS), SETTINGS)


def _trained(corpus: md.Corpus, *counts: int) -> dict[int, LDAModel]:
    return dict(lda.train_sweep(corpus.vectors, counts))


def _corpus_and_model(spark: SparkSession, folder: str) -> tuple[md.Corpus, LDAModel]:
    corpus = _corpus(spark, folder)
    return corpus, _trained(corpus, 14)[14]


def model_fit(spark, folder):
    corpus, model = _corpus_and_model(spark, folder)
    return lda.fit_report(model, corpus.vectors, dct.token_total(corpus.dictionary), 14)


def model_fit_facts(spark, folder):
    fit = model_fit(spark, folder)
    tokens = F.round(-F.col("log_likelihood") / F.col("log_perplexity")).cast("long")
    return fit.select(
        "k", "vocabulary", tokens.alias("n_tokens"), (F.col("log_likelihood") < 0).alias("negative"), (F.col("log_perplexity") > 0).alias("positive")
    )


def model_vectors(spark, folder):
    corpus, model = _corpus_and_model(spark, folder)
    return lda.topic_vectors(model, corpus.vectors)


def model_vectors_facts(spark, folder):
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return model_vectors(spark, folder).select(
        "doc_id", F.size("vector").alias("n_topics"), F.round(total, 6).alias("total")
    )


def _model_words(corpus: md.Corpus, model: LDAModel) -> DataFrame:
    return topics.top_words(stage(lda.topic_terms(model, corpus.dictionary), "terms"))


def model_words(spark, folder):
    return _model_words(*_corpus_and_model(spark, folder))


def model_words_facts(spark, folder):
    corpus, model = _corpus_and_model(spark, folder)
    known = corpus.dictionary.select("term", F.lit(True).alias("in_dictionary"))
    terms = stage(lda.topic_terms(model, corpus.dictionary), "terms")
    total = terms.groupBy("topic").agg(F.round(F.sum("weight"), 6).alias("topic_total"))
    words = topics.top_words(terms).withColumn("before", F.lag("weight").over(Window.partitionBy("topic").orderBy("rank")))
    words = words.join(known, "term", "left").join(total, "topic")
    return words.select(
        "topic",
        "rank",
        F.coalesce("in_dictionary", F.lit(False)).alias("in_dictionary"),
        F.coalesce(F.col("weight") <= F.col("before"), F.col("rank") == 1).alias("falling"),
        "topic_total",
    )


def _saved_and_loaded(spark: SparkSession, corpus: md.Corpus, model: LDAModel) -> LDAModel:
    path, words = staged_path(spark, "model"), dct.vocabulary(corpus.dictionary)
    lda.save_model(model, path, words)
    return lda.load_model(path, words)


def model_saved(spark, folder):
    corpus, model = _corpus_and_model(spark, folder)
    return md.assignments(corpus, _saved_and_loaded(spark, corpus, model), 14)


def model_saved_facts(spark, folder):
    corpus, model = _corpus_and_model(spark, folder)
    after = md.assignments(corpus, _saved_and_loaded(spark, corpus, model), 14)
    after = after.select("doc_id", F.col("topic").alias("topic_after"))
    return md.assignments(corpus, model, 14).join(after, "doc_id").select(
        "doc_id", (F.col("topic") == F.col("topic_after")).alias("same"), F.col("topic").between(-1, 13).alias("in_range")
    )


def model_sweep(spark, folder):
    """Every step for all topic counts, with the assignments next to the documents."""
    run = md.run_models(_corpus(spark, folder), TOPIC_COUNTS)
    return md.with_assignments(_documents(spark, folder).drop("text"), run)


def model_sweep_facts(spark, folder):
    wide = model_sweep(spark, folder)
    return wide.select(
        "doc_id", "lang", "source", *(F.col(f"topic_k{k}").between(-1, k - 1).alias(f"in_range_k{k}") for k in TOPIC_COUNTS)
    )


def model_evaluation(spark, folder):
    corpus = _corpus(spark, folder)
    models = _trained(corpus, *TOPIC_COUNTS)
    parts = [md.assignments(corpus, model, k) for k, model in models.items()]
    wide = topics.wide_assignments(reduce(DataFrame.unionByName, parts), sorted(models))
    return md.evaluate(stage(wide, "wide"), corpus, models)


def model_evaluation_facts(spark, folder):
    return model_evaluation(spark, folder).select("k", F.col("n_docs").cast("long").alias("n_docs"))


def model_heldout(spark, folder):
    """Perplexity of documents that took no part in dictionary and training."""
    docs = cp.prepared_documents(_texts(spark, folder), SETTINGS)
    training, heldout = md.heldout_documents(docs)
    corpus = md.build_corpus(stage(training, "training"), SETTINGS)
    return md.heldout_perplexity(corpus, _trained(corpus, 14)[14], heldout)


def heldout_perplexity(spark, folder):
    """Languages as topics: their word shares, and nine tenths of a document's weight on its own."""
    terms, _ = _language_shares(spark, folder)
    languages = ["de", "en", "es", "fr"]
    weights = F.array(*[F.when(F.col("lang") == name, 0.925).otherwise(0.025) for name in languages])
    thetas = _documents(spark, folder).select("doc_id", weights.alias("vector"))
    _, scored = lda.split_tokens(dox.content_tokens(_texts(spark, folder), SETTINGS.stop_words, boilerplate=False))
    counts = dct.document_token_counts(scored, ("doc_id",)).withColumnRenamed("token", "term")
    report = lda.completion_perplexity(thetas, terms, counts)
    return report.select("n_tokens", F.round("log_likelihood", 3).alias("log_likelihood"), F.round("perplexity", 6).alias("perplexity"))


def _chunk_assignments(spark: SparkSession, folder: str) -> DataFrame:
    chunks = cp.prepared_chunks(_texts(spark, folder), SETTINGS)
    corpus = md.build_corpus(chunks.drop("text"), SETTINGS, ("doc_id", "chunk_no"))
    (model,) = (model for _, model in lda.train_sweep(corpus.vectors, (14,)))
    topic = md.assignments(corpus, model, 14).select("doc_id", "chunk_no", "topic")
    return stage(chunks.select("doc_id", "chunk_no", "text").join(topic, ["doc_id", "chunk_no"]), "chunk-topics")


def chunk_topics(spark, folder):
    """The pieces' texts with their topics."""
    return _chunk_assignments(spark, folder).select("text", "topic")


def chunk_topics_facts(spark, folder):
    return _chunk_assignments(spark, folder).agg(
        F.count("*").alias("n_chunks"), F.sum(F.col("topic").between(-1, 13).cast("long")).alias("n_in_range")
    )


QUERIES = {
    "read_documents": read_documents,
    "read_texts": read_texts,
    "row_count": row_count,
    "preview": preview,
    "write_assignments": write_assignments,
    "write_wide_assignments": write_wide_assignments,
    "write_topic_texts": write_topic_texts,
    "write_metric_csv": write_metric_csv,
    "write_index_csv": write_index_csv,
    "write_topic_lines": write_topic_lines,
    "save_corpus": save_corpus,
    "present_texts": present_texts,
    "original_index": original_index,
    "truncate_text": truncate_text,
    "truncate_text_binding": truncate_text_binding,
    "strip_case_numbers": partial(_cleaned, tx.strip_case_numbers),
    "strip_reporter_cites": partial(_cleaned, tx.strip_reporter_cites),
    "strip_petition_header": partial(_cleaned, tx.strip_petition_header),
    "letters_only": letters_only,
    "word_tokens": word_tokens,
    "content_tokens": content_tokens,
    "conversation_tokens": conversation_tokens,
    "stop_word_use": stop_word_use,
    "enough_tokens": enough_tokens,
    "lemma_tokens": lemma_tokens,
    "inflected_forms": inflected_forms,
    "attested_lemmas": attested_lemmas,
    "lemma_stop_words": lemma_stop_words,
    "user_lemmatiser": user_lemmatiser,
    "user_function": user_function,
    "text_chunks": text_chunks,
    "aligned_documents": aligned_documents,
    "labelled_documents": labelled_documents,
    "alignment_report": alignment_report,
    "alignment_changes": alignment_changes,
    "index_map": index_map,
    "token_counts": token_counts,
    "top_tokens": top_tokens,
    "without_top_tokens": without_top_tokens,
    "document_frequency": document_frequency,
    "dictionary": dictionary,
    "dictionary_keep_terms": dictionary_keep_terms,
    "dictionary_size": dictionary_size,
    "known_tokens": known_tokens,
    "bag_of_words": bag_of_words,
    "bigram_counts": bigram_counts,
    "phrase_scores": phrase_scores,
    "merged_bigrams": merged_bigrams,
    "merged_trigrams": merged_trigrams,
    "stage_counts": stage_counts,
    "prepared_documents": prepared_documents,
    "corpus_dictionary": corpus_dictionary,
    "prepared_chunks": prepared_chunks,
    "wide_assignments": wide_assignments,
    "single_assignment": single_assignment,
    "topic_columns": topic_columns,
    "dominant_topics": dominant_topics,
    "sparse_topics": sparse_topics,
    "topic_sizes": topic_sizes,
    "topic_agreement": topic_agreement,
    "topic_agreement_scores": topic_agreement_scores,
    "topic_matching": topic_matching,
    "topic_trend": topic_trend,
    "topic_trend_test": topic_trend_test,
    "valid_points": valid_points,
    "silhouette": silhouette,
    "silhouette_work": silhouette_work,
    "davies_bouldin": davies_bouldin,
    "calinski_harabasz": calinski_harabasz,
    "squared_silhouette": squared_silhouette,
    "metric_table": metric_table,
    "top_words": top_words,
    "topic_coherence": topic_coherence,
    "coherence_series": coherence_series,
    "topic_shares": topic_shares,
    "salient_terms": salient_terms,
    "relevant_terms": relevant_terms,
    "topic_distances": topic_distances,
    "topic_map": topic_map,
    "model_fit": model_fit,
    "model_fit_facts": model_fit_facts,
    "model_vectors": model_vectors,
    "model_vectors_facts": model_vectors_facts,
    "model_words": model_words,
    "model_words_facts": model_words_facts,
    "model_saved": model_saved,
    "model_saved_facts": model_saved_facts,
    "model_sweep": model_sweep,
    "model_sweep_facts": model_sweep_facts,
    "model_evaluation": model_evaluation,
    "model_evaluation_facts": model_evaluation_facts,
    "model_heldout": model_heldout,
    "heldout_perplexity": heldout_perplexity,
    "chunk_topics": chunk_topics,
    "chunk_topics_facts": chunk_topics_facts,
}
