"""From documents to a token corpus with its dictionary."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.stopwords import default_stop_words
from themeloom.functions.text import CHUNK_WORDS, MIN_TOKENS, words_of, without_words
from themeloom.operators import dictionary as dct
from themeloom.operators import phrases as phr
from themeloom.operators.documents import chunked, content_tokens, evaluated_once, present_texts, with_enough_tokens
from themeloom.operators.inflection import attested_lemmas
from themeloom.staging import stage, stage_only


@dataclass(frozen=True)
class CorpusSettings:
    """Parameters of a corpus run; the defaults are those of the documented method."""

    stop_words: Sequence[str] = field(default_factory=default_stop_words)
    min_tokens: int = MIN_TOKENS
    max_chars: int | None = None
    bigram_min_count: int = phr.BIGRAM_MIN_COUNT
    trigram_min_count: int = phr.TRIGRAM_MIN_COUNT
    threshold: float = phr.THRESHOLD
    filter_after_phrases: bool = False  # also drop stop phrases such as ``foo_bar``
    no_below: int = dct.NO_BELOW
    no_above: float = dct.NO_ABOVE
    keep_terms: int | None = dct.KEEP_TERMS
    lemmatise: Callable[[DataFrame], DataFrame] = attested_lemmas


def lemma_tokens(docs: DataFrame, settings: CorpusSettings) -> DataFrame:
    """Lemmas without stop words; a lemma may itself be a stop word."""
    lemmas = settings.lemmatise(docs)
    return evaluated_once(lemmas.withColumn("tokens", without_words("tokens", settings.stop_words)))


def phrase_tokens(
    docs: DataFrame, settings: CorpusSettings, key: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Merge phrases twice; the second pass sees the merged words and finds longer phrases.

    ``docs`` should be a staged table: it is read once to learn the first pass and once to apply it. What
    that gives is staged, so that the second pass does not merge again.
    """
    return longer_phrase_tokens(stage(first_phrase_tokens(docs, settings, key), "bigrams"), settings, key)


def first_phrase_tokens(docs: DataFrame, settings: CorpusSettings, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The first pass of ``phrase_tokens``."""
    return phr.apply_phrases(docs, phr.learn_phrases(docs, settings.bigram_min_count, settings.threshold), key)


def longer_phrase_tokens(docs: DataFrame, settings: CorpusSettings, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The second pass of ``phrase_tokens`` over what the first one gave, staged."""
    docs = phr.apply_phrases(docs, phr.learn_phrases(docs, settings.trigram_min_count, settings.threshold), key)
    if settings.filter_after_phrases:
        docs = docs.withColumn("tokens", without_words("tokens", settings.stop_words))
    return docs


def prepared_documents(documents: DataFrame, settings: CorpusSettings | None = None) -> DataFrame:
    """``doc_id, tokens`` after all steps and the three token-count filters, staged.

    Each step's table is deleted when the next one is staged.
    """
    settings = settings or CorpusSettings()

    def lemmas() -> DataFrame:
        docs = content_tokens(documents, settings.stop_words, max_chars=settings.max_chars)
        docs = with_enough_tokens(docs, settings.min_tokens)
        return with_enough_tokens(lemma_tokens(docs, settings), settings.min_tokens)

    def bigrams() -> DataFrame:
        return first_phrase_tokens(stage_only(lemmas, "lemmas"), settings)

    def merged() -> DataFrame:
        docs = longer_phrase_tokens(stage_only(bigrams, "bigrams"), settings)
        return with_enough_tokens(docs, settings.min_tokens)

    return stage_only(merged, "documents")


def stage_counts(documents: DataFrame, settings: CorpusSettings | None = None) -> DataFrame:
    """``stage, n_docs``: documents left after each filter."""
    settings = settings or CorpusSettings()
    tokens = content_tokens(documents, settings.stop_words, max_chars=settings.max_chars)
    lemmas = stage(
        with_enough_tokens(tokens, settings.min_tokens).transform(lemma_tokens, settings), "lemmas"
    )
    kept = with_enough_tokens(lemmas, settings.min_tokens)
    final = with_enough_tokens(phrase_tokens(kept, settings), settings.min_tokens)
    counted = [("read", present_texts(documents)), ("tokens", lemmas), ("lemmas", kept), ("phrases", final)]
    rows = [docs.agg(F.lit(name).alias("stage"), F.count("*").alias("n_docs")) for name, docs in counted]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3])


def prepared_chunks(
    documents: DataFrame,
    settings: CorpusSettings | None = None,
    words_per_chunk: int = CHUNK_WORDS,
    top: int = dct.TOP_TOKENS,
) -> DataFrame:
    """``doc_id, chunk_no, text, tokens``: the variant that models pieces of each text.

    The most frequent tokens of the corpus join the stop words, then the length bounds, the stop
    words and the lemmas are applied a second time. No filter follows the phrases.

    The text goes along in the staged tables, which phrase passes do not read. Each step's table is deleted when the
    next one is staged.
    """
    settings = settings or CorpusSettings()
    key = ("doc_id", "chunk_no")

    def lemmas() -> DataFrame:
        docs = content_tokens(chunked(documents, words_per_chunk), settings.stop_words, (*key, "text"))
        return with_enough_tokens(lemma_tokens(docs, settings), settings.min_tokens)

    def lemmas_again() -> DataFrame:
        nonlocal settings  # from here on, phrases included
        docs = stage_only(lemmas, "chunk-lemmas")
        stop_words = [*settings.stop_words, *[row.token for row in dct.top_tokens(docs, top).collect()]]
        settings = replace(settings, stop_words=stop_words)
        again = docs.withColumn("tokens", words_of(F.array_join("tokens", " "))).withColumn(
            "tokens", without_words("tokens", stop_words)
        )
        return with_enough_tokens(lemma_tokens(again, settings), settings.min_tokens)

    def bigrams() -> DataFrame:
        docs = stage_only(lemmas_again, "chunk-tokens")
        return first_phrase_tokens(docs, settings, key)

    def merged() -> DataFrame:
        docs = stage_only(bigrams, "bigrams")
        return longer_phrase_tokens(docs, settings, key).select(*key, "text", "tokens")

    return stage_only(merged, "chunks")
