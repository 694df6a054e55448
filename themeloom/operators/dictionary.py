"""Corpus counts, dictionary and bag of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.functions.text import without_words
from themeloom.operators.documents import with_row_index
from themeloom.operators.joins import salted_join

# Dictionary bounds and the number of most frequent tokens that chunk runs drop.
NO_BELOW = 20
NO_ABOVE = 0.3
KEEP_TERMS = 100_000
TOP_TOKENS = 50

BROADCAST_TERMS = 1_000_000


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, n``: occurrences over the corpus."""
    return docs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_tokens(docs: DataFrame, n: int = TOP_TOKENS) -> DataFrame:
    """The ``n`` most frequent tokens; equal counts in alphabetical order."""
    return token_counts(docs).orderBy(F.desc("n"), "token").limit(n)


def without_top_tokens(docs: DataFrame, top: DataFrame) -> DataFrame:
    """Drop the tokens of a top list (bounded by its length) from all documents."""
    words = [row.token for row in top.select("token").collect()]
    return docs.withColumn("tokens", without_words("tokens", words))


def document_token_counts(docs: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``doc_id, token, n``: occurrences within each document.

    The tokens of a document are already together, so runs in its sorted tokens give the counts and
    no rows move.
    """
    runs = """transform(array(sort_array(tokens)), s ->
        filter(transform(s, (token, i) -> struct(token, i AS start)),
               run -> NOT get(s, run.start - 1) <=> run.token))[0]"""
    counted = f"""transform(array({runs}), r ->
        transform(r, (run, j) -> struct(
            run.token AS token,
            CAST(coalesce(get(r, j + 1).start, size(tokens)) - run.start AS BIGINT) AS n)))[0]"""
    return docs.select(*key, F.explode(F.expr(counted)).alias("run")).select(*key, "run.token", "run.n")


def term_statistics(docs: DataFrame) -> DataFrame:
    """``term, df, cf``: documents that hold the term, and its occurrences, from one shuffle.

    Each document gives its distinct tokens and then all of them, which needs no sorting.
    """
    lists = docs.select(F.posexplode(F.array(F.array_distinct("tokens"), "tokens")).alias("every", "listed"))
    tokens = lists.select(F.col("every").cast("long").alias("every"), F.explode("listed").alias("term"))
    return tokens.groupBy("term").agg(F.sum(1 - F.col("every")).alias("df"), F.sum("every").alias("cf"))


def pruned_terms(
    statistics: DataFrame, n_docs: int, no_below: int = NO_BELOW, no_above: float = NO_ABOVE
) -> DataFrame:
    """Terms in at least ``no_below`` documents and at most the share ``no_above`` of them."""
    return statistics.filter(F.col("df").between(no_below, int(no_above * n_docs)))


def build_dictionary(
    docs: DataFrame,
    no_below: int = NO_BELOW,
    no_above: float = NO_ABOVE,
    keep_terms: int | None = KEEP_TERMS,
) -> DataFrame:
    """``term_id, term, df, cf``: pruned terms numbered by falling document frequency, then name."""
    terms = pruned_terms(term_statistics(docs), docs.count(), no_below, no_above)
    ranked = with_row_index(terms, [F.desc("df"), F.asc("term")], "term_id")
    if keep_terms is not None:
        ranked = ranked.filter(F.col("term_id") < keep_terms)
    return ranked.select("term_id", "term", "df", "cf")


def bag_of_words(docs: DataFrame, dictionary: DataFrame, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``doc_id, term_id, n``: known terms per document; a document without any has no rows.

    With a dictionary small enough to broadcast, which ``keep_terms`` ensures, nothing is shuffled.
    """
    terms = dictionary.select("term_id", F.col("term").alias("token"))
    counts = document_token_counts(docs, key)
    if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        known = counts.join(F.broadcast(terms), "token")
    else:
        known = salted_join(counts, terms, "token", key)
    return known.select(*key, "term_id", "n")


def vocabulary(dictionary: DataFrame) -> list[str]:
    """Terms in id order. Bounded by ``keep_terms``; it becomes part of the fitted model."""
    rows = dictionary.select("term_id", "term").toPandas().sort_values("term_id")
    return rows["term"].tolist()


def token_total(dictionary: DataFrame) -> int:
    """Occurrences of all dictionary terms in the corpus."""
    return dictionary.agg(F.sum("cf")).first()[0] or 0


def vectoriser(dictionary: DataFrame) -> CountVectorizerModel:
    """A fitted vectoriser whose indices are the dictionary's term ids."""
    return CountVectorizerModel.from_vocabulary(
        vocabulary(dictionary), inputCol="tokens", outputCol="features"
    )


def count_vectors(docs: DataFrame, vectoriser_model: CountVectorizerModel) -> DataFrame:
    """Add sparse count vectors ``features`` without moving rows."""
    return vectoriser_model.transform(docs)
