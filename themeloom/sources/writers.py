"""Sinks. Every sink writes in parallel and replaces its target as a whole."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession

from themeloom.operators.lda import vocabulary_digest


def write_table(rows: DataFrame, path: str) -> None:
    """Wide assignments, or texts with their topic, as Parquet."""
    rows.write.mode("overwrite").parquet(path)


def write_by_topic_count(assignments: DataFrame, path: str) -> None:
    """Long assignments as Parquet with one folder per topic count ``k``."""
    assignments.write.mode("overwrite").partitionBy("k").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Index map or metric table as CSV with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_topic_lines(lines: DataFrame, path: str) -> None:
    """Topic lines as text, in topic order."""
    lines.orderBy("topic").select("line").write.mode("overwrite").text(path)


def save_corpus(
    dictionary: DataFrame, bags: DataFrame, vectoriser: CountVectorizerModel, path: str
) -> None:
    """Dictionary, bag of words and vectoriser under one folder, with a digest of the vocabulary."""
    dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    bags.write.mode("overwrite").parquet(f"{path}/bags")
    vectoriser.write().overwrite().save(f"{path}/vectoriser")
    digest = (len(vectoriser.vocabulary), vocabulary_digest(vectoriser.vocabulary))
    manifest = dictionary.sparkSession.createDataFrame([digest], "words long, digest string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, CountVectorizerModel]:
    """What ``save_corpus`` wrote; raises if dictionary and vectoriser are not those of the manifest."""
    dictionary, vectoriser = spark.read.parquet(f"{path}/dictionary"), CountVectorizerModel.load(f"{path}/vectoriser")
    known = spark.read.schema("words long, digest string").json(f"{path}/manifest").first()
    # as many rows as the vectoriser, which the driver holds anyway
    listed = dictionary.orderBy("term_id").limit(len(vectoriser.vocabulary) + 1)
    terms = [row["term"] for row in listed.select("term").collect()]
    if known is None or not known["digest"] == vocabulary_digest(vectoriser.vocabulary) == vocabulary_digest(terms):
        raise ValueError(f"the parts of {path} belong to different vocabularies")
    return dictionary, spark.read.parquet(f"{path}/bags"), vectoriser
