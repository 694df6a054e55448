"""Document sources. All reads are lazy; Spark prunes columns and pushes the null test down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW_ROWS = 20  # Fixed value: rows of a preview.


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with all its columns."""
    return spark.read.parquet(path)


def read_texts(
    spark: SparkSession,
    path: str,
    text_col: str = "text",
    key: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Key and text of a Parquet table.

    A table with fewer splits than the session has cores is spread over them by key, since cleaning
    text is the costly part. A large table has enough splits and is read without a shuffle.
    The rows per columnar batch are the session's ``spark.sql.parquet.columnarReaderBatchSize``; lower it
    there for very long texts.
    """
    texts = spark.read.parquet(path).select(*key, text_col)
    cores = spark.sparkContext.defaultParallelism
    return texts if texts.rdd.getNumPartitions() >= cores else texts.repartition(cores, *key)


def row_count(rows: DataFrame) -> DataFrame:
    """``rows``: one count, answered from the files' metadata where possible."""
    return rows.agg(F.count("*").alias("rows"))


def preview(rows: DataFrame, n: int = PREVIEW_ROWS, key: str = "doc_id") -> DataFrame:
    """The first ``n`` rows in key order."""
    return rows.orderBy(key).limit(n)
