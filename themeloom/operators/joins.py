"""Looking words up in tables: next to each executor while they fit, by shuffle beyond that."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.staging import stage

SALTS = 32
#: A value with more than 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE values are.
HOT_SHARE = 10_000


def salted_join(
    rows: DataFrame, table: DataFrame, on: str, spread: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Shuffle join in which one value of ``on`` may hold a large share of ``rows``.

    Rows of one value are spread over ``SALTS`` tasks by the columns ``spread``; the table, which has
    one row per value, is repeated once per salt.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [on, "_salt"], how).drop("_salt")


def hot_values(rows: DataFrame, on: str) -> DataFrame:
    """``on, _hot`` of the values that hold a large share of ``rows``."""
    counts = stage(rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")), "join-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    return counts.where(F.col("_n") * HOT_SHARE > total).select(on, F.lit(True).alias("_hot"))


def with_hot_salts(table: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    """The rows of hot values once per salt, the others with salt 0."""
    salts = F.sequence(F.lit(0), F.when(F.col("_hot").isNotNull(), SALTS - 1).otherwise(0))
    return table.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts)).drop("_hot")


def hot_salted_join(rows: DataFrame, table: DataFrame, on: str, spread: Sequence[str]) -> DataFrame:
    """Inner join as ``salted_join`` does it, for a large table: only its hot values are repeated.

    ``rows`` are read twice, first to count their values.
    """
    hot = hot_values(rows, on)
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    marked = rows.join(F.broadcast(hot), on, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot").isNotNull(), salt).otherwise(0)).drop("_hot")
    return salted.join(with_hot_salts(table, hot, on), [on, "_salt"]).drop("_salt")


def looked_up(docs: DataFrame, words: str, table: pa.Table, name: str) -> DataFrame:
    """Add an array column: for each entry of the array ``words`` its value in ``table``, or null.

    ``table`` has string columns ``word, value``, one row per word, and a size the caller has
    checked. Every executor gets one copy; whole Arrow batches are looked up at once and no row moves.
    """
    shared = docs.sparkSession.sparkContext.broadcast(table.combine_chunks())
    position = docs.columns.index(words)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = (shared.value[column].combine_chunks() for column in ("word", "value"))
        for batch in batches:
            lists = batch.column(position)
            hits = pc.take(values, pc.index_in(lists.flatten(), value_set=known))
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            found = pa.ListArray.from_arrays(offsets, hits)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.StringType()))])
    return docs.mapInArrow(look_up, schema)
