"""From document rows to filtered token rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions import text as tx
from themeloom.staging import stage


def present_texts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents with a text, as strings. The null test reaches the Parquet scan."""
    present = documents.filter(F.col(text_col).isNotNull())
    return present.withColumn(text_col, F.col(text_col).cast("string"))


def evaluated_once(docs: DataFrame) -> DataFrame:
    """The same rows, with ``tokens`` computed one time.

    The optimizer moves a filter on a computed column below its projection and so repeats the
    computation, twice per chained filter. It does not move filters below a generator.
    """
    others = [name for name in docs.columns if name != "tokens"]
    return docs.select(*others, F.explode(F.array("tokens")).alias("tokens"))


def content_tokens(
    documents: DataFrame,
    stop_words: Sequence[str],
    key: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    max_chars: int | None = None,
    boilerplate: bool = True,
) -> DataFrame:
    """``key, tokens``: cleaned words without stop words.

    Put columns to carry along into ``key``; they stay aligned with the tokens without a join.
    The whole text is read. ``max_chars`` cuts each text first, for results that must match an
    engine with such a limit.
    """
    text = F.col(text_col)
    if max_chars is not None:
        text = tx.truncate_text(text, max_chars)
    if boilerplate:
        text = tx.clean_boilerplate(text)
    words = present_texts(documents, text_col).select(*key, tx.words_of(text).alias("tokens"))
    return evaluated_once(words.withColumn("tokens", tx.without_words("tokens", stop_words)))


def with_enough_tokens(docs: DataFrame, minimum: int = tx.MIN_TOKENS) -> DataFrame:
    return docs.filter(tx.has_enough_tokens(F.col("tokens"), minimum))


def chunked(
    documents: DataFrame, words_per_chunk: int = tx.CHUNK_WORDS, text_col: str = "text"
) -> DataFrame:
    """``doc_id, chunk_no, text``: consecutive pieces of each text."""
    return present_texts(documents, text_col).select(
        "doc_id", F.posexplode(tx.text_chunks(F.col(text_col), words_per_chunk)).alias("chunk_no", "text")
    )


def with_row_index(rows: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Add the 0-based position of each row in a total order, without a single-task window.

    Rows are range-partitioned, staged so that the partition numbers cannot change, numbered within
    their range, and shifted by the count of all earlier ranges. Pass only the columns needed.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = stage(ranged, "row-index")
    # One row per range: as small as the number of partitions, whatever the number of rows.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count("*").alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy("_range").orderBy(*order)
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.row_number().over(within) - 1 + F.col("_offset")).cast("long"))
        .drop("_range", "_offset")
    )


def original_index(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``doc_id, original_index`` over the documents that have a text.

    The keys are staged first: range partitioning looks at its input twice, the texts are read once.
    """
    keys = stage(present_texts(documents, text_col).select("doc_id"), "keys")
    return with_row_index(keys, ["doc_id"], "original_index")


def index_map(indexed: DataFrame, survivors: DataFrame) -> DataFrame:
    """``doc_id, original_index, final_index`` for the documents that passed all filters."""
    kept = indexed.join(survivors.select("doc_id"), "doc_id", "left_semi")
    return with_row_index(kept, ["doc_id"], "final_index")


def content_hash(columns: Sequence[str]) -> Column:
    """A hash of a row's columns that tells a null from every value and one column from another."""
    if not columns:
        return F.lit(0).cast("long")
    return F.xxhash64(*(part for name in columns for part in (F.col(name), F.col(name).isNull())))


def alignment_report(
    left: DataFrame, right: DataFrame, key: Sequence[str] = ("doc_id",), content: Sequence[str] = ()
) -> DataFrame:
    """One row of counts that shows whether two tables hold the same documents once each.

    With ``content``, columns of both tables, ``changed`` counts the keys that both hold equally often but
    with other contents. Contents are compared by the sum and the exclusive or of row hashes, whatever the
    order of rows, so that no text is shuffled.
    """
    zero = F.lit(0).cast("long")
    digest = content_hash(content)
    sides = left.select(*key, F.lit(1).alias("l"), F.lit(0).alias("r"), digest.alias("lh"), zero.alias("rh")).unionAll(
        right.select(*key, F.lit(0).alias("l"), F.lit(1).alias("r"), zero.alias("lh"), digest.alias("rh"))
    )
    per_key = sides.groupBy(*key).agg(
        F.sum("l").alias("l"),
        F.sum("r").alias("r"),
        F.sum((F.col("lh").cast("decimal(38,0)") - F.col("rh").cast("decimal(38,0)"))).alias("apart"),
        F.bit_xor(F.col("lh").bitwiseXOR(F.col("rh"))).alias("mixed"),
    )
    both = (F.col("l") > 0) & (F.col("l") == F.col("r"))
    return per_key.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows"),
        F.count("*").alias("distinct_keys"),
        F.count_if((F.col("l") > 0) & (F.col("r") == 0)).alias("missing_right"),
        F.count_if((F.col("l") == 0) & (F.col("r") > 0)).alias("missing_left"),
        F.count_if((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated_keys"),
        F.count_if(both & ((F.col("apart") != 0) | (F.col("mixed") != 0))).alias("changed"),
    )


def require_alignment(
    left: DataFrame, right: DataFrame, key: Sequence[str] = ("doc_id",), content: Sequence[str] = ()
) -> None:
    """Raise when two tables do not hold the same documents once each, with the same ``content``."""
    row = alignment_report(left, right, key, content).first()
    if row.missing_left or row.missing_right or row.repeated_keys or row.changed:
        raise ValueError(f"tables are not aligned on {', '.join(key)}: {row.asDict()}")
