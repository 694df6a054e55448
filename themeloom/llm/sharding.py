"""Proportional stratified interleaving: every shard holds the sources in their overall shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.shared import bucket_bits, group_key, text_or_empty, with_running_totals
from themeloom.staging import stage

SEED = "interleave"


def interleaved_shards(
    docs: DataFrame,
    n_shards: int = 16,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """Deal rows into shards whose row counts differ by at most one and whose mixture is the whole's.

    Rows of a source are ranked by a seeded hash of key and text; row r of n gets the fraction
    (2r - 1) / 2n. All rows in order of fraction, cut into equal runs, are the shards. Returns ``key,
    source, size`` (UTF-8 bytes plus 1), ``text_crc32, shard, slot`` (place in the shard from 0).

    Null texts count as empty, null sources are a source of their own, null keys are hashed as empty.
    Rows that agree in key and text are interchangeable and each keeps a slot. Other columns are not
    read, an empty table gives no rows, and with fewer rows than shards some shards stay empty.
    """
    given = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), text_or_empty(text).alias("_text")
    )
    rows = stage(
        given.select(
            "_key",
            "_source",
            group_key("_source").alias("_group"),
            (F.octet_length("_text").cast("long") + 1).alias("_size"),
            F.crc32(F.col("_text").cast("binary")).alias("_crc"),
            F.md5(
                F.concat(
                    F.lit(f"{seed}:"),
                    F.coalesce(F.col("_key").cast("string"), F.lit("")),
                    F.lit(":"),
                    "_text",
                ).cast("binary")
            ).alias("_hash"),
        ),
        "sharding_rows",
    )
    total = rows.count()
    bits = bucket_bits(total)
    high_bits = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    order = [F.col("_hash"), F.col("_key"), F.col("_source")]
    ranked = with_running_totals(
        rows.withColumn("_bucket", F.shiftright(high_bits, 32 - bits)),
        ["_group"],
        "_bucket",
        order,
        {"_earlier": F.lit(1)},
    )
    sizes = rows.groupBy("_group").agg(F.count("*").alias("_rows"))
    fraction = (2 * F.col("_earlier") + 1).cast("double") / (2 * F.col("_rows")).cast("double")
    placed = stage(ranked.join(sizes, "_group").withColumn("_fraction", fraction), "sharding_fractions")
    dealt = with_running_totals(
        placed.withColumn("_bucket", F.floor(F.col("_fraction") * (1 << bits)).cast("long")).withColumn(
            "_all", F.lit(0)
        ),
        ["_all"],
        "_bucket",
        [F.col("_fraction"), F.col("_source").asc_nulls_last(), *order],
        {"_place": F.lit(1)},
    )
    shard = F.expr(f"_place * {n_shards} div {max(1, total)}")
    return dealt.withColumn("_shard", shard).select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"_place - (_shard * {total} + {n_shards - 1}) div {n_shards}").alias("slot"),
    )
