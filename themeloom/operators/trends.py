"""Whether topics rise or fall over time: shares per period, a rank test and a robust slope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNIFICANT = 1.96  # Fixed value: bound of the standard normal distribution for two sides of 5 %.


def topic_shares_by_period(trend: DataFrame, unit: str = "year") -> DataFrame:
    """``topic, place, period, n_docs, share`` with a row for each topic and period from the first to the last.

    ``trend`` holds ``period, topic, n_docs`` (``topics.topic_trend``). Periods in which a topic has no
    document count 0, and so do those without any document at all. Rows without a period are left out.
    """
    known = trend.where("period IS NOT NULL").groupBy("period", "topic").agg(F.sum("n_docs").alias("n_docs"))
    span = known.agg(F.min("period").alias("first"), F.max("period").alias("last")).first()
    periods = F.sequence(F.lit(span["first"]), F.lit(span["last"]), F.expr(f"INTERVAL 1 {unit}"))
    if span["first"] is None:
        periods = F.array().cast("array<date>")
    spine = known.select("topic").distinct().select("topic", F.posexplode(periods).alias("place", "period"))
    totals = known.groupBy("period").agg(F.sum("n_docs").alias("total"))
    n = F.coalesce("n_docs", F.lit(0))
    filled = spine.join(totals, "period", "left").join(
        known.withColumnRenamed("topic", "own").withColumnRenamed("period", "at"),
        F.col("topic").eqNullSafe(F.col("own")) & (F.col("period") == F.col("at")),
        "left",
    )
    share = F.coalesce(n / F.col("total"), F.lit(0.0))
    return filled.select("topic", "place", "period", n.alias("n_docs"), share.alias("share"))


def topic_trend_test(trend: DataFrame, unit: str = "year") -> DataFrame:
    """``topic, n_periods, s, z, direction, slope`` from ``period, topic, n_docs``.

    ``s`` is Mann and Kendall's sum of signs over all pairs of periods, ``z`` its normal score with the
    correction for ties, ``direction`` rising or falling where ``z`` is beyond 5 % on two sides, else steady.
    ``slope`` is Theil and Sen's median change of the share per period, null for one period. Pairs are pairs of
    periods, so their number is set by the calendar and does not grow with the documents.
    """
    shares = topic_shares_by_period(trend, unit)
    ordered = F.array_sort(F.collect_list(F.struct("place", "share")))
    series = shares.groupBy("topic").agg(F.transform(ordered, lambda x: x["share"]).alias("shares"))
    each = series.select("topic", "shares", F.posexplode("shares").alias("i", "own"))
    later = F.slice("shares", F.col("i") + 2, F.size("shares"))
    compared = each.select(
        "topic",
        F.aggregate(later, F.lit(0.0), lambda total, x: total + F.signum(x - F.col("own"))).alias("signs"),
        F.transform(later, lambda x, j: (x - F.col("own")) / (j + 1)).alias("slopes"),
    )
    signs = compared.groupBy("topic").agg(F.sum("signs").cast("long").alias("s"), F.count("*").alias("n_periods"))
    slopes = compared.select("topic", F.explode("slopes").alias("slope")).groupBy("topic").agg(F.median("slope").alias("slope"))
    t = F.col("ties")
    ties = shares.groupBy("topic", "share").agg(F.count("*").alias("ties"))
    ties = ties.groupBy("topic").agg(F.sum(t * (t - 1) * (2 * t + 5)).alias("tied"))
    n = F.col("n_periods")
    deviation = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("tied")) / 18)
    z = F.when(deviation > 0, (F.col("s") - F.signum("s")) / deviation).otherwise(0.0)
    joined = signs.alias("a").join(ties.alias("b"), F.expr("a.topic <=> b.topic")).join(
        slopes.alias("c"), F.expr("a.topic <=> c.topic"), "left"
    )
    return joined.select("a.topic", "n_periods", "s", z.alias("z"), "slope").select(
        "topic",
        "n_periods",
        "s",
        "z",
        F.when(F.col("z") > SIGNIFICANT, "rising").when(F.col("z") < -SIGNIFICANT, "falling").otherwise("steady").alias("direction"),
        "slope",
    )
