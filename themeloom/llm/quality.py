"""Quality rules: counts of a text, and robust multivariate outliers among them.

Each language and source has its own centre and scatter by the minimum covariance determinant: the mean
and covariance of the 75 % of rows nearest to them. Concentration steps go on from three robust starts
until the determinant falls no more, and the least determinant counts. A step is two grouped aggregations
over the small table of statistics; rows of one group are never brought together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.shared import chained, group_key, hashed_texts
from themeloom.staging import stage

SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
NEAREST = 0.75
#: A group with fewer rows is judged by its language, a language with fewer by all rows.
LEAST_ROWS = 50
#: Share of regular rows that the distance may reject.
REJECTED = 1e-6
#: What is no sign of bad text, any two of them together: characters more per word, symbols per word, lines that
#: repeat, and repeated words in a text of the table's median length.
HARMLESS = (0.2, 0.02, 1.0, 20.0)
#: Share of the whole table's robust deviation that a group's is taken to have at least.
LEAST_SPREAD = 0.25
DIMENSIONS = len(HARMLESS)
#: A step has to lower the logarithm of the determinant by more than this.
LEAST_GAIN = 1e-6
BINS_PER_OCTAVE = 64

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_counts(docs: DataFrame, text: str) -> DataFrame:
    """All columns of ``docs`` but the text, and the counts of each whole text."""
    kept = [name for name in docs.columns if name != text]
    schema = T.StructType([*docs.select(*kept).schema.fields, *T._parse_datatype_string(COUNTS).fields])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol = np.zeros(256, dtype=bool)
        symbol[list(SYMBOLS)] = True
        for batch in batches:
            for part in hashed_texts(batch.column(len(kept)), fold_case=False):
                counts = [
                    np.diff(part.word_bounds()),
                    part.counted(part.inside & ((part.raw & 0xC0) != 0x80)),
                    part.counted(symbol[part.raw]),
                    repeated_lines(part),
                    repeated_words(part),
                ]
                others = [batch.column(i).slice(part.first, part.n_rows) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*others, *(pa.array(c.astype(np.int64)) for c in counts)], schema.names
                )

    return docs.select(*kept, text).mapInArrow(count, schema)


def repeated_lines(part) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line."""
    breaks = np.flatnonzero(part.raw == 10)
    starts = np.union1d(part.bounds[:-1], breaks + 1)
    starts = starts[starts < len(part.raw)]
    # a text that starts where a line ends without a break still starts a line
    stops = np.minimum(np.r_[starts[1:], len(part.raw)], len(part.raw))
    ends_in_break = part.raw[stops - 1] == 10 if len(stops) else np.empty(0, bool)
    words = np.r_[0, np.cumsum(part.inside)]
    full = words[stops] > words[starts]
    starts, stops = starts[full], (stops - ends_in_break)[full]
    rows = np.searchsorted(part.bounds, starts, side="right") - 1
    return _surplus(rows, part.hashes(starts, stops), part.n_rows)


def _surplus(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return np.bincount(rows[order][1:][same], minlength=n_rows)


def repeated_words(part, words: int = WINDOW_WORDS) -> np.ndarray:
    """Per text the words that lie in a window found twice or more in the text."""
    runs = chained(part.words, words)
    at = np.flatnonzero(part.rows[: len(runs)] == part.rows[len(part.rows) - len(runs) :])
    rows, hashes = part.rows[at], runs[at]
    order = np.lexsort((hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(part.words) + 1, dtype=np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + words, -1)
    return np.bincount(part.rows[np.cumsum(cover[:-1]) > 0], minlength=part.n_rows)


def statistics() -> list[Column]:
    """The counts as statistics of comparable spread; short texts lean on a usual text."""
    n = F.col("n_words")
    return [
        (F.col("word_chars") + 500) / (n + 100),
        F.sqrt(F.col("n_symbols") / (n + 20)),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / (n + 100)),
    ]


def chi_square_cdf(x: float, d: int) -> float:
    """Distribution of the squared length of a normal vector of even dimension."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(d // 2))


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, d) < p else (low, middle)
    return high


def floors(shapes: DataFrame) -> tuple[float, ...]:
    """Least standard deviation of each statistic by the rows ``n_words, _x0, ...`` of the whole table.

    Two of the ``HARMLESS`` counts in a text of median length stay below the cutoff, and so does what is small
    against the deviation of all rows. Medians are to a thousandth of a rank.
    """
    x = [f"_x{i}" for i in range(DIMENSIONS)]
    middle = shapes.agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in ["n_words", *x])).first()
    length = float(middle["n_words"] or 0)
    apart = shapes.agg(*(F.percentile_approx(F.abs(F.col(c) - F.lit(middle[c])), 0.5, 1000).alias(c) for c in x)).first()
    chars, symbols, lines, words = HARMLESS
    harmless = (
        chars,
        math.sqrt(symbols * max(1.0, length) / (length + 20)),
        math.log1p(lines),
        math.sqrt(words / (length + 100)),
    )
    bound = math.sqrt(chi_square_quantile(1 - REJECTED, DIMENSIONS) / 2)
    return tuple(max(h / bound, LEAST_SPREAD * 1.4826 * (a or 0.0)) for h, a in zip(harmless, apart, strict=True))


ESTIMATE = "_group string, _start int, _mean array<double>, _inverse array<double>, _log_det double"
_PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def _symmetric(upper) -> np.ndarray:
    out = np.zeros((DIMENSIONS, DIMENSIONS))
    for (i, j), value in zip(_PAIRS, upper, strict=True):
        out[i, j] = out[j, i] = value
    return out


def _estimate(group: str, start: int, mean: np.ndarray, scatter: np.ndarray, log_det: float | None = None) -> tuple:
    """An estimate, rounded so that the order of summing leaves no trace."""
    if log_det is None:
        log_det = np.round(np.linalg.slogdet(scatter)[1], 9)
    return group, start, np.round(mean, 9), np.round(np.linalg.inv(scatter), 6).ravel(), float(log_det)


def starts(n: float, middle, spread, tanh_sums, tanh_products, sign_products, least: np.ndarray):
    """Scatters to start from: deviations alone, and with the correlations of rows pulled in by tanh or onto a sphere."""
    scale = np.sqrt(np.square(1.4826 * np.asarray(spread, float)) + least**2)
    mean = np.asarray(tanh_sums, float) / n
    pulled = _symmetric(tanh_products) / n - np.outer(mean, mean)
    sphere = _symmetric(sign_products) / n
    yield np.diag(scale**2)
    for shape in (pulled, sphere):
        shape = shape * DIMENSIONS / max(np.trace(shape), 1e-9)
        yield shape * np.outer(scale, scale) + np.diag(least**2)


def _distance() -> Column:
    off = [F.col(f"_x{i}") - F.col("_mean")[i] for i in range(DIMENSIONS)]
    return sum(
        (off[i] * off[j] * F.col("_inverse")[i * DIMENSIONS + j] for i in range(DIMENSIONS) for j in range(DIMENSIONS)),
        F.lit(0.0),
    )


def _started(rows: DataFrame, least: np.ndarray) -> DataFrame:
    """The starts of each group."""
    x = [F.col(f"_x{i}") for i in range(DIMENSIONS)]
    middle = rows.groupBy("_group").agg(*(F.percentile_approx(c, 0.5, 1000).alias(f"_m{i}") for i, c in enumerate(x)))
    apart = [F.abs(c - F.col(f"_m{i}")) for i, c in enumerate(x)]
    spread = rows.join(middle, "_group").groupBy("_group").agg(
        F.array(*(F.first(f"_m{i}") for i in range(DIMENSIONS))).alias("_middle"),
        F.array(*(F.percentile_approx(c, 0.5, 1000) for c in apart)).alias("_spread"),
    )
    spread = stage(spread, "quality_spread")
    z = [
        (c - F.col("_middle")[i]) / F.sqrt(F.pow(1.4826 * F.col("_spread")[i], 2) + F.lit(float(least[i] ** 2)))
        for i, c in enumerate(x)
    ]
    scaled = rows.join(spread, "_group").select("_group", "_middle", "_spread", *(c.alias(f"_z{i}") for i, c in enumerate(z)))
    z = [F.col(f"_z{i}") for i in range(DIMENSIONS)]
    tanh = [F.tanh(c) for c in z]
    squared = sum((c * c for c in z), F.lit(0.0))
    sums = scaled.groupBy("_group").agg(
        F.count("*").alias("_n"),
        F.first("_middle").alias("_middle"),
        F.first("_spread").alias("_spread"),
        F.array(*(F.sum(c) for c in tanh)).alias("_tanh"),
        F.array(*(F.sum(tanh[i] * tanh[j]) for i, j in _PAIRS)).alias("_tanh_products"),
        F.array(*(F.sum(F.when(squared > 0, z[i] * z[j] / squared).otherwise(0.0)) for i, j in _PAIRS)).alias("_signs"),
    )

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [
                _estimate(group, number, np.asarray(middle, float), scatter, math.inf)
                for group, n, middle, spread, *moments in frame.itertuples(index=False, name=None)
                for number, scatter in enumerate(starts(n, middle, spread, *moments, least))
            ]
            yield pd.DataFrame(out, columns=["_group", "_start", "_mean", "_inverse", "_log_det"])

    return sums.mapInPandas(make, ESTIMATE)


def _concentrated(rows: DataFrame, estimates: DataFrame, least: np.ndarray) -> DataFrame:
    """The estimates after a step: from the share ``NEAREST`` of a group's rows that are nearest by each."""
    x = [F.col(f"_x{i}") for i in range(DIMENSIONS)]
    level = F.floor(F.log2(F.greatest(_distance(), F.lit(2.0**-20))) * BINS_PER_OCTAVE)
    at = rows.join(estimates, "_group").select("_group", "_start", *x, level.alias("_level"))
    counts = at.groupBy("_group", "_start", "_level").agg(F.count("*").alias("_n"))
    of_one = Window.partitionBy("_group", "_start")
    counts = counts.withColumn("_up_to", F.sum("_n").over(of_one.orderBy("_level"))).withColumn("_all", F.sum("_n").over(of_one))
    limits = counts.where(F.col("_up_to") - F.col("_n") < NEAREST * F.col("_all")).groupBy("_group", "_start")
    limits = limits.agg(F.max("_level").alias("_limit"))
    sums = (
        at.join(limits, ["_group", "_start"])
        .where("_level <= _limit")
        .groupBy("_group", "_start")
        .agg(
            F.count("*").alias("_n"),
            F.array(*(F.sum(c) for c in x)).alias("_sums"),
            F.array(*(F.sum(x[i] * x[j]) for i, j in _PAIRS)).alias("_products"),
        )
    )
    grow = NEAREST / chi_square_cdf(chi_square_quantile(NEAREST, DIMENSIONS), DIMENSIONS + 2)

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for group, start, n, sums, products in frame.itertuples(index=False, name=None):
                mean = np.asarray(sums, float) / n
                scatter = grow * (_symmetric(products) / n - np.outer(mean, mean)) + np.diag(least**2)
                out.append(_estimate(group, start, mean, scatter))
            yield pd.DataFrame(out, columns=["_group", "_start", "_mean", "_inverse", "_log_det"])

    return sums.mapInPandas(make, ESTIMATE)


def minimum_covariance(rows: DataFrame, least: tuple[float, ...] = (0.05, 0.03, 0.25, 0.05)) -> DataFrame:
    """Estimates ``_group, _mean, _inverse, _log_det`` of the staged rows ``_group, _x0, ...``.

    ``least`` are the floors of the standard deviations. Each start takes steps as long as they lower the
    determinant, which ends since subsets are finitely many; ties of starts go to the first.
    """
    least = np.asarray(least, float)
    going = stage(_concentrated(rows, _started(rows, least), least), "quality_estimates")
    settled = []
    while not going.isEmpty():
        after = _concentrated(rows, going, least).withColumnsRenamed(
            {"_mean": "_new_mean", "_inverse": "_new_inverse", "_log_det": "_new_log_det"}
        )
        after = stage(going.join(after, ["_group", "_start"]), "quality_estimates")
        falls = F.col("_new_log_det") < F.col("_log_det") - LEAST_GAIN
        settled.append(after.where(~falls).select(*going.columns))
        going = after.where(falls).select(
            "_group", "_start", F.col("_new_mean").alias("_mean"), F.col("_new_inverse").alias("_inverse"),
            F.col("_new_log_det").alias("_log_det"),
        )
    ends = going
    for some in settled:
        ends = ends.unionByName(some)
    best = F.min(F.struct("_log_det", "_start", "_mean", "_inverse")).alias("_best")
    return ends.groupBy("_group").agg(best).select("_group", "_best._mean", "_best._inverse", "_best._log_det")


def quality_verdicts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """Counts of each whole text and whether it is kept.

    Returns ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance``. Fewer than 10 words, or more than 20 % of them in repeated windows, fail at once and shape
    no estimate. ``distance`` is the squared Mahalanobis distance.

    Null and empty texts have only zeros and fail. Null languages and sources are groups of their own;
    small groups are judged by their language or by all rows, and if nothing shapes an estimate the
    distance is null and only ``base_failed`` counts. No deviation is taken to be less than ``floors`` finds in
    the whole table. Rows that repeat count each; other columns are not
    read; an empty table gives no rows.
    """
    given = docs.select(F.col(key).alias("_key"), group_key(lang).alias("_lang"), group_key(source).alias("_source"), F.col(text).alias("_text"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = text_counts(given, "_text").withColumn("base_failed", failed)
    rows = stage(counted.select("*", *(c.alias(f"_x{i}") for i, c in enumerate(statistics()))), "quality_counts")
    own = F.concat(F.lit("group "), F.length("_lang"), F.lit(" "), "_lang", "_source")
    levels = F.array(own, F.concat(F.lit("lang "), "_lang"), F.lit("all"))
    shapes = rows.where("NOT base_failed").select(F.explode(levels).alias("_group"), *(f"_x{i}" for i in range(DIMENSIONS)))
    sizes = shapes.groupBy("_group").agg(F.count("*").alias("_size"))
    sizes = stage(sizes, "quality_sizes")
    large = sizes.where(F.col("_size") >= LEAST_ROWS)
    judged = rows.withColumn("_own", own).withColumn("_by_lang", F.concat(F.lit("lang "), "_lang"))
    judged = judged.join(large.select(F.col("_group").alias("_own"), F.lit(True).alias("_own_large")), "_own", "left")
    judged = judged.join(
        large.select(F.col("_group").alias("_by_lang"), F.lit(True).alias("_lang_large")), "_by_lang", "left"
    )
    group = F.when(F.col("_own_large"), F.col("_own")).when(F.col("_lang_large"), F.col("_by_lang")).otherwise("all")
    judged = stage(judged.withColumn("_group", group), "quality_judged")
    wanted = stage(judged.select("_group").distinct(), "quality_groups")
    least = floors(rows.where("NOT base_failed"))
    estimate = stage(
        minimum_covariance(stage(shapes.join(wanted, "_group", "left_semi"), "quality_shaping"), least), "quality_estimate"
    )
    cutoff = chi_square_quantile(1 - REJECTED, DIMENSIONS)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return (
        judged.join(estimate, "_group", "left")
        .withColumn("distance", _distance())
        .select(
            F.col("_key").alias(key),
            *names,
            (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
            "distance",
        )
    )
