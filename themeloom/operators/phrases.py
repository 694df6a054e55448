"""Two-word phrases: learn them from adjacent pairs and merge them in token arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from themeloom.functions.text import sql_list
from themeloom.operators.documents import evaluated_once
from themeloom.staging import stage

# Phrase thresholds of the first and the second pass, and the joining character.
BIGRAM_MIN_COUNT = 50
TRIGRAM_MIN_COUNT = 25
THRESHOLD = 10.0
DELIMITER = "_"

IN_PLAN_PHRASES = 5_000
BROADCAST_PHRASES = 2_000_000
# A pair with at least 1/HOT_SHARE of all occurrences is hot, so at most HOT_SHARE pairs are.
HOT_SHARE = 10_000
#: Tokens that a task works on at once, and counted grams that leave it in one batch.
TOKENS_AT_ONCE, GRAM_ROWS = 2_000_000, 200_000


@dataclass(frozen=True)
class PhraseModel:
    """Accepted phrases ``a, b, n, score`` and what is needed to apply them at any size."""

    phrases: DataFrame
    frequent: DataFrame  # every pair a, b, n with n >= min_count, accepted or not
    total_pairs: int
    vocabulary_size: int  # distinct words plus distinct pairs


def adjacent_pairs(tokens: Column) -> Column:
    """Array of structs ``a, b`` for each two neighbours."""
    neighbours = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.zip_with(
        neighbours, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )


def _slices(batch: pa.RecordBatch, position: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose token lists, in that column, hold ``TOKENS_AT_ONCE`` tokens and one list more at most."""
    lengths = pc.fill_null(batch.column(position).value_lengths(), 0).to_numpy().astype(np.int64)
    part = np.cumsum(lengths) // TOKENS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        if start < end:
            yield batch.slice(start, end - start)


def counted_grams(lists: pa.ListArray) -> pa.RecordBatch:
    """``a, b, n`` of the words (``b`` null) and adjacent pairs in some documents' tokens."""
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy())
    inside = np.ones(len(codes) + 1, dtype=bool)
    inside[ends] = False  # no pair reaches from one document into the next
    inside = inside[1 : len(codes)]
    size = max(1, len(words))
    pairs, times = np.unique(codes[:-1][inside] * size + codes[1:][inside], return_counts=True)
    first = np.concatenate([np.arange(len(words)), pairs // size])
    second = np.concatenate([np.zeros(len(words), np.int64), pairs % size])
    alone = np.arange(len(first)) < len(words)
    n = np.concatenate([np.bincount(codes, minlength=len(words)), times])
    columns = [words.take(pa.array(first)), words.take(pa.array(second, mask=alone)), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "n"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """``a, b, n`` over the corpus: words (``b`` null) and adjacent pairs from one scan.

    Tasks count the grams of some million tokens at a time, so a hot pair costs one row for each of
    these. Most pairs are rare and combine no further in a task, so the counts move at once and are added up
    in parts of bounded size, however large a task is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            grams = counted_grams(pa.concat_arrays(held))
            for start in range(0, grams.num_rows, GRAM_ROWS):
                yield grams.slice(start, GRAM_ROWS)

        for part in (part for batch in batches for part in _slices(batch, 0)):
            held.append(part.column(0))
            size += len(part.column(0).flatten())
            if size >= TOKENS_AT_ONCE:
                yield from counted()
                held, size = [], 0
        if held:
            yield from counted()

    grams = docs.select("tokens").mapInArrow(count, "a string, b string, n long")
    return grams.repartition("a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, min_count: int = 1) -> DataFrame:
    """``a, b, n`` of adjacent pairs with at least ``min_count`` occurrences."""
    pairs = docs.select(F.explode(adjacent_pairs(F.col("tokens"))).alias("gram"))
    counts = pairs.groupBy("gram.a", "gram.b").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= min_count)


def learn_phrases(
    docs: DataFrame, min_count: int = BIGRAM_MIN_COUNT, threshold: float = THRESHOLD
) -> PhraseModel:
    """Score each pair by (n_ab - min_count) / (n_a * n_b) * vocabulary size; keep high scores."""
    seen = Observation()
    is_pair = F.col("b").isNotNull()
    counts = gram_counts(docs).observe(
        seen,
        F.count(F.lit(1)).alias("grams"),
        F.coalesce(F.sum(F.when(is_pair, F.col("n"))), F.lit(0)).alias("pairs"),
    )
    # Rare grams only matter through their number: a word of an accepted pair is as frequent as it.
    kept = stage(counts.filter(F.col("n") >= min_count), "gram-counts")
    size, total = seen.get["grams"], seen.get["pairs"]
    frequent = kept.filter(is_pair)
    words = kept.filter(~is_pair)
    score = (F.col("n") - min_count) / (F.col("n_a") * F.col("n_b")) * F.lit(float(size))
    phrases = (
        frequent.join(words.select("a", F.col("n").cast("double").alias("n_a")), "a")
        .join(words.select(F.col("a").alias("b"), F.col("n").cast("double").alias("n_b")), "b")
        .select("a", "b", "n", score.alias("score"))
        .filter(F.col("score") > threshold)
    )
    return PhraseModel(stage(phrases, "phrases"), frequent, total, size)


def apply_phrases(docs: DataFrame, model: PhraseModel, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Merge accepted neighbours from left to right, no token twice, joined by ``_``.

    A small set of phrases becomes part of the plan, a larger one is copied to each executor, and no
    rows move; one that does not fit there is joined.
    """
    # the length says where the first token ends, whatever the tokens hold
    pair = F.concat(F.length("a").cast("string"), F.lit(":"), "a", "b").alias("word")
    size = model.phrases.count()
    if not size:
        return docs
    if size > BROADCAST_PHRASES:
        return _merged(_flagged_by_join(docs, model))
    if size > IN_PLAN_PHRASES:
        return _merged_in_tasks(docs, model.phrases.select("a", "b").toArrow())
    found = model.phrases.select(pair).toArrow()
    next_pair = f"zip_with(tokens, slice(tokens, 2, size(tokens)), (a, b) -> concat(length(a), ':', a, b))"
    accepted = sql_list(sorted(found["word"].to_pylist()))
    flags = F.expr(f"transform({next_pair}, pair -> IF(pair IN ({accepted}), '1', '0'))")
    return _merged(docs.withColumn("_flags", F.array_join(flags, "")))


def merged_lists(lists: pa.ListArray, words: pa.Array, codes: np.ndarray) -> pa.ListArray:
    """Token lists with accepted neighbours merged; ``codes`` are sorted, ``place of a * words + place of b``.

    Of neighbours that all start an accepted pair the first, third and so on are merged with the next one: the
    greedy scan from the left. As in ``_merged``, null tokens go where a document has a phrase.
    """
    flat, lengths = lists.flatten(), pc.fill_null(lists.value_lengths(), 0).to_numpy()
    ends = np.cumsum(lengths)
    known = pc.fill_null(pc.index_in(flat, value_set=words), -1).to_numpy().astype(np.int64)
    may = np.zeros(len(known), dtype=bool)
    may[:-1] = (known[:-1] >= 0) & (known[1:] >= 0)
    may[ends[lengths > 0] - 1] = False
    at = np.flatnonzero(may)
    pairs = known[at] * len(words) + known[at + 1]
    at = at[codes[np.minimum(np.searchsorted(codes, pairs), len(codes) - 1)] == pairs]
    if not len(at):
        return lists
    order = np.arange(len(at))
    begins = np.concatenate([[True], np.diff(at) > 1])
    starts = at[(order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0]
    kept, starting = np.ones(len(known), dtype=bool), np.zeros(len(known), dtype=bool)
    starting[starts] = True
    if flat.null_count:
        touched = np.zeros(len(lengths), dtype=bool)
        touched[np.searchsorted(ends, starts, side="right")] = True
        kept = ~(np.repeat(touched, lengths) & flat.is_null().to_numpy(zero_copy_only=False))
    kept[starts + 1] = False
    joined = pc.binary_join_element_wise(flat.take(pa.array(starts)), flat.take(pa.array(starts + 1)), DELIMITER)
    tokens = pc.replace_with_mask(flat, pa.array(starting), joined).filter(pa.array(kept))
    offsets = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens, mask=lists.is_null())


def _merged_in_tasks(docs: DataFrame, phrases: pa.Table) -> DataFrame:
    """Merge with a copy of the phrases next to each executor, some million tokens at a time."""
    shared = docs.sparkSession.sparkContext.broadcast(phrases.combine_chunks())
    position = docs.columns.index("tokens")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = (shared.value[column].combine_chunks() for column in ("a", "b"))
        words = pc.unique(pa.concat_arrays([a, b]))
        first, second = (pc.index_in(side, value_set=words).to_numpy().astype(np.int64) for side in (a, b))
        codes = np.sort(first * len(words) + second)
        for part in (part for batch in batches for part in _slices(batch, position)):
            columns = list(part.columns)
            columns[position] = merged_lists(columns[position], words, codes)
            yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return docs.mapInArrow(merge, docs.schema)


def _flagged_by_join(docs: DataFrame, model: PhraseModel) -> DataFrame:
    """Add ``_flags``, one character per token: 1 where the token starts an accepted pair.

    Hot pairs, accepted or not, are few by definition and are settled without a shuffle; the pairs
    that do shuffle each hold less than 1/HOT_SHARE of all occurrences.
    """
    hot = model.frequent.filter(F.col("n") * HOT_SHARE >= model.total_pairs).select("a", "b")
    accepted = model.phrases.select("a", "b", F.lit(True).alias("accepted"))
    hot = hot.join(accepted, ["a", "b"], "left").select("a", "b", F.coalesce("accepted", F.lit(False)).alias("hot"))
    names = docs.columns
    # rows may share their key, so each has a number of its own, fixed by writing it
    docs, key = stage(docs.withColumn("_row", F.monotonically_increasing_id()), "phrase-rows"), ("_row",)
    pairs = docs.select(*key, F.posexplode(adjacent_pairs(F.col("tokens"))).alias("pos", "gram"))
    marked = pairs.select(*key, "pos", "gram.a", "gram.b").join(F.broadcast(hot), ["a", "b"], "left")
    hits = (
        marked.filter("hot")
        .select(*key, "pos")
        .unionAll(
            marked.filter("hot is null")
            .join(model.phrases.select("a", "b"), ["a", "b"], "left_semi")
            .select(*key, "pos")
        )
    )
    places = hits.groupBy(*key).agg(F.sort_array(F.collect_list("pos")).alias("_places"))
    gaps = F.transform(
        "_places",
        lambda pos, i: F.concat(
            F.repeat(F.lit("0"), pos - F.coalesce(F.get("_places", i - 1), F.lit(-1)) - 1), F.lit("1")
        ),
    )
    flags = F.rpad(F.coalesce(F.array_join(gaps, ""), F.lit("")), F.size("tokens"), "0")
    return docs.join(places, list(key), "left").select(*names, flags.alias("_flags"))


def _merged(flagged: DataFrame) -> DataFrame:
    """Merge by flags. Replacing each ``1.`` in turn is the greedy, non-overlapping scan: it leaves 1
    where a phrase starts, 2 on its second token and 0 elsewhere.

    Tokens, their successors and their marks are zipped, so each of these arrays is made once per row.
    """
    marks = F.split(F.regexp_replace("_flags", "1.", "12"), "")
    pairs = F.zip_with(
        "tokens", F.slice("tokens", F.lit(2), F.size("tokens")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    joined = F.zip_with(
        pairs,
        marks,
        lambda pair, mark: F.when(mark == "1", F.concat(pair["a"], F.lit(DELIMITER), pair["b"]))
        .when(mark == "2", F.lit(None))
        .otherwise(pair["a"]),
    )
    merged = F.filter(joined, lambda token: token.isNotNull())
    untouched = F.instr("_flags", "1") == 0
    tokens = F.when(untouched, F.col("tokens")).otherwise(merged)
    return evaluated_once(flagged.withColumn("tokens", tokens).drop("_flags"))
