"""Mixing sources to target weights by fixed-length blocks of words.

The words of a source, its documents in a seeded order, are cut into blocks of fixed length. The mixture
is a row of slots dealt over output shards: each shard draws its counts per source from a multinomial.
A source's slots are mapped through pseudorandom permutations of its block numbers, one permutation per
pass over the source, and slots and blocks are joined by block number.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.llm.shared import WORD_PATTERN, bucket_bits, freed_worker, group_key, with_running_totals, word_count
from themeloom.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
BLOCK_WORDS = 256
SHARDS = 64
SEED = 17
SLOTS_PER_CHUNK = 1 << 16
ROUNDS = 4


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Words to take per source: ``share`` of all words by weight, no source above ``most`` times its size.

    What is above is shared again by weight among the sources that are below, until none is above.
    """
    total = share * sum(sizes)
    result = [0.0] * len(sizes)
    free = [i for i, size in enumerate(sizes) if size > 0 and weights[i] > 0]
    while free:
        weight = sum(weights[i] for i in free)
        above = [i for i in free if total * weights[i] / weight >= most * sizes[i]]
        if not above:
            for i in free:
                result[i] = total * weights[i] / weight
            break
        for i in above:
            result[i] = float(most * sizes[i])
            total -= result[i]
        free = [i for i in free if i not in set(above)]
    return result


def _mixed(values: np.ndarray, key: int) -> np.ndarray:
    values = (values + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def permuted(index: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Image of each index under a keyed permutation of 0..n-1 (Feistel rounds, walked back into range)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    todo = index.astype(np.uint64)
    open_ = np.arange(len(todo))
    while len(open_):
        left, right = todo[open_] >> shift, todo[open_] & mask
        for i in range(ROUNDS):
            number = ROUNDS - 1 - i if inverse else i
            keyed = (key * 2654435761 + number * 40503 + 1) & 0xFFFFFFFFFFFF
            if inverse:
                left, right = right ^ (_mixed(left, keyed) & mask), left
            else:
                left, right = right, left ^ (_mixed(right, keyed) & mask)
        todo[open_] = (left << shift) | right
        open_ = open_[todo[open_] >= np.uint64(n)]
    return todo.astype(np.int64)


def _key(seed: int, source: int, turn: int) -> int:
    return (seed * 1_000_003 + source) * 131 + turn


def slots_needed(words: int, target: int, block: int, seed: int, source: int) -> tuple[int, int]:
    """Number of slots whose blocks hold ``target`` words, and the words that the last of them takes."""
    n = -(-words // block)
    turns, rest = divmod(target, words) if words else (0, 0)
    if not rest:
        return turns * n, block
    short_size = words - (n - 1) * block
    short = int(permuted(np.array([n - 1]), n, _key(seed, source, turns), inverse=True)[0])
    if rest <= short * block:
        slots = -(-rest // block)
        return turns * n + slots, rest - (slots - 1) * block
    if rest <= short * block + short_size:
        return turns * n + short + 1, rest - short * block
    slots = -(-(rest + block - short_size) // block)
    return turns * n + slots, rest + block - short_size - (slots - 1) * block


def shard_counts(slots: Sequence[int], shards: int, seed: int) -> list[np.ndarray]:
    """Slots per source in each shard: multinomial draws by what the sources still have to give.

    Drawing by the rest keeps every shard near the mixture and makes the totals exact: what a draw takes
    beyond a source's rest is drawn again.
    """
    rng = np.random.default_rng(seed)
    rest = np.array(slots, dtype=np.int64)
    total, drawn = int(rest.sum()), []
    for shard in range(shards):
        wanted = (shard + 1) * total // shards - shard * total // shards
        counts = np.zeros_like(rest)
        while wanted:
            left = rest - counts
            counts = np.minimum(rest, counts + rng.multinomial(wanted, left / left.sum()))
            wanted = (shard + 1) * total // shards - shard * total // shards - int(counts.sum())
        rest -= counts
        drawn.append(counts)
    return drawn


def _slots(spark: SparkSession, plan: list[tuple], seed: int) -> DataFrame:
    """A row per slot of the mixture: shard, source, block, pass over the source, words it may take."""
    schema = "_shard int, _no int, _first long, _count long, _blocks long, _last_slot long, _last_words long"
    chunk = F.explode(F.sequence(F.lit(0), F.expr(f"(_count - 1) div {SLOTS_PER_CHUNK}")))
    chunks = (
        spark.createDataFrame(plan, schema)
        .withColumn("_chunk", chunk)
        .withColumn("_from", F.col("_first") + F.col("_chunk") * SLOTS_PER_CHUNK)
        .withColumn("_to", F.least(F.col("_first") + F.col("_count"), F.col("_from") + SLOTS_PER_CHUNK))
        # a number of its own: a row becomes many slots, which its bytes do not show
        .repartition(max(1, -(-sum(row[3] for row in plan) // SLOTS_PER_CHUNK)), "_shard", "_no", "_chunk")
    )

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        freed_worker()
        for frame in frames:
            for row in frame.to_dict("records"):
                n, no = int(row["_blocks"]), int(row["_no"])
                slot = np.arange(int(row["_from"]), int(row["_to"]), dtype=np.int64)
                turn = slot // n
                block = np.empty_like(slot)
                for t in np.unique(turn):
                    of = turn == t
                    block[of] = permuted(slot[of] - t * n, n, _key(seed, no, int(t)))
                limit = np.where(slot == int(row["_last_slot"]), int(row["_last_words"]), np.int64(2**62))
                columns = {"_no": np.int32(no), "_block": block, "_shard": np.int32(row["_shard"])}
                yield pd.DataFrame(columns | {"_slot": slot, "_pass": turn.astype(np.int32), "_limit": limit})

    return chunks.select("_shard", "_no", "_from", "_to", "_blocks", "_last_slot", "_last_words").mapInPandas(
        spread, "_no int, _block long, _shard int, _slot long, _pass int, _limit long"
    )


@dataclass
class Mixture:
    """``rows``: ``_row, _no, _start, _size, _target``; ``pieces``: ``_row, _start, _shard, _slot, _pass, _from, _words``."""

    rows: DataFrame
    pieces: DataFrame


def mixture(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    block_words: int = BLOCK_WORDS,
    shards: int = SHARDS,
    seed: int = SEED,
) -> Mixture:
    """Plan the mixture of staged ``rows`` with columns ``_row, _hash, _source, _size``.

    Sources by code point, null last, get the weights in turn. The table of sources, one row each, goes
    through the driver, as do ``shards`` counts for each. A piece is what one slot takes of one row:
    ``_words`` words from word ``_from`` on. A row is taken at most twice.
    """
    spark = rows.sparkSession
    by_source = rows.groupBy("_source").agg(F.sum("_size").alias("words")).collect()
    by_source.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    sizes = [int(r["words"]) for r in by_source]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, MOST_PASSES)
    needed = [
        slots_needed(size, min(round(target), MOST_PASSES * size), block_words, seed, no)
        for no, (size, target) in enumerate(zip(sizes, wanted, strict=True))
    ]
    plan, first = [], [0] * len(sizes)
    for shard, counts in enumerate(shard_counts([slots for slots, _ in needed], shards, seed)):
        for no, count in enumerate(int(c) for c in counts):
            if count:
                n_blocks = -(-sizes[no] // block_words)
                slots, last_words = needed[no]
                plan.append((shard, no, first[no], count, n_blocks, slots - 1, last_words))
                first[no] += count
    numbers = spark.createDataFrame(
        [(r["_source"], no, sizes[no], wanted[no]) for no, r in enumerate(by_source)],
        "_source string, _no int, _source_size long, _target double",
    ).select(group_key("_source").alias("_group"), "_no", "_source_size", "_target")
    bits = bucket_bits(rows.count())
    keyed = rows.withColumn("_group", group_key("_source")).withColumn(
        "_bucket", F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long")
    )
    order = [F.col("_hash").bitwiseXOR(F.lit(-(2**63))), F.col("_row")]
    placed = with_running_totals(keyed, ["_group"], "_bucket", order, {"_start": F.col("_size")})
    placed = stage(
        placed.join(numbers, "_group").select("_row", "_no", "_start", "_size", "_source_size", "_target"),
        "mixing_rows",
    )
    last = F.expr(f"(_start + _size - 1) div {block_words}")
    touched = placed.where("_size > 0").withColumn(
        "_block", F.explode(F.sequence(F.expr(f"_start div {block_words}"), last))
    )
    begin = F.greatest(F.col("_start"), F.col("_block") * block_words)
    end = F.least(
        F.col("_start") + F.col("_size"), F.col("_block") * block_words + F.least(F.lit(block_words), F.col("_limit"))
    )
    pieces = (
        # the size Spark expects of rows made in Python is far too low to broadcast by
        touched.join(_slots(spark, plan, seed).hint("merge"), ["_no", "_block"])
        .select("_row", "_shard", "_slot", "_pass", (begin - F.col("_start")).alias("_from"), (end - begin).alias("_words"))
        .where("_words > 0")
    )
    return Mixture(placed, pieces)


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """How much of each row the mixture takes: ``key, size, source_size, target, taken``, all in words.

    Settings are those of ``mixture``. Null and empty texts have size 0 and are never taken; a null source
    is a source of its own; rows that agree in every way are told apart by their place in the staged
    table. An empty table gives no rows. Other columns are not read. Reruns on equal tables agree up to
    rows that are wholly equal.
    """
    plain = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), word_count(text).alias("_size"),
        F.xxhash64(F.lit(settings.get("seed", SEED)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text)).alias("_hash"),
    )
    rows = stage(plain.withColumn("_row", F.monotonically_increasing_id()), "mixing_input")
    mix = mixture(rows.select("_row", "_hash", "_source", "_size"), **settings)
    zero = mix.rows.select("_row", F.lit(0).cast("long").alias("_words"))
    taken = zero.unionByName(mix.pieces.select("_row", "_words")).groupBy("_row").agg(F.sum("_words").alias("taken"))
    return (
        rows.select("_row", F.col("_key").alias(key), F.col("_size").alias("size"))
        .join(mix.rows.select("_row", F.col("_source_size").alias("source_size"), F.col("_target").alias("target")), "_row")
        .join(taken, "_row")
        .drop("_row")
    )


def mixed_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **settings
) -> DataFrame:
    """The mixture as documents: one row per input row and pass over its source, with all input columns.

    ``text`` holds the words that the pass takes of the row, with the white space between them; a row
    that a pass takes whole keeps its text exactly, one taken twice comes twice, and one not taken is
    left out. Null texts, rows without words and empty tables behave as in ``mixed_rows``: no words, not
    in the mixture.
    """
    names = docs.columns
    whole_row = F.struct(*(F.col(f"`{name}`") for name in names)).alias("_doc")
    staged = stage(docs.select(whole_row, F.monotonically_increasing_id().alias("_row")), "mixing_documents")
    words, wanted = F.col(f"_doc.{text}"), F.col(f"_doc.{key}")
    rows = staged.select(
        "_row", F.col(f"_doc.{source}").alias("_source"), word_count(words).alias("_size"),
        F.xxhash64(F.lit(settings.get("seed", SEED)), F.coalesce(wanted.cast("string"), F.lit("")), words).alias("_hash"),
    )
    mix = mixture(stage(rows, "mixing_input"), **settings)
    spans = F.sort_array(F.collect_list(F.struct("_from", "_words")))
    taken = mix.pieces.groupBy("_row", "_pass").agg(spans.alias("_spans"), F.sum("_words").alias("_taken"))
    joined = staged.join(taken, "_row")
    whole = F.col("_taken") == word_count(words)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_words(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    part = cut(F.when(~whole, words), F.when(~whole, F.col("_spans")))
    return joined.withColumn("_text", F.when(whole, words).otherwise(part)).select(
        *(F.col("_text").alias(name) if name == text else F.col(f"_doc.`{name}`").alias(name) for name in names)
    )


def cut_words(text: str, spans) -> str:
    """The words ``[from, from + words)`` of each span, neighbouring spans joined as in the text."""
    places = [match.span() for match in WORD_PATTERN.finditer(text)]
    merged: list[list[int]] = []
    for span in spans:
        start, words = int(span["_from"]), int(span["_words"])
        if merged and merged[-1][1] == start:
            merged[-1][1] = start + words
        else:
            merged.append([start, start + words])
    return "\n".join(text[places[a][0] : places[b - 1][1]] for a, b in merged)
