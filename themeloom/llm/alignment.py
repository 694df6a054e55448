"""Two tokenizers' tokens of one text, aligned by the bytes they cover.

The tokens of both are intervals of bytes. Sorted by start, with the running maximum of their ends, a group
ends where a start reaches that maximum; inside a group every token is expanded over the tokens of the other
tokenizer that it overlaps. Both tokenizers end a token wherever a new word follows a single space, so what
stands between such spaces is encoded and aligned once for many texts. How often two ids are linked in the
whole corpus is counted in a first pass. The second pass puts the counts to the documents in two parts: the
frequent pairs, of which there is a bounded number, are looked up in the tasks, the rest is joined by shuffle.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm.shared import kept_in_worker, text_slices
from themeloom.staging import stage

BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
#: Pairs of ids looked up in the tasks at most: two arrays of 8 bytes and one of 1 a pair.
LOOKED_UP = 1_000_000
#: Where both tokenizers begin anew: a single space between other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
WIDE = re.compile(r"\s\s")
#: Documents are worked on together until they have so many distinct words or so many words.
WORDS_AT_ONCE = 500_000
PLACES_AT_ONCE = 1 << 23
#: Words that are encoded and aligned together.
ALIGNED_AT_ONCE = 1 << 15


def cut_words(text: str) -> list[str]:
    """What stands between single spaces; a text without wider white space is cut at every space."""
    if WIDE.search(text) or text[:1].isspace() or text[-1:].isspace():
        return CUT.split(text)
    return text.split(" ")


def byte_level_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in the entries of a byte-level vocabulary.

    Printable bytes stand for themselves, the others for the characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteTokenizer:
    """Ids of texts by the byte-level vocabulary in a tokenizer file.

    Where each merge makes the next id, as in the given file, ids are ranks and the vocabulary serves the
    rank encoder, which gives the same ids in a quarter of the time; any other file is read as it is.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        alphabet, vocabulary = byte_level_alphabet(), model["vocab"]
        ranks = {bytes(alphabet[c] for c in entry): i for entry, i in vocabulary.items() if set(entry) <= alphabet.keys()}
        merged = ["".join(merge.split(" ") if isinstance(merge, str) else merge) for merge in model["merges"]]
        ids = [vocabulary[entry] for entry in merged]
        self.plain, self.ranked = None, None
        if ids == list(range(len(alphabet), len(alphabet) + len(ids))) and len(ranks) == len(alphabet) + len(ids):
            self.ranked = tiktoken.Encoding(
                "ranks of a file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.encode_special_tokens = True
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; the strings of special tokens are ordinary text."""
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(text) for text in texts]
        return [e.ids for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]


class TwoTokenizers:
    """Ids of a text by both tokenizers, and the bytes of each id."""

    def __init__(self, byte_path: str, piece_path: str):
        self.byte = ByteTokenizer(byte_path)
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.piece_tokens = [self._piece_bytes(i) for i in range(self.piece.get_piece_size())]
        self._sizes = tuple(np.array([len(t) for t in tokens], np.int64) for tokens in (self.byte.tokens, self.piece_tokens))

    def _piece_bytes(self, i: int) -> bytes:
        piece = self.piece.id_to_piece(i)
        if self.piece.is_byte(i):
            return bytes((int(piece[3:5], 16),))
        return piece.replace("▁", " ").encode()

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each id of either tokenizer."""
        return self._sizes

    def encoded(self, words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For both, the ids of the words behind a space in turn and how many each has; which words are whole.

        A word is whole if both give it back byte for byte; the others have no ids.
        """
        raw = [f" {word}" for word in words]
        sides = self.byte.encoded(raw), self.piece.encode(words, num_threads=1)
        given = [text.encode() for text in raw]
        whole = np.ones(len(words), dtype=bool)
        for ids, tokens in zip(sides, (self.byte.tokens, self.piece_tokens), strict=True):
            # all at once; one by one only where something differs
            if b"".join(map(tokens.__getitem__, chain.from_iterable(ids))) != b"".join(given):
                whole &= [b"".join([tokens[i] for i in found]) == text for found, text in zip(ids, given, strict=True)]
        lengths = np.fromiter(map(len, given), np.int64, len(given))
        result = []
        for ids, sizes in zip(sides, self.sizes(), strict=True):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum()))
            whole &= np.diff(np.r_[0, np.cumsum(sizes[flat])][np.r_[0, np.cumsum(n)]]) == lengths
            result.append((flat, n))
        if not whole.all():
            result = [(flat[np.repeat(whole, n)], np.where(whole, n, 0)) for flat, n in result]
        return result, whole


def two_tokenizers(byte_path: str | None = None, piece_path: str | None = None) -> TwoTokenizers:
    """The worker's tokenizers; every node has the files at the same place."""
    byte_path = byte_path or public_tokenizers.path(BYTE_TOKENIZER)
    piece_path = piece_path or public_tokenizers.path(PIECE_TOKENIZER)
    return kept_in_worker(f"two {byte_path} {piece_path}", lambda: TwoTokenizers(byte_path, piece_path))


class Aligned:
    """Tokens of some words in groups, and their links.

    ``a, b`` have the ids of all words in turn, ``n_a, n_b`` how many each word has, ``size_a, size_b`` the
    bytes of the ids. A word's intervals begin where those of the word before end. ``group_a, group_b``
    number the group of each token, ``link_a, link_b`` the tokens of each link.
    """

    def __init__(self, a, n_a, b, n_b, size_a, size_b):
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        starts = np.concatenate([end_a - size_a[a], end_b - size_b[b]])
        ends = np.concatenate([end_a, end_b])
        order = np.lexsort((ends, starts))
        reached = np.maximum.accumulate(ends[order])
        breaks = np.ones(len(order), dtype=bool)
        breaks[1:] = starts[order][1:] >= reached[:-1]
        groups = np.empty(len(order), dtype=np.int64)
        groups[order] = np.cumsum(breaks) - 1
        self.n_groups = int(breaks.sum())
        self.group_a, self.group_b = groups[: len(a)], groups[len(a) :]
        # each A token spreads over the B tokens that end behind its start and begin before its end
        first = np.searchsorted(end_b, starts[: len(a)], side="right")
        last = np.searchsorted(starts[len(a) :], end_a, side="left")
        spread = last - first
        self.link_a = np.repeat(np.arange(len(a)), spread)
        self.link_b = np.arange(len(self.link_a)) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(first, spread)
        self.bounds_a = np.r_[0, np.cumsum(n_a)]

    def pairs(self) -> np.ndarray:
        """The two ids of each link as one number."""
        return (self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b]

    def links_before(self) -> np.ndarray:
        """Number of the first link of each word, and of all links."""
        return np.searchsorted(self.link_a, self.bounds_a)

    def groups_before(self) -> np.ndarray:
        """Number of the first group of each word, and of all groups."""
        return np.r_[self.group_a, self.n_groups][self.bounds_a]

    def texts(self) -> list[str]:
        """For each word ``a1,a2|b1;a3|b2,b3``: the ids of its groups in order."""
        names = list(map(str, range(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)))
        sides = [self._joined(ids, groups, names) for ids, groups in ((self.a, self.group_a), (self.b, self.group_b))]
        joined = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        bounds = self.groups_before().tolist()
        return [";".join(joined[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]

    def _joined(self, ids: np.ndarray, groups: np.ndarray, names: list[str]) -> list[str]:
        words = [names[i] for i in ids.tolist()]
        bounds = np.searchsorted(groups, np.arange(self.n_groups + 1)).tolist()
        return [words[i] if j == i + 1 else ",".join(words[i:j]) for i, j in zip(bounds, bounds[1:], strict=False)]


@dataclass
class WordTable:
    """Of each distinct word: counts of tokens, groups and links, its pairs in turn, and its groups as text."""

    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    pairs: np.ndarray
    texts: list[str]


def word_table(words: list[str], both: TwoTokenizers, with_texts: bool) -> WordTable:
    """Words encoded and aligned, some thousands at a time; words that are not given back have nothing."""
    size_a, size_b = both.sizes()
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    texts: list[str] = []
    for start in range(0, len(words), ALIGNED_AT_ONCE):
        ((a, n_a), (b, n_b)), whole = both.encoded(words[start : start + ALIGNED_AT_ONCE])
        aligned = Aligned(a, n_a, b, n_b, size_a, size_b)
        found = (whole, n_a, n_b, np.diff(aligned.groups_before()), np.diff(aligned.links_before()), aligned.pairs())
        for column, values in zip(columns, found, strict=True):
            column.append(values)
        if with_texts:
            texts += aligned.texts()
    return WordTable(*map(np.concatenate, columns), texts)


class Block:
    """Some documents as numbers of their distinct words."""

    def __init__(self) -> None:
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__  # a new word gets the next number
        self.places: list[np.ndarray] = []
        self.rows: list[pa.RecordBatch] = []
        self.n_places = 0

    def add(self, text: str) -> None:
        """A document's words; none if it is empty."""
        words = cut_words(text) if text else []
        self.places.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.n_places += len(words)

    def full(self) -> bool:
        return len(self.numbers) >= WORDS_AT_ONCE or self.n_places >= PLACES_AT_ONCE

    def table(self, both: TwoTokenizers, with_texts: bool) -> tuple[WordTable, np.ndarray, np.ndarray]:
        """The words, the words of documents that both tokenizers give back, in turn, and their bounds."""
        found = word_table(list(self.numbers), both, with_texts)
        if not found.whole.all():
            none = np.empty(0, dtype=np.int32)
            self.places = [p if found.whole[p].all() else none for p in self.places]
        return found, np.concatenate(self.places), np.r_[0, np.cumsum([len(p) for p in self.places])]


def _blocks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[Block]:
    """Documents together until there are enough words; ``rows`` keeps the other columns."""
    block = Block()
    others = None
    for batch in batches:
        others = [name for i, name in enumerate(batch.schema.names) if i != text]
        for start, texts in text_slices(batch.column(text)):
            for value in texts:
                block.add(value)
            block.rows.append(batch.select(others).slice(start, len(texts)))
            if block.full():
                yield block
                block = Block()
    if block.places:
        yield block


def _pair_counts(docs: DataFrame, byte_path: str | None, piece_path: str | None) -> DataFrame:
    """``_pair, _n``: links of each pair of ids in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(byte_path, piece_path)
        for block in _blocks(batches, 0):
            words, places, _ = block.table(both, with_texts=False)
            times = np.repeat(np.bincount(places, minlength=len(words.whole)), words.n_links)
            pairs, back = np.unique(words.pairs, return_inverse=True)
            n = np.bincount(back, weights=times, minlength=len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[n > 0]), pa.array(n[n > 0])], ["_pair", "_n"])

    counts = docs.select("_text").mapInArrow(count, "_pair long, _n long").groupBy("_pair").agg(F.sum("_n").alias("_n"))
    return stage(counts, "alignment_counts")


def _marked(counts: DataFrame) -> DataFrame:
    """Counts with ``_best``: no pair of the same B id has a higher one. B ids are a bounded vocabulary."""
    b = F.col("_pair").bitwiseAND(F.lit((1 << 32) - 1))
    most = counts.groupBy(b.alias("_b")).agg(F.max("_n").alias("_most"))
    joined = counts.withColumn("_b", b).join(F.broadcast(most), "_b")
    return joined.select("_pair", "_n", (F.col("_n") == F.col("_most")).alias("_best"))


def _least_frequent(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs are linked as often."""
    # at most 64 rows
    sizes = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("_n")).cast("int")).count().collect()}
    power, held = 63, 0
    while power >= 0 and held + sizes.get(power, 0) <= most:
        held += sizes.get(power, 0)
        power -= 1
    return 1 << (power + 1)


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(
    docs: DataFrame,
    frequent: pa.Table,
    byte_path: str | None,
    piece_path: str | None,
    with_groups: bool,
    with_rest: bool,
) -> DataFrame:
    """Per row its counts over the frequent pairs, and with ``with_rest`` its other pairs, ``_rest``."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(
        tuple(frequent.column(c).to_numpy() for c in ("_pair", "_n", "_best"))
    )
    names = [field.split()[0] for field in RESULT.split(", ")]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = two_tokenizers(byte_path, piece_path)
        known, n_known, best_known = shared.value
        for block in _blocks(batches, 1):
            words, places, bounds = block.table(both, with_texts=True)
            at = np.minimum(np.searchsorted(known, words.pairs), max(0, len(known) - 1))
            hit = known[at] == words.pairs if len(known) else np.zeros(len(words.pairs), dtype=bool)
            value, best = (np.zeros(len(words.pairs), dtype=np.int64) for _ in range(2))
            value[hit], best[hit] = n_known[at[hit]], best_known[at[hit]]
            links = np.r_[0, np.cumsum(words.n_links)]
            per_word = [words.n_a, words.n_b, words.n_groups, words.n_links]
            per_word += [np.diff(np.r_[0, np.cumsum(x)][links]) for x in (best, value)]
            sums = [np.diff(np.r_[0, np.cumsum(x[places])][bounds]) for x in per_word]
            texts, first = words.texts, 0
            numbers, ends = places.tolist(), bounds.tolist()
            rare = [words.pairs[i:j][~hit[i:j]] for i, j in zip(links, links[1:], strict=False)] if with_rest else []
            for rows in block.rows:
                last = first + rows.num_rows
                groups = [";".join([texts[w] for w in numbers[ends[i] : ends[i + 1]]]) for i in range(first, last)]
                hashes = [hashlib.sha256(text.encode()).hexdigest() if text else "" for text in groups]
                columns = [*rows.columns, *(pa.array(x[first:last].astype(np.int64)) for x in sums), pa.array(hashes, pa.string())]
                labels = [*rows.schema.names, *names]
                if with_groups:
                    columns.append(pa.array(groups, pa.large_string()).cast(pa.string()))
                    labels.append("groups")
                if with_rest:
                    found = [_tallied([rare[w] for w in numbers[ends[i] : ends[i + 1]]]) for i in range(first, last)]
                    columns.append(pa.array(found, pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))))
                    labels.append("_rest")
                yield pa.RecordBatch.from_arrays(columns, labels)
                first = last

    kind = docs.schema["_doc"].dataType.simpleString()
    schema = f"_doc {kind}, {RESULT}" + ", groups string" * with_groups
    schema += ", _rest array<struct<pair: bigint, times: bigint>>" * with_rest
    return docs.select("_doc", "_text").mapInArrow(put, schema)


def _tallied(pairs: list[np.ndarray]) -> list[dict[str, int]]:
    """Each pair once with its number."""
    found, n = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]), return_counts=True)
    return [{"pair": p, "times": t} for p, t in zip(found.tolist(), n.tolist(), strict=True)]


def aligned_tokens(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    byte_path: str | None = None,
    piece_path: str | None = None,
    looked_up: int = LOOKED_UP,
    with_groups: bool = False,
) -> DataFrame:
    """``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A is the byte-level tokenizer, which gets a space and the text, B the one that adds that space. Groups
    end at the byte offsets where tokens of both end. A link is a token of A and one of B whose bytes
    overlap; a pair of ids counts as often as links hold it in the whole table, and a link is best if no pair
    with its B id counts more. With ``with_groups`` also ``groups``, the ids as ``a1,a2|b1;a3|b2,b3``, of which
    ``groups_sha256`` is the hash.

    Texts that are null, empty or not given back byte for byte by both tokenizers have no tokens: zeros and
    ''. Repeated rows are rows each and count each; a null key stays null. Other columns are not read, an
    empty table gives no rows. At most ``looked_up`` pairs of ids go to every task, the most frequent ones;
    rarer pairs are joined by shuffle, where none has as many rows as those.
    """
    given = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    counts = _pair_counts(given, byte_path, piece_path)
    marked = _marked(counts)
    least = _least_frequent(counts, looked_up)
    frequent = marked.where(F.col("_n") >= least).toArrow().sort_by("_pair")
    rare = marked.where(F.col("_n") < least)
    with_rest = not counts.where(F.col("_n") < least).isEmpty()
    result = _looked_up(given, frequent, byte_path, piece_path, with_groups, with_rest)
    names = [c for c in result.columns if c not in ("_doc", "_rest")]
    if not with_rest:
        return result.select(F.col("_doc").alias(key), *names)
    # rows may share their key, so each has a number of its own, fixed by writing it
    result = stage(result.withColumn("_row", F.monotonically_increasing_id()), "alignment_rows")
    rest = result.select("_row", F.explode("_rest").alias("_one"))
    rest = rest.select("_row", F.col("_one.pair").alias("_pair"), F.col("_one.times").alias("_times"))
    more = rest.join(rare.hint("merge"), "_pair").groupBy("_row").agg(
        F.sum(F.when(F.col("_best"), F.col("_times")).otherwise(0)).alias("_more_best"),
        F.sum(F.col("_times") * F.col("_n")).alias("_more_sum"),
    )
    whole = result.join(more, "_row", "left")
    added = {"n_best": "_more_best", "count_sum": "_more_sum"}
    columns = [(F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else F.col(c) for c in names]
    return whole.select(F.col("_doc").alias(key), *columns)
