"""Best-fit packing of tokenised documents after dominance reduction.

Pieces of equal length are alike, so the instance is the count of pieces per length: at most one number
per length up to the capacity, however many documents there are. The driver reduces and packs these
counts into patterns (lengths that share a sequence, and how often); each piece then finds its sequence
by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.shared import bucket_bits, freed_worker, text_slices, with_running_totals
from themeloom.llm.tokens import word_tokens
from themeloom.staging import stage

CAPACITY = 4096
END_ID = 1


@dataclass
class Pattern:
    """``times`` sequences that hold the same lengths; ``runs`` has (length, how many in a row)."""

    times: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def used(self) -> int:
        return sum(length * n for length, n in self.runs)


class _Counts:
    """Counts per length with the nearest length at or below a bound."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {length: n for length, n in counts.items() if n > 0}
        self.lengths = sorted(self.counts)

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.remove(length)

    def largest(self, bound: int, without: Sequence[int] = ()) -> int | None:
        """Largest length up to ``bound`` of which a piece is left besides those in ``without``."""
        at = bisect_right(self.lengths, bound) - 1
        while at >= 0 and self.counts[self.lengths[at]] <= sum(x == self.lengths[at] for x in without):
            at -= 1
        return self.lengths[at] if at >= 0 else None

    def smallest(self, n: int, without: int, above: int = 0) -> list[int]:
        """The ``n`` smallest pieces longer than ``above``, besides one of length ``without``."""
        found: list[int] = []
        at = bisect_right(self.lengths, above)
        while at < len(self.lengths) and len(found) < n:
            length = self.lengths[at]
            found += [length] * min(n - len(found), self.counts[length] - (length == without))
            at += 1
        return found


def _dominating(counts: _Counts, length: int, room: int) -> list[int] | None:
    """Partners of a piece of ``length`` that dominate every other choice, or None.

    A set dominates if any other feasible set can be exchanged for it, piece by piece, without needing
    more room elsewhere.
    """
    first = counts.largest(room, [length])
    if first is None:
        return []
    if first == room:
        return [first]  # fills the sequence: any other set is no longer in sum than this piece
    smallest = counts.smallest(3, length)
    if len(smallest) < 2 or sum(smallest[:2]) > room:
        return [first]  # only one partner fits, and this is the longest
    if len(smallest) == 3 and sum(smallest) <= room:
        return None
    pair = _best_pair(counts, length, room)
    if first >= sum(pair):
        return [first]
    if first == pair[0]:
        longer = counts.smallest(2, length, above=pair[1])
        if len(longer) < 2 or sum(longer) > room:
            return list(pair)  # in every pair one piece is at most pair[1], the other at most the longest
    return None


def _best_pair(counts: _Counts, length: int, room: int) -> tuple[int, int]:
    best = (0, 0)
    for a in reversed(counts.lengths):
        if 2 * a < sum(best):
            break
        if a < room and counts.largest(a, [length]) == a:
            b = counts.largest(min(a, room - a), [length, a])
            if b is not None and a + b > sum(best):
                best = (a, b)
    return best


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that some optimal packing holds, and the counts that are left.

    Lengths are tried from the longest on, again and again until nothing more can be fixed. Equal pieces
    are fixed many at a time as long as the same partners stay available.
    """
    left, fixed, changed = _Counts(dict(counts)), [], True
    while changed:
        changed = False
        for length in reversed(list(left.lengths)):
            while length in left.counts:
                partners = _dominating(left, length, capacity - length)
                if partners is None:
                    break
                runs = [(length, 1)] + [(p, 1) for p in partners]
                needs: dict[int, int] = {}
                for p, n in runs:
                    needs[p] = needs.get(p, 0) + n
                # taking pieces away leaves the argument valid while these partners are still there
                times = min(left.counts[p] // n for p, n in needs.items())
                for p, n in needs.items():
                    left.take(p, n * times)
                fixed.append(Pattern(times, runs))
                changed = True
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: each piece goes where it leaves the least room.

    Sequences of one pattern are filled together, and so are the equal pieces of one length.
    """
    by_room: dict[int, list[Pattern]] = {}
    rooms: list[int] = []

    def put(pattern: Pattern) -> None:
        room = capacity - pattern.used()
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        by_room[room].append(pattern)

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_right(rooms, length - 1)
            if at == len(rooms):
                each = capacity // length
                if todo >= each:
                    put(Pattern(todo // each, [(length, each)]))
                if todo % each:
                    put(Pattern(1, [(length, todo % each)]))
                break
            room = rooms[at]
            pattern = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.remove(room)
            each = min(room // length, todo)
            filled = min(pattern.times, todo // each)
            put(Pattern(filled, [*pattern.runs, (length, each)]))
            if filled < pattern.times:
                put(Pattern(pattern.times - filled, pattern.runs))
            todo -= filled * each
    return [pattern for patterns in by_room.values() for pattern in patterns]


def pack_counts(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns for pieces given as counts per length: dominance first, best fit for the rest."""
    fixed, left = dominance_reduction(counts, capacity)
    return fixed + best_fit(left, capacity)


#: Per length: first ranks of its runs, and for each run first sequence, offset and pieces per sequence.
Places = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def find_places(tables: Places, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece from its length and its rank within the length."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for length in np.unique(lengths):
        of = np.flatnonzero(lengths == length)
        first, base, start, each = tables[int(length)]
        run = np.searchsorted(first, ranks[of], side="right") - 1
        inside = ranks[of] - first[run]
        sequence[of] = base[run] + inside // each[run]
        offset[of] = start[run] + inside % each[run] * length
    return sequence, offset


def places(patterns: Sequence[Pattern]) -> Places:
    """Number the sequences of all patterns and note where each length's pieces go."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for pattern in patterns:
        start = 0
        for length, each in pattern.runs:
            found.setdefault(length, []).append((base, start, each, pattern.times * each))
            start += length * each
        base += pattern.times
    tables = {}
    for length, runs in found.items():
        b, s, e, n = (np.array(column, dtype=np.int64) for column in zip(*runs, strict=True))
        tables[length] = (np.cumsum(n) - n, b, s, e)
    return tables


PIECES = "_key long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, key: str, text: str, path: str | None, capacity: int, with_ids: bool = False, keep_cache: bool = True
) -> DataFrame:
    """A row per piece of at most ``capacity`` ids: ``_key, piece, start, length, ids_crc32`` and ``ids``."""
    extra = [T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else []
    schema = T.StructType([*T._parse_datatype_string(PIECES).fields, *extra])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            keys = batch.column(0)
            for first, texts in text_slices(batch.column(1)):
                rows: list[tuple] = []
                for i, raw in enumerate(tokens.texts(texts)):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[start : start + 4 * capacity]
                        rows.append((first + i, piece, start // 4, len(part) // 4, zlib.crc32(part), part))
                at, piece, start, length, crc, parts = zip(*rows, strict=True)
                columns = [
                    keys.take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(p, "<u4").astype(np.int64) for p in parts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
        if not keep_cache:
            del tokens
            freed_worker()

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(cut, schema)


def packed_pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    keep_cache: bool = True,
) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids.

    A document is its text's ids and one end id; only longer ones are cut. Returns ``key, piece, start,
    length, ids_crc32, sequence_id, offset`` and, on request, ``ids``. ``tokenizer`` is the path of a
    tokenizer file that every node has.

    Null and empty texts are the end id alone. Rows that repeat are packed each on their own; null keys
    stay null. An empty table gives no rows. Other columns are not read.

    Workers keep the ids of known words from task to task. Without ``keep_cache`` a task gives them back at
    its end, which takes longer and leaves the memory to other stages and workers; the rows are the same.
    """
    pieces = stage(token_pieces(docs, key, text, tokenizer, capacity, with_ids, keep_cache), "packing_pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = docs.sparkSession.sparkContext.broadcast(places(pack_counts(counts, capacity)))
    names = pieces.columns
    bits = bucket_bits(sum(counts.values()))
    hashed = pieces.withColumn("_hash", F.xxhash64("_key", "piece", "ids_crc32"))
    ranked = with_running_totals(
        hashed.withColumn("_bucket", F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long")),
        ["length"],
        "_bucket",
        [F.col("_hash"), F.col("_key"), F.col("piece"), F.col("ids_crc32")],
        {"_rank": F.lit(1)},
    ).select(*names, "_rank")
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    at, by = names.index("length"), len(names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sequence, offset = find_places(table, batch.column(at).to_numpy(), batch.column(by).to_numpy())
            columns = [*batch.columns[:by], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return ranked.mapInArrow(place, schema).withColumnRenamed("_key", key)
