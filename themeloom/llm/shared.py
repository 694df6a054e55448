"""What the operators share: words of a text, distributed running totals, words of whole Arrow batches."""

from __future__ import annotations

import gc
import math
import re
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WORD_PATTERN = re.compile(r"[^ \t-\r]+")
ROWS_PER_BUCKET = 256
FAN_OUT_BITS = 10


def text_or_empty(text: str | Column = "text") -> Column:
    """The text, a null text as the empty one."""
    return F.coalesce(text, F.lit(""))


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name like ``name`` that is not among ``taken``, whatever their case."""
    taken = {column.lower() for column in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: str | Column = "text") -> Column:
    """Number of words as a long; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def group_key(column: str | Column) -> Column:
    """A string that is never null and keeps null apart from every value."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n"))


def bucket_bits(rows: int) -> int:
    """Bits of a bucket number so that a bucket of evenly spread rows holds some hundreds of them."""
    return max(0, math.ceil(math.log2(max(1, rows) / ROWS_PER_BUCKET)))


def with_running_totals(
    rows: DataFrame, group: Sequence[str], bucket: str, order: Sequence[Column], totals: Mapping[str, Column]
) -> DataFrame:
    """Add for each name in ``totals`` the sum of its expression over the earlier rows of the group.

    Rows of a group are ordered by the long column ``bucket``, then by ``order``; ``bucket`` must rise
    with the wanted order and spread rows evenly. The group columns are never null. A group of any size
    is summed in three levels (bucket, 1,024 buckets, group), so no task holds more of it than one bucket
    or one row per bucket.
    """
    names = list(totals)
    keys = [*group, bucket]
    cells = rows.groupBy(*keys).agg(*(F.sum(value).alias(name) for name, value in totals.items()))
    cells = cells.withColumn("_block", F.shiftright(bucket, FAN_OUT_BITS))
    blocks = cells.groupBy(*group, "_block").agg(*(F.sum(name).alias(name) for name in names))
    earlier_blocks = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *group, "_block", *(F.coalesce(F.sum(n).over(earlier_blocks), F.lit(0)).alias(f"_above_{n}") for n in names)
    )
    earlier_cells = (
        Window.partitionBy(*group, "_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = cells.join(blocks, [*group, "_block"]).select(
        *keys,
        *(
            (F.col(f"_above_{n}") + F.coalesce(F.sum(n).over(earlier_cells), F.lit(0))).alias(f"_start_{n}")
            for n in names
        ),
    )
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = [(F.coalesce(F.sum(value).over(earlier), F.lit(0))).alias(name) for name, value in totals.items()]
    return (
        rows.join(starts, keys)
        .select(*rows.columns, *(f"_start_{n}" for n in names), *inside)
        .select(*rows.columns, *((F.col(f"_start_{n}") + F.col(n)).cast("long").alias(n) for n in names))
    )


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Position and texts of consecutive slices of about ``most_bytes``; null texts become empty."""
    sizes = texts.cast(pa.large_binary()).nbytes if len(texts) else 0
    step = max(1, int(len(texts) * most_bytes / max(1, sizes)))
    for start in range(0, len(texts), step):
        yield start, [text or "" for text in texts.slice(start, step).to_pylist()]


def kept_in_worker(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, made once per Python worker.

    Functions travel to tasks by value, so their module's globals are new in each task; this place stays.
    """
    place = sys.modules.setdefault("_themeloom_worker", ModuleType("_themeloom_worker")).__dict__
    if name not in place:
        place[name] = build()
    return place[name]


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)


def scrambled(values: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Texts:
    """Some texts as one run of bytes, with the place and the hash of every word.

    ``bounds`` has where each text begins and the last one ends; ``starts``, ``stops`` and ``rows`` have a
    word's span and text. Hashes are differences of running sums of a polynomial over the bytes.
    """

    def __init__(self, first: int, raw: np.ndarray, bounds: np.ndarray, fold_case: bool):
        self.first, self.raw, self.bounds, self.n_rows = first, raw, bounds, len(bounds) - 1
        self.inside = (raw != 32) & ((raw < 9) | (raw > 13))
        text_start = np.zeros(len(raw) + 1, dtype=bool)
        text_start[bounds] = True
        before, after = np.r_[False, self.inside[:-1]], np.r_[self.inside[1:], False]
        self.starts = np.flatnonzero(self.inside & (~before[: len(raw)] | text_start[:-1]))
        self.stops = np.flatnonzero(self.inside & (~after[: len(raw)] | text_start[1:])) + 1
        self.rows = np.searchsorted(bounds, self.starts, side="right") - 1
        shown = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw) if fold_case else raw
        self._sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[shown] * _powers(_BASE, len(raw)), out=self._sums[1:])
        self.words = self.hashes(self.starts, self.stops)

    def hashes(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Hash of each span of bytes."""
        sums = (self._sums[stops] - self._sums[starts]) * _powers(_BASE_INVERSE, len(self.raw) + 1)[starts]
        return scrambled(sums + (stops - starts).astype(np.uint64))

    def counted(self, marked: np.ndarray) -> np.ndarray:
        """Number of marked bytes of each text."""
        sums = np.r_[0, np.cumsum(marked)]
        return sums[self.bounds[1:]] - sums[self.bounds[:-1]]

    def word_bounds(self) -> np.ndarray:
        """Number of the first word of each text, and of all words."""
        return np.searchsorted(self.rows, np.arange(self.n_rows + 1))


def hashed_texts(texts: pa.Array, fold_case: bool = True, most_bytes: int = 1 << 20) -> Iterator[Texts]:
    """Slices of about ``most_bytes``; null texts count as empty, A-Z as a-z if ``fold_case``."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Texts(
            first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], fold_case
        )
        first = last


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` successive values."""
    count = max(0, len(hashes) - n + 1)
    result = scrambled(hashes[:count] + np.uint64(n))
    for i in range(1, n):
        result = scrambled(result * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + count])
    return result


def freed_worker() -> None:
    """Give back what an earlier task kept in this Python worker; called by tasks that do not use it."""
    place = sys.modules.get("_themeloom_worker")
    kept = [name for name in place.__dict__ if not name.startswith("__")] if place else []
    for name in kept:
        delattr(place, name)
    if kept:
        gc.collect()
    pa.default_memory_pool().release_unused()
