"""Merkle manifest of a dataset: a tree of hashes per source, kept in van Emde Boas order, and proofs from it.

The unit of the layout is a run: up to 16 sibling digests, which is what a proof reads at one level. The
runs of a tree form a 16-ary tree themselves. It is split at half its height; the upper half is stored
first, then each lower tree, all of them split likewise, down to blocks of at most three levels of runs. A
block is one row. Blocks of the lowest stratum are built from leaves, and the roots of blocks are the
inputs of the stratum above. A run's place is computed from height, depth and number alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.shared import group_key
from themeloom.operators.documents import with_row_index
from themeloom.operators.joins import salted_join
from themeloom.staging import stage

#: Nodes of a run, as a power of two.
RUN_BITS = 4
RUN = 1 << RUN_BITS
DIGEST = 32
#: Levels of runs in a block at most: 16 ** 3 inputs, 273 runs, 140 kB.
BLOCK_LEVELS = 3
MOST_LEVELS = 15
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows sent at once may hold so many bytes of paths.
PATH_BYTES = 1 << 22


def runs_of(height: int) -> int:
    """Runs of a full tree of so many levels of runs."""
    return (RUN**height - 1) // (RUN - 1)


def lower_levels(height: int) -> int:
    """Levels of the lower trees when a tree is split at half its height."""
    return height // 2


def addresses(height: int, depth: int, numbers: np.ndarray) -> np.ndarray:
    """Places of runs of one depth (0 is the top run) in the van Emde Boas order of a tree.

    ``numbers`` count the runs of that depth from the left.
    """
    numbers = np.asarray(numbers, dtype=np.int64)
    if height <= 1:
        return np.zeros_like(numbers)
    low = lower_levels(height)
    top = height - low
    if depth < top:
        return addresses(top, depth, numbers)
    bits = RUN_BITS * (depth - top)
    tree, inside = numbers >> bits, numbers & ((1 << bits) - 1)
    return runs_of(top) + tree * runs_of(low) + addresses(low, depth - top, inside)


def strata(height: int) -> list[int]:
    """Levels of the blocks from the leaves up: the tree split at half its height until blocks are small."""
    if height <= BLOCK_LEVELS:
        return [height] if height else []
    low = lower_levels(height)
    return strata(low) + strata(height - low)


def height_for(n: int | Column) -> Column:
    """Levels of runs over ``n`` nodes: the least h with 16 ** h >= n."""
    chain = F.when(F.lit(n) <= 1 if isinstance(n, int) else n <= 1, 0)
    for h in range(1, MOST_LEVELS):
        chain = chain.when((F.lit(n) if isinstance(n, int) else n) <= RUN**h, h)
    return chain.otherwise(MOST_LEVELS)


def run_hash(digests: bytes) -> bytes:
    """Digest of a run: SHA-256 of the digests as lower-case hexadecimal text, one after the other."""
    return hashlib.sha256(digests.hex().encode()).digest()


class BlockLayout:
    """Places of the runs of a block, and the block's building and reading."""

    def __init__(self, levels: int):
        self.levels = levels
        self.places = [
            addresses(levels, levels - 1 - level, np.arange(RUN ** (levels - 1 - level))).tolist() for level in range(levels)
        ]

    def built(self, inputs: bytes) -> tuple[bytes, bytes]:
        """Runs in van Emde Boas order, up to the last one that exists, and the root."""
        packed, end, size = bytearray(runs_of(self.levels) * RUN * DIGEST), 0, RUN * DIGEST
        for places in self.places:
            above = []
            for run, start in enumerate(range(0, len(inputs), size)):
                held, at = inputs[start : start + size], places[run] * size
                packed[at : at + len(held)] = held
                end = max(end, at + len(held))
                above.append(run_hash(held))
            inputs = b"".join(above)
        return bytes(packed[:end]), inputs

    def run(self, packed: bytes, n: int, level: int, number: int) -> bytes:
        """Digests of the run ``number`` of a level (0: inputs) of a block with ``n`` inputs."""
        nodes = -(-n >> RUN_BITS * level) if level else n
        held = min(RUN, nodes - number * RUN)
        at = self.places[level][number] * RUN * DIGEST
        return packed[at : at + held * DIGEST]

    def step(self, packed: bytes, n: int, level: int, node: int) -> bytes:
        """One level of a path: slot, size of the run, and the digests of the siblings."""
        slot = node & (RUN - 1)
        held = self.run(packed, n, level, node >> RUN_BITS)
        at = slot * DIGEST
        return bytes((slot, len(held) // DIGEST)) + held[:at] + held[at + DIGEST :]

    def steps_above(self, packed: bytes, n: int, node: int, level: int) -> bytes:
        """Path from a node of a level to the root of the block."""
        return b"".join(
            self.step(packed, n, at, node >> RUN_BITS * (at - level)) for at in range(level, self.levels)
        )


def path_sides(path: bytes) -> list[tuple[bytes, bytes]]:
    """For each level, the hexadecimal digests left and right of the path's node."""
    sides, at = [], 0
    while at < len(path):
        slot, held = path[at], path[at + 1]
        at += 2
        end = at + (held - 1) * DIGEST
        cut = at + slot * DIGEST
        sides.append((path[at:cut].hex().encode(), path[cut:end].hex().encode()))
        at = end
    return sides


def folded(leaf: bytes, sides: Sequence[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf's digest and its siblings give, as hexadecimal text."""
    digest = leaf.hex().encode()
    for left, right in sides:
        digest = hashlib.sha256(left + digest + right).hexdigest().encode()
    return digest


def encoded_field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Binary SHA-256 over the encoded fields of a row."""
    return F.unhex(F.sha2(F.concat(*map(encoded_field, fields)).cast("binary"), 256))


@dataclass(frozen=True)
class Forest:
    """Blocks of several trees by stratum, from the leaves up, and their roots ``_tree, _root``."""

    blocks: list[DataFrame]
    roots: DataFrame


@dataclass(frozen=True)
class Manifest:
    """Trees of the groups, the tree over their roots, and the root of all as hexadecimal text.

    ``groups``: a row per group with ``_tree`` (its number in order), ``_group``, ``_n`` and ``_root``.
    """

    groups: DataFrame
    trees: Forest
    top: Forest
    root: str


def _by_height(of: list[list[int]], height: str, stratum: int, default: int) -> Column:
    chain = F.lit(default)
    for h, values in enumerate(of):
        if stratum < len(values):
            chain = F.when(F.col(height) == h, values[stratum]).otherwise(chain)
    return chain


_STRATA = [strata(h) for h in range(MOST_LEVELS + 1)]


def _blocks_of(nodes: DataFrame, extra: Sequence[str]) -> DataFrame:
    """A row per block of ``nodes``: ``_tree, _height, _levels, _block, _n, _packed, _root`` and lists of ``extra``."""
    kinds = dict(nodes.dtypes)
    schema = "_tree long, _height int, _levels int, _block long, _n int, _packed binary, _root binary"
    schema += "".join(f", {name} array<{kinds[name]}>" for name in extra)
    at = F.expr(f"shiftright(_place, {RUN_BITS} * _levels)")
    dealt = nodes.withColumn("_block", at).repartition("_tree", "_block").sortWithinPartitions("_tree", "_block", "_place")
    dealt = dealt.select("_tree", "_height", "_levels", "_block", "_digest", *extra)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[int, BlockLayout] = {}

        def made(rows: pa.Table, starts: list[int]) -> pa.RecordBatch:
            first = rows.take(pa.array(starts[:-1], pa.int64())).combine_chunks()
            digests = rows.column("_digest").combine_chunks()
            packed, roots, counts = [], [], []
            for i, levels in enumerate(first.column("_levels").to_pylist()):
                layout = layouts.get(levels) or layouts.setdefault(levels, BlockLayout(levels))
                held = digests.slice(starts[i], starts[i + 1] - starts[i])
                block, root = layout.built(b"".join(held.to_pylist()))
                packed.append(block)
                roots.append(root)
                counts.append(len(held))
            arrays = [first.column(name).combine_chunks() for name in ("_tree", "_height", "_levels", "_block")]
            arrays += [pa.array(counts, pa.int32()), pa.array(packed, pa.binary()), pa.array(roots, pa.binary())]
            offsets = pa.array(starts, pa.int32())
            arrays += [pa.ListArray.from_arrays(offsets, rows.column(name).combine_chunks()) for name in extra]
            return pa.RecordBatch.from_arrays(arrays, ["_tree", "_height", "_levels", "_block", "_n", "_packed", "_root", *extra])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = _starts(held)
            # the last block may go on in the next batch
            if len(starts) > 1:
                yield made(held.slice(0, starts[-1]), starts)
                held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield made(held, [*_starts(held), held.num_rows])

    return dealt.mapInArrow(build, schema)


def _starts(rows: pa.Table) -> list[int]:
    """Where the blocks of some sorted rows begin."""
    if not rows.num_rows:
        return []
    tree, block = (rows.column(name).to_numpy() for name in ("_tree", "_block"))
    return [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]


def _forest(nodes: DataFrame, most_levels: int, extra: Sequence[str]) -> Forest:
    """Trees over ``nodes`` (``_tree, _height, _place, _digest`` and, for leaves, ``extra``)."""
    blocks, roots = [], [nodes.where("_height = 0").select("_tree", F.col("_digest").alias("_root"))]
    depth = max(len(_STRATA[h]) for h in range(most_levels + 1))
    for s in range(depth):
        levels = _by_height(_STRATA, "_height", s, 0)
        last = _by_height([[i + 1 == len(x) for i in range(len(x))] for x in _STRATA], "_height", s, False)
        here = nodes.withColumn("_levels", levels.cast("int")).where("_levels > 0")
        built = stage(_blocks_of(here, extra if s == 0 else []), f"merkle_blocks_{s}")
        blocks.append(built)
        roots.append(built.where(last).select("_tree", "_root"))
        nodes = built.where(~last).select("_tree", "_height", F.col("_block").alias("_place"), F.col("_root").alias("_digest"))
    return Forest(blocks, reduce(DataFrame.unionByName, roots))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "source", changed: Column | None = None
) -> Manifest:
    """Hash trees over the rows of ``docs``: a tree per value of ``group``, and one over their roots.

    A leaf is the SHA-256 of the row's ``fields``, each ``-`` if null, else UTF-8 byte count, ``:`` and
    value. Leaves of a group ascend by ``key``, null first, rows of one key by digest; rows that agree in all
    fields are leaves each. A run of up to 16 nodes becomes the SHA-256 of their hexadecimal digests until
    one node is left; a lone leaf is its group's root. Groups are ordered null first, then by UTF-8 bytes.

    ``changed`` is an optional digest per row, kept beside the leaf, that ``proofs`` folds instead of it.
    Columns outside ``fields`` are not read; an empty table has no groups and the root ``''``. No task sees
    more of a tree than one block of 4,096 nodes; a group of any size is numbered by ranges.
    """
    leaves = docs.select(
        F.col(key).alias("_key"),
        F.col(group).alias("_group"),
        leaf_digest([docs[name] for name in fields]).alias("_digest"),
        (F.lit(None).cast("binary") if changed is None else changed).alias("_changed"),
    )
    leaves = stage(leaves, "merkle_leaves")
    placed = with_row_index(leaves, ["_group", "_key", "_digest"], "_at").withColumn("_name", group_key("_group"))
    placed = stage(placed, "merkle_placed")
    groups = placed.groupBy("_name").agg(
        F.first("_group").alias("_group"), F.count("*").alias("_n"), F.min("_at").alias("_start")
    )
    groups = stage(with_row_index(stage(groups, "merkle_sizes"), ["_start"], "_tree"), "merkle_groups")
    n_groups, largest = groups.agg(F.count("*"), F.coalesce(F.max("_n"), F.lit(0))).first()
    heights = groups.select("_name", "_tree", "_start", height_for(F.col("_n")).cast("int").alias("_height"))
    nodes = salted_join(placed.drop("_group"), heights, "_name", ["_at"]).select(
        "_tree", "_height", (F.col("_at") - F.col("_start")).alias("_place"), "_digest", "_key", "_changed"
    )
    trees = _forest(stage(nodes, "merkle_nodes"), _height(largest), ["_key", "_changed"])
    trees = Forest([nodes, *trees.blocks], trees.roots)
    known = stage(groups.drop("_name").join(trees.roots, "_tree"), "merkle_roots")
    above = known.select(
        F.lit(0).cast("long").alias("_tree"),
        height_for(n_groups).cast("int").alias("_height"),
        F.col("_tree").alias("_place"),
        F.col("_root").alias("_digest"),
    )
    top = _forest(above, _height(n_groups), [])
    root = top.roots.first() if n_groups else None
    return Manifest(known, trees, top, root["_root"].hex() if root else "")


def _height(n: int) -> int:
    return next(h for h in range(MOST_LEVELS + 1) if RUN**h >= n)


PATH = "_tree long, _place long, _path binary"


def _paths_below(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of the inputs of ``blocks``, whose roots have ``paths``."""
    given = paths.select("_tree", F.col("_place").alias("_block"), "_path")
    joined = blocks.select("_tree", "_block", "_levels", "_n", "_packed").join(given, ["_tree", "_block"])
    joined = joined.select("_tree", "_block", "_levels", "_n", "_packed", "_path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[int, BlockLayout] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tree, block, levels, n, packed, path = (batch.column(c)[i].as_py() for c in range(6))
                layout = layouts.get(levels) or layouts.setdefault(levels, BlockLayout(levels))
                first = block << RUN_BITS * levels
                step = max(1, PATH_BYTES // (len(path) + levels * RUN * DIGEST))
                for start in range(0, n, step):
                    nodes = range(start, min(n, start + step))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([tree] * len(nodes), pa.int64()),
                            pa.array([first + node for node in nodes], pa.int64()),
                            pa.array([layout.steps_above(packed, n, node, 0) + path for node in nodes], pa.binary()),
                        ],
                        ["_tree", "_place", "_path"],
                    )

    return joined.mapInArrow(read, PATH)


def proofs(made: Manifest) -> DataFrame:
    """``_key, _tree, leaf, proof_sha256, folded_root``: one row per row of the table the manifest is of.

    ``proof_sha256`` is the SHA-256 of the siblings' hexadecimal digests, level by level from the leaf to the
    root of all and left to right. ``folded_root`` is computed anew from the row's changed digest, or its
    leaf where it has none, and the stored siblings.
    """
    start = made.groups.select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_place"))
    paths = start.limit(1).select("_tree", F.lit(0).cast("long").alias("_place"), F.lit(b"").alias("_path"))
    for blocks in reversed(made.top.blocks):
        paths = _paths_below(blocks, paths)
    # the places of the tree over all groups are the numbers of the groups' own trees
    roots = stage(paths.select(F.col("_place").alias("_tree"), "_path"), "merkle_paths")
    nodes, *blocks = made.trees.blocks
    one = F.lit(0).cast("long").alias("_place")
    arriving: DataFrame | None = None
    for s in reversed(range(1, len(blocks))):
        last = _by_height([[i + 1 == len(x) for i in range(len(x))] for x in _STRATA], "_height", s, False)
        tops = blocks[s].where(last).select("_tree").distinct().join(roots, "_tree").select("_tree", one, "_path")
        given = tops if arriving is None else arriving.unionByName(tops)
        arriving = stage(_paths_below(blocks[s], given), f"merkle_paths_{s}")
    results = []
    if blocks:
        last = F.col("_height") <= BLOCK_LEVELS
        tops = blocks[0].where(last).select("_tree").distinct().join(roots, "_tree").select("_tree", one, "_path")
        given = tops if arriving is None else arriving.unionByName(tops)
        results.append(_leaf_proofs(blocks[0], given))
    alone = nodes.where("_height = 0").join(roots, "_tree")
    results.append(_lone_proofs(alone))
    return reduce(DataFrame.unionByName, results)


def _proof_schema(key_type: str) -> str:
    return f"_key {key_type}, _tree long, leaf string, proof_sha256 string, folded_root string"


_NAMES = ["_key", "_tree", "leaf", "proof_sha256", "folded_root"]


def _leaf_proofs(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    given = paths.select("_tree", F.col("_place").alias("_block"), "_path")
    joined = blocks.join(given, ["_tree", "_block"])
    joined = joined.select("_tree", "_levels", "_n", "_packed", "_path", "_key", "_changed")
    schema = _proof_schema(dict(blocks.dtypes)["_key"].removeprefix("array<")[:-1])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts: dict[int, BlockLayout] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                tree, levels, n, packed, path = (batch.column(c)[i].as_py() for c in range(5))
                layout = layouts.get(levels) or layouts.setdefault(levels, BlockLayout(levels))
                keys, changed = batch.column(5)[i].values, batch.column(6)[i].values.to_pylist()
                leaves, hashes, roots = [], [], []
                for run in range(-(-n // RUN)):
                    held = layout.run(packed, n, 0, run)
                    text = held.hex().encode()
                    above = path_sides(layout.steps_above(packed, n, run, 1) + path)
                    tail = b"".join(left + right for left, right in above)
                    for slot in range(len(held) // DIGEST):
                        left, own, right = text[: slot * 64], text[slot * 64 : slot * 64 + 64], text[slot * 64 + 64 :]
                        leaves.append(own.decode())
                        hashes.append(hashlib.sha256(left + right + tail).hexdigest())
                        leaf = changed[run * RUN + slot] or held[slot * DIGEST : (slot + 1) * DIGEST]
                        roots.append(folded(leaf, [(left, right), *above]).decode())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array([tree] * n, pa.int64()), pa.array(leaves), pa.array(hashes), pa.array(roots)], _NAMES
                )

    return joined.mapInArrow(read, schema)


def _lone_proofs(nodes: DataFrame) -> DataFrame:
    """Proofs of leaves that are their group's root."""
    given = nodes.select("_key", "_tree", "_digest", "_changed", "_path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [column.to_pylist() for column in batch.columns[2:]]
            leaves, hashes, roots = [], [], []
            for leaf, changed, path in zip(*rows, strict=True):
                sides = path_sides(path)
                leaves.append(leaf.hex())
                hashes.append(hashlib.sha256(b"".join(left + right for left, right in sides)).hexdigest())
                roots.append(folded(changed or leaf, sides).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(leaves, pa.string()), pa.array(hashes, pa.string()), pa.array(roots, pa.string())], _NAMES
            )

    return given.mapInArrow(read, _proof_schema(dict(nodes.dtypes)["_key"]))


def verified_documents(docs: DataFrame, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    Rows whose unsigned CRC-32 of the decimal key is divisible by 5 are tampered with before they are
    verified: A-Z of the text become a-z. A row with a null key stays as it is.
    """
    low = F.translate(text, UPPER, LOWER)
    changed = leaf_digest([low if name == text else docs[name] for name in FIELDS])
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    made = manifest(docs, FIELDS, key, group, F.when(hit, changed))
    subroots = made.groups.select("_tree", F.lower(F.hex("_root")).alias("subroot"))
    rows = salted_join(proofs(made), subroots, "_tree", ["leaf"])
    return rows.select(
        F.col("_key").alias(key),
        "leaf",
        "subroot",
        F.lit(made.root).alias("root"),
        "proof_sha256",
        "folded_root",
        (F.col("folded_root") == made.root).alias("verified"),
    )
