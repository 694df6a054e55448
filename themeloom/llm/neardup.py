"""Near-duplicates by one-permutation MinHash with optimal densification and star-shaped candidates.

Documents with equal shingle sets are one class, so exact copies never meet each other. A class has one
signature: its shingle hashes fall into bins, each bin keeps its least hash, and an empty bin copies the
first filled one of an order that is drawn for that bin once and for all documents. Bands of the signature
name buckets. In a bucket only edges from its least member go out: the number of candidates is that of
bucket entries. Edges are confirmed on full shingle sets, and components found. Where a bucket still
holds several components, links across them are searched exactly, by their rarest shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.llm.shared import chained, freed_worker, hashed_texts, scrambled
from themeloom.staging import stage

SHINGLE_WORDS = 5
SIMILAR = 80
BANDS, BAND_ROWS = 32, 4
BINS = BANDS * BAND_ROWS
#: So many document ids are sent to every executor at most (16 MB); beyond that a join by shuffle does it.
BROADCAST_IDS = 2_000_000


def probe_orders(bins: int = BINS, seed: int = 7) -> np.ndarray:
    """For each bin the order in which an empty one looks for a filled one."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(shingles: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Least hash per bin of sorted distinct shingle hashes, empty bins densified."""
    bins = len(probes)
    at = ((shingles >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    filled = np.zeros(bins, dtype=bool)
    filled[at[first]] = True
    least = np.zeros(bins, dtype=np.uint64)
    least[at[first]] = shingles[first]
    donors = probes[np.arange(bins), filled[probes].argmax(axis=1)]
    return np.where(filled, least, least[donors])


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One bucket name per band."""
    rows = values.reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for column in rows.T:
        keys = scrambled(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and the sorted distinct shingle hashes of each row, slice by slice.

    A text with fewer words is one shingle, one without words has none.
    """
    for part in hashed_texts(texts):
        runs, bounds = chained(part.words, words), part.word_bounds().tolist()
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                sets.append(np.unique(runs[a : b - words + 1]))
            else:
                sets.append(chained(part.words[a:b], b - a) if b > a else np.empty(0, np.uint64))
        yield part.first, sets


SIGNATURES = "_key long, n_shingles long, _set_a long, _set_b long, _bands array<long>"


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """Per row of ``_key, _text``: size and digest of the shingle set, and its bucket names."""
    schema = T._parse_datatype_string(SIGNATURES)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed_worker()
        probes = probe_orders()
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), words):
                digests = [
                    np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (None, None)
                    for s in sets
                ]
                bands = [band_keys(signature(s, probes)).view(np.int64) if len(s) else [] for s in sets]
                columns = [
                    batch.column(0).slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(sign, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``_node, _set`` with all shingle hashes per row of ``_key, _text``."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freed_worker()
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), words):
                values = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), values], ["_node", "_set"])

    return docs.mapInArrow(collect, "_node long, _set array<long>")


def among(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose key is (or, by ``left_anti``, is not) in the staged one-column table ``ids``."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, rows[key] == ids[ids.columns[0]], how)


def sets_of(pairs: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Staged ``_node, _set`` of every node in the staged ``pairs``."""
    nodes = stage(pairs.select(F.explode(F.array("_a", "_b")).alias("_id")).distinct(), "neardup_nodes")
    return stage(full_sets(among(docs, "_key", nodes), words), "neardup_sets")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The pairs ``_a, _b`` whose full sets are similar enough."""
    left = sets.select(F.col("_node").alias("_a"), F.col("_set").alias("_set_a"))
    right = sets.select(F.col("_node").alias("_b"), F.col("_set").alias("_set_b"))
    shared = F.size(F.array_intersect("_set_a", "_set_b")) * (100 + similar)
    both = (F.size("_set_a") + F.size("_set_b")) * similar
    return pairs.join(left, "_a").join(right, "_b").where(shared >= both).select("_a", "_b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``_node, _component`` with the least node that edges ``_a, _b`` lead to, for every node with an edge.

    Large-star and small-star rounds: every node's larger neighbours, then its smaller ones and itself,
    are tied to its least neighbour, until nothing changes. Each round is written to the shared folder.
    """
    edges = stage(edges.where("_a <> _b").select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).withColumn("_m", F.least("_m", "_u"))
        large = (
            both.where("_v > _u").join(least, "_u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
            .distinct()
        )
        large = stage(large.where("_u <> _v"), "large_star")
        down = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        tied = large.join(down, "_u").select("_u", "_v", "_m")
        small = (
            tied.select(F.col("_v").alias("_u"), F.col("_m").alias("_v"))
            .unionByName(tied.select("_u", F.col("_m").alias("_v")))
            .where("_u <> _v").distinct()
        )
        edges = stage(small, "small_star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("_u", "_v") % 1_000_003), F.sum(F.xxhash64("_v", "_u") % 998_244_353)).first()
        if now == before:
            return edges.select(F.col("_u").alias("_node"), F.col("_v").alias("_component")).unionByName(
                edges.select(F.col("_v").alias("_node"), F.col("_v").alias("_component"))
            ).distinct()
        before = now


def near_duplicates(
    docs: DataFrame,
    words: int = SHINGLE_WORDS,
    similar: int = SIMILAR,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Components of documents linked by ``100 * shared shingles >= similar * all shingles``.

    Shingles are runs of ``words`` words of the text with A-Z as a-z; a text with fewer words is one
    shingle. Returns ``key, n_shingles, component_id`` (least key that links lead to) and ``kept`` (the
    document is the least of its component). Two similar sets share a bucket with a probability of
    1 - (1 - s^4)^32: they are missed less than once in 10 million at 0.8 and in 10^10 at 0.85.

    Null texts, empty texts and texts without words have no shingles and are linked with nothing. Rows
    that share a key count as one document. Rows with a null key take no part: no component, kept. Empty
    tables give no rows; other columns are not read.
    """
    given = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    signed = stage(signatures(given, words), "neardup_signatures")
    classes = stage(
        signed.where("n_shingles > 0 AND _key IS NOT NULL").groupBy("_set_a", "_set_b").agg(F.min("_key").alias("_node")),
        "neardup_classes",
    )
    heads = signed.join(classes, ["_set_a", "_set_b"]).where("_key = _node")
    entries = stage(
        heads.select("_node", F.col("n_shingles").alias("_n"), F.explode("_bands").alias("_bucket")).distinct(),
        "neardup_entries",
    )
    buckets = stage(
        entries.groupBy("_bucket").agg(F.min("_node").alias("_a"), F.count("*").alias("_members")).where("_members > 1"),
        "neardup_buckets",
    )
    shared = stage(entries.join(buckets.select("_bucket", "_a"), "_bucket"), "neardup_shared")
    pairs = stage(shared.where("_node <> _a").select("_a", F.col("_node").alias("_b")).distinct(), "neardup_pairs")
    same_key = signed.where("n_shingles > 0").join(classes, ["_set_a", "_set_b"]).where("_key <> _node")
    sets = sets_of(pairs, given, words)
    edges = stage(confirmed(pairs, sets, similar).unionByName(_shared_keys(same_key, classes)), "neardup_edges")
    found = stage(components(edges), "neardup_components")
    more = stage(_across(shared, found, sets, similar).join(pairs, ["_a", "_b"], "left_anti"), "neardup_across")
    found = stage(components(edges.unionByName(confirmed(more, sets, similar))), "neardup_components")
    node = classes.join(found, "_node", "left").select(
        "_set_a", "_set_b", F.coalesce("_component", "_node").alias("_component")
    )
    component = F.when(F.col("_key").isNotNull(), F.coalesce("_component", "_key"))
    result = signed.join(node, ["_set_a", "_set_b"], "left").select(
        F.col("_key").alias(key), "n_shingles", component.alias("component_id")
    )
    return result.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def without_near_duplicates(
    docs: DataFrame, words: int = SHINGLE_WORDS, similar: int = SIMILAR, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each component, the one with the least key, with all columns as they were.

    Rows with null keys stay; of rows that repeat a key one stays.
    """
    found = near_duplicates(docs, words, similar, key, text)
    found = stage(found.where(F.col(key).isNotNull()), "neardup_found")
    dropped = stage(found.where("NOT kept").select(F.col(key).alias("_id")).distinct(), "neardup_dropped")
    left = among(docs, key, dropped, "left_anti")
    repeated = stage(found.groupBy(F.col(key).alias("_id")).count().where("count > 1").select("_id"), "neardup_repeated")
    if repeated.isEmpty():
        return left
    once = among(left, key, repeated).dropDuplicates([key])
    return among(left, key, repeated, "left_anti").unionByName(once)


def _shared_keys(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges between the classes of rows that have one key and different texts."""
    heads = classes.select(F.col("_node").alias("_key"))
    return rows.join(heads, "_key", "left_semi").select(F.col("_key").alias("_a"), F.col("_node").alias("_b")).distinct()


def _across(shared: DataFrame, found: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs of nodes in different components that can still be similar.

    Only buckets with several components leave such pairs. Their nodes' shingles are ordered by how few of
    these nodes hold them. Of two similar sets the first shingle in common leaves enough behind it on both
    sides, so it is among the first few of each, and its place there rules out nearly all other pairs.
    In a group of nodes with one shingle, those of the commonest component are not compared among themselves.
    """
    placed = shared.join(found, "_node", "left").select("_bucket", "_node", F.coalesce("_component", "_node").alias("_component"))
    several = (
        placed.groupBy("_bucket")
        .agg(F.min("_component").alias("_low"), F.max("_component").alias("_high"))
        .where("_low <> _high")
    )
    nodes = stage(placed.join(several.select("_bucket"), "_bucket").select("_node", "_component").distinct(), "neardup_open")
    held = stage(
        sets.dropDuplicates(["_node"]).join(nodes, "_node")
        .select("_node", "_component", F.size("_set").alias("_n"), F.explode("_set").alias("_shingle")),
        "neardup_open_shingles",
    )
    holders = held.groupBy("_shingle").agg(F.count("*").alias("_holders"))
    place = F.row_number().over(Window.partitionBy("_node").orderBy("_holders", "_shingle")) - 1
    first = (
        held.join(holders, "_shingle")
        .withColumn("_place", place)
        .where((F.col("_holders") > 1) & (100 * (F.col("_n") - F.col("_place")) >= similar * F.col("_n")))
        .select("_shingle", "_node", "_component", "_n", "_place")
    )
    first = stage(first, "neardup_first_shingles")
    commonest = (
        first.groupBy("_shingle", "_component").agg(F.count("*").alias("_rows"))
        .groupBy("_shingle").agg(F.max_by("_component", F.struct("_rows", "_component")).alias("_main"), F.count("*").alias("_parts"))
        .where("_parts > 1").select("_shingle", "_main")
    )
    open_ = first.join(commonest, "_shingle")
    left = open_.where("_component <> _main").select(
        "_shingle", *(F.col(name).alias(f"{name}_a") for name in ("_node", "_component", "_n", "_place"))
    )
    enough = similar * (F.col("_n") + F.col("_n_a"))
    can = ((100 + similar) * (F.col("_n") - F.col("_place")) >= enough) & (
        (100 + similar) * (F.col("_n_a") - F.col("_place_a")) >= enough
    )
    pairs = left.join(open_, "_shingle").where((F.col("_component") != F.col("_component_a")) & can)
    return pairs.select(F.least("_node", "_node_a").alias("_a"), F.greatest("_node", "_node_a").alias("_b")).distinct()
