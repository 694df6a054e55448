"""Exact top-k by inner product with sorted lists read in turn and no random access.

Candidates are packed into blocks with one sorted list per component. For a batch of queries the lists
of a block are read to the same depth, from the end that the sign of the query's component asks for.
What has been read gives each candidate a lower and an upper bound of its score: an unread component
lies between the list's far end and the last value read. Reading stops for a query once no candidate
outside its k best lower bounds can reach them; then the scores of those k are completed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.staging import stage

BLOCK_ROWS = 4096
QUERY_ROWS = 512
#: Shares of the lists that are read one after the other.
DEPTHS = (0.25, 0.5, 1.0)


def sorted_lists(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each entry within its component from the top, and the components in falling order."""
    order = np.argsort(-matrix, axis=0, kind="stable")
    ranks = np.empty_like(order)
    np.put_along_axis(ranks, order, np.arange(len(matrix))[:, None], axis=0)
    return ranks, np.take_along_axis(matrix, order, axis=0)


def top_of_block(
    queries: np.ndarray, query_ids: np.ndarray, matrix: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its position, the ids and the scores of its k best in the block, ties to smaller ids.

    ``ids`` rises; all numbers are whole, so sums are exact.
    """
    n = len(ids)
    ranks, falling = sorted_lists(matrix)
    up, down = np.maximum(queries, 0.0), np.minimum(queries, 0.0)
    open_ = np.arange(len(queries))
    for share in DEPTHS:
        depth = min(n, max(1, int(np.ceil(n * share))))
        # entries read from the top by positive, from the bottom by negative query components
        top, bottom = ranks < depth, ranks >= n - depth
        high, low = np.where(top, matrix, 0.0), np.where(bottom, matrix, 0.0)
        positive, negative = up[open_], down[open_]
        read = positive @ high.T + negative @ low.T
        if depth < n:
            unread_top, unread_bottom = (~top).astype(float), (~bottom).astype(float)
            upper = read + (positive * falling[depth - 1]) @ unread_top.T + (negative * falling[n - depth]) @ unread_bottom.T
            lower = read + (positive * falling[-1]) @ unread_top.T + (negative * falling[0]) @ unread_bottom.T
        else:
            upper, lower = read, read
        own = ids[None, :] == query_ids[open_][:, None]
        lower[own] = -np.inf
        upper[own] = -np.inf
        size = np.minimum(k, n - own.sum(axis=1))
        most = min(k, n)
        cut = -np.partition(-lower, most - 1, axis=1)[:, most - 1]
        # done where nobody else can reach the k-th lower bound; one that could tie may still win by its id
        done = (upper >= np.maximum(cut, -1e300)[:, None]).sum(axis=1) <= size if depth < n else np.ones(len(open_), bool)
        for i in np.flatnonzero(done):
            # resolve: complete the scores of those that qualify
            best, q = _largest(lower[i], int(size[i])), open_[i]
            scores = lower[i][best] if depth == n else matrix[best] @ queries[q]
            order = np.lexsort((ids[best], -scores))
            yield int(q), ids[best][order], scores[order]
        open_ = open_[~done]
        if not len(open_):
            return


def _largest(values: np.ndarray, size: int) -> np.ndarray:
    """Positions of the ``size`` largest, equal ones by position."""
    if not size:
        return np.empty(0, np.int64)
    cut = np.partition(values, len(values) - size)[len(values) - size]
    above = np.flatnonzero(values > cut)
    return np.concatenate([above, np.flatnonzero(values == cut)[: size - len(above)]])


def _packed(rows: DataFrame, part: str, size: int, spread, name: str) -> tuple[DataFrame, int]:
    """Rows ``_id, _vector`` in packs of about ``size``: ``part, _ids, _values``; and the number of packs."""
    parts = max(1, -(-rows.count() // size))
    keyed = rows.withColumn(part, F.pmod(spread, F.lit(parts)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_id")
        width = max(map(len, frame["_vector"]))
        matrix = np.zeros((len(frame), width))
        for i, vector in enumerate(frame["_vector"]):
            matrix[i, : len(vector)] = vector
        return pd.DataFrame(
            {part: [frame[part].iloc[0]], "_ids": [frame["_id"].to_numpy(np.int64).tobytes()], "_values": [matrix.tobytes()]}
        )

    packed = keyed.groupBy(part).applyInPandas(pack, f"{part} int, _ids binary, _values binary")
    return stage(packed, name), parts


def top_scores(
    vectors: DataFrame,
    k: int = 20,
    scale: float = 64.0,
    query_step: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``. Queries are the rows whose key is divisible by
    ``query_step``, candidates all rows with another key; ties go to the smaller key. Each pair of a
    block of candidates and a batch of queries is one task's work, and a second step merges the k best
    of the blocks, at most k rows per block and query, and Spark keeps the k best of a query in each task before it shuffles.

    Rows with a null key, a null vector, or null or non-finite components take no part. Shorter vectors
    count as filled up with 0. Repeated keys are candidates each on their own; a repeated query is
    answered once, for the smallest of its vectors. Empty tables give no rows; other columns are not read.
    Scores are exact while they stay below 2^53.
    """
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf")))
    )
    rows = stage(
        vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
            F.col(key).cast("long").alias("_id"), scaled.alias("_vector")
        ),
        "topk_vectors",
    )
    spread = F.xxhash64("_id", "_vector")
    blocks, _ = _packed(rows, "_block", block_rows, spread, "topk_blocks")
    asked = rows.where(F.col("_id") % query_step == 0).groupBy("_id").agg(F.min("_vector").alias("_vector"))
    batches, n_batches = _packed(asked, "_batch", query_rows, spread, "topk_queries")
    batches = batches.select("_batch", F.col("_ids").alias("_query_ids"), F.col("_values").alias("_query_values"))
    pairs = (
        blocks.withColumn("_batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
        .join(batches, "_batch")
        .repartition("_block", "_batch")
    )

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                ids, query_ids = np.frombuffer(row["_ids"], np.int64), np.frombuffer(row["_query_ids"], np.int64)
                matrix = np.frombuffer(row["_values"]).reshape(len(ids), -1)
                queries = np.frombuffer(row["_query_values"]).reshape(len(query_ids), -1)
                width = max(matrix.shape[1], queries.shape[1])
                matrix = np.pad(matrix, ((0, 0), (0, width - matrix.shape[1])))
                queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
                found = list(top_of_block(queries, query_ids, matrix, ids, k)) if width else []
                if not width:
                    found = [(q, ids[ids != i][:k], np.zeros(len(ids[ids != i][:k]))) for q, i in enumerate(query_ids)]
                yield pd.DataFrame(
                    {
                        "query_id": [query_ids[q] for q, _, _ in found],
                        "ids": [i.tolist() for _, i, _ in found],
                        "scores": [s.astype(np.int64).tolist() for _, _, s in found],
                    }
                )

    found = pairs.select("_ids", "_values", "_query_ids", "_query_values").mapInPandas(
        search, "query_id long, ids array<long>, scores array<long>"
    )

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("_hit"))
        .select("query_id", F.col("_hit.ids").alias("vec_id"), F.col("_hit.scores").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
