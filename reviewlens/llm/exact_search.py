"""Operator 11: exact search for the largest inner products, by branch and bound over columns.

Vectors are turned into integers and kept in vertical layout. A query's products grow by a
few dimensions at a time. What a candidate can still gain is at most the product of the
lengths of both rests (their remaining mass); candidates whose bound falls below the query's
k-th best so far are dropped, and the survivors are compacted before the next dimensions are
added. Each cell keeps the k best of each query; a ranking over the cells' rows gives the
result. Bounds only drop candidates that are surely worse; ties stay.

Defined cases: rows without id, or whose vector is null or holds a null or non-finite
component, take no part; ids are meant to be unique, and of rows that share one the smallest
vector counts; a vector is filled with zeros to a longer one's length, so an empty one has
product 0 with all; other columns are ignored; a product beyond 64 bits ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.llm.vectors import (
    Block,
    Sizes,
    best_first,
    in_cells,
    one_of_each,
    query_matrix,
    same_width,
    scaled,
    usable,
)

K = 20
FACTOR = 64
EVERY = 20
#: Dimensions added before the bounds are looked at again.
STEP = 8


def survivors(
    query: np.ndarray, columns: np.ndarray, rests: list[np.ndarray], allowed: np.ndarray, k: int, least: float, step: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and products of all candidates that may be among the ``k`` best.

    ``rests[j]`` holds the lengths of the block's vectors from dimension ``j * step`` on,
    ``allowed`` the places to look at, ``least`` a product that ``k`` others are known to reach.
    """
    alive, sums = allowed, np.zeros(len(allowed), columns.dtype)
    for at in range(0, len(columns), step):
        part = columns[at : at + step]
        sums = sums + query[at : at + step] @ (part if len(alive) == part.shape[1] else part[:, alive])
        rest = query[at + step :].astype(float)
        if not len(rest) or len(alive) <= k:
            continue
        reach = np.sqrt(rest @ rest) * (1 + 1e-9) * rests[at // step + 1][alive] + 1e-6
        now = sums.astype(float)
        if least == -np.inf:
            # at least k candidates reach the k-th best of the lower bounds
            bound = np.floor(np.partition(now - reach, len(alive) - k)[len(alive) - k])
        else:
            bound = least
        good = now + reach >= bound
        if not good.all():
            alive, sums = alive[good], sums[good]
    return alive, sums


def best_in_cell(queries: pa.Table, candidates: Iterator[Block], k: int, step: int) -> pa.Table:
    """The ``k`` best of each query among the blocks of a cell."""
    ids = queries["id"].to_numpy()
    asked = query_matrix(queries)
    scores = [np.empty(0)] * len(ids)
    found = [np.empty(0, np.int64)] * len(ids)
    for block in candidates:
        columns, filled = same_width(block, asked)
        squares = columns.astype(float) ** 2
        rests = [np.sqrt(squares[at:].sum(axis=0)) for at in range(0, len(columns) + step, step)]
        for q, own in enumerate(ids):
            least = float(scores[q][-1]) if len(scores[q]) == k else -np.inf
            allowed = np.flatnonzero(block.ids != own)
            places, sums = survivors(filled[q], columns, rests, allowed, k, least, step)
            keep = sums >= least
            both = np.concatenate([scores[q], sums[keep]])
            names = np.concatenate([found[q], block.ids[places[keep]]])
            best = best_first(both, names, k)
            scores[q], found[q] = both[best], names[best]
    return pa.table(
        [
            pa.array(np.repeat(ids, [len(f) for f in found]), pa.int64()),
            pa.array(np.concatenate(found), pa.int64()),
            pa.array([int(s) for one in scores for s in one], pa.int64()),
        ],
        names=["query_id", "vec_id", "score"],
    )


def top_k(
    embeddings: DataFrame, k: int = K, factor: int = FACTOR, every: int = EVERY, step: int = STEP, cut: Sizes = Sizes()
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``embeddings`` (vec_id, embedding) whose
    id is divisible by ``every`` the ``k`` rows with the largest products."""
    vectors = one_of_each(
        embeddings.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("id"),
            F.lit(0).cast("long").alias("label"),
            scaled(F.col("embedding"), factor).alias("vector"),
        )
    ).withColumn("group", F.col("label"))
    queries = vectors.filter(F.col("id") % every == 0).drop("label")

    def work(asked: pa.Table, found: Iterator[Block]) -> pa.Table:
        return best_in_cell(asked, found, k, step)

    found = in_cells(queries, vectors, work, "query_id long, vec_id long, score long", cut)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
