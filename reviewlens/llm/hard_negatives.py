"""Operator 12: hard negatives by Fagin's threshold algorithm over sorted dimensions.

Every block of candidates has a sorted list for each dimension. An anchor reads its lists from
the end where its sign makes products large, all to the same depth. What it meets first is
scored at once by random access, as an exact integer product. The sum of the anchor's products
with the values at the present depth is the threshold: nothing unmet can score more. A window is
settled when the threshold is strictly below its k-th best score (or below its lower end), and
the anchor stops when all its windows are.

First each anchor finds its positives among the rows of its label, with one open window; then
each positive opens a window of scores, from a share of its own score up to it, for rows of other
labels. Cells keep the k best of each window; a ranking over the cells' rows gives the result.

Defined cases: rows without id or label, or whose vector is null or holds a null or non-finite
component, take no part; ids are meant to be unique, and of rows that share one that with the
smallest label, then vector, counts; an anchor without positives, and a positive whose window
is empty, give no rows; a positive with a negative score has an empty window; vectors are
filled with zeros to a longer one's length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
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
from reviewlens.session import stage

K = 5
FACTOR = 256
EVERY = 100
#: The lower end of a window, in hundredths of the positive's score.
LOW = 80
#: Depth of the first round; each round is twice as deep as the one before.
DEPTH = 32


class SortedLists:
    """A block's candidates sorted by each dimension, with rows for random access."""

    def __init__(self, columns: np.ndarray):
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.order, axis=1)
        self.rows = np.ascontiguousarray(columns.T)

    def rounds(self, anchor: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Places met for the first time, their scores, and the threshold after each round."""
        n = len(self.rows)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = np.zeros(n, bool)
        begin = 0
        while begin < n:
            end = min(begin + depth, n) if len(up) or len(down) else n
            if end < n:
                places = [self.order[up, n - end : n - begin].ravel(), self.order[down, begin:end].ravel()]
                fresh = np.zeros(n, bool)
                fresh[np.concatenate(places)] = True
                new = np.flatnonzero(fresh & ~met)
                last = anchor[up] @ self.values[up, n - end] + anchor[down] @ self.values[down, end - 1]
            else:
                new, last = np.flatnonzero(~met), -np.inf
            met[new] = True
            yield new, self.rows[new] @ anchor, last
            begin, depth = end, depth * 2


class Windows:
    """The ``k`` best of each window of scores of an anchor."""

    def __init__(self, ends: list[tuple[float, float]], k: int):
        self.ends, self.k = ends, k
        self.scores = [np.empty(0)] * len(ends)
        self.ids = [np.empty(0, np.int64)] * len(ends)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w, (low, high) in enumerate(self.ends):
            inside = (scores >= low) & (scores <= high)
            if len(self.scores[w]) == self.k:
                inside &= scores >= self.scores[w][-1]
            if inside.any():
                both = np.concatenate([self.scores[w], scores[inside]])
                names = np.concatenate([self.ids[w], ids[inside]])
                best = best_first(both, names, self.k)
                self.scores[w], self.ids[w] = both[best], names[best]

    def settled(self, threshold: float) -> bool:
        return all(
            threshold < low or len(s) == self.k and threshold < s[-1]
            for (low, _), s in zip(self.ends, self.scores)
        )


def mine_cell(
    anchors: pa.Table, candidates: Iterator[Block], same_label: bool, k: int, low: int, depth: int
) -> pa.Table:
    """``id, positive, positive_score, found, score``: the ``k`` best rows of each window."""
    ids, labels, asked = anchors["id"].to_numpy(), anchors["label"].to_numpy(), query_matrix(anchors)
    positives = [[(-1, 0)]] * len(ids) if same_label else [
        [(p["id"], p["score"]) for p in one] for one in anchors["positives"].to_pylist()
    ]
    windows = [
        # ends in whole numbers; the lower one rounded up
        Windows([(-np.inf, np.inf) if same_label else (-(-low * s // 100), s) for _, s in one], k)
        for one in positives
    ]
    for block in candidates:
        columns, filled = same_width(block, asked)
        lists = SortedLists(columns)
        for a, own in enumerate(ids):
            fits = (block.ids != own) & ((block.labels == labels[a]) == same_label)
            for new, scores, threshold in lists.rounds(filled[a], depth):
                good = fits[new]
                windows[a].add(scores[good], block.ids[new[good]])
                if windows[a].settled(threshold):
                    break
    out: list[list[int]] = [[], [], [], [], []]
    for a, own in enumerate(ids):
        for (positive, score), names, scores in zip(positives[a], windows[a].ids, windows[a].scores):
            for name, found in zip(names, scores):
                for column, value in zip(out, (own, positive, score, name, found)):
                    column.append(int(value))
    return pa.table([pa.array(c, pa.int64()) for c in out], names=CELL.replace(" long", "").split(", "))


CELL = "id long, positive long, positive_score long, found long, score long"


def _place(by: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "found"))


def mine(
    embeddings: DataFrame,
    label: Column,
    k: int = K,
    factor: int = FACTOR,
    every: int = EVERY,
    low: int = LOW,
    depth: int = DEPTH,
    cut: Sizes = Sizes(),
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of
    ``embeddings`` (vec_id, embedding) whose id is divisible by ``every``; ``label`` is a row's label."""
    vectors = one_of_each(
        embeddings.filter(F.col("vec_id").isNotNull() & label.isNotNull() & usable(F.col("embedding"))).select(
            F.col("vec_id").cast("long").alias("id"),
            label.cast("long").alias("label"),
            scaled(F.col("embedding"), factor).alias("vector"),
        )
    )
    anchors = vectors.filter(F.col("id") % every == 0)

    def near(asked: pa.Table, found: Iterator[Block]) -> pa.Table:
        return mine_cell(asked, found, True, k, low, depth)

    def far(asked: pa.Table, found: Iterator[Block]) -> pa.Table:
        return mine_cell(asked, found, False, k, low, depth)

    # rows of one label meet only each other, rows of all labels meet in one group
    of_label = [df.withColumn("group", F.col("label")) for df in (anchors, vectors)]
    found = in_cells(*of_label, near, CELL, cut)
    positives = (
        found.withColumn("rank", _place(["id"]))
        .filter(F.col("rank") <= k)
        .groupBy("id")
        .agg(F.collect_list(F.struct(F.col("found").alias("id"), "score")).alias("positives"))
    )
    # always 0, but not a literal: the planner would take a literal out of the join keys
    zero = F.pmod(F.col("id"), F.lit(1).cast("long"))
    asking = stage(anchors.join(positives, "id"), "anchors").withColumn("group", zero)
    found = in_cells(asking, vectors.withColumn("group", zero), far, CELL, cut)
    return (
        found.withColumn("rank", _place(["id", "positive"]))
        .filter(F.col("rank") <= k)
        .select(
            F.col("id").alias("anchor_id"),
            F.col("positive").alias("positive_id"),
            "rank",
            F.col("found").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
