"""Integer vectors in blocks of columns, and the cells in which queries meet candidates.

Both sides are cut by hash: candidates into parts of blocks, each block a row that holds its
vectors in vertical layout (all values of one dimension together), queries into chunks. A
cell is one chunk with one part. Chunks and parts are sent as a few large rows, so what
crosses the shuffle is the vectors themselves, copied once for each chunk or part they meet.

Vectors of unequal length are filled with zeros, which leaves inner products as they are.
Sums are exact: 64-bit floats while they can't pass 2^53, else Python integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import stage

BLOCK_ROWS = 16_384
#: Blocks that a cell goes through one after the other.
PART_ROWS = 16 * BLOCK_ROWS
CHUNK_ROWS = 4096
#: Chunks made at least, so that few queries still keep many tasks busy.
LEAST_CHUNKS = 16


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component x, worked out as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and no component is null or not finite."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")),
    )
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


@dataclass
class Block:
    """``ids`` and ``columns`` (a row for each dimension) of some vectors."""

    ids: np.ndarray
    labels: np.ndarray
    columns: np.ndarray


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A row for each vector, as 64-bit integers, filled with zeros to ``width``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def exact(columns: np.ndarray, queries: np.ndarray) -> type:
    """The type in which no sum of products of these integers loses a digit."""
    most = [max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))) for m in (columns, queries)]
    return np.float64 if most[0] * most[1] * max(len(columns), 1) < 1 << 52 else object


BLOCK_SCHEMA = "group long, part long, rows long, width int, ids binary, labels binary, columns binary"


def _block(group: int, part: int, table: pa.Table) -> pa.Table:
    width = int(pa.compute.max(pa.compute.list_value_length(table["vector"])).as_py() or 0)
    values = matrix(table["vector"], width)
    plain = [table[c].to_numpy().astype("<i8").tobytes() for c in ("id", "label")]
    data = [[group], [part], [table.num_rows], [width], [plain[0]], [plain[1]], [values.T.astype("<i8").tobytes()]]
    names = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.binary()] * 3
    return pa.table([pa.array(d, k) for d, k in zip(data, kinds)], names=names)


def sizes(rows: DataFrame) -> DataFrame:
    """Rows of each group; written, so that the planner knows how small the table is."""
    return stage(rows.groupBy("group").agg(F.count("*").alias("n")), "group-sizes")


def one_of_each(rows: DataFrame) -> DataFrame:
    """``rows`` (id, label, vector) with one row for each id, the smallest, written."""
    least = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return stage(least.select("id", "row.*"), "vectors")


@dataclass(frozen=True)
class Sizes:
    """How large blocks, parts and chunks are; results don't depend on it."""

    block_rows: int = BLOCK_ROWS
    part_rows: int = PART_ROWS
    chunk_rows: int = CHUNK_ROWS
    least_chunks: int = LEAST_CHUNKS

    def blocks(self, n: Column) -> Column:
        return F.ceil(n / self.block_rows).cast("long")

    def parts(self, n: Column) -> Column:
        return F.ceil(self.blocks(n) / self.blocks_in_part).cast("long")

    @property
    def blocks_in_part(self) -> int:
        return max(self.part_rows // self.block_rows, 1)

    def chunks(self, n: Column) -> Column:
        wanted = F.greatest(F.lit(self.least_chunks), F.ceil(n / self.chunk_rows))
        return F.least(n, wanted).cast("long")


def in_cells(
    queries: DataFrame,
    candidates: DataFrame,
    work: Callable[[pa.Table, Iterator[Block]], pa.Table],
    schema: str,
    cut: Sizes = Sizes(),
) -> DataFrame:
    """``work`` of every chunk of ``queries`` (group, id, vector, ...) with the blocks of every part of
    the ``candidates`` (group, id, label, vector) of the same group; ``schema`` is that of its rows."""
    candidate_sizes, query_sizes = sizes(candidates), sizes(queries)
    per_part = cut.blocks_in_part

    def build(key: tuple, table: pa.Table) -> pa.Table:
        group, block = (k.as_py() for k in key)
        return _block(group, block // per_part, table)

    block = F.pmod(F.xxhash64("id", F.lit(5)), cut.blocks(F.col("n")))
    dealt = candidates.join(candidate_sizes, "group").select("group", block.alias("block"), "id", "label", "vector")
    made = stage(dealt.groupBy("group", "block").applyInArrow(build, BLOCK_SCHEMA), "vector-blocks")
    chunk = F.pmod(F.xxhash64("id", F.lit(7)), cut.chunks(F.col("n")))
    row = F.struct(*[F.col(f"`{c}`") for c in queries.columns if c != "group"])
    packed = stage(
        queries.join(query_sizes, "group")
        .groupBy("group", chunk.alias("chunk"))
        .agg(F.collect_list(row).alias("queries")),
        "query-chunks",
    )

    def numbers(upto: Column) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), upto - 1))

    # a block is copied for each chunk it meets and a chunk for each part
    asking = packed.join(candidate_sizes, "group").select(
        "group", "chunk", numbers(cut.parts(F.col("n"))).alias("part"), "queries"
    )
    asked = made.join(query_sizes, "group").select(
        *made.columns, numbers(cut.chunks(F.col("n"))).alias("chunk")
    )
    cells = ["group", "chunk", "part"]
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64()] * len(names)

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        rows = left["queries"].combine_chunks().flatten()

        def each() -> Iterator[Block]:
            for at in range(right.num_rows):
                width = right["width"][at].as_py()
                ids, labels, columns = (
                    np.frombuffer(right[c][at].as_buffer(), "<i8") for c in ("ids", "labels", "columns")
                )
                yield Block(ids, labels, columns.reshape(width, len(ids)))

        return work(pa.Table.from_batches([pa.RecordBatch.from_struct_array(rows)]), each())

    return asking.groupBy(*cells).cogroup(asked.groupBy(*cells)).applyInArrow(meet, schema)


def best_first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], int)
    return np.lexsort((ids, -scores))[:k]


def same_width(block: Block, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's columns and the queries, filled to one width, in a type that is exact for them."""
    width = max(len(block.columns), queries.shape[1])
    columns = np.zeros((width, len(block.ids)), np.int64)
    columns[: len(block.columns)] = block.columns
    filled = np.zeros((len(queries), width), np.int64)
    filled[:, : queries.shape[1]] = queries
    kind = exact(columns, filled)
    return columns.astype(kind), filled.astype(kind)


def query_matrix(queries: pa.Table) -> np.ndarray:
    lengths = queries["vector"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    return matrix(queries["vector"], int(lengths.max(initial=0)))
