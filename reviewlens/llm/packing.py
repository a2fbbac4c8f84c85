"""Operator 5: packing documents into sequences by a grouping genetic algorithm.

Texts become pieces of at most ``capacity`` ids. Pieces are dealt at random into shards of
about ``SHARD`` pieces; every shard is a bin-packing problem that several islands work on,
each with a population of its own. A crossover injects whole well-filled bins of one parent
into another, removes the bins that would repeat a document, and best-fits the documents
displaced so. After each epoch the elite of an island migrates to the next one. Bins that
stay poorly filled are opened, and their documents meet those of other shards in a next,
much smaller round, until one shard is left.

Defined cases: a null or empty text is one piece, the end id alone; a piece of ``capacity``
ids is a sequence of its own; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.tokens import encoder
from reviewlens.session import stage

END_ID = 1
SHARD = 4096


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096
    islands: int = 2
    population: int = 4
    epochs: int = 2
    generations: int = 4
    well_filled: float = 0.995


def pieces(
    docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs`` (doc_id, text)."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode_all = encoder(tokenizer).encode_all
        last = end_id.to_bytes(4, "little")
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            doc_ids, number, start, length, crc = [], [], [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, found in zip(batch.column(0).to_pylist(), encode_all(texts)):
                ids = found + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    doc_ids.append(doc_id)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc_ids, pa.int64()),
                    pa.array(number, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(bins: list[list[int]], free: list[int], items: list[int], sizes, capacity: int) -> None:
    """Put ``items`` in turn into the fullest bin that has room, or into a new one."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, room in enumerate(free):
        by_free[room].append(b)
        mask |= 1 << room
    for item in items:
        size = sizes[item]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_free[room].pop()
            if not by_free[room]:
                mask ^= 1 << room
            bins[b].append(item)
            room -= size
        else:
            b, room = len(bins), capacity - size
            bins.append([item])
            free.append(room)
        free[b] = room
        if not by_free[room]:
            mask |= 1 << room
        by_free[room].append(b)


class Island:
    """A population of packings of the same documents; the fittest comes first."""

    def __init__(self, sizes: list[int], settings: Settings, seed: int):
        self.sizes, self.settings = sizes, settings
        self.random = random.Random(seed)
        self._ranked: list[tuple[tuple[int, float], list[int]]] = []

    @property
    def members(self) -> list[list[int]]:
        return [packing for _, packing in self._ranked]

    def join(self, packings: list[list[int]]) -> None:
        """Let ``packings`` into the population, of which the fittest stay."""
        self._ranked += [(self.fitness(p), p) for p in packings]
        self._ranked.sort(key=lambda x: x[0])
        del self._ranked[self.settings.population :]

    def fitness(self, packing: list[int]) -> tuple[int, float]:
        """Fewer bins first, then bins that are rather full or empty than alike."""
        fill: dict[int, int] = {}
        for item, b in enumerate(packing):
            fill[b] = fill.get(b, 0) + self.sizes[item]
        return len(fill), -sum(f * f for f in fill.values())

    def _packed(self, bins: list[list[int]]) -> list[int]:
        packing = [0] * len(self.sizes)
        for b, items in enumerate(bins):
            for item in items:
                packing[item] = b
        return packing

    def fresh(self, spread: float) -> list[int]:
        """Best fit of the documents, largest first, with sizes blurred by ``spread``."""
        blur = [s * (1 + spread * self.random.random()) for s in self.sizes]
        order = sorted(range(len(self.sizes)), key=lambda i: (-blur[i], i))
        bins: list[list[int]] = []
        best_fit(bins, [], order, self.sizes, self.settings.capacity)
        return self._packed(bins)

    def start(self) -> None:
        spreads = [0.0] + [0.1 * k for k in range(1, self.settings.population)]
        self.join([self.fresh(s) for s in spreads])

    def _bins(self, packing: list[int]) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for item, b in enumerate(packing):
            out.setdefault(b, []).append(item)
        return list(out.values())

    def crossed(self, into: list[int], of: list[int]) -> list[int]:
        capacity = self.settings.capacity
        sizes = self.sizes
        full = self.settings.well_filled * capacity
        good = [b for b in self._bins(of) if sum(sizes[i] for i in b) >= full]
        taken = [b for b in good if self.random.random() < 0.5]
        present = {i for b in taken for i in b}
        kept, displaced = list(taken), []
        for b in self._bins(into):
            if present.isdisjoint(b) and sum(sizes[i] for i in b) >= full:
                kept.append(b)
            else:
                displaced += [i for i in b if i not in present]
        blur = 0.05 * self.random.random()
        displaced.sort(key=lambda i: -sizes[i] * (1 + blur * self.random.random()))
        bins = [list(b) for b in kept]
        free = [capacity - sum(sizes[i] for i in b) for b in bins]
        best_fit(bins, free, displaced, sizes, capacity)
        return self._packed(bins)

    def evolve(self) -> None:
        lowest = -(-sum(self.sizes) // self.settings.capacity)
        for _ in range(self.settings.generations):
            (n_bins, _), _ = self._ranked[0]
            if n_bins <= lowest:
                return
            members = self.members
            a, b = self.random.sample(range(len(members)), 2) if len(members) > 1 else (0, 0)
            self.join([self.crossed(members[a], members[b])])


_STATE = (
    "shard long, island int, rows array<long>, sizes array<int>, "
    "members array<array<int>>, migrant array<int>"
)


def _evolved(state: DataFrame, settings: Settings, epoch: int) -> DataFrame:
    """One epoch on every island, with the elite that came from its neighbour."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                island = Island([int(s) for s in row.sizes], settings, hash((row.shard, row.island, epoch)))
                island.join([[int(b) for b in m] for m in row.members])
                if not island.members:
                    island.start()
                if row.migrant is not None:
                    island.join([[int(b) for b in row.migrant]])
                island.evolve()
                out.append(island.members)
            yield frame.assign(members=out, migrant=None)

    return state.mapInPandas(run, _STATE)


def _packed_shards(items: DataFrame, settings: Settings) -> DataFrame:
    """``items`` (shard, row, length) packed: ``shard, rows, sizes, packing`` per shard."""
    shards = (
        items.groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("row", "length"))).alias("x"))
        .select(
            "shard",
            F.explode(F.array(*[F.lit(i) for i in range(settings.islands)])).alias("island"),
            F.col("x.row").alias("rows"),
            F.col("x.length").cast("array<int>").alias("sizes"),
            F.array().cast("array<array<int>>").alias("members"),
            F.lit(None).cast("array<int>").alias("migrant"),
        )
        .repartition("shard", "island")
    )
    state = stage(_evolved(shards, settings, 0), "islands")
    for epoch in range(1, settings.epochs):
        elite = state.select(
            F.col("shard").alias("to_shard"),
            ((F.col("island") + 1) % settings.islands).alias("to_island"),
            F.get("members", F.lit(0)).alias("elite"),
        )
        moved = state.join(
            elite,
            (F.col("shard") == F.col("to_shard")) & (F.col("island") == F.col("to_island")),
        ).select("shard", "island", "rows", "sizes", "members", F.col("elite").alias("migrant"))
        state = stage(_evolved(moved, settings, epoch), "islands")
    n_bins = F.size(F.array_distinct(F.get("members", F.lit(0))))
    return state.groupBy("shard").agg(
        F.min_by(
            F.struct("rows", "sizes", F.get("members", F.lit(0)).alias("packing")),
            F.struct(n_bins.alias("n"), "island"),
        ).alias("best")
    ).select("shard", "best.*")


def pack(found: DataFrame, settings: Settings = Settings(), shard_size: int = SHARD) -> DataFrame:
    """``found`` (the columns of ``pieces``) with ``sequence_id`` and ``offset``."""
    numbered = stage(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = numbered.filter(F.col("length") < settings.capacity).select("row", "length")
    n_left = left.count()
    done = None
    first_shard = 0
    while n_left:
        n_shards = max(1, round(n_left / shard_size))
        shard = F.pmod(F.xxhash64("row", F.lit(first_shard)), F.lit(n_shards)) + first_shard
        packed = stage(
            _packed_shards(left.withColumn("shard", shard), settings)
            .select("shard", F.explode(F.arrays_zip("rows", "sizes", "packing")).alias("x"))
            .select(
                "shard",
                F.col("x.rows").alias("row"),
                F.col("x.sizes").cast("long").alias("length"),
                F.col("x.packing").alias("bin"),
            ),
            "packed",
        )
        fill = packed.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        enough = F.col("fill") >= settings.well_filled * settings.capacity
        full = fill.filter(enough if n_shards > 1 else F.lit(True))
        kept = packed.join(full.drop("fill"), ["shard", "bin"])
        done = kept if done is None else done.unionByName(kept)
        if n_shards == 1:
            break
        left = stage(
            packed.join(fill.filter(~enough).drop("fill"), ["shard", "bin"]).select("row", "length"),
            "displaced",
        )
        first_shard += n_shards
        before, n_left = n_left, left.count()
        if n_left > 0.8 * before:
            # too few bins fill up for another round to help: keep them all
            shard_size *= 2
        if shard_size > 16 * SHARD:
            done = packed if first_shard == n_shards else done.unionByName(
                packed.join(fill.filter(~enough).drop("fill"), ["shard", "bin"])
            )
            break
    alone = numbered.filter(F.col("length") >= settings.capacity).withColumns(
        {"sequence_id": -F.col("row") - 1, "offset": F.lit(0).cast("long")}
    )
    if done is None:
        return alone.drop("row")
    # a bin holds at most ``capacity`` documents, for none is empty
    order = F.sort_array(F.collect_list(F.struct("row", "length")))
    placed = (
        done.groupBy("shard", "bin")
        .agg(order.alias("x"))
        .select(
            (F.col("shard") * (1 << 20) + F.col("bin")).alias("sequence_id"),
            F.col("x.row").alias("rows"),
            F.transform(
                F.col("x.length"),
                lambda n, i: F.aggregate(
                    F.slice(F.col("x.length"), F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + y
                ),
            ).alias("offsets"),
        )
        .select("sequence_id", F.explode(F.arrays_zip("rows", "offsets")).alias("y"))
        .select("sequence_id", F.col("y.rows").alias("row"), F.col("y.offsets").alias("offset"))
    )
    shared = numbered.filter(F.col("length") < settings.capacity).join(placed, "row")
    return shared.unionByName(alone).drop("row")
