"""Operator 8: documents whose shingle sets overlap, by T-occurrence search.

1. Copies share a digest of their words; a class is such a group of equal word sequences.
2. A document with a partner shares at least ``threshold`` of its shingles with others. Tasks
   deal the shingles of blocks of documents out by hash range, each once per block, and get
   back how many of a document's shingles occur elsewhere. All others have no partner.
3. One text of every class that is left is shingled again; blocks learn in the same way in how
   many classes each shingle occurs. Ordered by rarity, the first n - T + 1 shingles of a
   class must contain one of any partner's; classes connected by such shingles are a family.
4. Within a family, in tiles of bounded size, every class is searched in the inverted lists of
   the others (DivideSkip): the short lists are merged, the long ones are probed by bisection
   for what the merge left, and overlaps of at least T are links. Links form components.

Copies are never paired. A tile reports a spanning forest of its links, and for each class how
many documents its links lead to.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are their
own component; a row without an id takes part, but a component is named by the smallest id
in it (null if there is none); repeated rows are copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import components
from reviewlens.llm.native import BLANKS, lower_ascii
from reviewlens.llm.row_places import with_ids
from reviewlens.llm.shingles import SIZE, shingle_set
from reviewlens.session import stage


@dataclass(frozen=True)
class Settings:
    #: Jaccard similarity from which two documents link, in hundredths.
    percent: int = 80
    shingle: int = SIZE
    #: Bytes of text in a block, and shingles that a task sorts at once.
    block_bytes: int = 8_000_000
    bucket_shingles: int = 2_000_000
    #: Classes of a family that are searched in one task.
    tile: int = 1024


def digest(text: bytes | None) -> bytes | None:
    words = (text or b"").lower().split()
    return hashlib.md5(b" ".join(words)).digest() if words else None


def bucket_of(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the token, so sorted tokens are in order of buckets."""
    return ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


_DEALT = "bucket long, block string, kind int, tokens binary, docs binary"
_LOCAL = pa.schema(
    [("bucket", pa.int64()), ("block", pa.string()), ("kind", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary())]
)
_SEEN = pa.schema(
    [("doc_id", pa.int64()), ("class", pa.binary()), ("n_shingles", pa.int64()), ("shared", pa.int64())]
)
_ONCE, _OFTEN, _OWN = 0, 1, 2


def _dealt(docs: DataFrame, buckets: int, settings: Settings) -> DataFrame:
    """The shingles of blocks of documents by hash range, and a row about the block itself."""

    def block_rows(block: str, ids: list, texts: list[bytes | None]) -> pa.RecordBatch:
        digests = [digest(t) for t in texts]
        first: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        of: list[int] = []  # the set of each document
        for text, key in zip(texts, digests):
            if key is None:
                of.append(-1)
            elif key in first:
                of.append(first[key])
            else:
                first[key] = len(sets)
                of.append(len(sets))
                sets.append(shingle_set(text, settings.shingle))
        sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        distinct, back, times = np.unique(tokens, return_inverse=True, return_counts=True)
        once = times[back] == 1
        shared_here = np.bincount(owner[~once], minlength=len(sets))
        rows: list[tuple] = []
        for kind, t, o in ((_ONCE, tokens[once], owner[once]), (_OFTEN, distinct[times > 1], None)):
            at = bucket_of(t, buckets)
            order = np.argsort(at, kind="stable")
            t, at = t[order], at[order]
            o = None if o is None else o[order].astype("<u2")
            cuts = np.searchsorted(at, np.arange(buckets + 1, dtype=np.uint64))
            low = t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            for k in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[k], cuts[k + 1])
                rows.append(
                    (int(k), block, kind, low[part].tobytes(), b"" if o is None else o[part].tobytes())
                )
        own = {
            "ids": pa.array(ids, pa.int64()),
            "class": pa.array(digests, pa.binary()),
            "set": pa.array(of, pa.int32()),
            "n": pa.array([int(sizes[k]) if k >= 0 else 0 for k in of], pa.int64()),
            "here": pa.array([int(shared_here[k]) if k >= 0 else 0 for k in of], pa.int64()),
        }
        sink = pa.BufferOutputStream()
        table = pa.table(own)
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        about = -1 - int.from_bytes(hashlib.md5(block.encode()).digest()[:3], "little")
        rows.append((about, block, _OWN, sink.getvalue().to_pybytes(), b""))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows), _LOCAL)], schema=_LOCAL
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[bytes | None] = []
        held = count = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                held += len(text or b"")
                if held >= settings.block_bytes or len(ids) >= 60_000:
                    yield block_rows(f"{part}-{count}", ids, texts)
                    ids, texts, held, count = [], [], 0, count + 1
        if ids:
            yield block_rows(f"{part}-{count}", ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(deal, _DEALT)


def _forty(data: bytes) -> np.ndarray:
    """40-bit numbers as 64-bit ones."""
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").reshape(-1)


def _found_elsewhere(table: pa.Table) -> pa.Table:
    """For a hash range: the documents of each block whose shingles other blocks hold too."""
    kinds = table.column("kind").to_pylist()
    if kinds[0] == _OWN:
        return table
    tokens = [_forty(x.as_py()) for x in table.column("tokens")]
    _, back, times = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = times[back] > 1
    rows: list[tuple] = []
    at = 0
    for block, kind, t, docs in zip(
        table.column("block").to_pylist(), kinds, tokens, table.column("docs")
    ):
        if kind == _ONCE:
            owners = np.frombuffer(docs.as_py(), "<u2")[shared[at : at + len(t)]]
            if len(owners):
                rows.append((0, block, _ONCE, b"", owners.tobytes()))
        at += len(t)
    columns = zip(*rows) if rows else [[]] * len(_LOCAL)
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _LOCAL)], schema=_LOCAL)


def _counted(table: pa.Table) -> pa.Table:
    """For a block: a row per document with its shingles and how many are shared."""
    own = None
    owners = [np.empty(0, np.int64)]
    for kind, tokens, docs in zip(
        table.column("kind").to_pylist(), table.column("tokens"), table.column("docs")
    ):
        if kind == _OWN:
            own = pa.ipc.open_stream(tokens.as_py()).read_all()
        else:
            owners.append(np.frombuffer(docs.as_py(), "<u2").astype(np.int64))
    of = own.column("set").to_numpy()
    counts = np.bincount(np.concatenate(owners), minlength=max(int(of.max(initial=-1)) + 1, 1))
    shared = own.column("here").to_numpy() + np.where(of >= 0, counts[np.maximum(of, 0)], 0)
    return pa.Table.from_arrays(
        [own.column("ids"), own.column("class"), own.column("n"), pa.array(shared, pa.int64())],
        schema=_SEEN,
    )


def shared_counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, class, n_shingles, shared`` of every row: how many shingles other word
    sequences (or copies in other blocks) hold as well. May count too many, never too few."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, round(size / 6 / settings.bucket_shingles))
    found = (
        _dealt(docs, buckets, settings)
        .groupBy("bucket")
        .applyInArrow(_found_elsewhere, _DEALT)
    )
    return found.groupBy("block").applyInArrow(
        _counted, "doc_id long, class binary, n_shingles long, shared long"
    )


def class_sets(docs: DataFrame, wanted: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``class, n, tokens`` (sorted 64-bit hashes), ``copies`` for ``wanted`` (doc_id, class, copies)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                keys, sizes, sets, copies = [], [], [], []
                for text, key, n in zip(part.column(0).cast(pa.binary()), part.column(1), part.column(2).to_pylist()):
                    text = text.as_py()
                    if digest(text) == key.as_py():
                        found = shingle_set(text, settings.shingle)
                        keys.append(key.as_py())
                        sizes.append(len(found))
                        sets.append(found.astype("<u8").tobytes())
                        copies.append(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array(sizes, pa.int32()),
                        pa.array(sets, pa.binary()),
                        pa.array(copies, pa.int64()),
                    ],
                    names=["class", "n", "tokens", "copies"],
                )

    asked = wanted.select(F.col("doc_id").alias("_wanted"), "class", "copies")
    # few texts are wanted; the others stay where they are read
    found = with_ids(docs.select("doc_id", "text"), wanted.select("doc_id"))
    return (
        found.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(asked, F.col("doc_id").eqNullSafe(F.col("_wanted")))
        .select("text", "class", "copies")
        .mapInArrow(read, "class binary, n int, tokens binary, copies long")
        .dropDuplicates(["class"])
    )


_BLOCK = "block string, nodes array<long>, tokens array<binary>"


def _blocks(sets: DataFrame, settings: Settings) -> DataFrame:
    """Sets with a number each (``node``), many to a row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, nodes, sets, count = 0, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{part}-{count}"]),
                    pa.array([nodes], pa.list_(pa.int64())),
                    pa.array([sets], pa.list_(pa.binary())),
                ],
                names=["block", "nodes", "tokens"],
            )

        for batch in batches:
            for node, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                nodes.append(node)
                sets.append(tokens.as_py())
                held += len(sets[-1])
                if held >= settings.block_bytes:
                    yield row()
                    held, nodes, sets, count = 0, [], [], count + 1
        if nodes:
            yield row()

    return sets.select("node", "tokens").mapInArrow(gather, _BLOCK)


def rare_prefixes(sets: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``token, node``: the shared shingles among the rarest n - T + 1 of each set."""
    blocks = stage(_blocks(sets, settings), "set-blocks")
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, round(total / settings.bucket_shingles))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sets_ in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                tokens, times = np.unique(
                    np.concatenate([np.frombuffer(s, "<u8") for s in sets_]), return_counts=True
                )
                cuts = np.searchsorted(
                    bucket_of(tokens, buckets), np.arange(buckets + 1, dtype=np.uint64)
                )
                rows = [
                    (int(k), block, tokens[cuts[k] : cuts[k + 1]].tobytes(), times[cuts[k] : cuts[k + 1]].astype("<u4").tobytes())
                    for k in np.flatnonzero(np.diff(cuts))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.binary(), pa.binary()))],
                    names=["bucket", "block", "tokens", "times"],
                )

    def total_times(table: pa.Table) -> pa.Table:
        tokens = [np.frombuffer(x.as_py(), "<u8") for x in table.column("tokens")]
        times = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("times")])
        distinct, back = np.unique(np.concatenate(tokens), return_inverse=True)
        sums = np.bincount(back, weights=times, minlength=len(distinct)).astype("<u4")[back]
        cuts = np.cumsum([0] + [len(t) for t in tokens])
        return pa.table(
            {
                "bucket": table.column("bucket"),
                "block": table.column("block"),
                "times": pa.array([sums[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            }
        )

    counted = (
        blocks.mapInArrow(deal, "bucket long, block string, tokens binary, times binary")
        .groupBy("bucket")
        .applyInArrow(total_times, "bucket long, block string, times binary")
    )
    percent = settings.percent

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        out_tokens, out_nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        parts = sorted(zip(right.column("bucket").to_pylist(), right.column("times").to_pylist()))
        for nodes, sets_ in zip(left.column("nodes").to_pylist(), left.column("tokens").to_pylist()):
            arrays = [np.frombuffer(s, "<u8") for s in sets_]
            distinct = np.unique(np.concatenate(arrays))
            times = np.frombuffer(b"".join(p for _, p in parts), "<u4")
            for node, tokens in zip(nodes, arrays):
                df = times[np.searchsorted(distinct, tokens)]
                n = len(tokens)
                need = -(-percent * n // 100)
                order = np.lexsort((tokens, df))[: n - need + 1]
                rare = tokens[order[df[order] > 1]]
                out_tokens.append(rare.view(np.int64))
                out_nodes.append(np.full(len(rare), node, np.int64))
        return pa.table({"token": np.concatenate(out_tokens), "node": np.concatenate(out_nodes)})

    return (
        blocks.groupBy("block")
        .cogroup(counted.groupBy("block"))
        .applyInArrow(prefixes, "token long, node long")
    )


class InvertedLists:
    """Posting lists of a tile's sets, sorted by set."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        self.postings = owner[order]
        self.tokens, self.begin = np.unique(tokens[order], return_index=True)
        self.end = np.append(self.begin[1:], len(tokens))
        self.sizes = np.array(sizes, np.int64)

    def overlapping(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Sets whose Jaccard similarity with ``query`` is at least ``percent``, by DivideSkip."""
        at = np.searchsorted(self.tokens, query)
        at = at[at < len(self.tokens)] if len(self.tokens) else at[:0]
        at = at[np.isin(self.tokens[at], query, assume_unique=False)]
        at = np.unique(at)
        n = len(query)
        least = -(-percent * n // 100)  # of any partner: it shares this much of the query
        if len(at) < least:
            return np.empty(0, np.int64)
        begin, length = self.begin[at], self.end[at] - self.begin[at]
        order = np.argsort(length, kind="stable")
        # the more the longest list outweighs a probe, the more lists are probed
        n_long = min(int(least / (0.0085 * np.log(max(int(length.max()), 2)) + 1)), least - 1)
        short, long_ = order[: len(order) - n_long], order[len(order) - n_long :]
        steps = np.arange(int(length[short].sum()))
        base = np.repeat(begin[short] - np.append(0, np.cumsum(length[short])[:-1]), length[short])
        found, times = np.unique(self.postings[base + steps], return_counts=True)
        fits = (100 * self.sizes[found] >= percent * n) & (percent * self.sizes[found] <= 100 * n)
        keep = fits & (times >= least - n_long)
        found, times = found[keep], times[keep]
        for k in long_:
            if not len(found):
                break
            postings = self.postings[begin[k] : begin[k] + length[k]]
            place = np.minimum(np.searchsorted(postings, found), len(postings) - 1)
            times = times + (postings[place] == found)
        union = n + self.sizes[found] - times
        return found[100 * times >= percent * union]


class Forest:
    """Union-find over the sets of a tile."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def tile_links(
    rows: list[tuple[int, int, np.ndarray, int]], across: bool, percent: int
) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links that span what is connected among ``rows`` (side, node, set, copies), and for each
    node the copies that all its links lead to. Across tiles only sets of different sides are
    compared."""
    if across:
        queries = [r for r in rows if r[0] == 0]
        listed = [r for r in rows if r[0] == 1]
    else:
        queries = listed = rows
    index = InvertedLists([r[2] for r in listed])
    forest = Forest(len(queries) + len(listed) if across else len(rows))
    shift = len(queries) if across else 0
    copies = np.array([r[3] for r in listed], np.int64)
    led = np.zeros(len(listed), np.int64)
    spanning, counts = [], []
    for q, (_, node, tokens, own) in enumerate(queries):
        found = index.overlapping(tokens, percent)
        if across:
            led[found] += own
        else:
            found = found[found != q]
        if len(found):
            counts.append((node, int(copies[found].sum())))
        for other in found.tolist():
            if (across or other > q) and forest.join(q, other + shift):
                spanning.append((node, listed[other][1]))
    counts += [(listed[k][1], int(led[k])) for k in np.flatnonzero(led)]
    return spanning, counts


def links(sets: DataFrame, families: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links (a, b) between nodes of ``sets`` (node, tokens, copies) within ``families`` (node,
    component), and rows (a, n) of the copies that links of a lead to."""
    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    tiles = F.ceil(F.col("size") / settings.tile).cast("long")
    placed = (
        families.join(sizes, "component")
        .withColumn("tiles", tiles)
        .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
        .join(sets.select("node", "tokens", "copies"), "node")
    )
    n_small = max(1, (families.count() // settings.tile) * 2)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    small = placed.filter("tiles = 1").select(
        F.pmod(F.xxhash64("component"), F.lit(n_small)).alias("x"),
        F.lit(-1).cast("long").alias("y"),
        F.lit(-1).cast("long").alias("z"),
        "component",
        F.lit(0).alias("side"),
        "node",
        "tokens",
        "copies",
    )
    large = (
        placed.filter("tiles > 1")
        .withColumn("other", other)
        .select(
            F.col("component").alias("x"),
            F.least("tile", "other").alias("y"),
            F.greatest("tile", "other").alias("z"),
            "component",
            F.when(F.col("tile") <= F.col("other"), 0).otherwise(1).alias("side"),
            "node",
            "tokens",
            "copies",
        )
    )
    percent = settings.percent

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("node", "ascending")])
        across = table.column("y")[0].as_py() != table.column("z")[0].as_py()
        component = table.column("component").to_numpy()
        cuts = np.flatnonzero(np.diff(component)) + 1
        out: list[tuple] = []
        for low, high in zip(np.append(0, cuts), np.append(cuts, len(component))):
            part = table.slice(low, high - low)
            rows = [
                (side, node, np.frombuffer(tokens.as_py(), "<u8"), copies)
                for side, node, tokens, copies in zip(
                    part.column("side").to_pylist(),
                    part.column("node").to_pylist(),
                    part.column("tokens"),
                    part.column("copies").to_pylist(),
                )
            ]
            spanning, counts = tile_links(rows, across, percent)
            out += [(a, b, None) for a, b in spanning] + [(a, None, n) for a, n in counts]
        columns = zip(*out) if out else ((), (), ())
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip("abn", columns)})

    return (
        small.unionByName(large)
        .groupBy("x", "y", "z")
        .applyInArrow(search, "a long, b long, n long")
    )


def text_class(text: Column) -> Column:
    """The class of a text's copies, as ``digest`` has it; null without words."""
    words = F.trim(F.regexp_replace(lower_ascii(text), BLANKS, " "))
    return F.when(words != "", F.unhex(F.md5(words)))


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, n_links, component_id, class, component_class`` for every row of
    ``docs`` (doc_id, text); ``n_links`` counts the rows it links with. The last two are the classes of the text and of the component's first one:
    they tell components apart whose first texts have one id."""
    seen = stage(shared_counts(docs, settings), "shared-counts")
    worded = seen.filter("class is not null")
    classes = worded.groupBy("class").agg(
        F.min("doc_id").alias("first_id"),
        F.count("*").alias("copies"),
        F.max(100 * F.col("shared") >= settings.percent * F.col("n_shingles")).alias("candidate"),
    )
    wanted = classes.filter("candidate").select(F.col("first_id").alias("doc_id"), "class", "copies")
    wanted = stage(wanted, "wanted-classes")
    sets = stage(
        class_sets(docs, wanted, settings).withColumn("node", F.monotonically_increasing_id()),
        "class-sets",
    )
    prefixes = stage(rare_prefixes(sets, settings), "rare-prefixes")
    leaders = prefixes.groupBy("token").agg(F.min("node").alias("leader"))
    families = components(
        prefixes.join(leaders, "token").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    )
    linked = stage(links(sets, families, settings), "class-links")
    found = components(linked.filter("b is not null").select("a", "b"))
    led = linked.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("led"))
    named = (
        found.join(led, "node", "left")
        .join(sets.select("node", "class"), "node")
        .join(classes.select("class", "first_id"), "class")
    )
    first = F.struct(F.col("first_id").isNull(), "first_id", F.col("class").alias("component_class"))
    names = named.groupBy("component").agg(F.min(first).alias("first"))
    of_class = stage(
        classes.join(named.select("class", "component", "led"), "class", "left")
        .join(names, "component", "left")
        .select(
            F.col("class").alias("_class"),
            F.when(F.col("first").isNull(), F.col("first_id")).otherwise(F.col("first.first_id")).alias("component_id"),
            F.coalesce("first.component_class", "class").alias("component_class"),
            (F.col("copies") - 1 + F.coalesce("led", F.lit(0))).alias("n_links"),
        ),
        "class-components",
    )
    return seen.join(of_class, F.col("class") == F.col("_class"), "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "class",
        "component_class",
    )
