"""Operator 7: token ids in files of independent zstandard frames with a trailing seek table.

A file is a sequence of frames that each hold ``FRAME_IDS`` ids (the last fewer), one more
frame with the index of the documents, and the seek table of the zstandard seekable format:
a skippable frame with the compressed and the plain size and a checksum of every frame. A
reader finds the table at the end of the file, reads the index, and decompresses only the
frames that hold the documents it wants.

Documents are range-partitioned and sorted by id, and each task writes one file under a name
of its own; only the manifest that Spark commits says which files count, so a task that is
run again does no harm. Files go through ``pyarrow.fs``, which reaches local, HDFS and object
storage by their addresses.

Defined cases: a null or empty text is the end id alone; documents with a null id come first;
equal ids are ordered by a hash of the text and then by the text; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.llm.tokens import encoder
from reviewlens.session import new_folder, stage

FRAME_IDS = 1 << 16
END_ID = 2

# Fixed values of the seekable format.
_SKIPPABLE = 0x184D2A5E
_SEEKABLE = 0x8F92EAB1
_WITH_CHECKSUMS = 0x80

MANIFEST = "part int, path string, n_docs long, n_ids long"


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes ids of documents to an open binary file."""

    def __init__(self, out, width: int):
        import zstandard

        self._out = out
        self._width = width
        self._pack = zstandard.ZstdCompressor(level=3, write_checksum=True).compress
        self._buffer = bytearray()
        self._table: list[tuple[int, int, int]] = []
        self._index = bytearray()
        self.n_docs = self.n_ids = 0

    def _frame(self, data: bytes) -> None:
        packed = self._pack(data)
        self._out.write(packed)
        self._table.append((len(packed), len(data), _checksum(data)))

    def add(self, doc_id: int | None, ids) -> None:
        """``ids``: a numpy array of unsigned 32-bit ids."""
        data = ids.astype(f"<u{self._width}", copy=False).tobytes()
        self._index += struct.pack("<?qQ", doc_id is not None, doc_id or 0, len(ids))
        self._buffer += data
        size = FRAME_IDS * self._width
        if len(self._buffer) >= size:
            whole = len(self._buffer) // size * size
            for at in range(0, whole, size):
                self._frame(bytes(self._buffer[at : at + size]))
            del self._buffer[:whole]
        self.n_docs += 1
        self.n_ids += len(ids)

    def close(self) -> None:
        if self._buffer:
            self._frame(bytes(self._buffer))
        self._frame(struct.pack("<BQ", self._width, self.n_docs) + bytes(self._index))
        entries = b"".join(struct.pack("<III", *entry) for entry in self._table)
        footer = struct.pack("<IBI", len(self._table), _WITH_CHECKSUMS, _SEEKABLE)
        self._out.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)))
        self._out.write(entries + footer)


class FrameReader:
    """Reads documents of a file opened for random access."""

    def __init__(self, source):
        import numpy as np

        self._source = source
        size = source.size()
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE or flags != _WITH_CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * count)
        table = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self._sums = table[:, 2]
        self._at = np.concatenate([[0], np.cumsum(table[:, 0])])
        index = self._frame(count - 1)
        self.width, self.n_docs = struct.unpack_from("<BQ", index)
        entries = np.frombuffer(index, [("valid", "?"), ("doc_id", "<i8"), ("n", "<u8")], offset=9)
        self.entries = entries
        self.starts = np.concatenate([[0], np.cumsum(entries["n"].astype(np.int64))])
        self._kept: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        import zstandard

        self._source.seek(int(self._at[k]))
        packed = self._source.read(int(self._at[k + 1] - self._at[k]))
        data = zstandard.ZstdDecompressor().decompress(packed)
        if _checksum(data) != self._sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return data

    def ids(self, doc: int):
        """Ids of the document at place ``doc``, from the frames that hold them."""
        import numpy as np

        begin, end = int(self.starts[doc]), int(self.starts[doc + 1])
        parts = []
        at = begin
        while at < end:
            k = at // FRAME_IDS
            if self._kept[0] != k:
                self._kept = (k, self._frame(k))
            upto = min(end, (k + 1) * FRAME_IDS)
            low = (at - k * FRAME_IDS) * self.width
            parts.append(self._kept[1][low : low + (upto - at) * self.width])
            at = upto
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")


def write(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None
) -> DataFrame:
    """Write the ids of all ``docs`` (doc_id, text) in order of doc_id; the manifest of files."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-files")
    spark.range(0).write.parquet(f"{folder}/empty")  # makes the folder where Spark can

    def write_part(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode_all = encoder(tokenizer).encode_all
        store, root = fs.FileSystem.from_uri(folder)
        path = f"{root}/part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer = out = None
        last = struct.pack("<I", end_id)
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            if writer is None:
                out = store.open_output_stream(path, compression=None)
                writer = FrameWriter(out, 2 if end_id < 1 << 16 and _fits(tokenizer) else 4)
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts)):
                writer.add(doc_id, np.frombuffer(ids + last, "<u4"))
        if writer is not None:
            writer.close()
            out.close()
            row = {"part": [part], "path": [path], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]}
            yield pa.RecordBatch.from_pydict(
                row,
                pa.schema(
                    [("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]
                ),
            )

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    manifest = stage(ordered.mapInArrow(write_part, MANIFEST), "token-manifest")
    return manifest.withColumn("folder", F.lit(folder))


def _fits(tokenizer: str | None) -> bool:
    return encoder(tokenizer)._tokenizer.get_vocab_size() < 1 << 16


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per document, read back from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    placed = manifest.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n_files = manifest.count()

    def read_files(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        schema = pa.schema(
            [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        )
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = fs.FileSystem.from_uri(row["folder"])
                with store.open_input_file(row["path"]) as source:
                    reader = FrameReader(source)
                    for low in range(0, reader.n_docs, 10_000):
                        rows = range(low, min(low + 10_000, reader.n_docs))
                        of = reader.entries[low : low + 10_000]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([int(d) if v else None for d, v in zip(of["doc_id"], of["valid"])], pa.int64()),
                                pa.array([row["file_start"] + int(reader.starts[k]) for k in rows], pa.int64()),
                                pa.array(of["n"].astype("int64")),
                                pa.array([zlib.crc32(reader.ids(k).tobytes()) for k in rows], pa.int64()),
                            ],
                            schema=schema,
                        )

    return placed.repartition(max(n_files, 1)).mapInArrow(
        read_files, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
