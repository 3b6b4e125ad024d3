"""Token files: independent zstandard frames with a trailing seek table."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import new_folder, shared_filesystem, utf8

# Fixed values of the public zstandard seekable format.
_SKIPPABLE, _SEEKABLE, _WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX_SCHEMA = "doc_id long, part int, file string, at long, n_tokens long"
_FRAME = 1 << 18              # bytes of ids that fill a frame; longer documents take several
_GROUP = 4 << 20              # bytes of text encoded at a time


def _checksum(data: bytes) -> int:
    from xxhash import xxh64_intdigest
    return xxh64_intdigest(data) & 0xFFFFFFFF


class FrameWriter:
    """Writes bytes as frames of about ``_FRAME`` bytes; ``close`` adds the seek table."""

    def __init__(self, out, level: int):
        import zstandard
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level)
        self.buffer, self.size, self.entries = [], 0, []

    def add(self, data: bytes) -> None:
        self.buffer.append(data)
        self.size += len(data)
        if self.size >= _FRAME:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self.buffer)
        self.buffer, self.size = [], 0
        for k in range(0, len(data), 4 * _FRAME):
            part = data[k:k + 4 * _FRAME]
            frame = self.pack.compress(part)
            self.out.write(frame)
            self.entries.append(struct.pack("<III", len(frame), len(part), _checksum(part)))

    def close(self) -> None:
        self._flush()
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), _WITH_CHECKSUMS, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.out.close()


class FrameReader:
    """Random access to the bytes of a file: only frames that a request touches are
    read and decompressed, each checked against its checksum; the last one is kept."""

    def __init__(self, source):
        import zstandard
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != _SEEKABLE or not flags & _WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sums = table[:, 2]
        self.stored = np.concatenate(([0], np.cumsum(table[:, 0])))
        self.plain = np.concatenate(([0], np.cumsum(table[:, 1])))
        self.number, self.frame = -1, b""

    def _frame(self, k: int) -> bytes:
        if k != self.number:
            data = self.source.read_at(int(self.stored[k + 1] - self.stored[k]), int(self.stored[k]))
            frame = self.unpack.decompress(data, max_output_size=int(self.plain[k + 1] - self.plain[k]))
            if _checksum(frame) != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.number, self.frame = k, frame
        return self.frame

    def read(self, begin: int, size: int) -> bytes:
        out, k = [], int(np.searchsorted(self.plain, begin, side="right")) - 1
        while size > 0:
            skip = begin - int(self.plain[k])
            part = self._frame(k)[skip:skip + size]
            out.append(part)
            begin, size, k = begin + len(part), size - len(part), k + 1
        return b"".join(out)


def _writer(folder: str, path: str, end_id: int, level: int):
    names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, file = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.ids.zst"
        fs, where = shared_filesystem(file)
        out, at, end = None, 0, struct.pack("<I", end_id)
        for batch in batches:
            rows, texts, size = [], [], 0
            pairs = list(zip(batch.column("doc_id").to_pylist(), batch.column("text")))
            for i, (doc_id, x) in enumerate(pairs):
                texts.append((doc_id, x.as_py().decode()))
                size += len(texts[-1][1])
                if size < _GROUP and i + 1 < len(pairs):
                    continue
                if out is None:
                    fs.create_dir(where.rpartition("/")[0], recursive=True)
                    out = FrameWriter(fs.open_output_stream(where, compression=None), level)
                for (d, _), ids in zip(texts, encoder(path).encode([t for _, t in texts])):
                    out.add(ids + end)
                    rows.append((d, part, file, at, len(ids) // 4 + 1))
                    at += len(ids) // 4 + 1
                texts, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if out is not None:
            out.close()
    return run


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 0, level: int = 3,
                 files: int | None = None) -> DataFrame:
    """Write the ids of all documents, ``end_id`` after each, in ascending doc_id
    order, and return the index (doc_id, part, file, at, n_tokens, start).

    Rows are range-partitioned by doc_id into ``files`` files (default: the
    session's shuffle partitions); ``at`` counts ids in the file, ``start`` ids of
    all documents before. The index is a written table and names the file of the
    task that counted: a repeated task writes another file, which nothing reads.
    ids are little-endian unsigned 32-bit. Null and empty texts hold only
    ``end_id``; null doc_ids come first, repeated rows are kept (in any order
    among themselves), further columns are ignored; an empty table has no file.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
     .repartitionByRange(files or _partitions(docs), "doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(_writer(folder, path, end_id, level), INDEX_SCHEMA)
     .write.mode("errorifexists").parquet(f"{folder}/index"))
    index = docs.sparkSession.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)       # one row a file
    bases = (index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
             .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    return index.join(bases, "file").withColumn("start", F.col("base") + F.col("at")).drop("base")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    source = reader = opened = None
    for batch in batches:
        rows, ids, held = batch.to_pylist(), [], 0
        begin = 0
        for i, r in enumerate(rows):
            if opened != r["file"]:
                if source is not None:
                    source.close()
                fs, where = shared_filesystem(r["file"])
                source, opened = fs.open_input_file(where), r["file"]
                reader = FrameReader(source)
            ids.append(reader.read(4 * r["at"], 4 * r["n_tokens"]))
            held += len(ids[-1])
            if held >= 4 * _GROUP or i + 1 == len(rows):
                some = batch.slice(begin, i + 1 - begin)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), some.column("start"), some.column("n_tokens"), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
                ids, held, begin = [], 0, i + 1
    if source is not None:
        source.close()


def read_tokens(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents that ``index`` (all of it or any
    selection) names; a damaged frame raises. Only frames they touch are decompressed."""
    return (index.select("doc_id", "start", "n_tokens", "file", "at", "part")
            .repartitionByRange(_partitions(index), "part", "at").sortWithinPartitions("part", "at")
            .mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary"))
