"""Token-ID files: fixed-size id blocks, transposed into bit planes, each compressed with zstandard.

File layout::

    "BPF1"
    blocks     each: the compressed planes of one block of ids, lowest bit (or byte) first
    directory  zstandard: int64 arrays, see ``_directory``: the chunk index and the documents
    footer     directory offset (int64), directory bytes (int64), plane kind (b or y), "BPF1"

A block holds ``block_ids`` ids; the last one of a file may be shorter. Only planes that hold a set
bit are stored. The chunk index gives each block's byte offset and the bytes of each plane, so that
any range of ids is read by seeking to the blocks that it touches.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.llm import shared
from citeforge.llm.textvec import column, flat_slices
from citeforge.llm.wordcoder import coder, vocabulary_path, with_end

MAGIC = b"BPF1"
FOOTER = struct.Struct("<qqc4s")
BLOCK_IDS = 1 << 16

#: Ids that one task reads back, where files are smaller; a larger file is a task of its own.
TASK_IDS = 1 << 24

MANIFEST = "shard long, path string, n_docs long, n_ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def split_planes(ids: np.ndarray, kind: str = "b") -> list[bytes]:
    """The planes of a block of uint32 ids up to the highest that is not zero."""
    top = int(ids.max()) if len(ids) else 0
    if kind == "y":
        columns = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() for k in range((top.bit_length() + 7) // 8)]
    narrow = ids.astype(np.uint16) if top < 1 << 16 else ids
    return [np.packbits((narrow & narrow.dtype.type(1 << k)) != 0).tobytes() for k in range(top.bit_length())]


def join_planes(planes: list[bytes], n: int, kind: str = "b") -> np.ndarray:
    """The block of ``n`` ids whose planes these are."""
    if kind == "y":
        out = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4").astype(np.uint32, copy=False)
    narrow = np.uint16 if len(planes) <= 16 else np.uint32
    out = np.zeros(n, narrow)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(narrow) << narrow(k)
    return out.astype(np.uint32, copy=False)


class Writer:
    """Takes documents in order and gives the file's bytes in pieces; holds one block at a time."""

    def __init__(self, kind: str = "b", block_ids: int = BLOCK_IDS, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.kind, self.block_ids = kind, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.at = len(MAGIC)
        self.blocks: list[tuple[int, int, list[int]]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> Iterator[bytes]:
        """Documents' ids end to end; ``missing`` marks null document ids."""
        self.docs.append((doc_ids.astype(np.int64), missing.astype(np.int64), counts.astype(np.int64)))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            ready = np.concatenate(self.held)
            full = len(ready) - len(ready) % self.block_ids
            for a in range(0, full, self.block_ids):
                yield self._block(ready[a : a + self.block_ids])
            self.held, self.n_held = [ready[full:].copy()], len(ready) - full

    def _block(self, ids: np.ndarray) -> bytes:
        planes = [self.pack(p) for p in split_planes(ids, self.kind)]
        self.blocks.append((self.at, len(ids), [len(p) for p in planes]))
        out = b"".join(planes)
        self.at += len(out)
        self.n_ids += len(ids)
        return out

    def close(self) -> Iterator[bytes]:
        if self.n_held:
            yield self._block(np.concatenate(self.held))
        where = self.at
        body = self.pack(_directory(self.blocks, self.docs))
        yield body
        yield FOOTER.pack(where, len(body), self.kind.encode(), MAGIC)


def _directory(blocks: list, docs: list) -> bytes:
    """Counts of blocks and documents; per block offset, ids, planes; all plane sizes; documents."""
    sizes = [s for _, _, planes in blocks for s in planes]
    head = [len(blocks), sum(len(d[0]) for d in docs), len(sizes)]
    columns = [np.array(x, np.int64) for x in (head, [b[0] for b in blocks], [b[1] for b in blocks], [len(b[2]) for b in blocks], sizes)]
    columns += [np.concatenate([d[k] for d in docs]) if docs else np.zeros(0, np.int64) for k in range(3)]
    return b"".join(c.astype("<i8").tobytes() for c in columns)


class Reader:
    """Random and sequential access to a file of ids."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        where, size, kind, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        self.kind = kind.decode()
        source.seek(where)
        words = np.frombuffer(self.unpack(source.read(size)), "<i8")
        n_blocks, n_docs, n_sizes = (int(x) for x in words[:3])
        cuts = np.cumsum([3, n_blocks, n_blocks, n_blocks, n_sizes, n_docs, n_docs])
        _, self.offset, self.n, planes, sizes, self.doc_ids, self.missing, self.counts = np.split(words, cuts)
        self.sizes = np.split(sizes, np.cumsum(planes)[:-1]) if n_blocks else []
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offset[k]))
        return join_planes([self.unpack(self.source.read(int(s))) for s in self.sizes[k]], int(self.n[k]), self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive), from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.first, start, side="right") - 1, np.searchsorted(self.first, stop, side="left")
        got = np.concatenate([self.block(k) for k in range(a, b)])
        return got[start - self.first[a] : stop - self.first[a]]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, ids of the file's documents before it, its ids, their CRC-32), block by block."""
        starts = np.concatenate([[0], np.cumsum(self.counts)])
        k, held, held_at = -1, np.zeros(0, np.uint32), 0
        for i in range(len(self.counts)):
            crc, at, stop = 0, int(starts[i]), int(starts[i + 1])
            while at < stop:
                while at >= held_at + len(held):
                    held_at += len(held)
                    k += 1
                    held = self.block(k)
                part = held[at - held_at : stop - held_at]
                crc = zlib.crc32(part.astype("<u4", copy=False), crc)
                at += len(part)
            yield (None if self.missing[i] else int(self.doc_ids[i])), int(starts[i]), stop - int(starts[i]), crc


def _write_shards(vocabulary: str, end_id: int, folder: str, kind: str, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        writer, encoder = Writer(kind, block_ids), coder(vocabulary_path(vocabulary))
        n_docs = 0

        def body() -> Iterator[bytes]:
            nonlocal n_docs
            yield MAGIC
            for batch in batches:
                keys = column(batch, "doc_id")
                missing = keys.is_null().to_numpy(zero_copy_only=False)
                numbers = keys.fill_null(0).to_numpy()
                for a, b, flat in flat_slices(column(batch, "text")):
                    ids, counts = with_end(*encoder.slice_ids(flat), end_id)
                    n_docs += b - a
                    yield from writer.add(numbers[a:b], missing[a:b], counts, ids)
            yield from writer.close()

        path = f"{folder}/ids-{shard:06d}.bpf"
        shared.write_file(path, body())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [n_docs], "n_ids": [writer.n_ids]})

    return write


def write_ids(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, kind: str = "b", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every text and write the ids in ascending doc_id order; one row for each file.

    Rows are range-partitioned by doc_id (equal ids further by their text's hash, so that one id
    never fills a task); a task sorts, encodes and writes one file, and a task that runs again
    replaces its file by the same bytes. Null ids come first, a null text is empty (one end id),
    repeated rows are all written, an empty table gives empty files or none. Other columns are not
    read. ``start_id`` in the result is the number of ids in the files before. The result is one
    Parquet file, not one for each row: every file that Spark writes makes it start processes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    files = rows.select("doc_id", "text").mapInArrow(_write_shards(vocabulary, end_id, shared.new_dir(spark, "token-ids"), kind, block_ids), MANIFEST)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    return shared.materialize(files.withColumn("start_id", F.coalesce(before, F.lit(0))), "token-files")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(column(batch, "path").to_pylist(), column(batch, "start_id").to_pylist(), strict=True):
            with shared.open_file(path) as source:
                rows: list = []
                for doc_id, start, n, crc in Reader(source).documents():
                    rows.append((doc_id, base + start, n, crc))
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=list(names))


def read_ids(files: DataFrame, task_ids: int = TASK_IDS) -> DataFrame:
    """Each document's place, length and CRC-32, from the files alone.

    Files are dealt in turn to tasks of about ``task_ids`` ids each, no fewer than cores and no more
    than files, so that many small files are not as many small tasks. All files are read in any case.
    """
    n_files, n_ids = files.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    n = max(1, min(n_files, max(files.sparkSession.sparkContext.defaultParallelism, -(-n_ids // task_ids))))
    return files.select("path", "start_id").repartition(n).mapInArrow(_read_files, READ)


def op5_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids, then read the files back."""
    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")))
