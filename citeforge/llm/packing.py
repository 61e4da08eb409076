"""Sequence packing by Karmarkar-Karp multiway differencing.

Documents are cut into pieces while they are encoded: full windows first, then the rest, halved
until no piece exceeds ``capacity / 4``. Full windows are sequences by themselves. The other pieces
are dealt to buckets of about ``bucket_windows`` windows; in a bucket, differencing merges partial
partitions with opposing imbalances (the fullest subset of one with the emptiest of the other)
until one partition into near-equal windows remains. If a window exceeds the capacity, the window
count rises by one and the bucket is partitioned again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import shared
from citeforge.llm.textvec import column, flat_slices
from citeforge.llm.wordcoder import coder, vocabulary_path, with_end

CAPACITY = 4096
BUCKET_WINDOWS = 128

PIECE = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows, then the rest in parts of at most a quarter."""
    out = [(a, capacity) for a in range(0, n - capacity + 1, capacity)]
    at, rest = len(out) * capacity, n % capacity
    parts = max(1, -(-rest // max(1, capacity // 4)))
    for k in range(parts if rest else 0):
        size = rest // parts + (k < rest % parts)
        out.append((at, size))
        at += size
    return out


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The subset (0 to k - 1) of each item under k-way largest-differencing.

    A partial partition is k subset sums in falling order, each with the root of its item tree, less
    its smallest sum. The two partitions with the largest spread are merged, one reversed. Ties go
    to the partition made first, so the result depends on the sizes' order alone.
    """
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    left, right = np.full(2 * n * k + n, -1, np.int64), np.full(2 * n * k + n, -1, np.int64)
    nodes = n
    heap: list = []
    for i in np.argsort(-sizes, kind="stable"):
        sums, roots = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], roots[0] = sizes[i], i
        heap.append((-int(sizes[i]), len(heap), sums, roots))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a_sums, a_roots = heapq.heappop(heap)
        _, _, b_sums, b_roots = heapq.heappop(heap)
        sums, opposite = a_sums + b_sums[::-1], b_roots[::-1]
        both = np.flatnonzero((a_roots >= 0) & (opposite >= 0))
        roots = np.where(a_roots >= 0, a_roots, opposite)
        if nodes + len(both) > len(left):
            left, right = (np.concatenate([x, np.full(len(x), -1, np.int64)]) for x in (left, right))
        made = np.arange(nodes, nodes + len(both))
        left[made], right[made], roots[both] = a_roots[both], opposite[both], made
        nodes += len(both)
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], roots[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, roots))
        serial += 1
    out = np.zeros(n, np.int64)
    for subset, root in enumerate(heap[0][3]):
        stack = [int(root)] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = subset
            else:
                stack += (int(left[x]), int(right[x]))
    return out


def bundled(sizes: np.ndarray, most: int) -> np.ndarray:
    """The bundle (0 on) of each item: items of ``most`` or more alone, smaller ones together.

    Small items are laid end to end in falling order and cut wherever a multiple of ``most`` falls
    in one, so a bundle is less than twice ``most`` and there are at most two for each ``most`` ids.
    """
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order]
    large = falling >= most
    before = np.cumsum(np.where(large, 0, falling)) - np.where(large, 0, falling)
    new = large | (before // most != np.concatenate([[-1], before[:-1] // most]))
    new[int(large.sum()) :][:1] = True
    out = np.empty(len(sizes), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def pack_bucket(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; no window exceeds ``capacity``, and no piece may.

    Differencing holds k numbers an item, so very small pieces go as bundles: what it holds follows
    the ids in the bucket, not its pieces, of which there may be as many as ids.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    bundle = bundled(sizes, max(1, capacity // 64))
    sums = np.bincount(bundle, weights=sizes).astype(np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sums, k)
        if np.bincount(window, weights=sums, minlength=1).max(initial=0) <= capacity:
            return window[bundle]
        k += 1


def _pieces(vocabulary: str, end_id: int, capacity: int, keep_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        encoder = coder(vocabulary_path(vocabulary))
        for batch in batches:
            keys = column(batch, "doc_id")
            for a, b, flat in flat_slices(column(batch, "text")):
                ids, counts = with_end(*encoder.slice_ids(flat.lower() if encoder.folds else flat), end_id)
                ids = ids.astype("<u4", copy=False)
                begin, rows, kept = np.concatenate([[0], np.cumsum(counts)]), [], []
                for i in range(b - a):
                    for start, size in cuts(int(counts[i]), capacity):
                        part = ids[begin[i] + start : begin[i] + start + size]
                        rows.append((i, number, start, size, zlib.crc32(part), int(counts[i])))
                        number += 1
                        if keep_ids:
                            kept.append(part)
                of, *rest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                arrays = [pa.array(rest[0]), keys.slice(a, b - a).take(pa.array(of)), *map(pa.array, rest[1:])]
                names = ["piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    ends = np.concatenate([[0], np.cumsum(rest[2])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pieces


def cut_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every text's ids with the end id, written to the shared folder.

    Null texts are empty (the end id alone), of which there may be any number; null ids and repeated
    rows are kept as they come, very long texts are cut into as many pieces as they need; other
    columns are not read, and an empty table has no pieces. ``keep_ids`` adds the ids themselves.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = rows.mapInArrow(_pieces(vocabulary, end_id, capacity, keep_ids), PIECE + (", ids array<int>" if keep_ids else ""))
    return shared.materialize(cut, "pieces")


def _pack(capacity: int):
    def pack(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("piece")
        sizes = bucket["length"].to_numpy()
        window = pack_bucket(sizes, capacity)
        order = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], np.diff(window[order]) != 0])
        offset = np.zeros(len(sizes), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        number = bucket["bucket"][0].as_py()
        out = bucket.drop_columns(["piece", "bucket"])
        return out.append_column("sequence_id", pa.array((number << 20) + window)).append_column("offset", pa.array(offset))

    return pack


def assign_windows(pieces: DataFrame, capacity: int = CAPACITY, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """Add sequence_id and offset. ``pieces`` is a written table, so that its numbers stay as they are.

    The number of buckets follows the total of ids, so a bucket's size does not depend on the
    input's; pieces are dealt to buckets by the hash of their number, whatever document they are
    of. Sequence ids are unique, not consecutive: bucket times 2^20 plus window for packed
    sequences, and 2^62 plus the piece's number for full windows.
    """
    full = F.col("length") == capacity
    rest = pieces.where(~full)
    total = rest.agg(F.sum("length")).first()[0] or 0
    n = max(1, round(total / (capacity * bucket_windows)))
    dealt = rest.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(n)))
    names = [c for c in pieces.columns if c != "piece"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "piece")
    packed = dealt.groupBy("bucket").applyInArrow(_pack(capacity), f"{types}, sequence_id long, offset long")
    whole = pieces.where(full).select(*names, (F.lit(1 << 62) + F.col("piece")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """All documents' ids in sequences of at most ``capacity``, one row for each piece."""
    return assign_windows(cut_documents(docs, capacity=capacity, keep_ids=keep_ids), capacity)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
