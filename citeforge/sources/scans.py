"""Splittable scans: one JSON array read by many tasks, and archives' members read where they lie.

An array is cut into byte ranges. What a range does to the nesting depends on whether it starts
inside a string, so a first pass works that out for both cases; the ranges' few numbers, in order,
give each one's true start. In the second pass a task reads the records that begin in its range, the
last one beyond its end. Nothing is unpacked, and of a file only ranges are held.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 32 << 20

_MARK = re.compile(rb'"(?:[^"\\]++|\\.)*+"|[{}\[\]"]', re.S)
_STRING_END = re.compile(rb'(?:[^"\\]++|\\.)*+"', re.S)


def opened(path: str):
    """(seekable reader, size) of a file by URI or local path."""
    from pyarrow import fs

    parts = urlsplit(path)
    store, place = (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(path)
    return store.open_input_file(place), store.get_file_info(place).size


def _start(source, nominal: int, size: int) -> int:
    """The first place from ``nominal`` on that no backslash comes before, so that nothing there is escaped."""
    at = nominal
    while 0 < at < size:
        source.seek(at - 1)
        piece = source.read(4096)
        skipped = len(piece) - len(piece.lstrip(b"\\"))
        if skipped < len(piece):
            return at + skipped
        at += len(piece)
    return min(at, size)


def _range(path: str, chunk: int, number: int) -> tuple[bytes, int, int]:
    """(bytes, first, end) of a range."""
    source, size = opened(path)
    with source:
        first, end = _start(source, number * chunk, size), _start(source, (number + 1) * chunk, size)
        source.seek(first)
        return source.read(end - first), first, end


def _effect(data: bytes, inside: bool) -> tuple[bool, int]:
    """(whether it ends inside a string, change of depth) of bytes that start inside a string or not."""
    at, depth = 0, 0
    if inside:
        m = _STRING_END.match(data)
        if not m:
            return True, 0
        at = m.end()
    for m in _MARK.finditer(data, at):
        mark = m[0]
        if mark in (b"{", b"["):
            depth += 1
        elif mark in (b"}", b"]"):
            depth -= 1
        elif mark == b'"':  # not closed here
            return True, depth
    return False, depth


def _records(path: str, chunk: int, number: int, inside: bool, depth: int) -> Iterator[bytes]:
    """The objects in the array that begin in a range; its depth and state at the start are known."""
    data, first, end = _range(path, chunk, number)
    at = 0
    if inside:
        m = _STRING_END.match(data)
        if not m:
            return
        at = m.end()
    begin = None
    source, size = opened(path)
    with source:
        limit = len(data)
        while True:
            m = _MARK.search(data, at)
            cut = m is None or m[0] == b'"'
            if cut:
                if begin is None and (m is None or m.start() >= limit or first + len(data) >= size or depth < 2):
                    return  # no record is open, and none begins in what is left of the range
                source.seek(first + len(data))
                more = source.read(max(1 << 16, len(data) // 4))
                if not more:
                    raise ValueError(f"{path} ends within a record")
                at = m.start() if m else len(data)
                data += more
                continue
            at = m.end()
            if m[0] in (b"{", b"["):
                depth += 1
                if depth == 2 and begin is None:
                    if m.start() >= limit:
                        return
                    begin = m.start()
            elif m[0] in (b"}", b"]"):
                depth -= 1
                if depth == 1 and begin is not None:
                    yield data[begin:at]
                    begin = None


def json_array(spark: SparkSession, path: str, schema: str, chunk: int = CHUNK) -> DataFrame:
    """The objects of one JSON array in a file, under a schema; a malformed one fails the query.

    Equals a ``multiLine`` read, by as many tasks as the file has ranges. A row for each range, a
    few numbers, passes through the driver.
    """
    source, size = opened(path)
    source.close()
    n = max(1, -(-size // chunk))
    numbers = spark.range(n, numPartitions=min(n, 10_000))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                data = _range(path, chunk, k)[0]
                rows.append((k, *_effect(data, False), *_effect(data, True)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["k", "out", "out_depth", "in", "in_depth"])

    found = sorted(numbers.mapInArrow(measure, "k long, out boolean, out_depth long, `in` boolean, in_depth long").collect())
    starts, inside, depth = [], False, 0
    for k, *effects in found:
        starts.append((k, inside, depth))
        inside, change = effects[2:] if inside else effects[:2]
        depth += change
    if inside or depth:
        raise ValueError(f"{path} is not one whole array")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, i, d in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts: list[str] = []
                for record in _records(path, chunk, k, i, d):
                    texts.append(record.decode())
                    if len(texts) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(texts)], names=["value"])
                        texts = []
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])

    ranges = spark.createDataFrame(starts, "k long, i boolean, d long").repartition(min(n, 10_000), "k")
    return _parsed(ranges.mapInArrow(read, "value string"), schema)


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).where("r is not null").select("r.*")


# Archives


def archive_members(spark: SparkSession, paths: list[str], suffix: str = "") -> DataFrame:
    """(archive, member, length) from the archives' directories, which tasks read; members that end in ``suffix``."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                source, _ = opened(path)
                with source, zipfile.ZipFile(source) as z:
                    rows += [(path, i.filename, i.file_size) for i in z.infolist() if not i.is_dir() and i.filename.endswith(suffix)]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["archive", "member", "length"])

    listed = spark.createDataFrame([(p,) for p in paths], "archive string").repartition(max(1, len(paths)))
    return listed.mapInArrow(members, "archive string, member string, length long")


def member_lines(members: DataFrame, schema: str, tasks: int | None = None) -> DataFrame:
    """JSON lines of archives' members (archive, member): each member is streamed from its archive by one task."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, _ = opened(path)
                with source, zipfile.ZipFile(source) as z, z.open(name) as member:
                    held: list[str] = []
                    for line in io.TextIOWrapper(member, "utf-8", newline="\n"):
                        if line.strip():
                            held.append(line)
                        if len(held) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(held)], names=["value"])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])

    rows = members.select("archive", "member")
    rows = rows.repartition(tasks, "archive", "member") if tasks else rows.repartition("archive", "member")
    return _parsed(rows.mapInArrow(lines, "value string"), schema)
