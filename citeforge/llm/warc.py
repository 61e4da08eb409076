"""WARC archives with a two-level capture index.

Writing: equal payloads are found by digest; each task writes one archive whose records are gzip
members of their own. Index: capture lines are range-partitioned and sorted by reversed-host URL
key; each shard holds compressed blocks of lines and, at its end, a sparse directory with the first
key, offset and length of every block. Lookup: shards by their key ranges, then a binary search in
the shard's directory, then range reads of the blocks that can hold the key, then range reads of
the records themselves.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import shared
from citeforge.llm.textvec import column

#: Payloads of fewer bytes are never revisits.
LEAST_PAYLOAD = 1000
BLOCK_LINES = 500
SALTS = 1 << 20  # so many tasks may share the copies of one payload; salts that no copy has cost nothing
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOOTER = struct.Struct("<qq4s")
MAGIC = b"CDX2"

CAPTURES = "surt string, page_id long, archive string, offset long, length long, record_type string"
SHARDS = "shard long, path string, n_lines long, first string, last string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _clean(url: str | None) -> str:
    """A URL for a header or an index line: control characters and blanks are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: ``com,example,www)/path?query``; fragments are left out."""
    url = _clean(url)
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return f"){url}"
    key = ",".join(reversed(host.split(".")))
    if port and (parts.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:capture:{'-' if page_id is None else page_id}:{zlib.crc32(_clean(url).encode()):08x}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str] | None) -> bytes:
    """A response or, where ``refers_to`` names one, a revisit record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(*refers_to)}", f"WARC-Refers-To-Target-URI: {_clean(refers_to[1])}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """What a record says of its payload; a response's digest is computed anew and must agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda x: None if (s := x.split(":")[2]) == "-" else int(s)
    target = fields.get("WARC-Refers-To")
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI", ""),
        "payload_bytes": size,
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": number(target) if target else None,
    }


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and the response that each revisit refers to.

    Of equal payloads of ``least`` bytes or more, that of the largest page_id is the response
    (repeated rows of this id all are; rows without an id refer to it, and without any id in the
    group each is a response). Only digests that occur twice or more are joined: broadcast where they
    are few, so that the html stays where it was read; else by digest and a salt, and a digest's row
    is copied for the salts that its copies have, so a payload spreads over as many tasks as need be.
    A null payload is empty, and very long ones are hashed where they are read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    long_ones = rows.where(F.octet_length("html") >= least)
    groups = long_ones.groupBy("digest").agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))).alias("response"), F.count("*").alias("n"))
    groups = shared.materialize(groups.where((F.col("n") > 1) & F.col("response").isNotNull()).select("digest", "response"), "repeated")
    if shared.is_small(groups):
        joined = rows.join(F.broadcast(groups), "digest", "left")
    else:
        salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        slots = salted(long_ones).select("digest", "salt").distinct().join(groups, "digest")
        joined = salted(rows).join(slots, ["digest", "salt"], "left")
    target = F.when(~F.col("page_id").eqNullSafe(F.col("response.page_id")), F.col("response"))
    return joined.select("page_id", "url", "html", "digest", target.alias("refers_to"))


def _write_archives(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        lines: list[tuple] = []
        at = 0

        def members() -> Iterator[bytes]:
            nonlocal at
            for batch in batches:
                for r in batch.to_pylist():
                    target = r["refers_to"]
                    record = encode_record(r["page_id"], r["url"], r["html"].encode(), r["digest"], (target["page_id"], target["url"]) if target else None)
                    member = gzip.compress(record, 6, mtime=0)
                    lines.append((surt(r["url"]), r["page_id"], path, at, len(member), "revisit" if target else "response"))
                    at += len(member)
                    yield member

        shared.write_file(path, members())
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["surt", "page_id", "archive", "offset", "length", "record_type"]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in lines], kind) for k, kind in enumerate(kinds)], names=names)

    return write


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every row as a record; the table of captures."""
    planned = plan_records(pages)
    folder = shared.new_dir(pages.sparkSession, "warc")
    return shared.materialize(planned.mapInArrow(_write_archives(folder), CAPTURES), "captures")


class IndexWriter:
    """Sorted lines in compressed blocks, then the sparse directory and a footer."""

    def __init__(self, block_lines: int = BLOCK_LINES):
        self.block_lines, self.at, self.n = block_lines, 0, 0
        self.directory: list[tuple[str, int, int]] = []
        self.held: list[str] = []
        self.first = self.last = None

    def add(self, key: str, rest: list) -> Iterator[bytes]:
        self.first, self.last = key if self.first is None else self.first, key
        self.held.append(key + "\t" + json.dumps(rest, separators=(",", ":")))
        self.n += 1
        if len(self.held) == self.block_lines:
            yield self._block()

    def _block(self) -> bytes:
        block = gzip.compress("\n".join(self.held).encode(), 6, mtime=0)
        self.directory.append((self.held[0].split("\t")[0], self.at, len(block)))
        self.at += len(block)
        self.held = []
        return block

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._block()
        body = gzip.compress(json.dumps(self.directory).encode(), 6, mtime=0)
        yield body
        yield FOOTER.pack(self.at, len(body), MAGIC)


class IndexReader:
    """Lookup in one shard: binary search in its directory, then range reads of blocks."""

    def __init__(self, source):
        self.source, self.blocks_read = source, 0
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        at, size, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a capture index")
        source.seek(at)
        self.directory = json.loads(gzip.decompress(source.read(size)))
        self.firsts = [d[0] for d in self.directory]
        self.held: tuple[int, list[str]] = (-1, [])

    def block(self, k: int) -> list[str]:
        if self.held[0] != k:
            self.source.seek(self.directory[k][1])
            self.held = (k, gzip.decompress(self.source.read(self.directory[k][2])).decode().split("\n"))
            self.blocks_read += 1
        return self.held[1]

    def find(self, key: str) -> Iterator[list]:
        """The captures of a key, which may run over several blocks."""
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)  # a key's first line may lie in the block before
        while k < len(self.directory) and self.firsts[k] <= key:
            lines = self.block(k)
            at = bisect.bisect_left(lines, key + "\t")
            while at < len(lines) and lines[at].startswith(key + "\t"):
                yield json.loads(lines[at].split("\t", 1)[1])
                at += 1
            k += 1


def _write_index(folder: str, block_lines: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.cdx"
        writer = IndexWriter(block_lines)

        def body() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.to_pylist():
                    yield from writer.add(r["surt"], [r["page_id"], r["archive"], r["offset"], r["length"], r["record_type"]])
            yield from writer.close()

        shared.write_file(path, body())
        row = {"shard": [shard], "path": [path], "n_lines": [writer.n], "first": pa.array([writer.first], pa.string()), "last": pa.array([writer.last], pa.string())}
        yield pa.RecordBatch.from_pydict(row)

    return write


def write_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the capture index; one row for each shard. One URL's captures may span shards."""
    order = ["surt", "page_id", "archive", "offset"]
    rows = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    folder = shared.new_dir(captures.sparkSession, "cdx")
    return shared.materialize(rows.mapInArrow(_write_index(folder, block_lines), SHARDS), "cdx-shards").where("n_lines > 0")


def _route(shards: list[tuple]):
    """Each distinct key of the batch's URLs to the shards whose range holds it."""
    firsts, lasts = [s[1] for s in shards], [s[2] for s in shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = sorted({surt(u) for u in column(batch, "url").to_pylist()})
            out = [(shards[k][0], key) for key in keys for k in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], names=["shard", "surt"])

    return route


def _search(paths: dict[int, str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, opened = None, None
        for batch in batches:
            out: list[tuple] = []
            for shard, key in zip(column(batch, "shard").to_pylist(), column(batch, "surt").to_pylist(), strict=True):
                if shard != opened:
                    reader, opened = IndexReader(shared.open_file(paths[shard])), shard
                for page_id, archive, offset, length, kind in reader.find(key):
                    out.append((key, page_id, archive, offset, length, kind))
                    if len(out) == 10_000:
                        yield _captures(out)
                        out = []
            yield _captures(out)

    return search


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["surt", "page_id", "archive", "offset", "length", "record_type"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def lookup(shards: DataFrame, urls: DataFrame) -> DataFrame:
    """The captures of all URLs in column ``url`` (each once, however often it is asked for).

    The driver holds a row for each index shard; keys go to the tasks of the shards that can hold
    them, so one URL with very many captures is read by as many tasks as its captures fill shards.
    """
    held = sorted((r.first, r.last, r.shard, r.path) for r in shards.collect())
    if not held:
        return urls.sparkSession.createDataFrame([], CAPTURES)
    routed = urls.select("url").mapInArrow(_route([(s, f, e) for f, e, s, _ in held]), "shard long, surt string").distinct()
    asked = routed.repartitionByRange(len(held), "shard").sortWithinPartitions("shard", "surt")
    return asked.mapInArrow(_search({s: p for _, _, s, p in held}), CAPTURES)


def _read(most: int = 4 << 20):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            rows = list(zip(column(batch, "archive").to_pylist(), column(batch, "offset").to_pylist(), column(batch, "length").to_pylist(), strict=True))
            out, k = [], 0
            while k < len(rows):  # neighbouring records are read at once
                archive, start, length = rows[k]
                if archive != opened:
                    source, opened = shared.open_file(archive), archive
                end, stop = k + 1, start + length
                while end < len(rows) and rows[end][0] == archive and rows[end][1] == stop and stop - start < most:
                    stop += rows[end][2]
                    end += 1
                source.seek(start)
                data = source.read(stop - start)
                for _, at, n in rows[k:end]:
                    out.append(decode_record(gzip.GzipFile(fileobj=io.BytesIO(data[at - start : at - start + n])).read()))
                k = end
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in zip(names, kinds, strict=True)], names=names)

    return read


def read_records(captures: DataFrame) -> DataFrame:
    """The records at captures' places, by range reads in archive order."""
    order = ["archive", "offset"]
    return captures.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_read(), RECORDS)


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, index them, and read all URLs back over the index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    shards = write_index(write_archives(pages))
    found = read_records(lookup(shards, pages.select("url")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB SQL for the same rows.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= {LEAST_PAYLOAD} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN g.top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.top <> page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
