import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from citeforge.llm import shared, warc


def rows_of(spark, pages):
    shards = warc.write_index(warc.write_archives(pages), block_lines=4)
    return shards, warc.read_records(warc.lookup(shards, pages.select("url"))).collect()


def brute(rows):
    top = {}
    for p, _, h in rows:
        d = (h or "").encode()
        if len(d) >= warc.LEAST_PAYLOAD and p is not None:
            top[d] = max(top.get(d, p), p)
    out = []
    for p, _, h in rows:
        d = (h or "").encode()
        to = top.get(d) if top.get(d) != p else None
        out.append((p, len(d), hashlib.sha1(d).hexdigest(), "revisit" if to is not None else "response", to))
    return out


def same(got, want):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("most", [0, 1 << 25])
def test_pages_round_trip(spark, most, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    _, got = rows_of(spark, pages)
    same(got, brute([(r.page_id, r.url, r.html) for r in pages.collect()]))


def test_odd_pages(spark, monkeypatch):
    big = "é" * 600
    rows = [(1, "http://a.com/x", big), (2, "http://A.com/x#y", big), (2, "http://a.com/x", big), (None, None, big), (3, None, None), (4, "", ""), (5, "http://[bad", "x"), (6, "http://a.com/x y\n", "y" * 999), (7, "http://b.org:8080", "y" * 999)]
    rows += [(100 + i, "http://hot.example.com/same", f"{i % 3} {big}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("offset", F.lit("x"))
    shards, got = rows_of(spark, pages)
    same(got, brute(rows))
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 0)
    same(rows_of(spark, pages)[1], brute(rows))
    first = shards.first()
    with gzip.open(shared.open_file(warc.lookup(shards, pages.select("url")).first().archive)) as source:
        assert source.read(8) == b"WARC/1.1"
    assert first.n_lines > 0


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows_of(spark, pages)[1] == []


def test_binary_search_reads_few_blocks():
    keys = sorted(f"com,example)/{random.Random(i).randrange(400):04d}" for i in range(3000))
    writer = warc.IndexWriter(block_lines=50)
    data = b"".join(b for i, k in enumerate(keys) for b in writer.add(k, [i])) + b"".join(writer.close())
    for key in ["com,example)/0000", keys[0], keys[1500], keys[-1], "zz", ""]:
        reader = warc.IndexReader(io.BytesIO(data))
        assert [x[0] for x in reader.find(key)] == [i for i, k in enumerate(keys) if k == key]
        assert reader.blocks_read <= 3


def test_keys():
    assert warc.surt("HTTP://www.Example.com:80/a?b=c#d") == "com,example,www)/a?b=c"
    assert warc.surt("https://x.org:8443") == "org,x:8443)/"
    assert warc.surt(None) == ")/"
