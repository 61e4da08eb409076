import io
import zlib

import numpy as np
import pytest
from brute import encode_all

from citeforge.llm import bitplanes as bp


@pytest.mark.parametrize("kind", ["b", "y"])
@pytest.mark.parametrize("top", [1, 2, 255, 50_257, 1 << 20, (1 << 32) - 1])
def test_planes_round_trip(kind, top):
    ids = np.random.default_rng(0).integers(0, top, 1001, dtype=np.uint32)
    assert (bp.join_planes(bp.split_planes(ids, kind), len(ids), kind) == ids).all()


@pytest.mark.parametrize("kind", ["b", "y"])
def test_ranges_of_a_file(kind):
    rng = np.random.default_rng(1)
    ids, counts = rng.integers(0, 50_000, 1000, dtype=np.uint32), np.array([0, 300, 1, 699])
    writer = bp.Writer(kind, block_ids=64)
    out = bp.MAGIC + b"".join(writer.add(np.arange(4), np.zeros(4, bool), counts, ids)) + b"".join(writer.close())
    reader = bp.Reader(io.BytesIO(out))
    for a, b in [(0, 0), (0, 1000), (63, 65), (64, 128), (999, 1000), (128, 900)]:
        assert (reader.ids(a, b) == ids[a:b]).all()
    assert [r[2] for r in reader.documents()] == counts.tolist()


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for (doc_id, _), ids in zip(rows, encode_all("byte_bpe_50k.json", [r[1] for r in rows]), strict=True):
        out.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    return out, start


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_files_hold_every_id(table, request):
    df = request.getfixturevalue(table)
    got = sorted(map(tuple, bp.read_ids(bp.write_ids(df, block_ids=4096)).collect()), key=lambda r: r[1])
    want, total = expected([(r.doc_id, r.text) for r in df.collect()])
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == sorted(want, key=key)
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    assert [r[0] or -1 for r in got] == sorted(r[0] or -1 for r in got)


def test_empty_table(empty):
    assert bp.read_ids(bp.write_ids(empty)).collect() == []


@pytest.fixture
def many_partitions(spark):
    """Forty shuffle partitions that are never joined into fewer."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 40
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_files_share_tasks(spark, docs, many_partitions):
    """Forty small id files are listed in one file and read by a task for each core; a task for each where they are large."""
    files = bp.write_ids(docs)
    assert files.count() == many_partitions
    assert len(files.inputFiles()) == 1
    few, each = bp.read_ids(files), bp.read_ids(files, task_ids=1)
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert each.rdd.getNumPartitions() == many_partitions
    want, _ = expected([(r.doc_id, r.text) for r in docs.collect()])
    for read in (few, each):
        got = sorted(map(tuple, read.collect()), key=lambda r: r[1])
        assert [(r[0], r[2], r[3]) for r in got] == want
        assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
