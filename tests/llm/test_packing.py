import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import encode_all
from hypothesis import given, settings
from hypothesis import strategies as st

from citeforge.llm import packing as pk


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=120))
def test_windows_hold_their_pieces(sizes):
    sizes = np.array(sizes)
    window = pk.pack_bucket(sizes)
    loads = np.bincount(window, weights=sizes)
    assert loads.max() <= pk.CAPACITY
    assert window.max() + 1 <= 1 + sizes.sum() // (pk.CAPACITY - 1024)


@given(st.lists(st.integers(1, 1024), min_size=1, max_size=300), st.integers(1, 200))
def test_bundles_are_small_and_few(sizes, most):
    sizes = np.array(sizes)
    bundle = pk.bundled(sizes, most)
    sums, counts = np.bincount(bundle, weights=sizes), np.bincount(bundle)
    assert counts.min() > 0 and all(counts[b] == 1 for b, s in zip(bundle, sizes, strict=True) if s >= most)
    assert sums[counts > 1].max(initial=0) < 2 * most
    assert len(sums) <= (sizes >= most).sum() + 1 + 2 * sizes[sizes < most].sum() // most


def test_very_many_tiny_pieces():
    """As many pieces as ids: no more is held than for a bucket of large ones, and nothing is padded."""
    tracemalloc.start()
    window = pk.pack_bucket(np.ones(128 * pk.CAPACITY, np.int64))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert np.array_equal(np.bincount(window), np.full(128, pk.CAPACITY))


def test_very_many_empty_texts(spark):
    rows = spark.range(50_000).selectExpr("id AS doc_id", "'' AS text")
    out = pk.pack_documents(rows).groupBy("sequence_id").count().collect()
    assert sum(r["count"] for r in out) == 50_000 and len(out) == 13


def test_differencing_balances():
    assert np.ptp(np.bincount(pk.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) <= 2
    sizes = np.random.default_rng(0).integers(1, 1000, 500)
    assert np.ptp(np.bincount(pk.differencing(sizes, 20), weights=sizes)) < 50


@given(st.integers(1, 100_000))
def test_cuts_cover_the_document(n):
    at = 0
    for start, size in pk.cuts(n):
        assert start == at and 0 < size <= pk.CAPACITY
        at += size
    assert at == n


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_each_id_lies_in_one_piece(table, request):
    df = request.getfixturevalue(table)
    out = pk.pack_documents(df, keep_ids=True).collect()
    source = df.collect()
    want = Counter((r.doc_id, tuple(ids)) for r, ids in zip(source, encode_all("word_bpe_49k.json", [r.text for r in source]), strict=True))
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) and r.length == len(r.ids)
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, pieces in by_doc.items():
        copies = sum(n for (d, _), n in want.items() if d == doc_id)
        ids = [i for (d, x) in want for i in x if d == doc_id]
        assert sum(p.length for p in pieces) == sum(len(x) * n for (d, x), n in want.items() if d == doc_id)
        if copies == 1:
            assert [i for p in sorted(pieces, key=lambda p: p.start) for i in p.ids] == ids
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= pk.CAPACITY
        padding += pk.CAPACITY - at
    if table == "docs":
        assert padding < 0.03 * pk.CAPACITY * len(sequences)


def test_empty_table(empty):
    assert pk.pack_documents(empty).collect() == []
