import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeforge.llm import components, oddsketch


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    by, top = {}, {d: d for d in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    for d, s in sets.items():
        for e in {e for g in s for e in by[g] if e < d}:
            both = len(s & sets[e])
            if 100 * both >= 75 * (len(s) + len(sets[e]) - both):
                a, b = sorted((root(d), root(e)))
                top[b] = a
    return {(d, len(s), root(d), root(d) == d) for d, s in sets.items()}


def got(df):
    return {tuple(r) for r in oddsketch.near_duplicates(df).drop("text_key").collect()}


def test_documents_equal_brute_force(docs):
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def variants(seed, n, edits):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    for _ in range(n):
        copy = list(words)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


@pytest.mark.parametrize(("bucket_block", "block"), [(1024, 256), (16, 20)])
def test_large_groups_of_variants(spark, bucket_block, block, monkeypatch):
    monkeypatch.setattr(oddsketch, "BUCKET_BLOCK", bucket_block)
    monkeypatch.setattr(oddsketch, "BLOCK", block)
    texts = [*variants(1, 80, 4), *variants(2, 60, 8), *variants(3, 60, 5), "same text of only six words"] + ["same TEXT of only six words"] * 30 + ["a b", "a b", "A  b", "b a", "", None]
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts, 100))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_twenty_thousand_near_copies_are_one_group(spark):
    """All are near the text with the smallest id; few pairs, and no block pairs, are enough."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    rows = [(7, " ".join(words))]
    for i in range(20_000):
        copy = list(words)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(120)] = f"x{i}"
        rows.append((100 + i, " ".join(copy)))
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert out.groupBy("component_id").count().collect() == [(7, 20_001)]
    assert out.where("kept").count() == 1


def test_unlinked_sets_in_one_bucket(spark, monkeypatch):
    """Texts that share much and are not linked meet in buckets, in blocks of outsiders and others."""
    monkeypatch.setattr(oddsketch, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(oddsketch, "BLOCK", 12)
    rng = random.Random(11)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(90):
        copy = list(base)
        for k in rng.sample(range(100), 4 if i % 3 else 2):
            copy[k] = f"x{i}.{k}"
        rows.append((i, " ".join(copy)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_an_id_with_several_texts(spark):
    """Each text of an id is linked by its own set."""
    a, b = ([f"{c}{k}" for k in range(60)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, near(a)), (7, near(b)), (8, "something else of more than five words")]
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]


def test_odd_rows(odd):
    out = oddsketch.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out}
    assert by[None].component_id is None and by[None].kept
    assert (by[2].n_shingles, by[2].component_id, by[2].kept) == (0, 2, True) and by[3].kept and by[4].kept
    assert by[5].n_shingles == 1


def test_one_of_each(spark, odd, docs):
    odd = odd.withColumns({c: F.lit("x") for c in ("gone_id", "gone_key", "again_id", "id", "key", "row", "text_key")})
    kept = oddsketch.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7]
    ids = sorted(r.doc_id for r in oddsketch.one_of_each(docs).collect())
    assert ids == sorted(d for d, _, _, keep in brute([(r.doc_id, r.text) for r in docs.collect()]) if keep)


def test_empty_table(empty):
    assert got(empty) == set()


def test_estimate_is_close(spark):
    rng = np.random.default_rng(0)
    for share in (0.6, 0.75, 0.9):
        real, ones = [], []
        for _ in range(40):
            common, rest = rng.integers(0, 1 << 62, 600).astype(np.uint64), rng.integers(0, 1 << 62, 2000).astype(np.uint64)
            k = int(600 * (1 - share) / (2 * share))
            a, b = np.concatenate([common, rest[:k]]), np.concatenate([common, rest[1000 : 1000 + k]])
            odd = oddsketch.odd_sketches(np.stack([oddsketch.samples_of(a), oddsketch.samples_of(b)]))
            ones.append(int(np.unpackbits((odd[0] ^ odd[1]).view(np.uint8)).sum()))
            real.append(600 / (600 + 2 * k))
        table = spark.createDataFrame([(x,) for x in ones], "ones int").select(oddsketch.similarity_estimate(F.col("ones")).alias("e"))
        estimates = [r.e for r in table.collect()]
        assert abs(np.mean(estimates) - np.mean(real)) < 0.02 and min(estimates) > oddsketch.LEAST_ESTIMATE - 0.1 * (share < 0.7)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(50)] + [(500, 500 + k) for k in range(1, 40)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        top[y] = x
    out = components.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {(r.node, r.component) for r in out.collect()} == {(x, root(x)) for x in linked}


def test_small_tables_are_not_spread_over_all_partitions(spark, monkeypatch):
    """Few rows are written by few tasks, however many partitions a shuffle has, and the texts of
    nodes that were confirmed are not read once more for the last links."""
    monkeypatch.setattr(oddsketch, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(oddsketch, "BLOCK", 20)
    files, real = {}, oddsketch.shared.materialize

    def counted(df, name, *args):
        table = real(df, name, *args)
        files.setdefault(name, []).append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(oddsketch.shared, "materialize", counted)
    texts = [*variants(1, 60, 4), *variants(2, 60, 8)]
    rows = list(enumerate(texts, 100))
    held = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = spark.sparkContext.defaultParallelism
    assert {k: v for k, v in files.items() if max(v) > most} == {}
    assert len(files["rows"]) == 1 and len(files["sets"]) == 1 + len(files["promising"])
