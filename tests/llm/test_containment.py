import re

import pytest
from pyspark.sql import functions as F

from citeforge.llm import containment as ct
from citeforge.llm import shared


def shingles(text):
    w = [x for x in re.split("[\x09-\x0d\x20]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs, items):
    held = [(i, shingles(t)) for i, t in items]
    out = set()
    for d, t in docs:
        s = shingles(t)
        out |= {(d, i, len(g), len(g & s)) for i, g in held if g and 100 * len(g & s) >= 75 * len(g)}
    return out


def found(docs, items):
    return {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in ct.contained_items(docs, items).collect()}


def test_documents_equal_brute_force(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert found(docs, items) == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_edited_items_in_long_documents(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", most)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(3 + 7 * k))) for k in range(12)] + [(50, None), (51, " "), (52, "short one")]
    docs = []
    for k, t in items[:12]:
        w = t.split()
        for edits in range(4):
            v = list(w)
            for e in range(edits):
                v[(e * 11 + 2) % len(v)] = "changed"
            docs.append((len(docs), " ".join(["filler words go here"] * 50 + v + ["and more filler"] * 50)))
    docs += [(900, "short one"), (901, "a short one is here now"), (902, None), (None, items[5][1]), (903, items[5][1].upper()), (903, items[5][1].upper()), (904, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("hash", F.lit(2)).withColumn("key", F.lit(3)).withColumn("held_text_key", F.lit(4)).withColumn("row", F.lit(5))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = brute(docs, items)
    assert found(d, b) == want and any(x[0] is None for x in want) and (900, 52, 1, 1) in want
    kept = ct.clean_documents(d, b)
    assert kept.columns == d.columns
    held = {x[0] for x in want}
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted((i, t) for i, t in docs if i not in held and i is not None and t)


def test_no_rows(spark, empty, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert found(docs, items) == set() and found(empty, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")) == set()
    assert ct.clean_documents(docs, items).count() == docs.count()
