"""An incremental update equals a full run, and validates only what changed."""

import random

import pytest

from citeforge.operators import attribution as A
from citeforge.operators.incremental import ValidationStore, ground_digest

LEDGER = "dataset_id string, source_id string, snapshot_hash string, span_id string, span_hash string"
CITED = "run_id string, claim_id string, citation_id string"


def ledger(spark, n, word="h"):
    return spark.createDataFrame([(f"d{i % 2}", f"s{i % 5}", "v1", f"p{i}", f"{word}{i}") for i in range(n)], LEDGER)


def found(df):
    return sorted((r.run_id, r.claim_id, str(r.citation_id), r.validator_status, r.in_retrieved_evidence) for r in df.collect())


def test_random_changes(spark, tmp_path):
    rng = random.Random(2)
    held = ledger(spark, 20)
    pointers = ["/".join(r) for r in held.collect()]
    retrieved = spark.createDataFrame([(p,) for p in pointers[::2]], "citation_id string")
    store = ValidationStore(spark, f"file://{tmp_path}/store", ["run_id", "claim_id"])
    pick = lambda: rng.choice([*pointers, "a/b", None, pointers[0] + "x"])
    rows = {(f"r{i % 7}", f"c{i}"): pick() for i in range(60)}
    for step in range(3):
        before = dict(rows) if step else {}
        for k in rng.sample(sorted(rows), 6):
            rows.pop(k)
        for k in rng.sample(sorted(rows), 5):
            rows[k] = pick()
        rows |= {("new", f"{step}_{i}"): pick() for i in range(4)}
        citations = spark.createDataFrame([(*k, v) for k, v in rows.items()], CITED)
        got = store.update(citations, held, retrieved)
        assert found(got) == found(A.validate(citations, held, retrieved))
        assert {(r.run_id, r.claim_id) for r in got.where("reused").collect()} == {k for k, v in rows.items() if k in before and before[k] == v}
    # Another ledger makes every stored result void.
    other = ledger(spark, 20, "g")
    got = store.update(citations, other, retrieved)
    assert got.where("reused").count() == 0 and found(got) == found(A.validate(citations, other, retrieved))


@pytest.mark.parametrize("n", [0, 5])
def test_digest_of_the_ground(spark, n):
    none = spark.createDataFrame([], "citation_id string")
    one = ledger(spark, n)
    assert ground_digest(one, none) == ground_digest(one.orderBy("span_id", ascending=False).union(one), none)
    assert ground_digest(one, none) != ground_digest(ledger(spark, n + 1), none)
    assert ground_digest(one, none) != ground_digest(one, spark.createDataFrame([("x",)], "citation_id string"))
