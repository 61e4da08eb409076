"""Snapshots are seen whole or not at all; of two updates of one version one wins."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from citeforge.operators import snapshots as P

CORPUS = "dataset_id string, split string, source_doc_id string, source_uri string, text string"


def corpus(spark, n, word="a"):
    return spark.createDataFrame([(f"d{i % 2}", "en" if i % 3 else None, f"doc_{i}", "u", f"{word} {i}") for i in range(n)], CORPUS)


def questions(spark):
    return spark.createDataFrame([("d0", 1, "x"), ("d0", 2, None), ("d9", 3, "z")], "dataset_id string, question_id long, question_text string")


@pytest.fixture
def versions(spark, tmp_path):
    return P.Versions(spark, f"file://{tmp_path}/snapshots")


def test_a_reader_keeps_the_old_snapshot(spark, versions):
    assert versions.newest() == 0
    with pytest.raises(ValueError):
        versions.read("corpus")
    P.publish_snapshot(versions, corpus(spark, 9), questions(spark))
    held = versions.read("corpus")
    during = []

    def check(record):  # the second build is staged by now
        during.append((versions.newest(), versions.read("corpus").count(), record.agg({"corpus_doc_count": "sum"}).first()[0]))

    assert P.publish_snapshot(versions, corpus(spark, 20, "b"), questions(spark), check=check) == 2
    assert during == [(1, 9, 20)]
    assert held.count() == 9 and {r.text[0] for r in held.collect()} == {"a"}
    assert versions.read("corpus").count() == 20 and versions.read("corpus", 1).count() == 9
    assert versions.entry(2)["facts"]["corpus_doc_count"] == 20


def test_a_failed_build_leaves_nothing(spark, versions):
    P.publish_snapshot(versions, corpus(spark, 4), questions(spark))

    def check(record):
        raise RuntimeError("not good enough")

    with pytest.raises(RuntimeError):
        P.publish_snapshot(versions, corpus(spark, 5), questions(spark), check=check)
    assert versions.newest() == 1 and versions.read("corpus").count() == 4


def test_digests_follow_the_rows(spark, versions):
    def record(n, word="a"):
        P.publish_snapshot(versions, corpus(spark, n, word), questions(spark))
        return {(r.dataset_id, r.split): (r.processed_corpus_hash, r.question_count, r.source_snapshot_id) for r in versions.read("record").collect()}

    one, same, other = record(9), record(9), record(9, "b")
    assert one == same and len({*one.values()} & {*other.values()}) == 0
    assert {k: v[1] for k, v in one.items()} == {("d0", None): 2, ("d0", "en"): 2, ("d1", None): 0, ("d1", "en"): 0}
    assert one["d0", "en"][2] == f"d0_en_official_{one['d0', 'en'][0][:16]}"
    empty = versions.spark.createDataFrame([], CORPUS)
    P.publish_snapshot(versions, empty, questions(spark))
    assert versions.read("record").count() == 0


def test_newest_of_any_number(spark, versions):
    for n in range(1, 20):
        assert versions.publish(n - 1, {}, {"n": n}) == n
        assert versions.newest() == n
    with pytest.raises(P.Conflict):
        versions.publish(18, {}, {})
    with pytest.raises(P.Conflict):
        versions.publish(30, {}, {})


@pytest.fixture
def registry(spark, tmp_path):
    r = P.Registry(spark, f"file://{tmp_path}/registry")
    assert r.read() is None
    r.update(spark.createDataFrame([(f"d{i}", "pending", i) for i in range(5)], "dataset_id string, status string, n int"), 0)
    return r


def rows(registry, version=None):
    return sorted((r.dataset_id, r.status, r.n, r.version) for r in registry.read(version).collect())


def test_of_two_promotions_one_wins(spark, registry):
    def promote(k):
        try:
            return registry.update(spark.createDataFrame([("d1", f"ready_{k}", k)], "dataset_id string, status string, n int"), 1)
        except P.Conflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(promote, range(4)))
    assert sorted(x for x in made if x) == [2]
    k = made.index(2)
    assert rows(registry) == [("d0", "pending", 0, 1), ("d1", f"ready_{k}", k, 2), *[(f"d{i}", "pending", i, 1) for i in (2, 3, 4)]]
    assert rows(registry, 1)[1] == ("d1", "pending", 1, 1)


def test_compaction_changes_no_record(spark, registry):
    schema = "dataset_id string, status string, n int"
    registry.update(spark.createDataFrame([("d1", None, 7), ("d8", "new", 8)], schema), 1)
    registry.update(spark.createDataFrame([("d1", "again", 9)], schema), 2)
    before = rows(registry)
    assert registry.compact() == 4 and rows(registry) == before
    assert len(registry._since_full(4)) == 1 and len(registry._since_full(3)) == 3
    registry.update(spark.createDataFrame([("d0", "late", 1)], schema), 4)
    assert rows(registry) == [("d0", "late", 1, 5), *before[1:]]
    assert [(v, "again" in r) for v, r in registry.history("d1")] == [(1, False), (2, False), (3, True)]
    with pytest.raises(ValueError, match="d2"):
        registry.update(spark.createDataFrame([("d2", "x", 1), ("d2", "y", 2)], schema), 5)
    assert registry.versions.newest() == 5
