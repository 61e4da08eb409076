from brute import encode_all
from test_containment import brute as leaks
from test_markov import brute as base_secrets
from test_odd_sketch import brute as groups

import corpus_pipeline as cp
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def texts(rows):
    return [(r.doc_id, r.text) for r in rows]


def test_each_stage_equals_brute_force(spark, docs, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["language", "near copies", "benchmark leaks", "secrets", "packing"]
    items = texts(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id").collect())
    before, table = docs.collect(), docs
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, table, SF)
        if name == "packing":
            break
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{i}")
        table = spark.read.parquet(f"{tmp_path}/{i}")
        after = table.collect()
        ids = {r.doc_id for r in after}
        if name == "language":
            assert {r.doc_id for r in before if not any(c.isalpha() for c in r.text or "")}.isdisjoint(ids) and len(after) > 0.9 * len(before)
            assert set(after) <= set(before)
        elif name == "near copies":
            assert ids == {d for d, _, _, keep in groups(texts(before)) if keep} and set(after) <= set(before)
        elif name == "benchmark leaks":
            assert ids == {r.doc_id for r in before} - {d for d, *_ in leaks(texts(before), items)} and set(after) <= set(before)
        else:
            old = {r.doc_id: r for r in before}
            assert ids == set(old)
            for r in after:
                assert not base_secrets(r.text)
                assert r == old[r.doc_id] or (base_secrets(old[r.doc_id].text) and "[SECRET]" in r.text and r.n_chars == len(r.text))
        before = after
    packed = out.collect()
    want = {r.doc_id: len(ids) for r, ids in zip(before, encode_all("word_bpe_49k.json", [r.text for r in before]), strict=True)}
    got: dict = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, cp.run(spark, SF).collect())) == sorted(map(key, packed))


CLASHING = ["row", "key", "id", "lang_pred", "lang_score", "base_spans", "all_spans", "clean", "clean_text", "gone_id", "gone_key", "again_id", "held_text_key", "text_key", "item", "hash", "words"]


def test_columns_with_the_stages_own_names_stay(spark, docs, tmp_path):
    """What a stage keeps does not depend on other columns, and these stay as they are."""
    plain = docs.where("doc_id < 60")
    more = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for i, (_, stage) in enumerate(cp.STAGES):
        outs = [stage(spark, table, SF) for table in (plain, more)]
        if i == 4:
            break
        assert outs[1].columns == more.columns
        for k, out in enumerate(outs):
            out.write.parquet(f"{tmp_path}/{i}.{k}")
        plain, more = (spark.read.parquet(f"{tmp_path}/{i}.{k}") for k in (0, 1))
        rows = more.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)
        assert sorted(map(tuple, plain.collect())) == sorted(tuple(r[c] for c in plain.columns) for r in rows)


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, table in (("odd", odd), ("empty", empty)):
        for i, (_, stage) in enumerate(cp.STAGES):
            stage(spark, table, SF).write.parquet(f"{tmp_path}/{name}{i}")
            if i < 4:
                assert spark.read.parquet(f"{tmp_path}/{name}{i}").columns == table.columns
                table = spark.read.parquet(f"{tmp_path}/{name}{i}")


def test_sample_ids(spark):
    from citeforge.llm import shared

    rows = spark.range(50_000).select((F.col("id") % 40_000).alias("doc_id"))
    every = [r[0] for r in rows.distinct().orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 1)).limit(100).collect()]
    assert shared.sample_ids(rows, 100) == every
    assert len(shared.sample_ids(rows, 100_000)) == 40_000
