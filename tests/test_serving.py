"""Pruned top-k: equal to scoring everything, and doing less than that."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeforge.operators import evidence as E
from citeforge.operators import serving as S

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def tables(spark):
    """Long documents are few and stand together, as a source's do; some ids tie on their scores."""
    rng = random.Random(5)
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(f"doc_{i:04d}", " ".join(rng.choices(WORDS, weights, k=rng.randint(300, 600) if 500 < i < 520 else rng.randint(0, 12)))) for i in range(1500)]
    questions = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 6)))) for i in range(40)] + [(98, "nothing known"), (99, None)]
    return spark.createDataFrame(questions, "question_id long, question_text string"), spark.createDataFrame(docs, "source_doc_id string, text string"), questions, docs


@pytest.fixture(scope="module")
def index(tables, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('serving')}/index"
    S.write_serving_index(tables[1], folder)
    return folder


def test_ranking_equals_scoring_all(tables, index):
    questions, corpus, *_ = tables
    for k in (1, 8, 64):
        cols = ["question_id", "source_doc_id", "score", "rank"]
        want = sorted(map(tuple, E.rank_evidence(questions, corpus, k).select(cols).collect()))
        assert sorted(map(tuple, S.rank_pruned(questions, index, k).select(cols).collect())) == want
    with pytest.raises(ValueError, match="64"):
        S.rank_pruned(questions, index, 65)


def test_only_asked_buckets_are_read(spark, tables, index):
    terms = E.query_terms(tables[0].where("question_id < 2"))
    blocks = S.asked_buckets(spark, index, "postings", terms)
    asked = {r[0] for r in terms.select(S.bucket_of(F.col("token"))).collect()}
    assert 0 < len(asked) < 20
    assert {int(re.search(r"bucket=(\d+)", f)[1]) for f in (r[0] for r in blocks.select(F.input_file_name()).distinct().collect())} <= asked
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_blocks_are_skipped_and_pairs_left_unscored(tables, index, spark):
    questions, corpus, *_ = tables
    terms = E.query_terms(questions)
    found = S.search(terms, *(S.asked_buckets(spark, index, t, terms) for t in ("postings", "terms")), 2)
    n = S.counts(found).first()
    every = E._scores(questions, corpus, "source_doc_id").count()
    assert n.skipped > n.blocks / 3 and 0 < n.pairs < every / 3
    # What leaves the tasks is at most two rows a question and task.
    assert found.where("question_id is not null").groupBy("question_id", F.input_file_name()).count().agg(F.max("count")).first()[0] <= 2


def test_term_statistics(spark):
    rows = [("t", d, 1 + d // 40) for d in range(200)] + [("u", 3, 7)]
    ids = spark.createDataFrame([(d, d) for d in range(200)], "key long, doc long")
    blocks = S.posting_blocks(spark.createDataFrame(rows, "token string, key long, term_frequency long"), ids, "key")
    got = {r.token: (r.document_frequency, [(x.upto, x.tf) for x in r.best]) for r in S.term_statistics(blocks).collect()}
    assert got == {"t": (200, [(40, 5), (80, 4)]), "u": (1, [(1, 7)])}
    assert blocks.where("token = 't'").count() == 2 and all(len(r.docs) <= S.BLOCK for r in blocks.collect())


@pytest.mark.parametrize("score", [S.FrequencyScore(), S.OverlapScore()])
def test_search_of_any_blocks_equals_brute_force(score):
    rng = np.random.default_rng(1)
    for _ in range(60):
        state, best = S._Search(score, 3), {}
        questions = {q: {t: int(rng.integers(1, 4)) for t in rng.choice(12, rng.integers(1, 6), replace=False)} for q in range(5)}
        for number in rng.permutation(6):
            tf = rng.poisson(rng.choice([0.05, 0.3, 2.0]), (12, S.BLOCK))
            lengths = tf.sum(0) + rng.integers(0, 30, S.BLOCK).astype(float)
            rows = []
            for t in np.argsort((tf > 0).sum(1), kind="stable"):
                asked = [q for q in questions if t in questions[q]]
                docs = np.flatnonzero(tf[t])
                if asked and len(docs):
                    slots = np.array([state.slot(q, len(questions[q]), 0.0) for q in asked])
                    rows.append((int(tf[t].max()), docs, tf[t][docs].astype(float), slots, np.array([questions[q][t] for q in asked], float)))
            if rows:
                state.block(int(number), rows, lengths)
            for q, terms in questions.items():
                gain = sum(score.gain(f, tf[t]) for t, f in terms.items()).astype(float)
                docs = np.flatnonzero(gain)
                values = score.final(gain[docs], lengths[docs], len(terms))
                best.setdefault(q, []).extend((-v, int(number) * S.BLOCK + int(d)) for v, d in zip(values, docs))
        for q, slot in state.slots.items():
            want = sorted(best[q])[:3]
            s, d = state.best[slot]
            assert [(-v, int(n)) for v, n in zip(s, d)] == want


def test_spans_equal_brute_force(spark, tables):
    """Short question, no overlap, and a question without any word left."""
    questions, corpus, asked, docs = tables
    spans = corpus.withColumnRenamed("source_doc_id", "span_id")
    got = {(r.question_id, r["rank"]): (r.span_id, r.score) for r in S.retrieve_spans(questions, spans).collect()}
    assert len(got) == 2 * len(asked)
    for q, text in asked[:15] + asked[-2:]:
        words = re.findall("[a-z0-9]+", (text or "").lower())
        ranked = []
        for name, body in docs:
            own = body.split()
            o = sum(min(own.count(w), words.count(w)) for w in set(words))
            ranked.append((-round(o / len(set(words)) + o / len(own) ** 0.5, 6) if o else 0.0, name))
        assert [got[q, k][0] for k in (1, 2)] == [n for _, n in sorted(ranked)[:2]]
