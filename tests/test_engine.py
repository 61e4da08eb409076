"""Cases of single operators."""

import random

import pytest
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import attribution as A
from citeforge.operators import evidence as E
from citeforge.operators import judging as J
from citeforge.operators import metrics as M
from citeforge.operators import rules as R
from citeforge.operators import serving as S

LEDGER = "dataset_id string, source_id string, snapshot_hash string, span_id string, span_hash string"


def python_status(cited, ledger, retrieved, label):
    p = (cited or "").split("/")
    if len(p) != 5 or "" in p:
        return "malformed_citation_id"
    spans = [r for r in ledger if (r[0], r[1], r[3]) == (p[0], p[1], p[3])]
    if not spans:
        return "nonexistent_citation_id"
    if not any(r[2] == p[2] for r in spans):
        return "wrong_snapshot_hash"
    if not any(r[2] == p[2] and r[4] == p[4] for r in spans):
        return "wrong_span_hash"
    if cited not in retrieved:
        return "citation_id_not_in_retrieved_evidence"
    if label in A.UNSUPPORTED:
        return "structurally_valid_but_semantically_unsupported_citation"
    return "overclaim_partially_supported_claim" if label in A.PARTIAL else "valid_citation"


def test_validator_on_mutated_pointers(spark):
    rng = random.Random(3)
    ledger = [(f"d{i % 2}", f"s{i % 5}", f"v{i % 3}", f"p{i}", f"h{i}") for i in range(30)] + [("d0", "s0", "v9", "p0", "h9")]
    pointers = ["/".join(r) for r in ledger]
    retrieved = set(pointers[::2])
    labels = [None, "entailed", "unsupported", "contradictory", "insufficient_evidence", "partially_supported", "overclaim", "odd"]
    rows = []
    for i in range(400):
        parts = rng.choice(pointers).split("/")
        k = rng.randrange(9)
        if k < 5:
            parts[k] = rng.choice(["", "x", parts[k] + "y"])
        elif k == 5:
            parts = parts[:4]
        rows.append((i, "/".join(parts) if rng.random() > 0.02 else None, rng.choice(labels)))
    out = A.validate(spark.createDataFrame(rows, "i int, citation_id string, semantic_label string"), spark.createDataFrame(ledger, LEDGER), spark.createDataFrame([(x,) for x in retrieved], "citation_id string"))
    got = {r.i: r for r in out.collect()}
    assert len(got) == len(rows)
    for i, cited, label in rows:
        status = python_status(cited, ledger, retrieved, label)
        assert got[i].validator_status == status
        assert (got[i].structural_validity == "valid") == (status.startswith(("valid", "structurally", "overclaim")))
        assert got[i].span_replay_success == (status not in ("malformed_citation_id", "nonexistent_citation_id", "wrong_snapshot_hash", "wrong_span_hash"))
        assert got[i].semantic_support == (label or "pending")
    assert len({r.validator_status for r in got.values()}) == 8


def test_validator_is_scoped(spark):
    ledger = spark.createDataFrame([("r1", "d", "s", "v", "p", "h")], "run_id string, " + LEDGER)
    cited = spark.createDataFrame([("r1", "d/s/v/p/h"), ("r2", "d/s/v/p/h")], "run_id string, citation_id string")
    out = A.validate(cited, ledger, cited, ["run_id"])
    assert {r.run_id: r.validator_status for r in out.collect()} == {"r1": "valid_citation", "r2": "nonexistent_citation_id"}


@pytest.mark.parametrize(
    ("claim", "span", "want"),
    [
        ("the cat sat", "a cat sat on the mat", ("entailed", 1.0)),
        ("the cat never sat", "the cat sat here", ("contradictory", 0.666667)),
        ("red green blue yellow", "red green blue", ("partially_supported", 0.75)),
        ("red green", "blue", ("unsupported", 0.0)),
        ("", "x", ("insufficient_evidence", 0.0)),
        ("the of", "x", ("insufficient_evidence", 0.0)),
        ("x", None, ("insufficient_evidence", 0.0)),
    ],
)
def test_verdicts(spark, claim, span, want):
    row = spark.createDataFrame([(claim, span)], "c string, s string").select(A.meaning(F.col("c")).alias("c"), A.meaning(F.col("s")).alias("s")).select(A.verdict(F.col("c"), F.col("s")).alias("v")).first().v
    assert (row.verdict, row.confidence) == want


def test_rates_of_three_citations(spark):
    rows = [("r", "c1", "valid_citation"), ("r", "c2", "malformed_citation_id"), ("r", "c3", "citation_id_not_in_retrieved_evidence")]
    flags = A.with_flags(spark.createDataFrame(rows, "run_id string, claim_id string, validator_status string"), F.lit(None).cast("string"))
    got = M.validation_rates(flags.agg(*[c.alias(n) for n, c in M.validation_counts().items()])).first()
    assert (got.citation_id_validity_rate, got.invalid_citation_rate, got.span_replay_success_rate) == (0.333333, 0.666667, 0.666667)


def test_rankings(spark):
    q = spark.createDataFrame([(1, "red red blue"), (2, "zzz")], "question_id long, question_text string")
    docs = spark.createDataFrame([("a", "blue"), ("b", "red"), ("c", "blue"), ("d", None)], "source_doc_id string, text string")
    ranked = E.rank_evidence(q, docs, 2)
    assert sorted((r.question_id, r.rank, r.source_doc_id, r.score) for r in ranked.collect()) == [(1, 1, "b", 2), (1, 2, "a", 1)]
    context = spark.createDataFrame([(1, "d"), (1, "c"), (2, "a"), (2, "b")], "question_id long, source_doc_id string")
    scoped = E.rank_scoped(q, docs, context, 8)
    assert sorted((r.question_id, r.rank, r.source_doc_id) for r in scoped.collect()) == [(1, 1, "c"), (1, 2, "d"), (2, 1, "a"), (2, 2, "b")]
    spans = docs.select(F.col("source_doc_id").alias("span_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = S.retrieve_spans(q, spans, 2).collect()
    assert {(r.question_id, r.rank, r.span_id) for r in found} == {(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "b")}


def test_digest_depends_on_order_and_content(spark):
    def digest(texts):
        rows = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "dataset_id string, at long, t string")
        return E.digest_tree(rows, "at", F.col("t"), "dataset_id", width=3).first().corpus_hash

    base = digest([str(i) for i in range(20)])
    assert base == digest([str(i) for i in range(20)])
    assert base != digest([str(i) for i in reversed(range(20))]) and base != digest([str(i) for i in range(19)] + ["x"])


def test_digest_has_one_node_at_any_size(spark):
    import hashlib

    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for n in (1, 26, 27, 28, 81, 82, 100):
        rows = spark.createDataFrame([("d", i) for i in range(n)], "dataset_id string, at long")
        out = E.digest_tree(rows, "at", F.col("at").cast("string"), "dataset_id", width=3).collect()
        level, rounds = [h(str(i)) for i in range(n)], 0
        while len(level) > 1 or rounds < 3:
            level = [h("\n".join(level[k : k + 3])) for k in range(0, len(level), 3)]
            rounds += 1
        assert [r.corpus_hash for r in out] == level


def test_support_of_short_questions(spark):
    from citeforge.plans.catalogue import _support

    items = spark.createDataFrame([(1, "two words"), (2, "one"), (3, "three plain words"), (4, "four words in all"), (5, "of the of the x"), (6, None), (7, "absent")], "question_id long, question_text string")
    texts = ["here two words are", "no such thing", "gone and done", "three plain words", "xthree plain wordsy", "all four words in all here", "of the of the x", None, ""]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "source_doc_id string, text string")
    got = {tuple(r) for r in _support(items, docs).collect()}
    assert got == {(r.question_id, d.source_doc_id) for r in items.collect() for d in docs.collect() if r.question_text and d.text and r.question_text in d.text}


def test_questions_without_a_context_are_ranked_among_all(spark):
    q = spark.createDataFrame([(1, "red"), (2, "blue red")], "question_id long, question_text string")
    docs = spark.createDataFrame([("a", "blue"), ("b", "red red"), ("c", "green")], "source_doc_id string, text string")
    context = spark.createDataFrame([(1, "a"), (1, "c")], "question_id long, source_doc_id string")
    got = {(r.question_id, r.rank, r.source_doc_id) for r in E.rank_scoped(q, docs, context, 2).collect()}
    assert got == {(1, 1, "a"), (1, 2, "c"), (2, 1, "b"), (2, 2, "a")}


def test_ranking_drops_tokens_before_its_first_shuffle(spark):
    docs = spark.createDataFrame([("a", "blue sky"), ("b", "red")], "source_doc_id string, text string")
    q = spark.createDataFrame([(1, "red")], "question_id long, question_text string")
    plan = E.rank_evidence(q, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.index("RepartitionByExpression")  # deeper, so earlier


def test_texts_are_tokenised_once(spark):
    rows = spark.createDataFrame([("c", "valid", "a b", "s")], "claim_id string, structural_validity string, claim_text string, span_text string")
    facts = A.span_facts(rows.select("claim_id", "span_text"), "claim_id")
    out = A.semantic_records(rows.drop("span_text").join(facts, "claim_id"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("[a-z0-9]+") == 2
    assert out.first().verdict == "unsupported"


def test_replaceable_evaluator(spark):
    rows = spark.createDataFrame([("c", "valid", "a b", "s"), ("d", "invalid", "x", "s")], "claim_id string, structural_validity string, claim_text string, span_text string")
    facts = A.span_facts(rows.select("claim_id", "span_text"), "claim_id")
    always = lambda c, s: F.struct(F.lit("entailed").alias("verdict"), F.lit(0.5).alias("confidence"))
    out = A.semantic_records(rows.drop("span_text").join(facts, "claim_id"), always).collect()
    assert {(r.claim_id, r.verdict, r.semantic_status) for r in out} == {("c", "entailed", "evaluated"), ("d", None, "skipped")}


def test_support_references_take_the_last_context(spark):
    corpus = spark.createDataFrame([("q", 0, "River Museum", "d0"), ("q", 1, "River  Museum", "d1")], "question_id string, context_index int, title string, source_doc_id string")
    facts = spark.createDataFrame([("q", "River Museum", 0), ("q", "Lost", 2)], "question_id string, title string, sentence_index int")
    assert {(r.title, r.sentence_id) for r in E.support_references(facts, corpus).collect()} == {("River Museum", "d1_sent_0"), ("Lost", None)}


def test_judging(spark):
    def judge(row):
        if row["claim_text"] == "boom":
            raise RuntimeError("down")
        return {"label": "odd"} if row["claim_text"] == "odd" else {"label": "entailed", "confidence": "2", "rationale": 1}

    items = spark.createDataFrame([(1, "a", "s"), (2, "boom", "s"), (3, "odd", "s"), (4, "a", " ")], "i int, claim_text string, cited_span_text string")
    got = {r.i: (r.judge_status, r.judge_label, r.judge_confidence) for r in J.apply_judge(items, judge).collect()}
    assert got == {1: ("labeled", "entailed", 1.0), 2: ("error", "", 0.0), 3: ("error", "", 0.0), 4: ("skipped", "", 0.0)}
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in J.last_labels(rows, "o", "k").collect()} == {("a", "y"), ("b", "z")}
    old = spark.createDataFrame([("1", "contradictory"), ("2", "entailed"), ("3", "entailed")], "annotation_id string, judge_label string")
    new = spark.createDataFrame([("1", "entailed"), ("2", "unsupported"), ("3", "entailed"), ("4", "entailed")], "annotation_id string, judge_label string")
    compared = J.compare_labels(old, new)
    assert compared.agg(F.count("*"), F.count_if("changed"), F.count_if("from_contradictory"), F.count_if("from_entailed")).first()[:] == (3, 2, 1, 1)


def test_audit_subset_prefers_doubtful_labels(spark):
    labels = ["entailed"] * 6 + ["unsupported"] * 3 + ["contradictory"] * 3 + ["partially_supported"] * 2 + ["strange"]
    rows = spark.createDataFrame(list(enumerate(labels)), "i int, judge_label string")
    got = [r.judge_label for r in J.audit_subset(rows, "i", 8).collect()]
    assert got == ["contradictory"] * 3 + ["partially_supported"] * 2 + ["unsupported"] * 3


def test_ordinals(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(7)
    assert {(r.k, r.ordinal) for r in J.with_ordinal(rows, ["k"]).collect()} == {(k, k + 1) for k in range(1000)}


def test_registry_differences(spark):
    a = spark.createDataFrame([("x", "1", "p"), ("y", "2", "q")], "k string, f string, g string")
    b = spark.createDataFrame([("x", "1", "other"), ("z", "3", None)], "k string, f string, g string")
    assert {tuple(r) for r in R.field_mismatches(a, b, "k", ["f", "g"]).collect()} == {("x", "g", "p", "other"), ("y", "f", "2", None), ("y", "g", "q", None)}
    assert {tuple(r) for r in R.set_differences(a, b, "k").collect()} == {("y", "missing"), ("z", "unexpected")}
    assert [tuple(r) for r in R.duplicates(a.union(a.limit(1)), "k").collect()] == [("x", 2)]


def test_legacy_ids_last_wins(spark):
    evidence = spark.createDataFrame([("r", 1, "P1", "e", "s"), ("r", 2, "P2", "e", "e2")], "run_id string, position int, citation_id string, evidence_id string, ledger_span_id string")
    cited = spark.createDataFrame([("r", "e"), ("r", "s"), ("r", "new"), ("q", "e")], "run_id string, cited_id string")
    assert {(r.run_id, r.cited_id, r.citation_id) for r in A.resolve_legacy(cited, evidence).collect()} == {("r", "e", "P2"), ("r", "s", "P1"), ("r", "new", "new"), ("q", "e", "e")}


def test_pointer_needs_all_parts(spark):
    df = spark.createDataFrame([("a", "b", None, "d", "e")], "a string, b string, c string, d string, e string")
    built = df.select(A.pointer(*[F.col(c) for c in "abcde"]).alias("p"))
    assert built.first().p == "a/b//d/e" and built.select(A.parsed(F.col("p"))).first()[0] is None
    assert df.select(T.first_of(F.col("c"), F.lit(""), F.col("d"))).first()[0] == "d"


def test_one_large_group_is_numbered_in_many_tasks(spark):
    off = "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(2000).selectExpr("'src' as dataset_id", "if(id < 1900, 'en', null) as split", "lpad(cast(id as string), 6, '0') as source_doc_id", "repeat('word ', 50) as text")
    spark.conf.set(off, "false")
    try:
        out = E.index_documents(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(off)
    assert len({r.task for r in out if r.split}) > 1
    assert sorted((r.split or "", r.internal_doc_id, r.source_doc_id) for r in out) == sorted([("en", i, f"{i:06}") for i in range(1900)] + [("", i, f"{1900 + i:06}") for i in range(100)])
