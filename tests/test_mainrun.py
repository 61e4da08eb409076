"""The composed run: restarts, stops, retries and what a request holds."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from citeforge.operators import mainrun as N
from citeforge.operators.judging import settled
from citeforge.sources.folders import put_once, read_text

SPANS = [(f"doc_{i}", f"Title {i}", f"Harbour {i} was quiet. It is not blue.", "d", f"s{i}", "v1", f"p{i}", f"h{i}") for i in range(4)]


@pytest.fixture(scope="module")
def inputs(spark):
    spans = spark.createDataFrame(SPANS, "source_doc_id string, title string, text string, dataset_id string, source_id string, snapshot_hash string, span_id string, span_hash string")
    ranked = spark.createDataFrame([(f"q{i}", f"doc_{(i + k) % 4}", 9.0 - k, k + 1) for i in range(10) if i != 7 for k in range(2)], "question_id string, source_doc_id string, score double, rank int")
    plan = spark.createDataFrame([(i * 2 + b + 1, f"run_{i}_{b}", "d", f"q{i}", f"Harbour {i} was quiet", ("ledger_only", "vanilla")[b]) for i in range(10) for b in range(2)], "plan_order long, run_id string, dataset_id string, question_id string, question_text string, baseline string")
    return plan, settled(N.enrich(ranked, spans))


def answering(fails=(), cut=(), log=None):
    def generate(row):
        if log:
            with open(log, "a") as out:
                out.write(row["run_id"] + "\n")
        if row["run_id"] in fails:
            raise RuntimeError("down")
        ids = json.loads(row["request"].split("valid_evidence_ids:\n")[1].split("\n")[0])
        answer = {"global_answer": "x", "refusal": not ids, "atomic_claims": [{"text": row["question_text"]}], "citations": [{"claim_id": "c1", "cited_evidence_id": i} for i in [*ids, "d/s9/v1/p9/h9"]]}
        return {"content": json.dumps(answer)[: -2 if row["run_id"] in cut else None], "prompt_tokens": 7, "completion_tokens": 3}

    return generate


def rows(spark, folder):
    return sorted(map(str, N.RunFolder(spark, folder).read().collect()))


class Killed(Exception):
    pass


def test_a_run_killed_anywhere_ends_as_an_unbroken_one(spark, inputs, tmp_path, monkeypatch):
    plan, evidence = inputs
    go = lambda folder, log=None: N.run_batches(plan, evidence, answering(fails={"run_3_0"}, cut={"run_5_1"}, log=log), folder, 6, wait=0)
    whole = f"file://{tmp_path}/whole"
    totals = go(whole)
    assert (totals.batches, totals.runs, totals.success_count, totals.provider_errors, totals.json_errors, totals.prompt_tokens, totals.stopped) == (4, 20, 18, 1, 1, 19 * 7, False)
    for after in range(4):
        for before_commit in (True, False):
            folder = f"file://{tmp_path}/killed_{after}_{before_commit}"
            real = N.RunFolder.commit

            def commit(self, batch, attempt, t):
                if batch == after and before_commit:
                    raise Killed
                done = real(self, batch, attempt, t)
                if batch == after:
                    raise Killed
                return done

            with monkeypatch.context() as m:
                m.setattr(N.RunFolder, "commit", commit)
                with pytest.raises(Killed):
                    go(folder)
            log = str(tmp_path / f"calls_{after}_{before_commit}")
            assert go(folder, log) == totals
            assert rows(spark, folder) == rows(spark, whole)
            called = set(open(log).read().split()) if os.path.exists(log) else set()
            assert called == {r.run_id for r in plan.where(F.col("plan_order") > 6 * (after + (not before_commit))).collect()}


def test_too_many_failures_stop_the_run(spark, inputs, tmp_path):
    plan, evidence = inputs
    fails = {"run_0_1", "run_2_0", "run_4_1", "run_5_0", "run_9_0"}
    for size in (3, 20):
        folder = f"file://{tmp_path}/stopped_{size}"
        totals = N.run_batches(plan, evidence, answering(fails), folder, size, most_errors=2, attempts=1)
        assert totals.stopped and totals.provider_errors == 3
        assert [r.run_id for r in N.RunFolder(spark, folder).read().orderBy("plan_order").collect()][-1] == "run_4_1"
        assert N.run_batches(plan, evidence, answering(), folder, size) == totals  # stays stopped


def test_finished_runs_are_left_out(spark, inputs, tmp_path):
    plan, evidence = inputs
    folder = f"file://{tmp_path}/rest"
    N.run_batches(plan, evidence, answering(), folder, 8, finished=plan.where("plan_order <= 9"))
    assert sorted(r.plan_order for r in N.RunFolder(spark, folder).read().collect()) == list(range(10, 21))


def test_records(spark, inputs):
    plan, evidence = inputs
    asked = N.with_request(plan.join(evidence, "question_id").where("question_id = 'q1'"))
    r = {x.baseline: x for x in asked.collect()}["ledger_only"]
    assert N.POLICIES["ledger_only"] in r.system and N.RULES in r.system
    assert 'valid_evidence_ids:\n["doc_1","doc_2"]' in r.request and 'valid_citation_ids:\n["d/s1/v1/p1/h1","d/s2/v1/p2/h2"]' in r.request
    assert "- evidence_id=doc_1 ledger_span_id=doc_1 citation_id=d/s1/v1/p1/h1 title=Title 1 text=Harbour 1 was quiet. It is not blue.\n- evidence_id=doc_2" in r.request
    got = N.records(N.with_answers(asked, answering(), wait=0)).first()
    assert [(c.citation_id, c.validator_status, c.kept) for c in got.citations] == [("d/s1/v1/p1/h1", "valid_citation", True), ("d/s2/v1/p2/h2", "valid_citation", True), ("d/s9/v1/p9/h9", "nonexistent_citation_id", False)]
    assert [c.verdict for c in got.citations] == ["contradictory", "contradictory", None]  # "not" is on one side alone
    assert (got.status, got.valid_citation_count, got.invalid_citation_count, got.uncited_claim_count, got.refusal_label) == ("ok", 2, 1, 0, "answered")


def test_one_of_many_commits(spark, tmp_path):
    path = f"file://{tmp_path}/commits/0.json"
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda k: put_once(spark, path, str(k)), range(8)))
    assert sum(made) == 1 and read_text(spark, path) == str(made.index(True))
    assert read_text(spark, path + "x") is None
    assert not any("-" in f for f in os.listdir(tmp_path / "commits"))  # no draft stays
