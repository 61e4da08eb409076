"""The composed run as a query: every question with every baseline, in committed batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.operators import mainrun as N
from citeforge.operators.judging import settled
from citeforge.plans import catalogue as C
from citeforge.plans import records as K
from citeforge.plans import tables as B
from citeforge.plans.registry import query
from citeforge.sources.folders import new_folder

BATCHES = 4


def scripted(row: dict) -> dict:
    """Stands in for a model: cites the first and the last item listed and one that is not; some calls
    fail and some outputs are cut."""
    n, text = int(row["question_id"]), row["question_text"]
    if n % 11 == 5:
        raise RuntimeError("no answer")
    ids = json.loads(row["request"].split("\n\nvalid_evidence_ids:\n")[1].split("\n")[0])
    cited = [{"claim_id": "c1", "cited_evidence_id": f" `{ids[0]}`"}, {"claim_id": "c2", "evidence_id": ids[-1]}] if ids else []
    answer = {"global_answer": text[:40], "refusal": n % 5 == 0, "atomic_claims": [{"claim_id": "c1", "text": text}, {"claim_text": "not " + text}], "citations": [*cited, {"claim_id": "c1", "cited_evidence_id": "doc_x"}]}
    content = json.dumps(answer, ensure_ascii=False)
    return {"content": f"```json\n{content[: -1 if n % 7 == 3 else None]}\n```", "prompt_tokens": len(row["request"]) // 4, "completion_tokens": len(text) // 8}


def plan_with_texts(spark, d) -> DataFrame:
    texts = B.questions(spark, d).select(F.col("question_id").cast("string").alias("question_id"), "question_text")
    return K._planned(spark, d).join(texts, "question_id")


def evidence(spark, d) -> DataFrame:
    spans = B.ledger(spark, d, "text").withColumns({"source_doc_id": F.col("source_id"), "title": F.concat(F.lit("Document "), F.col("doc_id").cast("string"))})
    ranked = C._top8(spark, d).withColumn("question_id", F.col("question_id").cast("string"))
    return settled(N.enrich(ranked, spans))


_SYSTEM = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.POLICIES.items())

_MAIN = f"""{C._TOP8}, {B.LEDGER}, {K._PLAN},
ev AS (SELECT question_id::VARCHAR AS question_id, count(*) AS n, string_agg('"' || source_doc_id || '"', ',' ORDER BY rank) AS ids, string_agg('"' || pointer || '"', ',' ORDER BY rank) AS pointers,
  string_agg('- evidence_id=' || source_doc_id || ' ledger_span_id=' || source_doc_id || ' citation_id=' || pointer || ' title=Document ' || doc_id || ' text=' || coalesce(text, ''), chr(10) ORDER BY rank) AS lines,
  arg_min(coalesce(text, ''), rank) AS first_text, arg_max(coalesce(text, ''), rank) AS last_text FROM rk JOIN lp ON source_id = source_doc_id WHERE rank <= 8 GROUP BY question_id),
rq AS (SELECT pl.*, b.text AS q, b.item_id AS k, n, first_text, last_text, 'baseline=' || baseline || '. prompt_version=v1. ' || CASE baseline {_SYSTEM} END || ' {N.RULES}' AS sys,
  'Question:' || chr(10) || b.text || chr(10) || chr(10) || 'valid_evidence_ids:' || chr(10) || '[' || coalesce(ids, '') || ']' || chr(10) || chr(10) || 'valid_citation_ids:' || chr(10) || '[' || coalesce(pointers, '') || ']' || chr(10) || chr(10) || 'Evidence:' || chr(10) || coalesce(lines, '') AS req
  FROM pl JOIN benchmark b ON b.item_id::VARCHAR = pl.question_id LEFT JOIN ev ON ev.question_id = pl.question_id),
st AS (SELECT *, CASE WHEN k % 11 = 5 THEN 'provider_error' WHEN k % 7 = 3 THEN 'json_parse_error' ELSE 'ok' END AS status, CASE WHEN k % 11 = 5 THEN 0 ELSE length(req) // 4 END AS p, CASE WHEN k % 11 = 5 THEN 0 ELSE length(q) // 8 END AS c,
  CAST((plan_order - 1) // CAST(ceil((SELECT max(plan_order) FROM pl) / {BATCHES}) AS BIGINT) AS INTEGER) AS batch, coalesce(n, 0) > 0 AS has_ev FROM rq),
cl1 AS (SELECT DISTINCT k, q AS claim, first_text AS span FROM st WHERE has_ev), cl2 AS (SELECT DISTINCT k, 'not ' || q AS claim, last_text AS span FROM st WHERE has_ev),
{B.verdict("cl1", "claim", "span", "f1")}, {B.verdict("cl2", "claim", "span", "f2")},
tt AS (SELECT batch, sum(p) AS p, sum(c) AS c FROM st GROUP BY batch),
tb AS (SELECT batch, CAST(sum(p) OVER (ORDER BY batch) AS BIGINT) AS total_prompt_tokens, CAST(sum(c) OVER (ORDER BY batch) AS BIGINT) AS total_completion_tokens FROM tt)
SELECT plan_order, run_id, baseline, status, batch, sha256(sys || chr(10) || req) AS request_sha256, CAST(length(req) AS BIGINT) AS request_length, coalesce(n, 0) AS n_evidence,
  CASE WHEN status = 'ok' THEN substr(q, 1, 40) END AS global_answer, CASE WHEN status = 'ok' THEN CASE WHEN st.k % 5 = 0 THEN 'insufficient_evidence' ELSE 'answered' END END AS refusal_label,
  CASE WHEN status = 'ok' THEN 2 ELSE 0 END::BIGINT AS claim_count, CASE WHEN status = 'ok' AND has_ev THEN 2 ELSE 0 END::BIGINT AS valid_citation_count, CASE WHEN status = 'ok' THEN 1 ELSE 0 END::BIGINT AS invalid_citation_count,
  CASE WHEN status = 'ok' AND NOT has_ev THEN 2 ELSE 0 END::BIGINT AS uncited_claim_count, CASE WHEN status = 'ok' AND has_ev THEN f1.verdict || ',' || f2.verdict ELSE '' END AS verdicts,
  round_even(p / 1e6 * 0.435 + c / 1e6 * 0.87, 6) AS estimated_cost_usd, total_prompt_tokens, total_completion_tokens
FROM st JOIN tb USING (batch) LEFT JOIN f1 ON f1.k = st.k LEFT JOIN f2 ON f2.k = st.k"""


@query(f"WITH {_MAIN}")
def main_run(spark, d):
    """Plan, evidence, requests, answers and checked records in batches; the totals up to a batch are its commit's."""
    folder = new_folder(spark, "run")
    plan = settled(plan_with_texts(spark, d))
    size = max(1, -(-plan.count() // BATCHES))
    N.run_batches(plan, evidence(spark, d), scripted, folder, size, most_errors=None, attempts=2, wait=0.0)
    place = N.RunFolder(spark, folder)
    rows = place.read()
    carried = spark.createDataFrame([(k, c["totals"]["prompt_tokens"], c["totals"]["completion_tokens"]) for k, c in enumerate(place.commits())], "batch int, total_prompt_tokens long, total_completion_tokens long")
    kept = F.transform(F.filter("citations", lambda c: c["kept"]), lambda c: c["verdict"])
    return rows.join(F.broadcast(carried), "batch").select(
        "plan_order", "run_id", "baseline", "status", "batch", "request_sha256", "request_length", F.size("evidence_ids").cast("long").alias("n_evidence"), "global_answer", "refusal_label", F.size("claims").cast("long").alias("claim_count"),
        "valid_citation_count", "invalid_citation_count", "uncited_claim_count", F.array_join(kept, ",").alias("verdicts"), "estimated_cost_usd", "total_prompt_tokens", "total_completion_tokens",
    )
