"""Queries over planned runs, parsed answers, run records, the written index, paragraphs, registries,
sources and sinks, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import attribution as A
from citeforge.operators import evidence as E
from citeforge.operators import index as I
from citeforge.operators import judging as J
from citeforge.operators import metrics as M
from citeforge.operators import rules as R
from citeforge.operators import runs as U
from citeforge.operators import serving as S
from citeforge.operators.judging import settled
from citeforge.plans import catalogue as C
from citeforge.plans import tables as B
from citeforge.plans.registry import query
from citeforge.sources import readers, writers
from citeforge.sources.folders import new_folder

_LIST = lambda xs: "[" + ", ".join(repr(x) for x in xs) + "]"

# Planned runs and answers


def _planned(spark, d, **slice_):
    questions = B.questions(spark, d).select(F.lit("bench").alias("dataset_id"), F.col("question_id").cast("string").alias("question_id"))
    return U.plan_runs(questions, B.BASELINES, **slice_)


_PLAN = f"""q AS (SELECT item_id::VARCHAR AS question_id, row_number() OVER (ORDER BY item_id::VARCHAR) AS n FROM benchmark),
bl AS (SELECT unnest({_LIST(B.BASELINES)}) AS baseline, unnest(range({len(B.BASELINES)})) AS b),
pl AS (SELECT (n - 1) * {len(B.BASELINES)} + b + 1 AS plan_order, 'main_v1_bench_run_' || baseline || '_' || question_id AS run_id, 'bench' AS dataset_id, question_id, baseline FROM q, bl)"""


@query(f"WITH {_PLAN} SELECT * FROM pl")
def run_plan(spark, d):
    """Every question with every baseline."""
    return _planned(spark, d)


@query(f"WITH {_PLAN} SELECT plan_order - {2 * len(B.BASELINES)} AS plan_order, run_id FROM pl WHERE plan_order > {2 * len(B.BASELINES)} AND plan_order <= {12 * len(B.BASELINES)}")
def run_plan_slice(spark, d):
    """Ten questions from the third on."""
    return _planned(spark, d, offset=2, count=10).select("plan_order", "run_id")


def _outputs(spark, d) -> DataFrame:
    """Model outputs made of the answers: JSON in a fence, plain JSON, or cut off."""
    rows = B.answers(spark, d).withColumn("s", T.sentences(F.coalesce("text", F.lit(""))))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    claim = lambda x, i: F.struct(F.when(i % 2 == 1, F.concat(F.lit("k"), i.cast("string"))).alias("claim_id"), F.when(i % 3 != 0, x).alias("text"), x.alias("claim_text"))
    answer = F.struct(F.substring("text", 1, 40).alias("global_answer"), (F.col("conv_id") % 5 == 0).alias("refusal"), F.transform("s", claim).alias("atomic_claims"))
    js = F.to_json(answer)
    content = F.when(kind == 0, F.concat(F.lit("```json\n"), js, F.lit("\n``` "))).when(kind == 1, js).when(kind == 2, F.concat(F.lit("\n```\n"), js)).otherwise(js.substr(F.lit(1), F.length(js) - 1))
    return rows.select("run_id", "dataset_id", "baseline", "conv_id", "turn", content.alias("content"))


_OUT = f"""{B.ANSWERS}, o AS (SELECT *, {B.sents("coalesce(text, '')")} AS s, (conv_id + turn) % 4 AS kind FROM a)"""


@query(f"""WITH {_OUT} SELECT run_id, CASE WHEN kind = 3 THEN 'error' ELSE 'ok' END AS answer_status, CASE WHEN kind <> 3 THEN substr(text, 1, 40) END AS global_answer,
CASE WHEN kind <> 3 THEN conv_id % 5 = 0 END AS refusal, CASE WHEN kind <> 3 THEN CAST(len(s) AS BIGINT) END AS claim_count FROM o""")
def answer_parse(spark, d):
    """What is read of each output; a cut one is an error of its own row."""
    rows = U.parse_answers(_outputs(spark, d))
    return rows.select("run_id", "answer_status", "answer.global_answer", "answer.refusal", F.when(F.col("answer").isNotNull(), F.size("answer.atomic_claims")).cast("long").alias("claim_count"))


@query(f"""WITH {_OUT}, x AS (SELECT run_id, unnest(s) AS t, unnest(range(len(s))) AS i FROM o WHERE kind <> 3)
SELECT run_id, CASE WHEN i % 2 = 1 THEN 'k' || i ELSE 'c' || (i + 1) END AS claim_id, t AS claim_text, i + 1 AS answer_order FROM x""")
def answer_claims(spark, d):
    return U.answer_claims(U.parse_answers(_outputs(spark, d)).where("answer_status = 'ok'"), "run_id")


@query(f"WITH {C._TOP8}, e AS (SELECT question_id, min(source_doc_id) FILTER (rank = 1) AS doc FROM rk WHERE rank <= 8 GROUP BY question_id) SELECT item_id AS question_id, CASE WHEN doc IS NULL THEN 'INSUFFICIENT_EVIDENCE' ELSE 'DRY_RUN_NO_MODEL_CALL' END AS global_answer, doc IS NULL AS refusal, doc AS cited FROM benchmark LEFT JOIN e ON question_id = item_id")
def dry_run(spark, d):
    """The answer without a model for each question, on its evidence."""
    listed = C._top8(spark, d).groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source_doc_id"))), lambda x: x["source_doc_id"]).alias("e"))
    rows = B.questions(spark, d).join(listed, "question_id", "left").withColumn("a", U.dry_answer(F.col("e")))
    return rows.select("question_id", "a.global_answer", "a.refusal", F.try_element_at("a.citations", F.lit(1))["cited_evidence_id"].alias("cited"))


# Sanitised citations, run records and summaries


def _raw_citations(spark, d):
    """Pointers and older ids as models write them, with quotes and blanks around them."""
    held = settled(B.ledger(spark, d))
    old, evidence = C._legacy(spark, d, held)
    direct = B.citations(spark, d, held).select(F.col("run_id").alias("answer_id"), "claim_id", "citation_id")
    rows = old.join(direct, ["answer_id", "claim_id"])
    quoted = F.when(F.col("claim_index") % 3 == 0, F.concat(F.lit(" `"), "cited_id", F.lit("`"))).otherwise(F.concat(F.lit('"'), "citation_id", F.lit("'\n")))
    return rows.select("answer_id", "claim_id", "run_id", quoted.alias("cited_id")), evidence, held


def _sanitised(spark, d):
    rows, evidence, held = _raw_citations(spark, d)
    out = A.sanitise(rows, evidence, held, B.retrieved(held))
    return out.drop("run_id").withColumnRenamed("answer_id", "run_id")


_SANITISED = f"""{B.CITATIONS}, ev AS (SELECT doc_id, pointer, 'e' || (doc_id % ({C._DOCS} // 2 + 1)) AS evidence_id, 's' || (doc_id % ({C._DOCS} * 2 // 3 + 1)) AS ledger_span_id FROM lp),
ks AS (SELECT evidence_id AS legacy, doc_id, 0 AS o, pointer FROM ev UNION ALL SELECT ledger_span_id, doc_id, 1, pointer FROM ev),
mx AS (SELECT legacy, arg_max(pointer, doc_id * 2 + o) AS pointer FROM ks GROUP BY legacy),
rc AS (SELECT run_id, claim_id, CASE WHEN claim_index % 3 = 0 THEN CASE WHEN claim_index % 2 = 0 THEN 'e' || doc_id ELSE 's' || doc_id END ELSE trim(citation_id, '`''"') END AS cited FROM ci),
sz AS (SELECT run_id, claim_id, coalesce(mx.pointer, cited) AS citation_id FROM rc LEFT JOIN mx ON mx.legacy = cited), {B.checked("sz")}"""


@query(f"WITH {_SANITISED} SELECT run_id, claim_id, citation_id, structural_validity = 'valid' AS kept, validation_error AS reason FROM v")
def citation_sanitise(spark, d):
    """Citations kept and dropped, with the reason."""
    return _sanitised(spark, d).select("run_id", "claim_id", "citation_id", "kept", F.col("validation_error").alias("reason"))


@query(f"""WITH {_SANITISED}, k AS (SELECT run_id, count(*) FILTER (structural_validity = 'valid') AS kept_count, count(*) FILTER (structural_validity <> 'valid') AS dropped_count,
count(DISTINCT claim_id) - count(DISTINCT claim_id) FILTER (structural_validity = 'valid') AS uncited_claim_count, count(DISTINCT claim_id) AS claim_count FROM v GROUP BY run_id)
SELECT run_id, claim_count, uncited_claim_count, kept_count, dropped_count FROM k""")
def citation_diagnostics(spark, d):
    return A.diagnostics(_sanitised(spark, d), B.claims(spark, d))


def _records(spark, d):
    n = F.length("text")
    runs = B.runs(spark, d).select("run_id", "dataset_id", "baseline", "refusal_label", F.floor(n / 4).alias("prompt_tokens"), F.floor(n / 8).alias("completion_tokens"))
    claims = B.claims(spark, d).select("run_id", "claim_id", "claim_text", (F.col("claim_index") + 1).alias("answer_order"))
    return U.run_records(runs, claims, B.validated(spark, d))


_RECORDS = f"""{B.VALIDATED}, {B.RUNS}, g AS (SELECT run_id, count(*) AS claim_count, count(*) FILTER (structural_validity = 'valid') AS valid_citation_count, count(*) FILTER (structural_validity <> 'valid') AS invalid_citation_count,
  string_agg(claim_id, ',' ORDER BY claim_index) AS claim_ids, string_agg(CASE WHEN structural_validity = 'valid' THEN claim_id || '=' || citation_id END, ',' ORDER BY CASE WHEN structural_validity = 'valid' THEN claim_id END) AS citations FROM v GROUP BY run_id),
rr AS (SELECT r.run_id, r.dataset_id, r.baseline, refusal_label, coalesce(claim_count, 0) AS claim_count, coalesce(valid_citation_count, 0) AS valid_citation_count, coalesce(invalid_citation_count, 0) AS invalid_citation_count,
  coalesce(claim_count - valid_citation_count, 0) AS uncited_claim_count, coalesce(claim_ids, '') AS claim_ids, coalesce(citations, '') AS citations,
  CASE WHEN coalesce(valid_citation_count, 0) > 0 THEN 'not_checked' ELSE 'insufficient' END AS label, length(text) // 4 AS p, length(text) // 8 AS c,
  round_even((length(text) // 4) / 1e6 * 0.435 + (length(text) // 8) / 1e6 * 0.87, 6) AS usd FROM r LEFT JOIN g USING (run_id))"""


@query(f"""WITH {_RECORDS} SELECT run_id, baseline, refusal_label, claim_count, valid_citation_count, invalid_citation_count, uncited_claim_count, claim_ids, citations, usd AS estimated_cost_usd FROM rr""")
def run_records(spark, d):
    """Nested records, flattened to columns."""
    rows = _records(spark, d)
    ids = F.coalesce(F.array_join("atomic_claims.claim_id", ","), F.lit(""))
    cited = F.coalesce(F.array_join(F.transform("citations", lambda c: F.concat_ws("=", c["claim_id"], c["citation_id"])), ","), F.lit(""))
    return rows.select("run_id", "baseline", "refusal_label", "claim_count", "valid_citation_count", "invalid_citation_count", "uncited_claim_count", ids.alias("claim_ids"), cited.alias("citations"), "estimated_cost_usd")


@query(f"WITH {_RECORDS} SELECT rr.run_id, cl.claim_id, rr.baseline IN ({', '.join(repr(b) for b in U.VERIFIED)}) AS verifier_enabled, label FROM rr JOIN cl USING (run_id)")
def verdict_rows(spark, d):
    return _records(spark, d).select("run_id", F.explode("verdicts").alias("v")).select("run_id", "v.*")


_SUM = """count(*) AS success_count, count(*) FILTER (refusal_label <> 'answered') AS refusal_count, CAST(sum(claim_count) AS BIGINT) AS claim_count, CAST(sum(valid_citation_count) AS BIGINT) AS valid_citation_count,
CAST(sum(invalid_citation_count) AS BIGINT) AS dropped_invalid_citation_count, CAST(sum(uncited_claim_count) AS BIGINT) AS uncited_claim_count, CAST(sum(p) AS BIGINT) AS total_prompt_tokens, CAST(sum(c) AS BIGINT) AS total_completion_tokens, CAST(sum(CAST(usd AS DECIMAL(18,6))) AS DOUBLE) AS estimated_cost_usd"""


@query(f"WITH {_RECORDS} SELECT {_SUM} FROM rr")
def run_summary(spark, d):
    return U.run_summary(_records(spark, d))


@query(f"WITH {_RECORDS} SELECT dataset_id, {_SUM} FROM rr GROUP BY dataset_id")
def batch_summary(spark, d):
    return U.run_summary(_records(spark, d), "dataset_id")


@query(f"WITH {B.SEMANTIC} SELECT run_id, claim_id, semantic_status, verdict, claim_text FROM sr WHERE verdict IN ({', '.join(repr(v) for v in U.FAILED)}) OR semantic_status = 'skipped' ORDER BY conv_id, turn, claim_index LIMIT 12")
def failure_sample(spark, d):
    """The first twelve failures in the order of conversations, turns and claims."""
    return U.failure_sample(B.semantic(spark, d), ["conv_id", "turn", "claim_index"]).select("run_id", "claim_id", "semantic_status", "verdict", "claim_text")


@query(f"""WITH {B.SEMANTIC}, {B.RUNS}, x AS (SELECT baseline, {C._VAL_COUNTS}, {C._SEM_COUNTS}, count(DISTINCT CASE WHEN structural_validity = 'valid' THEN run_id || '/' || claim_id END) AS cited_claims FROM sr GROUP BY baseline),
y AS (SELECT baseline, count(*) AS run_record_count, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (refusal_label <> 'answered') AS refusals FROM r GROUP BY baseline), z AS (SELECT baseline, count(*) AS claim_count FROM cl GROUP BY baseline),
j AS (SELECT * FROM y JOIN x USING (baseline) JOIN z USING (baseline))
SELECT * EXCLUDE (chars, refusals, cited_claims), {C._VAL_RATES}, {C._SEM_RATES}, {B.rate('claim_count', 'run_record_count')} AS claim_count_per_answer, {B.rate('citation_count', 'run_record_count')} AS citation_count_per_answer,
{B.rate('cited_claims', 'claim_count')} AS claim_citation_coverage, {B.rate('chars', 'run_record_count')} AS answer_length, {B.rate('refusals', 'run_record_count')} AS refusal_rate FROM j""")
def baseline_comparison(spark, d):
    """All structural and semantic metrics of each baseline."""
    return M.by_baseline(B.runs(spark, d), B.claims(spark, d), B.semantic(spark, d))


@query("""WITH t AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, turn, n, CAST(sum(n) OVER (ORDER BY conv_id, turn) AS BIGINT) AS total_n FROM t""")
def running_totals(spark, d):
    rows = B.read(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    return U.running_totals(rows, ["conv_id", "turn"], ["n"])


@query("""WITH t AS (SELECT conv_id, turn, length(text) % 11 = 0 AS failed FROM conversations), s AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (ORDER BY conv_id, turn) AS n FROM t)
SELECT conv_id, turn, failed FROM s WHERE n <= 2 OR (n = 3 AND failed)""")
def stop_after_errors(spark, d):
    """Calls in order until the third one that fails."""
    rows = B.read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 11 == 0).alias("failed"))
    return U.until_errors(rows, ["conv_id", "turn"], F.col("failed"))


# Judges


@query(f"""WITH {B.VALIDATED}, w AS (SELECT *, CASE WHEN validator_status <> 'valid_citation' THEN validator_status WHEN length(claim_text) % 3 = 0 THEN 'structurally_valid_but_semantically_unsupported_citation'
WHEN length(claim_text) % 3 = 1 THEN 'overclaim_partially_supported_claim' ELSE 'valid_citation' END AS status FROM v)
SELECT run_id, claim_id, status AS validator_status, structural_validity, ({_LIST(['unsupported', 'partially_supported', 'entailed'])})[length(claim_text) % 3 + 1] AS semantic_support FROM w""")
def judged_validation(spark, d):
    """Labels of a judge, given twice to each claim, refine the status of valid citations; the last one counts."""
    held = settled(B.ledger(spark, d))
    rows = settled(B.citations(spark, d, held))
    n = F.length("claim_text")
    pick = lambda k: F.element_at(F.array(*map(F.lit, ["unsupported", "partially_supported", "entailed"])), (k % 3 + 1).cast("int"))
    given = rows.select("run_id", "claim_id", F.explode(F.array(F.struct(F.lit(0).alias("order"), pick(n + 1).alias("judge_label")), F.struct(F.lit(1).alias("order"), pick(n).alias("judge_label")))).alias("x")).select("run_id", "claim_id", "x.*")
    out = A.validate(A.labelled(rows, given, "run_id", "claim_id"), held, B.retrieved(held))
    return out.select("run_id", "claim_id", "validator_status", "structural_validity", "semantic_support")


@query(f"WITH {C._LABELS} SELECT count(*) AS compared_count, count(*) FILTER (old <> new) AS changed_count, count(*) FILTER (old <> new) / count(*)::DOUBLE AS disagreement_rate, count(*) FILTER (old <> new AND old = 'contradictory') AS from_contradictory_count, count(*) FILTER (old = 'entailed' AND new IN ('insufficient_evidence', 'partially_supported', 'unsupported')) AS from_entailed_count FROM lb")
def label_comparison(spark, d):
    return J.comparison_summary(C._compared(spark, d))


# The pilot without a model

_PILOT = f"""{C._TOP8}, qs AS (SELECT item_id AS question_id, CASE WHEN item_id % 5 = 0 THEN 'insufficient' ELSE 'answerable' END AS case_type, {B.sents('text')} AS expected FROM benchmark),
su AS (SELECT question_id, source_doc_id FROM rk WHERE rank IN (2, 3) AND question_id % 2 = 0),
be AS (SELECT rk.question_id, arg_min(rk.source_doc_id, CASE WHEN su.source_doc_id IS NULL THEN 100 ELSE 0 END + rank) AS doc FROM rk LEFT JOIN su USING (question_id, source_doc_id) WHERE rank <= 8 GROUP BY rk.question_id),
cx AS (SELECT question_id, case_type, unnest(CASE WHEN case_type = 'insufficient' THEN ['INSUFFICIENT_EVIDENCE'] ELSE expected END) AS claim_text, unnest(range(CASE WHEN case_type = 'insufficient' THEN 1 ELSE len(expected) END)) AS i FROM qs),
an AS (SELECT cx.question_id, cx.question_id || '_claim_' || (i + 1) AS claim_id, claim_text, i + 1 AS answer_order, CASE WHEN case_type = 'insufficient' THEN 'insufficient_evidence' ELSE 'answered' END AS refusal_label,
  CASE WHEN case_type <> 'insufficient' THEN doc END AS source_doc_id FROM cx LEFT JOIN be ON be.question_id = cx.question_id)"""


def _pilot(spark, d):
    top = settled(C._top8(spark, d))
    questions = B.questions(spark, d).select("question_id", F.when(F.col("question_id") % 5 == 0, "insufficient").otherwise("answerable").alias("case_type"), T.sentences(F.col("question_text")).alias("expected_claims"))
    support = top.where(F.col("rank").isin(2, 3) & (F.col("question_id") % 2 == 0)).select("question_id", "source_doc_id")
    return questions, support, U.offline_answers(questions, top, support)


@query(f"WITH {_PILOT} SELECT * FROM an")
def offline_answers(spark, d):
    return _pilot(spark, d)[2]


@query(f"""WITH {_PILOT} SELECT an.question_id, claim_id, CASE WHEN refusal_label = 'answered' AND su.source_doc_id IS NOT NULL THEN 'support' ELSE 'insufficient' END AS label,
CASE WHEN refusal_label <> 'answered' OR su.source_doc_id IS NOT NULL THEN 1.0 ELSE 0.0 END AS score FROM an LEFT JOIN su ON su.question_id = an.question_id AND su.source_doc_id = an.source_doc_id""")
def offline_verdicts(spark, d):
    questions, support, answers = _pilot(spark, d)
    answers = settled(answers)
    citations = answers.where("source_doc_id is not null").select("question_id", "claim_id", F.lit(1).alias("position"), "source_doc_id")
    expected = questions.select("question_id", F.explode("expected_claims").alias("claim_text"))
    return U.offline_verdicts(answers, citations, expected, support)


# The written index

_TREES = lambda leaf, name: leaf + "".join(f", {name}{k} AS (SELECT dataset_id, split, up AS pos, sha256(string_agg(h, chr(10) ORDER BY pos)) AS h FROM (SELECT *, pos // 1024 AS up FROM {name}{k - 1}) GROUP BY dataset_id, split, up)" for k in (1, 2, 3))


@query(f"""WITH {C._CORPUS}, i AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, split ORDER BY source_doc_id) - 1 AS pos, {B.toks("coalesce(text, '')")} AS tk FROM cp),
{_TREES("d0 AS (SELECT dataset_id, split, pos, sha256(source_doc_id || ':' || sha256(coalesce(text, '')) || ':' || len(tk)) AS h FROM i)", "d")},
t AS (SELECT dataset_id, split, pos AS doc, unnest(tk) AS token FROM i), p AS (SELECT dataset_id, split, token, doc, count(*) AS tf FROM t GROUP BY ALL),
bk AS (SELECT dataset_id, split, token, doc // 1024 AS block, string_agg(doc || ':' || tf, ',' ORDER BY doc) AS postings FROM p GROUP BY ALL),
{_TREES("p0 AS (SELECT dataset_id, split, row_number() OVER (PARTITION BY dataset_id, split ORDER BY token, block) - 1 AS pos, sha256(token || '|' || block || '|' || postings) AS h FROM bk)", "p")},
n AS (SELECT dataset_id, split, count(*) AS document_count, CAST(sum(len(tk)) AS BIGINT) AS token_count FROM i GROUP BY ALL), u AS (SELECT dataset_id, split, count(DISTINCT token) AS distinct_tokens FROM bk GROUP BY ALL)
SELECT n.*, coalesce(distinct_tokens, 0) AS distinct_tokens, d3.h AS documents_hash, p3.h AS postings_hash, sha256(d3.h || ':' || coalesce(p3.h, '')) AS index_hash
FROM n JOIN d3 USING (dataset_id, split) LEFT JOIN u USING (dataset_id, split) LEFT JOIN p3 USING (dataset_id, split)""")
def index_manifest(spark, d):
    """Counts and digests of an index that is written and read back."""
    return I.write_index(B.corpus(spark, d), new_folder(spark, "index"))


@query(f"WITH {C._TOP8} SELECT question_id, source_doc_id, score, rank FROM rk WHERE rank <= 8")
def rank_evidence_indexed(spark, d):
    """The ranking from a written index, of which only the buckets of asked tokens are read."""
    folder = new_folder(spark, "serving")
    S.write_serving_index(B.corpus(spark, d), folder)
    ranked = S.rank_pruned(B.questions(spark, d), folder)
    return ranked.select("question_id", "source_doc_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


# Paragraphs


def _paragraphs(spark, d):
    """Turns as paragraphs that name their place and text in several ways."""
    t = F.col("turn")
    return B.read(spark, d, "conversations").select(
        F.concat(F.lit("Q "), F.col("conv_id").cast("string")).alias("question_id"), F.lit("corpus://turns").alias("source_uri"), t.alias("position"), F.when(t % 3 == 0, t).alias("idx"), F.when(t % 3 == 1, t).alias("paragraph_idx"),
        F.when(t % 2 == 0, F.col("role")).alias("title"), F.when(t % 4 == 0, F.col("text")).alias("paragraph_text"), F.when(t % 4 == 1, F.col("text")).alias("text"), F.when(t % 4 > 1, F.col("text")).alias("paragraph"), ((F.col("conv_id") + t) % 2 == 0).alias("is_supporting"),
    )


_PARAGRAPHS = f"""pg AS (SELECT 'Q ' || conv_id AS question_id, turn AS position, turn AS idx, CASE WHEN turn % 2 = 0 THEN role ELSE 'paragraph_' || turn END AS title, {B.norm("coalesce(text, '')")} AS body, (conv_id + turn) % 2 = 0 AS sup FROM conversations),
pr AS (SELECT *, 'musique_q_' || substr(question_id, 3) || '_para_' || idx || '_' || {B.id_part('title')} AS source_doc_id FROM pg)"""


@query(f"WITH {_PARAGRAPHS} SELECT question_id, idx AS paragraph_idx, title, source_doc_id, 'corpus://turns#question=' || question_id || '&paragraph=' || idx AS source_uri, sha256(body) AS source_hash, sup AS is_supporting FROM pr")
def paragraph_corpus(spark, d):
    rows = E.paragraph_rows(_paragraphs(spark, d))
    return rows.select("question_id", "paragraph_idx", "title", "source_doc_id", "source_uri", "source_hash", "is_supporting")


@query(f"""WITH {_PARAGRAPHS}, s AS (SELECT question_id, position, CASE WHEN position % 3 = 2 THEN 0 ELSE position END AS paragraph_idx FROM pr WHERE sup)
SELECT s.question_id, s.position, s.paragraph_idx, source_doc_id, title FROM s LEFT JOIN pr ON pr.question_id = s.question_id AND pr.idx = s.paragraph_idx""")
def paragraph_support(spark, d):
    """Supporting paragraphs; those without a place of their own count as number 0."""
    rows = _paragraphs(spark, d)
    return E.paragraph_support(rows, E.paragraph_rows(rows)).withColumn("paragraph_idx", F.col("paragraph_idx").cast("long"))


# Registries


@query(f"""WITH {C._REG}, w AS (SELECT *, CASE WHEN n % 4 = 1 THEN 'src0' ELSE dataset_id END AS id FROM g), k AS (SELECT id, count(*) AS c FROM w GROUP BY id)
SELECT id AS record, 'dataset_id' AS field, 'duplicate id' AS message FROM k WHERE c > 1 UNION ALL SELECT dataset_id, 'dataset_id', 'expected id is missing' FROM g WHERE dataset_id NOT IN (SELECT id FROM w)
UNION ALL SELECT 'src999', 'dataset_id', 'expected id is missing' UNION ALL SELECT DISTINCT id, 'license_note', 'required field is missing' FROM w WHERE n % 6 = 0 UNION ALL SELECT DISTINCT id, 'status', 'unknown value' FROM w WHERE n % 7 = 0""")
def registry_validation(spark, d):
    """Duplicates, expected ids that are missing, required fields and unknown values of a registry."""
    rows = C._registry(spark, d).withColumn("license_note", F.when(F.col("n") % 6 != 0, F.col("license_note")))
    rows = rows.withColumn("status", F.when(F.col("n") % 7 == 0, "lost").otherwise("ready"))
    named = rows.withColumn("dataset_id", F.when(F.col("n") % 4 == 1, "src0").otherwise(F.col("dataset_id")))
    expected = rows.select("dataset_id").union(spark.createDataFrame([("src999",)], "dataset_id string"))
    return R.registry_errors(named, "dataset_id", ["license_note", "source_snapshot_id"], {"status": R.STATUSES}, expected)


@query(f"""WITH {C._REG}, s AS (SELECT dataset_id, n % 3 = 0 AS no_raw, n % 5 = 0 AS no_corpus, n % 2 = 1 AS moved FROM g)
SELECT dataset_id, 'raw_data_hash' AS field, 'raw_data_hash is not locked' AS message FROM s WHERE no_raw UNION ALL SELECT dataset_id, 'processed_corpus_hash', 'processed_corpus_hash is not locked' FROM s WHERE no_corpus
UNION ALL SELECT dataset_id, 'processed_corpus_hash', 'corpus is not the recorded one' FROM s WHERE no_corpus OR moved""")
def source_gate(spark, d):
    """What keeps a source from being indexed; the corpus's hash is compared with the recorded one."""
    rows = C._registry(spark, d)
    found = rows.select("dataset_id", F.when(F.col("n") % 2 == 1, "other").otherwise(F.col("processed_corpus_hash")).alias("found_hash"))
    return R.source_gate(rows, found)


@query("SELECT source AS key, count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return R.duplicates(B.read(spark, d, "documents").withColumnRenamed("source", "key"), "key")


@query(f"""WITH {C._REG} SELECT dataset_id, 'n' AS field, n::VARCHAR AS expected, (n + 1)::VARCHAR AS actual FROM g WHERE n % 3 = 0 UNION ALL SELECT dataset_id, 'langs', NULL, 'x' FROM g WHERE n % 4 = 0""")
def config_mismatch(spark, d):
    """Fields that differ between two configurations of the same records."""
    g = C._registry(spark, d).select("dataset_id", "n")
    left = g.withColumn("langs", F.lit(None).cast("string"))
    right = g.select("dataset_id", F.when(F.col("n") % 3 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("n") % 4 == 0, "x").alias("langs"))
    return R.field_mismatches(left, right, "dataset_id", ["n", "langs"])


@query("SELECT item_id, regexp_matches(lower(text), 'tbd|todo|turn[0-9]+') AS marked, try_cast(split_part(text, ' ', 1) AS DOUBLE) > 0 IS TRUE AS positive FROM benchmark")
def prompt_markers(spark, d):
    """Texts with marks of unfinished prompts, and those that begin with a positive number."""
    first = F.split("text", " ")[0]
    return B.read(spark, d, "benchmark").select("item_id", T.has_marker(F.col("text")).alias("marked"), T.is_positive(first).alias("positive"))


# Sources and sinks


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    """Canonical JSON lines, written and read back under the schema."""
    folder = new_folder(spark, "jsonl")
    writers.write_json_lines(B.read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), folder)
    return readers.json_lines(spark, folder, "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, sha256('{\"conv_id\":' || conv_id || ',\"role\":\"' || role || '\",\"turn\":' || turn || '}') AS line_hash FROM conversations")
def canonical_json(spark, d):
    """The hash of each row as JSON with sorted keys and no blanks."""
    rows = B.read(spark, d, "conversations").select("turn", "role", "conv_id")
    return rows.select("conv_id", "turn", T.sha256(writers.canonical_json(rows)).alias("line_hash"))


@query("SELECT doc_id, quality, '' AS note FROM labels")
def csv_round_trip(spark, d):
    """CSV with a fixed header; a column that is not there is empty."""
    folder = new_folder(spark, "csv")
    writers.write_csv(B.read(spark, d, "labels"), folder, ["doc_id", "quality", "note"])
    back = spark.read.schema("doc_id long, quality long, note string").option("header", True).csv(folder)
    return back.select("doc_id", F.col("quality"), F.coalesce("note", F.lit("")).alias("note"))


@query(f"WITH {B.ANSWERS} SELECT run_id, baseline FROM a WHERE conv_id % 3 = 0")
def resume_scan(spark, d):
    """Finished runs, read from where a run wrote them; a folder that is not there yet has none."""
    folder = new_folder(spark, "finished")
    schema = "run_id string, baseline string"
    before = readers.read_if_exists(spark, folder, schema)
    writers.write_json_lines(B.answers(spark, d).where("conv_id % 3 = 0").select("run_id", "baseline"), folder)
    return before.unionByName(readers.read_if_exists(spark, folder, schema))
