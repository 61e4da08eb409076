"""Published snapshots, the registry that follows them, and stored judgements, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import judging as J
from citeforge.operators import rules as R
from citeforge.operators import snapshots as P
from citeforge.operators.judging import settled
from citeforge.operators.memo import JudgeMemo
from citeforge.plans import catalogue as C
from citeforge.plans import tables as B
from citeforge.plans.registry import query
from citeforge.sources.folders import new_folder

_TREE = lambda leaf, name, keys: leaf + "".join(f", {name}{k} AS (SELECT {keys}, up AS pos, sha256(string_agg(h, chr(10) ORDER BY pos)) AS h FROM (SELECT *, pos // 1024 AS up FROM {name}{k - 1}) GROUP BY {keys}, up)" for k in (1, 2, 3))

_RECORD = f"""sd AS (SELECT source AS dataset_id, lang AS split, 'doc_' || doc_id AS source_doc_id, sha256('doc_' || doc_id || '|' || 'corpus://' || source || '/' || doc_id || '|' || sha256(coalesce(text, ''))) AS h FROM documents),
{_TREE("s0 AS (SELECT dataset_id, split, row_number() OVER (PARTITION BY dataset_id, split ORDER BY source_doc_id) - 1 AS pos, h FROM sd)", "s", "dataset_id, split")},
qd AS (SELECT 'src' || (item_id % 20) AS dataset_id, item_id FROM benchmark),
{_TREE("z0 AS (SELECT dataset_id, row_number() OVER (PARTITION BY dataset_id ORDER BY item_id) - 1 AS pos, sha256(item_id::VARCHAR) AS h FROM qd)", "z", "dataset_id")},
rec AS (SELECT n.dataset_id, n.split, corpus_doc_count, coalesce(question_count, 0) AS question_count, s3.h AS processed_corpus_hash, z3.h AS split_hash,
  concat_ws('_', {B.id_part('n.dataset_id')}, {B.id_part('n.split')}, 'official', substr(s3.h, 1, 16)) AS source_snapshot_id
  FROM (SELECT dataset_id, split, count(*) AS corpus_doc_count FROM sd GROUP BY ALL) n JOIN s3 ON s3.dataset_id = n.dataset_id AND s3.split = n.split
  LEFT JOIN (SELECT dataset_id, count(*) AS question_count FROM qd GROUP BY ALL) k ON k.dataset_id = n.dataset_id LEFT JOIN z3 ON z3.dataset_id = n.dataset_id)"""


def _published(spark, d) -> P.Versions:
    versions = P.Versions(spark, new_folder(spark, "snapshot"))
    questions = B.questions(spark, d).select(F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string")).alias("dataset_id"), "question_id", "question_text")
    P.publish_snapshot(versions, B.corpus(spark, d), questions)
    return versions


@query(f"WITH {_RECORD} SELECT * FROM rec")
def snapshot_record(spark, d):
    """The record of a snapshot that is staged, digested, published and read back."""
    return _published(spark, d).read("record")


@query(f"""WITH {_RECORD}, {C._REG}, en AS (SELECT * FROM rec WHERE split = 'en')
SELECT g.dataset_id, coalesce(en.source_snapshot_id, g.dataset_id || '_v1') AS source_snapshot_id, CASE WHEN en.dataset_id IS NOT NULL THEN CASE WHEN n % 3 <> 1 THEN 'idx/' || g.dataset_id ELSE 'unset' END WHEN n % 2 = 0 THEN '' ELSE 'index' END AS retrieval_index_path,
CASE WHEN en.dataset_id IS NOT NULL THEN CASE WHEN n % 3 <> 1 THEN 'ready' ELSE 'source_ready' END WHEN n % 7 = 0 THEN 'lost' WHEN n % 2 = 0 THEN 'pending' ELSE 'ready' END AS status,
CASE WHEN en.dataset_id IS NULL THEN 1 WHEN n % 3 <> 1 THEN 3 ELSE 2 END AS version FROM g LEFT JOIN en ON en.dataset_id = g.dataset_id""")
def registry_versions(spark, d):
    """A registry in three versions: as it was, with the snapshot's facts, and with the indexes that are there."""
    registry = P.Registry(spark, new_folder(spark, "registry"))
    registry.update(C._registry(spark, d).drop("n", "langs"), 0)
    record = _published(spark, d).read("record").where("split = 'en'")
    registry.update(P.with_snapshot(registry.read().drop("version"), record), 1)
    held = registry.read(2)
    with_index = C._registry(spark, d).where("n % 3 <> 1").select("dataset_id", F.concat(F.lit("idx/"), "dataset_id").alias("index_path"), T.sha256(F.col("dataset_id")).alias("index_hash"))
    merged = R.promotable(held.where("version = 2").drop("version"), with_index).join(with_index.select("dataset_id"), "dataset_id", "left_semi").drop("promoted")
    registry.update(merged, 2)
    registry.compact()
    return registry.read().select("dataset_id", "source_snapshot_id", "retrieval_index_path", "status", F.col("version").cast("int").alias("version"))


_JUDGED = "SELECT *, CASE WHEN trim(coalesce(span_text, '')) = '' THEN 'skipped' WHEN length(claim_text) > 150 THEN 'error' ELSE 'labeled' END AS judge_status"


@query(f"""WITH {B.VALIDATED}, j AS ({_JUDGED}, {B.excerpt('span_text')} AS x FROM v WHERE structural_validity = 'valid'), f AS (SELECT DISTINCT claim_text, x FROM j WHERE conv_id % 2 = 0 AND judge_status = 'labeled')
SELECT run_id, claim_id, judge_status, CASE WHEN judge_status = 'labeled' THEN ([{', '.join(repr(x) for x in J.LABELS)}])[length(j.claim_text) % 5 + 1] ELSE '' END AS judge_label, CASE WHEN judge_status = 'labeled' THEN 1.0 ELSE 0.0 END AS judge_confidence, f.x IS NOT NULL AS from_store
FROM j LEFT JOIN f ON f.claim_text = j.claim_text AND f.x = j.x AND judge_status = 'labeled'""")
def judge_memo(spark, d):
    """Labels of valid citations, of which half have been judged before and are taken from the store."""
    items = B.semantic(spark, d).where("structural_validity = 'valid'").select("conv_id", "run_id", "claim_id", "claim_text", F.when(F.col("span_filled"), F.col("span_excerpt")).alias("cited_span_text"))
    items = settled(items)
    memo = JudgeMemo(spark, new_folder(spark, "memo"), "length_v1")
    memo.label(items.where("conv_id % 2 = 0"), C.LengthJudge(), attempts=2)
    return memo.label(items, C.LengthJudge(), attempts=2).select("run_id", "claim_id", "judge_status", "judge_label", "judge_confidence", "from_store")
