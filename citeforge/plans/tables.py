"""The engine's inputs, derived from the given tables, and the SQL of the same derivations.

Documents are the corpus and the ledger (a document is a span), benchmark items are questions, and
assistant turns of conversations are answers whose sentences are claims. Each claim cites one
document; by a fixed rule some citations are damaged, so that every validator status occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import attribution as A
from citeforge.operators.judging import settled
from citeforge.operators.sizing import small

BASELINES = ["vanilla", "hybrid", "citation_only", "validator_only", "ledger_only", "ledger_validator"]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        F.col("source").alias("dataset_id"),
        F.col("lang").alias("split"),
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_doc_id"),
        F.concat(F.lit("corpus://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_uri"),
        "text",
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question_text"))


def ledger(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The ledger's keys by document; ``more`` names further columns of the documents to keep."""
    docs = read(spark, d, "documents")
    name = F.col("doc_id").cast("string")
    rows = docs.select("doc_id", F.col("source").alias("dataset_id"), F.concat(F.lit("doc_"), name).alias("source_id"), F.substring(T.sha256(F.coalesce("lang", F.lit(""))), 1, 16).alias("snapshot_hash"), F.concat(F.lit("span_"), name).alias("span_id"), T.span_hash(F.coalesce("text", F.lit(""))).alias("span_hash"), *more)
    return rows.withColumn("pointer", A.pointer(*[F.col(p) for p in A.PARTS]))


def retrieved(held: DataFrame) -> DataFrame:
    """Four of five documents of a ledger count as retrieved."""
    return held.where(F.col("doc_id") % 5 != 4).select(F.col("pointer").alias("citation_id"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").where("role = 'assistant'")
    baseline = F.element_at(F.array(*map(F.lit, BASELINES)), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return rows.select("conv_id", "turn", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("run_id"), F.concat(F.lit("set"), (F.col("conv_id") % 3).cast("string")).alias("dataset_id"), baseline.alias("baseline"), "text")


def claims(spark: SparkSession, d: str) -> DataFrame:
    rows = answers(spark, d).select("*", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("claim_index", "claim_text"))
    return rows.drop("text").withColumn("claim_id", F.concat(F.lit("c"), (F.col("claim_index") + 1).cast("string")))


def claims_with_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each claim with the document that it cites; over all ids from 0 to the number of documents."""
    n = read(spark, d, "documents").count()
    cited = (F.col("conv_id") * 7919 + F.col("claim_index") * 104729 + F.col("turn") * 31) % max(n, 1)
    return claims(spark, d).withColumn("doc_id", cited)


def citations(spark: SparkSession, d: str, held: DataFrame | None = None) -> DataFrame:
    """Claims with their citation; ``held`` is the ledger where the caller has it written already."""
    known = (held if held is not None else ledger(spark, d)).select("doc_id", *[F.col(p).alias(f"p_{p}") for p in A.PARTS])
    rows = claims_with_documents(spark, d).join(known, "doc_id", "left").withColumn("damage", (F.col("conv_id") + F.col("claim_index")) % 7)
    hurt = lambda k, p: F.when(F.col("damage") == k, F.concat(F.col(p), F.lit("x"))).otherwise(F.col(p))
    whole = A.pointer(F.coalesce("p_dataset_id", F.lit("nowhere")), F.coalesce(hurt(2, "p_source_id"), F.lit("none")), F.coalesce(hurt(4, "p_snapshot_hash"), F.lit("none")), F.coalesce(hurt(3, "p_span_id"), F.lit("none")), F.coalesce(hurt(5, "p_span_hash"), F.lit("none")))
    cited = F.when(F.col("damage") == 1, F.concat_ws("/", F.coalesce("p_dataset_id", F.lit("nowhere")), F.lit("broken"))).otherwise(whole)
    return rows.withColumn("citation_id", cited).drop("damage", *[f"p_{p}" for p in A.PARTS])


def validated(spark: SparkSession, d: str) -> DataFrame:
    """All citations validated; the ledger's keys, without texts, are written once."""
    held = settled(ledger(spark, d))
    return A.validate(citations(spark, d, held), held, retrieved(held))


def with_spans(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """Rows with the facts of the document in doc_id; only documents that a row names are tokenised."""
    rows = settled(rows)
    spans = read(spark, d, "documents").select("doc_id", F.col("text").alias("span_text"))
    named = small(rows.select("doc_id").distinct())
    return rows.join(A.span_facts(spans.join(named, "doc_id", "left_semi"), "doc_id"), "doc_id", "left")


def semantic(spark: SparkSession, d: str) -> DataFrame:
    return A.semantic_records(with_spans(spark, d, validated(spark, d)))


def runs(spark: SparkSession, d: str) -> DataFrame:
    """A row for each answer: refusals are answers of fewer than 40 characters."""
    label = F.when(F.length("text") < 40, "insufficient_evidence").otherwise("answered")
    return answers(spark, d).withColumn("refusal_label", label)


# The same in DuckDB SQL.

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sents(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({norm(x)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


def toks(x: str, stop: list[str] | None = None) -> str:
    found = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return f"list_filter({found}, lambda t: t NOT IN ({', '.join(repr(w) for w in stop)}))" if stop else found


def span_hash(x: str) -> str:
    stripped = rf"regexp_replace(regexp_replace({x}, '\A{WS}+', ''), '{WS}+\z', '')"
    return rf"sha256(array_to_string(list_transform(string_split_regex({stripped}, '{LB}'), lambda s: regexp_replace(s, '{WS}+\z', '')), chr(10)))"


def rate(n: str, d: str) -> str:
    return f"coalesce(round_even(CAST({n} AS DOUBLE) / nullif({d}, 0), 6), 0.0)"


def id_part(x: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '\A_+|_+\z', '', 'g')"


def excerpt(x: str) -> str:
    n = norm(f"coalesce({x}, '')")
    return f"CASE WHEN length({n}) > 240 THEN rtrim(substr({n}, 1, 237)) || '...' ELSE {n} END"


LEDGER = f"""l AS (SELECT doc_id, source AS dataset_id, 'doc_' || doc_id AS source_id, substr(sha256(coalesce(lang, '')), 1, 16) AS snapshot_hash,
  'span_' || doc_id AS span_id, {span_hash("coalesce(text, '')")} AS span_hash, text FROM documents),
lp AS (SELECT *, concat_ws('/', dataset_id, source_id, snapshot_hash, span_id, span_hash) AS pointer FROM l)"""

ANSWERS = f"""a AS (SELECT conv_id, turn, conv_id || ':' || turn AS run_id, 'set' || (conv_id % 3) AS dataset_id,
  ([{", ".join(repr(b) for b in BASELINES)}])[(conv_id + turn) % 6 + 1] AS baseline, text FROM conversations WHERE role = 'assistant')"""

CLAIMS = f"""{ANSWERS},
cs AS (SELECT * EXCLUDE (text), {sents("coalesce(text, '')")} AS s FROM a),
c AS (SELECT * EXCLUDE (s), unnest(s) AS claim_text, unnest(range(len(s))) AS claim_index FROM cs),
cl AS (SELECT *, 'c' || (claim_index + 1) AS claim_id, (conv_id * 7919 + claim_index * 104729 + turn * 31) % (SELECT greatest(count(*), 1) FROM documents) AS doc_id, (conv_id + claim_index) % 7 AS damage FROM c)"""

CITATIONS = f"""{LEDGER}, {CLAIMS},
ci AS (SELECT cl.*, l.text AS span_text, CASE WHEN damage = 1 THEN coalesce(l.dataset_id, 'nowhere') || '/broken' ELSE concat_ws('/',
  coalesce(l.dataset_id, 'nowhere'), coalesce(CASE WHEN damage = 2 THEN l.source_id || 'x' ELSE l.source_id END, 'none'),
  coalesce(CASE WHEN damage = 4 THEN l.snapshot_hash || 'x' ELSE l.snapshot_hash END, 'none'),
  coalesce(CASE WHEN damage = 3 THEN l.span_id || 'x' ELSE l.span_id END, 'none'),
  coalesce(CASE WHEN damage = 5 THEN l.span_hash || 'x' ELSE l.span_hash END, 'none')) END AS citation_id
  FROM cl LEFT JOIN l ON l.doc_id = cl.doc_id)"""

def checked(source: str) -> str:
    """CTEs that validate the citation_id of ``source`` against the ledger; the last one is v."""
    return f"""pp AS (SELECT *, string_split(citation_id, '/') AS p FROM {source}),
v0 AS (SELECT pp.*, len(p) = 5 AND NOT list_contains(p, '') AS formed,
  EXISTS (SELECT 1 FROM l WHERE l.dataset_id = p[1] AND l.source_id = p[2]) AS has_source,
  EXISTS (SELECT 1 FROM l WHERE l.dataset_id = p[1] AND l.source_id = p[2] AND l.span_id = p[4]) AS has_span,
  EXISTS (SELECT 1 FROM l WHERE l.dataset_id = p[1] AND l.source_id = p[2] AND l.span_id = p[4] AND l.snapshot_hash = p[3]) AS has_snapshot,
  EXISTS (SELECT 1 FROM lp WHERE lp.pointer = citation_id) AS has_hash,
  EXISTS (SELECT 1 FROM lp WHERE lp.pointer = citation_id AND doc_id % 5 <> 4) AS has_retrieved FROM pp),
v1 AS (SELECT *, CASE WHEN NOT formed THEN 'malformed_citation_id' WHEN NOT has_source OR NOT has_span THEN 'nonexistent_citation_id'
  WHEN NOT has_snapshot THEN 'wrong_snapshot_hash' WHEN NOT has_hash THEN 'wrong_span_hash'
  WHEN NOT has_retrieved THEN 'citation_id_not_in_retrieved_evidence' ELSE 'valid_citation' END AS validator_status FROM v0),
v AS (SELECT *, formed AND has_source AS source_exists, CASE WHEN validator_status = 'valid_citation' THEN 'valid' ELSE 'invalid' END AS structural_validity,
  CASE WHEN validator_status = 'valid_citation' THEN 'none' WHEN validator_status = 'citation_id_not_in_retrieved_evidence' THEN 'not_in_retrieved_evidence' ELSE validator_status END AS validation_error,
  validator_status NOT IN ('malformed_citation_id', 'nonexistent_citation_id', 'wrong_snapshot_hash') AS snapshot_replay_success,
  validator_status NOT IN ('malformed_citation_id', 'nonexistent_citation_id', 'wrong_snapshot_hash', 'wrong_span_hash') AS span_replay_success,
  validator_status = 'valid_citation' AS in_retrieved_evidence FROM v1)"""


VALIDATED = f"{CITATIONS}, {checked('ci')}"


def verdict(source: str, claim: str, span: str, name: str) -> str:
    """CTEs that add verdict and confidence of two text columns to ``source``."""
    neg = ", ".join(repr(w) for w in T.NEGATIONS)
    return f"""{name}_1 AS (SELECT *, list_distinct({toks(f"coalesce({claim}, '')", T.SEMANTIC_STOPWORDS)}) AS ct, list_distinct({toks(f"coalesce({span}, '')", T.SEMANTIC_STOPWORDS)}) AS st FROM {source}),
{name}_2 AS (SELECT *, list_intersect(ct, st) AS both_t, list_has_any(ct, [{neg}]) <> list_has_any(st, [{neg}]) AS flip FROM {name}_1),
{name}_3 AS (SELECT *, coalesce(CAST(len(both_t) AS DOUBLE) / nullif(len(ct), 0), 0.0) AS ratio, len(list_filter(both_t, lambda t: t NOT IN ({neg}))) > 0 AS topical FROM {name}_2),
{name}_4 AS (SELECT *, CASE WHEN len(ct) = 0 OR len(st) = 0 THEN 'insufficient_evidence' WHEN flip AND topical AND ratio >= 0.5 THEN 'contradictory'
  WHEN len(both_t) = len(ct) THEN 'entailed' WHEN ratio >= 0.65 THEN 'partially_supported' ELSE 'unsupported' END AS verdict0 FROM {name}_3),
{name} AS (SELECT * EXCLUDE (ct, st, both_t, flip, topical), verdict0 AS verdict, CASE WHEN verdict0 = 'entailed' THEN 1.0 WHEN verdict0 = 'insufficient_evidence' THEN 0.0 ELSE round_even(ratio, 6) END AS confidence FROM {name}_4)"""


SEMANTIC = f"""{VALIDATED},
{verdict("v", "claim_text", "span_text", "vd")},
sr AS (SELECT * EXCLUDE (verdict, confidence), CASE WHEN structural_validity <> 'valid' THEN 'skipped' WHEN span_text IS NULL THEN 'error' ELSE 'evaluated' END AS semantic_status,
  CASE WHEN structural_validity = 'valid' AND span_text IS NOT NULL THEN verdict END AS verdict, CASE WHEN structural_validity = 'valid' AND span_text IS NOT NULL THEN confidence END AS confidence FROM vd)"""

RUNS = "r AS (SELECT *, CASE WHEN length(text) < 40 THEN 'insufficient_evidence' ELSE 'answered' END AS refusal_label FROM a)"
