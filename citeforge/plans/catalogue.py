"""All registered queries of the attribution engine and their DuckDB oracles.

Each query takes (spark, sf_dir), reads the given tables whole, and has a flat result with a unique
order-free set of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators import attribution as A
from citeforge.operators import evidence as E
from citeforge.operators import judging as J
from citeforge.operators import metrics as M
from citeforge.operators import rules as R
from citeforge.operators import serving as S
from citeforge.operators.judging import settled
from citeforge.operators.sizing import small
from citeforge.plans import tables as B
from citeforge.plans.registry import query
from citeforge.streaming.audit import pending

# Ledger and text functions

_LD = f"""d0 AS (SELECT doc_id, 'doc_' || doc_id AS source_doc_id, 'corpus://' || source || '/' || doc_id AS source_uri, {B.norm("coalesce(text, '')")} AS text FROM documents),
d1 AS (SELECT *, sha256(text) AS source_hash FROM d0),
ld AS (SELECT *, 'doc_' || substr(sha256(source_doc_id || source_hash), 1, 16) AS document_id FROM d1)"""


@query(f"WITH {_LD} SELECT doc_id, document_id, source_uri, source_hash, length(text) AS n_chars FROM ld")
def ledger_documents(spark, d):
    rows = E.ledger_documents(B.corpus(spark, d))
    return rows.select("doc_id", "document_id", "source_uri", "source_hash", F.length("text").cast("long").alias("n_chars"))


@query(f"""WITH {_LD}, s0 AS (SELECT *, 'chunk_' || substr(sha256(document_id || ':0'), 1, 16) AS chunk_id, {B.sents("text")} AS s FROM ld),
s1 AS (SELECT document_id, chunk_id, source_uri, unnest(s) AS t, unnest(range(len(s))) AS span_index FROM s0),
s2 AS (SELECT *, sha256(t) AS span_hash FROM s1)
SELECT document_id, span_index, 'span_' || substr(sha256(chunk_id || ':' || span_index || ':' || span_hash), 1, 16) AS span_id, span_hash, source_uri || '#span=' || span_index AS replay_path FROM s2""")
def ledger_spans(spark, d):
    rows = E.ledger_spans(E.ledger_documents(B.corpus(spark, d)))
    return rows.select("document_id", F.col("span_index").cast("long").alias("span_index"), "span_id", "span_hash", "replay_path")


@query(f"SELECT doc_id, {B.span_hash("coalesce(text, '')")} AS span_hash FROM documents")
def span_hash(spark, d):
    return B.read(spark, d, "documents").select("doc_id", T.span_hash(F.coalesce("text", F.lit(""))).alias("span_hash"))


@query(f"SELECT doc_id, {B.excerpt('text')} AS excerpt, substr(text, 1, 240) AS raw_excerpt FROM documents")
def excerpt(spark, d):
    return B.read(spark, d, "documents").select("doc_id", T.excerpt(F.col("text")).alias("excerpt"), F.substring("text", 1, 240).alias("raw_excerpt"))


@query(f"SELECT page_id, coalesce(nullif({B.id_part("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, ''), 'untitled') AS slug FROM pages")
def slugify(spark, d):
    return B.read(spark, d, "pages").select("page_id", T.slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query(f"""SELECT source, lang, concat_ws('_', {B.id_part('source')}, {B.id_part('lang')}, 'v_1', substr(sha256(source || lang || count(*)), 1, 16)) AS snapshot_id FROM documents GROUP BY source, lang""")
def snapshot_ids(spark, d):
    groups = B.read(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    digest = T.sha256(F.concat("source", "lang", F.col("n").cast("string")))
    return groups.select("source", "lang", T.snapshot_id(F.col("source"), F.col("lang"), F.lit("v.1"), digest).alias("snapshot_id"))


@query(r"""SELECT lang, count(*) AS n_docs, CAST(sum(CASE WHEN regexp_matches(text, 'sk-[A-Za-z0-9_\-]{12,}') OR regexp_matches(text, '(?i)Bearer\s+[A-Za-z0-9_\-.]{12,}')
OR regexp_matches(text, '(?i)[A-Z]+_API_KEY\s*=') THEN 1 ELSE 0 END) AS BIGINT) AS n_credentials,
CAST(sum(CASE WHEN regexp_matches(text, '(?i)(password|token|secret)\s*[:=]') THEN 1 ELSE 0 END) AS BIGINT) AS n_assignments FROM documents GROUP BY lang""")
def credential_scan(spark, d):
    docs = B.read(spark, d, "documents")
    return docs.groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.count_if(T.has_credential(F.col("text"))).alias("n_credentials"), F.count_if(F.col("text").rlike(r"(?i)(password|token|secret)\s*[:=]")).alias("n_assignments")
    )


# Index

_CORPUS = "cp AS (SELECT source AS dataset_id, lang AS split, doc_id, 'doc_' || doc_id AS source_doc_id, text FROM documents)"


@query(f"""WITH {_CORPUS} SELECT dataset_id, split, source_doc_id, row_number() OVER (PARTITION BY dataset_id, split ORDER BY source_doc_id) - 1 AS internal_doc_id,
sha256(coalesce(text, '')) AS text_hash, CAST(len({B.toks("coalesce(text, '')")}) AS BIGINT) AS token_count FROM cp""")
def index_documents(spark, d):
    return E.index_documents(B.corpus(spark, d))


@query(f"""WITH t AS (SELECT source AS dataset_id, doc_id, unnest({B.toks('text')}) AS token FROM documents), p AS (SELECT dataset_id, doc_id, token, count(*) AS tf FROM t GROUP BY ALL)
SELECT dataset_id, token, count(*) AS document_frequency, CAST(sum(tf) AS BIGINT) AS total_term_frequency FROM p GROUP BY dataset_id, token""")
def term_stats(spark, d):
    return E.term_stats(E.postings(B.corpus(spark, d), "dataset_id", "doc_id"), "dataset_id")


@query(f"""WITH {_CORPUS}, i AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, split ORDER BY source_doc_id) - 1 AS internal_doc_id FROM cp),
t AS (SELECT dataset_id, split, internal_doc_id, unnest({B.toks('text')}) AS token FROM i), p AS (SELECT dataset_id, split, token, internal_doc_id, count(*) AS tf FROM t GROUP BY ALL)
SELECT dataset_id, split, token, internal_doc_id // 1024 AS block, string_agg(internal_doc_id || ':' || tf, ',' ORDER BY internal_doc_id) AS postings FROM p GROUP BY ALL""")
def postings_nested(spark, d):
    corpus = B.corpus(spark, d)
    numbered = corpus.join(E.index_documents(corpus).select("dataset_id", "split", "source_doc_id", "internal_doc_id"), ["dataset_id", "split", "source_doc_id"])
    blocks = E.posting_blocks(E.postings(numbered, "dataset_id", "split", "internal_doc_id"), "dataset_id", "split")
    joined = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["internal_doc_id"].cast("string"), p["term_frequency"].cast("string"))), ",")
    return blocks.select("dataset_id", "split", "token", "block", joined.alias("postings"))


def _tree(levels: int) -> str:
    sql = "t0 AS (SELECT dataset_id, pos, sha256(v) AS h FROM leaf)"
    for k in range(1, levels + 1):
        sql += f", t{k} AS (SELECT dataset_id, up AS pos, sha256(string_agg(h, chr(10) ORDER BY pos)) AS h FROM (SELECT *, pos // 1024 AS up FROM t{k - 1}) GROUP BY dataset_id, up)"
    return sql


@query(f"""WITH leaf AS (SELECT source AS dataset_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, doc_id || ':' || coalesce(text, '') AS v FROM documents),
{_tree(3)} SELECT dataset_id, h AS corpus_hash FROM t3""")
def corpus_digest(spark, d):
    return E.ordered_digest(B.corpus(spark, d), "doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))), "dataset_id")


# Retrieval

_TERMS = f"qt AS (SELECT item_id AS question_id, token, count(*) AS qf FROM (SELECT item_id, unnest({B.toks('text')}) AS token FROM benchmark) GROUP BY ALL)"
_POSTS = f"po AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({B.toks('text')}) AS token FROM documents) GROUP BY ALL)"
_SCORES = f"{_TERMS}, {_POSTS}, sc AS (SELECT question_id, 'doc_' || doc_id AS source_doc_id, CAST(sum(qf * tf) AS BIGINT) AS score FROM qt JOIN po USING (token) GROUP BY ALL)"
_TOP8 = f"{_SCORES}, rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, source_doc_id) AS rank FROM sc)"


def _top8(spark, d):
    return E.rank_evidence(B.questions(spark, d), B.corpus(spark, d))


@query(f"WITH {_TOP8} SELECT question_id, source_doc_id, score, rank FROM rk WHERE rank <= 8")
def rank_evidence_top8(spark, d):
    return _top8(spark, d).select("question_id", "source_doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_SCORES}, cx AS (SELECT item_id AS question_id, 'doc_' || doc_id AS source_doc_id FROM benchmark JOIN documents ON source = 'src' || (item_id % 20)),
rk AS (SELECT cx.*, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY cx.question_id ORDER BY coalesce(score, 0) DESC, cx.source_doc_id) AS rank FROM cx LEFT JOIN sc USING (question_id, source_doc_id))
SELECT question_id, source_doc_id, score, rank FROM rk WHERE rank <= 8""")
def rank_evidence_scoped(spark, d):
    items, corpus = B.questions(spark, d), B.corpus(spark, d)
    scope = F.concat(F.lit("src"), (F.col("question_id") % 20).cast("string"))
    context = items.withColumn("dataset_id", scope).join(corpus.select("dataset_id", "source_doc_id"), "dataset_id").select("question_id", "source_doc_id")
    ranked = E.rank_scoped(items, corpus, context)
    return ranked.select("question_id", "source_doc_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH qt AS (SELECT item_id AS question_id, token, count(*) AS qf FROM (SELECT item_id, unnest({B.toks('text', T.RETRIEVAL_STOPWORDS)}) AS token FROM benchmark) GROUP BY ALL),
nq AS (SELECT question_id, count(*) AS nq FROM qt GROUP BY 1),
sp AS (SELECT 'doc_' || doc_id AS span_id, {B.toks('text', T.RETRIEVAL_STOPWORDS)} AS t FROM documents),
po AS (SELECT span_id, len(t) AS n, token, count(*) AS f FROM (SELECT span_id, t, unnest(t) AS token FROM sp) GROUP BY ALL),
ov AS (SELECT question_id, span_id, n, sum(least(f, qf)) AS o FROM qt JOIN po USING (token) GROUP BY ALL),
sc AS (SELECT question_id, span_id, round_even(CAST(o AS DOUBLE) / nq + CAST(o AS DOUBLE) / sqrt(CAST(n AS DOUBLE)), 6) AS score FROM ov JOIN nq USING (question_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, span_id) AS rank FROM (SELECT question_id, span_id, score FROM (SELECT item_id AS question_id, sp.span_id, coalesce(score, 0.0) AS score
  FROM benchmark CROSS JOIN sp LEFT JOIN sc ON sc.question_id = item_id AND sc.span_id = sp.span_id)))
SELECT question_id, span_id, score, rank FROM rk WHERE rank <= 2""")
def retrieve_spans_top2(spark, d):
    spans = B.corpus(spark, d).select(F.col("source_doc_id").alias("span_id"), "text")
    return S.retrieve_spans(B.questions(spark, d), spans).select("question_id", "span_id", "score", F.col("rank").cast("long").alias("rank"))


_SUPPORT = "su AS (SELECT item_id AS question_id, 'doc_' || doc_id AS source_doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query(f"""WITH {_TOP8}, {_SUPPORT}, m AS (SELECT question_id, count(*) AS n, count(su.source_doc_id) AS hits, min(CASE WHEN su.source_doc_id IS NOT NULL THEN rank END) AS first
  FROM (SELECT * FROM rk WHERE rank <= 8) LEFT JOIN su USING (question_id, source_doc_id) GROUP BY question_id),
e AS (SELECT item_id, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits, first FROM benchmark LEFT JOIN m ON question_id = item_id)
SELECT count(*) AS question_count, round_even(avg(CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS recall_at_k, round_even(avg(CAST(hits AS DOUBLE) / greatest(n, 1)), 6) AS precision_at_k,
round_even(avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)), 6) AS mrr FROM e""")
def pilot_retrieval_metrics(spark, d):
    """Support documents hold the question's text; candidates come from an equi-join on its words."""
    items, corpus = B.questions(spark, d), B.corpus(spark, d)
    return M.retrieval_metrics(_top8(spark, d), _support(items, corpus), items)


def _support(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question_id, source_doc_id) where the document's text contains the question's.

    A containing document has all words of a question but the first and the last as whole words, so
    documents are matched on the longest two of them in a row, or the one where there is one. The
    questions are the small side: words that none of them has go before any shuffle. Questions of
    one or two words have no such word; blocks of them are held against all texts.
    """
    words = F.split("question_text", "[ \n]")
    asked = items.where("question_text is not null").withColumn("w", words)
    inner = F.slice(F.col("w"), 2, F.greatest(F.size("w") - 2, F.lit(0)))
    pair = F.zip_with(inner, F.slice(inner, 2, F.greatest(F.size(inner), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    longest = F.element_at(F.array_sort(F.transform(F.array_compact(pair), lambda x: F.struct(F.length(x).alias("n"), x.alias("x")))), -1)["x"]
    keyed = settled(asked.where(F.size("w") > 2).select("question_id", "question_text", F.when(F.size("w") == 3, F.element_at("w", 2)).when(F.size("w") > 3, longest).alias("key")))
    own = F.split("text", "[ \n]")
    pairs = F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b)))
    parts = F.array_distinct(F.concat(F.array_compact(pairs), own)) if not keyed.where(~F.contains("key", F.lit(" "))).isEmpty() else F.array_distinct(F.array_compact(pairs))
    met = corpus.select("source_doc_id", F.explode(parts).alias("key")).join(small(keyed), "key").select("question_id", "question_text", "source_doc_id").distinct()
    sure = met.join(corpus.select("source_doc_id", "text"), "source_doc_id").where(F.contains("text", "question_text")).select("question_id", "source_doc_id")
    short = asked.where(F.size("w") <= 2).select("question_id", "question_text").collect()  # questions of one or two words
    for a in range(0, len(short), 1000):
        block = F.array(*[F.struct(F.lit(r[0]).cast("long").alias("question_id"), F.lit(r[1]).alias("q")) for r in short[a : a + 1000]])
        held = corpus.select("source_doc_id", F.explode(F.filter(block, lambda x: F.contains(F.col("text"), x["q"]))).alias("x"))
        sure = sure.union(held.select("x.question_id", "source_doc_id"))
    return sure


@query(f"""WITH {_TOP8}, b AS (SELECT question_id, q.text AS qtext, d.text AS dtext FROM rk JOIN benchmark q ON item_id = question_id JOIN documents d ON 'doc_' || d.doc_id = source_doc_id WHERE rank = 1),
f AS (SELECT question_id, list_distinct({B.toks('qtext')}) AS x, list_distinct({B.toks('dtext')}) AS y FROM b)
SELECT question_id, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(list_intersect(x, y)) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)) END AS f1 FROM f""")
def token_set_f1(spark, d):
    best = _top8(spark, d).where("rank = 1").join(B.questions(spark, d), "question_id").join(B.corpus(spark, d).select("source_doc_id", "text"), "source_doc_id")
    return best.select("question_id", T.set_f1(T.tokens(F.col("question_text")), T.tokens(F.col("text"))).alias("f1"))


@query(f"""WITH {_TOP8}, s AS (SELECT question_id, q.text AS claim, 'not ' || q.text AS negated, d.text AS span, rank FROM rk JOIN benchmark q ON item_id = question_id JOIN documents d ON 'doc_' || d.doc_id = source_doc_id WHERE rank <= 8),
{B.verdict('s', 'claim', 'span', 'p')}, {B.verdict('s', 'negated', 'span', 'n')}
SELECT question_id, rank, false AS negated, verdict, confidence FROM p UNION ALL SELECT question_id, rank, true, verdict, confidence FROM n""")
def claim_span_verdict(spark, d):
    """Each question as a claim on its evidence, plain and negated."""
    top = settled(_top8(spark, d))
    spans = B.corpus(spark, d).join(small(top.select("source_doc_id").distinct()), "source_doc_id", "left_semi")
    spans = spans.select("source_doc_id", A.meaning(F.col("text")).alias("span_meaning"))
    asked = B.questions(spark, d).withColumn("negated", F.explode(F.array(F.lit(False), F.lit(True))))
    claim = F.when(F.col("negated"), F.concat(F.lit("not "), "question_text")).otherwise(F.col("question_text"))
    asked = asked.select("question_id", "negated", A.meaning(claim).alias("claim_meaning"))
    rows = top.join(asked, "question_id").join(spans, "source_doc_id")
    v = A.verdict(F.col("claim_meaning"), F.col("span_meaning"))
    return rows.select("question_id", F.col("rank").cast("long").alias("rank"), "negated", v.alias("v")).select("question_id", "rank", "negated", "v.verdict", "v.confidence")


@query(f"""WITH {_TOP8}, e AS (SELECT question_id, count(*) AS n_evidence, string_agg(source_doc_id, ',' ORDER BY rank) AS evidence FROM rk WHERE rank <= 8 GROUP BY question_id)
SELECT item_id AS question_id, sha256('Question:' || chr(10) || text || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, '')) AS request_hash,
CAST(length('Question:' || chr(10) || text || chr(10) || 'Evidence:' || chr(10) || coalesce(evidence, '')) AS BIGINT) AS request_length, coalesce(n_evidence, 0) AS n_evidence FROM benchmark LEFT JOIN e ON question_id = item_id""")
def request_build(spark, d):
    """The request text of each question with its evidence in rank order (at most eight a group)."""
    entries = _top8(spark, d).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source_doc_id"))).alias("e"))
    rows = B.questions(spark, d).join(entries, "question_id", "left")
    listed = F.coalesce(F.array_join("e.source_doc_id", ","), F.lit(""))
    request = F.concat(F.lit("Question:\n"), "question_text", F.lit("\nEvidence:\n"), listed)
    return rows.select("question_id", T.sha256(request).alias("request_hash"), F.length(request).cast("long").alias("request_length"), F.greatest(F.coalesce(F.size("e"), F.lit(0)), F.lit(0)).cast("long").alias("n_evidence"))


# Pointers and validation


@query(f"WITH {B.LEDGER} SELECT doc_id, pointer FROM lp")
def pointer_build(spark, d):
    return B.ledger(spark, d).select("doc_id", "pointer")


@query(f"WITH {B.CITATIONS}, p AS (SELECT run_id, claim_id, string_split(citation_id, '/') AS p FROM ci) SELECT run_id, claim_id, CASE WHEN len(p) = 5 AND NOT list_contains(p, '') THEN p[2] END AS source_id, CASE WHEN len(p) = 5 AND NOT list_contains(p, '') THEN p[4] END AS span_id FROM p")
def pointer_parse(spark, d):
    rows = B.citations(spark, d).withColumn("p", A.parsed(F.col("citation_id")))
    return rows.select("run_id", "claim_id", "p.source_id", "p.span_id")


_FLAGS = ["source_exists", "structural_validity", "validation_error", "snapshot_replay_success", "span_replay_success", "in_retrieved_evidence"]


@query(f"WITH {B.VALIDATED} SELECT run_id, claim_id, citation_id, validator_status, {', '.join(_FLAGS)} FROM v")
def validate_citations(spark, d):
    return B.validated(spark, d).select("run_id", "claim_id", "citation_id", "validator_status", *_FLAGS)


@query(f"WITH {B.VALIDATED} SELECT baseline, validation_error, count(*) AS n FROM v GROUP BY baseline, validation_error")
def validation_error_histogram(spark, d):
    return B.validated(spark, d).groupBy("baseline", "validation_error").agg(F.count("*").alias("n"))


@query(rf"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace('  `"' || text || '"` ', '\A{B.WS}+', ''), '{B.WS}+\z', ''), '\A[`''"]+|[`''"]+\z', '', 'g') AS citation_id FROM conversations""")
def citation_normalize(spark, d):
    raw = F.concat(F.lit('  `"'), "text", F.lit('"` '))
    return B.read(spark, d, "conversations").select("conv_id", "turn", T.citation_id(raw).alias("citation_id"))


_DOCS = "(SELECT count(*) FROM documents)"


@query(f"""WITH {B.LEDGER}, {B.CLAIMS}, ev AS (SELECT doc_id, pointer, 'e' || (doc_id % ({_DOCS} // 2 + 1)) AS evidence_id, 's' || (doc_id % ({_DOCS} * 2 // 3 + 1)) AS ledger_span_id FROM lp),
ks AS (SELECT evidence_id AS legacy, doc_id, 0 AS o, pointer FROM ev UNION ALL SELECT ledger_span_id, doc_id, 1, pointer FROM ev),
mx AS (SELECT legacy, arg_max(pointer, doc_id * 2 + o) AS pointer FROM ks GROUP BY legacy)
SELECT cl.run_id, cl.claim_id, coalesce(mx.pointer, x.cited) AS citation_id FROM cl, LATERAL (SELECT CASE WHEN claim_index % 2 = 0 THEN 'e' || cl.doc_id ELSE 's' || cl.doc_id END AS cited) x LEFT JOIN mx ON mx.legacy = x.cited""")
def legacy_id_resolve(spark, d):
    """Older ids are resolved; of the documents that share one, the last wins."""
    rows = _legacy(spark, d)
    return A.resolve_legacy(rows[0], rows[1]).select(F.col("answer_id").alias("run_id"), "claim_id", "citation_id")


def _legacy(spark, d, held=None):
    """Claims that cite documents by older ids, and the ids that documents have; some share one."""
    one = F.lit("all")
    n = B.read(spark, d, "documents").count()
    old = lambda mark, k: F.concat(F.lit(mark), (F.col("doc_id") % k).cast("string"))
    held = B.ledger(spark, d) if held is None else held
    evidence = held.select(one.alias("run_id"), F.col("doc_id").alias("position"), F.col("pointer").alias("citation_id"), old("e", n // 2 + 1).alias("evidence_id"), old("s", n * 2 // 3 + 1).alias("ledger_span_id"))
    cited = F.concat(F.when(F.col("claim_index") % 2 == 0, F.lit("e")).otherwise(F.lit("s")), F.col("doc_id").cast("string"))
    rows = B.claims_with_documents(spark, d).select(F.col("run_id").alias("answer_id"), "claim_id", "claim_index", one.alias("run_id"), cited.alias("cited_id"))
    return rows, evidence


@query(f"WITH {B.SEMANTIC} SELECT run_id, claim_id, semantic_status, verdict, confidence, {B.excerpt('claim_text')} AS claim_excerpt, {B.excerpt('span_text')} AS span_excerpt FROM sr")
def semantic_records(spark, d):
    return B.semantic(spark, d).select("run_id", "claim_id", "semantic_status", "verdict", "confidence", "claim_excerpt", "span_excerpt")


_SEM_COUNTS = ", ".join(f"CAST(count(*) FILTER (verdict = '{v}') AS BIGINT) AS {v}_count" for v in M.VERDICTS) + ", count(semantic_status) AS semantic_record_count, count(*) FILTER (semantic_status = 'skipped') AS skipped_count, count(*) FILTER (semantic_status = 'evaluated') AS evaluated_count"
_SEM_RATES = ", ".join(f"{B.rate(f'{v}_count', 'semantic_record_count')} AS {v}_rate" for v in M.VERDICTS) + f", {B.rate('skipped_count', 'semantic_record_count')} AS skipped_rate, {B.rate('entailed_count', 'evaluated_count')} AS entailed_rate_of_evaluated"


@query(f"WITH {B.SEMANTIC}, g AS (SELECT dataset_id, {_SEM_COUNTS} FROM sr GROUP BY dataset_id) SELECT *, {_SEM_RATES} FROM g")
def semantic_summary(spark, d):
    return M.semantic_rates(B.semantic(spark, d).groupBy("dataset_id").agg(*[c.alias(n) for n, c in M.semantic_counts().items()]))


# Metrics

_VAL_COUNTS = """count(validator_status) AS citation_count, count(*) FILTER (structural_validity = 'valid') AS valid_citation_count, count(*) FILTER (validation_error = 'malformed_citation_id') AS malformed_citation_count,
count(*) FILTER (validation_error = 'nonexistent_citation_id') AS nonexistent_citation_count, count(*) FILTER (validation_error = 'not_in_retrieved_evidence') AS not_retrieved_citation_count,
count(*) FILTER (validation_error = 'wrong_snapshot_hash') AS wrong_snapshot_hash_count, count(*) FILTER (validation_error = 'wrong_span_hash') AS wrong_span_hash_count,
count(*) FILTER (span_replay_success) AS span_replay_count, count(*) FILTER (snapshot_replay_success) AS snapshot_replay_count"""
_VAL_RATES = "citation_count - valid_citation_count AS invalid_citation_count, " + ", ".join(
    f"{B.rate(n, 'citation_count')} AS {k}"
    for k, n in {
        "invalid_citation_rate": "(citation_count - valid_citation_count)", "citation_id_validity_rate": "valid_citation_count", "not_in_retrieved_evidence_rate": "not_retrieved_citation_count",
        "malformed_citation_rate": "malformed_citation_count", "wrong_snapshot_hash_rate": "wrong_snapshot_hash_count", "wrong_span_hash_rate": "wrong_span_hash_count",
        "span_replay_success_rate": "span_replay_count", "snapshot_replay_success_rate": "snapshot_replay_count",
    }.items()
)


@query(f"""WITH {B.VALIDATED}, g AS (SELECT run_id, {_VAL_COUNTS}, count(DISTINCT claim_id) FILTER (structural_validity = 'valid') AS cited_claims, count(DISTINCT claim_id) AS claim_count FROM v GROUP BY run_id)
SELECT *, {_VAL_RATES}, CAST(cited_claims AS DOUBLE) / greatest(claim_count, 1) AS mapping_completeness, claim_count - cited_claims AS uncited_claim_count FROM g""")
def metric_record_by_run(spark, d):
    valid = F.when(F.col("structural_validity") == "valid", F.col("claim_id"))
    rows = B.validated(spark, d).groupBy("run_id").agg(*[c.alias(n) for n, c in M.validation_counts().items()], F.count_distinct(valid).alias("cited_claims"), F.count_distinct("claim_id").alias("claim_count"))
    rows = M.validation_rates(rows)
    return rows.withColumns({"mapping_completeness": F.col("cited_claims").cast("double") / F.greatest("claim_count", F.lit(1)), "uncited_claim_count": F.col("claim_count") - F.col("cited_claims")})


@query(f"""WITH {B.SEMANTIC}, {B.RUNS}, x AS (SELECT baseline, {_VAL_COUNTS} FROM sr GROUP BY baseline), y AS (SELECT baseline, count(*) AS run_count, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) FILTER (refusal_label <> 'answered') AS refusals FROM r GROUP BY baseline),
z AS (SELECT baseline, count(*) AS claim_count FROM cl GROUP BY baseline)
SELECT baseline, run_count, claim_count, citation_count, {B.rate('claim_count', 'run_count')} AS claims_per_answer, {B.rate('citation_count', 'run_count')} AS citations_per_answer, {B.rate('chars', 'run_count')} AS answer_length, {B.rate('refusals', 'run_count')} AS refusal_rate, {B.rate('valid_citation_count', 'citation_count')} AS citation_id_validity_rate
FROM y LEFT JOIN x USING (baseline) LEFT JOIN z USING (baseline)""")
def baseline_table(spark, d):
    x = B.semantic(spark, d).groupBy("baseline").agg(F.count("validator_status").alias("citation_count"), F.count_if(F.col("structural_validity") == "valid").alias("valid"))
    y = B.runs(spark, d).groupBy("baseline").agg(F.count("*").alias("run_count"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("refusal_label") != "answered").alias("refusals"))
    z = B.claims(spark, d).groupBy("baseline").agg(F.count("*").alias("claim_count"))
    rows = y.join(x, "baseline", "left").join(z, "baseline", "left")
    c = F.col
    return rows.select(
        "baseline", "run_count", "claim_count", "citation_count", T.rate(c("claim_count"), c("run_count")).alias("claims_per_answer"), T.rate(c("citation_count"), c("run_count")).alias("citations_per_answer"),
        T.rate(c("chars"), c("run_count")).alias("answer_length"), T.rate(c("refusals"), c("run_count")).alias("refusal_rate"), T.rate(c("valid"), c("citation_count")).alias("citation_id_validity_rate"),
    )


@query(f"""WITH {B.SEMANTIC}, {B.RUNS},
x AS (SELECT dataset_id, baseline, grouping(dataset_id, baseline) AS g, count(*) AS record_count, count(*) FILTER (refusal_label <> 'answered') AS refusal_count FROM r GROUP BY CUBE (dataset_id, baseline)),
k AS (SELECT run_id, dataset_id, baseline, claim_id, 1 AS anyc, max(CASE WHEN structural_validity = 'valid' THEN 1 END) AS validc FROM sr GROUP BY ALL),
y AS (SELECT dataset_id, baseline, grouping(dataset_id, baseline) AS g, count(*) AS claim_count, count(anyc) AS covered_any, count(validc) AS covered_valid FROM k GROUP BY CUBE (dataset_id, baseline)),
z AS (SELECT dataset_id, baseline, grouping(dataset_id, baseline) AS g, {_VAL_COUNTS}, {_SEM_COUNTS} FROM sr GROUP BY CUBE (dataset_id, baseline)),
j AS (SELECT x.dataset_id, x.baseline, x.g AS "grouping", record_count, refusal_count, coalesce(claim_count, 0) AS claim_count, coalesce(covered_any, 0) AS covered_any, coalesce(covered_valid, 0) AS covered_valid, z.* EXCLUDE (dataset_id, baseline, g)
  FROM x LEFT JOIN y ON x.g = y.g AND x.dataset_id IS NOT DISTINCT FROM y.dataset_id AND x.baseline IS NOT DISTINCT FROM y.baseline LEFT JOIN z ON x.g = z.g AND x.dataset_id IS NOT DISTINCT FROM z.dataset_id AND x.baseline IS NOT DISTINCT FROM z.baseline)
SELECT *, {_VAL_RATES}, {_SEM_RATES}, {B.rate('refusal_count', 'record_count')} AS refusal_rate, {B.rate('covered_any', 'claim_count')} AS coverage_any_validation, {B.rate('covered_valid', 'claim_count')} AS coverage_valid FROM j""")
def attribution_audit_cube(spark, d):
    return M.audit(B.runs(spark, d), B.claims(spark, d), B.semantic(spark, d))


@query(f"""WITH {B.CITATIONS}, {B.RUNS}, n AS (SELECT run_id, count(*) AS claim_count, count(*) FILTER (damage <> 1) AS citation_count, bool_or(span_text IS NOT NULL) AS support_hit FROM ci GROUP BY run_id),
s AS (SELECT r.baseline, coalesce(support_hit, false) AS support_hit, refusal_label <> 'answered' AS refusal, coalesce(citation_count, 0) AS citation_count, coalesce(claim_count, 0) AS claim_count, length(text) // 4 AS p, length(text) // 8 AS c,
CAST(round_even((length(text) // 4) / 1e6 * 0.435 + (length(text) // 8) / 1e6 * 0.87, 6) AS DECIMAL(18,6)) AS usd FROM r LEFT JOIN n USING (run_id)),
g AS (SELECT baseline, grouping(baseline) AS "grouping", count(*) AS record_count, count(*) FILTER (support_hit) AS support_hit_count, count(*) FILTER (refusal) AS refusal_count, CAST(sum(citation_count) AS BIGINT) AS citation_count,
CAST(sum(claim_count) AS BIGINT) AS claim_count, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(sum(usd) AS DOUBLE) AS estimated_cost_usd FROM s GROUP BY ROLLUP (baseline)),
h AS (SELECT *, {B.rate('support_hit_count', 'record_count')} AS support_hit_rate, {B.rate('refusal_count', 'record_count')} AS refusal_rate, {B.rate('citation_count', 'claim_count')} AS claim_to_citation_rate FROM g)
SELECT *, CASE WHEN support_hit_rate < 0.8 THEN 'fix_retrieval_before_scaling' WHEN refusal_rate > 0.5 THEN 'inspect_prompt_refusal_behavior_before_scaling' ELSE 'eligible_for_larger_mini_run' END AS recommendation FROM h""")
def review_rollup(spark, d):
    known = B.read(spark, d, "documents").select("doc_id", F.lit(True).alias("there"))
    cited = B.claims_with_documents(spark, d).join(known, "doc_id", "left").groupBy("run_id").agg(F.count("*").alias("claim_count"), F.count_if((F.col("conv_id") + F.col("claim_index")) % 7 != 1).alias("citation_count"), F.count_if(F.col("there")).alias("hits"))
    n = F.length("text")
    rows = B.runs(spark, d).join(cited, "run_id", "left").select(
        "baseline", (F.coalesce("hits", F.lit(0)) > 0).alias("support_hit"), (F.col("refusal_label") != "answered").alias("refusal"), F.coalesce("citation_count", F.lit(0)).alias("citation_count"), F.coalesce("claim_count", F.lit(0)).alias("claim_count"),
        F.floor(n / 4).alias("prompt_tokens"), F.floor(n / 8).alias("completion_tokens"), T.cost_usd(F.floor(n / 4), F.floor(n / 8)).cast("decimal(18,6)").alias("cost"),
    )
    return M.review(rows).withColumn("estimated_cost_usd", F.col("estimated_cost_usd").cast("double"))


@query("""WITH c AS (SELECT event_type, count(*) AS calls, CAST(sum(event_id % 900) AS BIGINT) AS prompt_tokens, CAST(sum(event_id % 170) AS BIGINT) AS completion_tokens FROM events GROUP BY event_type)
SELECT *, round_even(prompt_tokens / 1e6 * 0.435 + completion_tokens / 1e6 * 0.87, 6) AS cost_usd FROM c""")
def cost_summary(spark, d):
    rows = B.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 900).alias("prompt_tokens"), F.sum(F.col("event_id") % 170).alias("completion_tokens"))
    return rows.withColumn("cost_usd", T.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens")))


# Annotation and judges


@query(f"""WITH {B.SEMANTIC}, o AS (SELECT *, sum(CASE WHEN structural_validity = 'valid' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY claim_index) AS n FROM sr)
SELECT concat_ws('__', dataset_id, run_id, baseline, claim_id, CAST(n AS VARCHAR)) AS annotation_id, claim_text, sha256(coalesce(span_text, '')) AS span_hash, verdict FROM o WHERE structural_validity = 'valid'""")
def annotation_export(spark, d):
    rows = J.annotation_rows(B.semantic(spark, d).withColumn("citation_ordinal", F.col("claim_index")))
    return rows.select("annotation_id", "claim_text", F.coalesce("span_sha256", T.sha256(F.lit(""))).alias("span_hash"), "verdict")


def _labels(spark, d):
    """Two judges' labels of labelled documents: one from the labels, one from the texts' lengths."""
    rows = B.read(spark, d, "labels").join(B.read(spark, d, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    pick = lambda c: F.element_at(F.array(*map(F.lit, J.LABELS)), (c % 5 + 1).cast("int"))
    return rows.select("doc_id", F.col("doc_id").cast("string").alias("annotation_id"), pick(F.col("quality") + 2 * F.col("toxic") + F.col("doc_id") % 3).alias("old"), pick(F.col("n") % 7 + F.col("quality")).alias("new"))


_LABELS = f"lb AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS annotation_id, ([{', '.join(repr(x) for x in J.LABELS)}])[(quality + 2 * toxic + doc_id % 3) % 5 + 1] AS old, ([{', '.join(repr(x) for x in J.LABELS)}])[(length(text) % 7 + quality) % 5 + 1] AS new FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_LABELS}, k AS (SELECT unnest([{', '.join(repr(x) for x in J.LABELS)}]) AS label) SELECT label, count(new) AS n FROM k LEFT JOIN lb ON new = label GROUP BY label")
def label_distribution(spark, d):
    return J.label_distribution(_labels(spark, d), "new")


def _compared(spark, d):
    rows = _labels(spark, d)
    return J.compare_labels(rows.select("annotation_id", F.col("old").alias("judge_label")), rows.select("annotation_id", F.col("new").alias("judge_label")))


@query(f"WITH {_LABELS} SELECT old AS old_label, " + ", ".join(f"count(*) FILTER (new = '{x}') AS {x}" for x in J.LABELS) + " FROM lb GROUP BY old")
def label_confusion(spark, d):
    return J.confusion(_compared(spark, d))


@query(f"WITH {_LABELS} SELECT annotation_id, old AS old_label, new AS new_label, old <> new AS changed, old <> new AND old = 'contradictory' AS from_contradictory, old = 'entailed' AND new IN ('insufficient_evidence', 'partially_supported', 'unsupported') AS from_entailed FROM lb")
def label_changes(spark, d):
    return _compared(spark, d)


@query(f"WITH {_LABELS} SELECT doc_id, new AS judge_label FROM lb ORDER BY list_position([{', '.join(repr(x) for x in J.AUDIT_PRIORITY)}], new), doc_id LIMIT 50")
def stratified_audit_subset(spark, d):
    return J.audit_subset(_labels(spark, d).withColumn("judge_label", F.col("new")), "doc_id").select("doc_id", "judge_label")


class LengthJudge:
    """A stand-in for a remote judge: fails on long claims and at first on claims of even length."""

    def __init__(self):
        self.asked: set[str] = set()

    def __call__(self, row: dict) -> dict:
        claim = row["claim_text"]
        if len(claim) > 150:
            raise TimeoutError("too long")
        if len(claim) % 2 == 0 and claim not in self.asked:
            self.asked.add(claim)
            raise ConnectionError("try again")
        return {"label": J.LABELS[len(claim) % 5], "confidence": 2.0}


@query(f"""WITH {B.VALIDATED} SELECT run_id, claim_id, CASE WHEN trim(coalesce(span_text, '')) = '' THEN 'skipped' WHEN length(claim_text) > 150 THEN 'error' ELSE 'labeled' END AS judge_status,
CASE WHEN trim(coalesce(span_text, '')) = '' OR length(claim_text) > 150 THEN '' ELSE ([{', '.join(repr(x) for x in J.LABELS)}])[length(claim_text) % 5 + 1] END AS judge_label,
CASE WHEN trim(coalesce(span_text, '')) = '' OR length(claim_text) > 150 THEN 0.0 ELSE 1.0 END AS judge_confidence FROM v WHERE structural_validity = 'valid'""")
def judge_apply(spark, d):
    """Labels of valid citations by a judge that needs a second try at times."""
    items = B.semantic(spark, d).where("structural_validity = 'valid'").select("run_id", "claim_id", "claim_text", F.when(F.col("span_filled"), F.col("span_excerpt")).alias("cited_span_text"))
    return J.apply_judge(items, LengthJudge(), attempts=2).select("run_id", "claim_id", "judge_status", "judge_label", "judge_confidence")


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS ordinal FROM conversations")
def export_ordinal(spark, d):
    return J.with_ordinal(B.read(spark, d, "conversations").select("conv_id", "turn"), ["conv_id", "turn"])


# Records, pages, registries and runs


@query(f"""WITH p AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'), o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ci, role, {B.sents("coalesce(text, '')")} AS s FROM p)
SELECT 'q' || conv_id AS question_id, ci AS context_index, 'q' || conv_id || '_doc_' || ci || '_' || role AS source_doc_id, sha256(array_to_string(s, ' ')) AS source_hash FROM o""")
def process_contexts(spark, d):
    """Turns of conversations as context entries, numbered in each conversation by partitions."""
    turns = B.read(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", F.col("role").alias("title"), T.sentences(F.coalesce("text", F.lit(""))).alias("sentences"))
    entries = J.with_group_ordinal(turns, ["conv_id"], ["turn"], "_n")
    entries = entries.select(F.concat(F.lit("q"), F.col("conv_id").cast("string")).alias("question_id"), F.lit("corpus://conversations").alias("source_uri"), (F.col("_n") - 1).alias("context_index"), "title", "sentences")
    return E.context_rows(entries).select("question_id", F.col("context_index").cast("long").alias("context_index"), "source_doc_id", "source_hash")


@query(f"""WITH c AS (SELECT conv_id, turn, lower({B.norm('role')}) AS title FROM conversations), l AS (SELECT conv_id, title, arg_max('t' || turn, turn) AS source_doc_id FROM c GROUP BY ALL),
f AS (SELECT conv_id, unnest(['user', 'assistant', 'system', 'nobody']) AS title, conv_id % 3 AS sentence_index FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT f.conv_id, f.title, sentence_index, source_doc_id, CASE WHEN source_doc_id IS NOT NULL THEN source_doc_id || '_sent_' || sentence_index END AS sentence_id FROM f LEFT JOIN l USING (conv_id, title)""")
def support_refs_join(spark, d):
    """Facts name a role; of a conversation's turns with this role the last one is meant."""
    turns = B.read(spark, d, "conversations")
    corpus = turns.select(F.col("conv_id").alias("question_id"), F.col("role").alias("title"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("source_doc_id"), F.col("turn").alias("context_index"))
    facts = turns.select(F.col("conv_id").alias("question_id")).distinct().select("question_id", F.explode(F.array(*map(F.lit, ["user", "assistant", "system", "nobody"]))).alias("title"), (F.col("question_id") % 3).alias("sentence_index"))
    return E.support_references(facts, corpus).select(F.col("question_id").alias("conv_id"), "title", "sentence_index", "source_doc_id", "sentence_id")


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<html[^>]*>') AS tag, regexp_extract_all(html, '<a [^>]*>') AS links FROM pages)
SELECT page_id, regexp_extract(tag, 'lang="([^"]*)"', 1) AS lang, CAST(len(links) AS BIGINT) AS n_links, CASE WHEN len(links) > 0 THEN replace(regexp_extract(links[1], 'href="([^"]*)"', 1), '&amp;', '&') END AS first_href FROM t""")
def html_links(spark, d):
    pages = B.read(spark, d, "pages").select("page_id", F.regexp_extract("html", "<html[^>]*>", 0).alias("tag"), F.regexp_extract_all("html", F.lit("(<a [^>]*>)"), F.lit(1)).alias("links"))
    first = F.try_element_at(T.html_attributes(F.try_element_at("links", F.lit(1))), F.lit("href"))
    return pages.select("page_id", F.coalesce(F.try_element_at(T.html_attributes(F.col("tag")), F.lit("lang")), F.lit("")).alias("lang"), F.size("links").cast("long").alias("n_links"), first.alias("first_href"))


def _registry(spark, d):
    """A snapshot record for each source; which fields are unset follows from its size and number."""
    docs = B.read(spark, d, "documents")
    rows = docs.groupBy(F.col("source").alias("dataset_id")).agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))
    rows = rows.withColumn("n", F.col("n") + F.substring("dataset_id", 4, 9).cast("long"))
    n = F.col("n")
    return rows.select(
        "dataset_id", "n", F.lit("public").alias("license_note"), F.concat("dataset_id", F.lit("_v1")).alias("source_snapshot_id"), F.when(n % 4 == 0, F.concat(F.lit("a/../"), "dataset_id")).otherwise(F.concat(F.lit("data/"), "dataset_id")).alias("dataset_path"),
        F.when(n % 3 == 0, F.lit(" Unset ")).otherwise(T.sha256(F.col("dataset_id"))).alias("raw_data_hash"), F.when(n % 5 == 0, F.lit(None)).otherwise(T.sha256(n.cast("string"))).alias("processed_corpus_hash"), T.sha256(F.col("langs").cast("string")).alias("split_hash"),
        F.lit("build").alias("build_command_record"), F.when(n % 2 == 0, F.lit("")).otherwise(F.lit("index")).alias("retrieval_index_path"), F.when(n % 7 == 0, F.lit("lost")).when(n % 2 == 0, F.lit("pending")).otherwise(F.lit("ready")).alias("status"), F.when(n > 1000, F.lit("huge")).otherwise(F.lit("small")).alias("storage_class"),
    )


_REG = "g AS (SELECT source AS dataset_id, count(*) + CAST(substr(source, 4) AS BIGINT) AS n FROM documents GROUP BY source)"


@query(f"""WITH {_REG} SELECT dataset_id, 'dataset_path' AS field, 'path has unsafe parts' AS message FROM g WHERE n % 4 = 0
UNION ALL SELECT dataset_id, 'raw_data_hash', 'raw_data_hash is not locked' FROM g WHERE n % 3 = 0 UNION ALL SELECT dataset_id, 'processed_corpus_hash', 'processed_corpus_hash is not locked' FROM g WHERE n % 5 = 0
UNION ALL SELECT dataset_id, 'retrieval_index_path', 'retrieval_index_path is not locked' FROM g WHERE n % 2 = 0 UNION ALL SELECT dataset_id, 'status', 'snapshot status is not ready' FROM g WHERE n % 7 = 0 OR n % 2 = 0
UNION ALL SELECT dataset_id, 'status', 'invalid status' FROM g WHERE n % 7 = 0 UNION ALL SELECT dataset_id, 'storage_class', 'invalid storage class' FROM g WHERE n > 1000""")
def registry_blockers(spark, d):
    return R.blockers(_registry(spark, d), R.snapshot_rules(), "dataset_id")


@query(f"""WITH {_REG} SELECT dataset_id, CASE WHEN n % 3 <> 1 THEN 'ready' WHEN n % 7 = 0 THEN 'lost' WHEN n % 2 = 0 THEN 'pending' ELSE 'ready' END AS status,
CASE WHEN n % 3 <> 1 THEN 'idx/' || dataset_id WHEN n % 2 = 0 THEN '' ELSE 'index' END AS retrieval_index_path,
NOT (n % 4 = 0 OR n % 3 = 0 OR n % 5 = 0 OR n > 1000 OR (n % 3 = 1 AND (n % 2 = 0 OR n % 7 = 0))) AS promoted FROM g""")
def registry_promotion(spark, d):
    registry = _registry(spark, d)
    manifests = registry.where("n % 3 <> 1").select("dataset_id", F.concat(F.lit("idx/"), "dataset_id").alias("index_path"), T.sha256(F.col("dataset_id")).alias("index_hash"))
    return R.promotable(registry, manifests).select("dataset_id", "status", "retrieval_index_path", "promoted")


@query("SELECT DISTINCT doc_id, 'unexpected' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def label_set_difference(spark, d):
    return R.set_differences(B.read(spark, d, "labels").select("doc_id"), B.read(spark, d, "documents").select("doc_id"), "doc_id")


@query(f"WITH {B.ANSWERS} SELECT run_id FROM a WHERE NOT (conv_id % 4 = 0)")
def resume_antijoin(spark, d):
    runs = B.answers(spark, d)
    return pending(runs.select("run_id"), runs.where("conv_id % 4 = 0"))


@query(f"WITH {B.ANSWERS} SELECT CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, baseline, count(*) AS n FROM a GROUP BY ALL")
def shard_merge(spark, d):
    from citeforge.sources.readers import tagged_union

    runs = B.answers(spark, d)
    merged = tagged_union({"even__1": runs.where("turn % 2 = 0"), "odd__1": runs.where("turn % 2 <> 0").drop("turn")}, "dataset")
    return merged.groupBy("dataset", "baseline").agg(F.count("*").alias("n"))
