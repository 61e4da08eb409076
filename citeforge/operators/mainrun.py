"""The composed run: planned runs with their evidence become requests, answers and checked records.

A run's evidence is at most ``top_k`` items and its answer a few claims, so all that concerns one run
stays in its row: the request, the answer, each citation's validation and each verdict are worked
out on arrays, without a join or a shuffle a step.

Runs go in batches of the plan's order. A batch is written under a name of its own and becomes part
of the run by one small file, its commit, which is made whole or not at all and only once. The
commit has the totals up to it, so cost and errors carry over; a run that starts again goes on after
the last commit, and what an unfinished batch had written is never read.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citeforge.functions import text as T
from citeforge.operators import attribution as A
from citeforge.operators import runs as U
from citeforge.operators.judging import settled
from citeforge.operators.sizing import small
from citeforge.sources.folders import put_once, read_text

#: What each baseline is told about citations, by the part of its name after the data set.
POLICIES = {
    "vanilla": "Answer from the evidence below. Cite where a source is clear.",
    "hybrid": "Answer directly from the evidence below. Citations may be left out; no check follows.",
    "citation_only": "Give at least one evidence id for every factual claim, and only ids listed below.",
    "validator_only": "Answer from the evidence below. Cite evidence ids where you can; a validator checks them afterwards.",
    "ledger_only": "Give at least one ledger span id for every factual claim. Span ids equal evidence ids; never cite titles, ranks or invented ids.",
    "ledger_validator": "Give at least one ledger span id for every factual claim. Span ids equal evidence ids; never cite titles, ranks or invented ids. A validator checks them afterwards.",
}
RULES = (
    "Copy every cited_evidence_id exactly from valid_evidence_ids; do not shorten, translate or number them. "
    "Return JSON only, with the keys global_answer, atomic_claims (claim_id, text), citations (claim_id, cited_evidence_id), refusal and refusal_reason. "
    "Where the evidence does not suffice, set refusal to true."
)


# Evidence and requests


def enrich(ranked: DataFrame, spans: DataFrame, key: str = "source_doc_id") -> DataFrame:
    """(question_id, evidence): each question's ranked items with texts, ids and pointers, by rank.

    ``ranked`` has question_id, key, score and rank, at most top_k rows a question; ``spans`` has the
    key, title, text and the parts of a pointer. Spans that nothing names are dropped where they are read.
    """
    best = settled(ranked.select("question_id", key, "score", "rank"))
    named = spans.join(small(best.select(key).distinct()), key, "left_semi")
    text = F.coalesce("text", F.lit(""))
    item = F.struct(
        F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.col(key).alias("evidence_id"), F.col(key).alias("ledger_span_id"),
        *[F.col(p) for p in A.PARTS], A.pointer(*[F.col(p) for p in A.PARTS]).alias("citation_id"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"), A.meaning(text).alias("meaning"),
    )
    return best.join(named, key).groupBy("question_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))


def with_request(rows: DataFrame, prompt_version: str = "v1") -> DataFrame:
    """Add ``system`` and ``request`` for rows with baseline, question_text and evidence, and what records keep of them.

    The evidence's texts are in the request from here on, and leave the evidence.
    """
    policy = F.element_at(F.create_map(*[F.lit(x) for kv in POLICIES.items() for x in kv]), F.col("baseline"))
    system = F.concat(F.lit("baseline="), "baseline", F.lit(f". prompt_version={prompt_version}. "), policy, F.lit(" " + RULES))
    ids = lambda name: F.to_json(F.transform("evidence", lambda e: e[name]))
    line = lambda e: F.concat(F.lit("- evidence_id="), e["evidence_id"], F.lit(" ledger_span_id="), e["ledger_span_id"], F.lit(" citation_id="), e["citation_id"], F.lit(" title="), e["title"], F.lit(" text="), e["text"])
    user = F.concat(F.lit("Question:\n"), "question_text", F.lit("\n\nvalid_evidence_ids:\n"), ids("evidence_id"), F.lit("\n\nvalid_citation_ids:\n"), ids("citation_id"), F.lit("\n\nEvidence:\n"), F.array_join(F.transform("evidence", line), "\n"))
    asked = rows.withColumn("system", system).withColumn("request", user)
    asked = asked.withColumns({"request_sha256": T.sha256(F.concat("system", F.lit("\n"), "request")), "request_length": F.length("request").cast("long")})
    return asked.withColumn("evidence", F.transform("evidence", lambda e: e.dropFields("title", "text")))


Generator = Callable[[dict], dict]


def with_answers(rows: DataFrame, generate: Generator, attempts: int = 3, wait: float = 1.0, seen: tuple = ("run_id", "baseline", "question_id", "question_text", "system", "request")) -> DataFrame:
    """Call ``generate`` for each row in the tasks, with the columns ``seen``.

    It returns content, prompt_tokens and completion_tokens. The request's texts go no further. A call that fails is tried again after
    ``wait`` seconds, twice as long each time; one that still fails gives its row the error.
    """

    def call(row: dict) -> tuple:
        error = ""
        for k in range(attempts):
            try:
                got = generate(row)
                return got.get("content"), int(got.get("prompt_tokens") or 0), int(got.get("completion_tokens") or 0), k + 1, None
            except Exception as e:  # any failure of a remote model is a row's status
                error = str(e)
                if k + 1 < attempts:
                    time.sleep(wait * 2**k)
        return None, 0, 0, attempts, error

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [call(row) for row in batch.select(list(seen)).to_pylist()]
            more = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in kept], *more], names=[*kept, "content", "prompt_tokens", "completion_tokens", "attempts", "error"])

    kept = [n for n in rows.columns if n not in ("system", "request")]
    schema = StructType([f for f in rows.schema.fields if f.name in kept])
    for name, kind in (("content", "string"), ("prompt_tokens", "long"), ("completion_tokens", "long"), ("attempts", "integer"), ("error", "string")):
        schema.add(name, kind)
    return rows.mapInArrow(answer, schema)


# Records


def checked(citations: Column, evidence: Column, claims: Column) -> Column:
    """Citations with their pointer, the validator's status and the verdict on their claim, from the run's own evidence.

    Each step adds fields to the structs of the one before, so that no expression repeats another.
    """
    names: list[str] = []

    def step(array: Column, fields: Callable[[Column], dict[str, Column]]) -> Column:
        added: list[str] = []

        def grow(x: Column) -> Column:
            new = fields(x)
            added[:] = new
            return F.struct(*[x[n].alias(n) for n in names], *[c.alias(n) for n, c in new.items()])

        out = F.transform(array, grow)
        names.extend(added)
        return out

    def known(p: Column, *parts: str) -> Column:
        def same(e: Column) -> Column:
            out = F.lit(True)
            for n in parts:
                out = out & (e[n] == p[n])
            return out

        return F.coalesce(F.exists(evidence, same), F.lit(False))

    last = lambda array: F.try_element_at(array, F.lit(-1))
    found = step(citations, lambda c: {"claim_id": F.coalesce(c["claim_id"], F.lit("")), "raw_citation_id": T.first_of(c["cited_evidence_id"], c["evidence_id"])})
    found = step(found, lambda x: {"cited": T.citation_id(F.coalesce(x["raw_citation_id"], F.lit("")))})
    # An older id stands for the last item that has it.
    found = step(found, lambda x: {"citation_id": F.coalesce(last(F.filter(evidence, lambda e: (e["evidence_id"] == x["cited"]) | (e["ledger_span_id"] == x["cited"])))["citation_id"], x["cited"])})
    found = step(found, lambda x: {"p": A.parsed(x["citation_id"]), "item": last(F.filter(evidence, lambda e: e["citation_id"] == x["citation_id"]))})
    levels = (("dataset_id", "source_id"), ("dataset_id", "source_id", "span_id"), ("dataset_id", "source_id", "span_id", "snapshot_hash"), A.PARTS)
    found = step(found, lambda x: {"validator_status": A.status(x["p"].isNotNull(), *[known(x["p"], *n) for n in levels], x["item"].isNotNull(), F.lit(None).cast("string"))})
    found = step(found, lambda x: {"kept": x["validator_status"] == "valid_citation", "c": A.meaning(last(F.filter(claims, lambda c: c["claim_id"] == x["claim_id"]))["claim_text"]), "s": x["item"]["meaning"]})
    found = step(found, lambda x: {"v": F.when(x["kept"], A.verdict(x["c"], x["s"]))})
    kept = ("claim_id", "raw_citation_id", "citation_id", "validator_status", "kept")
    return F.transform(found, lambda x: F.struct(*[x[n].alias(n) for n in kept], x["v"]["verdict"].alias("verdict"), x["v"]["confidence"].alias("confidence")))


def records(answered: DataFrame) -> DataFrame:
    """One row for each run: its status, answer, claims, checked citations, tokens and cost.

    The status is ok, provider_error or json_parse_error; a failed run has neither claims nor citations.
    """
    parsed = U.parse_answers(answered)
    status = F.when(F.col("error").isNotNull(), "provider_error").when(F.col("answer_status") != "ok", "json_parse_error").otherwise("ok")
    order = lambda c, i: F.struct(F.coalesce(T.truthy(c["claim_id"]), F.concat(F.lit("c"), (i + 1).cast("string"))).alias("claim_id"), T.first_of(c["text"], c["claim_text"]).alias("claim_text"))
    none = F.array().cast("array<struct<claim_id:string,claim_text:string>>")
    rows = parsed.withColumn("status", status).withColumn("claims", F.coalesce(F.transform("answer.atomic_claims", order), none))
    rows = rows.withColumn("checked", checked(F.col("answer.citations"), F.col("evidence"), F.col("claims")))
    rows = rows.withColumn("citations", F.coalesce("checked", F.array().cast(rows.schema["checked"].dataType)))
    uncited = F.size(F.array_except(F.transform("claims", lambda c: c["claim_id"]), F.transform(F.filter("citations", lambda c: c["kept"]), lambda c: c["claim_id"])))
    ok = F.col("status") == "ok"
    return rows.select(
        "plan_order", "run_id", "dataset_id", "question_id", "baseline", "status", "request_sha256", "request_length", "attempts", "error",
        F.transform("evidence", lambda e: e["evidence_id"]).alias("evidence_ids"), F.when(ok, F.col("answer.global_answer")).alias("global_answer"), F.when(ok, U.refusal_label(F.coalesce("answer.refusal", F.lit(False)))).alias("refusal_label"), "claims", "citations",
        F.size(F.filter("citations", lambda c: c["kept"])).cast("long").alias("valid_citation_count"), F.size(F.filter("citations", lambda c: ~c["kept"])).cast("long").alias("invalid_citation_count"),
        uncited.cast("long").alias("uncited_claim_count"), "prompt_tokens", "completion_tokens", T.cost_usd(F.col("prompt_tokens"), F.col("completion_tokens")).alias("estimated_cost_usd"),
    )


# Batches and commits


@dataclass(frozen=True)
class Totals:
    """What a run has up to a commit."""

    batches: int = 0
    runs: int = 0
    success_count: int = 0
    provider_errors: int = 0
    json_errors: int = 0
    prompt_tokens: int = 0
    completion_tokens: int = 0
    stopped: bool = False


class RunFolder:
    """A run's batches and their commits in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[dict]:
        """The commits in their order; a gap ends them."""
        out: list[dict] = []
        while text := read_text(self.spark, f"{self.folder}/commits/{len(out):09d}.json"):
            out.append(json.loads(text))
        return out

    def new_attempt(self, batch: int) -> str:
        return f"{self.folder}/records/{batch:09d}-{uuid.uuid4().hex}"

    def commit(self, batch: int, attempt: str, totals: Totals) -> bool:
        """Make a written batch part of the run; False where another one has been already."""
        return put_once(self.spark, f"{self.folder}/commits/{batch:09d}.json", json.dumps({"attempt": attempt, "totals": asdict(totals)}))

    def read(self) -> DataFrame | None:
        """All committed records, with their batch; None before the first commit."""
        found = [(k, c["attempt"]) for k, c in enumerate(self.commits())]
        if not found:
            return None
        table = self.spark.read.parquet(*[path for _, path in found])
        return table.withColumn("batch", F.regexp_extract(F.input_file_name(), r"/records/(\d+)-[0-9a-f]+/", 1).cast("int"))


def until_failures(rows: DataFrame, most: int | None, before: Totals) -> tuple[DataFrame, bool]:
    """A batch's rows up to the failure that is one too many of its kind, counted from the run's start, and
    whether there is one. Kinds are few and counted over the batch; only then are rows cut."""
    if most is None:
        return rows, False
    kinds = {"provider_error": before.provider_errors, "json_parse_error": before.json_errors}
    end = None
    for kind, n in kinds.items():
        # The failure number most + 1 of the kind, if the batch gets there: at most most + 1 rows reach the driver.
        failed = rows.where(F.col("status") == kind).select("plan_order").orderBy("plan_order").limit(most - n + 1).collect()
        if len(failed) == most - n + 1:
            end = min(end, failed[-1][0]) if end is not None else failed[-1][0]
    return (rows, False) if end is None else (rows.where(F.col("plan_order") <= end), True)


def run_batches(plan: DataFrame, evidence: DataFrame, generate: Generator, folder: str, batch_size: int, most_errors: int | None = 2, attempts: int = 3, wait: float = 1.0, finished: DataFrame | None = None) -> Totals:
    """Work through ``plan`` (plan_order, run_id, dataset_id, question_id, question_text, baseline) in
    batches of ``batch_size`` of its order, each committed before the next begins.

    Starts after the last commit in ``folder``. Runs in ``finished`` (run_id) are left out. More than
    ``most_errors`` failures of one kind end the run, the row of the last one included.
    """
    spark = plan.sparkSession
    place = RunFolder(spark, folder)
    done = place.commits()
    totals = Totals(**done[-1]["totals"]) if done else Totals()
    plan = settled(plan if finished is None else plan.join(finished.select("run_id").distinct(), "run_id", "left_anti"))
    last = plan.agg(F.max("plan_order")).first()[0] or 0
    none = F.array().cast(evidence.schema["evidence"].dataType)
    for batch in range(totals.batches, -(-last // batch_size)):
        if totals.stopped:
            break
        rows = plan.where((F.col("plan_order") > batch * batch_size) & (F.col("plan_order") <= (batch + 1) * batch_size))
        rows = rows.join(evidence, "question_id", "left").withColumn("evidence", F.coalesce("evidence", none))
        attempt = place.new_attempt(batch)
        # Calls are made once: what they gave is written before anything is counted.
        made = settled(records(with_answers(with_request(rows), generate, attempts, wait)))
        kept, stopped = until_failures(made, most_errors, totals)
        kept.write.parquet(attempt)
        status = lambda s: F.count_if(F.col("status") == s)
        got = spark.read.parquet(attempt).agg(F.count("*"), status("ok"), status("provider_error"), status("json_parse_error"), F.sum("prompt_tokens"), F.sum("completion_tokens")).first()
        sums = [a + (b or 0) for a, b in zip((totals.runs, totals.success_count, totals.provider_errors, totals.json_errors, totals.prompt_tokens, totals.completion_tokens), got, strict=True)]
        after = Totals(batch + 1, *sums, stopped)
        totals = after if place.commit(batch, attempt, after) else Totals(**place.commits()[batch]["totals"])
    return totals
