"""Citation pointers, their validation, and claim-to-span support."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeforge.functions import text as T
from citeforge.operators.judging import settled

# The parts of a pointer in their order, and label and status names.
PARTS = ["dataset_id", "source_id", "snapshot_hash", "span_id", "span_hash"]

UNSUPPORTED = ["unsupported", "contradictory", "insufficient_evidence"]
PARTIAL = ["partially_supported", "overclaim"]
LEGACY_KEYS = ["evidence_id", "ledger_span_id"]


def pointer(*parts: Column) -> Column:
    """dataset/source/snapshot/span/hash; a null part is empty, which makes the pointer malformed."""
    return F.concat_ws("/", *[F.coalesce(p, F.lit("")) for p in parts])


def parsed(c: Column) -> Column:
    """The five parts as a struct; null unless there are exactly five and none is empty."""
    parts = F.split(F.coalesce(c, F.lit("")), "/", -1)
    good = (F.size(parts) == len(PARTS)) & ~F.array_contains(parts, "")
    return F.when(good, F.struct(*[parts[k].alias(n) for k, n in enumerate(PARTS)]))


def resolve_legacy(citations: DataFrame, evidence: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Replace older ids in cited_id by pointers; unknown ids stay.

    ``evidence`` has run_id, position, citation_id and the legacy key columns; the last item that
    uses a key wins, and within an item the later key.
    """
    keys = keys or LEGACY_KEYS
    entries = F.array(*[F.struct(F.lit(i).alias("k"), F.col(k).alias("legacy_id")) for i, k in enumerate(keys)])
    pairs = evidence.select("run_id", "position", "citation_id", F.explode(entries).alias("e")).where(T.truthy(F.col("e.legacy_id")).isNotNull())
    known = pairs.groupBy("run_id", F.col("e.legacy_id").alias("cited_id")).agg(F.max_by("citation_id", F.struct("position", "e.k")).alias("pointer_id"))
    return citations.join(known, ["run_id", "cited_id"], "left").withColumn("citation_id", F.coalesce("pointer_id", "cited_id")).drop("pointer_id")


#: What each level of a pointer is looked up by; the last of them is the whole pointer.
LEVELS = {
    "_source": ["dataset_id", "source_id"],
    "_span": ["dataset_id", "source_id", "span_id"],
    "_snapshot": ["dataset_id", "source_id", "span_id", "snapshot_hash"],
    "_hash": ["dataset_id", "source_id", "span_id", "snapshot_hash", "span_hash"],
}


def _keys(parts: dict[str, Column]) -> Column:
    """(level, key) of each level; null where a part is. No part of a parsed pointer has a slash, so
    a key has as many slashes as its level only if it is made of such parts."""
    joined = lambda names: F.concat(*[x for n in names for x in (F.lit("/"), parts[n])])
    return F.array(*[F.struct(F.lit(level).alias("level"), joined(names).alias("key")) for level, names in LEVELS.items()])


def status(formed: Column, source: Column, span: Column, snapshot: Column, whole: Column, retrieved: Column, label: Column) -> Column:
    """A citation's status from what is known of its pointer and its label; the first rule that applies decides."""
    return (
        F.when(~formed, "malformed_citation_id")
        .when(~source | ~span, "nonexistent_citation_id")
        .when(~snapshot, "wrong_snapshot_hash")
        .when(~whole, "wrong_span_hash")
        .when(~retrieved, "citation_id_not_in_retrieved_evidence")
        .when(label.isin(UNSUPPORTED), "structurally_valid_but_semantically_unsupported_citation")
        .when(label.isin(PARTIAL), "overclaim_partially_supported_claim")
        .otherwise("valid_citation")
    )


def validate(citations: DataFrame, ledger: DataFrame, retrieved: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Add the status of each citation and everything that follows from it.

    ``citations`` has citation_id and the scope columns; ``ledger`` the scope columns, dataset_id,
    source_id, snapshot_hash, span_id and span_hash; ``retrieved`` the scope columns and
    citation_id. An optional column semantic_label refines valid citations. The first rule that
    applies decides: form, source, span, snapshot, hash, retrieval, label.

    A status depends on the scope and the cited id alone, so distinct ids are looked up: their keys
    at all levels in one join with the ledger's distinct keys and the retrieved ids. Each table is
    read once; the citations are written once and joined with their ids' flags.
    """
    scope = scope or []
    label = F.col("semantic_label") if "semantic_label" in citations.columns else F.lit(None).cast("string")
    rows = settled(citations)
    ids = rows.select(*scope, "citation_id").distinct().withColumn("_p", parsed(F.col("citation_id")))
    own = lambda level: F.array(F.struct(F.lit(level).alias("level"), F.col("citation_id").alias("key")))
    asked = ids.where("_p is not null").select(*scope, "citation_id", F.explode(F.concat(_keys({n: F.col(f"_p.{n}") for n in PARTS}), own("_retrieved"))).alias("k"))
    known = ledger.select(*scope, F.explode(_keys({n: F.col(n) for n in PARTS})).alias("k")).union(retrieved.select(*scope, F.explode(own("_retrieved")).alias("k")))
    known = known.select(*scope, "k.level", "k.key").where("key is not null").distinct()
    flags = [*LEVELS, "_retrieved"]
    met = asked.select(*scope, "citation_id", "k.level", "k.key").join(known, [*scope, "level", "key"])
    met = met.groupBy(*scope, "citation_id").agg(*[F.max(F.col("level") == f).alias(f) for f in flags])
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.join(met, [*scope, "citation_id"], "left")
    found = status(parsed(F.col("citation_id")).isNotNull(), *[has(f) for f in flags], label)
    rows = rows.withColumns({"validator_status": found, "source_exists": has("_source")}).drop(*flags)
    return with_flags(rows, label)


def with_flags(rows: DataFrame, label: Column) -> DataFrame:
    """What the validator's status says of validity and replay."""
    s = F.col("validator_status")
    lost = ["malformed_citation_id", "nonexistent_citation_id", "wrong_snapshot_hash"]
    invalid = [*lost, "wrong_span_hash", "citation_id_not_in_retrieved_evidence"]
    return rows.withColumns(
        {
            "structural_validity": F.when(s.isin(invalid), "invalid").otherwise("valid"),
            "validation_error": F.when(s == "citation_id_not_in_retrieved_evidence", "not_in_retrieved_evidence").when(s.isin(invalid), s).otherwise("none"),
            "snapshot_replay_success": ~s.isin(lost),
            "span_replay_success": ~s.isin([*lost, "wrong_span_hash"]),
            "in_retrieved_evidence": ~s.isin(invalid),
            "semantic_support": F.coalesce(label, F.lit("pending")),
        }
    )


def meaning(c: Column) -> Column:
    """A text's distinct tokens without the stop words of the support test."""
    return F.array_distinct(T.tokens(F.coalesce(c, F.lit("")), T.SEMANTIC_STOPWORDS))


def verdict(c: Column, s: Column) -> Column:
    """Struct of verdict and confidence from a claim's and a span's ``meaning``.

    These are columns of their own by then: each text is tokenised once, where it is read.
    """
    negations = F.array(*map(F.lit, T.NEGATIONS))
    shared = F.array_intersect(c, s)
    ratio = F.coalesce(F.try_divide(F.size(shared).cast("double"), F.size(c).cast("double")), F.lit(0.0))
    against = (F.arrays_overlap(c, negations) != F.arrays_overlap(s, negations)) & (F.size(F.array_except(shared, negations)) > 0) & (ratio >= 0.5)
    name = (
        F.when((F.size(c) == 0) | (F.size(s) == 0), "insufficient_evidence")
        .when(against, "contradictory")
        .when(F.size(shared) == F.size(c), "entailed")
        .when(ratio >= 0.65, "partially_supported")
        .otherwise("unsupported")
    )
    sure = F.when(name == "entailed", F.lit(1.0)).when(name == "insufficient_evidence", F.lit(0.0)).otherwise(F.bround(ratio, 6))
    return F.struct(name.alias("verdict"), sure.alias("confidence"))


def span_facts(spans: DataFrame, *keys: str) -> DataFrame:
    """What judging needs of each span (keys..., span_text): its meaning, excerpt and hash.

    A span is read and tokenised once, however many citations it has, and its text stays where it is.
    """
    text = F.col("span_text")
    return spans.select(*keys, meaning(text).alias("span_meaning"), T.excerpt(text).alias("span_excerpt"), T.sha256(F.coalesce(text, F.lit(""))).alias("span_sha256"), text.isNotNull().alias("span_found"), (F.trim(F.coalesce(text, F.lit(""))) != "").alias("span_filled"))


Evaluator = Callable[[Column, Column], Column]


def semantic_records(validations: DataFrame, evaluate: Evaluator = verdict) -> DataFrame:
    """Verdicts of structurally valid citations; others are skipped, those without a span errors.

    ``validations`` has claim_text and the columns of ``span_facts`` next to the validator's.
    ``evaluate`` takes the two meanings and gives a struct of verdict and confidence.
    """
    judged = F.col("structural_validity") == "valid"
    found = F.coalesce("span_found", F.lit(False))
    status = F.when(~judged, "skipped").when(~found, "error").otherwise("evaluated")
    rows = validations.withColumn("semantic_status", status).withColumn("claim_meaning", F.when(judged & found, meaning(F.col("claim_text"))))
    rows = rows.withColumn("_v", F.when(F.col("claim_meaning").isNotNull(), evaluate(F.col("claim_meaning"), F.col("span_meaning"))))
    rows = rows.withColumn("verdict", F.col("_v.verdict")).withColumn("confidence", F.col("_v.confidence"))
    rows = rows.withColumn("claim_excerpt", T.excerpt(F.col("claim_text"))).withColumn("span_excerpt", F.coalesce("span_excerpt", F.lit("")))
    return rows.drop("_v", "claim_meaning", "span_meaning")


def labelled(citations: DataFrame, labels: DataFrame, *keys: str) -> DataFrame:
    """Citations with semantic_label from judged rows (keys..., judge_label, order); the last one wins."""
    last = labels.groupBy(*keys).agg(F.max_by("judge_label", "order").alias("semantic_label"))
    return citations.join(last, list(keys), "left")


def sanitise(citations: DataFrame, evidence: DataFrame, ledger: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cited ids without quotes, resolved from older ids and validated; ``kept`` are the valid ones.

    ``citations`` has run_id and cited_id; dropped ones keep their validation_error as the reason.
    """
    cleaned = citations.withColumn("cited_id", T.citation_id(F.coalesce("cited_id", F.lit(""))))
    checked = validate(resolve_legacy(cleaned, evidence), ledger, retrieved)
    return checked.withColumn("kept", F.col("structural_validity") == "valid")


def diagnostics(checked: DataFrame, claims: DataFrame) -> DataFrame:
    """Per run: claims, kept and dropped citations, and claims that no kept citation names.

    ``checked`` comes from ``sanitise``; ``claims`` has run_id and claim_id.
    """
    named = checked.where("kept").select("run_id", "claim_id").distinct().withColumn("_named", F.lit(1))
    by_claim = claims.select("run_id", "claim_id").distinct().join(named, ["run_id", "claim_id"], "left").groupBy("run_id").agg(F.count("*").alias("claim_count"), (F.count("*") - F.count("_named")).alias("uncited_claim_count"))
    by_citation = checked.groupBy("run_id").agg(F.count_if("kept").alias("kept_count"), F.count_if(~F.col("kept")).alias("dropped_count"))
    return by_claim.join(by_citation, "run_id", "left").fillna(0, ["kept_count", "dropped_count"])
