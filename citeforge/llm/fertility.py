"""Quality rules from tokeniser fertility.

Public vocabularies measure each text: characters per token, the share of byte-fallback tokens and
the entropy of its token distribution. A text is rejected where a measure leaves its band. Each
script has fixed, wide limits. Within these, the characters per token have bands that come from
medians and median deviations of all documents, of the text's script and of its language in this
script; as a mean over few tokens varies more, a band narrows with the root of the text's tokens.
The fewer documents a script or a language has, the more its band is that of the level above
(language, script, fixed limits); the blend is smooth, and a text without a language has its
script's band. Simple counts go along.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.llm import shared
from citeforge.llm.textvec import Flat, Words, column, encode, flat_slices, gather
from citeforge.llm.wordcoder import coder, vocabulary_path

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"

#: Bands by script: least and most characters per token (piece vocabulary, then byte
#: vocabulary), most byte-fallback share, least entropy in bits for a text of ``FULL_TOKENS`` or
#: more tokens. Shorter texts need an entropy in proportion to the logarithm of their tokens.
BANDS: dict[str, tuple[float, float, float, float, float, float]] = {
    "latin": (1.2, 8.0, 1.2, 8.0, 0.10, 3.0),
    "cyrillic": (1.0, 8.0, 0.5, 6.0, 0.10, 3.0),
    "cjk": (0.3, 3.0, 0.3, 3.0, 0.60, 3.0),
    "other": (0.2, 10.0, 0.2, 10.0, 0.90, 2.0),
}
FULL_TOKENS = 64
#: A band reaches so many robust deviations; a group of ``PRIOR`` documents weighs as much as the
#: level above it. Medians are exact to one part in ``PARTS`` of an octave.
DEVIATIONS = 10.0
PRIOR = 50.0
PARTS = 256

SCRIPTS = ("other", "latin", "cyrillic", "cjk")
#: Lead bytes of UTF-8 by script: Latin letters, Cyrillic, and kana, Han and Hangul.
_SCRIPT = bytearray(256)
for _c in range(256):
    if _c < 128 and chr(_c).isalpha() or 0xC3 <= _c <= 0xC9:
        _SCRIPT[_c] = 1
    elif 0xD0 <= _c <= 0xD3:
        _SCRIPT[_c] = 2
    elif 0xE3 <= _c <= 0xED:
        _SCRIPT[_c] = 3
    elif 0xCA <= _c < 0xF8:
        _SCRIPT[_c] = 4
_SCRIPT = bytes(_SCRIPT)
_SYMBOL = bytes(chr(c) in "#*$%&|<>" for c in range(256))
_NOT_NEWLINE = bytes(c != 10 for c in range(256))

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, "
    "n_piece_tokens long, n_fallback long, piece_entropy double, n_byte_tokens long"
)


class PieceCoder:
    """SentencePiece ids of words; keeps those of the first ``most`` distinct words."""

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece

        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.known: dict[str, int] = {}
        self.ids, self.at = np.zeros(1 << 20, np.uint16), np.zeros(most + 1, np.int64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words end to end, and the number of each word's."""
        k = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
        fresh = np.flatnonzero(k < 0)
        got = self.model.encode([words[i] for i in fresh], num_threads=1) if len(fresh) else []
        counts = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint16, int(counts.sum()))
        ends, n = np.cumsum(counts), len(self.known)
        kept = min(len(fresh), self.most - n)
        if kept:
            more, first = int(ends[kept - 1]), int(self.at[n])
            if first + more > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), more), np.uint16)])
            self.ids[first : first + more] = flat[:more]
            self.at[n + 1 : n + 1 + kept] = first + ends[:kept]
            self.known.update(zip((words[i] for i in fresh[:kept]), range(n, n + kept), strict=True))
            k[fresh[:kept]] = np.arange(n, n + kept)
        ids, start, length = self.ids, self.at[k], self.at[k + 1] - self.at[k]
        if kept < len(fresh):
            used = int(self.at[len(self.known)])
            ids = np.concatenate([ids[:used], flat])
            start[fresh[kept:]], length[fresh[kept:]] = used + ends[kept:] - counts[kept:], counts[kept:]
        return ids[gather(start, length)], length


@functools.lru_cache(maxsize=1)
def piece_coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal values get equal numbers from 0; the count of numbers."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy(), len(coded.dictionary)


def repeated_words(words: Words, codes: np.ndarray, n_codes: int, width: int = 5) -> np.ndarray:
    """Per row, the words that lie in a window of ``width`` words found twice or more in the row."""
    n = len(words)
    out = np.zeros(words.flat.n, np.int64)
    if n < width:
        return out
    codes = codes.astype(np.int64)
    window, kinds = codes, n_codes
    for k in range(1, width):  # windows of k + 1 words, numbered exactly
        window, kinds = _numbered(window[: n - k] * n_codes + codes[k:])
        window = window.astype(np.int64)
    row = words.rows()
    inside = row[: n - width + 1] == row[width - 1 :]
    at = np.flatnonzero(inside)
    number, kinds = _numbered(window[at] * words.flat.n + row[at])
    again = at[np.bincount(number, minlength=kinds)[number] > 1]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + width, -1)
    np.add.at(out, row[np.cumsum(covered[:-1]) > 0], 1)
    return out


def repeated_lines(flat: Flat, words: Words) -> np.ndarray:
    """Per row, the lines with a word that equal an earlier line."""
    inside = np.frombuffer(flat.data.tobytes().translate(_NOT_NEWLINE), bool)
    starts, ends = flat.runs(inside)
    codes, lines = encode(flat.data[inside], ends - starts)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    row = flat.row_of(starts)[worded]
    number, kinds = _numbered(row * max(1, len(lines)) + codes[worded])
    first = np.zeros(kinds, np.int64)
    first[number] = row
    return np.bincount(row, minlength=flat.n) - np.bincount(first, minlength=flat.n)


def entropy(rows: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of each row's token distribution; 0 without tokens."""
    key = np.sort(rows * np.int64(1 << 20) + ids)
    if not len(key):
        return np.zeros(len(counts))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    c = np.diff(np.append(first, len(key))).astype(float)
    spread = np.bincount(key[first] >> 20, weights=c * np.log2(c), minlength=len(counts))
    n = np.maximum(counts, 1)
    return np.maximum(np.log2(n) - spread / n, 0)


def _per_row(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of word values by row."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[words.at[1:]] - total[words.at[:-1]]


def _measured(pieces: str, bytes_: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, byte_level = piece_coder(vocabulary_path(pieces)), coder(vocabulary_path(bytes_))
        for batch in batches:
            for a, b, flat in flat_slices(column(batch, "text")):
                words = flat.words()
                codes, distinct = words.encode()
                ids, length = model.of(distinct.to_numpy(zero_copy_only=False).tolist())
                begin = np.cumsum(length) - length
                tokens = length[codes] if len(codes) else np.zeros(0, np.int64)
                n_tokens = _per_row(words, tokens)
                fallback = np.concatenate([[0], np.cumsum(model.fallback[ids])])
                n_fallback = (fallback[begin + length] - fallback[begin])[codes] if len(codes) else tokens
                taken = pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids)).take(pa.array(codes)).flatten().to_numpy() if len(codes) else ids
                symbols = np.flatnonzero(np.frombuffer(flat.data.tobytes().translate(_SYMBOL), bool))
                kinds = np.frombuffer(flat.data.tobytes().translate(_SCRIPT), np.uint8)
                shares = np.stack([np.diff(np.searchsorted(np.flatnonzero(kinds == k), flat.offs)) for k in (4, 1, 2, 3)])
                out = {
                    "n_words": words.counts,
                    "word_chars": _per_row(words, flat.code_points(words.starts, words.ends)),
                    "n_symbols": np.diff(np.searchsorted(symbols, flat.offs)),
                    "n_dup_lines": repeated_lines(flat, words),
                    "n_repeat_words": repeated_words(words, codes, len(distinct)),
                    "script": [SCRIPTS[k] for k in shares.argmax(axis=0)],
                    "n_piece_tokens": n_tokens,
                    "n_fallback": _per_row(words, n_fallback),
                    "piece_entropy": entropy(np.repeat(np.arange(flat.n), n_tokens), taken.astype(np.int64), n_tokens),
                    "n_byte_tokens": byte_level.slice_ids(flat)[1],
                }
                rest = [batch.column(i).slice(a, b - a) for i, name in enumerate(batch.schema.names) if name != "text"]
                names = [n for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, out.values())], names=[*names, *out])

    return measure


def measures(docs: DataFrame, pieces: str = PIECES, bytes_: str = BYTES) -> DataFrame:
    """doc_id, lang and all counts and token measures of every whole text; no shuffle.

    A null text is empty: no words, all counts 0. Null ids and repeated rows give a row each.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")
    return rows.mapInArrow(_measured(pieces, bytes_), f"doc_id long, lang string, {MEASURES}")


RATIOS = {"chars_per_piece": "n_piece_tokens", "chars_per_byte_token": "n_byte_tokens"}


def with_figures(measured: DataFrame) -> DataFrame:
    """Add base_failed and the ratios that the bands are about; ratios without tokens are 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    figures = {name: ratio("word_chars", n) for name, n in RATIOS.items()}
    return measured.withColumns({"base_failed": failed, "fallback_share": ratio("n_fallback", "n_piece_tokens"), **figures})


def _medians(rows: DataFrame, value: Column) -> tuple[DataFrame, DataFrame]:
    """(script, lang, m, n) and (script, m, n): medians of ``value`` by language and by script.

    Values are counted in logarithmic classes, some thousand a group at most, so the result does not
    depend on the order of rows, and a language that has most of the rows is no hot key.
    """
    place = F.floor(F.log2(F.greatest(value, F.lit(2.0**-20))) * PARTS)
    counted = shared.materialize(rows.groupBy("script", "lang", place.alias("place")).agg(F.count("*").alias("n")), "classes")

    def median(counts: DataFrame, *keys: str) -> DataFrame:
        every = Window.partitionBy(*keys)
        upto = every.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        half = counts.select(*keys, "place", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("all")).where(2 * F.col("upto") >= F.col("all"))
        return half.groupBy(*keys).agg(F.pow(F.lit(2.0), (F.min("place") + 0.5) / PARTS).alias("m"), F.first("all").cast("double").alias("n"))

    by_script = counted.groupBy("script", "place").agg(F.sum("n").alias("n"))
    return median(counted.where("lang is not null"), "script", "lang"), median(by_script, "script")


def _fixed(scripts: dict | None = None) -> Column:
    """The fixed limits of a row's script, as an array."""
    known = F.create_map(*[x for k, v in (scripts or BANDS).items() for x in (F.lit(k), F.array(*map(F.lit, map(float, v))))])
    return F.coalesce(F.try_element_at(known, "script"), F.try_element_at(known, F.lit("other")))


def language_bands(figures: DataFrame, scripts: dict | None = None) -> DataFrame:
    """(script, lang, band): for each ratio, the middle, the deviation of one token and the slack.

    Rows with a null lang are the scripts' own bands.
    """
    rows = figures.where("not base_failed and n_piece_tokens > 0").select("script", "lang", *RATIOS, *RATIOS.values())
    bands = None
    for k, (r, n_tokens) in enumerate(RATIOS.items()):
        middle, above = (shared.materialize(x, "middles") for x in _medians(rows, F.col(r)))
        spread = lambda m: F.abs(F.col(r) - m) * F.sqrt(F.col(n_tokens))  # noqa: B023, E731
        own, _ = _medians(rows.join(shared.small(middle.withColumnRenamed("m", "mid").drop("n")), ["script", "lang"]), spread(F.col("mid")))
        _, wide = _medians(rows.join(shared.small(above.withColumnRenamed("m", "mid").drop("n")), "script"), spread(F.col("mid")))
        limits = _fixed(scripts)
        low, high = F.element_at(limits, 2 * k + 1), F.element_at(limits, 2 * k + 2)
        w = F.col("n") / (F.col("n") + PRIOR)
        joined = above.join(wide.select("script", (1.4826 * F.col("m")).alias("s")), "script")
        outer = joined.select(
            "script",
            (w * F.col("m") + (1 - w) * (low + high) / 2).alias("middle"),
            (w * F.col("s")).alias("scale"),
            ((1 - w) * (high - low) / 2).alias("slack"),
        )
        inner = middle.join(own.select("script", "lang", (1.4826 * F.col("m")).alias("s")), ["script", "lang"]).join(outer, "script")
        inner = inner.select(
            "script",
            "lang",
            F.struct(
                (w * F.col("m") + (1 - w) * F.col("middle")).alias("middle"),
                (w * F.col("s") + (1 - w) * F.col("scale")).alias("scale"),
                ((1 - w) * (F.col("slack") + F.abs(F.col("m") - F.col("middle")))).alias("slack"),
            ).alias(r),
        )
        table = inner.unionByName(outer.select("script", F.lit(None).cast("string").alias("lang"), F.struct("middle", "scale", "slack").alias(r)))
        table = shared.materialize(table, "bands").withColumn("lang_key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
        bands = table if bands is None else bands.join(table.drop("lang"), ["script", "lang_key"])
    return bands


def judge(figures: DataFrame, bands: DataFrame, scripts: dict | None = None) -> DataFrame:
    """Add kept: false if the base failed, else whether all measures lie in their bands."""
    limits = _fixed(scripts)
    bands = shared.small(shared.materialize(bands.select("script", "lang_key", *[F.col(r).alias(f"{r}_band") for r in RATIOS]), "bands"))
    rows = figures.withColumn("lang_key", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).join(bands, ["script", "lang_key"], "left").withColumn("limits", limits)
    at = lambda k: F.element_at(F.col("limits"), k)
    short = F.least(F.lit(1.0), F.log2(F.greatest(F.col("n_piece_tokens"), F.lit(1))) / F.log2(F.lit(float(FULL_TOKENS))))
    good = (F.col("fallback_share") <= at(5)) & (F.col("piece_entropy") >= at(6) * short)
    for i, (r, n_tokens) in enumerate(RATIOS.items()):
        b = F.col(f"{r}_band")
        reach = DEVIATIONS * b["scale"] / F.sqrt(F.greatest(F.col(n_tokens), F.lit(1))) + b["slack"]
        good = good & F.col(r).between(at(2 * i + 1), at(2 * i + 2)) & F.coalesce(F.abs(F.col(r) - b["middle"]) <= reach, F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & good).drop("limits", "lang_key", *[f"{r}_band" for r in RATIOS])


def judge_documents(docs: DataFrame, pieces: str = PIECES, bytes_: str = BYTES) -> DataFrame:
    """Measure all documents, take the bands from them, and judge each one.

    The measures, a few numbers a document, are written once and read for the bands and verdicts. A
    null or empty text has no words, so its base fails; a very long one is measured whole. Repeated
    rows are judged alike, null ids and languages included, and count as often as they come. Columns
    of any other names are not read. An empty table gives an empty one.
    """
    figures = with_figures(shared.materialize(measures(docs, pieces, bytes_), "measures"))
    return judge(figures, language_bands(figures))


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge all documents."""
    out = judge_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*counts, "chars_per_piece", "chars_per_byte_token", "fallback_share", "piece_entropy")
