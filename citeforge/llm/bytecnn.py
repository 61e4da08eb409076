"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows, each is max-pooled,
and a softmax over the pooled filters gives the language. The network is trained here, in numpy, on
windows of a bounded sample of labelled documents. Every whole text is cut into windows that
overlap by one filter less a byte, batches of windows are scored by one matrix product, and a
text's probabilities are the means over its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeforge.llm.textvec import column, flat_slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8

#: Bounds of the training sample: documents (as many of each language as there are, or an equal
#: share; those first by their id's hash) and windows of each.
SAMPLE_DOCS = 3000
SAMPLE_WINDOWS = 3

UNKNOWN = "und"
_LETTER = bytes(c < 128 and chr(c).isalpha() for c in range(256))


class Network:
    """Weights; float32 throughout."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.span = max(WIDTHS)
        k = len(WIDTHS) * FILTERS
        self.w = {
            "embed": rng.normal(0, 0.5, (256, EMBEDDING)),
            "conv": rng.normal(0, 0.3, (self.span, EMBEDDING, k)),
            "bias": np.zeros(k),
            "out": rng.normal(0, 0.3, (k, len(languages))),
            "prior": np.zeros(len(languages)),
        }
        #: A filter of width n reads the first n places of the widest one.
        self.mask = np.zeros((self.span, 1, k))
        for i, width in enumerate(WIDTHS):
            self.mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        self.w["conv"] *= self.mask
        self.w["embed"][0] = 0
        self.w = {n: x.astype(np.float32) for n, x in self.w.items()}

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Convolved and max-pooled windows, the responses, and the embedded windows."""
        x = self.w["embed"][windows]
        n, places = len(windows), WINDOW - self.span + 1
        rows = np.lib.stride_tricks.sliding_window_view(x.reshape(n, -1), self.span * EMBEDDING, axis=1)[:, ::EMBEDDING]
        flat = rows.reshape(n * places, -1)
        response = (flat @ self.w["conv"].reshape(-1, flat.shape[1] and self.w["bias"].size)).reshape(n, places, -1)
        return response.max(1) + self.w["bias"], response, x

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.w["out"] + self.w["prior"]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return _softmax(self.logits(self.pooled(windows)[0]))

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004) -> None:
        """Adam on the class-balanced cross entropy."""
        rng = np.random.default_rng(11)
        balance = len(labels) / np.maximum(1, np.bincount(labels, minlength=len(self.languages))) / len(self.languages)
        first = {n: np.zeros_like(x) for n, x in self.w.items()}
        second = {n: np.zeros_like(x) for n, x in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), batch):
                at = order[a : a + batch]
                step += 1
                for name, g in self._gradients(windows[at], labels[at], balance[labels[at]]).items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.001 * (g * g - second[name])
                    unbiased = first[name] / (1 - 0.9**step)
                    self.w[name] -= (rate * unbiased / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pooled, response, x = self.pooled(windows)
        n = len(windows)
        error = _softmax(self.logits(pooled))
        error[np.arange(n), labels] -= 1
        error *= (weight / n)[:, None]
        active = np.maximum(pooled, 0)
        down = (error @ self.w["out"].T) * (pooled > 0)
        place = response.argmax(1)  # each filter learns from the place of its maximum only
        conv, embed = np.zeros_like(self.w["conv"]), np.zeros_like(self.w["embed"])
        row = np.arange(n)[:, None]
        for j in range(self.span):
            conv[j] = np.einsum("nke,nk->ek", x[row, place + j], down)
            np.add.at(embed, windows[row, place + j], down[:, :, None] * self.w["conv"][j].T[None])
        embed[0] = 0
        return {"embed": embed, "conv": conv * self.mask, "bias": down.sum(0), "out": active.T @ error, "prior": error.sum(0)}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def crc_remainder(doc_id, n: int):
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shares(counts: list[int], most: int) -> list[int]:
    """How many of each group a sample of ``most`` takes: all of small groups, equal parts of others."""
    out, left = [0] * len(counts), most
    order = sorted(range(len(counts)), key=lambda i: (counts[i], i))
    for k, i in enumerate(order):
        out[i] = min(counts[i], left // (len(order) - k))
        left -= out[i]
    return out


def sample_ids(rows: DataFrame, most: int) -> list[int]:
    """Up to ``most`` doc_ids, stratified by language, each language's by the smallest hashes.

    A bound on the hash, from the language's number of rows, keeps what is ranked small; it lets
    about four times as many ids pass as are asked for, so repeated ids leave enough.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    asked = [(r["lang"], k, min(1.0, 4 * k / r["n"])) for r, k in zip(counts, shares([r["n"] for r in counts], most), strict=True) if k]
    if not asked:
        return []
    quota = F.broadcast(rows.sparkSession.createDataFrame(asked, "lang string, quota long, share double"))  # at most ``most`` rows
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    some = rows.select("lang", "doc_id", h.alias("h")).join(quota, "lang").where(F.col("h") <= F.col("share") * float(1 << 63)).distinct()
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where("rank <= quota")
    return sorted({r[0] for r in first.select("doc_id").collect()})


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows_each: int = SAMPLE_WINDOWS) -> Network | None:
    """A network from labelled rows of ``docs`` (doc_id, text, lang); None without any.

    Two steps keep the sample small on its way to the driver: ids first, then short pieces of their
    texts, from places set by the id's hash. Of several texts of one id and language one is taken,
    the same one each time, so that the network is the same for the same rows.
    """
    rows = docs.where("text is not null and lang is not null and doc_id is not null").withColumn("lang", F.col("lang").cast("string"))
    ids = sample_ids(rows, sample_docs)
    if not ids:
        return None
    place = lambda k: 1 + F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - WINDOW, F.lit(1)))
    cut = F.array(*[F.substring("text", place(k).cast("int"), F.lit(WINDOW)) for k in range(windows_each)])
    picked = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(F.min(cut).alias("pieces"))
    sample = sorted((r["doc_id"], r["lang"], piece) for r in picked.collect() for piece in r["pieces"])
    languages = sorted({lang for _, lang, piece in sample if piece})
    number = {x: i for i, x in enumerate(languages)}
    kept = [(number[lang], piece.encode()[:WINDOW]) for _, lang, piece in sample if piece]
    if not kept:
        return None
    windows = np.zeros((len(kept), WINDOW), np.uint8)
    for i, (_, piece) in enumerate(kept):
        windows[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    network = Network(languages)
    network.fit(windows, np.array([k for k, _ in kept]))
    return network


def _predict(network: Network | None, batch_windows: int = 256):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stride = WINDOW - max(WIDTHS) + 1
        for batch in batches:
            texts = column(batch, "text")
            for a, b, flat in flat_slices(texts):
                size = np.diff(flat.offs)
                n = np.maximum(1, -(-np.maximum(size - (WINDOW - stride), 0) // stride))
                row = np.repeat(np.arange(flat.n), n)
                first = np.cumsum(n) - n
                start = flat.offs[row] + (np.arange(len(row)) - first[row]) * stride
                data = np.concatenate([flat.data, np.zeros(WINDOW, np.uint8)])
                letters = np.flatnonzero(np.frombuffer(flat.data.tobytes().translate(_LETTER), bool))
                known = np.diff(np.searchsorted(letters, flat.offs)) > 0
                for i in np.flatnonzero(~known & (size > 0)):
                    known[i] = any(c.isalpha() for c in texts[a + int(i)].as_py())
                if network is None:
                    yield _answers(batch, a, b, [UNKNOWN] * flat.n, np.zeros(flat.n))
                    continue
                total = np.zeros((flat.n, len(network.languages)))
                for k in range(0, len(row), batch_windows):
                    at = start[k : k + batch_windows, None] + np.arange(WINDOW)
                    w = np.where(at < flat.offs[row[k : k + batch_windows] + 1][:, None], data[at], 0)
                    np.add.at(total, row[k : k + batch_windows], network.probabilities(w))
                mean = total / n[:, None]
                best = mean.argmax(1)
                score = np.where(known, mean[np.arange(flat.n), best], 0.0)
                yield _answers(batch, a, b, [network.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)], score)

    return predict


def _answers(batch: pa.RecordBatch, a: int, b: int, languages: list[str], score: np.ndarray) -> pa.RecordBatch:
    kept = [(n, batch.column(i).slice(a, b - a)) for i, n in enumerate(batch.schema.names)]
    return pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(languages), pa.array(np.clip(score, 0, 1))], names=[*(n for n, _ in kept), "lang_pred", "lang_score"])


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """``docs`` with lang_pred and lang_score; only ``text`` is read.

    A null text, or one without any letter, is ``und`` with score 0. A very long text is scored in
    batches of windows. Rows keep their number, null ids and repeated rows included; a column of
    these names that is there already is replaced. An empty table gives an empty one.
    """
    rows = docs.drop("lang_pred", "lang_score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_predict(network), f"{kinds}, lang_pred string, lang_score double")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict all documents' languages from a network that saw no document of remainder 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    network = train(docs.select("doc_id", "text", "lang").where(~held_out))
    found = identify(docs.select("doc_id", "text"), network)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
