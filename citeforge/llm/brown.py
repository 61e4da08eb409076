"""Language-model scoring by a Brown class bigram.

Word counts of all training documents go to a written vocabulary table. Words that make up at least
one part in ``HEAD`` of all tokens (so at most ``HEAD`` words) are known to every task and each has
a class of its own choice; all others are looked up by a join, and their class is that of their
ending (``Model.outside`` is their share of the tokens). Exchange
clustering assigns head words and endings to classes from the adjacent pairs of these symbols in
the whole corpus: first, on the driver, the ``SEED`` most frequent words and all endings; then, in
rounds over the written contexts of all symbols, every symbol in the tasks. A round proposes the
best move of each symbol against the same class counts and keeps the moves only if the likelihood
of the corpus rises, else the better half of them, so it never falls. A token's probability is its
class's transition from the class before, times its emission from its class, both smoothed; each
document starts and ends with the end token, a class by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import shared
from citeforge.llm.textvec import column, flat_slices

HEAD = 200_000
SEED = 1000  # most frequent words that the driver clusters first
ENDINGS = 512  # at most so many endings have a class; they make up one part in ENDINGS of tokens each
CLASSES = 48
ENDING_CHARS = 2
ROUNDS = 10  # of the exchange over all symbols
LEAST_GAIN = 1e-4  # of the likelihood, below which the exchange ends
END = " "  # the end token; no word holds a blank


def _grow(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(between: np.ndarray) -> float:
    """What class-pair counts say of the corpus's log-likelihood; all else does not depend on classes."""
    return float(_grow(between).sum() - _grow(between.sum(0)).sum() - _grow(between.sum(1)).sum())


def gains(between: np.ndarray, here: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """(symbols, classes): what the likelihood would be with each symbol in each class, up to a
    number of its own for each symbol.

    ``between`` counts pairs of classes with the symbols where they are, in ``here``; ``after`` and
    ``before`` are a symbol's counts by the class of other symbols on its right and left, ``itself``
    its pairs with itself. Only classes that a symbol has beside it matter, so a rare one costs little.
    """
    row, itself = np.arange(len(here)), itself[:, None]

    def without(counts: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.repeat(counts[None], len(here), 0)
        out[row, here] -= own
        return out

    diagonal = without(np.diag(between), after[row, here] + before[row, here] + itself[:, 0])
    gain = _grow(diagonal + after + before + itself) - _grow(diagonal)
    for sums, own in ((between.sum(1), after), (between.sum(0), before)):
        more = own.sum(1) + itself[:, 0]
        rest = without(sums, more)
        gain -= _grow(rest + more[:, None]) - _grow(rest)
    for cells, own, other in ((between, after, before), (between.T, before, after)):
        w, c = np.nonzero(own)
        if not len(w):
            continue
        entry, x, at = np.arange(len(w)), own[w, c], here[w]
        rest = cells.T[c]
        rest[entry, at] -= x
        same = np.flatnonzero(c == at)
        rest[same] -= other[w[same]]
        rest[same, at[same]] -= itself[w[same], 0]
        more = _grow(rest + x[:, None]) - _grow(rest)
        more[entry, c] = 0
        first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        gain[w[first]] += np.add.reduceat(more, first)
    return gain


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 12) -> np.ndarray:
    """The class of each symbol, by exchange clustering on adjacent-pair counts (symbols x symbols).

    The last symbol is the end token and stays alone in the last class. Each round moves every
    symbol, the most frequent first, to the class that gives the class bigram the greatest
    likelihood; it ends when no symbol moves.
    """
    n = len(pairs)
    classes = max(2, min(classes, n))
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1))[:-1], kind="stable")
    own = np.full(n, classes - 1)
    own[order] = np.arange(n - 1) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), own] = 1
    between = member.T @ pairs @ member
    for _ in range(rounds):
        moved = 0
        for w in order:
            here, itself = own[w], pairs[w, w]
            after, before = pairs[w] @ member, pairs[:, w] @ member
            after[here] -= itself
            before[here] -= itself
            gain = gains(between, own[w : w + 1], after[None], before[None], pairs[w, w][None])[0, :-1]
            best = int(gain.argmax())
            if gain[best] > gain[here] + 1e-9:
                for c, sign in ((here, -1), (best, 1)):
                    between[c] += sign * after
                    between[:, c] += sign * before
                    between[c, c] += sign * itself
                member[w, here], member[w, best], own[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return own


def _mapped(classes: np.ndarray, k: int):
    """Pair counts of symbols to pair counts of their classes."""
    size = len(classes)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            pair, n = column(batch, "pair").to_numpy(), column(batch, "n").to_numpy()
            key, at = np.unique(classes[pair // size] * np.int64(k) + classes[pair % size], return_inverse=True)
            for x, c in zip(key.tolist(), np.bincount(at, weights=n).tolist(), strict=True):
                total[x] = total.get(x, 0) + int(c)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["pair", "n"])

    return mapped


def class_pairs(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of adjacent classes; the driver gets at most classes x classes of them."""
    k = int(classes.max()) + 1
    counted = pairs.mapInArrow(_mapped(classes, k), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    between = np.zeros(k * k)
    between[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    return between.reshape(k, k)


def contexts(pairs: DataFrame, size: int) -> DataFrame:
    """A row for each symbol with all its neighbours: at most 2 x ``size`` of them, whatever the corpus.

    Symbols are dealt to a fixed number of tasks, as a round's work follows them and not their bytes.
    """
    a, b = F.expr(f"pair div {size}").cast("int"), (F.col("pair") % size).cast("int")
    sides = F.array(F.struct(a.alias("symbol"), F.lit(True).alias("right"), b.alias("other"), "n"), F.struct(b.alias("symbol"), F.lit(False).alias("right"), a.alias("other"), "n"))
    rows = pairs.select(F.explode(sides).alias("s")).select("s.*")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "symbol").groupBy("symbol").agg(F.collect_list(F.struct("right", "other", "n")).alias("near"))


def _proposed(classes: np.ndarray, between: np.ndarray, most: int = 512):
    """The best move of each symbol that has a better class than its own."""
    k, end = len(between), len(classes) - 1

    def moves(symbols: np.ndarray, w: np.ndarray, right: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        here, own = classes[symbols], other == symbols[w]
        itself = np.bincount(w, weights=n * (own & right), minlength=len(symbols))
        side = lambda r: np.bincount(w * k + classes[other], weights=n * (r & ~own), minlength=len(symbols) * k).reshape(-1, k)
        gain = gains(between, here, side(right), side(~right), itself)[:, :-1]
        best, row = gain.argmax(1), np.arange(len(symbols))
        up = gain[row, best] - gain[row, np.minimum(here, k - 2)]
        good = (up > 1e-6) & (symbols != end)  # the end token stays
        return pa.RecordBatch.from_arrays([pa.array(symbols[good].astype(np.int64)), pa.array(best[good]), pa.array(up[good])], names=["symbol", "to", "gain"])

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, near = column(batch, "symbol").to_numpy(), column(batch, "near")
            at, rows = near.offsets.to_numpy(), near.values
            right, other, n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("right", "other", "n"))
            for a in range(0, len(symbols), most):
                b = min(a + most, len(symbols))
                part = slice(at[a], at[b])
                yield moves(symbols[a:b], np.repeat(np.arange(b - a), np.diff(at[a : b + 1])), right[part], other[part], n[part])

    return propose


def refine(pairs: DataFrame, near: DataFrame, classes: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Exchange over all symbols: (classes, class-pair counts, likelihood after each round).

    ``pairs`` (pair, n) and ``near`` (``contexts``) are written tables. Classes, at most ``HEAD`` +
    ``ENDINGS`` + 2 small numbers, go to the tasks, and at most as many moves come back.
    """
    between = class_pairs(pairs, classes)
    trace = [likelihood(between)]
    for _ in range(rounds):
        moves = near.mapInArrow(_proposed(classes, between), "symbol long, to long, gain double").toArrow()
        symbol, to, gain = (moves[c].to_numpy() for c in ("symbol", "to", "gain"))
        order = np.lexsort((symbol, -gain))
        while len(order):
            tried = classes.copy()
            tried[symbol[order]] = to[order]
            counted = class_pairs(pairs, tried)
            if likelihood(counted) > trace[-1]:
                break
            order = order[: len(order) // 2]  # moves that are good alone may spoil each other
        if not len(order):
            break
        classes, between = tried, counted
        trace.append(likelihood(between))
        if trace[-1] - trace[-2] < LEAST_GAIN * abs(trace[-1]):
            break
    return classes, between, trace


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, flat in flat_slices(column(batch, "text")):
            codes, distinct = flat.lower().words().encode()
            n = np.bincount(codes, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(n)], names=["word", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([b - a])], names=["word", "n"])


@dataclass
class Symbols:
    """The symbol of every word: its own if it is a head word, else its ending's, else a common one."""

    words: dict[str, int]
    endings: dict[str, int]

    @property
    def rest(self) -> int:
        return len(self.words) + len(self.endings)

    @property
    def end(self) -> int:
        return self.rest + 1

    def of_ending(self, word: str) -> int:
        return self.endings.get(word[-ENDING_CHARS:], self.rest)

    def of(self, words: list[str]) -> np.ndarray:
        own, ending = self.words.get, self.of_ending
        return np.fromiter((k if (k := own(w)) is not None else ending(w) for w in words), np.int64, len(words))


def _sequence(words, symbol_of_code: np.ndarray, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all rows with the end token before each and after the last, and its places."""
    at = words.at + np.arange(words.flat.n + 1)
    out = np.full(len(codes) + words.flat.n + 1, end)
    keep = np.ones(len(out), bool)
    keep[at] = False
    out[keep] = symbol_of_code[codes] if len(codes) else codes
    return out, at


def _pairs(symbols: Symbols):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = symbols.end + 1
        for batch in batches:
            for _, _, flat in flat_slices(column(batch, "text")):
                words = flat.lower().words()
                codes, distinct = words.encode()
                line, _ = _sequence(words, symbols.of(distinct.to_numpy(zero_copy_only=False).tolist()), codes, symbols.end)
                key, n = np.unique(line[:-1] * size + line[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["pair", "n"])

    return pairs


@dataclass
class Model:
    """What the tasks need: counts of head words, classes, and smoothed log10 probabilities."""

    symbols: Symbols
    head: np.ndarray  # counts of the symbols that are head words
    classes: np.ndarray
    transition: np.ndarray  # log10 P(class | class before)
    spread: np.ndarray  # log10 of each class's emission denominator
    n: int
    v: int
    n_end: int
    trace: list[float] = field(default_factory=list)  # likelihood after each round of the exchange

    @property
    def base_spread(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.v + 1)))

    @property
    def outside(self) -> float:
        """The share of training tokens whose class is that of their ending."""
        return 1 - (float(self.head.sum()) + self.n_end) / max(1, self.n)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the vocabulary table (word, n) that holds every training word's count.

    A null text is empty and counts one end token, and so does a repeated row each time; a text may
    be of any length. Without rows all counts are 0 and all classes alike.
    """
    texts = docs.select("text")
    vocabulary = texts.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    vocabulary = shared.materialize(vocabulary, "vocabulary")
    n, v = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = vocabulary.where(F.col("word") != END)
    common = F.col("n") * HEAD >= n
    head = sorted((tuple(r) for r in words.where(common).collect()), key=lambda r: (-r[1], r[0]))  # at most HEAD rows
    # Endings get a class by what they hold besides the seed words; they stand for rarer words then.
    ending = F.substring("word", -ENDING_CHARS, ENDING_CHARS)
    seed = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w, _ in head[:SEED]], "word string"))
    by_ending = words.join(seed, "word", "left_anti").groupBy(ending.alias("ending")).agg(F.sum("n").alias("n"))
    endings = sorted(r[0] for r in by_ending.where(F.col("n") * ENDINGS >= n).select("ending").collect())  # at most ENDINGS rows
    symbols = Symbols({w: i for i, (w, _) in enumerate(head)}, {e: len(head) + i for i, e in enumerate(endings)})
    size = symbols.end + 1
    pairs = texts.mapInArrow(_pairs(symbols), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = shared.materialize(pairs, "pairs")

    few = min(SEED, len(head))
    seeded = np.arange(size) - len(head) + few  # endings, the rest and the end follow the seed words
    seeded[: len(head)] = np.minimum(np.arange(len(head)), few)
    seeded[few : len(head)] = [symbols.of_ending(w) - len(head) + few for w, _ in head[few:]]
    classes = exchange(class_pairs(pairs, seeded), rounds=4)[seeded]  # a start; the rounds below go on
    near = shared.materialize(contexts(pairs, size), "contexts")
    classes, between, trace = refine(pairs, near, classes)

    k = len(between)
    unigram = (between.sum(0) + 0.5) / (between.sum() + 0.5 * k)
    transition = (between + 2.0 * unigram) / (between.sum(1, keepdims=True) + 2.0)
    totals, kinds = np.zeros(size), np.zeros(size)
    totals[: len(head)], kinds[: len(head)] = [c for _, c in head], 1
    for e, c, d in words.where(~common).groupBy(ending.alias("e")).agg(F.sum("n"), F.count("*")).where(F.col("e").isin(endings)).collect():  # at most ENDINGS rows
        totals[symbols.endings[e]], kinds[symbols.endings[e]] = c, d
    n_end = next((r[0] for r in vocabulary.where(F.col("word") == END).select("n").collect()), 0)
    totals[symbols.end], kinds[symbols.end] = n_end, int(n_end > 0)
    totals[symbols.rest], kinds[symbols.rest] = n - totals.sum(), v - kinds.sum()
    per_class, kinds_per_class = (np.bincount(classes, weights=x, minlength=k) for x in (totals, kinds))
    spread = np.log10(per_class + 0.5 * (kinds_per_class + 1))
    model = Model(symbols, np.array([c for _, c in head], np.int64), classes, np.log10(transition), spread, int(n), int(v), int(n_end), trace)
    return model, vocabulary


PARTIAL = "rid long, word string, tf long, info struct<doc_id:long,n_tokens:long,n_known:long,base:double,score:double>"


def _score_rows(model: Model):
    """Each document's sums over the head words, and a row for each of its other distinct words.

    ``score`` and ``base`` hold all that does not depend on the other words' counts.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        end_base = np.log10(model.n_end + 0.5)
        for batch in batches:
            keys = column(batch, "doc_id")
            for a, b, flat in flat_slices(column(batch, "text")):
                words = flat.lower().words()
                codes, distinct = words.encode()
                listed = distinct.to_numpy(zero_copy_only=False).tolist()
                symbol = model.symbols.of(listed)
                counts = np.append(model.head, 0)[np.minimum(symbol, len(model.head))]
                line, at = _sequence(words, symbol, codes, model.symbols.end)
                steps = model.classes[line]
                jumps = np.concatenate([[0.0], np.cumsum(model.transition[steps[:-1], steps[1:]])])
                weight = np.where(counts > 0, np.log10(counts + 0.5), 0.0)
                spread = model.spread[model.classes[symbol]] if len(listed) else np.zeros(0)
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes] if len(codes) else np.zeros(0))])[words.at])  # noqa: B023, E731
                known, logs, spreads = total((counts > 0).astype(np.int64)), total(weight), total(spread)
                size = words.counts + 1
                base = logs + end_base - size * model.base_spread
                scores = jumps[at[1:]] - jumps[at[:-1]] + logs - spreads + end_base - model.spread[-1]
                rids = rid + np.arange(b - a)
                rid += b - a
                info = pa.StructArray.from_arrays(
                    [keys.slice(a, b - a), pa.array(size), pa.array(known.astype(np.int64) + int(model.n_end > 0)), pa.array(base), pa.array(scores)],
                    names=["doc_id", "n_tokens", "n_known", "base", "score"],
                )
                names = ["rid", "word", "tf", "info"]
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array([f" {r}" for r in rids]), pa.array(np.zeros(b - a, np.int64)), info], names=names)
                rare = counts[codes] == 0 if len(codes) else np.zeros(0, bool)
                pair, tf = np.unique(words.rows()[rare] * np.int64(max(1, len(listed))) + codes[rare], return_counts=True)
                of, code = pair // max(1, len(listed)), pair % max(1, len(listed))
                yield pa.RecordBatch.from_arrays([pa.array(rids[of]), distinct.take(pa.array(code)).cast(pa.string()), pa.array(tf), pa.nulls(len(pair), info.type)], names=names)

    return score


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """A row for each document: tokens, known tokens, unigram base score and class-bigram score.

    A null text is empty (one end token); null ids and repeated rows are rows of their own. Words
    outside the head meet their counts in a join on the word; they are by definition not frequent,
    so no key of it is hot.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score_rows(model), PARTIAL)
    rare = vocabulary.where(F.col("n") * HEAD < model.n)
    met = rows.join(rare, "word", "left")
    per_word = F.col("tf") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    sums = met.groupBy("rid").agg(
        F.max("info").alias("info"),
        F.sum(F.when(F.col("tf") > 0, per_word).otherwise(0.0)).alias("logs"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("known"),
        F.sum("tf").alias("rare"),
    )
    return sums.select(
        "info.doc_id",
        "info.n_tokens",
        (F.col("info.n_known") + F.col("known")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        # The base denominator was taken for all tokens; the class ones likewise, in the tasks.
        (F.col("info.base") + F.col("logs")).alias("base_score"),
        (F.col("info.score") + F.col("logs")).alias("score"),
    )


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a model of those whose id's remainder is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model, vocabulary = train(docs.where(~crc(F.col("doc_id"))))
    out = score(docs, model, vocabulary)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", crc(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", perplexity.alias("perplexity"))
