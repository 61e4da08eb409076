import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeforge.llm import brown


HELD = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 1


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", lower) + [brown.END]


@pytest.mark.parametrize("table", ["docs", "odd"])
@pytest.mark.parametrize("head", [200_000, 50])
def test_scores_equal_brute_force(table, head, request, monkeypatch):
    monkeypatch.setattr(brown, "HEAD", head)
    df = request.getfixturevalue(table)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    model, vocabulary = brown.train(df.where(~held))
    rows = df.select("doc_id", "text", held.alias("held")).collect()
    count = Counter(t for r in rows if not r.held for t in tokens(r.text))
    n, v = sum(count.values()), len(count)
    assert (model.n, model.v) == (n, v)
    per_class, kinds = Counter(), Counter()
    sym = lambda w: model.symbols.end if w == brown.END else int(model.symbols.of([w])[0])
    for w, c in count.items():
        per_class[model.classes[sym(w)]] += c
        kinds[model.classes[sym(w)]] += 1
    want = []
    for r in rows:
        ts = tokens(r.text)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        score, last = 0.0, model.classes[-1]
        for t in ts:
            k = model.classes[sym(t)]
            score += model.transition[last, k] + math.log10((count[t] + 0.5) / (per_class[k] + 0.5 * (kinds[k] + 1)))
            last = k
        want.append((-1 if r.doc_id is None else r.doc_id, len(ts), sum(count[t] > 0 for t in ts), base, score))
    got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in brown.score(df, model, vocabulary).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


@pytest.fixture(scope="module")
def trained(docs):
    return brown.train(docs.where(~HELD(F.col("doc_id"))))


def test_model_is_a_distribution_and_beats_the_base(docs, trained):
    held = HELD(F.col("doc_id"))
    model, vocabulary = trained
    assert np.allclose((10**model.transition).sum(1), 1)
    out = brown.score(docs.where(held), model, vocabulary).agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > out[1]


def test_exchange_finds_alternating_classes():
    pairs = np.zeros((9, 9))
    for i in range(8):
        for j in range(8):
            pairs[i, j] = 10.0 if i % 2 != j % 2 else 0.0
    own = brown.exchange(pairs, classes=3)
    assert len(set(own[:8:2])) == 1 and len(set(own[1:8:2])) == 1 and own[0] != own[1] and own[8] == 2


def dense(texts, symbols):
    size = symbols.end + 1
    pairs = np.zeros((size, size))
    for text in texts:
        line = [symbols.end, *symbols.of(tokens(text)[:-1]).tolist(), symbols.end]
        for a, b in zip(line, line[1:], strict=False):
            pairs[a, b] += 1
    return pairs


def test_gains_equal_the_likelihoods_difference():
    rng = np.random.default_rng(3)
    pairs, own = rng.poisson(3, (12, 12)).astype(float), rng.integers(0, 3, 12)
    pairs[7, :] = 0
    pairs[7, [2, 7]] = 5
    count = lambda own: np.array([[pairs[np.ix_(own == a, own == b)].sum() for b in range(3)] for a in range(3)])
    others = pairs - np.diag(np.diag(pairs))
    after, before = (np.array([[v[w, own == c].sum() for c in range(3)] for w in range(12)]) for v in (others, others.T))
    gain = brown.gains(count(own), own, after, before, np.diag(pairs))
    for w in range(12):
        want = []
        for c in range(3):
            moved = own.copy()
            moved[w] = c
            want.append(brown.likelihood(count(moved)))
        assert np.diff(want) == pytest.approx(np.diff(gain[w]))


def test_exchange_over_all_symbols(docs, monkeypatch):
    monkeypatch.setattr(brown, "SEED", 50)
    model, _ = brown.train(docs)
    assert len(model.trace) > 2 and all(b > a for a, b in zip(model.trace, model.trace[1:], strict=False))
    pairs = dense([r.text for r in docs.collect()], model.symbols)
    k = int(model.classes.max()) + 1
    member = np.eye(k)[model.classes]
    assert brown.likelihood(member.T @ pairs @ member) == pytest.approx(model.trace[-1])
    assert (model.classes[:-1] < k - 1).all() and model.classes[-1] == k - 1
    assert len(set(model.classes[: len(model.symbols.words)].tolist())) > 10


def test_only_rarer_words_ride_on_endings(trained):
    model, vocabulary = trained
    total, outside = vocabulary.agg(F.sum("n"), F.sum(F.when((F.col("n") * brown.HEAD < model.n) & (F.col("word") != brown.END), F.col("n")).otherwise(0))).first()
    assert model.outside == pytest.approx(outside / total)
    assert len(model.symbols.words) == vocabulary.where(F.col("n") * brown.HEAD >= model.n).where(F.col("word") != brown.END).count()


def test_empty_table(empty, odd):
    model, vocabulary = brown.train(empty)
    assert brown.score(empty, model, vocabulary).collect() == []
    assert brown.score(odd, model, vocabulary).count() == odd.count()
