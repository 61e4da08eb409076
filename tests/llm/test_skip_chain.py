import itertools
import random
import re
import time

import numpy as np
import pytest

from citeforge.llm import skipchain as sc

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for k, rx in enumerate(map(re.compile, PATTERNS)):
        for m in rx.finditer(text or ""):
            d = "".join(c for c in m[0] if c in "0123456789")
            if k == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if k == 2 and not (16 <= len(d) <= 19 and sc.luhn(d)):
                continue
            if k == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_base_spans_equal_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = sc.find_spans(df).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    ours = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans if s.base]) for r in got), key=key)
    assert ours == sorted(((r.doc_id, brute(r.text)) for r in df.collect()), key=key)


def test_patterns_equal_brute_force_on_random_texts():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("a1@.-_+ (0") for _ in range(rng.randrange(60)))
        assert sc.base_spans(text) == brute(text), text


@pytest.mark.parametrize("blob", ["x" * 2_000_000 + " a@b.c", "7" * 2_000_000 + " 1.2.3", "1." * 1_000_000, "a@" * 500_000, "+" * 1_000_000, "a.b" * 700_000 + "@"])
def test_long_blobs_take_linear_time(blob):
    began = time.process_time()
    sc.Nodes(blob)
    assert time.process_time() - began < 3


def prose(rng, n):
    """Documents with matches of all kinds, plain numbers and repeats."""
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        while not sc.luhn(d := "4" + digits(15)):
            pass
        return d

    for i in range(n):
        phone, code, mail = f"+49{digits(9)}", digits(rng.randrange(1, 9)), f"ab{i}.c{digits(2)}@mail{i % 9}.example.com"
        lines = [f"call {phone} now", f"order {code} of {digits(4)} and {code} again", f"host {rng.randrange(256)}.{rng.randrange(256)}.3.4 is up", f"mail {mail} or {mail} please", f"paid by {card()} today", f"call {phone} later", f"+1 ({digits(3)}) {digits(3)}-{digits(4)} rings", f"number {digits(11)} of {digits(16)}"]
        desk, part = f"+49{digits(8)}", digits(9)
        lines += [f"desk {desk}1 or {desk}2", f"part {part}3 or {part}4", f"line {desk}7 is not {desk[1:]}8"]
        rng.shuffle(lines)
        yield " then ".join(lines[: rng.randrange(1, 12)])


@pytest.fixture(scope="module")
def model(spark):
    texts = list(prose(random.Random(1), 300))
    return sc.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def added(spark, model, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in sc.find_spans(docs, model).collect()}
    return [[(sc.KINDS[s.kind], t[s.start : s.end]) for s in found[i] if not s.base] for i, t in enumerate(texts)]


def test_repeats_in_another_form_are_found(spark, model):
    forms = {"phone": ("+49301234567", "49301234567"), "card": ("4111111111111111", "4111.1111.1111.1111"), "ip": ("10.20.30.40", "10-20-30-40")}
    texts = [f"see {a} there. " + f"Then {b} once more. " * 15 for a, b in forms.values()]
    assert added(spark, model, *texts, "see 49301234567 and 49301234567 alone") == [[(k, b)] * 15 for k, (_, b) in forms.items()] + [[]]
    text = "Call +1 (017) 555-7713 or write to a.b@mail.example.com today. Later only 555-7713 was given, and order 1234 stays."
    assert added(spark, model, text) == [[("phone", "555-7713")]]


def test_isolated_numbers_do_not_split_a_span(spark, model):
    text = "Call +49 1512 345678 today. Later only 1512 345678 was given."
    want = [[("phone", "1512 345678")]]
    assert added(spark, model, text) == want
    assert added(spark, model, "In 1 of 2 or 3 and 4 or 5 and 6 or 7 cases. " + text) == want


def test_weights_do_not_depend_on_the_size_of_the_corpus(spark):
    rows = [(s, y) for t in prose(random.Random(2), 60) for s, y in sc.Nodes(t).situations()]
    s, y = (np.array(x) for x in zip(*rows, strict=True))
    small, large = (sc.Model(s, y, np.full(len(s), n)) for n in (1, 10**8))
    assert np.allclose(small.w, large.w, atol=1e-6)
    assert small.equal[4, 4] > small.equal[4, 0] and small.equal[4, 4] > small.near[4, 4] > small.near[4, 0]


def test_fit_is_the_maximum(spark):
    rows = [(s, y) for t in prose(random.Random(3), 20) for s, y in sc.Nodes(t).situations()]
    s, y = (np.array(x) for x in zip(*rows, strict=True))
    m, u = sc.Model(s, y, np.ones(len(s))), np.full(len(s), 1 / len(s))
    w = np.random.default_rng(0).normal(0, 0.3, len(m.w))
    loss, gradient, hessian = m._slopes(s, y, u, w)
    e = 1e-5 * np.random.default_rng(1).normal(0, 1, len(w))
    ahead, slope, _ = m._slopes(s, y, u, w + e)
    assert ahead - loss == pytest.approx(gradient @ e + e @ hessian @ e / 2, abs=1e-9)
    assert np.allclose(slope - gradient, hessian @ e, atol=1e-7)
    balanced = np.ones(len(s)) / np.bincount(y)[y] / len(set(y.tolist()))
    assert np.abs(m._slopes(s, y, balanced, m.w)[1]).max() < 1e-5


def exact(own, edges, factor):
    n, size = own.shape
    total = np.zeros((n, size))
    for y in itertools.product(range(size), repeat=n):
        p = np.exp(sum(own[k, y[k]] for k in range(n)) + sum(f[y[a], y[b]] for (a, b), f in zip(edges, factor, strict=True)))
        total[np.arange(n), y] += p
    return total / total.sum(1, keepdims=True)


@pytest.mark.parametrize(("edges", "close"), [([(0, 1), (1, 2), (1, 3), (4, 3)], 1e-6), ([(0, 1), (1, 2), (2, 3), (3, 0), (3, 4)], 0.05), ([], 1e-12)])
def test_marginals_against_enumeration(edges, close):
    rng = np.random.default_rng(5)
    own, edges = rng.normal(0, 1, (5, 3)), np.array(edges, int).reshape(-1, 2)
    factor = rng.normal(0, 0.6, (len(edges), 3, 3))
    assert np.abs(sc.marginals(own, edges, factor, 200) - exact(own, edges, factor)).max() < close


def test_similar_keys_equal_brute_force():
    rng = random.Random(8)
    keys = list(dict.fromkeys("".join(rng.choice("01") for _ in range(rng.randrange(5, 9))) for _ in range(60)))

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    pairs = sc.similar_keys(keys)
    assert all(one_edit(keys[i], keys[j]) for i, j in pairs)
    top = list(range(len(keys)))
    root = lambda x: x if top[x] == x else root(top[x])
    for i, j in pairs:
        top[root(i)] = root(j)
    for i, j in itertools.combinations(range(len(keys)), 2):
        if min(len(keys[i]), len(keys[j])) >= 7 and one_edit(keys[i], keys[j]):
            assert root(i) == root(j)


def test_added_spans_equal_a_plain_reading(spark, model):
    """Labels by enumeration over small documents, then runs of nodes tied to a match."""
    for text in ["a +49301234567 b 49301234567 c", "x 10.20.30.40 y 10-20-30-40 z 5", "n 4111111111111111 m 4111 1111 1111 1112"]:
        nodes = sc.Nodes(text)
        own, edges, factor = sc.field(model, [nodes])
        if len(own) <= 6:
            p = exact(np.maximum(own, -50), edges, factor)
            want = sc.added_spans(text, nodes, p)
            assert [s for s in added(spark, model, text)[0]] == [(sc.KINDS[k], text[a:b]) for k, a, b in want]


def test_clean_text_gets_no_spans(spark):
    docs = spark.createDataFrame([(1, "Order 12345 of 2024 came with 3 parts, no 12345 again.")], "doc_id long, text string")
    assert sc.find_spans(docs).first().spans == []


def test_empty_table(empty):
    assert sc.find_spans(empty).collect() == []


def test_query_counts(spark):
    from collections import Counter

    SF = "/root/testdata/sf0.001"

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in sc.op2_skip_chain(spark, SF).collect():
        spans = brute(docs[r.doc_id])
        n = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == (n[0], n[1], n[2], n[3], sc.sha256_of(spans))
        assert r.n_added or r.spans == ",".join(f"{sc.KINDS[k]}:{a}:{b}" for k, a, b in spans)
