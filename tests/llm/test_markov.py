import base64
import hashlib
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeforge.llm import markov

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(out)


def key(x):
    return x[0] is not None, x[0] or 0, x[1]


TRICKY = [
    "token=token:abcdefgh password = 'hunter22' api_key:\"A-b_c.d/e=\" APIKEY:12345 Secret=x",
    "é 🎉 AKIA" + "A1" * 10 + " AKIAAKIA1234 " + "ab12" * 6 + "g" + "0" * 23 + " " + "f" * 24,
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" passwd::secret=abcdef",
]


@pytest.mark.parametrize("table", ["docs", "odd", "tricky"])
def test_base_spans_equal_brute_force(table, request, spark):
    df = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string") if table == "tricky" else request.getfixturevalue(table)
    got = markov.find_secrets(df).collect()
    ours = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.base_spans]) for r in got), key=key)
    assert ours == sorted(((r.doc_id, brute(r.text)) for r in df.collect()), key=key)
    if table == "docs":
        assert sum(len(r.all_spans) - len(r.base_spans) for r in got) == 0


def test_very_many_matches(spark):
    """A text of 30,000 matches; numbering them one by one would copy 450 million spans."""
    import time

    text = " é ".join(f"{i:024x}" for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, "token=abcdef " * 700)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.base] for r in df.select("doc_id", markov.base_spans(F.col("text")).alias("base")).collect()}
    assert time.time() - began < 60
    assert got[1] == brute(text) and got[2] == brute("token=abcdef " * 700)


def test_random_strings_are_added(spark, docs):
    ratios = markov.train(markov.labelled_samples(docs))
    secrets = [base64.b64encode(hashlib.sha256(str(i).encode()).digest()[:24]).decode().rstrip("=") for i in range(50)]
    plain = ["thequickbrownfoxandthehound", "read_the_documents_and_answers", "/usr/local/share/and/there", "-" * 40, "=" * 30, "1234567890123456789012345", "otherInterestingWordsInThere"]
    rows = [(i, f"see {s} here") for i, s in enumerate(secrets + plain)]
    out = {r.doc_id: r.all_spans for r in markov.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ratios).collect()}
    hit = [len(out[i]) == 1 and (out[i][0].start, out[i][0].end, out[i][0].kind) == (4, 4 + len(s), 3) for i, s in enumerate(secrets)]
    assert sum(hit) >= 48
    assert all(s.kind != 3 for i in range(len(secrets), len(rows)) for s in out[i])


def test_random_parts_of_tokens_are_added(spark, docs):
    ratios = markov.train(markov.labelled_samples(docs))
    draw = random.Random(3)
    word = lambda n, letters=string.ascii_letters + string.digits: "".join(draw.choice(letters) for _ in range(n))
    hexes = "0123456789abcdef"
    made = {
        "equals": [("mail_signing_credential=", word(20), "") for _ in range(50)],
        "path": [("/internal/services/production/credentials/", word(24), "/and/other/words/behind") for _ in range(50)],
        "upper": [("", word(32, string.ascii_uppercase), "") for _ in range(50)],
        "lower": [("", word(32, string.ascii_lowercase), "") for _ in range(50)],
        "beside": [(f"checksum={word(32, hexes)}/", word(24), "") for _ in range(50)],
        "second": [(f"first_key={word(24)}_and_the_second_credential_in_here=", word(24), "") for _ in range(50)],
    }
    plain = ["/archive/2024/01/15/report-2024-final-version", "orders/2024/01/15/12345678901234567890/items", "MAX_BUFFER_SIZE_IN_BYTES_PER_NODE", string.ascii_uppercase]
    rows = [(name, *parts) for name, all_parts in made.items() for parts in all_parts] + [("plain", "", x, "") for x in plain]
    texts = [(i, f"see {a}{s}{b} here") for i, (_, a, s, b) in enumerate(rows)]
    out = {r.doc_id: r for r in markov.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), ratios).collect()}
    hits = Counter()
    for i, (name, a, s, _) in enumerate(rows):
        start, end = 4 + len(a), 4 + len(a) + len(s)
        hits[name] += any(x.kind == 3 and x.start <= start and end <= x.end for x in out[i].all_spans)
        assert all(b.end <= x.start or x.end <= b.start for b in out[i].base_spans for x in out[i].all_spans if x.kind == 3)
        assert all(texts[i][1][x.start : x.end] == x.value for x in out[i].all_spans if x.kind == 3)
    assert hits["plain"] == 0 and all(hits[name] >= 47 for name in made)


def test_redaction(spark):
    rows = [(1, TRICKY[2]), (2, None), (3, "nothing here"), (4, "é password=abcdefg")]
    found = markov.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), [0.0] * markov.SIZE**2)
    out = {r[0]: r[1] for r in found.select("doc_id", markov.redacted(F.col("text"), F.col("all_spans"))).collect()}
    assert out[1] == '[SECRET]" passwd::[SECRET]' and out[2] is None and out[3] == "nothing here" and out[4] == "é [SECRET]"


def test_empty_table(empty):
    assert markov.find_secrets(empty).collect() == []


def plain_parts(steps):
    """The pass of ``best_parts`` as a loop over a token's steps."""
    width, never = markov.LEAST - 1, -1e15
    w, b, a, c, ca, peak, pa, pe, out = 0.0, never, 0, never, 0, -1.0, 0, -2, []
    for i, d in enumerate(steps):
        w += d - (steps[i - width] if i >= width else 0.0)
        first = i - (width - 1)
        fresh = w if first >= 0 else never
        behind = w if first >= 0 and first >= pe + 2 else never
        b, c = b + d, c + d
        if fresh > b:
            a = first
        b = max(b, fresh)
        if behind > c:
            ca = first
        c = max(c, behind)
        if b >= 0 and b > peak:
            if peak >= 0 and a >= pe + 2:
                out.append((pa, pe + 2))
            peak, pa, pe, c = b, a, i, never
        elif peak >= 0 and c >= 0:
            out.append((pa, pe + 2))
            peak, pa, pe, b, a, c = c, ca, i, c, ca, never
    return [*out, (pa, pe + 2)] if peak >= 0 else out


def plain_random(text, ratios):
    base, out = brute(text), []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        v, at = m[0], m.start()
        place = [markov.ALPHABET.find(x) for x in v]
        steps = [ratios[p * markov.SIZE + q] - markov.MARGIN for p, q in zip(place, place[1:])]
        near = [(s, e) for s, _, e in base if s < m.end() and at < e]
        if not near and sum(steps) >= 0:
            out.append((at, m.end()))
            continue
        taken = [markov._TAKEN if any(s <= at + i + 1 and at + i < e for s, e in near) else x for i, x in enumerate(steps)]
        parts, wide = plain_parts(taken), []
        for k, (a, e) in enumerate(parts):
            low = max([0, *(q - at for _, q in near if q <= at + a), *([parts[k - 1][1]] if k else [])])
            high = min([len(v), *(p - at for p, _ in near if p >= at + e), *([parts[k + 1][0]] if k + 1 < len(parts) else [])])
            while a > low and v[a - 1].isalnum():
                a -= 1
            while e < high and v[e].isalnum():
                e += 1
            if wide and wide[-1][1] >= a:
                wide[-1] = wide[-1][0], max(wide[-1][1], e)
            else:
                wide.append((a, e))
        out += [(at + a, at + e) for a, e in wide]
    return out


def mixed(draw, n):
    """A text of glued and separate values of every kind, a few of its tokens very long."""
    letters = string.ascii_letters + string.digits
    piece = lambda k, of: "".join(draw.choices(of, k=k))
    makers = [lambda: piece(draw.randint(24, 40), "0123456789abcdef"), lambda: "token=" + piece(8, letters), lambda: piece(draw.randint(10, 60), letters), lambda: "the_quick_brown_fox", lambda: "AKIA" + piece(20, string.ascii_uppercase), lambda: "x" * 25, lambda: piece(30, "+/_=-")]
    out = []
    while sum(map(len, out)) < n:
        out += [draw.choice(makers)(), draw.choice(["", "", "Z", "/", "é ", " ", "\n"])]
    return "".join(out)


def test_added_spans_equal_plain_loops(spark, docs):
    ratios = markov.train(markov.labelled_samples(docs))
    draw = random.Random(11)
    texts = [mixed(draw, n) for n in [150] * 150 + [1500] * 2]
    out = {r.doc_id: r.all_spans for r in markov.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ratios).collect()}
    # Sums are made in another order, so a part whose steps sum to almost exactly 0 may differ; there is none here.
    for i, text in enumerate(texts):
        assert [(s.start, s.end) for s in out[i] if s.kind == 3] == plain_random(text, ratios)
    assert sum(len(plain_random(t, ratios)) for t in texts) > 200


def test_time_follows_length(spark):
    """Twice the matches and tokens take about twice the time."""
    import time

    ratios = [0.1] * markov.SIZE**2
    draw = random.Random(5)
    text = "".join(f"token={draw.randrange(10**9):012d} {draw.randrange(16**31):032x} " for _ in range(6_000))

    def took(n):
        df = spark.createDataFrame([(1, text[:n])], "doc_id long, text string")
        began = time.time()
        markov.find_secrets(df, ratios).select(F.size("all_spans")).collect()
        return time.time() - began

    took(1000)
    small = took(len(text) // 2)
    assert took(len(text)) < 2 + 2 * small
