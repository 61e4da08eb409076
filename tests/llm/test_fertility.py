import re
from collections import Counter

import pytest

from citeforge.llm import fertility as ft


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, inside, seen, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside.update(range(i, i + 5))
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_counts_equal_brute_force(table, request):
    df = request.getfixturevalue(table)
    got = ft.judge_documents(df).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    ours = sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got), key=key)
    assert ours == sorted(((r.doc_id, brute(r.text)) for r in df.collect()), key=key)
    assert not any(r.kept and (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in got)
    if table == "docs":
        passed = [r for r in got if not r.base_failed]
        assert sum(r.kept for r in passed) > 0.95 * len(passed)


def test_measures_equal_the_library(spark):
    import math

    import sentencepiece
    from citeforge.llm.wordcoder import vocabulary_path

    text = "The straße naïve 日本語 𓀀 reading, the reading of the words."
    row = ft.measures(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(ft.PIECES))
    ids = [i for w in text.split() for i in model.encode(w)]
    assert row.n_piece_tokens == len(ids) and row.n_fallback == sum(model.is_byte(i) for i in ids) > 0
    assert row.piece_entropy == pytest.approx(-sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()))


def test_random_strings_are_rejected(spark):
    import base64
    import hashlib

    junk = " ".join(base64.b85encode(hashlib.sha256(str(i).encode()).digest()).decode() for i in range(30))
    prose = "Every evening the old gardener walked slowly through the quiet orchard, counting apples and humming songs from his childhood."
    got = ft.judge_documents(spark.createDataFrame([(1, junk), (2, prose)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got} == {1: False, 2: True}


def test_empty_table(empty):
    assert ft.judge_documents(empty).collect() == []


def plain_verdicts(rows):
    """kept of each row, by loops: binned medians, three levels, and the limits."""
    import math

    used = [r for r in rows if not r.base_failed and r.n_piece_tokens > 0]

    def median(values):
        places = sorted(math.floor(math.log2(max(v, 2.0**-20)) * ft.PARTS) for v in values)
        return 2 ** ((places[(len(places) - 1) // 2] + 0.5) / ft.PARTS)

    def blend(rows, r, above):
        if not rows:
            return above
        n, m = len(rows), median([r_[r] for r_ in rows])
        s = 1.4826 * median([abs(x[r] - m) * math.sqrt(x[ft.RATIOS[r]]) for x in rows])
        w = n / (n + ft.PRIOR)
        return w * m + (1 - w) * above[0], w * s + (1 - w) * above[1], (1 - w) * (above[2] + (abs(m - above[0]) if above[1] else 0))

    out = []
    for x in rows:
        limits = ft.BANDS[x.script]
        short = min(1.0, math.log2(max(1, x.n_piece_tokens)) / math.log2(ft.FULL_TOKENS))
        good = not x.base_failed and x.fallback_share <= limits[4] and x.piece_entropy >= limits[5] * short
        for k, r in enumerate(ft.RATIOS):
            low, high = limits[2 * k : 2 * k + 2]
            script = blend([u for u in used if u.script == x.script], r, ((low + high) / 2, 0.0, (high - low) / 2))
            middle, scale, slack = blend([u for u in used if u.script == x.script and u.lang == x.lang], r, script) if x.lang is not None else script
            good = good and low <= x[r] <= high and abs(x[r] - middle) <= ft.DEVIATIONS * scale / math.sqrt(max(1, x[ft.RATIOS[r]])) + slack
        out.append(good)
    return out


def test_kept_equals_a_plain_verdict(spark, docs):
    from pyspark.sql import functions as F

    some = docs.select("doc_id", "text", "lang").where("doc_id % 2 = 0").withColumn("lang", F.when(F.col("doc_id") % 6 != 0, F.col("lang")))
    junk = [(10**6 + i, " ".join(f"{'xq#'[i % 3]}{k}z{'-&' * (i % 4)}" for k in range(40)), "en" if i % 2 else None) for i in range(8)]
    rows = ft.judge_documents(some.union(spark.createDataFrame(junk, "doc_id long, text string, lang string"))).collect()
    want = plain_verdicts(rows)
    assert [r.kept for r in rows] == want and not all(want[k] for k, r in enumerate(rows) if r.doc_id >= 10**6)


def test_a_language_has_its_own_bands(spark, docs):
    """Symbol-laden text leaves the band of its language, and that of its script where it has none;
    random letters leave it as well."""
    import random

    prose = docs.where("lang = 'en'").select("doc_id", "text", "lang")
    first = prose.orderBy("doc_id").first().text
    noisy = " ".join(w + "".join(c for c in "#%&*")[i % 3 :] * 2 for i, w in enumerate(first.split()))
    rng = random.Random(0)
    letters = "".join(rng.choice("bcdfghjklmnpqrstvwxz") if c.isalpha() else c for c in first)
    more = [(10**6, noisy, "en"), (10**6 + 1, noisy, None), (10**6 + 2, letters, None), (10**6 + 3, first + " and", None)]
    rows = prose.union(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in ft.judge_documents(rows).where("not base_failed").collect()}
    assert [out[10**6 + k].kept for k in range(4)] == [False, False, False, True]
    assert all(r.kept for r in out.values() if r.doc_id < 10**6 and r.n_symbols < 0.05 * r.n_words and r.n_words >= 20)
