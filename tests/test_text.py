import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeforge.functions import text as T

EXOTIC = ["", " ", "a  b c d", "　x \u0085 y\x1c", "One. Two!  Three? four", "A\r\nB \n C D  ", "İK ſ ß Über-42", "x" * 400, "tail   \t", "`\"'id'\"`", "no\x0bbreak\x0cthere", "a.b. c", "🎉 emoji. Done."]


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[1] for r in sorted(df.select("i", column(F.col("t")).alias("v")).collect())]


def py_span_hash(s):
    return hashlib.sha256("\n".join(line.rstrip() for line in s.strip().splitlines()).encode()).hexdigest()


def test_against_python(spark):
    norm = [re.sub(r"\s+", " ", s).strip() for s in EXOTIC]
    assert values(spark, T.normalize, EXOTIC) == norm
    assert values(spark, T.strip, EXOTIC) == [s.strip() for s in EXOTIC]
    assert values(spark, T.sentences, EXOTIC) == [[p for p in re.split(r"(?<=[.!?])\s+", n) if p] for n in norm]
    assert values(spark, T.tokens, EXOTIC) == [re.findall("[a-z0-9]+", s.lower()) for s in EXOTIC]
    assert values(spark, T.span_hash, EXOTIC) == [py_span_hash(s) for s in EXOTIC]
    assert values(spark, T.excerpt, EXOTIC) == [n if len(n) <= 240 else n[:237].rstrip() + "..." for n in norm]
    assert values(spark, T.slug, EXOTIC) == [re.sub("[^a-z0-9]+", "_", s.lower()).strip("_") or "untitled" for s in EXOTIC]
    assert values(spark, T.citation_id, EXOTIC) == [s.strip().strip("`'\"") for s in EXOTIC]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab. \n\t\r\x0b\x1e  !?'`\"", max_size=30), min_size=20, max_size=20))
def test_random_texts(spark, rows):
    assert values(spark, T.span_hash, rows) == [py_span_hash(s) for s in rows]
    assert values(spark, T.normalize, rows) == [re.sub(r"\s+", " ", s).strip() for s in rows]


def test_numbers(spark):
    row = spark.range(1).select(
        T.rate(F.lit(1), F.lit(3)), T.rate(F.lit(1), F.lit(0)), T.confidence(F.lit("1.7")), T.confidence(F.lit("x")), T.cost_usd(F.lit(1_000_000), F.lit(500_000)), T.is_unset(F.lit(" UNSET ")), T.is_positive(F.lit("0.1")), T.is_positive(F.lit("none"))
    ).first()
    assert tuple(row) == (0.333333, 0.0, 1.0, 0.0, 0.87, True, True, False)


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), (["x"], [], 0.0), (["x", "y"], ["y", "z"], 0.5), (["x", "x"], ["x"], 1.0)])
def test_set_f1(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(T.set_f1(F.col("a"), F.col("b"))).first()[0] == want


def test_html_attributes(spark):
    tag = '<a class="x" href="/a?b=1&amp;c=2" title="&quot;t&quot;" href="/last">'
    assert values(spark, T.html_attributes, [tag, "<b>"]) == [{"class": "x", "title": '"t"', "href": "/last"}, {}]


def test_credentials(spark):
    assert values(spark, T.has_credential, ["sk-abcdefghijkl1", "bearer abcdefghijklm", "MY_API_KEY = 1", "nothing"]) == [True, True, True, False]


def test_safe_components(spark):
    assert values(spark, T.is_safe_component, ["ok-1", "..", "a/b", "c:", "", None]) == [True, False, False, False, False, False]


def test_trimming_long_blank_runs_takes_linear_time(spark):
    import time

    text = "x" + " \t" * 400_000 + "y" + "\u2003 \n" * 100_000
    began = time.time()
    row = spark.createDataFrame([(text,)], "t string").select(F.length(T.strip(F.col("t"))), T.span_hash(F.col("t"))).first()
    assert row[0] == 800_002 and time.time() - began < 10


def test_confirmation_url(spark):
    pages = [
        '<a href="/get?id=1&amp;confirm=abc">go</a>',
        '<form id="download-form"><input type="hidden" name="id" value="a b"><input name="confirm" value="t&amp;"></form>',
        '<form><input name="id" value="x"></form>',
        None,
    ]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.u for r in rows.select("i", T.confirmation_url(F.col("html"), F.lit("https://host.example/get")).alias("u")).collect()}
    assert got == {0: "/get?id=1&confirm=abc", 1: "https://host.example/get?id=a+b&confirm=t%26", 2: None, 3: None}


def test_unset_variants(spark):
    rows = spark.createDataFrame([("Unset ", []), ("unset", ["x"]), ("", None), (None, [])], "s string, l array<string>")
    got = [tuple(r) for r in rows.select(T.is_unset(F.col("s")), T.is_unset(F.col("s"), strict=True), T.is_empty(F.col("l"))).collect()]
    assert got == [(True, False, True), (True, True, False), (True, True, True), (True, True, True)]
