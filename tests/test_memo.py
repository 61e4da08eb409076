"""A pair is judged once; what failed is tried again."""

import pytest

from citeforge.operators.memo import JudgeMemo

ITEMS = [(i, f"claim {i % 7}", "span" if i % 5 else f"span {i % 3}") for i in range(60)] + [(90, "claim", None), (91, "claim", "  "), (92, None, "span")]


def judging(log, down=()):
    """A judge that writes down what it is asked; ``down`` claims fail."""

    def judge(row):
        with open(log, "a") as out:
            out.write(f"{row['claim_text']}|{row['cited_span_text']}\n")
        if row["claim_text"] in down:
            raise RuntimeError("down")
        return {"label": "entailed", "confidence": 0.5, "rationale": f"of {row['claim_text']}"}

    return judge


def calls(path):
    return open(path).read().splitlines() if path.exists() else []


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "i int, claim_text string, cited_span_text string")


def test_a_second_run_makes_no_call(spark, items, tmp_path):
    memo = JudgeMemo(spark, f"file://{tmp_path}/memo", "j1")
    pairs = {(c, s) for _, c, s in ITEMS if (s or "").strip()}
    one = {r.i: r for r in memo.label(items, judging(str(tmp_path / "a"), down={"claim 3"}), attempts=2).collect()}
    asked = calls(tmp_path / "a")
    assert len(set(asked)) == len(pairs) and len(asked) == len(pairs) + sum(c == "claim 3" for c, _ in pairs)
    assert {one[i].judge_status for i, c, _ in ITEMS[:60]} == {"labeled", "error"} and one[90].judge_status == one[91].judge_status == "skipped"
    again = {r.i: r for r in memo.label(items, judging(str(tmp_path / "b"))).collect()}
    assert {x.split("|")[0] for x in calls(tmp_path / "b")} == {"claim 3"}
    assert all(again[i].judge_status == "labeled" and again[i].from_store == (c != "claim 3") for i, c, _ in ITEMS[:60])
    last = {r.i: r for r in memo.label(items, judging(str(tmp_path / "c"))).collect()}
    assert calls(tmp_path / "c") == [] and len(last) == len(ITEMS)
    same = lambda r: (r.judge_status, r.judge_label, r.judge_confidence, r.judge_rationale)
    assert {i: same(r) for i, r in last.items()} == {i: same(r) for i, r in again.items()}
    # Another judge has answers of its own.
    JudgeMemo(spark, f"file://{tmp_path}/memo", "j2").label(items, judging(str(tmp_path / "d"))).collect()
    assert len(set(calls(tmp_path / "d"))) == len(pairs)


def test_limit_and_parallel_stores(spark, items, tmp_path):
    memo = JudgeMemo(spark, f"file://{tmp_path}/memo", "j1")
    rows = memo.label(items, judging(str(tmp_path / "a")), limit=4).collect()
    assert len(calls(tmp_path / "a")) == 4 and {r.judge_status for r in rows} == {"labeled", "pending", "skipped"}
    # Two runs that judged the same pairs at once: both versions stay, each pair has one answer.
    memo._store(memo.answers())
    assert memo.versions.newest() == 2 and memo.answers().count() == 4
    empty = memo.label(items.limit(0), judging(str(tmp_path / "e")))
    assert empty.collect() == [] and calls(tmp_path / "e") == []
