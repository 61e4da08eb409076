"""Ranges of one array equal the whole; members are read in their archives."""

import json
import random
import zipfile

import pytest

from citeforge.sources import readers, scans

SCHEMA = "id long, text string, deep struct<a:array<struct<b:string>>>, tags array<string>"


def records(n, seed=1):
    rng = random.Random(seed)
    odd = ['"', "\\", "}", "]", "{", "[", ",", "é", "日", "\n", "\\\\", '\\"', "x" * 40, ": ", " ", "\\" * 9]
    text = lambda: "".join(rng.choices(odd, k=rng.randint(0, 12)))
    return [{"id": i, "text": text(), "deep": {"a": [{"b": text()} for _ in range(rng.randint(0, 3))]}, "tags": [text() for _ in range(rng.randint(0, 3))]} for i in range(n)]


def plain(path, chunk, n):
    """All ranges' records one after the other, without Spark."""
    inside, depth, out = False, 0, []
    for k in range(n):
        out += [json.loads(r) for r in scans._records(path, chunk, k, inside, depth)]
        inside, change = scans._effect(scans._range(path, chunk, k)[0], inside)
        depth += change
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1000, 10**6])
@pytest.mark.parametrize("ascii_", [True, False])
def test_ranges_of_any_size(tmp_path, chunk, ascii_):
    rows = records(12 if chunk < 7 else 150)
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(rows, ensure_ascii=ascii_, indent=chunk % 3 or None) + "\n", encoding="utf-8")
    assert plain(str(path), chunk, -(-path.stat().st_size // chunk)) == rows


def test_array_equals_a_multiline_read(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records(800), ensure_ascii=False), encoding="utf-8")
    want = sorted(map(str, readers.json_document(spark, f"file://{path}", SCHEMA).collect()))
    got = scans.json_array(spark, f"file://{path}", SCHEMA, chunk=3000)
    assert sorted(map(str, got.collect())) == want and len(want) == 800
    assert got.rdd.getNumPartitions() > 10


@pytest.mark.parametrize("text", ["[]", " [ ] "])
def test_empty_array(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    assert scans.json_array(spark, str(tmp_path / "a.json"), SCHEMA, chunk=2).collect() == []


def test_broken_arrays_fail(spark, tmp_path):
    for k, text in enumerate(('[{"id": 1}', '[{"id": "x', '[{"id": 1}, {"id": }]')):
        (tmp_path / f"{k}.json").write_text(text)
        with pytest.raises(Exception, match="whole array|MALFORMED|FAILFAST|Malformed"):
            scans.json_array(spark, str(tmp_path / f"{k}.json"), SCHEMA, chunk=4).collect()


def test_members_of_archives(spark, tmp_path):
    rows = records(90)
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED if k else zipfile.ZIP_STORED) as z:
            z.writestr("folder/readme.txt", "no")
            for m in range(3):
                z.writestr(f"folder/part_{m}.jsonl", "\n".join(json.dumps(r) for r in rows[m::3] if r["id"] % 2 == k) + "\n\n")
    members = scans.archive_members(spark, [str(tmp_path / "0.zip"), f"file://{tmp_path}/1.zip"], ".jsonl")
    assert members.count() == 6
    got = sorted((r.id, r.text) for r in scans.member_lines(members, SCHEMA, tasks=4).collect())
    assert got == [(r["id"], r["text"]) for r in rows]
    assert [f.name for f in tmp_path.iterdir() if f.suffix != ".zip"] == []
