import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citeforge.sources import readers, writers
from citeforge.streaming import audit


def test_json_lines_round_trip(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"b": 1, "a": "é"}\n\n{"a": null, "b": 2}\n')
    df = readers.json_lines(spark, str(tmp_path / "in.jsonl"), "b long, a string")
    assert df.count() == 2
    writers.write_json_lines(df, str(tmp_path / "out"))
    lines = sorted(line for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines())
    assert lines == ['{"a":"é","b":1}', '{"a":null,"b":2}']
    (tmp_path / "bad.jsonl").write_text('{"b": 1}\n{oops\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), "b long, a string").collect()


def test_canonical_json_sorts_nested_fields(spark):
    df = spark.sql("select array(named_struct('z', 1, 'a', named_struct('y', 2, 'b', 3))) as v, 'x' as k")
    assert df.select(writers.canonical_json(df)).first()[0] == '{"k":"x","v":[{"a":{"b":3,"y":2},"z":1}]}'


def test_archives(spark, tmp_path):
    records = [{"_id": "q1", "question": "Who?", "answer": "x", "supporting_facts": [["T", 0]], "context": [["T", ["One.", "Two."]], ["U", []]]}]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data_ids/dev.json", json.dumps(records))
        z.writestr("dev.json", "[]")
    path = readers.extract_member(str(tmp_path / "a.zip"), "dev", str(tmp_path))
    row = readers.qa_records(readers.json_document(spark, path, readers.QA_RECORD)).first()
    assert row.question_id == "q1" and row.context[0].sentences == ["One.", "Two."] and row.facts[0].sentence_index == 0
    with pytest.raises(ValueError):
        readers.member_name(["x_dev.json", "y_dev.json"], "dev")


def test_files_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert readers.file_digests(spark, str(tmp_path / "f.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()
    (tmp_path / ".env").write_text("# note\nKEY='v'\nOTHER=1\n")
    monkeypatch.setenv("OTHER", "2")
    assert readers.settings(str(tmp_path / ".env"), ["KEY", "OTHER", "NONE"]) == {"KEY": "v", "OTHER": "2", "NONE": ""}
    (tmp_path / "c.yaml").write_text("# c\nversion: 1\nname: a b\nlist:\n  - x\n")
    found = readers.flat_yaml(spark.read.text(str(tmp_path / "c.yaml")))
    assert {tuple(r) for r in found.collect()} == {("version", "1"), ("name", "a b"), ("list", "")}
    assert readers.read_if_exists(spark, str(tmp_path / "none"), "run_id string").count() == 0


def test_csv_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    writers.write_csv(df, str(tmp_path / "c"), ["b", "lost", "a"])
    rows = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert rows.columns == ["b", "lost", "a"] and rows.count() == 2
    assert writers.report(df.orderBy("a"), ["a", "b"]).splitlines()[2:] == ["| 1 |  |", "| 2 | x |"]
    with pytest.raises(ValueError):
        writers.report(spark.range(5), ["id"], most=3)
    assert json.loads(writers.summary(df.orderBy("a"))) == {"a": 1, "b": None}


def test_streaming_audit_equals_batch(spark, tmp_path):
    ledger = spark.createDataFrame([("d", "s", "v", "p", "h")], "dataset_id string, source_id string, snapshot_hash string, span_id string, span_hash string")
    cited = spark.createDataFrame([(1, "d/s/v/p/h"), (2, "d/s/v/p/x"), (3, "no")], "i int, citation_id string")
    got = cited.where("i = 1").select("citation_id")
    cited.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cited.schema).parquet(str(tmp_path / "in"))
    query = audit.stream_audit(stream, ledger, got, str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    want = audit.validate(cited, ledger, got)
    assert {(r.i, r.validator_status) for r in out.collect()} == {(r.i, r.validator_status) for r in want.collect()}


def test_windowed_errors(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:30' + make_interval(0,0,0,0,0,cast(id as int)) as ts, 'none' as validation_error from range(30)").write.parquet(str(tmp_path / "w"))
    stream = spark.readStream.schema("ts timestamp, validation_error string").parquet(str(tmp_path / "w"))
    query = audit.windowed_errors(stream, "ts").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r.n for r in spark.table("windows").collect()) == [10, 10, 10]


def test_tagged_union_and_pending(spark):
    a, b = spark.range(2), spark.range(1).withColumn("x", F.lit(1))
    assert {(r.dataset_id, r.id, r.x) for r in readers.tagged_union({"m__1": a, "n__2": b}).collect()} == {("m", 0, None), ("m", 1, None), ("n", 0, 1)}
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert [r.run_id for r in audit.pending(runs, runs.limit(1).where("run_id = 'a'")).collect()] == ["b"]


def test_first_member_of_several(tmp_path):
    names = ["a/x_train.jsonl", "b/y_train.jsonl"]
    assert readers.member_name(names, "train", ".jsonl", first=True) == names[0]
    with pytest.raises(ValueError, match="2 members"):
        readers.member_name(names, "train", ".jsonl")


def test_only_record(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert readers.only_record(rows, "k", "b").first().v == 2
    with pytest.raises(ValueError, match="no record"):
        readers.only_record(rows, "k", "z")


def test_csv_with_a_discovered_header(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("b", "1"), ("a", "2")]), (2, [("c", "3"), ("label", "x")]), (3, [("a", "0"), ("a", "4")])], "n int, cells array<struct<key:string,value:string>>")
    header = writers.write_discovered_csv(rows, "n", f"{tmp_path}/out", ["label"])
    assert header == ["b", "a", "c", "label"]
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert back.columns == header and sorted((r.a or "", r.c or "", r.label or "") for r in back.collect()) == [("", "3", "x"), ("2", "", ""), ("4", "", "")]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1)], "run_id string, n int")
    paths = writers.write_artifacts(rows, rows.select("n"), rows.limit(0), f"{tmp_path}/run")
    assert readers.json_lines(spark, paths["run_records"], "run_id string, n int").collect() == rows.collect()
    assert readers.json_lines(spark, paths["failures"], "run_id string, n int").count() == 0
    writers.write_json_rows(rows, f"{tmp_path}/plain")
    assert spark.read.text(f"{tmp_path}/plain").first().value == '{"run_id":"r","n":1}'


def test_all_artifacts_of_a_run_in_one_pass(spark, tmp_path):
    """The input is evaluated once: a counter in it sees each row once."""
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    rows = spark.createDataFrame([(i, "ok" if i % 4 else "failed", None if i % 3 else "é") for i in range(40)], "n long, status string, text string").mapInPandas(count, "n long, status string, text string")
    folder = f"file://{tmp_path}/run"
    totals = {"runs": F.count(F.lit(1)), "failures": F.count_if(F.col("status") == "failed"), "n": F.sum("n")}
    found = writers.write_run(rows, folder, F.col("status") == "failed", totals)
    assert found == {"runs": 40, "failures": 10, "n": 780} and seen.value == 40
    assert json.loads((tmp_path / "run/summary.json").read_text()) == found
    lines = lambda name: sorted(json.loads(r.value)["n"] for r in spark.read.text(f"{folder}/artifact={name}").collect())
    assert lines("run_records") == list(range(40)) and lines("failures") == list(range(0, 40, 4))
    assert spark.read.text(f"{folder}/artifact=failures").first()[0].startswith('{"n":')
    writers.write_run(rows.where("n < 0"), folder, F.col("status") == "failed", totals)  # over the old ones
    assert json.loads((tmp_path / "run/summary.json").read_text())["runs"] == 0
