"""Readers, writers, listings, archives and the code host."""

from __future__ import annotations

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import extract, filters, rewrite, sinks
from docloom.sources import code_host, files, listings, web_archive
from docloom.streaming import incremental


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "vendor" / "proj"
    for path in ["a.go", "x/b.go", "x/b_test.go", "x/c_example.go", "vendor/d.go", "x/vendor/y/e.go", "x/readme.md"]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(f"package p\n\n// {path} loads the raw data.\nfunc F() {{\n}}\n")
    return root


def test_scan(spark, tree):
    df = files.scan_go_files(spark, str(tree))
    assert sorted(r["path"] for r in df.collect()) == ["a.go", "vendor/d.go", "x/b.go", "x/b_test.go", "x/c_example.go", "x/vendor/y/e.go"]
    assert sorted(r["path"] for r in filters.corpus_files(df).collect()) == ["a.go", "x/b.go"]
    assert sorted(r["path"] for r in filters.generator_files(df).collect()) == ["a.go", "x/b.go", "x/c_example.go"]
    one = files.scan_go_files(spark, [str(tree / "x"), str(tree / "a.go")])
    assert {os.path.basename(r["path"]) for r in one.collect()} == {"a.go", "b.go", "b_test.go", "c_example.go", "e.go"}
    assert extract.function_pairs(filters.corpus_files(df)).count() == 2


def test_text_measures(spark):
    df = spark.createDataFrame([("a\nb\n", "x/a.b.go"), ("", "a.go"), ("a", "x/.go"), ("\n", "noext")], "c string, p string")
    got = df.select(text.line_count(F.col("c")), text.file_stem(F.col("p")), text.directory(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(3, "a.b", "x"), (1, "a", "."), (1, ".go", "x"), (2, "noext", ".")]


ROW = {"name": "func A() ()", "comment": "A does.\n", "comment_analysis": {"tokens": ["A"], "lemmas": ["a"], "pos_tags": ["NOUN"], "entities": [["3", "CARDINAL"]]}, "file_name": "f"}


def test_dataset_lines(spark, tmp_path):
    lines = [json.dumps({**ROW, "name": f"n{i}"}) if i % 10 else "{broken" for i in range(120)]
    (tmp_path / "d.jsonl").write_text("\n".join(lines) + "\n")
    parsed = files.read_dataset_lines(spark, str(tmp_path / "d.jsonl"))
    assert files.valid_rows(parsed).count() == 108 and files.rejected_rows(parsed).count() == 12
    assert files.rejected_rows(parsed).first()["error"] == "{broken"
    from docloom.operators.ordering import row_window

    order = ["source", "block", "line"]
    first = files.valid_rows(row_window(parsed, order)).orderBy("row_no").collect()
    assert [r["name"] for r in first] == [f"n{i}" for i in range(50) if i % 10]
    later = files.valid_rows(row_window(parsed, order, start=41)).collect()
    assert {r["name"] for r in later} == {f"n{i}" for i in range(40, 91) if i % 10}
    assert files.read_dataset(spark, str(tmp_path / "d.jsonl")).filter("name = 'n1'").first()["comment_analysis"]["entities"] == [["3", "CARDINAL"]]


def test_newest_dataset(spark, tmp_path):
    for i, name in enumerate(["functions_dataset_1.jsonl", "functions_dataset_2.jsonl", "other.jsonl", "functions_dataset_3.txt"]):
        path = tmp_path / name
        path.write_text(json.dumps({**ROW, "name": name}) + "\n")
        os.utime(path, (1_700_000_000 + i * 100 - (150 if i == 1 else 0),) * 2)
    assert files.read_newest_dataset(spark, str(tmp_path), "functions_dataset").first()["name"] == "functions_dataset_1.jsonl"
    assert files.read_newest_dataset(spark, str(tmp_path)).first()["name"] == "other.jsonl"
    with pytest.raises(FileNotFoundError):
        files.read_newest_dataset(spark, str(tmp_path), "none")


def test_versions(spark):
    names = ["checkpoint-tf-2", "checkpoint-tf-10", "checkpoint-tf-x", "checkpoint-99", "checkpoint-tf-77"]
    df = spark.createDataFrame([(n, n != "checkpoint-tf-77") for n in names], "name string, is_dir boolean")
    assert listings.require_version(df) == 10
    with pytest.raises(ValueError):
        listings.require_version(df.filter("name = 'checkpoint-99'"))


def test_csv_round_trip(spark, tmp_path):
    pairs = spark.createDataFrame([("func A(a int) ()", 'says "hi",\nthen\n'), ("b", "c")], "name string, comment string")
    sinks.write_pairs_csv(pairs, str(tmp_path / "csv"))
    back = files.read_table_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, pairs.collect()))


def test_distinct_append_and_json(spark, tmp_path):
    rows = spark.read.schema(files.DATASET_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(ROW)] * 3))
    ts = F.lit("2024-01-31 07:59:59").cast("timestamp")
    sinks.append_dataset(rows, str(tmp_path / "a"), ts, distinct=True)
    assert spark.read.json(str(tmp_path / "a")).count() == 1
    sinks.write_json(rows, str(tmp_path / "j"))
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    sinks.show(rows)


def test_rewritten_files_go_elsewhere(spark, go, tmp_path):
    done = rewrite.commented(go("package p\n\nfunc A() {\n}\n", "package p\n"))
    sinks.write_files(done, str(tmp_path / "changed"))
    sinks.write_files(done, str(tmp_path / "all"), only_changed=False)
    assert spark.read.parquet(str(tmp_path / "changed")).count() == 1
    assert spark.read.parquet(str(tmp_path / "all")).count() == 2


def test_archive(spark, tmp_path):
    def record(kind, uri, body):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\n\r\n{body}\r\n\r\n"

    page = "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>one\n\n```go\nfunc A() {}\n``` é ```go x``` ```go open"
    text_ = record("warcinfo", "", "software: x") + record("request", "http://a", "GET / HTTP/1.1") + record("response", "http://a", page)
    text_ += record("response", "http://b", "HTTP/1.1 200 OK\r\n\r\nnone") + record("response", "http://c", "plain ```go y```")
    (tmp_path / "x.warc").write_bytes(text_.encode())
    records = web_archive.read_warc(spark, str(tmp_path / "x.warc"))
    assert records.count() == 5
    answers = web_archive.responses(records)
    assert answers.count() == 3
    got = extract.fenced_snippets(answers).orderBy("url", "pos").select("url", "pos", "snippet").collect()
    assert [tuple(r) for r in got] == [("http://a", 0, "\nfunc A() {}\n"), ("http://a", 1, " x"), ("http://c", 0, " y")]
    lists = {r["url"]: r["snippets"] for r in extract.snippet_lists(answers).collect()}
    assert lists["http://b"] == [] and len(lists["http://a"]) == 2
    answers.write.parquet(str(tmp_path / "landed"))
    assert web_archive.read_archive_table(spark, str(tmp_path / "landed"), "parquet").count() == 3


def test_long_fence(spark):
    body = "```go" + "x\n" * 500_000 + "```"
    df = spark.createDataFrame([(body,)], "payload string")
    assert len(extract.fenced_snippets(df).first()["snippet"]) == 1_000_000


def test_code_host(spark, tmp_path):
    search = {"items": [{"name": f"r{i}", "owner": {"login": "o"}, "language": "Go" if i % 2 else "C", "stargazers_count": i} for i in range(10)]}
    (tmp_path / "s.json").write_text(json.dumps(search, indent=2))
    repos = code_host.read_search(spark, str(tmp_path / "s.json"))
    assert [r["repo"] for r in code_host.top_repositories(repos, page=2, per_page=2).collect()] == ["r5", "r3"]
    blob = base64.encodebytes("package é\n".encode() * 20).decode()
    listing = spark.createDataFrame(
        [("o", "r9", json.dumps([{"name": "a.go", "path": "x/a.go"}, {"name": "b.md", "path": "b.md"}, {"name": "c.go", "path": "c.go"}])),
         ("o", "r8", json.dumps([{"name": "z.go", "path": "z.go"}]))], "owner string, repo string, body string")
    answers = spark.createDataFrame(
        [("o", "r9", "x/a.go", json.dumps({"encoding": "base64", "content": blob})),
         ("o", "r9", "c.go", json.dumps({"encoding": "none", "content": ""})),
         ("o", "r8", "z.go", json.dumps({"encoding": "base64", "content": blob}))], "owner string, repo string, path string, body string")
    got = code_host.repository_files(code_host.top_repositories(repos), listing, answers).collect()
    assert [(r["repo"], r["path"], r["content"]) for r in got] == [("r9", "x/a.go", "package é\n" * 20)]
    trees = spark.createDataFrame([("r", json.dumps({"tree": [{"path": "a/b.go"}, {"path": "a"}]}))], "repo string, body string")
    assert [tuple(r) for r in code_host.tree_listing(trees).collect()] == [("r", "a/b.go")]
    assert files.files_from_rows(spark, [("r", "p.go", "package p\n")]).columns == ["repo", "path", "content"]


def test_incremental_run(spark, tmp_path):
    landing, out, state = (str(tmp_path / d) for d in ("landing", "out", "state"))

    def land(name):
        text_ = f"package p\n\n// {name} loads the raw data.\nfunc {name}() {{\n}}\n"
        spark.createDataFrame([(f"{name}.go", text_)], incremental.LANDED_SCHEMA).write.mode("append").parquet(landing)

    land("A")
    incremental.run_available(incremental.landed_files(spark, landing), out, state)
    land("B")
    for _ in range(2):
        incremental.run_available(incremental.landed_files(spark, landing), out, state)
    assert sorted(r["file_name"] for r in spark.read.json(out).collect()) == ["A", "B"]


def test_append_once(spark, tmp_path):
    folder = str(tmp_path / "once")
    schema = "name string, comment string, tags array<string>"
    rows = spark.createDataFrame([("a", "x", ["t"]), ("a", "x", ["t"]), ("b", None, None), (None, "", []), ("c", "\\u2028 é\n", [None])], schema)
    hour = F.lit("2024-01-31 07:30:00").cast("timestamp")

    def held():
        return sorted((tuple(r) for r in spark.read.schema(schema).json(folder).drop("bucket").collect()), key=str)

    want = sorted((tuple(r) for r in rows.collect()), key=str)
    sinks.append_once(rows, folder, hour)
    assert held() == want
    sinks.append_once(rows, folder, hour)
    assert held() == want
    # A run that broke off: one file is missing, one line was not written to its end.
    parts = sorted((tmp_path / "once" / "bucket=20240131_07").glob("part-*.json"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    for p in parts:
        p.write_text("")
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
    parts[0].write_text("\n".join(lines[:2]) + "\n" + lines[2][:9])
    sinks.append_once(rows, folder, hour)
    assert [r for r in held() if any(v is not None for v in r)] == want
    other = F.lit("2024-01-31 09:00:00").cast("timestamp")
    sinks.append_once(rows, folder, other, distinct=True)
    assert len([r for r in held() if any(v is not None for v in r)]) == 9
