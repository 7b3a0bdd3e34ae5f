"""Unified patches, applied by another tool and by the library."""

from __future__ import annotations

import random
import subprocess

from pyspark.sql import functions as F

from docloom.functions import patches
from docloom.operators import rewrite


def applied(tmp_path, path, text, patch):
    """The file after ``git apply``, which checks every header and context line."""
    (tmp_path / path).write_bytes(text.encode())
    subprocess.run(["git", "apply", "--whitespace=nowarn", "-"], input=patch.encode(), cwd=tmp_path, check=True)
    return (tmp_path / path).read_bytes().decode()


def test_patches_lead_to_the_commented_files(go, tmp_path):
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    far = "\n".join(f"\t_ = {i}" for i in range(9))
    texts = [
        "package p\n\nfunc A(x int) {}\n",
        f"package p\n\nfunc A() {{\n{far}\n}}\n\nfunc B() {{\n{far}\n}}\n\nvar c = 1\nvar d = 2\n\n// E is known.\ntype E int\n\nconst (\n\tF = 1\n\tG = 2\n)",
        "package p; var a = 1; func B() {}\n",
        "package p\r\n\r\nvar a = 1\r\n",
        "package p\n\nvar last = 1",
    ]
    files = go(*texts)
    want = {r["path"]: r["new_content"] for r in rewrite.commented(files, signature=F.lit("me")).collect()}
    rows = rewrite.patched(rewrite.file_patches(files, signature=F.lit("me"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["new_content"] == want[r["path"]]
        assert applied(tmp_path, r["path"], r["content"], r["patch"]) == want[r["path"]]
    # Changes before lines 3, 15, 27, 28, 34 and 35: gaps of 12 lines cut, one of 6 does not.
    assert next(r["patch"] for r in rows if r["path"] == "f1.go").count("@@ -") == 3
    assert rewrite.file_patches(go("package p\n\n// A is known.\nvar A = 1\n", "no go")).count() == 0


def test_random_insertions(spark, tmp_path):
    subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    rng = random.Random(6)
    rows = []
    for i in range(60):
        lines = [rng.choice(["", "x", "- y", "+ z", "@@ -1 +1 @@", " b"]) for _ in range(rng.randrange(1, 40))] + ["end"]
        text = "\n".join(lines) + rng.choice(["", "\n"])
        at = sorted(rng.sample(range(1, len(lines) + 1), rng.randrange(0, min(6, len(lines)) + 1)))
        changes = [(k, "".join(rng.choice(["new\n", "\n", "+\n"]) for _ in range(rng.randrange(1, 4)))) for k in at]
        rows.append((f"r{i}.txt", text, changes))
    df = spark.createDataFrame(rows, "path string, content string, changes array<struct<line: int, text: string>>")
    made = df.withColumn("patch", patches.insertion_patch(F.col("path"), F.col("content"), F.col("changes")))
    for r in rewrite.patched(made).collect():
        lines = r["content"].split("\n")
        for k, text in reversed(r["changes"]):
            lines[k - 1 : k - 1] = text[:-1].split("\n")
        assert r["new_content"] == "\n".join(lines)
        if r["changes"]:
            assert applied(tmp_path, r["path"], r["content"], r["patch"]) == "\n".join(lines)


def test_a_patch_that_does_not_fit(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n a\n+n\n c\n"), ("a\n", "")], "content string, patch string")
    assert [r["new_content"] for r in rewrite.patched(df).collect()] == [None, "a\n"]
