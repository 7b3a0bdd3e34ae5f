"""Analysis and grades."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions import grading
from docloom.operators import analysis, sinks
from docloom.plans import dataset

CASES = {
    "Loads data": "poor",  # 2 tokens
    "loads the data.": "poor",  # 4 tokens
    "loads the raw data.": "good",  # 5 tokens
    "the value of it here.": "poor",  # no verb
    "it opens the file here now.": "average",  # no technical term; 4 of 7 are stop words
    "returns the value of a thing by it at the end": "average",  # more than half stop words
    "parse the of a x y": "good",  # exactly half
    "Configured handlers are running jobs.": "good",
    "": "poor",
}


def test_grades(spark):
    df = spark.createDataFrame([(c,) for c in CASES], "comment string")
    got = {r["comment"]: r["grade"] for r in analysis.graded(df).collect()}
    assert got == CASES


def test_tags(spark):
    df = spark.createDataFrame([("It's stored in 3 maps,\n\nquickly running on Monday. Tries boxes buses été",)], "comment string")
    a = analysis.analyzed(df).first()["comment_analysis"]
    got = list(zip(a["tokens"], a["lemmas"], a["pos_tags"], strict=True))
    assert got == [
        ("It", "it", "PRON"), ("'", "'", "PUNCT"), ("s", "s", "NOUN"), ("stored", "store", "VERB"), ("in", "in", "ADP"),
        ("3", "3", "NUM"), ("maps", "map", "VERB"), (",", ",", "PUNCT"), ("\n\n", "\n\n", "SPACE"),
        ("quickly", "quickly", "ADV"), ("running", "run", "VERB"), ("on", "on", "ADP"), ("Monday", "monday", "NOUN"),
        (".", ".", "PUNCT"), ("Tries", "try", "VERB"), ("boxes", "boxe", "NOUN"), ("buses", "buse", "NOUN"), ("été", "été", "NOUN"),
    ]
    assert [(e["text"], e["label"]) for e in a["entities"]] == [("3", "CARDINAL"), ("Monday", "DATE")]


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_lexicon_table(spark, threshold):
    """The broadcast and the shuffled join give the same analysis; one word is hot."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    text = "the " * 400 + "flurb sets the value"
    df = spark.createDataFrame([(1, text), (2, "the flurb"), (3, "")], "id long, comment string")
    lexicon = spark.createDataFrame([("flurb", "flurbo", "VERB", False), ("the", "the", "DET", True)], "word string, lemma string, pos string, is_stop boolean")
    got = {r["id"]: r for r in analysis.analyze_with_lexicon(df, lexicon, ["id"]).collect()}
    assert got[1]["n_tokens"] == 404 and got[1]["n_stop"] == 401 and got[1]["n_verbs"] == 2 and got[1]["n_tech"] == 1
    assert got[1]["tokens"][-4:] == ["flurb", "sets", "the", "value"] and got[1]["lemmas"][-4:] == ["flurbo", "set", "the", "value"]
    assert got[2]["grade"] == "poor" and got[3]["n_tokens"] == 0 and got[3]["tokens"] == []
    counted = analysis.grade_with_lexicon(df, lexicon, ["id"])
    for r in counted.collect():
        assert all(r[c] == got[r["id"]][c] for c in ("n_tokens", "n_verbs", "n_stop", "n_tech", "grade"))
    assert counted.count() == 3
    assert "ObjectHashAggregate" not in counted._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_missing_comment_is_poor(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, comment string")
    assert [(r.grade, r.counts.n_tokens) for r in analysis.graded(df).collect()] == [("poor", 0)] * 2
    assert [r.comment_analysis.tokens for r in analysis.analyzed(df).collect()] == [[], []]
    assert analysis.good_only(analysis.graded(df)).count() == 0


def test_custom_word_lists(spark):
    lexicon = grading.Lexicon(verbs=("zap",), lemmas={}, entities={}, tech_terms=("widget",), closed={"DET": ["the"]})
    df = spark.createDataFrame([("they zap the big widget",)], "comment string")
    row = analysis.graded(df, lexicon=lexicon).first()
    assert row["grade"] == "good" and row["counts"]["n_verbs"] == 1


def test_roles_agree_with_tags(spark):
    """The short way to the counts gives what the tags and lemmas say."""
    words = sorted({*grading.VERBS, *grading.IRREGULAR_LEMMAS, *grading.DEFAULT_LEXICON.stop_words})
    forms = [w + end for w in words for end in ("", "s", "es", "ed", "ing", w[-1] + "ing", "ly")]
    forms += ["3rd", "_ed", "été", "Ring", "sing", "bed", "gas", "bus", "yes", "sss", "x", "٣", "İs", "5s", "widget", "widgets"]
    custom = grading.Lexicon(verbs=("zap", "do"), lemmas={"zapt": "zap", "did": "do"}, closed={"AUX": ["do", "did"]}, tech_terms=("widget", "zap"))
    df = spark.createDataFrame([(w,) for w in forms], "comment string")
    for lexicon in (grading.DEFAULT_LEXICON, custom):
        rows = df.select(
            "comment", grading.tagged("comment", lexicon).alias("items"), grading.roles("comment", lexicon).alias("roles")
        ).collect()
        for row in rows:
            want = [
                (item["pos"] == "VERB") * grading.IS_VERB + (item["word"] in lexicon.stop_words) * grading.IS_STOP
                + (item["lemma"] in lexicon.tech_terms) * grading.IS_TECH
                for item in row["items"]
            ]
            assert row["roles"] == want, row["comment"]


def test_dataset_job_and_layout(spark, go, tmp_path):
    text = "package p\n\n// Load parses the raw data.\nfunc Load() {\n}\n\n// Bad.\nfunc Bad() {\n}\n"
    rows = dataset.dataset(go(text))
    stored = sinks.dataset_rows(rows)
    assert stored.columns == ["name", "comment", "comment_analysis", "file_name"]
    row = stored.first()
    assert (row["name"], row["file_name"]) == ("func Load() ()", "f0")
    ts = F.lit("2024-01-31 07:59:59").cast("timestamp")
    for _ in range(2):
        sinks.append_dataset(stored, str(tmp_path / "out"), ts)
    back = spark.read.json(str(tmp_path / "out"))
    assert back.count() == 2 and [r[0] for r in back.select("bucket").distinct().collect()] == ["20240131_07"]


def test_lexicon_with_homographs_and_rows_without_ids(spark):
    lexicon = spark.createDataFrame([("foo", "foo", "VERB", False), ("foo", "foo", "NOUN", False), (None, "x", "NOUN", True)], "word string, lemma string, pos string, is_stop boolean")
    df = spark.createDataFrame([(None, "foo bar"), (None, "x y z"), (1, "foo bar"), (1, "foo bar"), (2, None)], "id int, comment string")
    for rows in (analysis.grade_with_lexicon(df, lexicon, ["id"]), analysis.analyze_with_lexicon(df, lexicon, ["id"])):
        assert "_row" not in rows.columns
        counts = sorted(((r["id"] or 0, r["n_tokens"]) for r in rows.collect()))
        assert [c for c in counts if c[0] < 2] == [(0, 2), (0, 3), (1, 2), (1, 2)] and len(counts) == 5


def test_lexicon_tasks_are_bounded(spark, monkeypatch):
    """More text is more tasks, not larger ones, and the same grades."""
    rows = spark.range(400).select("id", F.concat(F.lit("return the value "), F.repeat(F.lit("parse x "), (F.col("id") % 50).cast("int"))).alias("comment"))
    lexicon = spark.createDataFrame([("value", "value", "VERB", False)], "word string, lemma string, pos string, is_stop boolean")
    want = sorted(analysis.grade_with_lexicon(rows, lexicon, ["id"]).collect())
    monkeypatch.setattr(analysis, "TASK_CHARS", 2000)
    sizes = analysis._placed(rows, ["id"], "comment").groupBy(F.spark_partition_id()).agg(F.sum(F.length("comment")).alias("n")).collect()
    assert len(sizes) > 30 and max(r["n"] for r in sizes) < 10 * 2000
    assert sorted(analysis.grade_with_lexicon(rows, lexicon, ["id"]).collect()) == want
