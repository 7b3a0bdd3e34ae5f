"""Splits, shuffles, batches, encoding, evaluation and the recipe."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import evaluation, features, ordering, recipe


@pytest.mark.parametrize("n", [1, 7, 10, 1000, 12_345])
def test_positional_split(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 100_003).alias("k"))
    got = ordering.positional_split(df, ["k"])
    late = sorted(r["k"] for r in got.filter("split = 'validation'").collect())
    keys = sorted(i * 7919 % 100_003 for i in range(n))
    assert late == keys[n - math.ceil(0.1 * n):]


def test_split_by_two_columns_with_a_hot_path(spark, monkeypatch):
    """One path holds most rows; several rounds are needed to reach the cut."""
    monkeypatch.setattr(ordering, "SMALL_RANGE", 20)
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("p"), "id")).alias("path"), F.col("id").alias("pos"))
    late = ordering.positional_split(df, ["path", "pos"], 0.5).filter("split = 'validation'")
    want = sorted((r["path"], r["pos"]) for r in df.collect())[2500:]
    assert sorted((r["path"], r["pos"]) for r in late.collect()) == want


def test_keys_that_do_not_identify_rows_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_RANGE", 20)
    with pytest.raises(ValueError):
        ordering.positional_split(spark.range(1000).select(F.lit("same").alias("k")), ["k"])


def test_empty_split(spark):
    assert ordering.positional_split(spark.range(0).withColumnRenamed("id", "k"), ["k"]).count() == 0


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    got = [(r["k"], r["position"]) for r in ordering.with_position(df, ["k"]).collect()]
    assert sorted(got) == [(k, i) for i, k in enumerate(sorted(i * 37 % 1009 for i in range(1000)))]


def test_shuffle_is_a_seeded_permutation(spark):
    df = ordering.with_epochs(spark.range(500), 3)
    one, again, other = (
        {(r["epoch"], r["id"]): r["position"] for r in ordering.with_shuffled_position(df, "id", seed, "epoch").collect()}
        for seed in (1, 1, 2)
    )
    assert one == again != other
    for epoch in range(3):
        assert sorted(p for (e, _), p in one.items() if e == epoch) == list(range(500))
    assert [one[0, i] for i in range(500)] != [one[1, i] for i in range(500)]
    batches = ordering.with_batch(ordering.with_shuffled_position(spark.range(20), "id")).groupBy("batch").count()
    assert sorted(map(tuple, batches.collect())) == [(0, 8), (1, 8), (2, 4)]


def test_plan(spark):
    counts = spark.createDataFrame([("train", 107), ("validation", 13)], "split string, n long")
    row = ordering.training_plan(counts, epochs_done=20).first().asDict()
    assert row["train_steps"] == 13 and row["validation_steps"] == 2 and row["epochs"] == 40
    assert row["total_steps"] == 520 and row["warmup_steps"] == 104


def test_row_window(spark, monkeypatch):
    df = spark.range(3000).withColumn("k", F.lit(5000) - F.col("id"))
    for limit in (10, 100_000):
        monkeypatch.setattr(ordering, "SMALL_RANGE", limit)
        for start in (0, 1, 5, 500, 2990, 4000):
            got = [(r["row_no"], r["k"]) for r in ordering.row_window(df, ["k"], start, 50).orderBy("row_no").collect()]
            low = max(start, 1)
            assert got == [(n, 2000 + n) for n in range(low, min(start + 50, 3000) + 1)]


def test_random_split_is_exact(spark):
    got = ordering.split_counts(ordering.random_split(spark.range(101), "id"))
    assert dict(map(tuple, got.collect())) == {"train": 80, "validation": 21}


def test_encoding(spark):
    texts = spark.createDataFrame(
        [(1, "b a a", "x " * 200), (2, "", ""), (3, "zzz a", "b")], "id long, input string, target string"
    )
    words = features.build_vocabulary(texts.filter("id <> 3"), ["input", "target"])
    assert [tuple(r) for r in words.orderBy("token_id").collect()] == [("x", 4, 200), ("a", 5, 2), ("b", 6, 1)]
    got = {r["id"]: r for r in features.encode(texts, "id", words).collect()}
    assert len(got) == 3
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == 48 and len(r["labels"]) == 128 for r in got.values())
    assert got[1]["input_ids"][:6] == [1, 6, 5, 5, 2, 0] and got[1]["labels"] == [1] + [4] * 126 + [2]
    assert got[2]["input_ids"][:3] == [1, 2, 0] and got[2]["labels"][:3] == [1, 2, -100]
    assert got[3]["input_ids"][:5] == [1, 3, 5, 2, 0] and sum(got[3]["attention_mask"]) == 4
    counted = features.label_counts(features.encode(texts, "id", words).withColumn("batch", F.lit(0))).first()
    assert counted["n_labels"] == 128 + 2 + 3
    cut = features.build_vocabulary(texts, ["input", "target"], size=5)
    assert [r["token"] for r in cut.collect()] == ["x"]


def test_first_tokens_are_the_first_of_all_tokens(spark):
    texts = ["", " ", "\n", "a", "  a\n\n b ,c", "é_1 x\t\x0b.\r\n\n..y", "x " * 500, "\n \n \n a", "a\u00a0b \u2003c 😀d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 5, 126):
        rows = df.select(
            features.first_tokens(F.col("t"), n).alias("head"), F.slice(features.encoder_tokens(F.col("t")), 1, n).alias("cut")
        ).collect()
        assert all(r["head"] == r["cut"] for r in rows)


def test_encoding_shuffles_once(spark):
    """After the placement by id nothing is exchanged again but the broadcast."""
    texts = spark.range(100).select("id", F.lit("a b").alias("input"), F.lit("c").alias("target"))
    words = features.build_vocabulary(texts, ["input", "target"])
    plan = features.encode(texts, "id", words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1


def test_versions_and_batches(spark):
    rows = spark.createDataFrame([("func A() ()", "A does."), ("bad", "x")], "name string, comment string")
    matrix = evaluation.with_versions(rows, 3)
    assert matrix.count() == 6 and evaluation.with_versions(rows, 0).count() == 0

    def load(version):
        def model(texts):
            if "bad" in texts and version == 2:
                raise RuntimeError("no answer")
            return ["A does." if version == 3 else text for text in texts]

        return model

    replies = evaluation.predict_in_batches(matrix, load).cache()
    failed = replies.filter("error IS NOT NULL").collect()
    assert [(r["name"], r["version"], r["predicted"], r["error"]) for r in failed] == [("bad", 2, None, "no answer")]
    assert replies.filter("elapsed_ms < 0").count() == 0
    scores = {r["version"]: r for r in evaluation.version_scores(replies).collect()}
    assert scores[3]["exact_rate"] == 0.5 and scores[1]["exact_rate"] == 0.0 and scores[2]["n"] == 2


def test_a_model_is_loaded_once_per_process_and_version(spark, tmp_path):
    folder = str(tmp_path)

    def load(version):
        import os
        import uuid

        with open(f"{folder}/{os.getpid()}-{version}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts: texts[1:] if len(texts) > 1 else texts

    rows = evaluation.with_versions(spark.range(400).select(F.col("id").cast("string").alias("name")).repartition(20), 2)
    replies = evaluation.predict_in_batches(rows, load)
    assert replies.filter("predicted = name AND error IS NULL").count() == 800
    loads = [f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) >= 2


def test_word_f1(spark):
    cases = [("a b", "a c", 0.5), ("", "", 1.0), (None, "a", 0.0), ("A a B", "a b", 1.0)]
    df = spark.createDataFrame([(p, e) for p, e, _ in cases], "p string, e string")
    assert [r[0] for r in df.select(evaluation.word_f1(F.col("p"), F.col("e"))).collect()] == [c[2] for c in cases]


def test_losses(spark):
    steps = spark.range(1000).select((F.col("id") % 2).alias("epoch"), F.lit("train").alias("phase"), F.col("id").alias("step"), (F.col("id") * 0.5).alias("loss"))
    curve = {r["step"]: r["running_loss"] for r in evaluation.running_losses(steps).collect()}
    for step in (0, 1, 2, 500, 998, 999):
        earlier = [i * 0.5 for i in range(step % 2, step + 1, 2)]
        assert curve[step] == pytest.approx(sum(earlier) / len(earlier))
    means = {r["epoch"]: r["mean_loss"] for r in evaluation.epoch_losses(steps).collect()}
    assert means == {0: 249.5, 1: 250.0}
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [5, -100, 6])], "l array<double>, y array<int>")
    assert df.select(evaluation.batch_loss(F.col("l"), F.col("y"))).first()[0] == 5.0 / 2


def test_losses_keep_rows_without_epoch_phase_or_step(spark):
    rows = [(0, "train", 1, 1.0), (0, "train", 2, 3.0), (None, "train", 1, 5.0), (0, None, 1, 7.0), (0, None, None, 9.0), (None, None, None, 2.0)]
    steps = spark.createDataFrame(rows, "epoch int, phase string, step int, loss double")
    got = {(r.epoch, r.phase, r.step): r.running_loss for r in evaluation.running_losses(steps).collect()}
    assert got == {
        (0, "train", 1): 1.0, (0, "train", 2): 2.0, (None, "train", 1): 5.0, (0, None, None): 9.0, (0, None, 1): 8.0, (None, None, None): 2.0,
    }


def test_a_null_epoch_is_shuffled_too(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(20)], "id long, epoch int")
    got = ordering.with_shuffled_position(df, "id", epoch="epoch").collect()
    for epoch in (None, 1):
        assert sorted(r.position for r in got if r.epoch == epoch) == list(range(10))


def test_encoding_keeps_the_other_side_and_every_row(spark):
    rows = [(1, "a b", None), (2, None, "a b"), (3, "a", "b"), (3, "b", "a"), (3, "b", "a"), (None, "a", "a"), (4, None, None)]
    df = spark.createDataFrame(rows, "id long, input string, target string")
    words = features.build_vocabulary(df, ["input", "target"])
    assert {r.token: (r.token_id, r.n) for r in words.collect()} == {"a": (4, 7), "b": (5, 5)}
    assert {r.token for r in features.build_vocabulary(df, ["input", "target"], 5).collect()} == {"a"}
    got = [(r.id, [x for x in r.input_ids if x > 3], [x for x in r["labels"] if x > 3]) for r in features.encode(df, "id", words).collect()]
    want = [(1, [4, 5], []), (2, [], [4, 5]), (3, [4], [5]), (3, [5], [4]), (3, [5], [4]), (None, [4], [4]), (4, [], [])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert df.filter("id = 1").select(features.model_input(F.col("input"), F.col("target"))).first()[0] == "a b"


def test_a_batch_without_labels_has_no_loss(spark):
    df = spark.createDataFrame([([1.0], [-100])], "l array<double>, y array<int>")
    assert df.select(evaluation.batch_loss(F.col("l"), F.col("y"))).first()[0] is None


def test_forest(spark, tmp_path):
    df = spark.range(200).select("id", F.array((F.col("id") % 2).cast("float"), F.lit(1.0).cast("float")).alias("e"), (F.col("id") % 2).alias("y"))
    model, predictions = recipe.fit_forest(df, "e", "y", "id", trees=3)
    assert predictions.count() == 40 and predictions.filter("label <> prediction").count() == 0
    recipe.save_model(model, str(tmp_path / "m"))
    x, y = recipe.split_target(df, "y")
    assert x.columns == ["id", "e"] and y.columns == ["y"]


def test_version_intervals_hold_the_difference(spark):
    from docloom.operators.evaluation import bootstrap_weights, version_intervals

    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = [f"w{i}x{k}" for k in range(10)]
        for version, kept in ((1, 5), (2, rng.choice([4, 5, 6])), (3, rng.choice([5, 6, 7]))):
            rows.append((i, version, " ".join(text), " ".join(text[:kept])))
    rows += [(900, 1, "a b", None), (901, 2, "a b", "a")]
    df = spark.createDataFrame(rows, "id int, version int, comment string, predicted string")
    found = {r["version"]: r for r in version_intervals(df, ["id"]).collect()}
    assert set(found) == {2, 3} and found[2]["n"] == found[3]["n"] == 400
    assert found[2]["low"] < 0 < found[2]["high"] and 0 < found[3]["low"] < found[3]["difference"] < found[3]["high"]
    weights = [w for r in spark.range(200).select(bootstrap_weights([F.col("id")], 100, 1).alias("w")).collect() for w in r["w"]]
    assert abs(sum(weights) / len(weights) - 1) < 0.03 and abs(sum(w == 0 for w in weights) / len(weights) - 0.368) < 0.02


def test_batches_encode_once(spark):
    """Counting for the positions does not look into the vocabulary again."""
    from docloom.plans import training

    looked_up = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(token):
        looked_up.add(1)
        return True

    rows = spark.createDataFrame([(i, f"a w{i % 5}", f"b w{i % 3}") for i in range(40)], "id long, input string, target string")
    words = spark.createDataFrame([(w, n + 4) for n, w in enumerate(["a", "b", "w0", "w1", "w2", "w3"])], "token string, token_id int")
    plain = training.training_batches(rows, "id", words, epochs=2).select("epoch", "id", "position", "input_ids").collect()
    counted = training.training_batches(rows, "id", words.filter(seen("token")), epochs=2).select("epoch", "id", "position", "input_ids").collect()
    assert sorted(counted) == sorted(plain) and sorted(r["position"] for r in plain if r["epoch"] == 1) == list(range(40))
    assert looked_up.value == words.count()


def test_encoding_places_texts_not_tokens(spark, capsys):
    rows = spark.createDataFrame([(1, "a b", "c d")], "id long, input string, target string")
    words = spark.createDataFrame([("a", 4)], "token string, token_id int")
    features.encode(rows, "id", words).explain()
    plan = capsys.readouterr().out
    assert "regexp_extract_all" in plan and "regexp_extract_all" not in plan[plan.index("REPARTITION_BY_COL"):]
