"""How CPU-bound work is dealt over tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import config, filters
from docloom.plans import commenter, corpus, queries
from docloom.session import spread

DATA = "/root/testdata/sf0.001"


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file has more splits than cores, and all rows in one of them."""
    path, key = str(tmp_path / "rows"), "spark.sql.files.maxPartitionBytes"
    spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() > 8
        sizes = [r["count"] for r in spread(rows, "id").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == 4000 and max(sizes) <= 1000
    even = spark.range(0, 4000, 1, 8)
    assert spread(even, "id") is even


def test_rendered_files_are_dealt(spark, monkeypatch):
    """Narrow parts give a bounded number of files a task, and no path is tested part by part."""
    monkeypatch.setattr(corpus, "TASK_PARTS", 10)
    part = corpus.table(spark, DATA, "part")
    for files in (corpus.function_files(part), corpus.declaration_files(part)):
        sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) * 10 == part.count() and len(sizes) > 8
    plan = filters.generator_files(corpus.function_files(part))._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "vendor" in above and "vendor" not in below


def test_append_runs_share_one_job(spark, monkeypatch):
    """The rows that are appended are read from a table; the files are parsed once."""
    plans = []
    monkeypatch.setattr(queries.sinks, "append_once", lambda rows, *_: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()))
    assert queries.QUERIES["idempotent_append"](spark, DATA).count() > 0
    assert len(plans) == 2 and not any("regexp_extract_all" in plan for plan in plans)


def test_files_of_one_folder_are_dealt(spark, monkeypatch):
    """All files lie in one folder, which is the key of the join with its configuration."""
    monkeypatch.setattr(commenter, "TASK_FILES", 10, raising=False)
    path = F.concat(F.lit("repo/f"), F.col("id"), F.lit(".go"))
    files = spark.range(200).select(path.alias("path"), F.lit("package p\n\nfunc A() {}\n").alias("content"))
    none = spark.createDataFrame([], "path string, content string")
    placed = commenter.configured_files(files, config.parse_config(none), config.module_dirs(none))
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200 and len(sizes) > 8
