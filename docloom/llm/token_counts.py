"""Token counts through a digest cache: equal contents are encoded once, ever."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 1 << 20
CACHE = T.StructType(
    [T.StructField("content", T.BinaryType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())]
)


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: another file is another tokenizer."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def load_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of tokens by the file's own library: ``.json`` or ``.model``.

    No begin, end or added special tokens, no truncation, no padding.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    raise ValueError(f"no library for {path}")


def read_cache(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer, one row for each content; a missing folder is empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE).drop("tokenizer")
    rows = spark.read.schema(CACHE).parquet(folder).filter(F.col("tokenizer") == version)
    # Two writers at once may both have stored a content: the counts are equal.
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """``(content, text)`` to ``(content, n_tokens)``, in batches of bounded bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for batch in batches:
            texts, counts, held = [], [], 0
            for scalar in batch.column("text"):
                texts.append(scalar.as_py())
                held += len(texts[-1])
                if held >= BATCH_BYTES:
                    counts += count(texts)
                    texts, held = [], 0
            if texts:
                counts += count(texts)
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(encode, "content binary, n_tokens long")


def token_counts(
    docs: DataFrame,
    cache_folder: str,
    tokenizer_path: str,
    text: str = "text",
    id_column: str = "doc_id",
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row for each document: id, ``n_bytes`` (UTF-8) and ``n_tokens``.

    Contents are compared by the SHA-256 of their normalised form together with the
    digest of the tokenizer's file.  Contents the cache lacks are encoded once each and
    appended to it before the result is built; a failed run appends nothing, because
    Spark commits the append as a whole.  ``normalise`` must not change a count; by
    default only null becomes the empty text.

    Null and empty texts have 0 tokens.  Repeated rows and null ids stay as they are.
    Other columns are ignored.  An empty table gives no rows and appends nothing.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    whole = F.coalesce(F.col(text), F.lit(""))
    form = normalise(whole) if normalise else whole
    contents = docs.select(
        F.col(id_column).alias("id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        F.unhex(F.sha2(form.cast("binary"), 256)).alias("content"),
        form.alias("text"),
    )
    known = read_cache(spark, cache_folder, version)
    # Copies are dropped before the shuffle, so a hot content moves once a task; the cache
    # then meets the contents where they already are.
    distinct = contents.select("content", "text").groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(known, "content", "left_anti")
    new = encode_misses(misses, tokenizer_path)
    new.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_folder)
    counts = read_cache(spark, cache_folder, version)
    return (
        contents.drop("text")
        .join(counts, "content", "left")
        .select(F.col("id").alias(id_column), "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    )
