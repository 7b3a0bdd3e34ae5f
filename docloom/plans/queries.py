"""The registered queries: name -> (spark, folder of parquet tables) -> DataFrame.

Each reads the given tables whole.  ``oracles`` holds the SQL that must agree.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import grading, naming, prompts, templates, text
from docloom.operators import (
    analysis,
    config,
    entities,
    evaluation,
    extract,
    features,
    filters,
    ordering,
    recipe,
    rewrite,
    sinks,
)
from docloom.plans import commenter, corpus, dataset, evaluation_job, training
from docloom.plans.corpus import table
from docloom.session import checkpoint_dir, spread, stored
from docloom.sources import code_host, files, listings, warc_source, web_archive
from docloom.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def go_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.function_files(table(spark, sf, "part"))


def declared_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.declaration_files(table(spark, sf, "part"))


def oddly_declared_files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.other_layouts(declared_files(spark, sf))


def joined(column: str, sep: str = " "):
    return F.array_join(F.col(column).cast("array<string>"), sep).alias(column.split(".")[-1])


# -- extraction ------------------------------------------------------------------------


@query
def function_pairs(spark, sf):
    return extract.function_pairs(filters.corpus_files(go_files(spark, sf))).select("path", "name", "comment")


@query
def graded_dataset(spark, sf):
    """Files to stored dataset rows, the whole job."""
    rows = sinks.dataset_rows(dataset.dataset(go_files(spark, sf)))
    return rows.select("file_name", "name", "comment", joined("comment_analysis.pos_tags"), joined("comment_analysis.lemmas"))


@query
def streamed_dataset(spark, sf):
    """The same rows by an incremental run over landed files."""
    folder = f"{checkpoint_dir(spark)}/streamed-{uuid.uuid4().hex}"
    go_files(spark, sf).write.parquet(f"{folder}/landed")
    landed = incremental.landed_files(spark, f"{folder}/landed")
    incremental.run_available(landed, f"{folder}/rows", f"{folder}/state")
    return files.read_dataset(spark, f"{folder}/rows").select("file_name", "name", "comment")


@query
def undocumented_functions(spark, sf):
    found = extract.undocumented_functions(filters.generator_files(go_files(spark, sf)))
    return found.select("path", "name", naming.is_exported(F.col("name")).alias("exported"))


@query
def last_comment_pairs(spark, sf):
    return extract.token_stream_pairs(go_files(spark, sf)).select("path", "name", "comment")


@query
def declarations(spark, sf):
    found = extract.declarations(oddly_declared_files(spark, sf))
    listed = F.transform("fields", lambda f: F.concat(F.when(f["is_ptr"], "*").otherwise(""), f["name"]))
    return found.select(
        "path", "kind", "name", "exported", "has_paren", "doc",
        F.when(F.col("fields").isNull(), F.col("type")).otherwise(F.array_join(listed, ",")).alias("type"),
    )


@query
def undocumented_declarations(spark, sf):
    both = oddly_declared_files(spark, sf).unionByName(filters.generator_files(go_files(spark, sf)))
    found = extract.undocumented(extract.declarations(both))
    return found.groupBy("kind", "exported").agg(F.count(F.lit(1)).alias("n"))


@query
def file_stems(spark, sf):
    paths = go_files(spark, sf).select("path")
    return paths.select("path", text.file_stem(F.col("path")).alias("file_name"))


@query
def corpus_paths(spark, sf):
    return filters.corpus_files(go_files(spark, sf)).select("path")


@query
def line_counts(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.line_count(F.col("text")).cast("bigint").alias("line_count"))


@query
def rejected_files(spark, sf):
    """Documents are no Go files: all of them are set aside, none of the rendered files is."""
    docs = _documents(spark, sf).select(F.concat(F.lit("doc"), "doc_id").alias("path"), F.col("comment").alias("content"))
    return filters.unparsable(docs.unionByName(go_files(spark, sf)).unionByName(oddly_declared_files(spark, sf))).select("path")


# -- comment drafts --------------------------------------------------------------------


@query
def name_phrases(spark, sf):
    part = corpus.part_functions(table(spark, sf, "part"))
    name = F.col("name")
    return part.select(
        "k", "name",
        naming.snake_words(name).alias("words"),
        text.word_count(naming.snake_words(name)).cast("bigint").alias("n_words"),
        naming.value_phrase(F.concat(name, F.lit("URL"))).alias("value_phrase"),
        naming.function_phrase(name).alias("function_phrase"),
        naming.indefinite_article(F.col("words")).alias("article"),
        naming.is_exported(name).alias("exported"),
        naming.is_constructor(name).alias("constructor"),
    )


def _function_texts(spark, sf, constructors: bool) -> DataFrame:
    found = extract.undocumented_functions(filters.generator_files(go_files(spark, sf)))
    found = found.filter(naming.is_constructor(F.col("name")) == constructors)
    decl = F.struct("name", "receiver", "params", "results")
    return found.withColumn("decl", decl)


@query
def func_comments(spark, sf):
    found = _function_texts(spark, sf, False)
    return found.select("path", "name", templates.function_comment(F.col("decl")).alias("comment"))


@query
def ctor_comments(spark, sf):
    found = _function_texts(spark, sf, True)
    return found.select("path", "name", templates.constructor_comment(F.col("decl")).alias("comment"))


@query
def usage_examples(spark, sf):
    found = _function_texts(spark, sf, False)
    return found.select("path", "name", templates.usage_example(F.col("decl")).alias("example"))


def _spec_texts(spark, sf, kind: str) -> DataFrame:
    found = extract.value_and_type_specs(oddly_declared_files(spark, sf)).filter(F.col("kind") == kind)
    draft = templates.spec_comment(F.col("kind"), F.col("spec"), F.col("has_paren"), F.lit("corpus"))
    return found.select("path", F.array_join("spec.names", ", ").alias("names"), draft.alias("comment")).filter(
        F.col("comment") != ""
    )


@query
def const_comments(spark, sf):
    return _spec_texts(spark, sf, "const")


@query
def var_comments(spark, sf):
    return _spec_texts(spark, sf, "var")


@query
def type_comments(spark, sf):
    return _spec_texts(spark, sf, "type")


@query
def slash_comments(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", templates.slash_lines(F.col("text")).alias("comment"))


@query
def rewritten_files(spark, sf):
    done = rewrite.commented(filters.generator_files(go_files(spark, sf)), signature=F.lit("corpus"))
    return filters.changed(done).select("path", "new_content")


@query
def rewritten_declarations(spark, sf):
    return rewrite.commented(declared_files(spark, sf)).select("path", "new_content")


@query
def changed_files(spark, sf):
    both = declared_files(spark, sf).unionByName(filters.generator_files(go_files(spark, sf)))
    return rewrite.changed_paths(rewrite.commented(both))


@query
def patched_files(spark, sf):
    """The changed files as patches, applied again to the files as they were."""
    made = rewrite.file_patches(filters.generator_files(go_files(spark, sf)), signature=F.lit("corpus"))
    return rewrite.patched(made).select("path", "new_content")


@query
def inserted_comments(spark, sf):
    """The same changes line by line."""
    found = rewrite.inserted_comments(filters.generator_files(go_files(spark, sf)), signature=F.lit("corpus"))
    return found.select("path", F.col("line").cast("bigint").alias("line"), "text")


# -- configuration ---------------------------------------------------------------------


def _configs(spark, sf):
    tree, configs, modules = corpus.config_tree(table(spark, sf, "lineitem"), table(spark, sf, "supplier"))
    dirs = tree.select(text.directory(F.col("path")).alias("dir"))
    return config.resolve_configs(dirs, config.parse_config(configs), config.module_dirs(modules))


@query
def resolved_config(spark, sf):
    return _configs(spark, sf).select(
        "dir", "local", "signature", "active_examples", "localai_active", "localai_url",
        "localai_api_model_version", "openai_active", "openai_api_key", "openai_url", joined("prefixes", ","),
    )


@query
def provider_choice(spark, sf):
    return config.choose_provider(_configs(spark, sf)).select("dir", "provider", "model_version", "config_error")


@query
def files_by_provider(spark, sf):
    """Files joined to their directory's configuration."""
    tree, _, _ = corpus.config_tree(table(spark, sf, "lineitem"), table(spark, sf, "supplier"))
    placed = config.with_config(tree, config.choose_provider(_configs(spark, sf)))
    return placed.groupBy("provider", "local").agg(F.count(F.lit(1)).alias("n_files"))


@query
def module_names(spark, sf):
    _, _, modules = corpus.config_tree(table(spark, sf, "lineitem"), table(spark, sf, "supplier"))
    return config.module_dirs(modules)


def _configured(spark, sf) -> DataFrame:
    settings = config.parse_config(corpus.repository_settings(table(spark, sf, "region")))
    no_modules = config.module_dirs(spark.createDataFrame([], "path string, content string"))
    return commenter.configured_files(go_files(spark, sf), settings, no_modules)


@query
def commented_corpus(spark, sf):
    """The comment job: every file with the author and examples its folder asks for."""
    done = commenter.commented_files(_configured(spark, sf).filter("provider = 'template'"))
    return done.select("path", "author", "new_content")


@query
def model_requests(spark, sf):
    """The other side of the comment job: request bodies for folders with a model."""
    return commenter.model_requests(_configured(spark, sf)).select("path", "provider", "request")


def _replied(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The model folders with answers: of five places in a file one gets none, one a broken text,
    and one answers a second time for a place that does not exist."""
    configured = _configured(spark, sf)
    asked = extract.undocumented_functions(configured.filter("provider != 'template' AND config_error IS NULL"))
    comment = F.concat(F.lit("note "), "name", F.lit("\nat place "), F.col("pos"))
    body = F.when(F.col("pos") % 5 == 4, F.lit('{"comment')).otherwise(F.to_json(F.struct(comment.alias("comment"))))
    answers = asked.select("path", F.col("pos").cast("long").alias("pos"), body.alias("body")).filter("pos % 5 <> 2")
    astray = answers.filter("pos % 5 = 3").withColumn("pos", F.col("pos") + 1000)
    return commenter.apply_replies(configured, answers.unionByName(astray))


@query
def model_commented_files(spark, sf):
    """The comment job with a model's answers placed before their functions."""
    return _replied(spark, sf)[0].select("path", "author", "new_content")


@query
def rejected_folders(spark, sf):
    """What the comment job could not do: folders in error, answers without a comment or for
    nothing, and requests without an answer."""
    return _replied(spark, sf)[1].select("path", F.col("pos").cast("bigint").alias("pos"), "error")


@query
def prompt_requests(spark, sf):
    found = extract.undocumented_functions(filters.generator_files(go_files(spark, sf)))
    provider = (
        F.when(F.col("pos") % 3 == 0, F.lit("localai")).when(F.col("pos") % 3 == 1, F.lit("openai")).otherwise(F.lit("anthropic"))
    )
    found = found.withColumn("provider", provider)
    body = prompts.request_body(F.col("provider"), F.col("signature"), (F.col("pos") + 1).cast("int"))
    return found.select("path", "name", "provider", body.alias("request"))


@query
def response_decode(spark, sf):
    k, name = F.col("p_partkey"), F.col("p_name")
    body = (
        F.when(k % 6 == 0, F.to_json(F.struct(name.alias("comment"))))
        .when(k % 6 == 1, F.to_json(F.struct(F.array(F.struct(name.alias("text"))).alias("choices"))))
        .when(k % 6 == 2, F.to_json(F.struct(name.alias("completion"))))
        .when(k % 6 == 3, F.lit('{"choices": []}'))
        .when(k % 6 == 4, F.lit('{"choices": [{"index": 0}]}'))
        .otherwise(F.concat(F.lit("gateway "), name))
    )
    provider = F.when(k % 6 == 0, F.lit("localai")).when(k % 6 == 2, F.lit("anthropic")).otherwise(F.lit("openai"))
    reply = prompts.decode_response(provider, body)
    return table(spark, sf, "part").select("p_partkey", reply.alias("r")).select("p_partkey", "r.comment", "r.error")


# -- grading ---------------------------------------------------------------------------


def _documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", F.col("text").alias("comment")), "doc_id")


@query
def comment_grades(spark, sf):
    rows = analysis.graded(_documents(spark, sf))
    return rows.select(
        "doc_id", *[F.col(f"counts.{c}").cast("bigint").alias(c) for c in ("n_tokens", "n_verbs", "n_stop", "n_tech")], "grade"
    )


@query
def grades_with_gaps(spark, sf):
    """Every fifth comment is missing, and so graded as an empty one."""
    rows = _documents(spark, sf).withColumn("comment", F.when(F.col("doc_id") % 5 != 0, F.col("comment")))
    return analysis.graded(rows).select("doc_id", F.col("counts.n_tokens").cast("bigint").alias("n_tokens"), "grade")


@query
def graded_good(spark, sf):
    return analysis.good_only(analysis.graded(_documents(spark, sf))).select("doc_id")


@query
def comment_analysis(spark, sf):
    a = analysis.analyzed(_documents(spark, sf))
    entities = F.transform("comment_analysis.entities", lambda e: F.concat_ws("/", e["text"], e["label"]))
    return a.select(
        "doc_id", joined("comment_analysis.tokens"), joined("comment_analysis.lemmas"),
        joined("comment_analysis.pos_tags"), F.array_join(entities, " ").alias("entities"),
    )


@query
def entity_spans(spark, sf):
    """Names of a gazetteer in the documents; here beginnings and middles of the benchmark texts."""
    cut = table(spark, sf, "benchmark").select("item_id", entities.words("text").alias("w"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("PERSON", "PLACE", "GROUP")]), (F.col("item_id") % 3 + 1).cast("int"))
    names = F.array(*[F.array_join(F.slice("w", at, n), " ") for at, n in ((1, 2), (1, 4), (3, 5), (2, 1))])
    gazetteer = cut.select(F.explode(names).alias("name"), kinds.alias("label"))
    return entities.entity_spans(spread(table(spark, sf, "documents"), "doc_id"), gazetteer, ["doc_id"])


@query
def lexicon_grades(spark, sf):
    """Grading against a lexicon table; here the words of the benchmark texts."""
    word = F.explode(grading.tokens(F.lower("text")))
    lexicon = (
        table(spark, sf, "benchmark").select(word.alias("word")).filter(F.col("word").rlike(r"^\p{L}+$")).distinct()
        .select(
            "word", F.col("word").alias("lemma"),
            F.when(F.col("word").endswith("h"), F.lit("VERB")).otherwise(F.lit("NOUN")).alias("pos"),
            (F.length("word") <= 3).alias("is_stop"),
        )
    )
    rows = analysis.grade_with_lexicon(_documents(spark, sf), lexicon, ["doc_id"])
    return rows.select(
        "doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("n_tokens", "n_verbs", "n_stop", "n_tech")], "grade"
    )


# -- web and code-host corpora ---------------------------------------------------------


@query
def warc_responses(spark, sf):
    records = web_archive.parse_records(corpus.archive_records(table(spark, sf, "pages")))
    return web_archive.responses(records).select(
        "url", F.length("payload").cast("bigint").alias("n_chars"), F.md5(F.col("payload").cast("binary")).alias("digest")
    )


@query
def fenced_snippets(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", corpus.fenced_payload(F.col("html")).alias("payload"))
    return extract.fenced_snippets(pages).select("page_id", F.col("pos").cast("bigint").alias("pos"), "snippet")


@query
def snippet_lists(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", corpus.fenced_payload(F.col("html")).alias("payload"))
    return extract.snippet_lists(pages).select(
        "page_id", F.size("snippets").cast("bigint").alias("n_snippets"), joined("snippets", "|")
    )


@query
def repo_top(spark, sf):
    repos = corpus.repositories(table(spark, sf, "supplier"))
    return code_host.top_repositories(repos, page=2, per_page=5).select("owner", "repo", "stars")


@query
def repo_blobs(spark, sf):
    supplier = table(spark, sf, "supplier")
    repos = corpus.repositories(supplier)
    listing, blobs = corpus.repository_answers(table(spark, sf, "lineitem"), supplier, table(spark, sf, "part"))
    return code_host.repository_files(code_host.top_repositories(repos, per_page=10), listing, blobs)


@query
def repo_listing(spark, sf):
    """Files per repository, over all listings."""
    listing, _ = corpus.repository_answers(
        table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "part")
    )
    return code_host.contents_listing(listing).groupBy("owner", "repo").agg(F.count(F.lit(1)).alias("n_files"))


# -- writers and readers, there and back ---------------------------------------------------


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def archive_files(spark, sf):
    """Pages to archive files of both versions and back through the reader."""
    folder = _folder(spark, "archive")
    corpus.write_archive(table(spark, sf, "pages"), folder)
    records = warc_source.read_archives(spark, folder, ("response",))
    return records.select("url", F.md5(F.col("payload").cast("binary")).alias("digest"), "cut_short")


@query
def archive_members(spark, sf):
    """Pages to three archives compressed by record, read in byte ranges of some records each."""
    folder = _folder(spark, "members")
    pages = table(spark, sf, "pages")
    record = pages.select(
        F.when(F.col("page_id") % 5 == 0, "request").otherwise("response").alias("rec_type"), "url",
        F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\n"), corpus.marked_payload(F.col("page_id"))).alias("block"),
    )
    warc_source.write_archives(record.repartition(3, "url"), folder)
    records = warc_source.read_archives(spark, folder, ("response",), split_bytes=1 << 16)
    return records.select("url", F.md5(F.col("payload").cast("binary")).alias("digest"), "cut_short")


@query
def archive_table(spark, sf):
    """Records landed as a table and read again."""
    folder = _folder(spark, "landed")
    web_archive.parse_records(corpus.archive_records(table(spark, sf, "pages"))).write.parquet(folder)
    return web_archive.read_archive_table(spark, folder, "parquet").groupBy("rec_type").agg(F.count(F.lit(1)).alias("n"))


@query
def csv_pairs(spark, sf):
    """Pairs with comments of several lines, through a CSV file."""
    folder = _folder(spark, "pairs")
    sinks.write_pairs_csv(extract.function_pairs(filters.corpus_files(go_files(spark, sf))), folder)
    return files.read_table_csv(spark, folder).select("name", "comment")


@query
def appended_dataset(spark, sf):
    """Two runs into one hour repeat the rows, a run that drops repeats does not repeat its own."""
    folder = _folder(spark, "dataset")
    rows = sinks.dataset_rows(dataset.dataset(go_files(spark, sf)))
    hour = F.lit("2024-01-31 07:30:00").cast("timestamp")
    sinks.append_dataset(rows, folder, hour)
    sinks.append_dataset(rows.unionByName(rows), folder, hour, distinct=True)
    found = files.read_dataset(spark, folder).withColumn("bucket", F.regexp_extract(F.input_file_name(), "bucket=([0-9_]+)", 1))
    return found.groupBy("bucket", "name", "comment").agg(F.count(F.lit(1)).alias("n"))


@query
def idempotent_append(spark, sf):
    """A run that broke off after some rows, two whole runs, and one of another hour: each
    row is there as often as one run has it."""
    folder = _folder(spark, "dataset")
    # The runs append the rows of one job; a run of its own would read all files anew.
    rows = stored(sinks.dataset_rows(dataset.dataset(go_files(spark, sf))))
    repeated = rows.unionByName(rows.filter("file_name LIKE '%1'"))
    hour = F.lit("2024-01-31 07:30:00").cast("timestamp")
    sinks.append_dataset(repeated.filter("file_name LIKE '%1' OR file_name LIKE '%2'").dropDuplicates(["file_name", "name"]), folder, hour)
    sinks.append_dataset(rows.filter("file_name LIKE '%3'"), folder, F.lit("2024-01-31 08:30:00").cast("timestamp"))
    for _ in range(2):
        sinks.append_once(repeated, folder, hour)
    found = files.read_dataset(spark, folder).withColumn("bucket", F.regexp_extract(F.input_file_name(), "bucket=([0-9_]+)", 1))
    return found.groupBy("bucket", "file_name", "name", "comment").agg(F.count(F.lit(1)).alias("n"))


@query
def json_pairs(spark, sf):
    """Pairs written as JSON lines over an earlier run's."""
    folder = _folder(spark, "json")
    pairs = extract.function_pairs(filters.corpus_files(go_files(spark, sf)))
    sinks.write_json(pairs.limit(1), folder)
    sinks.write_json(pairs, folder)
    return spark.read.schema("path string, name string, comment string").json(folder)


@query
def written_files(spark, sf):
    """The changed files at their new place."""
    folder = _folder(spark, "files")
    done = rewrite.commented(filters.generator_files(go_files(spark, sf)), signature=F.lit("corpus"))
    sinks.write_files(done, folder)
    return spark.read.parquet(folder)


@query
def repo_tree(spark, sf):
    """Go files of recursive listings, one listing a repository."""
    listing, _ = corpus.repository_answers(
        table(spark, sf, "lineitem"), table(spark, sf, "supplier"), table(spark, sf, "part")
    )
    entry = F.from_json("body", code_host.CONTENTS_SCHEMA)[0]["path"]
    trees = listing.groupBy("owner", "repo").agg(
        F.to_json(F.struct(F.collect_list(F.struct(entry.alias("path"))).alias("tree"))).alias("body")
    )
    return code_host.tree_listing(trees).select("owner", "repo", "path")


# -- training set ----------------------------------------------------------------------


def _split(spark, sf, *columns: str) -> DataFrame:
    return ordering.positional_split(table(spark, sf, "documents").select("doc_id", *columns), ["doc_id"])


@query
def train_split(spark, sf):
    return _split(spark, sf)


def _batches(split: DataFrame) -> DataFrame:
    """Training rows in shuffled batches, validation rows in their order."""
    train = ordering.with_shuffled_position(split.filter("split = 'train'"), "doc_id")
    validation = ordering.with_position(split.filter("split = 'validation'"), ["doc_id"])
    return ordering.with_batch(train.unionByName(validation))


@query
def train_batches(spark, sf):
    return _batches(_split(spark, sf)).select("split", "batch", "doc_id")


@query
def train_plan(spark, sf):
    return ordering.training_plan(ordering.split_counts(_split(spark, sf)))


@query
def epoch_order(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return ordering.with_shuffled_position(ordering.with_epochs(docs, 3), "doc_id", epoch="epoch").select(
        F.col("epoch").cast("bigint").alias("epoch"), "position", "doc_id"
    )


@query
def random_pick(spark, sf):
    held_out = _split(spark, sf).filter("split = 'validation'")
    return ordering.pick_one(held_out, "doc_id", seed=2022).select("doc_id")


def _pairs(spark, sf) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        "doc_id", F.col("source").alias("file_name"), F.concat_ws("", F.col("lang"), F.lit("-doc")).alias("name"),
        F.col("text").alias("comment"),
    )


@query
def model_inputs(spark, sf):
    return features.with_model_text(analysis.analyzed(_pairs(spark, sf))).select("doc_id", "input", "target")


def _texts(spark, sf) -> DataFrame:
    rows = _pairs(spark, sf)
    model_input = features.model_input(F.col("file_name"), F.col("name"))
    return rows.select("doc_id", model_input.alias("input"), F.col("comment").alias("target"))


@query
def vocabulary(spark, sf):
    split = ordering.positional_split(_texts(spark, sf), ["doc_id"])
    found = features.build_vocabulary(split.filter("split = 'train'"), ["input", "target"])
    return found.select("token", F.col("token_id").cast("bigint").alias("token_id"), "n")


def _encoded(spark, sf) -> DataFrame:
    split = ordering.positional_split(_texts(spark, sf), ["doc_id"])
    words = features.build_vocabulary(split.filter("split = 'train'"), ["input", "target"])
    return features.encode(split, "doc_id", words)


@query
def encoded_features(spark, sf):
    return _encoded(spark, sf).select("doc_id", joined("input_ids", ","), joined("attention_mask", ","), joined("labels", ","))


@query
def label_counts(spark, sf):
    train, _, words = training.split_texts(_texts(spark, sf), ["doc_id"])
    return features.label_counts(training.training_batches(train, "doc_id", words)).select("batch", "n_labels")


@query
def training_batches(spark, sf):
    """The training-set job over two epochs."""
    train, _, words = training.split_texts(_texts(spark, sf), ["doc_id"])
    rows = training.training_batches(train, "doc_id", words, epochs=2)
    return rows.select(
        F.col("epoch").cast("bigint").alias("epoch"), "batch", "doc_id", joined("input_ids", ","),
        features.kept_labels(F.col("labels")).cast("bigint").alias("n_labels"),
    )


# -- evaluation ------------------------------------------------------------------------


def _versions(spark, sf) -> int:
    """Latest of the model versions named in a listing (one folder per order priority)."""
    orders = table(spark, sf, "orders")
    rank = F.substring("o_orderpriority", 1, 1)
    return listings.require_version(orders.select(F.concat(F.lit("checkpoint-tf-"), rank).alias("name")))


def _eval_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("role").alias("name"), F.col("text").alias("comment")
    )


def _first_words(spark, sf) -> DataFrame:
    """A stand-in model: version v repeats every word but each (v+1)-th of the answer."""
    rows = evaluation.with_versions(_eval_rows(spark, sf), _versions(spark, sf))
    return evaluation.predict(
        rows,
        lambda value, version: F.array_join(
            F.filter(text.words(value), lambda w, i: (i + 1) % (version + 1) != 0), " "
        ),
        text="comment",
    )


@query
def eval_matrix(spark, sf):
    return _first_words(spark, sf).select(
        "conv_id", "turn", F.col("version").cast("bigint").alias("version"), "predicted"
    )


def _length_model(version: int) -> Callable[[list[str]], list[str]]:
    """A stand-in for a loaded model: tells the length of its inputs, fails on some."""

    def replies(texts: list[str]) -> list[str]:
        if version == 2 and any(len(text) % 3 == 0 for text in texts):
            raise RuntimeError("no answer")
        return [f"{version}: {len(text)} characters" for text in texts]

    return replies


@query
def model_replies(spark, sf):
    """The evaluation matrix through a Python model, in batches; failures stay in their rows."""
    rows = evaluation.with_versions(_eval_rows(spark, sf), _versions(spark, sf))
    replies = evaluation.predict_in_batches(rows, _length_model, text="comment")
    return replies.select("conv_id", "turn", F.col("version").cast("bigint").alias("version"), "predicted", "error")


@query
def version_scores(spark, sf):
    scores = evaluation.version_scores(_first_words(spark, sf))
    return scores.select(
        F.col("version").cast("bigint").alias("version"), "n",
        F.round("exact_rate", 9).alias("exact_rate"), F.round("mean_f1", 9).alias("mean_f1"),
    )


@query
def version_intervals(spark, sf):
    """Each version against the first, with limits from 200 bootstrap replicates."""
    found = evaluation.version_intervals(_first_words(spark, sf), ["conv_id", "turn"])
    return found.select(F.col("version").cast("bigint").alias("version"), "n", *[F.round(c, 9).alias(c) for c in ("difference", "low", "high")])


def _requests(spark, sf) -> tuple[DataFrame, DataFrame]:
    turn = F.col("turn")
    return evaluation.inference_requests(
        table(spark, sf, "conversations").select(
            "conv_id", "turn",
            F.when(turn % 5 == 4, F.lit("")).when(turn % 5 != 3, F.col("text")).alias("text"),
            F.when(turn % 2 == 0, turn + 1).alias("version"),
        )
    )


@query
def inference_requests(spark, sf):
    return _requests(spark, sf)[0]


@query
def rejected_requests(spark, sf):
    return _requests(spark, sf)[1].select("conv_id", "turn", "error")


def _raw_lines(spark, sf) -> DataFrame:
    rows = _eval_rows(spark, sf)
    line = F.to_json(F.struct("name", "comment"))
    broken = F.concat(F.lit("{"), line)
    return rows.select("conv_id", "turn", F.when(F.col("conv_id") % 7 == 3, broken).otherwise(line).alias("value"))


def _json_lines(spark, sf) -> DataFrame:
    return files.parse_dataset_lines(_raw_lines(spark, sf))


def _echo_model(version: int) -> Callable[[list[str]], list[str]]:
    """A stand-in for a loaded model: gives some texts back, changes others, fails on some."""

    def replies(texts: list[str]) -> list[str]:
        if version == 2 and any(len(text) % 3 == 0 for text in texts):
            raise RuntimeError("no answer")
        return [text if len(text) % 2 == version % 2 else text + "!" for text in texts]

    return replies


@query
def evaluation_run(spark, sf):
    """The evaluation job over the first window of lines."""
    scores, _ = evaluation_job.evaluation_run(
        _raw_lines(spark, sf), ["conv_id", "turn"], _versions(spark, sf), _echo_model, text="comment"
    )
    return scores.select(F.col("version").cast("bigint").alias("version"), "n", "n_failed", F.round("exact_rate", 9).alias("exact_rate"))


@query
def valid_lines(spark, sf):
    return files.valid_rows(_json_lines(spark, sf)).select("conv_id", "turn", "name", "comment")


@query
def rejected_lines(spark, sf):
    return files.rejected_rows(_json_lines(spark, sf)).select("conv_id", "turn")


@query
def row_window(spark, sf):
    window = ordering.row_window(_json_lines(spark, sf), ["conv_id", "turn"])
    return files.valid_rows(window).select(F.col("row_no").cast("bigint").alias("row_no"), "name", "comment")


def _steps(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("epoch"),
        F.when(F.col("event_type") == "error", F.lit("validation")).otherwise(F.lit("train")).alias("phase"),
        F.col("event_id").alias("step"),
        F.col("value").cast("decimal(18,4)").alias("loss"),
    )


@query
def epoch_losses(spark, sf):
    return evaluation.epoch_losses(_steps(spark, sf)).select(
        "epoch", "phase", "n_steps", "mean_loss"
    )


@query
def batch_losses(spark, sf):
    """An order is a batch, a line a token; every third line's label is ignored."""
    line = F.struct("l_linenumber", "l_quantity")
    batches = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("t"))
    losses = F.transform("t", lambda x: x["l_quantity"].cast("double"))
    labels = F.transform("t", lambda x: F.when(x["l_linenumber"] % 3 == 0, features.IGNORED_LABEL).otherwise(x["l_linenumber"].cast("int")))
    return batches.select("l_orderkey", F.round(evaluation.batch_loss(losses, labels), 9).alias("loss"))


@query
def loss_curves(spark, sf):
    curves = evaluation.running_losses(_steps(spark, sf))
    return curves.select("epoch", "phase", "step", "running_loss")


@query
def hour_buckets(spark, sf):
    events = table(spark, sf, "events").select(sinks.hour_bucket(F.col("ts")).alias("bucket"))
    return events.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


# -- listings and recipe ---------------------------------------------------------------


@query
def latest_version(spark, sf):
    orders = table(spark, sf, "orders")
    key = F.col("o_custkey")
    kind = F.when(key % 3 == 0, F.lit("ckpt-")).otherwise(F.lit("checkpoint-tf-"))
    listing = orders.select(
        F.concat(kind, key, F.when(key % 5 == 0, F.lit(".index")).otherwise(F.lit(""))).alias("name"),
        (key % 7 != 0).alias("is_dir"),
    )
    return listings.latest_version(listing).select(F.col("version").cast("bigint").alias("version"))


@query
def newest_dataset(spark, sf):
    orders = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderkey") % 2 == 0, F.lit("functions_dataset_")).otherwise(F.lit("other_"))
    name = F.concat(kind, F.col("o_orderkey"), F.lit(".jsonl"))
    listing = orders.select(
        F.concat(F.lit("dataset/"), name).alias("path"), name.alias("name"), F.col("o_orderdate").alias("modified_at")
    )
    return listings.newest_file(listing, "functions_dataset", ".jsonl").select("path")


@query
def recipe_split(spark, sf):
    """Who is held out, row by row."""
    return ordering.random_split(table(spark, sf, "embeddings").select("vec_id"), "vec_id")


@query
def forest_recipe(spark, sf):
    _, predictions = recipe.fit_forest(table(spark, sf, "embeddings"), "embedding", "label", "vec_id")
    return predictions.select("vec_id", "label", "prediction")
