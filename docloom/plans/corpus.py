"""Corpora rendered from relational tables.

The test tables hold no source code, so Go files, listings, archives and configuration
files are written from their columns.  What an extractor must find in them follows
directly from the columns, which is how the expected results are computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.once import with_once
from docloom.session import tasks_for

VERB_WORDS = ["Get", "Set", "Init", "Is", "Has", "New", "Create", "Handle", "get", "delete"]
BLOCKS_PER_FILE = 10
#: Parts that a task renders and whose files it reads.
TASK_PARTS = 1 << 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list) -> Column:
    return F.get(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), index)


def _camel(name: Column) -> Column:
    return F.replace(F.initcap(name), F.lit(" "), F.lit(""))


def _parts(part: DataFrame) -> DataFrame:
    """The parts, dealt by file before anything is rendered: a fixed number a task, however
    narrow the table is, as its files take long to read."""
    k = F.col("p_partkey")
    narrow = part.select(k.alias("k"), F.floor(k / BLOCKS_PER_FILE).alias("f"), "p_name", "p_brand", "p_size")
    dealt = narrow.repartition(tasks_for(part.sparkSession, part.count(), TASK_PARTS), "f")
    return dealt.select(
        "k", "f",
        _camel(F.col("p_name")).alias("words"),
        F.replace("p_brand", F.lit("#"), F.lit("")).alias("brand"),
        F.col("p_size").alias("size"),
    )


def part_functions(part: DataFrame) -> DataFrame:
    """``(k, f, name, brand, block)``: one function per part."""
    k = F.col("k")
    name = (
        F.when(k % 29 == 0, F.lit("main"))
        .when(k % 31 == 0, F.lit("init"))
        .otherwise(F.concat(_pick((k % 10).cast("int"), VERB_WORDS), F.col("words")))
    )
    named = _parts(part).withColumn("name", name)
    text = F.col("name")
    doc = _pick(
        (k % 7).cast("int"),
        [
            "",
            F.concat(F.lit("// "), text, F.lit(" loads the value.\n")),
            F.concat(F.lit("// TODO: "), text, F.lit("\n")),
            F.concat(F.lit("// deprecated "), text, F.lit("\n")),
            F.concat(F.lit("// "), text, F.lit(" stores the item.\n// It returns early when done.\n")),
            F.concat(F.lit("/* "), text, F.lit(" stores it */\n")),
            F.concat(F.lit("// "), text, F.lit(" is an orphan.\n\n")),
        ],
    )
    brand = F.col("brand")
    receiver = _pick(
        (k % 3).cast("int"),
        ["", F.concat(F.lit("(x *"), brand, F.lit(") ")), F.concat(F.lit("(x "), brand, F.lit(") "))],
    )
    params = _pick(
        (k % 5).cast("int"),
        ["", "size int", "ctx context.Context, price float64", "items []string, opts map[string]int", "a, b int"],
    )
    results = _pick(
        (F.floor(k / 5) % 4).cast("int"),
        ["", " error", " (string, error)", F.concat(F.lit(" (*"), brand, F.lit(", bool)"))],
    )
    block = F.concat(
        doc, F.lit("func "), receiver, text, F.lit("("), params, F.lit(")"), results,
        F.lit(' {\n\t_ = "func Fake() {}"\n}\n\n'),
    )
    return named.withColumn("block", block)


def _files(blocks: DataFrame, path: Column) -> DataFrame:
    """Blocks of a file (a fixed number of them) put together in order.

    Tests of the path stay above the deal by file: below it they would run once a part, in
    the few tasks that read the table.
    """
    whole = blocks.groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", "block"))).alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), "")
    return with_once(whole, "path", path).select("path", F.concat(F.lit("package p\n\n"), text).alias("content"))


def function_path(f: Column) -> Column:
    return F.concat(
        F.lit("repo"), f % 5, F.lit("/"),
        F.when(f % 13 == 0, F.lit("vendor/")).otherwise(F.lit("")),
        F.lit("pkg"), f % 7, F.lit("/file_"), f,
        F.when(f % 11 == 0, F.lit("_test")).when(f % 17 == 0, F.lit("_example")).otherwise(F.lit("")),
        F.lit(".go"),
    )


def function_files(part: DataFrame) -> DataFrame:
    """``(path, content)``: Go files of ten functions each."""
    return _files(part_functions(part), function_path(F.col("f")))


def declaration_files(part: DataFrame) -> DataFrame:
    """``(path, content)``: Go files of ten const, var and type declarations each."""
    k = F.col("k")
    words = F.col("words")
    lowered = F.concat(F.lower(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
    named = _parts(part).withColumn("name", F.when(k % 4 == 0, lowered).otherwise(words))
    n, brand = F.col("name"), F.col("brand")
    doc = F.when(k % 7 == 0, F.concat(F.lit("// "), n, F.lit(" is documented.\n"))).otherwise(F.lit(""))
    var_type = _pick(
        F.col("size") % 4, ["int", F.concat(F.lit("*"), brand), "map[string][4]int", "func(int) error"]
    )
    alias = _pick(F.col("size") % 3, ["string", "[]int", "interface {\n\tRun() error\n}"])
    fields = _pick(
        F.floor(k / 6).cast("int") % 3,
        ["\tID int\n\tOwner *Brand\n\tsize, extra string // sizes\n\tbase\n", "\tOwner *Brand\n\tnext *Brand\n",
         "\tAge int `json:\"age\"`\n\n\tbase\n"],
    )
    body = _pick(
        (k % 6).cast("int"),
        [
            F.concat(F.lit("const "), n, F.lit(" = "), F.col("size"), F.lit("\n\n")),
            F.concat(F.lit("var "), n, F.lit(" "), var_type, F.lit("\n\n")),
            F.concat(F.lit("type "), n, F.lit(" struct {\n"), fields, F.lit("}\n\n")),
            F.concat(F.lit("type "), n, F.lit(" "), alias, F.lit("\n\n")),
            F.concat(F.lit("const (\n\t"), n, F.lit('URL = "x"\n\n\t// second is documented.\n\tsecond = 2\n)\n\n')),
            F.concat(F.lit("var (\n\t"), n, F.lit(", rest string\n\tlimit = 3\n)\n\n")),
        ],
    )
    f = F.col("f")
    path = F.concat(F.lit("repo"), f % 5, F.lit("/decl"), f % 7, F.lit("/decl_"), f, F.lit(".go"))
    return _files(named.withColumn("block", F.concat(doc, body)), path)


def other_layouts(files: DataFrame) -> DataFrame:
    """The same declarations in other layouts, by the number in the path: as it was, indented
    by blanks, whole file indented, joined by semicolons with groups on one line, and types
    nested 40 deep."""
    number = F.regexp_extract("path", r"_(\d+)\.go$", 1).cast("int")
    text = F.col("content")
    one_line = F.regexp_replace(text, r'const \(\n\t(\w+) = "x"\n\n\t// second is documented.\n\tsecond = 2\n\)', 'const ( $1 = "x"; // and\n\n // second is documented.\n second = 2; )')
    joined = F.regexp_replace(F.regexp_replace(one_line, r"\n\n(const|var|type) ", "; $1 "), "package p; ", "package p\n\n")
    nested = F.replace(text, F.lit("func(int) error"), F.lit("func(" * 40 + "int" + ")" * 40))
    layouts = [text, F.replace(text, F.lit("\t"), F.lit("    ")), F.replace(text, F.lit("\n"), F.lit("\n  ")), joined, nested]
    return files.withColumn("content", _pick(number % len(layouts), layouts))


def config_tree(lineitem: DataFrame, supplier: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, config files, module files): one organisation folder per supplier."""
    files = lineitem.select(
        F.concat(
            F.lit("org"), F.col("l_suppkey"), F.lit("/lib/pkg"), F.col("l_partkey") % 7, F.lit("/f"),
            F.col("l_partkey"), F.lit(".go"),
        ).alias("path")
    )
    s = F.col("s_suppkey")
    root = supplier.select(
        F.concat(F.lit("org"), s, F.lit("/.comments.yaml")).alias("path"),
        F.concat(
            F.lit('# settings\nsignature: "'), F.col("s_name"), F.lit('"\nprefixes:\n  - org'), s,
            F.lit("/api\nlocalai:\n  active: "), (s % 4 == 0).cast("string"),
            F.lit("\n  api_model_version: "), s % 3, F.lit("\nopenai:\n  api_key: key"), s, F.lit("\n"),
        ).alias("content"),
    )
    lib = supplier.filter(s % 2 == 1).select(
        F.concat(F.lit("org"), s, F.lit("/lib/.comments.yaml")).alias("path"),
        F.concat(
            F.lit("signature: lib-"), s, F.lit(" # own\nactive-examples: true\nprefixes: [lib"), s,
            F.lit("]\nopenai:\n  active: "), (s % 5 == 1).cast("string"),
            F.when(s % 10 == 1, F.lit("\n  url: https://chat.example\n")).otherwise(F.lit("\n")),
        ).alias("content"),
    )
    modules = supplier.filter(s % 3 == 0).select(
        F.concat(F.lit("org"), s, F.lit("/lib/go.mod")).alias("path"),
        F.concat(F.lit("// file\nmodule example.com/org"), s, F.lit("\n\ngo 1.22\n")).alias("content"),
    )
    return files, root.unionByName(lib), modules


def repository_settings(region: DataFrame) -> DataFrame:
    """Configuration files for the folders ``repo0``..``repo4`` of the rendered files."""
    r = F.col("r_regionkey")
    return region.select(
        F.concat(F.lit("repo"), r, F.lit("/.comments.yaml")).alias("path"),
        F.concat(
            F.lit("signature: "), F.col("r_name"), F.lit("\nactive-examples: "), (r % 2 == 0).cast("string"),
            F.lit("\nlocalai:\n  active: "), (r == 3).cast("string"), F.lit("\n  api_model_version: "), r,
            F.lit("\nopenai:\n  active: "), (r == 1).cast("string"), F.lit("\n  url: https://chat.example\n"),
        ).alias("content"),
    )


def marked_payload(page: Column) -> Column:
    """A page's html; every third ends in blank lines and every fourth holds a record's first line."""
    return F.concat(
        F.coalesce("html", F.lit("")),
        F.when(page % 3 == 0, F.lit("\r\n\r\n")).otherwise(F.lit("")),
        F.when(page % 4 == 0, F.lit("\nWARC/1.1\r\nWARC-Type: none\r\n")).otherwise(F.lit("")),
    )


def write_archive(pages: DataFrame, folder: str) -> None:
    """The same pages as archive files, 1.0 and 1.1 in turn, with lengths; every third
    payload ends in blank lines and every fourth holds a record's first line."""
    html = marked_payload(F.col("page_id"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), html)
    record = F.concat(
        F.lit("WARC/1."), F.col("page_id") % 2, F.lit("\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.col("url"),
        F.lit("\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"), block,
    )
    pages.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(folder)


def archive_records(pages: DataFrame) -> DataFrame:
    """``value``: archive records as the reader cuts them; every fifth is a request."""
    kind = F.when(F.col("page_id") % 5 == 0, F.lit("request")).otherwise(F.lit("response"))
    return pages.select(
        F.concat(
            F.lit("WARC-Type: "), kind, F.lit("\r\nWARC-Target-URI: "), F.col("url"),
            F.lit("\r\nContent-Type: application/http\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"),
            F.col("html"), F.lit("\r\n\r\n"),
        ).alias("value")
    )


def fenced_payload(html: Column) -> Column:
    """Paragraphs turned into fenced blocks."""
    return F.replace(F.replace(html, F.lit("<p>"), F.lit("```go\n")), F.lit("</p>"), F.lit("\n```"))


def repositories(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("owner"), F.col("s_nationkey")).alias("owner"),
        F.concat(F.lit("repo"), s).alias("repo"),
        F.when(s % 3 == 0, F.lit("Rust")).otherwise(F.lit("Go")).alias("language"),
        F.round(F.col("s_acctbal") * 100).cast("bigint").alias("stars"),
        s.alias("s_suppkey"),
    )


def repository_answers(lineitem: DataFrame, supplier: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listing answers, blob answers) of the code host, JSON in ``body``.

    A supplier's parts are its repository's files; every answer lists one of them.
    """
    repos = repositories(supplier).select("owner", "repo", F.col("s_suppkey").alias("l_suppkey"))
    entries = (
        lineitem.select("l_suppkey", "l_partkey").distinct()
        .join(repos, "l_suppkey")
        .join(part.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    )
    k = F.col("l_partkey")
    name = F.concat(F.lit("f"), k, F.when(k % 4 == 0, F.lit(".md")).otherwise(F.lit(".go")))
    path = F.concat(F.lit("src/"), name)
    listing = entries.select(
        "owner", "repo", F.to_json(F.array(F.struct(name.alias("name"), path.alias("path")))).alias("body")
    )
    text = F.concat(F.lit("package p // "), F.col("p_name"), F.lit("\n"))
    blob = F.struct(
        F.when(k % 9 == 0, F.lit("none")).otherwise(F.lit("base64")).alias("encoding"),
        F.base64(F.encode(text, "utf-8")).alias("content"),
    )
    return listing, entries.select("owner", "repo", path.alias("path"), F.to_json(blob).alias("body"))
