"""Drafts, rewriting and diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import naming, prompts, templates
from docloom.operators import extract, filters, rewrite


def rows(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, name string")
    return [tuple(r) for r in df.orderBy("i").select(*columns).collect()]


def test_names(spark):
    name = F.col("name")
    got = rows(
        spark,
        ["settingsPage", "issueID", "hashMap", "baseURL", "x", "GetHTTPCode", "initDB", "isOK", "deleteAll", "Run2Fast", "URL"],
        naming.snake_words(name), naming.function_phrase(name), naming.value_phrase(name),
    )
    assert got == [
        ("settings page", " which update thetings page", "settings page"),
        ("issue id", " to check thesue id", "issue id"),
        ("hash map", " to check theh map", "hash map"),
        ("base url", " which execute base url", " that indicates the endpoint URL for accessing to base "),
        ("x", "", ""),
        ("get http code", " that retrieve the http code", "get http code"),
        ("init db", " to initializes the db", "init db"),
        ("is ok", " to check the ok", "is ok"),
        ("delete all", " which execute delete all", "delete all"),
        ("run2fast", "", ""),
        ("url", "", ""),
    ]


def test_articles(spark):
    assert [r[0] for r in rows(spark, ["Apple", "int", "*T", "unit", "x"], naming.indefinite_article(F.col("name")))] == [
        "an", "an", "a", "an", "a",
    ]


def drafts(go, text, example=True):
    found = extract.undocumented_functions(go(text)).orderBy("pos")
    decl = F.struct("name", "receiver", "params", "results")
    return [r[0] for r in found.select(templates.function_comment(decl, F.lit(example))).collect()]


def test_function_drafts(go):
    text = (
        "package p\n\nfunc (s *Store) getItem(ctx context.Context, id int) (string, error) {\n}\n\n"
        "func Plain() {\n}\n\nfunc NewStore(path string) (*Store, error) {\n}\n\nfunc NewThing() *Thing {\n}\n\n"
        "func Order() (error, int) {\n}\n\nfunc Out() (bool, float64) {\n}\n\nfunc In(v Custom) {\n}\n\nfunc Bare(int, string) {\n}\n"
    )
    assert drafts(go, text) == [
        "// getItem is a private method that retrieve the item that belongs to the Store struct that take a ctx of type "
        "context.Context, an id of type int\n// and returns a string.\n// It's return an error if fails, otherwise nil.\n"
        "//\n// Example:\n//   ctx := context.Background()\n//   str, err := getItem(ctx, 50)\n//   if err != nil {\n"
        "//       log.Fatalf(\"Error: %v\", err)\n//   }\n//   fmt.Printf(\"%v \", str)\n",
        "// Plain is a method.\n// It does not take any arguments.\n",
        "// NewStore creates a new instance of *Store.\n// It initializes the *Store with the provided path of type string.\n"
        "// It's return an error if the initialization fails, otherwise nil.\n",
        "// NewThing creates a new instance of *Thing.\n",
        "// Order is a method and an int.\n// It's return an error if fails, otherwise nil.\n"
        "//\n// Example:\n//   err, nb := Order()\n//   if err != nil {\n//       log.Fatalf(\"Error: %v\", err)\n//   }\n"
        "//   fmt.Printf(\"%v \", nb)\n",
        "// Out is a method\n// and returns a bool and a float64.\n//\n// Example:\n//   valid, nb := Out()\n"
        "//   fmt.Printf(\"%v %v \", valid, nb)\n",
        "// In is a method that take a v of type Custom.\n",
        "// Bare is a method that take an int, a string.\n//\n// Example:\n//   Bare(50, my-string)\n",
    ]


SOURCE = (
    "// Package p does.\npackage p\n\nimport \"fmt\"\n\n// orphan stays\n\nconst a, B = 1, 2\n\n// Kept has a comment.\nvar Kept int\n\n"
    "var (\n\tone, two string\n\n\t// three is it.\n\tthree = 3\n\tbaseURL = `x\n\ty` // tail\n)\n\n"
    "type T struct {\n\tA int\n\tb *T\n}\n\ntype (\n\tU []int\n\t// V is it.\n\tV int\n)\n\n"
    "//go:noinline\nfunc Do() {\n\tfmt.Println(\"func X() {}\")\n}\n\nfunc main() {\n}\n"
)
EXPECTED = (
    "// Package p does.\npackage p\n\nimport \"fmt\"\n\n// orphan stays\n\n"
    "// B is a constant.\n//\n// Author: me.\nconst a, B = 1, 2\n\n// Kept has a comment.\nvar Kept int\n\n"
    "var (\n\t// one is a private variable of type string.\n\tone, two string\n\n\t// three is it.\n\tthree = 3\n"
    "\t// baseURL is a private variable of type unknown that indicates the endpoint URL for accessing to base .\n"
    "\tbaseURL = `x\n\ty` // tail\n)\n\n"
    "// T represents a structure for \n// It contains information about an A and\n// optionally a private b.\n//\n// Author: me.\n"
    "type T struct {\n\tA int\n\tb *T\n}\n\ntype (\n"
    "\t// U is a type alias for the []int type.\n\t// It allows you to create a new type with the same\n"
    "\t// underlying type as int, but with a different name.\n\t// This can be useful for improving code readability\n"
    "\t// and providing more semantic meaning to your types.\n\t//\n\t// Author: me.\n\tU []int\n\t// V is it.\n\tV int\n)\n\n"
    "// Do is a method.\n// It does not take any arguments.\n//\n// Author: me.\n//go:noinline\nfunc Do() {\n"
    "\tfmt.Println(\"func X() {}\")\n}\n\nfunc main() {\n}\n"
)


def test_rewrite(go):
    done = rewrite.commented(go(SOURCE), signature=F.lit("me")).first()
    assert done["new_content"] == EXPECTED


def test_rewrite_is_stable_and_keeps_other_files(go):
    texts = (EXPECTED, "not go {", "", "package p\n\n// A does.\nfunc A() {\n}\n")
    done = rewrite.commented(go(*texts), signature=F.lit("me"))
    assert done.filter("content <> new_content").count() == 0
    assert filters.changed(done).count() == 0


def test_insertions_give_the_new_file(go):
    texts = (SOURCE, "package p\n\nfunc A() {\n}", "package p\n\n// A does.\nfunc A() {\n}\n", "no go", "package p\n\n// x\x0c\u2028y\n\nfunc B() {}\n")
    files = go(*texts)
    done = {r["path"]: r for r in rewrite.commented(files, signature=F.lit("me")).collect()}
    changes = {}
    for r in rewrite.inserted_comments(files, signature=F.lit("me")).collect():
        changes.setdefault(r["path"], []).append((r["line"], r["text"]))
    assert sorted(changes) == ["f0.go", "f1.go", "f4.go"]
    for path, row in done.items():
        lines = row["content"].split("\n")
        for line, text in sorted(changes.get(path, []), reverse=True):
            lines[line - 1 : line - 1] = text.removesuffix("\n").split("\n")
        assert "\n".join(lines) == row["new_content"]


def test_generator_files(spark):
    paths = ["a.go", "a_test.go", "a_example.go", ".a.go", "vendor/a.go", "x/vendor/y/a.go", "vendored/a.go", "a.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in filters.generator_files(df).collect()] == ["a.go", "a_example.go", "vendored/a.go"]
    assert [r[0] for r in filters.corpus_files(df).collect()] == ["a.go", ".a.go", "vendored/a.go"]


def test_slash_lines(spark):
    got = rows(spark, ["a\nb", "a.\n", "", "a\n\n"], templates.slash_lines(F.col("name")))
    assert [r[0] for r in got] == ["// a\n// b.", "// a.", "// .", "// a\n// ."]


def test_responses(spark):
    cases = [
        ("localai", '{"comment": "x"}', ("x", None)),
        ("localai", "oops", (None, "error decoding response")),
        ("anthropic", '{"completion": "y"}', ("y", None)),
        ("openai", '{"choices": [{"text": "z"}]}', ("z", None)),
        ("openai", '{"choices": [{"message": {"content": "m"}}]}', ("m", None)),
        ("openai", '{"choices": []}', (None, "error: no choices found in response")),
        ("openai", "{}", (None, "error: no choices found in response")),
        ("openai", '{"choices": [{"index": 1}]}', (None, "error: no text found in response choice")),
        ("openai", None, (None, "error decoding response")),
    ]
    df = spark.createDataFrame([(i, p, b) for i, (p, b, _) in enumerate(cases)], "i int, provider string, body string")
    got = df.orderBy("i").select(prompts.decode_response(F.col("provider"), F.col("body")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [want for _, _, want in cases]


def test_blank_requests(spark):
    df = spark.createDataFrame([("a",), ("",), (None,)], "text string")
    usable, rejected = filters.split_blank_inputs(df)
    assert usable.count() == 1 and rejected.count() == 2
