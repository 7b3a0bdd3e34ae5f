"""Edge cases of the Go text functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docloom.functions import golang
from docloom.operators import extract


def pairs(df):
    return {r["name"]: r["comment"] for r in extract.function_pairs(df).collect()}


def signatures(df):
    return [r["signature"] for r in extract.functions(df).orderBy("path", "pos").collect()]


HEADERS = {
    "func A()": "func A() ()",
    "func (s *Store) Get(key string) (string, error)": "func (s *Store) Get(key string) (string, error)",
    "func (this Store) Get()": "func (s Store) Get() ()",
    "func (*Store) Get()": "func (s *Store) Get() ()",
    "func (Store) Get()": "func (s Store) Get() ()",
    "func (l *List[T]) Add(v T)": "func (l *List) Add(v T) ()",
    "func Map[K comparable, V any](m map[K]V) []K": "func Map(m map[K]V) ([]K)",
    "func A(a, b int, c string)": "func A(a int, b int, c string) ()",
    "func A(int, context.Context) error": "func A(int, context.Context) (error)",
    "func A(f func(x int, y string) error, n int)": "func A(f func, n int) ()",
    "func A(args ...string)": "func A(args unknown) ()",
    "func A(in <-chan int, out chan<- string, both chan bool)": "func A(in <-chan int, out chan<- string, both chan bool) ()",
    "func A(chan int, <-chan bool)": "func A(chan int, <-chan bool) ()",
    "func A(a [4]int, b [][]string, c map[string][2]bool)": "func A(a []int, b [][]string, c map[string][]bool) ()",
    "func A(v interface{ Run(x int) error }) interface{}": "func A(v interface{}) (interface{})",
    "func A(v struct{ x, y int }) struct{}": "func A(v unknown) (unknown)",
    "func A() map[string]struct{}": "func A() (map[string]unknown)",
    "func A() func(int) (string, error)": "func A() (func)",
    "func A() (n, m int, err error)": "func A() (int, int, error)",
    "func A(p *pkg.Type, q []*pkg.Type) *pkg.Type": "func A(p *pkg.Type, q []*pkg.Type) (*pkg.Type)",
    "func A(p Pair[int, string], q []Set[T])": "func A(p unknown, q []unknown) ()",
    "func Größe(breite int) int": "func Größe(breite int) (int)",
    "func A(\n\ta int, // first (of two)\n\tb string, /* second ) */\n) (\n\tint,\n\terror,\n)": "func A(a int, b string) (int, error)",
}


@pytest.mark.parametrize("body", [" {\n\treturn\n}\n", " { return }\n"])
def test_signatures(go, body):
    text = "package p\n\n" + "\n".join(h + body for h in HEADERS)
    assert signatures(go(text)) == list(HEADERS.values())


def test_function_without_body(go):
    assert signatures(go("package p\n\nfunc Asm(x int) int\n\nfunc B()\n")) == [
        "func Asm(x int) (int)", "func B() ()",
    ]


def test_doc_text_rules(go):
    text = (
        "package p\n\n"
        "// One says.\n//\n//\n//\tindented  \n//go:noinline\nfunc One() {\n}\n\n"
        "/* Two\n   spans. */\nfunc Two() {\n}\n\n"
        "/*\nThree starts late.\n*/\nfunc Three() {\n}\n\n"
        "// Four is apart.\n\nfunc Four() {\n}\n\n"
        "//go:embed x\nfunc Five() {\n}\n\n"
        "// Six a\n// Six b\n/* Six c */\nfunc (s S) Six() {\n}\n"
    )
    got = pairs(go(text))
    assert got == {
        "func One() ()": "One says.\n\n\tindented\n",
        "func Two() ()": " Two\n   spans.\n",
        "func Three() ()": "Three starts late.\n",
        "func (s S) Six() ()": "Six a\nSix b\n Six c\n",
    }


def test_keywords_and_entry_points(go):
    docs = ["a TODO later", "can debug it", "annotation here", "notebook", "prefixme", "is fine", "Deprecated: no"]
    text = "package p\n\n" + "".join(f"// F{i} {d}.\nfunc F{i}() {{\n}}\n\n" for i, d in enumerate(docs))
    text += "// main runs.\nfunc main() {\n}\n\n// init starts.\nfunc init() {\n}\n\n// main is a method.\nfunc (a A) main() {\n}\n"
    assert list(pairs(go(text))) == ["func F2() ()", "func F5() ()"]


def test_func_in_strings_and_comments_is_not_seen(go):
    text = (
        "package p\n\nconst src = `\n// Fake does.\nfunc Fake() {\n}\n`\n\n"
        "/*\n// Gone does.\nfunc Gone() {\n}\n*/\n\n"
        "// Real does.\nfunc Real() {\n\ts := \"func Str() {\"\n\tr := '\"'\n\tq := '\\''\n\t_ = `x\nfunc Raw() {}\n`\n}\n\n"
        "// After does.\nfunc After() {\n}\n"
    )
    assert list(pairs(go(text))) == ["func Real() ()", "func After() ()"]


def test_lexemes_cover_the_file(go):
    texts = [
        "", "package p", "package p\n\nfunc A() {", "x\n`open\nfunc A() {}\n", "// only", "/* open\nfunc A() {}",
        "package p\n\nvar (\n\ta = 1\n", "\n\n\n", "func\n", "type\n", "package p\n\nfunc A(((\n", "\tx 'y\n",
        "package p\n\ntype T struct {\n\n\tA int\n}\n// tail",
    ]
    rows = go(*texts).select("content", F.array_join(golang.lexemes(F.col("content")), "").alias("again")).collect()
    assert all(r["content"] == r["again"] for r in rows)


def test_long_texts_do_not_exhaust_the_stack(go):
    n = 20_000
    texts = [
        "package p\n" + "// c c c\n" * n + "func A() {\n}\n",
        "package p\n/* " + "* x / *\n" * n + "*/\nfunc B() {\n}\n",
        "package p\nvar s = `" + "y\"\n" * n + "`\n// C does.\nfunc C() {\n}\n",
        "package p\nfunc D() {\n" + "\tfoo(\"a\\\"b\", 'c')\n" * n + "}\n",
        "package p\nfunc E(\n" + "\ta int, // x\n" * 2000 + ") error {\n}\n",
        "package p\nconst (\n" + "\tX = 1 // x\n" * n + ")\n",
    ]
    df = go(*texts)
    assert len(extract.functions(df).collect()) == 5
    assert extract.value_and_type_specs(df).count() == n + 1
    assert extract.token_stream_pairs(df, keep_all=True).count() == 5


def test_unparsable_and_empty_files_give_no_rows(spark, go):
    from docloom.operators.filters import parsable, unparsable

    df = go("", "func A() {\n}\n", "package p\n\nfunc A() {\n", "package p\n\n// F does.\nfunc F() {\n}\n", "package p\n\nvar s = \"}\"\n")
    assert [r["path"] for r in parsable(df).orderBy("path").collect()] == ["f3.go", "f4.go"]
    assert unparsable(df).count() == 3
    assert pairs(df) == {"func F() ()": "F does.\n"}


def test_crlf_file(go):
    assert pairs(go("package p\r\n\r\n// A does.\r\n// More.\r\nfunc A(a,\r\n\tb int) {\r\n}\r\n")) == {
        "func A(a int, b int) ()": "A does.\nMore.\n"
    }


def test_specs(go):
    text = (
        "package p\n\n// Doc.\ntype Named int\n\ntype S struct {\n\tID, Name string `json:\"a // b\"`\n\tP *Foo // c\n"
        "\tEmb\n\t*Ptr\n\tpkg.Sel `tag`\n\tIn struct {\n\t\tHidden int\n\t}\n\tLast map[string]*T\n}\n\n"
        "type E struct{ X int; Y, Z *T }\n\ntype Empty struct{}\n\n"
        "type (\n\tG []int\n\n\t// H is it.\n\tH struct {\n\t\tA *int\n\t}\n\tI interface {\n\t\tRun() error\n\t}\n)\n\n"
        "type L[T any] struct {\n\tv T\n}\n\ntype Alias = pkg.Other\n\ntype Arr [4]*int\n\n"
        "const A, B = 1, 2\n\nvar (\n\tx = map[string]int{\n\t\t\"a\": 1,\n\t}\n\t// y is it.\n\ty, z *Foo\n\tbaseURL string\n)\n\n"
        "var w = func() int {\n\treturn 1\n}()\n"
    )
    rows = extract.value_and_type_specs(go(text)).orderBy("pos", "spec_pos").collect()
    got = [
        (
            r["kind"], r["has_paren"], ",".join(r["spec"]["names"]), r["spec"]["doc"],
            None if r["spec"]["is_struct"] else r["spec"]["type"],
            [("*" if f["is_ptr"] else "") + f["name"] for f in r["spec"]["fields"] or []],
        )
        for r in rows
    ]
    assert got == [
        ("type", False, "Named", "Doc.\n", "int", []),
        ("type", False, "S", "", None, ["ID", "Name", "*P", "In", "Last"]),
        ("type", False, "E", "", None, ["X", "*Y", "*Z"]),
        ("type", False, "Empty", "", None, []),
        ("type", True, "G", "", "[]int", []),
        ("type", True, "H", "H is it.\n", None, ["*A"]),
        ("type", True, "I", "", "interface{}", []),
        ("type", False, "L", "", None, ["v"]),
        ("type", False, "Alias", "", "pkg.Other", []),
        ("type", False, "Arr", "", "[]*int", []),
        ("const", False, "A,B", "", "unknown", []),
        ("var", True, "x", "", "unknown", []),
        ("var", True, "y,z", "y is it.\n", "*Foo", []),
        ("var", True, "baseURL", "", "string", []),
        ("var", False, "w", "", "unknown", []),
    ]


def test_token_stream(go):
    text = (
        "// head\npackage p\n\n// A does.\n// More.\nfunc A() {\n\t// inside\n}\n\nfunc (r *T) B() {\n\tgo func() { x() }()\n}\n\n"
        "/* C */\n\nvar s = \"func no // no\"\nfunc /* in */ C(int) {\n}\n\n// TODO d\nfunc D() {\n}\n\n// todo e\nfunc E() {\n}\n"
    )
    every = extract.token_stream_pairs(go(text), keep_all=True).orderBy("pos").collect()
    assert [(r["name"], r["comment"]) for r in every] == [
        ("A", "// More."), ("r", "// inside"), ("x", None), ("C", "/* in */"), ("D", "// TODO d"), ("E", "// todo e"),
    ]
    kept = extract.token_stream_pairs(go(text)).collect()
    assert [r["name"] for r in kept] == ["A", "r", "C", "E"]


def test_comment_text_by_kind(go):
    files = go(
        "package p\n\n// Serve handles /api/*/\nfunc A() {}\n\n/*\n// kept line\n//go:kept inside\n*/\nfunc B() {}\n\n"
        "//go:noinline\n// C runs.\nfunc C() {}\n\n// D /* no block\n// ends */\nfunc D() {}\n"
    )
    docs = {r["name"]: r["doc"] for r in extract.functions(files).collect()}
    assert docs == {"A": "Serve handles /api/*/\n", "B": "// kept line\n//go:kept inside\n", "C": "C runs.\n", "D": "D /* no block\nends */\n"}


def test_declarations_that_are_not_read_are_told_of(go):
    from docloom.operators.filters import unparsable

    deep = "func(" * 8 + ")" * 8
    beyond = "func(" * 30 + ")" * 30
    files = go(
        f"package p\n\n// Deep is nested.\nfunc Deep(f {deep}) {{}}\n\nfunc After() {{ x := func(a int) {{}} }}\n",
        f"package p\n\nfunc Lost(f {beyond}) {{}}\n",
        "package p\n\n/* doc */ func OneLine() {}\n",
        "package p\n\nfunc A() {}\n\n  func Indented() {}\n",
        "package p\n\n// func InComment() {}\nvar s = \"func InText() {}\"\ntype f func(a int) error\n\nfunc G[T any](x T) {}\n",
    )
    assert {r["name"] for r in extract.functions(files.filter("path = 'f0.go'")).collect()} == {"Deep", "After"}
    names = {r["name"] for r in extract.functions(files).collect()}
    assert names == {"Deep", "After", "Lost", "OneLine", "A", "Indented", "G"}
    assert unparsable(files).count() == 0
    strange = go("package p\n\nvar (\n\t= 3\n)\n", "package p\n\nfunc 3(x int) {}\n\ntype = int\n")
    assert unparsable(strange).count() == 2
