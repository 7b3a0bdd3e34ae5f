"""Declarations in any layout."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import golayout
from docloom.operators import extract, filters, rewrite


def declared(df):
    rows = extract.declarations(df).orderBy("path", "pos").collect()
    return [(r["kind"], r["name"], r["doc"], r["type"], None if r["fields"] is None else [tuple(f) for f in r["fields"]], r["has_paren"]) for r in rows]


def names(df):
    return [(kind, name, doc) for kind, name, doc, *_ in declared(df)]


LAYOUTS = {
    "package p\n\nvar (\n    A int\n    // B is two.\n    B, C string\n)\n": [("var", "A", ""), ("var", "B", "B is two.\n"), ("var", "C", "B is two.\n")],
    "package p\n\nconst ( C = 1; D = 2 )\n": [("const", "C", ""), ("const", "D", "")],
    "package p\n\nconst(\n\tC = 1;\n\tD = 2; // two\n\tE = \"a;b\"\n)\n": [("const", "C", ""), ("const", "D", ""), ("const", "E", "")],
    "package p\n\n  // T is indented.\n  type T int\n": [("type", "T", "T is indented.\n")],
    "package p; type T int; var x = 3; func F() { a := 1; b := 2; _, _ = a, b }\n": [("type", "T", ""), ("var", "x", ""), ("func", "F", "")],
    "package p\n\nvar a = 1 +\n2\nvar b = f(\n1,\n2)\n": [("var", "a", ""), ("var", "b", "")],
    "package p\n\nfunc F() {\nvar inner int\ntype local struct{}\n_ = inner\n}\n\nvar Outer int\n": [("func", "F", ""), ("var", "Outer", "")],
    "package p\n\n/* one */ var a int\n/* two */ func F() {}\n": [("var", "a", ""), ("func", "F", "")],
    "package p\n\ntype (\n  A struct {\n    x, y int\n    *Base\n    p *int\n  }\n  B = map[string]int\n)\n": [("type", "A", ""), ("type", "B", "")],
    "package p\n\nvar s = `\ntype inText int\n`\n   const X = 1\n": [("var", "s", ""), ("const", "X", "")],
    "package p\n\nvar f = func() int {\nreturn 1\n}\nfunc\tG ( ) { }\n": [("var", "f", ""), ("func", "G", "")],
    "package p\n\nconst ()\nvar (\n)\ntype X int\n": [("type", "X", "")],
    "package p\n\nvar (\n\t\tA = 1\n\t\tB = A +\n\t\t\t2\n\t\tC = \"x\"\n)\n": [("var", "A", ""), ("var", "B", ""), ("var", "C", "")],
}


@pytest.mark.parametrize("text", list(LAYOUTS))
def test_layouts(go, text):
    files = go(text)
    expected = [(k, n, d.replace(" \n", "\n")) for k, n, d in LAYOUTS[text]]
    assert [(k, n, d.replace(" \n", "\n").lstrip()) for k, n, d in names(files)] == expected
    assert filters.unparsable(files).count() == 0


def test_struct_fields_by_blanks(go):
    text = "package p\n\n  type T struct {\n    ID int\n    Owner, Next *Brand `json:\"x\"`\n    Base\n  }\n"
    assert declared(go(text)) == [("type", "T", "", "unknown", [("ID", False), ("Owner", True), ("Next", True)], False)]


@pytest.mark.parametrize("depth", [7, 9, 40, 300])
def test_deep_nesting(go, depth):
    value = "f(" * depth + "1" + ")" * depth
    kind = "func(" * depth + "int" + ")" * depth
    struct = "struct {\n" * depth + "x int\n" + "} \n" * depth
    text = f"package p\n\nvar A = {value}\n\nvar B {kind}\n\n// C is deep.\nfunc C(f {kind}) {kind} {{\n\t{value}\n}}\n\ntype D struct {{ y {struct} }}\nconst E = 1\n"
    files = go(text)
    assert names(files) == [("var", "A", ""), ("var", "B", ""), ("func", "C", "C is deep.\n"), ("type", "D", ""), ("const", "E", "")]
    assert filters.unparsable(files).count() == 0


def _canonical(rng, n):
    """Random declarations in the usual layout."""
    out = ["package p\n"]
    for k in range(n):
        doc = f"// N{k} is; documented ( here.\n" if rng.random() < 0.3 else ""
        kind = rng.choice(["const", "var", "type", "func", "group", "struct"])
        value = rng.choice(["1", "f(1, 2)", '"a; b"', "`x\n  var y int\n`", "[]int{1, 2}"])
        if kind == "group":
            members = "".join(f"\tM{k}x{i}{rng.choice([' = ' + value, ' int' if True else ''])}\n" for i in range(rng.randrange(1, 4)))
            out.append(f"{doc}{rng.choice(['var', 'const'])} (\n{members})\n")
        elif kind == "struct":
            out.append(f"{doc}type N{k} struct {{\n\tA int\n\tb *T\n}}\n")
        elif kind == "func":
            out.append(f"{doc}func N{k}(a int) error {{\n\tvar local = {value}\n\tfor i := 0; i < 3; i++ {{\n\t\t_ = i\n\t}}\n\treturn nil\n}}\n")
        else:
            out.append(f"{doc}{kind} N{k} {'int' if kind == 'type' else '= ' + value}\n")
    return out


def _odd(rng, blocks):
    """The same declarations in another layout; raw strings are left alone."""
    out = ""
    for block in blocks:
        pieces = re.split(r"(`[^`]*`)", block)
        margin = rng.choice(["", "  ", "\t", "      "])
        step = rng.choice(["\t", "    ", " "])
        text = "".join(p if p.startswith("`") else p.replace("\t", step).replace("\n", "\n" + margin) for p in pieces)
        text = margin + text
        if "//" not in block and "`" not in block and "(\n" in block and rng.random() < 0.6:
            text = margin + re.sub(r"\s*\n\s*", "; ", block.strip()).replace("(; ", "( ").replace("; )", " )") + "\n"
        if out.endswith("\n") and "//" not in block and "//" not in out.splitlines()[-1] and rng.random() < 0.3:
            out = out.rstrip() + "; " + text.lstrip()
        else:
            out += rng.choice(["", "\n"]) + text
    return out + "\n"


def test_random_layouts_read_alike(go):
    rng = random.Random(4)
    plain, odd = [], []
    for _ in range(40):
        blocks = _canonical(rng, 8)
        plain.append("\n".join(blocks))
        odd.append(_odd(rng, blocks))
    want, got = declared(go(*plain)), declared(go(*odd))
    assert len(want) > 300
    assert got == want
    assert filters.unparsable(go(*odd)).count() == 0


def test_usual_layout_is_left_alone(go):
    rng = random.Random(5)
    plain = ["\n".join(_canonical(rng, 8)) for _ in range(10)]
    rows = go(*plain).select("content", golayout.needs_layout(F.col("content")).alias("odd"), golayout.relaid(F.col("content")).alias("again")).collect()
    assert not any(r["odd"] for r in rows)
    assert [r["again"] for r in rows] == [r["content"] for r in rows]


def test_comments_go_into_the_laid_out_file(go):
    files = go("package p; const ( C = 1; D = 2 ); type T int\n")
    text = rewrite.commented(files).first()["new_content"]
    lines = text.split("\n")
    assert "type T int" in lines and "\tC = 1" in lines and lines[lines.index("\tC = 1") - 1].startswith("\t//")


def test_long_files(go):
    text = "package p\n\n" + "".join(f"  var v{i} = f({i}) // n\n" for i in range(20_000))
    assert extract.declarations(go(text)).count() == 20_000
