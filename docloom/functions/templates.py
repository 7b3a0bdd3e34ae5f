"""Comment drafts for undocumented declarations.

The wording of every template is a fixed value.  ``decl`` is an element of
``golang.function_parts``; ``spec`` an element of ``golang.spec_parts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.once import let
from docloom.functions.naming import (
    function_phrase,
    indefinite_article,
    is_constructor,
    is_exported,
    value_phrase,
)


def _blank() -> Column:
    return F.lit("")


def _private(name: Column) -> Column:
    return F.when(is_exported(name), _blank()).otherwise(F.lit("private "))


def _typed(entry: Column) -> Column:
    """``size of type int``; just the type for an unnamed parameter."""
    return F.when(entry["name"] == "", entry["type"]).otherwise(
        F.concat(entry["name"], F.lit(" of type "), entry["type"])
    )


def _with_article(entry: Column) -> Column:
    first = F.when(entry["name"] == "", entry["type"]).otherwise(entry["name"])
    return F.concat(indefinite_article(first), F.lit(" "), _typed(entry))


def _returns(results: Column, first_lead: str, text) -> Column:
    """Non-error results, the first of the list led by ``first_lead``, others by ' and '."""
    parts = F.transform(
        results,
        lambda r, i: F.when(r["type"] == "error", _blank()).otherwise(
            F.concat(F.when(i == 0, F.lit(first_lead)).otherwise(F.lit(" and ")), text(r["type"]))
        ),
    )
    return F.array_join(parts, "")


def _has_error(results: Column) -> Column:
    return F.exists(results, lambda r: r["type"] == "error")


def constructor_comment(decl: Column) -> Column:
    params, results = decl["params"], decl["results"]
    first = F.get(results, F.lit(0))["type"]
    built = F.when(first.isNull() | (first == "error"), _blank()).otherwise(first)
    return F.concat(
        F.lit("// "), decl["name"], F.lit(" creates a new instance"),
        _returns(results, " of ", lambda t: t), F.lit(".\n"),
        F.when(
            F.size(params) > 0,
            F.concat(
                F.lit("// It initializes the "), built, F.lit(" with the provided "),
                F.array_join(F.transform(params, _typed), ", "), F.lit(".\n"),
            ),
        ).otherwise(_blank()),
        F.when(
            _has_error(results),
            F.lit("// It's return an error if the initialization fails, otherwise nil.\n"),
        ).otherwise(_blank()),
    )


def function_comment(decl: Column, with_example: Column | None = None) -> Column:
    """Comment for a function or method; constructors have a wording of their own."""
    name, params, results = decl["name"], decl["params"], decl["results"]
    base = decl["receiver"]["base"]
    owner = F.when(base == "", _blank()).otherwise(
        F.concat(F.lit(" that belongs to the "), base, F.lit(" struct"))
    )
    lead = F.concat(F.lit("// "), name, F.lit(" is a "), _private(name), F.lit("method"), function_phrase(name), owner)
    takes = F.when(
        F.size(params) > 0,
        F.concat(F.lit(" that take "), F.array_join(F.transform(params, _with_article), ", ")),
    ).otherwise(_blank())
    returns = _returns(
        results, "\n// and returns ", lambda t: F.concat(indefinite_article(t), F.lit(" "), t)
    )
    fails = F.when(
        _has_error(results), F.lit(".\n// It's return an error if fails, otherwise nil")
    ).otherwise(_blank())
    plain = (F.size(params) == 0) & (F.size(results) == 0)
    text = F.when(plain, F.concat(lead, F.lit(".\n// It does not take any arguments.\n"))).otherwise(
        F.concat(lead, takes, returns, fails, F.lit(".\n"))
    )
    if with_example is not None:
        text = F.concat(text, F.when(with_example, usage_example(decl)).otherwise(_blank()))
    return F.when(is_constructor(name), constructor_comment(decl)).otherwise(text)


# Variable name and literal shown for a type in a usage example.
EXAMPLE_VARIABLES = {
    "bool": "valid", "int": "nb", "string": "str", "float32": "nb", "float64": "nb",
    "error": "err", "Context": "ctx",
}
EXAMPLE_LITERALS = {
    "bool": "true", "int": "50", "string": "my-string", "float32": "56.32", "float64": "56.64",
    "error": "nil", "Context": "ctx",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    found = F.when(F.lit(False), _blank())
    for name, shown in values.items():
        found = found.when(key == name, F.lit(shown))
    return found.otherwise(F.lit("unknown"))


def example_literal(type_text: Column) -> Column:
    """Literal for a type; a package-qualified type is looked up by its last name."""
    last = F.regexp_replace(type_text, r"^[^.*\[\] ]+\.", "")
    return let(last, lambda name: _lookup(EXAMPLE_LITERALS, name))


def example_variable(type_text: Column) -> Column:
    return F.when(type_text.contains("."), example_literal(type_text)).otherwise(
        _lookup(EXAMPLE_VARIABLES, type_text)
    )


def printf_format(count: Column) -> Column:
    return F.repeat(F.lit("%v "), count)


def usage_example(decl: Column) -> Column:
    """Example call; '' without inputs and outputs or when a type has no sample value."""
    values = F.struct(
        decl["name"].alias("name"),
        F.transform(decl["params"], lambda p: example_literal(p["type"])).alias("inputs"),
        F.transform(decl["results"], lambda r: example_variable(r["type"])).alias("outputs"),
        F.get(decl["params"], F.lit(0))["type"].alias("first"),
    )
    return let(values, _example_text)


def _example_text(values: Column) -> Column:
    inputs, outputs, first = values["inputs"], values["outputs"], values["first"]
    shown = F.filter(outputs, lambda o: o != "err")
    return F.when(
        ((F.size(inputs) == 0) & (F.size(outputs) == 0))
        | F.array_contains(inputs, "unknown")
        | F.array_contains(outputs, "unknown"),
        _blank(),
    ).otherwise(
        F.concat(
            F.lit("//\n// Example:\n//   "),
            F.when(
                F.coalesce(example_variable(first) == "ctx", F.lit(False)),
                F.lit("ctx := context.Background()\n//   "),
            ).otherwise(_blank()),
            F.when(F.size(outputs) > 0, F.concat(F.array_join(outputs, ", "), F.lit(" := "))).otherwise(_blank()),
            values["name"], F.lit("("), F.array_join(inputs, ", "), F.lit(")\n"),
            F.when(
                F.array_contains(outputs, "err"),
                F.lit('//   if err != nil {\n//       log.Fatalf("Error: %v", err)\n//   }\n'),
            ).otherwise(_blank()),
            F.when(
                F.size(shown) > 0,
                F.concat(
                    F.lit('//   fmt.Printf("'), printf_format(F.size(shown)), F.lit('", '),
                    F.array_join(shown, ", "), F.lit(")\n"),
                ),
            ).otherwise(_blank()),
        )
    )


def constant_comment(name: Column) -> Column:
    return F.concat(
        F.lit("// "), name, F.lit(" is a "), _private(name), F.lit("constant"), value_phrase(name), F.lit(".")
    )


def variable_comment(name: Column, type_text: Column) -> Column:
    return F.concat(
        F.lit("// "), name, F.lit(" is a "), _private(name), F.lit("variable of type "), type_text,
        value_phrase(name), F.lit("."),
    )


def struct_comment(name: Column, fields: Column) -> Column:
    """Names the mandatory fields first, then the optional (pointer) ones."""

    def listed(which: Column) -> Column:
        return F.array_join(
            F.transform(
                which,
                lambda f: F.concat(indefinite_article(f["name"]), F.lit(" "), _private(f["name"]), f["name"]),
            ),
            ", ",
        )

    mandatory = F.filter(fields, lambda f: ~f["is_ptr"])
    optional = F.filter(fields, lambda f: f["is_ptr"])
    return F.concat(
        F.lit("// "), name, F.lit(" represents a "), _private(name), F.lit("structure for "),
        F.when(
            F.size(mandatory) > 0, F.concat(F.lit("\n// It contains information about "), listed(mandatory))
        ).otherwise(_blank()),
        F.when(
            F.size(optional) > 0,
            F.concat(
                F.when(F.size(mandatory) > 0, F.lit(" and\n// optionally ")).otherwise(
                    F.lit("\n// It contains optional information about ")
                ),
                listed(optional),
            ),
        ).otherwise(_blank()),
        F.lit(".\n"),
    )


def alias_comment(name: Column, type_text: Column) -> Column:
    return F.concat(
        F.lit("// "), name, F.lit(" is a type alias for the "), type_text,
        F.lit(
            " type.\n// It allows you to create a new type with the same\n"
            "// underlying type as int, but with a different name.\n"
            "// This can be useful for improving code readability\n"
            "// and providing more semantic meaning to your types.\n"
        ),
    )


def author_line(signature: Column) -> Column:
    return F.when(F.coalesce(signature, _blank()) == "", _blank()).otherwise(
        F.concat(F.lit("//\n// Author: "), signature, F.lit("."))
    )


def spec_comment(kind: Column, spec: Column, has_paren: Column, signature: Column) -> Column:
    """Comment for one const/var/type spec, '' when it is documented.

    A group member gets no author line and takes its first name; a lone spec with
    several names takes the last.
    """
    names = spec["names"]
    name = F.when(has_paren, F.get(names, F.lit(0))).otherwise(F.get(names, F.size(names) - 1))
    return let(name, lambda n: _named_spec_comment(kind, spec, n, has_paren, signature))


def _named_spec_comment(kind: Column, spec: Column, name: Column, has_paren: Column, signature: Column) -> Column:
    author = author_line(signature)
    constant = constant_comment(name)
    variable = variable_comment(name, spec["type"])
    kind_of_type = F.when(spec["is_struct"], struct_comment(name, spec["fields"])).otherwise(
        alias_comment(name, spec["type"])
    )
    return (
        F.when((spec["doc"] != "") | name.isNull(), _blank())
        .when(kind == "type", F.concat(kind_of_type, author))
        .when(kind == "const", F.concat(constant, F.when(has_paren, _blank()).otherwise(F.concat(F.lit("\n"), author))))
        .otherwise(F.concat(variable, F.when(has_paren, _blank()).otherwise(F.concat(F.lit(".\n"), author))))
    )


def slash_lines(text: Column) -> Column:
    """Prefixes every line with ``// `` after dropping one final line feed and closing
    the text with a period."""
    cut = F.regexp_replace(text, r"\n\z", "")
    closed = let(cut, lambda t: F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit("."))))
    return F.concat(F.lit("// "), F.replace(closed, F.lit("\n"), F.lit("\n// ")))
