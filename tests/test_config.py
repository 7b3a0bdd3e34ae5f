"""Configuration lookup and providers."""

from __future__ import annotations

import pytest

from docloom.operators import config
from docloom.plans import commenter

FILES = "path string, content string"


def resolve(spark, dirs, configs, modules=(), **kwargs):
    resolved = config.resolve_configs(
        spark.createDataFrame([(d,) for d in dirs], "dir string"),
        config.parse_config(spark.createDataFrame(list(configs), FILES)),
        config.module_dirs(spark.createDataFrame(list(modules), FILES)),
        **kwargs,
    )
    return {r["dir"]: r for r in config.choose_provider(resolved).collect()}


ROOT = (
    "local: example.com/root\nsignature: 'root team'\nprefixes: [a, \"b\"]\nupdate-comments: true\n"
    "localai:\n  active: true\n  url: http://host:1 # here\n"
)
CHILD = "signature: child\r\nprefixes:\r\n  - c\r\nlocalai:\r\n  active: false\r\nopenai:\r\n  active: true\r\n  api_key: k\r\n  url: u\r\n"


def test_parse(spark):
    df = spark.createDataFrame([("/r/.comments.yaml", ROOT), ("/r/x/.comments.yaml", CHILD), (".comments.yaml", "")], FILES)
    got = {r["dir"]: r for r in config.parse_config(df).collect()}
    root, child, empty = got["/r"], got["/r/x"], got["."]
    assert (root["local"], root["signature"], root["prefixes"], root["update_comments"]) == ("example.com/root", "root team", ["a", "b"], True)
    assert (root["localai_active"], root["localai_url"], root["openai_active"]) == (True, "http://host:1", None)
    assert (child["signature"], child["prefixes"], child["localai_active"], child["openai_url"]) == ("child", ["c"], False, "u")
    assert all(empty[f] is None for f in config.FIELDS)


def test_nearest_wins_and_siblings_are_apart(spark):
    got = resolve(
        spark, ["/r", "/r/x", "/r/x/deep/er", "/r/y", "/"], [("/r/.comments.yaml", ROOT), ("/r/x/.comments.yaml", CHILD)]
    )
    assert got["/r"]["provider"] == got["/r/y"]["provider"] == "localai"
    assert got["/r/x"]["provider"] == got["/r/x/deep/er"]["provider"] == "openai"
    assert got["/r/x/deep/er"]["signature"] == "child" and got["/r/x/deep/er"]["local"] == "example.com/root"
    assert got["/r/x"]["prefixes"] == ["a", "b", "c"] and got["/r/y"]["prefixes"] == ["a", "b"]
    assert got["/"]["provider"] == "template" and got["/"]["signature"] is None and got["/"]["local"] == ""
    assert got["/r"]["model_version"] == 1 and got["/r"]["config_error"] is None


def test_module_file_bounds_the_walk(spark):
    modules = [("/r/x/go.mod", "// c\nmodule example.com/x\n"), ("/r/go.mod", "module example.com/r // no\n")]
    got = resolve(spark, ["/r/x/d", "/r/y"], [("/r/.comments.yaml", ROOT), ("/r/x/.comments.yaml", "signature: s\n")], modules)
    assert got["/r/x/d"]["local"] == "example.com/x" and got["/r/x/d"]["signature"] == "s"
    assert got["/r/x/d"]["provider"] == "template" and got["/r/x/d"]["prefixes"] == []
    assert got["/r/y"]["local"] == "example.com/root"


def test_arguments(spark):
    got = resolve(spark, ["a/b"], [], [("a/go.mod", "module m\n")], local="given", prefixes=["p"])
    assert got["a/b"]["local"] == "given" and got["a/b"]["prefixes"] == ["p"]


@pytest.mark.parametrize(
    "text, provider, error",
    [
        ("localai:\n  active: true\n", "localai", None),
        ("openai:\n  active: true\n  url: u\n", "openai", "openai_api_key is not set"),
        ("openai:\n  active: true\n  api_key: k\n", "openai", "openai_url is not set"),
        ("anthropic:\n  active: true\n  access-key: k\n", "anthropic", "anthropic_url is not set"),
        ("anthropic:\n  active: true\n  url: u\n", "anthropic", "anthropic_access_key is not set"),
        ("anthropic:\n  active: true\n  url: u\n  access-key: k\nopenai:\n  active: false\n", "anthropic", None),
        ("openai:\n  active: yes please\n", "template", "openai_active is not of type boolean"),
    ],
)
def test_providers(spark, text, provider, error):
    got = resolve(spark, ["d"], [("d/.comments.yaml", text)])["d"]
    assert (got["provider"], got["config_error"]) == (provider, error)


def test_comment_job(spark):
    files = spark.createDataFrame(
        [("r/a.go", "package p\n\nfunc A(x int) error {\n}\n"), ("r/x/b.go", "package p\n\nfunc B() {\n}\n"), ("r/c_test.go", "package p\n")],
        FILES,
    )
    configs = config.parse_config(
        spark.createDataFrame(
            [("r/.comments.yaml", "signature: me\nactive-examples: true\n"), ("r/x/.comments.yaml", "localai:\n  active: true\n  api_model_version: 4\n")], FILES
        )
    )
    modules = config.module_dirs(spark.createDataFrame([], FILES))
    placed = commenter.configured_files(files, configs, modules).cache()
    assert placed.count() == 2
    done = {r["path"]: r["new_content"] for r in commenter.commented_files(placed).collect()}
    assert "Example:" in done["r/a.go"] and "// Author: me.\nfunc A" in done["r/a.go"]
    asked = commenter.model_requests(placed).collect()
    assert [(r["path"], r["provider"], r["request"]) for r in asked] == [
        ("r/x/b.go", "localai", '{"text":"func B() ()","version":4}')
    ]


def test_empty_and_zero_values_flow_mappings_and_spellings(spark):
    parent = "signature: team\nlocalai:\n  active: true\n  api_model_version: 5\n  url: http://p\nopenai:\n  api_key: k\n"
    child = "signature: \"\"\nactive-examples: on\nlocalai: {active: true, url: \"\", api_model_version: 0}\nopenai: {api_key: '', active: No}\n"
    got = resolve(spark, ["r", "r/x"], [("r/.comments.yaml", parent), ("r/x/.comments.yaml", child)])
    assert (got["r"]["signature"], got["r"]["model_version"]) == ("team", 5)
    row = got["r/x"]
    assert (row["signature"], row["openai_api_key"], row["openai_active"], row["active_examples"]) == ("", "", False, True)
    assert (row["provider"], row["model_version"], row["localai_url"], row["config_error"]) == ("localai", 5, "http://p", None)


def test_a_bad_value_is_named(spark):
    got = resolve(spark, ["r/x"], [("r/.comments.yaml", "localai:\n  active: maybe\n"), ("r/x/.comments.yaml", "signature: s\n")])
    assert got["r/x"]["config_error"] == "localai_active is not of type boolean"


def test_keys_do_not_travel_with_files(spark):
    resolved = config.choose_provider(config.resolve_configs(
        spark.createDataFrame([("r",)], "dir string"), config.parse_config(spark.createDataFrame([("r/.comments.yaml", CHILD)], FILES)),
        config.module_dirs(spark.createDataFrame([], FILES)),
    ))
    files = config.with_config(spark.createDataFrame([("r/a.go",)], "path string"), resolved)
    assert not set(config.SECRET_FIELDS) & set(files.columns) and files.first()["provider"] == "openai"


def test_forms_of_several_lines(spark):
    texts = [
        "localai: { active: true,\n  url: http://h }\nsignature: x # c\n",
        "signature: |\n  line one\n    two\n\n  three\nlocal: a\n",
        'prefixes: ["a,b", c]\nsignature: >-\n  a\n  b\n',
        "openai:\n  api_key: |\n    url: no\n  url: \"http://x#y\"\n",
        'prefixes: [\n  "x, y", # first\n  z\n]\nanthropic: {active: yes, url: "a,b"}',
    ]
    rows = config.parse_config(spark.createDataFrame([(f"d{i}/.c", t) for i, t in enumerate(texts)], "path string, content string")).collect()
    found = {r["dir"]: {k: v for k, v in r.asDict().items() if v is not None and k != "dir"} for r in rows}
    assert found == {
        "d0": {"localai_active": True, "localai_url": "http://h", "signature": "x"},
        "d1": {"signature": "line one\n  two\n\nthree\n", "local": "a"},
        "d2": {"prefixes": ["a,b", "c"], "signature": "a b"},
        "d3": {"openai_api_key": "url: no\n", "openai_url": "http://x#y"},
        "d4": {"prefixes": ["x, y", "z"], "anthropic_active": True, "anthropic_url": "a,b"},
    }


def test_unreadable_lines_are_errors(spark):
    texts = ["localai: { active: true\nsignature: x\n", "what is this\nlocal: b\n", 'local: "a\n', "prefixes: [a\n", "localai:\n  active: maybe\n", "# c\n---\nlocal: fine\n"]
    rows = config.parse_config(spark.createDataFrame([(f"d{i}/.c", t) for i, t in enumerate(texts)], "path string, content string")).collect()
    assert [r["bad_value"] is not None for r in sorted(rows, key=lambda r: r["dir"])] == [True] * 5 + [False]
