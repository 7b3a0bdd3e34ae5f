"""Per-directory configuration: nearest-ancestor lookup, merge and provider choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.once import with_once
from docloom.functions.text import directory, module_name

# Address and version used when a configuration names none.
DEFAULT_LOCAL_URL = "http://:5000"
DEFAULT_LOCAL_VERSION = 1

# Configuration keys by section ('' is the top level) and their types.
CONFIG_KEYS = {
    "": {"local": "string", "signature": "string", "update-comments": "boolean", "active-examples": "boolean"},
    "localai": {"active": "boolean", "url": "string", "api_model_version": "int"},
    "openai": {"active": "boolean", "api_key": "string", "url": "string"},
    "anthropic": {
        "active": "boolean", "url": "string", "sso-region": "string", "access-key": "string",
        "secret-key": "string", "session-token": "string",
    },
}


def field_name(section: str, key: str) -> str:
    name = key.replace("-", "_")
    return f"{section}_{name}" if section else name


FIELDS = {
    field_name(section, key): kind for section, keys in CONFIG_KEYS.items() for key, kind in keys.items()
} | {"prefixes": "array<string>"}
# An empty value counts as set for these; elsewhere an empty text or a zero is not set.
MAY_BE_EMPTY = {"signature", "openai_api_key", "anthropic_access_key", "anthropic_secret_key", "anthropic_session_token"}
# Never carried along with files.
SECRET_FIELDS = ["openai_api_key", "anthropic_access_key", "anthropic_secret_key", "anthropic_session_token"]
# Spellings of a boolean.
TRUE, FALSE = ("true", "yes", "on", "y"), ("false", "no", "off", "n")


def _scalar(text: Column) -> Column:
    """A plain or quoted value; a comment after it is dropped.  No value at all is null,
    an empty text between quotes is an empty text."""
    quoted = F.regexp_extract(text, r"""^(["'])(.*?)\1[ \t]*(?:#.*)?$""", 2)
    is_quoted = text.rlike(r"""^["']""")
    plain = F.trim(F.regexp_replace(text, r"(?:^|[ \t])#.*$", ""))
    value = F.when(is_quoted, quoted).otherwise(plain)
    return F.when(is_quoted | ~value.isin("", "null", "~"), value)


def _typed(value: Column, kind: str) -> Column:
    if kind == "boolean":
        word = F.lower(value)
        return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    return value.try_cast(kind)


# A flow mapping or list, which may go over several lines, or what is no part of one.
_QUOTED = r'"[^"\n]*+"|\'[^\'\n]*+\''
_PIECE = rf"(?d)#[^\n]*+|{_QUOTED}|(?<=: |:\t)(?:\{{(?:{_QUOTED}|[^{{}}\"'])*+\}}|\[(?:{_QUOTED}|[^\[\]\"'])*+\])|[^#\"'{{\[]++|[\s\S]"
# An entry of a flow mapping or list: a comma between quotes does not end it.
_ENTRY = rf"(?:{_QUOTED}|[^,\"'])++"
# A block scalar: key, style, and lines indented more than the key.
_BLOCK = r"(?md)^([ \t]*+)([\w.-]+):[ \t]++([|>])([+-]?)[ \t]*+(?:#[^\n]*+)?\n((?:\1[ \t]++[^\n]*+(?:\n|\z)|[ \t]*+\n)*+)"
_LINE = r"\A[ \t]*+(?:#.*+|[\w.-]++:(?:[ \t].*+)?|-(?:[ \t].*+)?|---|\.\.\.)?\z"
_UNCLOSED = r"(?md)(?:^[ \t]*+[\w.-]++:|^[ \t]*+-)[ \t]++(?:\{[^}\n]*+|\[[^\]\n]*+|\"[^\"\n]*+|'[^'\n]*+)$"


def _on_one_line(content: Column) -> Column:
    """Flow mappings and lists without line feeds and comments."""
    pieces = F.regexp_extract_all(content, F.lit(_PIECE), F.lit(0))
    flat = F.transform(
        pieces, lambda p: F.when(p.rlike(r"\A[{\[].*\n"), F.regexp_replace(F.regexp_replace(p, r"[ \t]#[^\n]*+", ""), r"\s*\n\s*", " ")).otherwise(p)
    )
    return F.array_join(flat, "")


def _block_text(body: Column, style: Column, chomp: Column) -> Column:
    """A block scalar's text: without its indentation, lines kept or folded, one line feed
    at the end unless it is chomped."""
    indent = F.length(F.regexp_extract(body, r"\A(?:[ \t]*\n)*([ \t]*)", 1))
    lines = F.transform(F.split(F.regexp_replace(body, r"\s++\z", ""), "\n"), lambda line: F.substr(line, indent + 1))
    kept = F.array_join(lines, "\n")
    text = F.when(style == ">", F.regexp_replace(kept, r"(?<!\n)\n(?!\n)", " ")).otherwise(kept)
    return F.when(chomp == "-", text).otherwise(F.concat(text, F.lit("\n")))


def parse_config(files: DataFrame) -> DataFrame:
    """``(path, content)`` of configuration files to one row of fields per directory.

    Spark's file sources skip dot-files, so the files come as a landed table.  A section
    is a block of indented lines or a flow mapping, on one line or several; values are
    plain, quoted, or block scalars.  A value that is not of its kind is null, and the first
    such field is named in ``bad_value``, as is a line that cannot be read and a value that
    is not closed: their folder is in error rather than without settings.
    """
    content = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))

    def section_text(whole: Column, section: str) -> Column:
        if not section:
            return whole
        block = F.regexp_extract(whole, rf"(?md)^{section}:[ \t]*(?:#[^\n]*)?\n((?:[ \t]+[^\n]*(?:\n|\z)|\n)*+)", 1)
        flow = F.regexp_extract(whole, rf"(?md)^{section}:[ \t]*\{{([^\n]*)\}}", 1)
        entries = F.transform(F.regexp_extract_all(flow, F.lit(_ENTRY), F.lit(0)), lambda e: F.concat(F.lit(" "), F.trim(e)))
        return F.when(block != "", block).otherwise(F.array_join(entries, "\n"))

    def raw(section: str, key: str) -> Column:
        indent = r"[ \t]+" if section else ""
        within, full = F.col(f"_cut.{section or 'top'}"), F.col(f"_cut.{section or 'top'}_full")
        plain = _scalar(F.trim(F.regexp_extract(within, rf"(?md)^{indent}{key}:[ \t]+([^\n]*)$", 1)))
        pattern = _BLOCK.replace(r"([ \t]*+)([\w.-]+)", rf"({indent})({key})")
        part = [F.regexp_extract(full, pattern, n) for n in (5, 3, 4)]
        return F.coalesce(plain, F.when(F.col("_cut.blocks") & (part[1] != ""), _block_text(*part)))

    def bad(name: str, kind: str) -> Column:
        given = F.col(f"_raw.{name}")
        return F.when(given.isNotNull() & _typed(given, kind).isNull(), F.lit(f"{name} is not of type {kind}"))

    keys = [(s, key) for s, keys in CONFIG_KEYS.items() for key in keys]
    kinds = {field_name(s, key): CONFIG_KEYS[s][key] for s, key in keys}
    # The text is laid out once, sections are cut out once, values found once.
    flat = with_once(files, "_flat", _on_one_line(content))
    bare = with_once(flat, "_bare", F.regexp_replace("_flat", _BLOCK, "$1$2:\n"))
    sections = [section_text(F.col("_bare"), s).alias(s or "top") for s in CONFIG_KEYS]
    full = [section_text(F.col("_flat"), s).alias(f"{s or 'top'}_full") for s in CONFIG_KEYS]
    cut = with_once(bare, "_cut", F.struct(*sections, *full, (F.col("_bare") != F.col("_flat")).alias("blocks")))
    found = with_once(cut, "_raw", F.struct(*[raw(s, key).alias(field_name(s, key)) for s, key in keys]))

    block = F.regexp_extract("_bare", r"(?md)^prefixes:[ \t]*(?:#[^\n]*)?\n((?:[ \t]*-[ \t]+[^\n]*(?:\n|\z))*+)", 1)
    flow = F.regexp_extract("_bare", r"(?md)^prefixes:[ \t]*\[([^\n]*)\]", 1)
    entries = F.when(block != "", F.regexp_extract_all(block, F.lit(r"(?md)^[ \t]*-[ \t]+([^\n]*)$"), F.lit(1))).otherwise(
        F.regexp_extract_all(flow, F.lit(_ENTRY), F.lit(0))
    )
    prefixes = F.filter(F.transform(entries, lambda e: _scalar(F.trim(e))), lambda e: e != "")
    strange = F.get(F.filter(F.split("_bare", "\n"), lambda line: ~line.rlike(_LINE)), F.lit(0))
    return found.select(
        directory(F.col("path")).alias("dir"),
        *[_typed(F.col(f"_raw.{name}"), kind).alias(name) for name, kind in kinds.items()],
        F.when(F.size(prefixes) > 0, prefixes).alias("prefixes"),
        F.coalesce(
            F.when(strange.isNotNull(), F.concat(F.lit("line cannot be read: "), F.trim(strange))),
            F.when(F.col("_bare").rlike(_UNCLOSED), F.lit("value is not closed")),
            *[bad(name, kind) for name, kind in kinds.items() if kind != "string"],
        ).alias("bad_value"),
    )


def module_dirs(files: DataFrame) -> DataFrame:
    """``(path, content)`` of go.mod files to ``(dir, module)``."""
    return files.select(directory(F.col("path")).alias("dir"), module_name(F.col("content")).alias("module"))


def ancestors(directory_path: Column) -> Column:
    """``array<struct<depth, dir>>`` from the directory itself (greatest depth) to the
    top: '/' for an absolute path, '.' for a relative one."""
    parts = F.filter(F.split(directory_path, "/"), lambda p: (p != "") & (p != "."))
    absolute = directory_path.startswith("/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.struct(
            n.alias("depth"),
            F.when(n == 0, F.when(absolute, F.lit("/")).otherwise(F.lit(".")))
            .otherwise(
                F.concat(
                    F.when(absolute, F.lit("/")).otherwise(F.lit("")),
                    F.array_join(F.slice(parts, F.lit(1), n), "/"),
                )
            )
            .alias("dir"),
        ),
    )


def resolve_configs(
    dirs: DataFrame,
    configs: DataFrame,
    modules: DataFrame,
    local: str | None = None,
    prefixes: list[str] | None = None,
) -> DataFrame:
    """The merged configuration of every directory in ``dirs``.

    The walk goes up to the first directory with a module file, inclusive, or to the
    top.  Settings nearer the file win, field by field; an empty text or a zero wins only
    where it means something (``MAY_BE_EMPTY``); ``local`` falls back to the argument,
    then to the module's name.  A bad value of any level is handed on.  Prefixes of all levels are appended from the
    top down.  A directory's group has one row per level, whatever the corpus holds.
    """
    distinct = dirs.select(F.col("dir").alias("of")).distinct()
    chain = distinct.select("of", F.explode(ancestors(F.col("of"))).alias("step")).select(
        "of", "step.depth", "step.dir"
    )
    chain = chain.join(modules.withColumn("has_module", F.lit(True)), ["dir"], "left")
    # The walk's end first, then one aggregate a field over the levels that count.
    ends = chain.groupBy("of").agg(F.max(F.when(F.col("has_module"), F.col("depth"))).alias("end"))
    levels = chain.join(ends, "of").filter(F.col("depth") >= F.coalesce("end", F.lit(0)))
    levels = levels.join(configs, ["dir"], "left")

    def is_set(name: str) -> Column:
        value = F.col(name)
        if name in MAY_BE_EMPTY or FIELDS.get(name) == "boolean":
            return value.isNotNull()
        return value != (0 if FIELDS.get(name) == "int" else "")

    def nearest(name: str) -> Column:
        return F.max_by(name, F.when(is_set(name), F.col("depth"))).alias(name)

    own = F.struct("depth", F.coalesce("prefixes", F.array().cast("array<string>")).alias("prefixes"))
    merged = levels.groupBy("of").agg(
        *[nearest(name) for name in [*FIELDS, "bad_value"] if name != "prefixes"],
        F.min_by("module", "depth").alias("_module"),
        F.array_sort(F.collect_list(own)).alias("_prefixes"),
    )
    fields = {name: F.col(name) for name in [*FIELDS, "bad_value"] if name != "prefixes"}
    root_local = F.lit(local) if local else F.col("_module")
    fields["local"] = F.coalesce(fields["local"], root_local, F.lit(""))
    for flag in ("update_comments", "active_examples"):
        fields[flag] = F.coalesce(fields[flag], F.lit(False))
    fields["localai_url"] = F.coalesce(fields["localai_url"], F.lit(DEFAULT_LOCAL_URL))
    appended = F.flatten(F.transform("_prefixes", lambda x: x["prefixes"]))
    fields["prefixes"] = F.concat(F.array(*[F.lit(p) for p in prefixes or []]).cast("array<string>"), appended)
    return merged.select(F.col("of").alias("dir"), *[column.alias(name) for name, column in fields.items()])


def _missing(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def choose_provider(resolved: DataFrame) -> DataFrame:
    """Adds ``provider``, ``model_version`` and ``config_error``.

    The first active provider of localai, openai, anthropic is taken, else the template.
    A bad value, or an active provider that lacks a required setting, is reported, not
    skipped.
    """

    def active(section: str) -> Column:
        return F.coalesce(F.col(f"{section}_active"), F.lit(False))

    provider = (
        F.when(active("localai"), F.lit("localai"))
        .when(active("openai"), F.lit("openai"))
        .when(active("anthropic"), F.lit("anthropic"))
        .otherwise(F.lit("template"))
    )
    required = {
        "localai": ["localai_url"],
        "openai": ["openai_api_key", "openai_url"],
        "anthropic": ["anthropic_url", "anthropic_access_key"],
    }
    error = F.when(F.col("bad_value").isNotNull(), F.col("bad_value"))
    for name, settings in required.items():
        for setting in settings:
            error = error.when((F.col("provider") == name) & _missing(setting), F.lit(f"{setting} is not set"))
    version = F.coalesce(F.nullif(F.col("localai_api_model_version"), F.lit(0)), F.lit(DEFAULT_LOCAL_VERSION))
    return (
        resolved.withColumn("provider", provider)
        .withColumn("model_version", F.when(F.col("provider") == "localai", version))
        .withColumn("config_error", error)
    )


def with_config(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Files with the configuration of their directory, without keys and secrets.

    Spark broadcasts the configurations if they are small; else adaptive execution splits
    the partition of a folder that holds much of the corpus.
    """
    placed = files.withColumn("dir", directory(F.col("path")))
    return placed.join(resolved.drop(*SECRET_FIELDS), ["dir"], "left")
