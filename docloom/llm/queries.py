"""Registered queries of the operators: name -> (spark, folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import licences
from docloom.llm.decontaminate import find_contamination
from docloom.llm.exact_dedup import exact_duplicates
from docloom.llm.language_id import held_out, predict_language, train
from docloom.llm.line_dedup import drop_repeated_lines
from docloom.llm.merkle import leaf_digest, lower_ascii, manifest
from docloom.llm.mixing import mix_sources
from docloom.llm.parity_join import similar_sets
from docloom.llm.quality_rules import judge
from docloom.llm.secrets import SINGLE, find_secrets
from docloom.llm.store import new_folder, stored
from docloom.llm.token_counts import token_counts
from docloom.llm.web_records import read_pages, resolve_revisits, write_pages
from docloom.llm.whitening import fixed_point, whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The counted tokenizer and its limit.
TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096


@query
def op1_quality_rules(spark, sf):
    judged, _ = judge(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op2_decontamination(spark, sf):
    found = find_contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _sql_words(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"regexp_extract_all(translate(COALESCE({column}, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLES["op2_decontamination"] = f"""
WITH i AS (SELECT item_id, {_sql_words("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS phrase
      FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {_sql_words("text")} AS w FROM documents),
s AS (SELECT DISTINCT n FROM p),
o AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, n, k FROM o JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
       sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query
def op3_language_id(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang", held_out("doc_id").alias("held_out"))
    trees = train(docs.filter(~F.col("held_out")))
    return predict_language(docs.select("doc_id", "held_out", "text"), trees, with_text=False)


@query
def op4_parity_join(spark, sf):
    return similar_sets(read(spark, sf, "documents"))


@query
def op5_licences(spark, sf):
    found = licences.scan_licences(read(spark, sf, "documents"), licences.known_licences(spark))
    return found.select("doc_id", "whole_licence", F.array_join("licences", ",").alias("licences"))


def _sql_canonical(text: str) -> str:
    out = f"' ' || replace(lower(regexp_replace(COALESCE({text}, ''), '{licences.PUNCTUATION}', ' ', 'g')), chr(10), chr(10) || ' ')"
    for old, new in licences.SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _sql_unit(block: str) -> str:
    lines = f"list_transform(string_split({block}, chr(10)), lambda l: trim(l))"
    return f"array_to_string(list_filter({lines}, lambda l: l <> '' AND (NOT regexp_matches(l, '{licences.COPYRIGHT}') OR regexp_matches(l, '{licences.TERM_LINE}'))), ' ')"


_SQL_KNOWN = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licences.KNOWN)

ORACLES["op5_licences"] = f"""
WITH k AS (SELECT sha256({_sql_unit('c')}) AS digest, min(licence) AS licence
           FROM (SELECT licence, {_sql_canonical('body')} AS c FROM (VALUES {_SQL_KNOWN}) v(licence, body)) GROUP BY 1),
d AS (SELECT doc_id, {_sql_canonical('text')} AS c FROM documents),
u AS (SELECT doc_id, true AS whole, {_sql_unit('c')} AS unit FROM d
      UNION ALL SELECT doc_id, false, {_sql_unit('b')} FROM (SELECT doc_id, unnest(string_split_regex(c, '{licences.BLOCK_END}')) AS b FROM d)
      UNION ALL SELECT doc_id, false, {_sql_unit('b')} FROM (SELECT doc_id, unnest(string_split(c, chr(10))) AS b FROM d)),
m AS (SELECT doc_id, min(licence) FILTER (whole) AS whole_licence, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences
      FROM u JOIN k ON sha256(u.unit) = k.digest WHERE unit <> '' GROUP BY 1)
SELECT doc_id, whole_licence, COALESCE(licences, '') AS licences FROM documents LEFT JOIN m USING (doc_id)
"""


@query
def op6_warc(spark, sf):
    """Pages to archives and back; a record that did not come back whole stops the job."""
    folder = new_folder(spark, "archives")
    write_pages(read(spark, sf, "pages"), folder)
    records = stored(read_pages(spark, folder, with_payload=False).drop("payload"), "records")
    resolved = resolve_revisits(records)
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("page_id"))
    return resolved.select(
        whole.cast("long").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


ORACLES["op6_warc"] = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT payload_digest, max(page_id) AS origin FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.payload_bytes >= 1000 AND d.page_id <> r.origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.payload_bytes >= 1000 AND d.page_id <> r.origin THEN r.origin END AS refers_to
FROM d LEFT JOIN r USING (payload_digest)
"""


@query
def op7_token_counts(spark, sf):
    """Counts through a cache that starts empty."""
    import public_tokenizers

    folder = new_folder(spark, "token-cache")
    counted = token_counts(read(spark, sf, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def _span_list(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


@query
def op8_secret_scans(spark, sf):
    found = find_secrets(read(spark, sf, "documents"))
    kinds = [kind for kind, *_ in SINGLE]

    def of(*wanted: str):
        return F.filter("spans", lambda s: s["kind"].isin(*wanted))

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return found.select("doc_id", *counts, F.sha2(_span_list(of(*kinds)), 256).alias("base_sha256"), _span_list(F.col("spans")).alias("spans"))


#: Every source is repeated twice at most, in a mix as large as the corpus.
REPETITIONS = 2.0


@query
def op9_mixing(spark, sf):
    return mix_sources(read(spark, sf, "documents"), repetitions=REPETITIONS)


@query
def op10_line_dedup(spark, sf):
    kept = drop_repeated_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query
def op11_whitening(spark, sf):
    white = whiten(fixed_point(read(spark, sf, "embeddings")))
    parts = white.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part"))
    return parts.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").cast("long").alias("deviation"),
        F.col("part.whitened").alias("whitened"), F.col("part.explained").alias("explained"), "identity_error",
    )


@query
def op12_exact_dedup(spark, sf):
    found = exact_duplicates(read(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op12_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, length(COALESCE(text, '')) AS n, sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept, text_sha256
FROM d
"""

#: The columns of a leaf, and one of how many documents is shown with another text.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
TAMPERED = 3


@query
def op13_merkle_manifest(spark, sf):
    changed = leaf_digest([lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in LEAF_COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    found = manifest(read(spark, sf, "documents"), LEAF_COLUMNS, shown=F.when(chosen, changed))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def _sql_levels(name: str, levels: int) -> str:
    """Tables {name}0 .. (tree, p, node, n), each with what stands left and right in a node's run
    as {name}_s0 ..: runs of eight become one node until the tree is one."""
    run = "PARTITION BY tree, p // 8 ORDER BY p ROWS BETWEEN"
    return "".join(
        f"""{name}_s{k} AS (SELECT tree, p, n, COALESCE(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
            COALESCE(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
{name}{k + 1} AS (SELECT tree, p // 8 AS p, sha256(string_agg(node, '' ORDER BY p)) AS node, (any_value(n) + 7) // 8 AS n FROM {name}{k} WHERE n > 1 GROUP BY tree, p // 8
            UNION ALL SELECT tree, p, node, n FROM {name}{k} WHERE n = 1),
"""
        for k in range(levels)
    )


def _sql_folds(rows: str, name: str, levels: int) -> str:
    """Tables {rows}0 .. of documents on their way up: place, folded digest, proof so far."""
    return "".join(
        f"""{rows}{k + 1} AS (SELECT m.* EXCLUDE (p, f, proof), p // 8 AS p, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, proof || l || r AS proof
            FROM {rows}{k} m JOIN {name}_s{k} USING (tree, p)),
"""
        for k in range(levels)
    )


#: Levels of a language's tree and of the tree of languages that the SQL has tables for.
_LEVELS, _TOP_LEVELS = 6, 2
_SQL_FRAMED = " || ".join(f"COALESCE(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in LEAF_COLUMNS)
_SQL_LOWERED = _SQL_FRAMED.replace("|| text", "|| translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: crc32 of the digits: each byte is xored in, then eight shifts follow (marked by -1).
_SQL_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_concat([ord(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295::BIGINT)"""

ORACLES["op13_merkle_manifest"] = f"""
WITH d AS (SELECT doc_id, COALESCE('=' || lang, '') AS tree, sha256({_SQL_FRAMED}) AS node, CASE WHEN {_SQL_CRC} % {TAMPERED} = 0 THEN sha256({_SQL_LOWERED}) END AS shown FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS p, count(*) OVER (PARTITION BY tree) AS n FROM d),
{_sql_levels('a', _LEVELS)}
m0 AS (SELECT doc_id, tree, p, node AS leaf, COALESCE(shown, node) AS f, '' AS proof FROM a0),
{_sql_folds('m', 'a', _LEVELS)}
b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, node, count(*) OVER () AS n, tree AS lang FROM a{_LEVELS}),
{_sql_levels('b', _TOP_LEVELS)}
k0 AS (SELECT doc_id, leaf, b0.node AS subroot, b0.tree, b0.p, f, proof FROM m{_LEVELS} m JOIN b0 ON m.tree = b0.lang),
{_sql_folds('k', 'b', _TOP_LEVELS)}
e AS (SELECT doc_id, leaf, subroot, b{_TOP_LEVELS}.node AS root, sha256(proof) AS proof_sha256, f AS folded_root FROM k{_TOP_LEVELS} CROSS JOIN b{_TOP_LEVELS})
SELECT *, folded_root = root AS verified FROM e
"""
