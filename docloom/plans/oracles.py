"""Expected results as plain SQL over the same tables.

For corpora rendered from tables the SQL never looks at source text: it states what an
extractor must find straight from the columns.  For queries on texts it is a second,
relational formulation of the same rule.
"""

from __future__ import annotations

import math

from docloom.functions import grading, prompts
from docloom.plans.corpus import VERB_WORDS

ORACLES: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(values) -> str:
    return "(" + ", ".join(_text(v) for v in values) + ")"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) for v in values) + "]"


NL = "chr(10)"

# One row per rendered function.
FN = f"""
base AS (
  SELECT p_partkey AS k, p_partkey // 10 AS f, lower(p_name) AS phrase, replace(p_brand, '#', '') AS brand,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS words,
         {_list(VERB_WORDS)}[p_partkey % 10 + 1] AS verb, p_size AS size
  FROM part),
named AS (
  SELECT *, CASE WHEN k % 29 = 0 THEN 'main' WHEN k % 31 = 0 THEN 'init' ELSE verb || words END AS name,
         (k % 29 = 0 OR k % 31 = 0) AS entry,
         row_number() OVER (PARTITION BY f ORDER BY k) - 1 AS pos,
         f % 11 = 0 AS is_test, f % 11 <> 0 AND f % 17 = 0 AS is_example, f % 13 = 0 AS is_vendor,
         'file_' || f || CASE WHEN f % 11 = 0 THEN '_test' WHEN f % 17 = 0 THEN '_example' ELSE '' END AS stem
  FROM base),
fn AS (
  SELECT *, 'repo' || (f % 5) || '/' || CASE WHEN is_vendor THEN 'vendor/' ELSE '' END || 'pkg' || (f % 7) || '/' || stem || '.go' AS path,
         CASE k % 7 WHEN 1 THEN name || ' loads the value.' || {NL} WHEN 2 THEN 'TODO: ' || name || {NL}
           WHEN 3 THEN 'deprecated ' || name || {NL}
           WHEN 4 THEN name || ' stores the item.' || {NL} || 'It returns early when done.' || {NL}
           WHEN 5 THEN ' ' || name || ' stores it' || {NL} ELSE '' END AS doc,
         'func ' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN '(' || lower(brand[1:1]) || ' *' || brand || ') '
           ELSE '(' || lower(brand[1:1]) || ' ' || brand || ') ' END || name || '(' ||
           ['', 'size int', 'ctx context.Context, price float64', 'items []string, opts map[string]int', 'a int, b int'][k % 5 + 1]
           || ') (' || ['', 'error', 'string, error', '*' || brand || ', bool'][(k // 5) % 4 + 1] || ')' AS signature
  FROM named)"""

IGNORED = "regexp_matches(lower(doc), 'fixme|note|go:embed|todo|bug|deprecated')"
GENERATED = "NOT is_test AND NOT is_vendor"
BARE = "k % 7 IN (0, 6) AND NOT entry"

ORACLES["function_pairs"] = f"""
WITH {FN}
SELECT path, signature AS name, doc AS comment FROM fn
WHERE NOT is_test AND NOT is_example AND NOT is_vendor AND NOT entry AND doc <> '' AND NOT {IGNORED}"""

ORACLES["corpus_paths"] = f"""
WITH {FN} SELECT DISTINCT path FROM fn WHERE NOT is_test AND NOT is_example AND NOT is_vendor"""

ORACLES["file_stems"] = f"WITH {FN} SELECT DISTINCT path, stem AS file_name FROM fn"

ORACLES["undocumented_functions"] = f"""
WITH {FN}
SELECT path, name, k % 10 NOT IN (8, 9) AS exported FROM fn WHERE {GENERATED} AND {BARE}"""

ORACLES["last_comment_pairs"] = f"""
WITH {FN}
SELECT path, CASE WHEN k % 3 = 0 THEN name ELSE 'x' END AS name,
       CASE k % 7 WHEN 1 THEN '// ' || name || ' loads the value.' WHEN 4 THEN '// It returns early when done.'
         WHEN 5 THEN '/* ' || name || ' stores it */' ELSE '// ' || name || ' is an orphan.' END AS comment
FROM fn WHERE k % 7 IN (1, 4, 5, 6) AND NOT regexp_matches(name, 'FIXME|NOTE|TODO|BUG|deprecated')"""

# Draft of a function comment, clause by clause.
DRAFT = f"""
clauses AS (
  SELECT *,
    CASE WHEN k % 10 IN (8, 9) THEN 'private ' ELSE '' END AS private,
    CASE k % 10 WHEN 0 THEN ' that retrieve the ' || phrase WHEN 8 THEN ' that retrieve the ' || phrase
      WHEN 1 THEN ' which update the ' || phrase WHEN 2 THEN ' to initializes the ' || phrase
      WHEN 3 THEN ' to check the ' || phrase WHEN 4 THEN ' to check the ' || phrase
      ELSE ' which execute ' || lower(verb) || ' ' || phrase END AS explained,
    CASE WHEN k % 3 = 0 THEN '' ELSE ' that belongs to the ' || brand || ' struct' END AS owner,
    ['', 'a size of type int', 'a ctx of type context.Context, a price of type float64',
     'an items of type []string, an opts of type map[string]int', 'an a of type int, a b of type int'][k % 5 + 1] AS taken,
    ['', 'size of type int', 'ctx of type context.Context, price of type float64',
     'items of type []string, opts of type map[string]int', 'a of type int, b of type int'][k % 5 + 1] AS provided,
    (k // 5) % 4 AS r
  FROM fn),
drafts AS (
  SELECT *,
    CASE WHEN k % 10 = 5 THEN
      '// ' || name || ' creates a new instance' || ['', '', ' of string', ' of *' || brand || ' and bool'][r + 1] || '.' || {NL}
      || CASE WHEN k % 5 = 0 THEN '' ELSE '// It initializes the ' || ['', '', 'string', '*' || brand][r + 1] || ' with the provided ' || provided || '.' || {NL} END
      || CASE WHEN r IN (1, 2) THEN '// It''s return an error if the initialization fails, otherwise nil.' || {NL} ELSE '' END
    WHEN k % 5 = 0 AND r = 0 THEN
      '// ' || name || ' is a ' || private || 'method' || explained || owner || '.' || {NL} || '// It does not take any arguments.' || {NL}
    ELSE
      '// ' || name || ' is a ' || private || 'method' || explained || owner
      || CASE WHEN k % 5 = 0 THEN '' ELSE ' that take ' || taken END
      || ['', '', {NL} || '// and returns a string', {NL} || '// and returns a *' || brand || ' and a bool'][r + 1]
      || CASE WHEN r IN (1, 2) THEN '.' || {NL} || '// It''s return an error if fails, otherwise nil' ELSE '' END || '.' || {NL}
    END AS draft
  FROM clauses)"""

for _name, _test in (("func_comments", "k % 10 <> 5"), ("ctor_comments", "k % 10 = 5")):
    ORACLES[_name] = f"""
WITH {FN}, {DRAFT} SELECT path, name, draft AS comment FROM drafts WHERE {GENERATED} AND {BARE} AND {_test}"""

# Example call of a function; '' where a type has no sample value.
EXAMPLE = f"""CASE WHEN k % 5 = 3 OR (k // 5) % 4 = 3 OR (k % 5 = 0 AND (k // 5) % 4 = 0) THEN '' ELSE
  '//' || {NL} || '// Example:' || {NL} || '//   '
  || CASE WHEN k % 5 = 2 THEN 'ctx := context.Background()' || {NL} || '//   ' ELSE '' END
  || ['', 'err := ', 'str, err := '][(k // 5) % 4 + 1] || name || '(' || ['', '50', 'ctx, 56.64', '', '50, 50'][k % 5 + 1] || ')' || {NL}
  || CASE WHEN (k // 5) % 4 > 0 THEN '//   if err != nil {{' || {NL} || '//       log.Fatalf("Error: %v", err)' || {NL} || '//   }}' || {NL} ELSE '' END
  || CASE WHEN (k // 5) % 4 = 2 THEN '//   fmt.Printf("%v ", str)' || {NL} ELSE '' END END"""
ORACLES["usage_examples"] = f"""
WITH {FN} SELECT path, name, {EXAMPLE} AS example FROM fn WHERE {GENERATED} AND {BARE} AND k % 10 <> 5"""


def _commented(example: str, author: str, draft: str = "draft") -> str:
    """CTE ``blocks``: the commented text of every function; the arguments are SQL."""
    return f"""
blocks AS (
  SELECT f, k, path, {BARE} AS bare, {author} AS author,
    ['', '// ' || name || ' loads the value.' || {NL}, '// TODO: ' || name || {NL}, '// deprecated ' || name || {NL},
     '// ' || name || ' stores the item.' || {NL} || '// It returns early when done.' || {NL},
     '/* ' || name || ' stores it */' || {NL}, '// ' || name || ' is an orphan.' || {NL} || {NL}][k % 7 + 1]
    || CASE WHEN {BARE} THEN coalesce({draft} || {example} || '//' || {NL} || '// Author: ' || {author} || '.' || {NL}, '') ELSE '' END
    || 'func ' || ['', '(x *' || brand || ') ', '(x ' || brand || ') '][k % 3 + 1] || name || '('
    || ['', 'size int', 'ctx context.Context, price float64', 'items []string, opts map[string]int', 'a, b int'][k % 5 + 1]
    || ')' || ['', ' error', ' (string, error)', ' (*' || brand || ', bool)'][r + 1]
    || ' {{' || {NL} || chr(9) || '_ = "func Fake() {{}}"' || {NL} || '}}' || {NL} || {NL} AS block
  FROM drafts LEFT JOIN region ON f % 5 = r_regionkey WHERE {GENERATED})"""


ORACLES["rewritten_files"] = f"""
WITH {FN}, {DRAFT}, {_commented("''", "'corpus'")}
SELECT path, 'package p' || {NL} || {NL} || string_agg(block, '' ORDER BY k) AS new_content
FROM blocks GROUP BY f, path HAVING bool_or(bare)"""

# A patch that fits gives the commented file.
ORACLES["patched_files"] = ORACLES["rewritten_files"]

# Lines before a block: the file's two, those of earlier blocks, and an orphan comment's two.
ORACLES["inserted_comments"] = f"""
WITH {FN}, {DRAFT},
placed AS (
  SELECT *, 3 + coalesce(sum([0, 1, 1, 1, 2, 1, 2][k % 7 + 1] + 4) OVER (PARTITION BY f ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + CASE WHEN k % 7 = 6 THEN 2 ELSE 0 END AS line FROM drafts)
SELECT path, line::BIGINT AS line, draft || '//' || {NL} || '// Author: corpus.' || {NL} AS text FROM placed WHERE {GENERATED} AND {BARE}"""

_WITH_EXAMPLE = f"CASE WHEN f % 5 % 2 = 0 AND k % 10 <> 5 THEN {EXAMPLE} ELSE '' END"
ORACLES["commented_corpus"] = f"""
WITH {FN}, {DRAFT}, {_commented(_WITH_EXAMPLE, "r_name")}
SELECT path, author, 'package p' || {NL} || {NL} || string_agg(block, '' ORDER BY k) AS new_content
FROM blocks WHERE f % 5 NOT IN (1, 3) GROUP BY f, path, author"""

# Folder 1 has a chat provider without a key, so only folder 3 gives requests.
ORACLES["model_requests"] = f"""
WITH {FN}
SELECT path, 'localai' AS provider, '{{"text":"' || signature || '","version":3}}' AS request
FROM fn WHERE {GENERATED} AND {BARE} AND f % 5 = 3"""

# A comment of a model ends where the author's lines begin; broken answers leave nothing.
_REPLY = f"CASE WHEN pos % 5 NOT IN (2, 4) THEN '// note ' || name || {NL} || '// at place ' || pos || '.' END"
ORACLES["model_commented_files"] = f"""
WITH {FN}, {DRAFT}, {_commented("''", "r_name", _REPLY)}
SELECT path, author, 'package p' || {NL} || {NL} || string_agg(block, '' ORDER BY k) AS new_content
FROM blocks WHERE f % 5 = 3 GROUP BY f, path, author"""
ORACLES["rejected_folders"] = f"""
WITH {FN}
SELECT DISTINCT path, NULL::BIGINT AS pos, 'openai_api_key is not set' AS error FROM fn WHERE {GENERATED} AND f % 5 = 1
UNION ALL SELECT path, CASE WHEN pos % 5 = 3 THEN pos + 1000 ELSE pos END::BIGINT,
  CASE pos % 5 WHEN 4 THEN 'error decoding response' WHEN 2 THEN 'no answer' ELSE 'nothing was asked here' END
FROM fn WHERE {GENERATED} AND {BARE} AND f % 5 = 3 AND pos % 5 IN (2, 3, 4)"""

# One row per rendered const, var or type block.
DC = f"""
db AS (
  SELECT p_partkey AS k, p_partkey // 10 AS f, lower(p_name) AS phrase, replace(p_brand, '#', '') AS brand, p_size AS size,
         array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), '') AS words
  FROM part),
dc AS (
  SELECT *, CASE WHEN k % 4 = 0 THEN lower(words[1:1]) || words[2:] ELSE words END AS n, k % 4 <> 0 AS exported,
    CASE WHEN k % 4 = 0 THEN 'private ' ELSE '' END AS private,
    'repo' || (f % 5) || '/decl' || (f % 7) || '/decl_' || f || '.go' AS path, k % 7 = 0 AS documented,
    ['int', '*' || brand, 'map[string][]int', 'func'][size % 4 + 1] AS var_type,
    ['string', '[]int', 'interface{{}}'][size % 3 + 1] AS alias,
    ['ID,*Owner,size,extra', '*Owner,*next', 'Age'][(k // 6) % 3 + 1] AS fields
  FROM db),
specs AS (
  SELECT path, k, 'const' AS kind, n AS names, n AS name, exported, false AS has_paren, documented, 'unknown' AS type FROM dc WHERE k % 6 = 0
  UNION ALL SELECT path, k, 'var', n, n, exported, false, documented, var_type FROM dc WHERE k % 6 = 1
  UNION ALL SELECT path, k, 'type', n, n, exported, false, documented, fields FROM dc WHERE k % 6 = 2
  UNION ALL SELECT path, k, 'type', n, n, exported, false, documented, alias FROM dc WHERE k % 6 = 3
  UNION ALL SELECT path, k, 'const', n || 'URL', n || 'URL', exported, true, false, 'unknown' FROM dc WHERE k % 6 = 4
  UNION ALL SELECT path, k, 'const', 'second', 'second', false, true, true, 'unknown' FROM dc WHERE k % 6 = 4
  UNION ALL SELECT path, k, 'var', n || ', rest', n, exported, true, false, 'string' FROM dc WHERE k % 6 = 5
  UNION ALL SELECT path, k, 'var', n || ', rest', 'rest', false, true, false, 'string' FROM dc WHERE k % 6 = 5
  UNION ALL SELECT path, k, 'var', 'limit', 'limit', false, true, false, 'unknown' FROM dc WHERE k % 6 = 5)"""

ORACLES["declarations"] = f"""
WITH {DC}
SELECT path, kind, name, exported, has_paren, CASE WHEN documented THEN name || ' is documented.' || {NL} ELSE '' END AS doc, type
FROM specs"""

ORACLES["undocumented_declarations"] = f"""
WITH {FN}, {DC},
every AS (
  SELECT kind, exported FROM specs WHERE NOT documented
  UNION ALL SELECT 'func', k % 10 NOT IN (8, 9) FROM fn WHERE {GENERATED} AND {BARE})
SELECT kind, exported, count(*) AS n FROM every GROUP BY kind, exported"""

AUTHOR = f"'//' || {NL} || '// Author: corpus.'"
CONST = "'// ' || n || ' is a ' || private || 'constant' || phrase || '.'"
CONST_URL = "'// ' || n || 'URL is a ' || private || 'constant that indicates the endpoint URL for accessing to ' || phrase || ' .'"
VAR = "'// ' || n || ' is a ' || private || 'variable of type ' || var_type || phrase || '.'"
VAR_GROUP = "'// ' || n || ' is a ' || private || 'variable of type string' || phrase || '.'"
VAR_LIMIT = "'// limit is a private variable of type unknown.'"
STRUCT = f"""'// ' || n || ' represents a ' || private || 'structure for ' || {NL} || [
  '// It contains information about an ID, a private size, an private extra and' || {NL} || '// optionally an Owner',
  '// It contains optional information about an Owner, a private next',
  '// It contains information about an Age'][(k // 6) % 3 + 1] || '.' || {NL}"""
ALIAS = f"""'// ' || n || ' is a type alias for the ' || alias || ' type.' || {NL}
  || '// It allows you to create a new type with the same' || {NL} || '// underlying type as int, but with a different name.' || {NL}
  || '// This can be useful for improving code readability' || {NL} || '// and providing more semantic meaning to your types.' || {NL}"""

ORACLES["const_comments"] = f"""
WITH {DC}
SELECT path, n AS names, {CONST} || {NL} || {AUTHOR} AS comment FROM dc WHERE k % 6 = 0 AND NOT documented
UNION ALL SELECT path, n || 'URL', {CONST_URL} FROM dc WHERE k % 6 = 4"""

ORACLES["var_comments"] = f"""
WITH {DC}
SELECT path, n AS names, {VAR} || '.' || {NL} || {AUTHOR} AS comment FROM dc WHERE k % 6 = 1 AND NOT documented
UNION ALL SELECT path, n || ', rest', {VAR_GROUP} FROM dc WHERE k % 6 = 5
UNION ALL SELECT path, 'limit', {VAR_LIMIT} FROM dc WHERE k % 6 = 5"""

ORACLES["type_comments"] = f"""
WITH {DC}
SELECT path, n AS names, CASE k % 6 WHEN 2 THEN {STRUCT} ELSE {ALIAS} END || {AUTHOR} AS comment
FROM dc WHERE k % 6 IN (2, 3) AND NOT documented"""

ORACLES["rewritten_declarations"] = f"""
WITH {DC},
blocks AS (
  SELECT path, k, CASE WHEN documented THEN '// ' || n || ' is documented.' || {NL} ELSE '' END ||
    CASE k % 6
    WHEN 0 THEN CASE WHEN documented THEN '' ELSE {CONST} || {NL} END || 'const ' || n || ' = ' || size || {NL} || {NL}
    WHEN 1 THEN CASE WHEN documented THEN '' ELSE {VAR} || '.' || {NL} END || 'var ' || n || ' '
      || ['int', '*' || brand, 'map[string][4]int', 'func(int) error'][size % 4 + 1] || {NL} || {NL}
    WHEN 2 THEN CASE WHEN documented THEN '' ELSE {STRUCT} END || 'type ' || n || ' struct {{' || {NL} || [
      chr(9) || 'ID int' || {NL} || chr(9) || 'Owner *Brand' || {NL} || chr(9) || 'size, extra string // sizes' || {NL} || chr(9) || 'base' || {NL},
      chr(9) || 'Owner *Brand' || {NL} || chr(9) || 'next *Brand' || {NL},
      chr(9) || 'Age int `json:"age"`' || {NL} || {NL} || chr(9) || 'base' || {NL}][(k // 6) % 3 + 1] || '}}' || {NL} || {NL}
    WHEN 3 THEN CASE WHEN documented THEN '' ELSE {ALIAS} END || 'type ' || n || ' '
      || ['string', '[]int', 'interface {{' || {NL} || chr(9) || 'Run() error' || {NL} || '}}'][size % 3 + 1] || {NL} || {NL}
    WHEN 4 THEN 'const (' || {NL} || chr(9) || {CONST_URL} || {NL} || chr(9) || n || 'URL = "x"' || {NL} || {NL}
      || chr(9) || '// second is documented.' || {NL} || chr(9) || 'second = 2' || {NL} || ')' || {NL} || {NL}
    ELSE 'var (' || {NL} || chr(9) || {VAR_GROUP} || {NL} || chr(9) || n || ', rest string' || {NL}
      || chr(9) || {VAR_LIMIT} || {NL} || chr(9) || 'limit = 3' || {NL} || ')' || {NL} || {NL}
    END AS block
  FROM dc)
SELECT path, 'package p' || {NL} || {NL} || string_agg(block, '' ORDER BY k) AS new_content FROM blocks GROUP BY path"""

ORACLES["changed_files"] = f"""
WITH {FN}, {DC}
SELECT DISTINCT path FROM fn WHERE {GENERATED} AND {BARE}
UNION SELECT DISTINCT path FROM specs WHERE NOT documented"""

ORACLES["name_phrases"] = f"""
WITH {FN},
w AS (SELECT *, CASE WHEN entry THEN name ELSE lower(verb) || ' ' || phrase END AS spaced FROM fn)
SELECT k, name, spaced AS words, CASE WHEN entry THEN 1 ELSE 1 + len(string_split(phrase, ' ')) END AS n_words,
  ' that indicates the endpoint URL for accessing to ' || spaced || ' ' AS value_phrase,
  CASE WHEN entry THEN '' WHEN k % 10 IN (0, 8) THEN ' that retrieve the ' || phrase WHEN k % 10 = 1 THEN ' which update the ' || phrase
    WHEN k % 10 = 2 THEN ' to initializes the ' || phrase WHEN k % 10 IN (3, 4) THEN ' to check the ' || phrase
    ELSE ' which execute ' || spaced END AS function_phrase,
  CASE WHEN phrase[1:1] IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS article,
  NOT entry AND k % 10 NOT IN (8, 9) AS exported, NOT entry AND k % 10 = 5 AS constructor
FROM w"""

ORACLES["prompt_requests"] = f"""
WITH {FN}
SELECT path, name, ['localai', 'openai', 'anthropic'][pos % 3 + 1] AS provider,
  CASE pos % 3
  WHEN 0 THEN '{{"text":"' || signature || '","version":' || (pos + 1) || '}}'
  WHEN 1 THEN '{{"max_tokens":150,"messages":[{{"role":"system","content":"{prompts.CHAT_SYSTEM}"}},{{"role":"user","content":"'
    || replace({_text(prompts.CHAT_PROMPT)}, {NL}, '\\n') || signature || '"}}],"model":"{prompts.CHAT_MODEL}","temperature":0.7}}'
  ELSE '{{"prompt":"' || replace({_text(prompts.COMPLETION_PROMPT)}, {NL}, '\\n') || signature
    || '","max_tokens":150,"model":"{prompts.COMPLETION_MODEL}","temperature":0.7}}' END AS request
FROM fn WHERE {GENERATED} AND {BARE}"""

ORACLES["response_decode"] = """
SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN p_name END AS comment,
  CASE p_partkey % 6 WHEN 3 THEN 'error: no choices found in response' WHEN 4 THEN 'error: no text found in response choice'
    WHEN 5 THEN 'error decoding response' END AS error
FROM part"""

ORACLES["line_counts"] = """
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count FROM documents"""

ORACLES["rejected_files"] = "SELECT 'doc' || doc_id AS path FROM documents"

ORACLES["slash_comments"] = """
WITH cut AS (SELECT doc_id, CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END AS t FROM documents)
SELECT doc_id, '// ' || replace(t, chr(10), chr(10) || '// ') || CASE WHEN right(t, 1) = '.' THEN '' ELSE '.' END AS comment FROM cut"""

# -- configuration ---------------------------------------------------------------------

CFG = """
dirs AS (SELECT DISTINCT l_suppkey AS s, 'org' || l_suppkey || '/lib/pkg' || (l_partkey % 7) AS dir FROM lineitem),
resolved AS (
  SELECT dir, s, s % 3 = 0 AS own_module, s % 2 = 1 AS has_lib,
    CASE WHEN s % 3 = 0 THEN 'example.com/org' || s ELSE '' END AS local,
    CASE WHEN s % 2 = 1 THEN 'lib-' || s WHEN s % 3 <> 0 THEN s_name END AS signature,
    s % 2 = 1 AS active_examples,
    CASE WHEN s % 3 <> 0 THEN s % 4 = 0 END AS localai_active,
    'http://:5000' AS localai_url,
    CASE WHEN s % 3 <> 0 THEN (s % 3)::INTEGER END AS localai_api_model_version,
    CASE WHEN s % 2 = 1 THEN s % 5 = 1 END AS openai_active,
    CASE WHEN s % 3 <> 0 THEN 'key' || s END AS openai_api_key,
    CASE WHEN s % 10 = 1 THEN 'https://chat.example' END AS openai_url,
    concat_ws(',', CASE WHEN s % 3 <> 0 THEN 'org' || s || '/api' END, CASE WHEN s % 2 = 1 THEN 'lib' || s END) AS prefixes
  FROM dirs JOIN supplier ON s = s_suppkey),
chosen AS (
  SELECT *, CASE WHEN coalesce(localai_active, false) THEN 'localai' WHEN coalesce(openai_active, false) THEN 'openai' ELSE 'template' END AS provider
  FROM resolved)"""

ORACLES["resolved_config"] = f"""
WITH {CFG}
SELECT dir, local, signature, active_examples, localai_active, localai_url, localai_api_model_version, openai_active,
  openai_api_key, openai_url, prefixes FROM chosen"""

ORACLES["provider_choice"] = f"""
WITH {CFG}
SELECT dir, provider, CASE WHEN provider = 'localai' THEN localai_api_model_version END AS model_version,
  CASE WHEN provider = 'openai' AND openai_api_key IS NULL THEN 'openai_api_key is not set' END AS config_error
FROM chosen"""

ORACLES["files_by_provider"] = f"""
WITH {CFG}
SELECT provider, local, count(*) AS n_files
FROM lineitem JOIN chosen ON dir = 'org' || l_suppkey || '/lib/pkg' || (l_partkey % 7) GROUP BY provider, local"""

ORACLES["module_names"] = """
SELECT 'org' || s_suppkey || '/lib' AS dir, 'example.com/org' || s_suppkey AS module FROM supplier WHERE s_suppkey % 3 = 0"""

# -- grading ---------------------------------------------------------------------------

TOKEN = r"'[\p{L}\p{N}_]+|\n+|[^\p{L}\p{N}_\s]'"
LEX = grading.DEFAULT_LEXICON
VERBS, STOP, TECH = _words(LEX.verbs), _words(LEX.stop_words), _words(LEX.tech_terms)


def _undone(stem: str) -> str:
    return f"""CASE WHEN {stem} IN {VERBS} THEN {stem} WHEN {stem} || 'e' IN {VERBS} THEN {stem} || 'e'
      WHEN right({stem}, 1) = left(right({stem}, 2), 1) AND left({stem}, length({stem}) - 1) IN {VERBS} THEN left({stem}, length({stem}) - 1)
      ELSE {stem} END"""


_IRREGULAR = " ".join(f"WHEN w = {_text(k)} THEN {_text(v)}" for k, v in LEX.lemmas.items())
_CLOSED = " ".join(f"WHEN w IN {_words(ws)} THEN {_text(tag)}" for tag, ws in LEX.closed.items())

# Tokens of documents with lemma and tag; lemma and tag are worked out once per word.
TAGGED = f"""
pieces AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) AS pos FROM
  (SELECT doc_id, regexp_extract_all(text, {TOKEN}) AS l FROM documents)),
vocab AS (SELECT text AS t, lower(text) AS w FROM pieces GROUP BY text),
lemmas AS (
  SELECT t, w, CASE WHEN w IN {VERBS} THEN w {_IRREGULAR} WHEN w IN {STOP} THEN w
    WHEN right(w, 3) = 'ing' AND length(w) > 5 THEN {_undone("left(w, length(w) - 3)")}
    WHEN right(w, 2) = 'ed' AND length(w) > 4 THEN {_undone("left(w, length(w) - 2)")}
    WHEN right(w, 1) = 's' AND left(w, length(w) - 1) IN {VERBS} THEN left(w, length(w) - 1)
    WHEN right(w, 2) = 'es' AND left(w, length(w) - 2) IN {VERBS} THEN left(w, length(w) - 2)
    WHEN right(w, 3) = 'ies' AND length(w) > 4 THEN left(w, length(w) - 3) || 'y'
    WHEN right(w, 1) = 's' AND length(w) > 3 AND right(w, 2) NOT IN ('ss', 'us', 'is') THEN left(w, length(w) - 1)
    ELSE w END AS lemma
  FROM vocab),
lexicon AS (
  SELECT t, w, lemma, CASE WHEN t[1:1] = {NL} THEN 'SPACE' {_CLOSED}
    WHEN regexp_full_match(t, '\\p{{Nd}}+') THEN 'NUM' WHEN regexp_full_match(t, '[^\\p{{L}}\\p{{N}}_]') THEN 'PUNCT'
    WHEN lemma IN {VERBS} OR (right(w, 3) = 'ing' AND length(w) > 5) OR (right(w, 2) = 'ed' AND length(w) > 4) THEN 'VERB'
    WHEN right(w, 2) = 'ly' AND length(w) > 4 THEN 'ADV' ELSE 'NOUN' END AS tag,
    w IN {STOP} AS is_stop
  FROM lemmas)"""

GRADE = """CASE WHEN n_tokens < 5 OR n_verbs < 1 THEN 'poor' WHEN n_stop > 0.5 * n_tokens OR n_tech < 1 THEN 'average' ELSE 'good' END"""
GRADED = f"""
counted AS (
  SELECT d.doc_id, count(p.text) AS n_tokens, count(*) FILTER (tag = 'VERB') AS n_verbs, count(*) FILTER (is_stop) AS n_stop,
    count(*) FILTER (lemma IN {TECH}) AS n_tech
  FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id LEFT JOIN lexicon ON p.text = t GROUP BY d.doc_id)"""

ORACLES["comment_grades"] = f"WITH {TAGGED}, {GRADED} SELECT *, {GRADE} AS grade FROM counted"
ORACLES["grades_with_gaps"] = f"""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE n_tokens END AS n_tokens, CASE WHEN doc_id % 5 = 0 THEN 'poor' ELSE grade END AS grade
FROM ({ORACLES['comment_grades']})"""
ORACLES["graded_good"] = f"WITH {TAGGED}, {GRADED} SELECT doc_id FROM counted WHERE {GRADE} = 'good'"

_ENTITY = f"(tag = 'NUM' OR p.text IN {_words(LEX.entities)})"
ORACLES["comment_analysis"] = f"""
WITH {TAGGED}
SELECT d.doc_id, coalesce(string_agg(p.text, ' ' ORDER BY pos), '') AS tokens, coalesce(string_agg(lemma, ' ' ORDER BY pos), '') AS lemmas,
  coalesce(string_agg(tag, ' ' ORDER BY pos), '') AS pos_tags,
  coalesce(string_agg(CASE WHEN {_ENTITY} THEN p.text || '/' || CASE WHEN p.text IN {_words(LEX.entities)} THEN 'DATE' ELSE 'CARDINAL' END END, ' ' ORDER BY pos), '') AS entities
FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id LEFT JOIN lexicon ON p.text = t GROUP BY d.doc_id"""

ORACLES["lexicon_grades"] = f"""
WITH {TAGGED},
supplied AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), {TOKEN})) AS word FROM benchmark)
  WHERE regexp_full_match(word, '\\p{{L}}+')),
merged AS (
  SELECT t, coalesce(word, lemma) AS lemma, CASE WHEN word IS NULL THEN tag WHEN right(word, 1) = 'h' THEN 'VERB' ELSE 'NOUN' END AS tag,
    CASE WHEN word IS NULL THEN is_stop ELSE length(word) <= 3 END AS is_stop
  FROM lexicon LEFT JOIN supplied ON w = word),
counted AS (
  SELECT d.doc_id, count(p.text) AS n_tokens, count(*) FILTER (tag = 'VERB') AS n_verbs, count(*) FILTER (is_stop) AS n_stop,
    count(*) FILTER (lower(lemma) IN {TECH}) AS n_tech
  FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id LEFT JOIN merged ON p.text = t GROUP BY d.doc_id)
SELECT *, {GRADE} AS grade FROM counted"""

ORACLES["model_inputs"] = f"""
WITH {TAGGED}
SELECT d.doc_id, any_value(d.source) || ' ' || any_value(d.lang) || '-doc' AS input,
  any_value(d.text) || ' POS: [' || coalesce(string_agg('''' || tag || '''', ', ' ORDER BY pos), '') || ']' AS target
FROM documents d LEFT JOIN pieces p ON d.doc_id = p.doc_id LEFT JOIN lexicon ON p.text = t GROUP BY d.doc_id"""

# Graded dataset of the rendered functions.  Tags and lemmas of the fixed words are known;
# a function's name is an unlisted word, a verb when it ends in "ing".
ORACLES["graded_dataset"] = f"""
WITH {FN},
kept AS (
  SELECT *, right(name, 3) = 'ing' AS ing FROM fn
  WHERE NOT is_test AND NOT is_example AND NOT is_vendor AND NOT entry AND k % 7 IN (1, 4) AND NOT {IGNORED}),
lead AS (
  SELECT *, CASE WHEN ing THEN left(lower(name), length(name) - 3) ELSE lower(name) END AS base,
    CASE WHEN ing THEN 'VERB' ELSE 'NOUN' END AS tag FROM kept)
SELECT stem AS file_name, signature AS name, doc AS comment,
  tag || CASE k % 7 WHEN 1 THEN ' VERB DET NOUN PUNCT SPACE'
    ELSE ' VERB DET NOUN PUNCT SPACE PRON VERB ADV SCONJ NOUN PUNCT SPACE' END AS pos_tags,
  base || CASE k % 7 WHEN 1 THEN ' load the value . ' || {NL}
    ELSE ' store the item . ' || {NL} || ' it return early when done . ' || {NL} END AS lemmas
FROM lead"""

ORACLES["streamed_dataset"] = f"SELECT file_name, name, comment FROM ({ORACLES['graded_dataset']})"

# -- web and code-host corpora ---------------------------------------------------------

ORACLES["warc_responses"] = """
SELECT url, length(html) AS n_chars, md5(html) AS digest FROM pages WHERE page_id % 5 <> 0"""

FENCED = f"""
fenced AS (SELECT page_id, regexp_extract_all(replace(replace(html, '<p>', '```go' || {NL}), '</p>', {NL} || '```'), '(?s)```go(.*?)```', 1) AS l FROM pages)"""
ORACLES["fenced_snippets"] = f"""
WITH {FENCED} SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS snippet FROM fenced"""
ORACLES["snippet_lists"] = f"""
WITH {FENCED} SELECT page_id, len(l) AS n_snippets, array_to_string(l, '|') AS snippets FROM fenced"""

REPOS = """
repos AS (SELECT 'owner' || s_nationkey AS owner, 'repo' || s_suppkey AS repo, round(s_acctbal * 100)::BIGINT AS stars, s_suppkey, s_suppkey % 3 <> 0 AS is_go FROM supplier),
entries AS (SELECT DISTINCT owner, repo, stars, s_suppkey, l_partkey AS k FROM lineitem JOIN repos ON l_suppkey = s_suppkey)"""
ORACLES["repo_top"] = f"""
WITH {REPOS} SELECT owner, repo, stars FROM repos WHERE is_go ORDER BY stars DESC, owner, repo LIMIT 5 OFFSET 5"""
ORACLES["repo_listing"] = f"""
WITH {REPOS} SELECT owner, repo, count(*) AS n_files FROM entries WHERE k % 4 <> 0 GROUP BY owner, repo"""
ORACLES["repo_blobs"] = f"""
WITH {REPOS}, best AS (SELECT s_suppkey FROM repos WHERE is_go ORDER BY stars DESC, owner, repo LIMIT 10)
SELECT owner, repo, 'src/f' || k || '.go' AS path, 'package p // ' || p_name || {NL} AS content
FROM entries JOIN part ON k = p_partkey WHERE s_suppkey IN (SELECT s_suppkey FROM best) AND k % 4 <> 0 AND k % 9 <> 0"""

ORACLES["repo_tree"] = f"""
WITH {REPOS} SELECT owner, repo, 'src/f' || k || '.go' AS path FROM entries WHERE k % 4 <> 0"""

_NAME_WORDS = r"regexp_extract_all(COALESCE(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES["entity_spans"] = f"""
WITH RECURSIVE i AS (SELECT item_id, {_NAME_WORDS} AS w FROM benchmark),
g AS (SELECT name, min(label) AS label, len(string_split(name, ' ')) AS n FROM (
  SELECT CASE item_id % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'PLACE' ELSE 'GROUP' END AS label,
    unnest([array_to_string(w[1:2], ' '), array_to_string(w[1:4], ' '), array_to_string(w[3:7], ' '), array_to_string(w[2:2], ' ')]) AS name
  FROM i) WHERE name <> '' GROUP BY name),
d AS (SELECT doc_id, {_NAME_WORDS} AS w FROM documents),
o AS (SELECT doc_id, k, n, array_to_string(w[k + 1 : k + n], ' ') AS name
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
m AS (SELECT doc_id, k AS b, max(k + n) AS e, arg_max(name, n) AS name, arg_max(label, n) AS label FROM o JOIN g USING (name, n) GROUP BY doc_id, k),
nx AS (SELECT m.doc_id, m.b, m.e, m.name, m.label, f.b AS nb FROM m ASOF LEFT JOIN m AS f ON m.doc_id = f.doc_id AND f.b >= m.e),
p AS (SELECT nx.* FROM nx JOIN (SELECT doc_id, min(b) AS b FROM m GROUP BY 1) USING (doc_id, b)
  UNION ALL SELECT nx.* FROM p JOIN nx ON nx.doc_id = p.doc_id AND nx.b = p.nb)
SELECT doc_id, b::INT AS "begin", e::INT AS "end", name, label FROM p"""

# -- writers and readers, there and back ---------------------------------------------------

_BREAK = "chr(13) || chr(10)"
ORACLES["archive_files"] = f"""
SELECT url, false AS cut_short,
  md5(html || CASE WHEN page_id % 3 = 0 THEN {_BREAK} || {_BREAK} ELSE '' END
      || CASE WHEN page_id % 4 = 0 THEN {NL} || 'WARC/1.1' || {_BREAK} || 'WARC-Type: none' || {_BREAK} ELSE '' END) AS digest
FROM pages"""
ORACLES["archive_members"] = f"{ORACLES['archive_files']} WHERE page_id % 5 <> 0"
ORACLES["archive_table"] = """
SELECT CASE WHEN page_id % 5 = 0 THEN 'request' ELSE 'response' END AS rec_type, count(*) AS n FROM pages GROUP BY 1"""
ORACLES["csv_pairs"] = f"SELECT name, comment FROM ({ORACLES['function_pairs']})"
ORACLES["appended_dataset"] = f"""
WITH g AS ({ORACLES['graded_dataset']})
SELECT '20240131_07' AS bucket, name, comment, count(*) + 1 AS n FROM g GROUP BY name, comment"""
ORACLES["idempotent_append"] = f"""
WITH g AS ({ORACLES['graded_dataset']})
SELECT '20240131_07' AS bucket, file_name, name, comment, count(*) * CASE WHEN file_name LIKE '%1' THEN 2 ELSE 1 END AS n
FROM g GROUP BY file_name, name, comment
UNION ALL SELECT '20240131_08', file_name, name, comment, count(*) FROM g WHERE file_name LIKE '%3' GROUP BY file_name, name, comment"""
ORACLES["json_pairs"] = ORACLES["function_pairs"]
ORACLES["written_files"] = f"SELECT path, new_content AS content FROM ({ORACLES['rewritten_files']})"

# -- training set ----------------------------------------------------------------------

SPLIT = """
placed AS (
  SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) > count(*) OVER () - ceil(0.1::DOUBLE * count(*) OVER ())
    THEN 'validation' ELSE 'train' END AS split FROM documents)"""
BATCHED = f"""
{SPLIT},
batched AS (
  SELECT split, doc_id, (row_number() OVER (PARTITION BY split ORDER BY
    CASE WHEN split = 'train' THEN md5('2022:0:' || doc_id) ELSE '' END, doc_id) - 1) // 8 AS batch FROM placed)"""
ORACLES["train_split"] = f"WITH {SPLIT} SELECT doc_id, split FROM placed"
ORACLES["train_batches"] = f"WITH {BATCHED} SELECT split, batch, doc_id FROM batched"
ORACLES["train_plan"] = f"""
WITH {SPLIT},
c AS (SELECT count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'validation') AS validation_rows FROM placed),
s AS (SELECT *, train_rows // 8 AS train_steps, (validation_rows + 7) // 8 AS validation_steps, 60::BIGINT AS epochs FROM c)
SELECT *, train_steps * epochs AS total_steps, ceil(train_steps * epochs * 0.2::DOUBLE)::BIGINT AS warmup_steps FROM s"""
ORACLES["epoch_order"] = """
SELECT epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('2022:' || epoch || ':' || doc_id), doc_id) - 1 AS position, doc_id
FROM documents, range(3) AS e(epoch)"""
ORACLES["random_pick"] = f"""
WITH {SPLIT} SELECT doc_id FROM placed WHERE split = 'validation' ORDER BY md5('2022:0:' || doc_id) LIMIT 1"""

ENCODING = f"""
{SPLIT},
texts AS (SELECT doc_id, split, regexp_extract_all(source || ' ' || lang || '-doc', {TOKEN}) AS i, regexp_extract_all(text, {TOKEN}) AS o
  FROM documents JOIN placed USING (doc_id)),
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_concat(i, o)) AS token FROM texts WHERE split = 'train') GROUP BY token),
ranked AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id, n FROM counts),
words AS (SELECT * FROM ranked),
cut AS (
  SELECT doc_id, 0 AS side, unnest(i[1:46]) AS token, generate_subscripts(i[1:46], 1) AS pos FROM texts
  UNION ALL SELECT doc_id, 1, unnest(o[1:126]), generate_subscripts(o[1:126], 1) FROM texts),
found AS (SELECT doc_id, side, list(coalesce(token_id, 3) ORDER BY pos) AS ids FROM cut LEFT JOIN words USING (token) GROUP BY doc_id, side),
framed AS (
  SELECT doc_id, list_resize(list_concat([1], coalesce(a.ids, []), [2]), 48, 0) AS x, list_resize(list_concat([1], coalesce(b.ids, []), [2]), 128, 0) AS y
  FROM documents LEFT JOIN (SELECT * FROM found WHERE side = 0) a USING (doc_id) LEFT JOIN (SELECT * FROM found WHERE side = 1) b USING (doc_id))"""
ORACLES["vocabulary"] = f"WITH {ENCODING} SELECT token, token_id, n FROM words"
ORACLES["encoded_features"] = f"""
WITH {ENCODING}
SELECT doc_id, array_to_string(x, ',') AS input_ids,
  array_to_string(list_transform(x, lambda v: CASE WHEN v = 0 THEN 0 ELSE 1 END), ',') AS attention_mask,
  array_to_string(list_transform(y, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END), ',') AS labels
FROM framed"""
ORACLES["label_counts"] = f"""
WITH {ENCODING},
numbered AS (SELECT doc_id, (row_number() OVER (ORDER BY md5('2022:0:' || doc_id), doc_id) - 1) // 8 AS batch FROM placed WHERE split = 'train')
SELECT batch, sum(len(list_filter(y, lambda v: v <> 0)))::BIGINT AS n_labels FROM numbered JOIN framed USING (doc_id) GROUP BY batch"""

ORACLES["training_batches"] = f"""
WITH {ENCODING}
SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY md5('2022:' || epoch || ':' || doc_id), doc_id) - 1) // 8 AS batch,
  doc_id, array_to_string(x, ',') AS input_ids, len(list_filter(y, lambda v: v <> 0))::BIGINT AS n_labels
FROM placed JOIN framed USING (doc_id), range(2) AS e(epoch) WHERE split = 'train'"""

# -- evaluation ------------------------------------------------------------------------

PREDICTED = """
versions AS (SELECT unnest(range(1, (SELECT max(o_orderpriority[1:1]::INTEGER) FROM orders) + 1)) AS version),
predicted AS (
  SELECT conv_id, turn, version, text AS comment,
    array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w, i: i % (version + 1) <> 0), ' ') AS predicted
  FROM conversations, versions)"""
ORACLES["eval_matrix"] = f"WITH {PREDICTED} SELECT conv_id, turn, version, predicted FROM predicted"
ORACLES["model_replies"] = f"""
WITH {PREDICTED}
SELECT conv_id, turn, version,
  CASE WHEN version = 2 AND length(comment) % 3 = 0 THEN NULL ELSE version || ': ' || length(comment) || ' characters' END AS predicted,
  CASE WHEN version = 2 AND length(comment) % 3 = 0 THEN 'no answer' END AS error
FROM predicted"""
ORACLES["version_scores"] = f"""
WITH {PREDICTED},
sets AS (SELECT version, predicted = comment AS exact, list_distinct(regexp_extract_all(lower(predicted), '\\S+')) AS a,
  list_distinct(regexp_extract_all(lower(comment), '\\S+')) AS b FROM predicted)
SELECT version, count(*) AS n, round(avg(exact::INTEGER), 9) AS exact_rate,
  round(avg(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END::DOUBLE), 9) AS mean_f1
FROM sets GROUP BY version"""
# Weights are Poisson numbers of mean 1: limits of the distribution function times 2^32.
_LIMITS = [int(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) * 2**32) for k in range(12)]
_WEIGHT = " + ".join(f"(u >= {limit})::INTEGER" for limit in _LIMITS)
ORACLES["version_intervals"] = f"""
WITH {PREDICTED},
sets AS (SELECT conv_id, turn, version, list_distinct(regexp_extract_all(lower(predicted), '\\S+')) AS a,
  list_distinct(regexp_extract_all(lower(comment), '\\S+')) AS b FROM predicted),
scored AS (SELECT conv_id, turn, version,
  round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END::DOUBLE * 1e6)::BIGINT AS score FROM sets),
gains AS (SELECT s.conv_id, s.turn, s.version, s.score - f.score AS gain
  FROM scored s JOIN scored f ON f.conv_id = s.conv_id AND f.turn = s.turn AND f.version = 1 WHERE s.version > 1),
drawn AS (SELECT conv_id, turn, b, {_WEIGHT} AS w FROM (
  SELECT conv_id, turn, b, ('0x' || substr(md5((b // 4) || ':2022:' || conv_id || ':' || turn), 1 + 8 * (b % 4), 8))::BIGINT AS u FROM conversations, range(0, 200) r(b))),
sums AS (SELECT version, b, sum(w * gain)::DOUBLE / sum(w)::DOUBLE / 1e6 AS mean FROM gains JOIN drawn USING (conv_id, turn) GROUP BY version, b HAVING sum(w) > 0),
limits AS (SELECT version, list_sort(list(mean)) AS m FROM sums GROUP BY version),
whole AS (SELECT version, count(*) AS n, sum(gain)::DOUBLE / count(*)::DOUBLE / 1e6 AS difference FROM gains GROUP BY version)
SELECT version, n, round(difference, 9) AS difference, round(m[ceil(len(m) * 0.025)::INTEGER], 9) AS low, round(m[ceil(len(m) * 0.975)::INTEGER], 9) AS high
FROM whole JOIN limits USING (version)"""
ORACLES["inference_requests"] = """
SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN turn + 1 ELSE 9 END AS version
FROM conversations WHERE turn % 5 < 3 AND text <> ''"""
ORACLES["rejected_requests"] = """
SELECT conv_id, turn, 'text is required' AS error FROM conversations WHERE turn % 5 >= 3 OR text = ''"""
ORACLES["valid_lines"] = "SELECT conv_id, turn, role AS name, text AS comment FROM conversations WHERE conv_id % 7 <> 3"
ORACLES["rejected_lines"] = "SELECT conv_id, turn FROM conversations WHERE conv_id % 7 = 3"
ORACLES["evaluation_run"] = f"""
WITH {PREDICTED},
n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS row_no FROM conversations),
w AS (SELECT version, length(text) AS l, version = 2 AND length(text) % 3 = 0 AS failed FROM n, versions WHERE row_no <= 50 AND conv_id % 7 <> 3)
SELECT version, count(*) AS n, count(*) FILTER (failed) AS n_failed,
  round(avg((NOT failed AND l % 2 = version % 2)::INTEGER), 9) AS exact_rate FROM w GROUP BY version"""
ORACLES["row_window"] = """
WITH n AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS row_no FROM conversations)
SELECT row_no, role AS name, text AS comment FROM n WHERE row_no <= 50 AND conv_id % 7 <> 3"""

STEPS = """
steps AS (SELECT user_id % 10 AS epoch, CASE WHEN event_type = 'error' THEN 'validation' ELSE 'train' END AS phase,
  event_id AS step, value::DECIMAL(18, 4) AS loss FROM events)"""
ORACLES["epoch_losses"] = f"""
WITH {STEPS} SELECT epoch, phase, count(*) AS n_steps, sum(loss)::DOUBLE / count(*) AS mean_loss FROM steps GROUP BY epoch, phase"""
ORACLES["batch_losses"] = """
SELECT l_orderkey, round(sum(l_quantity::DOUBLE) FILTER (l_linenumber % 3 <> 0) / count(*) FILTER (l_linenumber % 3 <> 0), 9) AS loss
FROM lineitem GROUP BY l_orderkey"""
ORACLES["loss_curves"] = f"""
WITH {STEPS} SELECT epoch, phase, step, (sum(loss) OVER w)::DOUBLE / (count(*) OVER w) AS running_loss FROM steps
WINDOW w AS (PARTITION BY epoch, phase ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
ORACLES["hour_buckets"] = "SELECT strftime(ts, '%Y%m%d_%H') AS bucket, count(*) AS n FROM events GROUP BY 1"

# -- listings and recipe ---------------------------------------------------------------

ORACLES["latest_version"] = """
SELECT max(o_custkey) AS version FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 5 <> 0 AND o_custkey % 7 <> 0"""
ORACLES["newest_dataset"] = """
SELECT 'dataset/functions_dataset_' || o_orderkey || '.jsonl' AS path FROM orders
WHERE o_orderkey % 2 = 0 ORDER BY o_orderdate DESC, path LIMIT 1"""
ORACLES["recipe_split"] = """
SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY md5('42:0:' || vec_id), vec_id) > count(*) OVER () - ceil(0.2::DOUBLE * count(*) OVER ())
  THEN 'validation' ELSE 'train' END AS split FROM embeddings"""
