"""SQL for the corpus queries that SQL can express. The others are tested by brute force."""

from __future__ import annotations

from chatprep.llm import quality
from chatprep.llm.queries import LISTED

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_LOWER = "'abcdefghijklmnopqrstuvwxyz'"

_OP1 = f"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), {_UPPER}, {_LOWER}) AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
        FROM pages)
), named AS (
  SELECT *, regexp_replace(regexp_replace(host, '\\.?(:[0-9]*)?$', ''), '^(www|m)\\.', '')
      || regexp_replace(path, '/+$', '') AS canonical,
    list_has_any(string_split(host, '.'), {LISTED!r}) AS on_list,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, host <> '' AND canonical IN (SELECT canonical FROM named WHERE on_list) AS listed FROM named)
"""

_BLANK = "[\\x20\\x09-\\x0D]"
_CLASSES = {
    "c_upper": "\\P{Lu}",
    "c_digit": "[^0-9]",
    "c_blank": "[^\\x20\\x09-\\x0D]",
    "c_mark": "[^.,;:''\"?\\-]",
    "c_sign": "[^!#$%&()*+/<=>@\\[\\\\\\]^_`{|}~]",
}
_COUNTS = ", ".join(f"length(regexp_replace(t, '{p}+', '', 'g')) AS {n}" for n, p in _CLASSES.items())
_REST = "c_chars - c_upper - c_digit - c_blank - c_mark - c_sign"


def _distance(p: str, q: str) -> str:
    terms = f"""list_sum(list_transform(list_zip({p}, {q}), lambda z:
        CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END
      + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END))"""
    return f"sqrt(greatest({terms} / 2, 0))"


_WITH_REST = "list_append({x}, greatest(1 - coalesce(list_sum({x}), 0), 0))"

_OP4 = f"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS lang, t, w, len(w) AS n,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM (SELECT *, list_filter(regexp_split_to_array(t, '{_BLANK}+'), lambda x: x <> '') AS w
        FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents))
), windows AS (
  SELECT doc_id, k, array_to_string(w[k:k+7], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, n - 7)) AS k FROM base WHERE n >= 8)
), twice AS (
  SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1
), repeated AS (
  SELECT doc_id, sum(least(8, coalesce(after, k + 8) - k)) AS n_repeat_words
  FROM (SELECT *, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM twice) GROUP BY doc_id
), classes AS (
  SELECT doc_id, lang, length(t) AS c_chars, {_COUNTS} FROM base
), both_classes AS (
  SELECT unnest(list_distinct([lang, ''])) AS lang, 1000000 AS c_chars,
    {", ".join(f"c_{n} * 1000000 // c_chars AS c_{n}" for n in ("upper", "digit", "blank", "mark", "sign"))}
  FROM classes WHERE c_chars > 0
), class_reference AS (
  SELECT lang, [{", ".join(f"sum(c_{n}) / sum(c_chars)::DOUBLE" for n in ("upper", "digit", "blank", "mark", "sign"))},
    sum({_REST}) / sum(c_chars)::DOUBLE] AS q
  FROM both_classes GROUP BY lang
), own_languages AS (
  SELECT lang FROM classes WHERE lang <> '' AND c_chars > 0 GROUP BY lang HAVING count(*) >= {quality.MIN_DOCS}
), lowered AS (
  SELECT doc_id, lang, list_transform(w, lambda x: lower(x)) AS w FROM base
), word_counts AS (
  SELECT lang, word, count(*) AS times
  FROM (SELECT unnest(list_distinct([lang, ''])) AS lang, word FROM (SELECT lang, unnest(w) AS word FROM lowered))
  GROUP BY lang, word
), common AS (
  SELECT lang, list(word ORDER BY place) AS words, list(times ORDER BY place) AS times
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY times DESC, word) AS place FROM word_counts
        WHERE regexp_full_match(word, '\\p{{L}}{{1,{quality.COMMON_LETTERS}}}'))
  WHERE place <= {quality.COMMON_WORDS} GROUP BY lang
), word_reference AS (
  SELECT lang, words, list_transform(times, lambda x: x / total::DOUBLE) AS q
  FROM common JOIN (SELECT lang, sum(times) AS total FROM word_counts GROUP BY lang) USING (lang)
), refs AS (
  SELECT lang, cr.q AS cq, coalesce(wr.words, []) AS words, coalesce(wr.q, []::DOUBLE[]) AS wq
  FROM class_reference cr LEFT JOIN word_reference wr USING (lang)
  WHERE lang IN (SELECT lang FROM own_languages) OR (lang = '' AND NOT EXISTS (SELECT 1 FROM own_languages))
), held AS (
  SELECT l.doc_id, l.lang, l.w, l.lang IN (SELECT lang FROM own_languages) AS has_own FROM lowered l
), against AS (
  SELECT h.doc_id, n, c_chars, has_own OR h.lang = '' AS worded, r.lang AS reference, cq, wq,
    [{", ".join(f"c_{x} / greatest(c_chars, 1)::DOUBLE" for x in ("upper", "digit", "blank", "mark", "sign"))}, ({_REST}) / greatest(c_chars, 1)::DOUBLE] AS cp,
    list_transform(r.words, lambda x: len(list_filter(h.w, lambda y: y = x)) / greatest(n, 1)::DOUBLE) AS p
  FROM held h JOIN base b USING (doc_id) JOIN classes c USING (doc_id)
  LEFT JOIN refs r ON r.lang = h.lang OR NOT has_own
), measured AS (
  SELECT *, {_distance("cp", "cq")} AS class_distance,
    {_distance(_WITH_REST.format(x="p"), _WITH_REST.format(x="wq"))} AS word_distance,
    coalesce(list_sum(p), 0) AS share, 1 - greatest(1 - coalesce(list_sum(wq), 0), 0) AS whole
  FROM against
), judged AS (
  SELECT *, n >= {quality.MIN_WORDS} AND share < {quality.MIN_COMMON_PART!r} * whole
    AND (whole - share) * sqrt(n) > {quality.LACK_DEVIATIONS} * sqrt(whole) AS lacks
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY class_distance + word_distance, reference) AS place
        FROM measured) WHERE place = 1
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(c_chars >= {quality.MIN_CHARS} AND class_distance > {quality.MAX_CLASS_DISTANCE}, false)
  AND NOT coalesce(worded AND n_words >= {quality.MIN_WORDS} AND word_distance > {quality.MAX_WORD_DISTANCE}, false)
  AND NOT coalesce(worded AND lacks, false) AS kept
FROM (
  SELECT b.doc_id, b.n AS n_words, length(array_to_string(b.w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    b.n < {quality.MIN_BASE_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {quality.MAX_REPEAT_PERCENT} * b.n AS base_failed,
    c_chars, class_distance, word_distance, worded, lacks
  FROM base b JOIN judged USING (doc_id) LEFT JOIN repeated USING (doc_id)
)
"""

_OP7 = f"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '')) AS size,
    substr(sha256('mix:' || doc_id), 1, 15) AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size,
    [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::HUGEINT AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER before, 0) AS given,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM sources
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, cap * weights <= weight * (total - given) AS is_full FROM ordered
), goals AS (
  SELECT source, source_size::BIGINT AS source_size,
    CASE WHEN is_full THEN cap::DOUBLE ELSE
      (weight * (total - coalesce(sum(cap) FILTER (is_full) OVER (), 0)))::DOUBLE
      / (sum(weight) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
  FROM filled
), queued AS (
  SELECT s.*, source_size, target,
    sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), offers AS (
  SELECT doc_id, place, size, pass, (upto + pass * source_size)::DOUBLE / target AS finish
  FROM queued, (SELECT unnest([0, 1, 2]) AS pass) WHERE size > 0 AND target > 0
), mixed AS (
  SELECT doc_id, count(*) AS copies
  FROM (SELECT *, sum(size) OVER (ORDER BY finish, place, doc_id, pass ROWS UNBOUNDED PRECEDING) AS used FROM offers)
  WHERE used <= (SELECT sum(size) FROM sized) GROUP BY doc_id
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * coalesce(copies, 0))::BIGINT AS taken, coalesce(copies, 0)::INTEGER AS copies
FROM queued LEFT JOIN mixed USING (doc_id)
"""


def _shingles(table: str, name: str) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
  SELECT DISTINCT {name}, array_to_string(w[k:k+4], ' ') AS s
  FROM (SELECT {name}, w, unnest(generate_series(1, len(w) - 4)) AS k
        FROM (SELECT {name}, {words} AS w FROM {table}) WHERE len(w) >= 5)"""


_OP10 = f"""
WITH items AS ({_shingles("benchmark", "item_id")}),
docs AS ({_shingles("documents", "doc_id")}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM items GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM docs JOIN items USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles::DOUBLE AS containment
FROM shared JOIN sizes USING (item_id) WHERE 10 * n_shared >= 8 * n_shingles
"""

_OP11 = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(generate_series(0, 31), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest
  FROM hashed
), ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS original
  FROM named WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN original END AS refers_to
FROM ranked
"""

_OP12 = """
WITH crc_steps AS (
  SELECT list(list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, _:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS steps
  FROM (SELECT unnest(generate_series(0, 255))::BIGINT AS k)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
      lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::INTEGER + 1]))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_steps
), rebuilt AS (
  SELECT c.conv_id, t.role, t.text, place, 0 AS part
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND place < h
  UNION ALL
  SELECT c.conv_id, t.role, t.text, place, 1 FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place >= h
), paths AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL AS parent, 0 AS bytes FROM convs
  UNION ALL
  SELECT conv_id, depth, sha256(array_to_string(list_transform(upto, lambda x: sha256(x)), '')),
    CASE WHEN depth = 1 THEN '' ELSE sha256(array_to_string(list_transform(upto[:-2], lambda x: sha256(x)), '')) END, bytes
  FROM (SELECT conv_id, strlen(text) AS bytes, row_number() OVER w AS depth,
          list(strlen(role) || ':' || role || text) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
        FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place))
), nodes AS (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent,
    any_value(bytes) AS bytes, count(*) AS n_convs
  FROM paths GROUP BY node
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node
), sums AS (
  SELECT p.node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children USING (node) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth
  GROUP BY p.node
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN nodes up ON up.node = n.parent
  LEFT JOIN children ch ON ch.node = n.node LEFT JOIN ends e ON e.node = n.node
"""

ORACLE = {
    "op1_url_filter": _OP1,
    "op4_quality_rules": _OP4,
    "op7_mixing": _OP7,
    "op10_decontamination": _OP10,
    "op11_warc_revisits": _OP11,
    "op12_prefix_trie": _OP12,
}
