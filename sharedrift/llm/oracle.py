"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from sharedrift.llm import chat, licenses, quality, spelling, trie
from sharedrift.llm.queries import ALLOW_RULES, BLOCK_RULES, LISTED_LABELS, QUERY_EVERY, TOP_K, VECTOR_SCALE

WORD = r"[^\x20\x09-\x0D]+"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_RULES = [(rule, "block") for rule in BLOCK_RULES] + [(rule, "allow") for rule in ALLOW_RULES]
_LISTED = "|".join(LISTED_LABELS)

URLS = rf"""
WITH parts AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS raw_host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (
  SELECT page_id, path, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
  FROM parts),
rules AS (
  SELECT rule, kind, split_part(rule, '/', 1) AS domain, substr(rule, strpos(rule, '/')) AS start
  FROM (VALUES {_values(_RULES)}) AS r(rule, kind)),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(kind, length(rule)) AS kind
  FROM hosts JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, start)
  GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.kind,
         CASE WHEN regexp_matches(host, '(^|\.)({_LISTED})(\.|$)') THEN 'block' ELSE 'allow' END
       ) AS verdict
FROM hosts LEFT JOIN best USING (page_id)
"""

_ESCAPED = "text"
for _plain, _coded in chat.ESCAPES:
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_coded}')"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
marked AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS first_of_run,
         length({_ESCAPED}) AS escaped_chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(escaped_chars + CASE WHEN first_of_run
           THEN {len(chat.OPEN + chat.ROLE + chat.END_ROLE + chat.CLOSE)} + length(role)
           ELSE {len(chat.NEXT)} END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

TOP = f"""
WITH vectors AS (
  SELECT vec_id, [floor({VECTOR_SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {TOP_K}
"""

QUALITY = rf"""
WITH texts AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM texts),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM worded)),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY doc_id),
lines AS (
  SELECT doc_id, source, md5(text) AS whole, unnest(string_split(text, chr(10))) AS line FROM texts),
filled AS (
  SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS normal FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM filled GROUP BY doc_id),
hashed AS (
  SELECT *, md5(normal) AS hash, length(normal) - length(replace(normal, ' ', '')) + 1 AS n FROM filled),
common AS (
  SELECT source, hash FROM hashed GROUP BY source, hash HAVING count(DISTINCT whole) > {quality.LINE_LIMIT}),
removed AS (
  SELECT doc_id, sum(n) AS n FROM hashed SEMI JOIN common ON hashed.source IS NOT DISTINCT FROM common.source
    AND hashed.hash = common.hash GROUP BY doc_id),
joined AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '{quality.SYMBOLS}'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed.n, 0)::BIGINT AS n_removed_words
  FROM worded LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words)
         AND n_words - n_removed_words >= {quality.MIN_KEPT} * n_words AS kept
FROM joined
"""

_TEMPLATES = [
    (n, label, n < len(licenses.PHRASES), text) for n, (label, text) in enumerate([*licenses.PHRASES, *licenses.NOTICES])]

LICENSES = rf"""
WITH templates AS (
  SELECT template, label, exact, string_split(text, ' ') AS words
  FROM (VALUES {_values([(n, label, exact, text) for n, label, exact, text in _TEMPLATES])}) AS v(template, label, exact, text)),
template_grams AS (
  SELECT template, label, exact, len(words) - 2 AS n_grams, i - 1 AS nth, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM templates)),
worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
grams AS (
  SELECT doc_id, i - 1 AS place, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM worded)),
votes AS (
  SELECT doc_id, template, label, exact, n_grams, place - nth AS diagonal, count(*) AS votes, min(place) AS first, max(place) AS last
  FROM grams JOIN template_grams USING (gram) GROUP BY ALL),
spans AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span
  FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.SLACK}
                       THEN 0 ELSE 1 END AS fresh FROM votes WHERE NOT exact AND votes < n_grams)),
merged AS (
  SELECT doc_id, label, exact, n_grams, least(sum(votes) / n_grams, 1.0) AS coverage, min(first) AS first, max(last) + {licenses.GRAM} AS past
  FROM spans GROUP BY doc_id, template, label, exact, n_grams, span),
found AS (
  SELECT doc_id, label, exact, diagonal AS start, 1.0::DOUBLE AS coverage FROM votes WHERE votes = n_grams
  UNION ALL
  SELECT doc_id, label, exact, first, coverage FROM merged
  WHERE coverage >= {licenses.MIN_COVERAGE} AND past - first <= (n_grams + {licenses.GRAM - 1}) * {licenses.MAX_STRETCH})
SELECT doc_id, any_value(len(words)) AS n_words, count(*) FILTER (exact) AS n_base,
       min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(coverage), 0.0)::DOUBLE AS score
FROM worded LEFT JOIN found USING (doc_id) GROUP BY doc_id
"""

# CRC-32 of a list of bytes: the usual table of 256 entries, made by its rule.
_CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)
              ORDER BY n) AS crc_of
  FROM range(256) AS r(n))"""


def _crc32(codes: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(crc_of[(xor(c, b) & 255) + 1], c >> 8)))"


TRIE = rf"""
WITH {_CRC_TABLE.strip()},
turns AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[:{2 * trie.DIGEST}] AS digest,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, conv_id - conv_id % {trie.BLOCK} AS block,
         list({{'digest': digest, 'words': words}} ORDER BY turn NULLS FIRST, digest) AS own
  FROM turns GROUP BY conv_id),
headed AS (
  SELECT o.conv_id, o.own, coalesce(b.own, []) AS head,
         ({_crc32("[ord(d)::BIGINT FOR d IN string_split(o.conv_id::VARCHAR, '')]")} % {trie.MAX_HEAD})::INTEGER AS h
  FROM own o LEFT JOIN own b ON b.conv_id = o.block CROSS JOIN crc_table),
convs AS (SELECT conv_id, head[1:h] || own[h + 1:] AS turns FROM headed),
members AS (
  SELECT conv_id, depth, depth = len(turns) AS ends, CASE WHEN depth > 0 THEN turns[depth].words ELSE 0 END AS words,
         md5(array_to_string([t.digest FOR t IN turns[1:depth]], '')) AS node,
         CASE WHEN depth > 0 THEN md5(array_to_string([t.digest FOR t IN turns[1:depth - 1]], '')) END AS parent
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM convs)),
nodes AS (
  SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
paths AS (  -- every node with itself and every node above it
  SELECT DISTINCT m.node, a.node AS above FROM members m JOIN members a ON a.conv_id = m.conv_id AND a.depth <= m.depth),
sums AS (
  SELECT above AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, sum(saved) AS saved_tokens
  FROM paths JOIN nodes USING (node) LEFT JOIN children USING (node) GROUP BY above)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.parent
"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE.strip()},
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run
  FROM documents),
hashed AS (
  SELECT run, {_crc32("""flatten([CASE WHEN ord(d) < 128 THEN [ord(d)::BIGINT] ELSE [192 + (ord(d) >> 6)::BIGINT, 128 + (ord(d) & 63)::BIGINT] END
    FOR d IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')])""")} AS h
  FROM runs CROSS JOIN crc_table),
words AS MATERIALIZED (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  GROUP BY word HAVING length(word) >= {spelling.MIN_LETTERS} AND count(*) >= {spelling.MIN_COUNT}),
cuts AS MATERIALIZED (  -- each word without each of its letters
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS variant, b.n AS m FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(variant ORDER BY m DESC, variant) AS variant, max(m) AS m FROM pairs GROUP BY word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.DOMINANCE} * n THEN variant END AS form,
         CASE WHEN m >= {spelling.DOMINANCE} * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, place) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.place WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.place AS root, f.n, f.n_near, f.form_n
FROM walk JOIN forms AS last ON last.word = walk.place AND last.form IS NULL JOIN forms AS f ON f.word = walk.word
"""

ORACLE_SQL = {
    "op3_url_filter": URLS,
    "op4_license_scan": LICENSES,
    "op6_chat_format": CHAT,
    "op7_exact_top_k": TOP,
    "op8_quality_rules": QUALITY,
    "op12_prefix_trie": TRIE,
    "op13_spelling_variants": SPELLING,
}
