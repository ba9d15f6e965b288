"""Check SQL of the corpus operators that SQL can express (DuckDB)."""

from __future__ import annotations

_BOILERPLATE = (
    r"(?i)\b(enable javascript|javascript is disabled|accept (all )?cookies|we use cookies|all rights reserved|"
    r"subscribe to our newsletter|back to top|skip to (main )?content|terms of (use|service) apply)\b"
)
_NAVIGATION = r"(?i)^(home|menu|login|log in|sign in|sign up|search|share|next|previous|read more|click here|contact us|about us)[.!:]?$"

# Rows are numbered by file position, as doc_id may repeat.
_QUALITY = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {{documents}}
), w AS (
  SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d
), g AS (
  SELECT r, unnest(range(1, len(ws) - 6)) AS i,
    unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS gram
  FROM w WHERE len(ws) >= 8
), gi AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g
), cov AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM gi WHERE c > 1) GROUP BY r
), l AS (
  SELECT r, x AS line, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS lw
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
), f AS (
  SELECT r, line, len(lw)::BIGINT AS n, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tl,
    len(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) AS symbols,
    len(regexp_replace(line, '[^|]+', '', 'g')) AS bars,
    len(regexp_replace(line, '[^\\p{{{{L}}}}]+', '', 'g')) AS letters,
    len(regexp_replace(line, '[^\\p{{{{Lu}}}}]+', '', 'g')) AS capitals,
    CASE WHEN contains(line, '!!') OR contains(line, '??')
      THEN len(regexp_split_to_array(line, '[!?]{{{{2,}}}}')) - 1 ELSE 0 END AS doubled
  FROM l
), v AS (
  SELECT r, line, n, n > 0 AND (symbols * 100 > 20 * n OR (letters >= 20 AND capitals * 2 > letters)
    OR doubled * 100 > 30 * n OR bars >= 3
    OR (n <= 3 AND regexp_matches(tl, '{_NAVIGATION}'))
    OR (n <= 25 AND regexp_matches(tl, '{_BOILERPLATE}'))) AS fails
  FROM f
), s AS (
  SELECT r, sum(CASE WHEN fails THEN n ELSE 0 END)::BIGINT AS n_lost_words,
    (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0))::BIGINT AS n_dup_lines
  FROM v GROUP BY r
), b AS (
  SELECT w.doc_id, w.t, len(ws)::BIGINT AS n_words,
    len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_lost_words
  FROM w JOIN s USING (r) LEFT JOIN cov USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words,
  n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
  NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30 OR n_lost_words * 100 > n_words * 30) AS kept
FROM b
"""


# Conversation repair: one row per conversation and step holds, for each state of the pattern, the cheapest edits as
# seven digits of cost and the audit, so LEAST compares cost first and audit next.
_CRC_TABLE = (
    "list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), "
    "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
)


def _crc32(text: str) -> str:
    """crc32 of an ASCII text; ``crc_table`` is a column in scope."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)), "
        "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)"
    )


def _edit(state: str, cost: str, initial: str) -> str:
    return f"(printf('%07d', left({state}, 7)::INTEGER + {cost}) || substr({state}, 8) || '{initial}')"


_USER = f"least(c2, {_edit('c0', '2', 'I')}, {_edit('c1', '2', 'I')}, {_edit('c3', '2', 'I')})"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_REPAIR = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name, {_CRC_TABLE} AS crc_table
  FROM {{conversations}}
), kinds AS (
  SELECT conv_id, turn, role, text, {_crc32('name')} % 20 AS kind FROM base
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS earlier,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
    rtrim(text, {_SPACES}) AS body
  FROM damaged
), judged AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, before,
    CASE WHEN body = '' THEN 'blank' WHEN earlier THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), steps AS (
  SELECT conv_id, 0::BIGINT AS i, '0000000' AS c0, NULL::VARCHAR AS c1, NULL::VARCHAR AS c2, NULL::VARCHAR AS c3 FROM counted
  UNION ALL
  SELECT conv_id, i, {_edit('c0', '3', 'D')},
    least({_edit('c1', '3', 'D')}, CASE WHEN initial = 's' AND stays THEN {_edit('c0', 'extra', 'K')} END),
    least({_edit('u', '3', 'D')}, CASE WHEN stays THEN least({_edit('c0', '2 + extra', 'R')}, {_edit('c1', '2 + extra', 'R')}, {_edit('a', '2 + extra', 'R')}) END,
      CASE WHEN stays AND initial = 'u' THEN least({_edit('c0', 'extra', 'K')}, {_edit('c1', 'extra', 'K')}, {_edit('a', 'extra', 'K')}) END),
    least({_edit('a', '3', 'D')}, CASE WHEN stays THEN {_edit('u', '2 + extra', 'R')} END, CASE WHEN stays AND initial = 'a' THEN {_edit('u', 'extra', 'K')} END)
  FROM (
    SELECT *, least(c3, {_edit('u', '2', 'I')}) AS a FROM (
      SELECT s.conv_id, j.i, s.c0, s.c1, s.c3, {_USER.replace('c2', 's.c2').replace('c0', 's.c0').replace('c1', 's.c1').replace('c3', 's.c3')} AS u,
        j.initial, j.fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN j.fault = 'truncated' THEN 1 ELSE 0 END AS extra
      FROM steps s JOIN judged j ON s.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = s.i + 1
    )
  )
), ends AS (
  SELECT conv_id, least(c0, c3, {_edit('u', '2', 'I')}) AS best FROM (
    SELECT s.*, {_USER} AS u FROM steps s JOIN counted n ON s.conv_id IS NOT DISTINCT FROM n.conv_id AND s.i = n.n
  )
), audits AS (
  SELECT conv_id, left(best, 7)::BIGINT AS cost, substr(best, 8) AS audit FROM ends
), places AS (
  SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits
), outputs AS (
  SELECT p.conv_id, p.j, audit[p.j] AS edit, length(replace(audit[:p.j], 'I', '')) AS i, length(replace(audit[:p.j], 'D', '')) AS o
  FROM places p WHERE audit[p.j] <> 'D'
), lines AS (
  SELECT o.conv_id, o.j, o.o, o.edit, r.role, CASE WHEN o.edit = 'I' THEN '' ELSE r.text END AS text,
    max(CASE WHEN o.o = 1 AND o.edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.conv_id) AS shift
  FROM outputs o LEFT JOIN judged r ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.i = r.i
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS body
  FROM lines GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM {{conversations}}) d
LEFT JOIN counted c ON d.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON d.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN repaired b ON d.conv_id IS NOT DISTINCT FROM b.conv_id
"""


# Spelling variants: near words share a deletion (of one of them, or of both at the same place).
_BYTES = "list_transform(string_split({0}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN [ord(ch)::BIGINT] ELSE [195::BIGINT, ord(ch)::BIGINT - 64] END)"

_SPELLING = f"""
WITH RECURSIVE found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run
  FROM {{documents}}
), runs AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM found GROUP BY ALL
), sums AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({_BYTES.format("doc || ':' || run")})),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, (SELECT {_CRC_TABLE} AS crc_table)
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.rest
  UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.rest
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, min(x.other) AS form, CASE WHEN b.m >= 2 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
  LEFT JOIN near x ON x.word = w.word AND x.m = b.m AND b.m >= 2 * w.n GROUP BY ALL
), chain AS (
  SELECT word, word AS at FROM forms
  UNION SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM forms f JOIN chain c ON f.word = c.word JOIN forms e ON e.word = c.at AND e.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op10_quality_rules": _QUALITY.format(documents="documents"),
        "op11_conversation_repair": _REPAIR.format(conversations="conversations"),
        "op13_spelling_variants": _SPELLING.format(documents="documents"),
    }
