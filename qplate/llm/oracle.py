"""DuckDB SQL for the queries of this package that SQL can express (the others are tested against brute force)."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _common(min_docs: int, ratio: float) -> str:
    """CTEs: lines (doc_id, host, t, line, n) and common (host, line)."""
    return f"""
lines AS (
  SELECT doc_id, host, t, trim(regexp_replace(lower(raw), '{SPACE}', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, coalesce('h:' || source, 'null') AS host, text AS t,
               unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents)),
hosts AS (SELECT coalesce('h:' || source, 'null') AS host, count(DISTINCT coalesce('t' || text, 'n')) AS total
          FROM documents GROUP BY 1),
common AS (SELECT l.host, l.line FROM lines l JOIN hosts h ON l.host = h.host WHERE l.line <> ''
           GROUP BY l.host, l.line, h.total
           HAVING count(DISTINCT l.t) >= {min_docs} AND count(DISTINCT l.t) > CAST({ratio} AS DOUBLE) * h.total)"""


LINE_DEDUP = rf"""
WITH {_common(2, 0.05)},
parts AS (
  SELECT doc_id, coalesce('h:' || source, 'null') AS host, text, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
marked AS (
  SELECT p.*, c.line IS NOT NULL AS gone FROM parts p
  LEFT JOIN common c ON c.host = p.host AND c.line = trim(regexp_replace(lower(p.raw), '{SPACE}', ' ', 'g'), ' '))
SELECT doc_id,
       CASE WHEN bool_or(gone) THEN coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')
            ELSE any_value(text) END AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM marked GROUP BY doc_id"""

QUALITY = rf"""
WITH {_common(2, 0.1)},
w AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('h:' || source, 'null') AS host,
             regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
grams AS (SELECT doc_id, i, list_slice(ws, i, i + 4) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM grams GROUP BY doc_id, g HAVING count(*) > 1),
repeated AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
gone AS (SELECT l.doc_id, sum(len(string_split(l.line, ' '))) AS n FROM lines l JOIN common c ON l.host = c.host AND l.line = c.line
         GROUP BY l.doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
            - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
       AND NOT n_words - n_common_words < CAST(0.3 AS DOUBLE) * n_words AS kept
FROM base"""

DECONTAMINATE = rf"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, list_slice(w, i, i + 9) AS win
         FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dwin AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)),
hits AS (SELECT d.doc_id, d.n, d.i, s.item FROM dwin d JOIN wins s ON s.win = d.win),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words ON words.doc_id = dw.doc_id LEFT JOIN found ON found.doc_id = dw.doc_id"""

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id"""

# The table of the reflected CRC-32 polynomial, made bit by bit; a checksum folds it over the bytes of a text.
CRC_TABLE = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
        FROM range(256) r(i)))"""


def _crc(byte_list: str) -> str:
    """Unsigned crc32 of a list of bytes; ``crc_table`` has to be in scope."""
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)")


def _bytes(text: str) -> str:
    """UTF-8 bytes of a text whose characters are below U+0800."""
    return (f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] "
            "ELSE [(192 | (ord(x) >> 6))::BIGINT, (128 | (ord(x) & 63))::BIGINT] END))")


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([_field("doc_id::VARCHAR"), _field("source"), _field("lang"), _field("n_chars::VARCHAR"), _field(text)]) + ")"


def _levels(name: str, nodes: str) -> str:
    """All levels of the trees over ``nodes`` (tree, pos, h, n)."""
    return f"""
{name} AS (
  SELECT 0 AS lvl, tree, pos, h, n FROM {nodes}
  UNION ALL
  SELECT lvl + 1, tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY lvl, tree, pos // 3, n)"""


def _steps(name: str, levels: str, nodes: str) -> str:
    """(tree, pos, lvl, before, after): the siblings of each node of ``nodes`` at each level below its root."""
    return f"""
{name} AS (
  SELECT a.tree, a.pos, l.lvl,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos < a.pos // CAST(pow(3, l.lvl) AS BIGINT)), '') AS before,
         coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (WHERE s.pos > a.pos // CAST(pow(3, l.lvl) AS BIGINT)), '') AS after
  FROM {nodes} a
  JOIN (SELECT DISTINCT tree, lvl FROM {levels} WHERE n > 1) l ON l.tree = a.tree
  JOIN {levels} s ON s.tree = a.tree AND s.lvl = l.lvl AND s.pos // 3 = a.pos // CAST(pow(3, l.lvl + 1) AS BIGINT)
  GROUP BY a.tree, a.pos, l.lvl)"""


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, coalesce('h:' || source, 'null') AS tree, source, {_leaf("text")} AS h,
         CASE WHEN {_crc(_bytes("doc_id::VARCHAR"))} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS held
  FROM documents, crc_table),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed),
{_levels("low", "leaf")},
subroots AS (
  SELECT tree AS of, h, '' AS tree, row_number() OVER (ORDER BY (tree <> 'null'), tree) - 1 AS pos, count(*) OVER () AS n
  FROM low WHERE n = 1),
{_levels("high", "subroots")},
{_steps("low_steps", "low", "leaf")},
{_steps("high_steps", "high", "subroots")},
steps AS (
  SELECT tree, pos, row_number() OVER (PARTITION BY tree, pos ORDER BY lvl) AS step, before, after
  FROM (SELECT tree, pos, lvl, before, after FROM low_steps
        UNION ALL
        SELECT l.tree, l.pos, 1000 + s.lvl, s.before, s.after
        FROM leaf l JOIN subroots r ON r.of = l.tree JOIN high_steps s ON s.pos = r.pos)),
fold AS (
  SELECT tree, pos, 1 AS step, held AS h FROM leaf
  UNION ALL
  SELECT f.tree, f.pos, f.step + 1, sha256(s.before || f.h || s.after)
  FROM fold f JOIN steps s ON s.tree = f.tree AND s.pos = f.pos AND s.step = f.step),
folded AS (SELECT tree, pos, arg_max(h, step) AS folded_root FROM fold GROUP BY tree, pos),
proofs AS (SELECT tree, pos, string_agg(before || after, '' ORDER BY step) AS proof FROM steps GROUP BY tree, pos),
top AS (SELECT h AS root FROM high WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, r.h AS subroot, root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root,
       f.folded_root = root AS verified
FROM leaf l JOIN subroots r ON r.of = l.tree JOIN folded f ON f.tree = l.tree AND f.pos = l.pos
LEFT JOIN proofs p ON p.tree = l.tree AND p.pos = l.pos, top"""


SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id,
                unnest(regexp_extract_all(translate(text, {AZ}), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY id, run),
summed AS (SELECT run, n, {_crc(_bytes("id || ':' || run"))} AS h FROM counted, crc_table),
slipped AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM summed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
          UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
near AS (SELECT a, count(*) AS n_near, min(struct_pack(m := -w.n, b := encode(b))) AS best
         FROM pairs JOIN words w ON w.word = b GROUP BY a),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
                 CASE WHEN -best.m >= 5 * w.n THEN decode(best.b) END AS form, CASE WHEN -best.m >= 5 * w.n THEN -best.m END AS form_n
          FROM words w LEFT JOIN near ON a = w.word),
chain AS (SELECT word, word AS here, 0 AS k FROM forms
          UNION ALL SELECT c.word, f.form, k + 1 FROM chain c JOIN forms f ON f.word = c.here AND f.form IS NOT NULL)
SELECT f.word, form, r.root, n, n_near, form_n
FROM forms f JOIN (SELECT word, arg_max(here, k) AS root FROM chain GROUP BY word) r ON r.word = f.word"""

ORACLES = {"op2_line_dedup": LINE_DEDUP, "op3_decontaminate": DECONTAMINATE, "op8_quality_rules": QUALITY,
           "op10_near_dedup": NEAR_DEDUP, "op11_spelling": SPELLING, "op12_merkle": MERKLE}
