"""SQL answers (DuckDB) of the queries that SQL can express, from the definitions alone."""

from __future__ import annotations

from earshot.llm.chat import CONTROLS

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM i WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM items)
),
sizes AS (SELECT DISTINCT n FROM items),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)
),
met AS (SELECT doc_id, item_id, s, n FROM doc_windows JOIN item_windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM met) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _escaped(column: str) -> str:
    out = rf"replace({column}, '\', '\\')"
    for control in CONTROLS:
        out = rf"replace({out}, '{control}', '{control[0]}\{control[1:]}')"
    return out


CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length(role) - length(replace(role, chr(10), '')) + length({_escaped('text')}) + 24) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS s FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM roots LEFT JOIN n USING (doc_id)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST, b) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.id NULLS LAST, s.b) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
  WHERE place <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""



def _later(state: str, cost: str, edit: str, row: str = "''") -> str:
    """A state is [cost with leading zeros, edits, repaired rows]."""
    return f"CASE WHEN {state} IS NOT NULL THEN [lpad(CAST(CAST({state}[1] AS INTEGER) + {cost} AS VARCHAR), 9, '0'), {state}[2] || '{edit}', {state}[3] || {row}] END"


def _least(*states: str) -> str:
    return f"list_sort(list_filter([{', '.join(states)}], lambda x: x IS NOT NULL))[1]"


_INSERTS = f"""
SELECT *, {_least("s3", _later("c2", "2", "I", "chr(10) || 'assistant:'"))} AS c3
FROM (SELECT *, {_least("s2", *(_later(f"s{i}", "2", "I", "chr(10) || 'user:'") for i in (0, 1, 3)))} AS c2 FROM {{}})
"""
_ROW, _USER, _ASSISTANT = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"


def _next(to: int, initial: str | None, kept_from: str, changed_from: str, row: str) -> str:
    states = [_later(f"c{to}", "3", "D")]
    states += [f"CASE WHEN stays AND initial = '{initial}' THEN {_later(f'c{i}', 'cut', 'K', _ROW)} END" for i in kept_from]
    states += [f"CASE WHEN stays THEN {_later(f'c{i}', '2 + cut', 'R', row)} END" for i in changed_from]
    return _least(*states)


REPAIR = rf"""
WITH RECURSIVE bits AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, n: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS k
  FROM conversations
),
summed AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce([4294967295] || k, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS n
  FROM keyed, bits
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role,
    CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN n = 3 THEN 2 ELSE 1 END)) AS again
  FROM summed WHERE n <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i FROM damaged),
faulty AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][ 	-]*\z') AS open_end, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
),
marked AS (SELECT *, NOT blank AND NOT seen AS stays, CASE WHEN open_end THEN 1 ELSE 0 END AS cut FROM faulty),
walked AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, ['000000000', '', ''] AS s0, CAST(NULL AS VARCHAR[]) AS s1, CAST(NULL AS VARCHAR[]) AS s2, CAST(NULL AS VARCHAR[]) AS s3 FROM marked
  UNION ALL
  SELECT conv_id, i, {_later("c0", "3", "D")}, {_next(1, "s", "0", "", "''")}, {_next(2, "u", "013", "013", _USER)}, {_next(3, "a", "2", "2", _ASSISTANT)}
  FROM (
    SELECT w.conv_id, m.i, s0 AS c0, s1 AS c1, c2, c3, stays, cut, initial, role, text
    FROM ({_INSERTS.format("walked")}) w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i + 1
  )
),
ends AS (
  SELECT conv_id, max_by({_least("s0", "c3")}, i) AS best FROM ({_INSERTS.format("walked")}) GROUP BY conv_id
),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (stays AND open_end) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(best[1] AS BIGINT), 0) AS cost, coalesce(best[2], '') AS audit, sha256(coalesce(best[3][2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) n
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM n.conv_id
"""

TEXTS = {
    "op1_decontamination": DECONTAMINATION,
    "op3_chat_formatting": CHAT,
    "op10_near_dedup": NEAR_DEDUP,
    "op11_conversation_repair": REPAIR,
    "op13_hard_negatives": HARD_NEGATIVES,
}
