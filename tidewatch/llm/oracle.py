"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r(v, u) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
c AS (SELECT v, min(u) AS c FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.v = d.doc_id
"""

_OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT item_id, w, least(len(w), 13) AS k FROM bw WHERE len(w) > 0),
bx AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS g FROM k),
dx AS (
  SELECT doc_id, k, u.i AS i, array_to_string(w[u.i:u.i+k-1], ' ') AS g
  FROM dw, (SELECT DISTINCT k FROM k) kk, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) u),
o AS (SELECT doc_id, k, i, item_id FROM dx JOIN bx USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM o) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""

#: The table of crc32, for ``_crc``.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab)"""


def _crc(text: str) -> str:
    """crc32 of the UTF-8 of an expression, beside ``tab``."""
    hx = f"hex(encode({text}))"
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({hx}), 2), lambda i: ('0x' || substr({hx}, i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""


_OP11 = rf"""
WITH RECURSIVE {_CRC_TABLE},
t AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM t GROUP BY ALL),
h AS (SELECT run, m, {_crc("id || ':' || run")} AS h FROM l, crc WHERE length(run) >= 6),
d AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, m FROM h),
v AS (SELECT word, sum(m)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
x AS (SELECT DISTINCT word, n, i, left(word, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
p AS (
  SELECT a.word, a.n, b.word AS o, b.n AS m FROM x a JOIN x b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM x a JOIN v b ON a.s = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM x a JOIN v b ON a.s = b.word),
f AS (
  SELECT v.word, v.n, count(o) AS n_near, max(m) AS top, arg_max(o, {{'m': m, 'back': -r}}) AS best
  FROM v LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, o) AS r FROM p) p ON p.word = v.word GROUP BY ALL),
g AS (SELECT word, n, n_near, CASE WHEN top >= 5 * n THEN best END AS form, CASE WHEN top >= 5 * n THEN top END AS form_n FROM f),
c(word, root) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON g.word = c.root WHERE g.form IS NOT NULL)
SELECT g.word, g.form, c.root, g.n, g.n_near, g.form_n::BIGINT AS form_n
FROM g JOIN c USING (word) JOIN g e ON e.word = c.root WHERE e.form IS NULL
"""



def _least(*values: str) -> str:
    """The cheapest of structs of cost, audit and turns, on ties the least audit."""
    return f"list_sort(list_filter([{', '.join(values)}], lambda x: x IS NOT NULL))[1]"


def _step(label: str, cost: str, state: str, turn: str = "") -> str:
    return f"{{'c': {cost} + {state}.c, 'a': '{label}' || {state}.a, 'r': {f'list_prepend({turn}, {state}.r)' if turn else f'{state}.r'}}}"


def _turn(q: int) -> str:
    """The best of a turn in state q (0 nothing, 1 s, 2 u, 3 a before it) with the states behind it in s0 to s3."""
    after, role = ("s3", "assistant") if q == 2 else ("s2", "user")
    kept = [("a", "s3")] if q == 2 else [("u", "s2"), ("s", "s1")] if q == 0 else [("u", "s2")]
    keep = [f"CASE WHEN sound AND ini = '{i}' THEN {_step('K', 'extra', to, "role || ':' || text")} END" for i, to in kept]
    return _least(_step("D", "3", f"s{q}"), f"CASE WHEN sound THEN {_step('R', '2 + extra', after, f"'{role}:' || text")} END", *keep)


_OP12 = rf"""
WITH RECURSIVE {_CRC_TABLE},
b AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations, crc),
r AS (
  SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM b WHERE d <> 0),
o AS (
  SELECT *, left(role, 1) AS ini, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS prev
  FROM r WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
j AS (
  SELECT *, kind IN (0, 3) AS sound, (kind = 3)::INT AS extra FROM (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN i > min(i) OVER (PARTITION BY c, role, text) THEN 2
                   WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS kind FROM o)),
n AS (
  SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 1) AS blank,
         count(*) FILTER (kind = 2) AS duplicate, count(*) FILTER (kind = 3) AS truncated,
         count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM j GROUP BY c),
s(c, i, s0, s1, s2, s3) AS (
  SELECT c, n + 1, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, {{'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']}}, {{'c': 2, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}} FROM n
  UNION ALL
  SELECT c, i, {_least("t0", _step("I", "2", "u2", "'user:'"))}, {_least("t1", _step("I", "2", "u2", "'user:'"))}, u2, {_least("t3", _step("I", "2", "u2", "'user:'"))}
  FROM (SELECT *, {_least("t2", _step("I", "2", "t3", "'assistant:'"))} AS u2
        FROM (SELECT s.c, j.i, {", ".join(f"{_turn(q)} AS t{q}" for q in range(4))} FROM s JOIN j ON j.c = s.c AND j.i = s.i - 1)))
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost,
       coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM b) d LEFT JOIN n ON n.c = d.c LEFT JOIN s ON s.c = d.c AND s.i = 1
"""

ORACLE_SQL = {"op1_minhash_near_dedup": _OP1, "op10_benchmark_decontamination": _OP10, "op11_spelling_variants": _OP11, "op12_conversation_repair": _OP12}
