"""DuckDB SQL of the queries that SQL can express."""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
    regexp_replace(role, '([<\[])(\\*)(/?s>|turn>|/?INST\])', '\1\\\2\3', 'g') AS role_out,
    regexp_replace(text, '([<\[])(\\*)(/?s>|turn>|/?INST\])', '\1\\\2\3', 'g') AS text_out
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(text_out) + CASE WHEN opens THEN length('<s>[INST]' || role_out || '[/INST]' || '</s>') ELSE length('<turn>') END)::BIGINT
    AS formatted_chars
FROM told GROUP BY conv_id
"""

OP4 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM items),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN items USING (n, g)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def _best(*steps: str) -> str:
    return f"list_min([{', '.join(steps)}])"


def _step(state: int, cost: str, letter: str, line: str = "''") -> str:
    return f"{{'c': s[{state + 1}].c + {cost}, 'a': s[{state + 1}].a || '{letter}', 't': s[{state + 1}].t || {line}}}"


def _kept(initial: str, state: int) -> str:
    return _step(state, f"(CASE WHEN NOT blank AND NOT again AND r = '{initial}' THEN cut::INT ELSE 1000000000 END)", "K", "role || ':' || text || chr(10)")


def _rerole(role: str, state: int) -> str:
    return _step(state, "(CASE WHEN NOT blank AND NOT again THEN 2 + cut::INT ELSE 1000000000 END)", "R", f"'{role}:' || text || chr(10)")


def _inserted(role: str, state: int) -> str:
    return _step(state, "2", "I", f"'{role}:' || chr(10)")


# One step over a row for each state (start, after system, after user, after assistant), then insertions, twice
# because a user row and an assistant row can follow each other.
_OVER_ROW = ", ".join([
    _step(0, "3", "D"),
    _best(_step(1, "3", "D"), _kept("s", 0)),
    _best(_step(2, "3", "D"), *[f for x in (0, 1, 3) for f in (_kept("u", x), _rerole("user", x))]),
    _best(_step(3, "3", "D"), _kept("a", 2), _rerole("assistant", 2)),
])
_INSERT = ", ".join([
    "s[1]", "s[2]",
    _best("s[3]", *[_inserted("user", x) for x in (0, 1, 3)]),
    _best("s[4]", _inserted("assistant", 2)),
])

OP11 = rf"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      [4294967295] || list_transform(
        regexp_extract_all(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '.'), lambda x: ascii(x)),
      lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))),
      4294967295) % 20 AS code
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE code <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, left(role, 1) AS r
  FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    regexp_matches(text, '[^.!? 	-][ 	-]*\z') AS cut,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM placed),
counted AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, [{{'c': 0, 'a': '', 't': ''}}, {{'c': 1000000000, 'a': '', 't': ''}},
    {{'c': 2, 'a': 'I', 't': 'user:' || chr(10)}}, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}}] AS s
  FROM counted
  UNION ALL
  SELECT conv_id, i, [{_INSERT}] AS s FROM (
    SELECT conv_id, i, [{_INSERT}] AS s FROM (
      SELECT j.conv_id, j.i, [{_OVER_ROW}] AS s FROM walk w JOIN judged j ON w.conv_id IS NOT DISTINCT FROM j.conv_id AND j.i = w.i + 1))),
ended AS (
  SELECT c.*, {_best('s[1]', 's[4]')} AS e FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n),
everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit,
  sha256(coalesce(left(e.t, length(e.t) - 1), '')) AS repaired_sha256
FROM everyone o LEFT JOIN ended x ON o.conv_id IS NOT DISTINCT FROM x.conv_id
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
hashed AS (
  SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3,
    ('0x' || h[25:32])::BIGINT AS h4
  FROM d),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
parts AS (
  SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""

OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
