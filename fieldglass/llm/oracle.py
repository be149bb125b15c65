"""Corpus queries as SQL, for comparison with another engine."""

_BITS = "list_reduce([{c}] || [0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_STEP = _BITS.format(c="xor(x, y)")
_CRC = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda x, y: {_STEP}), 4294967295)"


def groups(k: int, more: str) -> str:
    """Documents grouped by sets of k-word shingles at a Jaccard similarity of 0.85: pairs by shared shingles, then what each document reaches."""
    return f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  shingles AS (SELECT DISTINCT d, hash(s) AS s FROM (SELECT d, unnest(CASE WHEN len(ws) >= {k} THEN list_transform(range(len(ws) - {k - 1}), lambda i: array_to_string(ws[i + 1:i + {k}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM texts) x),
  sizes AS (SELECT d, count(*) AS n FROM shingles GROUP BY d),
  shared AS (SELECT a.d AS a, b.d AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.d <> b.d GROUP BY a.d, b.d),
  links AS (SELECT a, b FROM shared JOIN sizes x ON x.d = a JOIN sizes y ON y.d = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
  reach AS (SELECT d AS a, d AS b FROM sizes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
  tops AS (SELECT a AS d, min(doc_id) AS component_id FROM reach JOIN texts t ON t.d = b GROUP BY a),
  named AS (SELECT t.doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN t.doc_id ELSE component_id END AS component_id FROM texts t LEFT JOIN sizes USING (d) LEFT JOIN tops USING (d))
SELECT doc_id, n_shingles, component_id{more} FROM named
"""


def _best(*options: str) -> str:
    """The least of (cost, letters) structs; a null one doesn't count."""
    return f"list_min(list_filter([{', '.join(options)}], lambda o: o IS NOT NULL))"


def _then(cost: str, letter: str, behind: str) -> str:
    return f"{{'c': {cost} + {behind}.c, 'l': '{letter}' || {behind}.l}}"


def _take(state: int) -> str:
    """The cheapest edit that takes the row in a state."""
    takes, following = {0: ("s", "u"), 1: ("u",), 2: ("a",), 3: ("u",)}[state], {0: 2, 1: 2, 2: 3, 3: 2}[state]
    to = {"s": 1, "u": 2, "a": 3}
    options = [_then("3", "D", f"w.v{state}"), f"CASE WHEN f > 0 OR f = 0 THEN {_then('2 + f', 'R', f'w.v{following}')} END"]
    options += [f"CASE WHEN f >= 0 AND r.i = '{x}' THEN {_then('f', 'K', f'w.v{to[x]}')} END" for x in takes]
    return _best(*options)


CONVERSATIONS = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
  hit AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS d FROM keyed),
  cut AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE d <> 0),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, count(*) OVER (PARTITION BY conv_id) AS size FROM cut),
  judged AS (SELECT *, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered),
  r AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN -1 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS f,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || i AS adjacent FROM judged),
  walk AS (SELECT conv_id, size + 1 AS n, {{'c': 0, 'l': ''}} AS v0, {{'c': 4, 'l': 'II'}} AS v1, {{'c': 2, 'l': 'I'}} AS v2, {{'c': 0, 'l': ''}} AS v3 FROM r WHERE n = 1
    UNION ALL SELECT conv_id, n, {_best("c0", _then("2", "I", "i2"))} AS v0, {_best("c1", _then("2", "I", "i2"))} AS v1, i2 AS v2, {_best("c3", _then("2", "I", "c2"))} AS v3
    FROM (SELECT *, {_best("c2", _then("2", "I", "c3"))} AS i2
      FROM (SELECT r.conv_id, r.n, {", ".join(f"{_take(s)} AS c{s}" for s in range(4))} FROM walk w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n - 1) a) b),
  edits AS (SELECT conv_id, v0.c AS cost, v0.l AS audit FROM walk WHERE n = 1),
  letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM edits),
  placed AS (SELECT conv_id, p, substr(audit, p, 1) AS e, substr(audit, 1, p) AS so_far FROM letters),
  taken AS (SELECT *, length(replace(so_far, 'I', '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS z FROM placed),
  turns AS (SELECT t.conv_id, t.p, t.e, CASE WHEN t.e = 'K' THEN r.role END AS role, CASE WHEN t.e = 'I' THEN '' ELSE r.text END AS text
    FROM taken t LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.n = t.n WHERE t.e <> 'D'),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS q, left(first_value(role) OVER (PARTITION BY conv_id ORDER BY p), 1) = 's' AS led FROM turns),
  named AS (SELECT conv_id, q, text, coalesce(role, CASE WHEN (q - CASE WHEN coalesce(led, FALSE) THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END) AS role FROM ranked),
  joined AS (SELECT conv_id, string_agg(role || ':' || text, chr(10) ORDER BY q) AS whole FROM named GROUP BY conv_id),
  counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE adjacent NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
  ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM ids LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN edits e ON e.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN joined j ON j.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

#: Equal words q apart are islands of the pairs (i, i + q); an island within one of a smaller q has not its smallest period.
RUNS = f"""
WITH keyed AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, coalesce(CAST(doc_id AS VARCHAR), 'none') AS k FROM documents),
  hashed AS (SELECT d, doc_id, ws, len(ws) AS n, CASE WHEN doc_id IS NULL THEN 1 ELSE {_CRC} END AS h FROM keyed),
  cut AS (SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a, (h // 10) % 8 AS e FROM hashed),
  stepped AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + e) END AS p FROM cut),
  texts AS (SELECT d, doc_id, n, CASE WHEN p IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) END AS ws FROM stepped),
  words AS (SELECT d, n, unnest(range(n)) AS i, unnest(ws) AS w FROM texts),
  pairs AS (SELECT x.d, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.d = y.d AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
  numbered AS (SELECT *, i - row_number() OVER (PARTITION BY d, q ORDER BY i) AS island FROM pairs),
  stretches AS (SELECT d, q, min(i) AS s, count(*) + q AS l FROM numbered GROUP BY d, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
  runs AS (SELECT * FROM stretches a WHERE NOT EXISTS (SELECT 1 FROM stretches b WHERE b.d = a.d AND b.q < a.q AND b.s <= a.s AND b.s + b.l >= a.s + a.l)),
  listed AS (SELECT d, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, arg_min([s, l, q], [-l, s, q]) AS best FROM runs GROUP BY d),
  dropped AS (SELECT DISTINCT d, unnest(range(s + q, s + l)) AS i FROM runs),
  kept AS (SELECT w.d, string_agg(w.w, ' ' ORDER BY w.i) AS whole FROM words w ANTI JOIN dropped x ON x.d = w.d AND x.i = w.i GROUP BY w.d)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period, CAST(1000 * best[2] // best[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(whole, '')) AS collapsed_sha256
FROM texts t LEFT JOIN listed USING (d) LEFT JOIN kept USING (d)
"""
