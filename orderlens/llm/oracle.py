"""SQL that gives the rows of the queries SQL can express, on the same tables."""

from __future__ import annotations

from orderlens.llm.chat_format import BLOCK, BUDGET, HISTORY, START, STOP, TURN_TOKENS

# Exact shingle sets, one class for equal sets, every pair of classes that shares a shingle.
NEAR_DEDUP = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place, len(w) AS words FROM worded
), joined AS (
  SELECT doc_id, words - place AS behind, words, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o,
    lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
  FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY place)
), shingles AS (
  SELECT DISTINCT doc_id, shingle FROM joined WHERE behind >= least(words, 5) - 1
), sets AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS k FROM shingles GROUP BY doc_id
), classes AS (
  SELECT k, min(doc_id) AS node, any_value(n) AS n FROM sets GROUP BY k
), held AS (
  SELECT c.node, c.n, s.shingle FROM classes c JOIN shingles s ON s.doc_id = c.node
), linked AS (
  SELECT a.node AS u, b.node AS v
  FROM held a JOIN held b ON a.shingle = b.shingle AND a.node <> b.node
  GROUP BY a.node, b.node
  HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT node AS u, node AS root FROM classes
  UNION
  SELECT l.v, r.root FROM reach r JOIN linked l ON l.u = r.u
), roots AS (
  SELECT u, min(root) AS root FROM reach GROUP BY u
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id,
  d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM documents d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN classes c ON c.k = s.k LEFT JOIN roots r ON r.u = c.node
"""

# Digests straight from the turns; windows by following each place to the first turn that no longer fits.
CHAT_WINDOWS = f"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), turns AS (
  SELECT {{'none': conv_id IS NULL, 'id': coalesce(conv_id, 0)}} AS conv, *,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS seq,
    {TURN_TOKENS} + len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]{{1,8}}|[^\\p{{L}}\\p{{N}}\\x20\\x09-\\x0D]')) AS cost,
    {len(START) + 1 + len(STOP)}
      + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;'))
      + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS chars
  FROM said
), systems AS (
  SELECT conv, cost, chars FROM turns WHERE seq = 1 AND role = 'system'
), body AS (
  SELECT t.conv, t.seq, t.cost, t.chars, (t.seq - 1) // {BLOCK} AS block, coalesce(s.chars, 0) AS system_chars,
    greatest({BUDGET - HISTORY} - coalesce(s.cost, 0), {BUDGET // 4}) AS room,
    sum(t.cost) OVER (PARTITION BY t.conv ORDER BY t.seq) - t.cost AS place
  FROM turns t LEFT JOIN systems s ON s.conv = t.conv
  WHERE s.conv IS NULL OR t.seq > 1
), follow AS (
  SELECT a.conv, a.block, a.place, a.system_chars, min(b.place) AS next_place
  FROM body a LEFT JOIN body b
    ON b.conv = a.conv AND b.block = a.block AND b.place > a.place AND b.place + b.cost - a.place > a.room
  GROUP BY ALL
), starts AS (
  SELECT conv, block, min(place) AS place FROM body GROUP BY conv, block
  UNION ALL
  SELECT f.conv, f.block, f.next_place FROM starts s JOIN follow f ON f.conv = s.conv AND f.place = s.place
  WHERE f.next_place IS NOT NULL
), again AS (
  SELECT s.conv, any_value(f.system_chars) + coalesce(sum(b.chars), 0) AS chars
  FROM starts s JOIN follow f ON f.conv = s.conv AND f.place = s.place
  LEFT JOIN body b ON b.conv = s.conv AND b.place < s.place AND b.place >= s.place - {HISTORY}
  WHERE s.place > 0
  GROUP BY s.conv, s.place
), repeated AS (
  SELECT conv, sum(chars) AS chars FROM again GROUP BY conv
), digests AS (
  SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n_turns, sum(chars) AS chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM turns GROUP BY conv
)
SELECT d.conv_id, d.n_turns, d.turns_sha256, length(d.loss) AS loss_chars, sha256(d.loss) AS loss_sha256,
  cast(d.chars + coalesce(r.chars, 0) AS BIGINT) AS formatted_chars
FROM digests d LEFT JOIN repeated r ON r.conv = d.conv
"""



def _field(expression: str) -> str:
    return f"coalesce(strlen({expression}) || ':' || {expression}, '-')"


def _leaf(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return f"sha256({' || '.join(map(_field, fields))})"


# CRC-32 of a decimal number, a bit at a time: each digit is followed by eight shifts.
_CRC = """
  xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)
"""

# Nodes level by level; a path goes up with its level's run of siblings, the groups' tree after the group's own.
MERKLE = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 5 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS found
  FROM documents
), leaves AS (
  SELECT *, {{'null': source IS NULL, 'name': coalesce(source, '')}} AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY source) AS n
  FROM rows
), nodes AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE n > 1 GROUP BY tree, level, place // 16, n
), subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY NOT tree['null'], encode(tree['name'])) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE n > 1 GROUP BY level, place // 16, n
), up AS (
  SELECT doc_id, tree, 0 AS level, place, n, coalesce(found, leaf) AS digest, '' AS others FROM leaves
  UNION ALL
  SELECT u.doc_id, u.tree, u.level + 1, u.place // 16, (u.n + 15) // 16,
    sha256(string_agg(CASE WHEN s.place = u.place THEN u.digest ELSE s.digest END, '' ORDER BY s.place)),
    any_value(u.others) || coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place <> u.place), '')
  FROM up u JOIN nodes s ON s.tree = u.tree AND s.level = u.level AND s.place // 16 = u.place // 16
  WHERE u.n > 1 GROUP BY u.doc_id, u.tree, u.level, u.place, u.n
), over AS (
  SELECT u.doc_id, 0 AS level, s.place, s.n, u.digest, u.others FROM up u JOIN subroots s ON s.tree = u.tree WHERE u.n = 1
  UNION ALL
  SELECT u.doc_id, u.level + 1, u.place // 16, (u.n + 15) // 16,
    sha256(string_agg(CASE WHEN s.place = u.place THEN u.digest ELSE s.digest END, '' ORDER BY s.place)),
    any_value(u.others) || coalesce(string_agg(s.digest, '' ORDER BY s.place) FILTER (WHERE s.place <> u.place), '')
  FROM over u JOIN tops s ON s.level = u.level AND s.place // 16 = u.place // 16
  WHERE u.n > 1 GROUP BY u.doc_id, u.level, u.place, u.n
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, sha256(o.others) AS proof_sha256,
  o.digest AS folded_root, o.digest = t.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN over o ON o.doc_id = l.doc_id AND o.n = 1 JOIN tops t ON t.n = 1
"""

_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 1)"
_REST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 2)"

CAPTURES = rf"""
WITH paid AS (
  SELECT page_id, coalesce(html, '') AS payload,
    replace(replace(replace(replace(url, chr(13), '%0D'), chr(10), '%0A'), chr(9), '%09'), ' ', '%20') AS url,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 31536000), '%Y-%m-%dT%H:%M:%SZ') AS date
  FROM pages
), keyed AS (
  SELECT *, sha256(payload) AS digest, strlen(payload) AS size, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://')
    THEN array_to_string(list_reverse(string_split(
      regexp_replace(regexp_replace(lower({_HOST}), '^www[0-9]*\.', ''), ':(80|443)$', ''), '.')), ',')
      || ')' || regexp_replace({_REST}, '/$', '')
    ELSE coalesce(url, '') END AS url_key
  FROM paid
), placed AS (
  SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first,
    row_number() OVER (ORDER BY encode(url_key), date, page_id) - 1 AS place
  FROM keyed
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to, url_key, date, place
FROM placed
"""

HARD_NEGATIVES = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other_id, a.label = c.label AS same,
    list_dot_product(a.q, c.q)::BIGINT AS score
  FROM sound a JOIN sound c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
  s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) <= 3
"""

STATEMENTS: dict[str, str] = {
    "op7_chat_windows": CHAT_WINDOWS,
    "op9_minhash_near_dedup": NEAR_DEDUP,
    "op11_warc_captures": CAPTURES,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_merkle_manifest": MERKLE,
}
