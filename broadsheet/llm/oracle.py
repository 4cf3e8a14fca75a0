"""DuckDB SQL of the training-data queries that SQL can express.

op7 follows the contract directly.  op5 repeats the rules of policy v2; windows
are spelled out and counted.  op9 computes crc32 and the jump hash.  The other queries train models, iterate, write
files or use hashes DuckDB lacks; they are tested against plain Python.  op11
builds its trees level by level and walks every leaf up.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

OP5 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls
  FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(ws[i:i+7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, g FROM w GROUP BY doc_id, g HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT w.doc_id, w.i, unnest(range(8)) AS k FROM w JOIN twice USING (doc_id, g)) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper,
         length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS n_letters
  FROM d LEFT JOIN covered USING (doc_id)),
b AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > n_letters THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits, 'v2' AS policy
FROM b
"""

OP7 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, keep_id, group_size, d.doc_id = keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""

# crc32 byte by byte with the table of its polynomial; the walk of the jump hash as a recursion
OP9 = """
WITH RECURSIVE t AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab
  FROM (SELECT unnest(range(256)) AS n)),
d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(string_split(trim(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g')), ' '),
                        lambda x: CASE WHEN x = '' THEN NULL ELSE CAST('0x' || x AS BIGINT) END) AS bytes
  FROM documents),
c AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size,
         xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_filter(bytes, lambda x: x IS NOT NULL)),
                                             lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS text_crc32
  FROM d, t),
ids AS (SELECT DISTINCT doc_id FROM documents),
walk AS (
  SELECT doc_id, n, -1::BIGINT AS b, 0::BIGINT AS j,
         CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS k
  FROM ids, (SELECT unnest([16, 17]) AS n)
  UNION ALL
  SELECT doc_id, n, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / CAST(s // 8589934592 + 1 AS DOUBLE))) AS BIGINT), s
  FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM walk WHERE j < n)),
shards AS (
  SELECT doc_id, CAST(max(b) FILTER (WHERE n = 16) AS INTEGER) AS shard, CAST(max(b) FILTER (WHERE n = 17) AS INTEGER) AS grown_shard
  FROM walk GROUP BY doc_id)
SELECT c.doc_id, c.size, c.text_crc32, 'key' AS law, s.shard, s.grown_shard,
       row_number() OVER (PARTITION BY s.shard ORDER BY (text_crc32 + ((coalesce(c.doc_id, 0) % 256) + 256) % 256) % 256,
                          c.doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
FROM c JOIN shards s ON s.doc_id IS NOT DISTINCT FROM c.doc_id
"""

def _field(value: str) -> str:
    return f"(CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END)"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _tree(name: str, start: str) -> str:
    """Nodes (tree, level, idx, h, n on the level) over the leaves of ``start``, and what stands left and right of each in its run."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n),
{name}_side AS (
  SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx)"""


def _walk(name: str, start: str, side: str) -> str:
    """The rows of ``start`` walked up by the neighbours in ``side``."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT doc_id, leaf, tree, own, level + 1, idx // 3, sha256(lft || h || rgt), proof || lft || rgt
  FROM {name} JOIN {side} USING (tree, level, idx))"""


OP11 = f"""
WITH RECURSIVE t AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) ORDER BY n) AS tab
  FROM (SELECT unnest(range(256)) AS n)),
c AS (
  SELECT *, coalesce(xor(4294967295::BIGINT, list_reduce(
              list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
              lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))), 0) AS crc
  FROM documents, t),
d AS (
  SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found
  FROM c),
g AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, n
  FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)),
l AS (
  SELECT d.*, tree, n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
{_tree("low", "SELECT tree, 0 AS level, idx, leaf AS h, n FROM l")},
{_tree("high", "SELECT 0 AS tree, 0 AS level, tree AS idx, h, (SELECT count(*) FROM g) AS n FROM low WHERE n = 1")},
{_walk("up", "SELECT doc_id, leaf, tree, tree AS own, 0 AS level, idx, found AS h, '' AS proof FROM l", "low_side")},
{_walk("top", '''SELECT doc_id, leaf, 0 AS tree, own, 0 AS level, own AS idx, up.h, proof
  FROM up JOIN low ON low.tree = up.own AND low.level = up.level AND low.n = 1''', "high_side")}
SELECT doc_id, leaf, low.h AS subroot, high.h AS root, sha256(proof) AS proof_sha256, top.h AS folded_root, top.h = high.h AS verified
FROM top JOIN high ON high.n = 1 AND high.level = top.level JOIN low ON low.tree = top.own AND low.n = 1
"""

OP13 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLE = {"op5_quality_rules": OP5, "op7_exact_dedup": OP7, "op9_sharding": OP9, "op11_merkle_manifest": OP11,
          "op13_hard_negatives": OP13}
