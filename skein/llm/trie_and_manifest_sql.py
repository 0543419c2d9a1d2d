"""Operators 12 and 13 as DuckDB SQL: levels and walks by recursion, prefixes by window, subtrees by all prefixes of a node."""

_CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)))"""


def crc32_sql(text: str) -> str:
    """The crc32 of an ASCII text, with ``crc_table`` in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {codes}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


TRIE_SQL = f"""
WITH {_CRC_TABLE},
said AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
  md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - ((c % 20) + 20) % 20 AS base, {crc32_sql("c::VARCHAR")} % 4 AS h, n FROM (SELECT c, count(*) AS n FROM said GROUP BY c), crc_table),
built AS (SELECT said.c, i + 1 AS d, m, words FROM said JOIN convs USING (c) WHERE c = base
  UNION ALL SELECT v.c, i + 1, m, words FROM convs v JOIN said s ON s.c = v.base AND s.i < v.h WHERE v.c <> v.base
  UNION ALL SELECT said.c, i + 1 - v.h + least(v.h, coalesce(b.n, 0)), m, words FROM said JOIN convs v USING (c) LEFT JOIN convs b ON b.c = v.base WHERE v.c <> v.base AND i >= v.h),
keyed AS (SELECT c, d, words, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS k FROM built
  UNION ALL SELECT c, 0, 0, 'root' FROM convs),
above AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS last FROM keyed),
nodes AS (SELECT k, d, min(c) AS c, count(*) AS n, any_value(up) AS up, (count(*) - 1) * any_value(words) AS saved,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last), '')) AS ends FROM above GROUP BY k, d),
kids AS (SELECT up, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
sums AS (SELECT a.k, sum(x.saved) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM nodes x JOIN keyed a ON a.c = x.c AND a.d <= x.d LEFT JOIN kids ON kids.up = x.k GROUP BY a.k)
SELECT x.c AS conv_id, x.d AS depth, p.c AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children, sums.leaves AS n_leaves, sums.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums USING (k) LEFT JOIN nodes p ON p.k = x.up LEFT JOIN kids ON kids.up = x.k
"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")), _FIELD.format(text)]) + ")"


def _tree(name: str, leaves: str) -> str:
    """Levels of the trees of ``leaves`` (s, i, d), the runs of 16 of every level but the last, and the roots."""
    return f"""{name}_lv(l, s, i, d) AS (SELECT 0, s, i, d FROM {leaves} UNION ALL
  SELECT l + 1, s, i // 16, sha256(string_agg(d, '' ORDER BY i)) FROM {name}_lv WHERE s IN (SELECT s FROM {name}_lv GROUP BY s HAVING count(*) > 1) GROUP BY l, s, i // 16),
{name}_runs AS (SELECT l, s, i // 16 AS r, list(d ORDER BY i) AS ds FROM {name}_lv WHERE (s, l) IN (SELECT (s, l) FROM {name}_lv GROUP BY s, l HAVING count(*) > 1) GROUP BY l, s, i // 16),
{name}_root AS (SELECT s, arg_max(d, l) AS d FROM {name}_lv GROUP BY s)"""


def _walk(name: str, tree: str, start: str) -> str:
    """From rows (row, s, i, digest, proof) up their tree: the folded digest and the siblings on the way."""
    before, after = "array_to_string(ds[1:w.i % 16], '')", "array_to_string(ds[w.i % 16 + 2:], '')"
    return f"""{name}(row, s, l, i, digest, proof) AS (SELECT row, s, 0, i, digest, proof FROM {start} UNION ALL
  SELECT w.row, w.s, w.l + 1, w.i // 16, sha256({before} || digest || {after}), proof || {before} || {after} FROM {name} w JOIN {tree}_runs u ON u.s = w.s AND u.l = w.l AND u.r = w.i // 16),
{name}_end AS (SELECT row, arg_max(s, l) AS s, arg_max(digest, l) AS digest, arg_max(proof, l) AS proof FROM {name} GROUP BY row)"""


MANIFEST_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
docs AS (SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, crc_table),
hashed AS (SELECT doc_id, s, {_leaf("text")} AS d, {_leaf("other")} AS digest FROM docs),
leaves AS (SELECT *, row_number() OVER (ORDER BY s, doc_id NULLS FIRST, d) AS row, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, d) - 1 AS i, '' AS proof FROM hashed),
{_tree("own", "leaves")},
tops AS (SELECT 'all' AS s, s AS source, row_number() OVER (ORDER BY s) - 1 AS i, d FROM own_root),
{_tree("top", "tops")},
{_walk("low", "own", "leaves")},
middle AS (SELECT row, 'all' AS s, tops.i, digest, proof FROM low_end JOIN tops ON tops.source = low_end.s),
{_walk("high", "top", "middle")}
SELECT doc_id, leaves.d AS leaf, own_root.d AS subroot, top_root.d AS root, sha256(high_end.proof) AS proof_sha256, high_end.digest AS folded_root, high_end.digest = top_root.d AS verified
FROM leaves JOIN high_end USING (row) JOIN own_root ON own_root.s = leaves.s, top_root
"""
