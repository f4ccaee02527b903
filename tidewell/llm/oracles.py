"""DuckDB SQL of those queries of this subpackage that SQL can express, over the same tables."""

from __future__ import annotations

#: crc32 of the decimal ``c``, bit by bit.
CRC32 = """
    xor(4294967295, list_reduce(
        list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::BIGINT, 1))::BIGINT),
        lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, byte)), 4294967295))"""

OP11 = f"""
WITH own AS (
    SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS v
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL
), h AS (SELECT c, v, {CRC32} % 6 AS h FROM own
), rebuilt AS (
    SELECT h.c, list_concat(coalesce(b.v[1:h.h], []), h.v[h.h + 1:]) AS v FROM h LEFT JOIN own b ON b.c = h.c - h.c % 100
), members AS (SELECT c, unnest(range(0, len(v) + 1)) AS d, len(v) AS n, v FROM rebuilt
), keyed AS (SELECT c, d, n, v[1:d] AS key FROM members
), nodes AS (
    SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN d = n THEN c::VARCHAR END, ',' ORDER BY c) AS ends
    FROM keyed GROUP BY ALL
), place AS (SELECT k.c, k.d, m.conv_id FROM keyed k JOIN nodes m ON m.d = k.d AND m.key = k.key
), up AS (
    SELECT n.d, n.conv_id, n.n_convs, n.ends, coalesce(length(n.key[n.d].x), 0) AS chars, p.conv_id AS parent
    FROM nodes n LEFT JOIN place p ON p.c = n.conv_id AND p.d = n.d - 1
), kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL
), tree AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (d, conv_id)
), sums AS (
    SELECT p.d, p.conv_id, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved_tokens
    FROM tree u JOIN place p ON p.c = u.conv_id AND p.d <= u.d GROUP BY ALL
)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM tree JOIN sums USING (d, conv_id)"""

OP12 = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), draws AS (
    SELECT *, len(u) AS n, [('0x' || substr(x, 8 * i::BIGINT + 1, 8))::BIGINT for i in [0, 1, 2, 3]] AS h FROM units
), cuts AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws
), parts AS (
    SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts"""

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": OP11, "op12_fill_in_middle": OP12}
