"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP1 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT b, root FROM r JOIN both_ways ON r.doc_id = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""

OP8 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
tri AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (
  SELECT doc_id, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
         length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣◦]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '([.]{3}|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
r AS (
  SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, 10 * n_symbols > n_words AS r2,
         n_lines >= 4 AND 2 * n_dup_lines > n_lines AS r3,
         n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS r4,
         2 * n_digits > word_chars AS r5, n_lines >= 4 AND 10 * n_bullet_lines > 9 * n_lines AS r6,
         n_lines >= 4 AND 10 * n_ellipsis_lines > 3 * n_lines AS r7
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r0 OR r1 AS base_failed,
       NOT (r0 OR r1 OR r2 OR r3 OR r4) AS kept,
       CAST(r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT + 128 * r7::INT AS INT) AS rule_bits
FROM r
"""


OP9 = r"""
WITH l AS (
  SELECT doc_id, p, x, lower_ascii AS k FROM (
    SELECT doc_id, p, x, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, generate_subscripts(ls, 1) AS p, unnest(ls) AS x
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)))),
h AS (SELECT k, max(doc_id) AS keep_doc FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT doc_id, p, x, keep_doc IS NOT NULL AND keep_doc <> doc_id AS gone FROM l LEFT JOIN h ON l.k = h.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""



_FIELDS = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in [*_FIELDS, text]) + ")"


def _tree(name: str, leaves: str, levels: int) -> str:
    """Tables name0, name1 ...: (g, i, h, n), the nodes of each level with their number; names ending in s hold siblings."""
    out = [f"{name}0 AS ({leaves})"]
    for k in range(levels):
        out.append(
            f"{name}{k}r AS (SELECT g, i // 16 AS run, sha256(string_agg(h, '' ORDER BY i)) AS up, "
            f"list(h ORDER BY i) AS hs, any_value(n) AS n FROM {name}{k} WHERE n > 1 GROUP BY g, i // 16)"
        )
        out.append(
            f"{name}{k + 1} AS (SELECT g, run AS i, up AS h, (n + 15) // 16 AS n FROM {name}{k}r "
            f"UNION ALL SELECT g, i, h, n FROM {name}{k} WHERE n = 1)"
        )
    return ",\n".join(out)


def _fold(name: str, levels: int, state: str, group: str, index: str) -> tuple[str, str]:
    """CTEs that lift (node, proof) of each row through the levels, and the last one's name."""
    out = []
    for k in range(levels):
        at = f"({index} // {16**k})"
        left, right = f"array_to_string(hs[:CAST({at} % 16 AS BIGINT)], '')", f"array_to_string(hs[CAST({at} % 16 AS BIGINT) + 2:], '')"
        out.append(
            f"{name}f{k} AS (SELECT s.* EXCLUDE (node, proof), CASE WHEN hs IS NULL THEN node ELSE sha256({left} || node || {right}) END AS node, "
            f"CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END AS proof "
            f"FROM {state} s LEFT JOIN {name}{k}r r ON r.g = s.{group} AND r.run = {at} // 16)"
        )
        state = f"{name}f{k}"
    return ",\n".join(out), state


def _op12(levels: int = 6) -> str:
    """Trees of up to 16^levels leaves, level by level."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low, low_end = _fold("a", levels, "rows0", "t", "i")
    high, high_end = _fold("b", levels, "mid", "zero", "t")
    return f"""
WITH d AS (
  SELECT doc_id, {_leaf("text")} AS leaf, {_leaf(lower)} AS lowered, source,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_leaf("text")}) - 1 AS i
  FROM documents),
c AS (
  SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
         lambda p: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), p, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295) AS crc
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
{_tree("a", "SELECT t AS g, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM d", levels)},
{_tree("b", f"SELECT 0 AS g, g AS i, h, count(*) OVER () AS n FROM a{levels}", levels)},
rows0 AS (
  SELECT d.doc_id, leaf, t, i, 0 AS zero, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS node, '' AS proof
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
{low},
mid AS (SELECT m.*, s.h AS subroot FROM {low_end} m JOIN a{levels} s ON s.g = m.t),
{high}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = r.h AS verified
FROM {high_end}, (SELECT h FROM b{levels}) r
"""


OP13 = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, lang, x FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS x
    FROM documents)),
w AS (SELECT id, lang, list_filter(string_split_regex(x, '[\x20\x09]+'), lambda y: y <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE len(ws) > 0),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(ws)),
n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
sub AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[b:b + k - 1], ' ') AS phrase, a
  FROM (SELECT lang, phrase, a, m, unnest(range(2, m)) AS k FROM f WHERE m > 2), (SELECT unnest(range(1, 6)) AS b) WHERE b + k - 1 <= m),
c AS (SELECT * FROM f WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM sub WHERE sub.lang = f.lang AND sub.phrase = f.phrase AND 100 * sub.a >= 100 * f.a)),
k AS (SELECT lang, phrase, a, m, unnest(range(1, m)) AS k FROM c),
z AS (
  SELECT k.lang, k.phrase, k.a, k, x.a AS l, y.a AS r, n.n,
         (CAST(1000 AS HUGEINT) * k.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(string_split(k.phrase, ' ')[:k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(string_split(k.phrase, ' ')[k + 1:], ' ')
  JOIN n ON n.lang = k.lang),
o AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM o QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op2_jaccard_join": OP2, "op8_quality_rules": OP8, "op9_line_dedup": OP9, "op12_merkle_manifest": _op12(), "op13_collocations": OP13}
