"""DuckDB SQL of span tagging and of greedy matching, with which the library's Arrow functions are compared."""

from __future__ import annotations

from ..functions.spans import Vocabulary

_WORD = r"[\p{L}\p{N}_]"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def span_sql(source: str, key: str, vocabulary: Vocabulary) -> str:
    """Spans (key, type, value, start, stop, role) of a SELECT of (key, text).

    A surface's occurrences are the gaps between the parts that it splits a text into, numbers those between the
    parts of their pattern. The spans that stay are a chain: each one's successor is the first that begins at or
    after its end.
    """
    surfaces = [
        f"({rank}, {i}, {_text(kind)}, {_text(s)}, {str(whole).lower()})"
        for i, (rank, kind, s, whole) in enumerate(
            [(0, "muscle", s, False) for s in vocabulary.muscles]
            + [(1, "region", s, vocabulary.whole_regions) for s in vocabulary.regions]
            + [(2, "movement", s, vocabulary.whole_movements) for s in vocabulary.movements]
        )
    ]
    before = f"substr(text, greatest(pos - {vocabulary.context}, 0) + 1, least(pos, {vocabulary.context}))"
    role = " ".join(f"WHEN contains({before}, {_text(word)}) THEN {_text(name)}" for word, name in vocabulary.roles)
    role = f"CASE {role} ELSE 'value' END" if role else "'value'"
    pattern = _text(vocabulary.numbers)
    return f"""WITH RECURSIVE docs AS ({source}),
surfaces(rank, i, kind, word, whole) AS (VALUES {", ".join(surfaces)}),
cut AS (SELECT {key}, text, rank, i, kind, word, whole, list_transform(string_split(text, word), lambda p: length(p)) AS parts FROM docs JOIN surfaces ON contains(text, word)),
hits AS (SELECT {key}, text, rank, i, kind, word, whole, CAST(list_sum(parts[1:j]) + (j - 1) * length(word) AS INT) AS pos FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS j FROM cut)),
named AS (SELECT {key}, pos, rank, i, pos + length(word) AS stop, kind, word AS value, NULL AS role FROM hits
  WHERE NOT whole OR NOT ((pos > 0 AND regexp_matches(substr(text, pos, 1), '{_WORD}')) OR regexp_matches(substr(text, pos + length(word) + 1, 1), '{_WORD}'))),
gaps AS (SELECT {key}, text, regexp_extract_all(text, {pattern}) AS nums, list_transform(regexp_split_to_array(text, {pattern}), lambda p: length(p)) AS parts FROM docs),
found AS (SELECT {key}, text, nums[j] AS value, CAST(list_sum(parts[1:j]) + coalesce(list_sum(list_transform(nums[1:j - 1], lambda p: length(p))), 0) AS INT) AS pos FROM (SELECT *, unnest(generate_series(1, len(nums))) AS j FROM gaps)),
numbers AS (SELECT {key}, pos, 3 AS rank, {len(surfaces)} AS i, pos + length(value) AS stop, 'number' AS kind, value, {role} AS role FROM found WHERE pos = 0 OR substr(text, pos, 1) <> '#'),
spans AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pos, rank, i) AS n FROM (SELECT * FROM named UNION ALL SELECT * FROM numbers)),
firsts AS (SELECT {key}, pos, min(n) AS n FROM spans GROUP BY {key}, pos),
linked AS (SELECT s.*, f.n AS after FROM spans s ASOF LEFT JOIN firsts f ON s.{key} = f.{key} AND s.stop <= f.pos),
kept AS (SELECT * FROM linked WHERE n = 1 UNION ALL SELECT l.* FROM kept k JOIN linked l ON l.{key} = k.{key} AND l.n = k.after)
SELECT {key}, kind AS type, value, pos AS start, stop, role FROM kept"""


def greedy_sql(source: str, rel: float = 0.02, floor: float = 0.01) -> str:
    """tp, fp, fn of a SELECT of (key, gold, pred): a step for each gold number in order, with the predictions that are left."""
    return f"""WITH RECURSIVE items AS ({source}),
steps(key, i, gold, rest, tp) AS (SELECT key, 1, list_sort(gold), list_sort(pred), 0 FROM items
  UNION ALL SELECT key, i + 1, gold, CASE WHEN near THEN rest[1:pos - 1] || rest[pos + 1:len(rest)] ELSE rest END, tp + CAST(near AS INT)
  FROM (SELECT *, coalesce(abs(rest[pos] - gold[i]) <= greatest({floor}, {rel} * abs(gold[i])), false) AS near
    FROM (SELECT *, list_position(away, list_min(away)) AS pos FROM (SELECT *, list_transform(rest, lambda p: abs(p - gold[i])) AS away FROM steps WHERE i <= len(gold)))))
SELECT key, CAST(tp AS BIGINT) AS tp, CAST(len(rest) AS BIGINT) AS fp, CAST(len(gold) - tp AS BIGINT) AS fn FROM steps WHERE i = len(gold) + 1"""
