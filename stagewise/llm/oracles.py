"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(name: str, table: str, key: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {key}, array_to_string(list_slice(w, s, s + 4), ' ') AS k
  FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s
        FROM (SELECT {key}, {_WORDS.format(_LOWER)} AS w FROM {table}) t WHERE len(w) > 0) u)"""


SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 12), ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM w WHERE len(w) >= 13) t),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, p FROM (
  SELECT win.doc_id, unnest(range(s, s + 13)) AS p FROM win JOIN least ON least.k = win.k WHERE m < win.doc_id) t),
runs AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN before IS NULL OR before < p - 1 THEN 1 ELSE 0 END) AS spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) t GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(runs.n, 0) AS n_removed, CAST(coalesce(runs.spans, 0) AS BIGINT) AS n_spans,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN runs ON runs.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

NEAR_COPIES = f"""
WITH RECURSIVE {_shingles('sh', 'documents', 'doc_id')},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN both_ways l ON l.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

CONTAINED = f"""
WITH {_shingles('d', 'documents', 'doc_id')},
{_shingles('i', 'benchmark', 'item_id')},
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, count(*) AS shared, n.n AS item_shingles
FROM d JOIN i ON d.k = i.k JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.n HAVING 10 * count(*) >= 8 * n.n
"""

#: crc32 of a text, bit by bit (the polynomial is a fixed value).
_CRC32 = """xor(4294967295, list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda s, b: list_reduce(list_concat([xor(s, b)], CAST([0, 1, 2, 3, 4, 5, 6, 7] AS BIGINT[])),
      lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

TRIE = f"""
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, turn,
    len({_WORDS.format("coalesce(text, '')")}) AS words FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'words': words}} ORDER BY turn NULLS FIRST, k) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM own),
built AS (SELECT h.conv_id, list_concat(coalesce(list_slice(d.turns, 1, h.h), []), coalesce(list_slice(h.turns, h.h + 1, len(h.turns)), [])) AS turns
  FROM h LEFT JOIN own d ON d.conv_id = h.conv_id - h.conv_id % 20),
member AS (SELECT conv_id, len(turns) AS n, d AS depth, list_transform(list_slice(turns, 1, d), lambda x: x.k) AS path, turns[d].words AS words
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM built) u),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words), 0) AS words, max(n) = depth AS leaf,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM member GROUP BY path, depth),
above AS (SELECT list_slice(path, 1, u) AS path, leaf, (n_convs - 1) * words AS saved, u = depth - 1 AS child
  FROM (SELECT *, unnest(range(0, depth + 1)) AS u FROM node) x),
total AS (SELECT path, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE child) AS n_children
  FROM above GROUP BY path)
SELECT node.conv_id, node.depth, p.conv_id AS parent_conv_id, node.n_convs, n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node JOIN total ON total.path = node.path
LEFT JOIN node p ON node.depth > 0 AND p.depth = node.depth - 1 AND p.path = list_slice(node.path, 1, node.depth - 1)
"""

PHRASES = f"""
WITH piece AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM words),
f AS (SELECT lang, phrase, size, count(*) AS f
  FROM (SELECT lang, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS phrase FROM starts, range(1, 6) t(size) WHERE s + size - 1 <= len(w)) u
  GROUP BY ALL HAVING count(*) >= 100),
candidate AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
inside AS (SELECT lang, a, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase
  FROM (SELECT lang, a, w, size, k, unnest(range(1, size - k + 2)) AS s FROM candidate, range(2, 5) t(k) WHERE k < size) u),
kept AS (SELECT * FROM candidate c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cut AS (SELECT kept.*, k, x.f AS l, y.f AS r, CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM kept JOIN range(1, 5) t(k) ON k < kept.size
  JOIN f x ON x.lang = kept.lang AND x.phrase = array_to_string(list_slice(w, 1, k), ' ')
  JOIN f y ON y.lang = kept.lang AND y.phrase = array_to_string(list_slice(w, k + 1, kept.size), ' ')
  JOIN total ON total.lang = kept.lang),
weakest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT x.lang, rank, phrase, a, l, r, total.n, CAST(score AS BIGINT) AS score FROM ranked x JOIN total ON total.lang = x.lang WHERE rank <= 2000
"""
