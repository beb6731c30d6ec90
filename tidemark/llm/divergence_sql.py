"""The quality rules as SQL over ``documents``."""

from __future__ import annotations

from tidemark.llm.divergence import COMMON_WORDS, Limits

LIMITS = Limits()
SYMBOLS = "#*$%&|<>"
CLASSES = ("[^a-z]", r"[^\x20\x09-\x0D]", f"[^{SYMBOLS}]", "[^A-Z]", "[^0-9]")


def _sum(lists: str, n: int) -> str:
    return "[" + ", ".join(f"sum({lists}[{i}])" for i in range(1, n + 1)) + "]"


def _distance(left: str, right: str) -> str:
    p, q = f"({left}[i] / list_sum({left}))", f"({right}[i] / list_sum({right}))"

    def part(x, y):
        return f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"

    return (f"CASE WHEN list_sum({left}) > 0 AND list_sum({right}) > 0 THEN sqrt(greatest(list_sum(list_transform("
            f"range(1, len({left}) + 1), lambda i: {part(p, q)} + {part(q, p)})), 0) / 2) END")


COUNTS = ", ".join(f"len(regexp_replace(t, '{c}', '', 'g'))" for c in CLASSES)
COMMON = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in COMMON_WORDS)

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT doc_id, lang, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)
), r AS (
  SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c >= 2
), v AS (
  SELECT doc_id, CAST(sum(least(3, coalesce(nx - i, 3))) AS BIGINT) AS n FROM r GROUP BY doc_id
), c AS (
  SELECT doc_id, lang, t, CAST(len(w) AS BIGINT) AS n_words, [{COUNTS}] AS k, [{COMMON}] AS m, len(w) AS nw,
         len(regexp_replace(t, '[^\x21-\x7E]', '', 'g')) AS visible,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM s LEFT JOIN v USING (doc_id)
), f AS (
  SELECT doc_id, lang, n_words, len(t) - k[2] AS word_chars, k[3] AS n_symbols, n_dup_lines, n_repeat_words, len(t) AS size,
         [k[1], k[2], k[3], k[4], k[5], visible - k[1] - k[3] - k[4] - k[5], len(t) - visible - k[2]] AS chars,
         list_append(m, nw - list_sum(m)) AS common,
         n_words < {LIMITS.base_min_words} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM c
), q AS (
  SELECT lang, {_sum('chars', 7)} AS ref_chars, {_sum('common', len(COMMON_WORDS) + 1)} AS ref_common
  FROM f WHERE NOT base_failed AND n_symbols <= {LIMITS.model_symbols} * n_words GROUP BY lang
), j AS (
  SELECT f.*, {_distance('chars', 'ref_chars')} AS dc, {_distance('common', 'ref_common')} AS dw
  FROM f LEFT JOIN q USING (lang)
)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (size >= {LIMITS.min_chars} AND coalesce(dc > {LIMITS.char_distance}, FALSE))
       AND NOT (n_words >= {LIMITS.min_words} AND coalesce(dw > {LIMITS.word_distance}, FALSE)) AS kept
FROM j
"""
