"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from evistra.llm.embedding_dedup import THRESHOLD
from evistra.llm.quality_rules import BOILERPLATE, MAX_BARS, MAX_SHOUTED, MAX_SYMBOLS, MIN_KEPT, MIN_SENTENCE, SEPARATORS, TERMINAL, WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]+"
_OTHER = r"[^#*$%&|<>]"


def _count(pattern: str, text: str) -> str:
    return f"length(regexp_replace({text}, '{pattern}', '', 'g'))"


def quality_rules(window: int = WINDOW) -> str:
    """Line rules by lists of lines and words; repeated windows by grouping a table of all windows."""
    window_words = " || chr(0) || ".join(f"words[p + {i}]" for i in range(window))
    opening, terminal = "^(?i:" + "|".join(BOILERPLATE) + ")", TERMINAL.replace("'", "''")
    bars = ", ".join(f"'{c}'" for c in SEPARATORS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS words, string_split(t, chr(10)) AS lines FROM d),
windows AS (SELECT r, p, hash({window_words}) AS h FROM (SELECT r, words, unnest(range(1, len(words) - {window - 2})) AS p FROM w)),
twice AS (SELECT r, p FROM windows QUALIFY count(*) OVER (PARTITION BY r, h) > 1),
repeated AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, range({window}) AS s(k) GROUP BY 1),
parts AS (SELECT r, line, len(ws) AS n, {_count(_OTHER, 'line')} AS symbols, {_count(_SPACE, 'line')} AS chars,
    len(list_filter(ws, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) AS shouted, len(list_filter(ws, lambda x: x IN ({bars}))) AS bars,
    contains('{terminal}', right(rtrim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    ')), 1)) AS ended
  FROM (SELECT r, line, regexp_extract_all(line, '{_WORD}') AS ws FROM (SELECT r, unnest(lines) AS line FROM w))),
good AS (SELECT r, sum(chars) AS chars FROM parts
  WHERE n = 0 OR NOT (symbols > n * CAST({MAX_SYMBOLS} AS DOUBLE) OR shouted > n * CAST({MAX_SHOUTED} AS DOUBLE)
    OR n >= {MIN_SENTENCE} AND NOT ended OR bars > n * CAST({MAX_BARS} AS DOUBLE) OR regexp_matches(ltrim(line, ' '), '{opening}')) GROUP BY 1),
base AS (SELECT w.r, doc_id, len(words) AS n_words, {_count(_SPACE, 't')} AS word_chars, {_count(_OTHER, 't')} AS n_symbols,
    len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}')))) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated ON w.r = repeated.r),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(chars, 0) >= word_chars * CAST({MIN_KEPT} AS DOUBLE) AS kept
FROM judged LEFT JOIN good ON judged.r = good.r"""


def embedding_dedup(threshold: float = THRESHOLD) -> str:
    """All pairs within a label, then what can be reached over links."""
    return f"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
sound AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM e LEFT JOIN component ON vec_id = component.a LEFT JOIN counts ON vec_id = counts.a"""


ORACLE_SQL = {"op2_quality_rules": quality_rules(), "op3_embedding_dedup": embedding_dedup()}
