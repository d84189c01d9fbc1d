"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import quality_rules as rules

_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format(text="text")} AS ws FROM d),
win AS (SELECT r, i, array_to_string(ws[i : i + {rules.WINDOW - 1}], ' ') AS win
        FROM (SELECT r, ws, unnest(range(1, len(ws) - {rules.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {rules.WINDOW})),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({rules.WINDOW}) AS s(k) GROUP BY r),
dup AS (SELECT r, sum(c - 1) AS n FROM (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY r),
base AS (SELECT r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
        FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS f FROM j GROUP BY source),
s AS (SELECT sum(n) AS all_n, sum(f) / sum(n) AS m, count(*) AS hosts, sum(f * f / n) AS sq, sum(n * n) AS nn FROM h),
v AS (SELECT m, (sq - all_n * m * m - (hosts - 1) * m * (1 - m)) / nullif(all_n - nn / all_n, 0) AS b FROM s),
p AS (SELECT m, CASE WHEN b > 0 THEN least({rules.MAX_PRIOR_WEIGHT}, greatest(1.0, m * (1 - m) / b - 1)) ELSE {rules.MAX_PRIOR_WEIGHT} END AS k FROM v),
hv AS (SELECT source, (f + m * k) / (n + k) <= {rules.HOST_LIMIT} AS ok FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept
FROM j JOIN hv ON j.source IS NOT DISTINCT FROM hv.source
"""

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_components(source: str, width: int, percent: int) -> str:
    """CTEs (to follow WITH RECURSIVE) that end in labels(doc_id, n_shingles, component_id) of a table with doc_id, text."""
    return rf"""
jw AS (SELECT doc_id, {_WORDS.format(text=_FOLDED)} AS ws FROM {source}),
js AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {width} THEN [array_to_string(ws, ' ')]
       ELSE list_transform(range(1, len(ws) - {width - 2}), lambda i: array_to_string(ws[i : i + {width - 1}], ' ')) END) AS sh FROM jw)),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jp AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM js a JOIN js b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
jl AS (SELECT x, y FROM jp JOIN jn p ON x = p.doc_id JOIN jn q ON y = q.doc_id WHERE 100 * shared >= {percent} * (p.n + q.n - shared)),
je AS (SELECT x, y FROM jl UNION SELECT y, x FROM jl),
reach(x, y) AS (SELECT doc_id, doc_id FROM {source} UNION SELECT r.x, e.y FROM reach r JOIN je e ON r.y = e.x),
jc AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x),
labels AS (SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM {source} d LEFT JOIN jn USING (doc_id) JOIN jc USING (doc_id))"""


OP6 = f"WITH RECURSIVE {jaccard_components('documents', 3, 90)} SELECT * FROM labels"

OP10 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
       coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.e) = len(b.e)
      WHERE a.ok AND b.ok AND list_cosine_similarity(a.e, b.e) >= 0.9),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""


def _rendered(side: str, common: str, column: str) -> str:
    head = "'<|' || role || '|>' || chr(10)"
    return f"""{column} AS (SELECT conv_id, string_agg({head} || text || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS body,
  string_agg(CASE WHEN role = 'assistant' THEN (pos + length({head})) || ':' || (pos + length({head}) + length(text) + 7) END, ',' ORDER BY turn, role, text) AS mask
  FROM (SELECT *, coalesce(sum(length({head}) + length(text) + 8) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
        FROM {side} JOIN ends USING (conv_id) WHERE {common} coalesce(turn < stop, true)) GROUP BY ALL)"""


OP8 = rf"""
WITH c AS (SELECT DISTINCT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '<(\||\z)', '< \1', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS turn, max(text) AS text FROM
         (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS top FROM c WHERE role = 'assistant') WHERE turn = top GROUP BY conv_id),
r AS (SELECT DISTINCT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = l.turn THEN n.text ELSE c.text END AS text
      FROM c LEFT JOIN last l ON c.conv_id = l.conv_id LEFT JOIN last n ON n.conv_id = c.conv_id + 1
      WHERE NOT coalesce(c.role = 'assistant' AND c.turn = l.turn, false) OR n.text IS NOT NULL),
both_sides AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.turn, b.turn) AS turn, a.x IS NOT DISTINCT FROM b.x AS same
      FROM (SELECT conv_id, turn, string_agg(role || chr(0) || text, chr(0) ORDER BY role, text) AS x FROM c GROUP BY ALL) a
      FULL JOIN (SELECT conv_id, turn, string_agg(role || chr(0) || text, chr(0) ORDER BY role, text) AS x FROM r GROUP BY ALL) b ON a.conv_id = b.conv_id AND a.turn = b.turn),
ends AS (SELECT conv_id, min(turn) FILTER (NOT same) AS stop FROM both_sides GROUP BY conv_id),
pairs AS (SELECT b.conv_id, count(DISTINCT turn) FILTER (coalesce(turn < stop, true)) AS n FROM both_sides b JOIN ends USING (conv_id) GROUP BY ALL),
{_rendered("c", "", "pr")}, {_rendered("c", "NOT", "ch")}, {_rendered("r", "NOT", "rj")}
SELECT p.conv_id, p.n AS n_prefix, coalesce(pr.body, '') AS prompt, coalesce(ch.body, '') AS chosen, coalesce(ch.mask, '') AS chosen_mask,
       coalesce(rj.body, '') AS rejected, coalesce(rj.mask, '') AS rejected_mask
FROM pairs p LEFT JOIN pr USING (conv_id) LEFT JOIN ch USING (conv_id) LEFT JOIN rj USING (conv_id)
"""
