"""SQL counterparts of the operators that SQL can express on whole tables."""

from __future__ import annotations

import string

from . import licenses, quality

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def quality_sql() -> str:
    word = "[^\\x20\\x09-\\x0D]+"
    fold = f"translate(array_to_string(regexp_extract_all(line, '{word}'), ' '), '{string.ascii_uppercase}123456789', '{string.ascii_lowercase}000000000')"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d)),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS tri FROM w),
rep AS (SELECT doc_id, tri FROM g WHERE tri IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM g JOIN rep USING (doc_id, tri), (VALUES (0), (1), (2)) v(j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, host, line, {fold} AS folded, len(regexp_extract_all(line, '{word}')) AS words FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
hosts AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
common AS (SELECT host, folded FROM (SELECT host, folded, count(DISTINCT doc_id) AS docs FROM l GROUP BY ALL) JOIN hosts USING (host) WHERE docs > {quality.LEAST} AND docs > {quality.SHARE} * host_docs),
gone AS (SELECT doc_id, sum(words) AS words, count(*) AS lines FROM l JOIN common USING (host, folded) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.lines, 0) AS BIGINT) AS n_common_lines, CAST(coalesce(n_words, 0) - coalesce(gone.words, 0) AS BIGINT) AS n_rest_words
 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_rest_words >= {quality.REST} * n_words AS kept FROM m"""


def license_sql() -> str:
    rows = []
    for t, (phrase, label) in enumerate([*licenses.BASE, *licenses.TEMPLATES]):
        w = phrase.split()
        rows += [(t, label, t < len(licenses.BASE), len(w) - licenses.GRAM + 1, at, " ".join(w[at : at + licenses.GRAM])) for at in range(len(w) - licenses.GRAM + 1)]
    values = ", ".join(f"({t}, '{label}', {str(base).lower()}, {n}, {at}, '{gram}')" for t, label, base, n, at, gram in rows)
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    return f"""WITH tmpl(template, label, is_base, n_runs, at_, gram) AS (VALUES {values}),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{pattern}') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM d),
g AS (SELECT doc_id, p, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY p) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY p) AS gram FROM w),
diagonals AS (SELECT doc_id, template, label, is_base, n_runs, p - at_ AS diagonal, count(*) AS votes, min(p) AS b, max(p) AS e, list(at_) AS held FROM g JOIN tmpl USING (gram) GROUP BY ALL),
f AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER x > {licenses.NEIGHBOUR} OR votes = n_runs OR lag(votes) OVER x = n_runs, true) AS fresh FROM diagonals WINDOW x AS (PARTITION BY doc_id, template ORDER BY diagonal)),
h AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS place FROM f),
merged AS (SELECT doc_id, template, label, is_base, n_runs, place, min(diagonal) AS diagonal, max(votes) AS votes, min(b) AS b, max(e) AS e, len(list_distinct(flatten(list(held)))) / CAST(n_runs AS DOUBLE) AS cover FROM h GROUP BY doc_id, template, label, is_base, n_runs, place),
accepted AS (SELECT *, is_base AND votes = n_runs AS exact FROM merged WHERE CASE WHEN is_base THEN votes = n_runs ELSE cover >= {licenses.COVER} END),
apart AS (SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY doc_id ORDER BY b, e, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {licenses.GRAM - 1} OR row_number() OVER (PARTITION BY doc_id ORDER BY b, e, template) = 1 THEN 1 ELSE 0 END AS x FROM accepted),
grouped AS (SELECT *, sum(x) OVER (PARTITION BY doc_id ORDER BY b, e, template) AS grp FROM apart),
best AS (SELECT *, max(cover) OVER (PARTITION BY doc_id, grp) AS top FROM grouped),
per AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(diagonal) FILTER (exact) AS first_word, max(diagonal) FILTER (exact) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (exact))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(cover) AS score, count(*) AS n_places FROM best WHERE exact OR cover = top GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score, CAST(coalesce(n_places, 0) AS BIGINT) AS n_places FROM d LEFT JOIN per USING (doc_id)"""


OP2_SQL = license_sql()
OP9_SQL = quality_sql()
