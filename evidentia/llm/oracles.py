"""SQL for DuckDB that gives the rows of the queries whose operators SQL can express.

The rest (models, the encoding, the queue by a hash that DuckDB lacks, pages) is
tested against brute force instead.
"""

from __future__ import annotations

from .common import WORD
from .personal_data import EVIDENCE, GENERALISE, SUPPORT

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256 FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS meet FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM shared WHERE 100 * meet >= 90 * (na + nb - meet)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b), least_ AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, len(g)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id FROM s LEFT JOIN least_ ON a = doc_id"""

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS key FROM d, unnest(range(1, greatest(len(w) - 6, 1))) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, key) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, sum(m) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS m FROM rep) GROUP BY 1),
m AS (SELECT d.doc_id, text, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{{L}}')) AS letters FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > 0.3::DOUBLE * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines > 0.3::DOUBLE * len(string_split(text, chr(10)))
  OR len(regexp_extract_all(text, '\p{{Lu}}')) > 0.5::DOUBLE * letters OR len(regexp_extract_all(text, '!')) > 0.3::DOUBLE * n_words OR letters < 0.5::DOUBLE * word_chars OR len(list_distinct(w)) < 0.1::DOUBLE * n_words) AS kept FROM b"""

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "lower(v)", "'domain:' || lower(split_part(v, '@', 2))"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR length(ltrim(p, '0')) = 3 AND ltrim(p, '0')::INT > 255)) = 0", "v", "'network:' || array_to_string(string_split(v, '.')[1:3], '.')"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(g) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: (reverse(g)[i])::INT * (2 - i % 2) - CASE WHEN i % 2 = 0 AND (reverse(g)[i])::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0",
        "g",
        "'issuer:' || left(g, 6)",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(g) BETWEEN 9 AND 15", "g", "'block:' || left(g, length(g) - 4)"),
}


def _found(kind: str, pattern: str, rows: str = "d") -> str:
    """(doc_id, kind, start, v) of every match, in code points; the text between two matches tells where the second begins."""
    return (
        f"SELECT doc_id, '{kind}' AS kind, sum(length(p) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS start, v FROM (SELECT doc_id, generate_subscripts(h, 1) AS i, unnest(h) AS v, unnest(q[1:len(h)]) AS p "
        f"FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS h, string_split_regex(text, '{pattern}') AS q FROM {rows}) WHERE len(h) > 0)"
    )


PERSONAL_DATA = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS kind, {no} AS no, start, start + length(v) AS ending, '{k}:' || {name} AS entity, {group} AS belongs FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM ({_found(k, p)})) WHERE {ok}" for no, (k, (p, ok, name, group)) in enumerate(_KINDS.items()))}),
total AS (SELECT count(*)::DOUBLE AS n FROM d), held AS (SELECT doc_id, entity FROM f UNION SELECT doc_id, belongs FROM f),
ent AS (SELECT entity, count(*) AS n_e, log2(any_value(n) / count(*)) AS ic FROM held, total GROUP BY 1 HAVING count(*) >= {SUPPORT} AND count(*) < any_value(n) AND count(*) * log2(any_value(n) / count(*)) >= {EVIDENCE}),
w AS ({_found('term', r'\p{L}{3,}')}), t AS (SELECT lower(v) AS term, count(DISTINCT doc_id) AS n_t FROM w GROUP BY 1),
free AS (SELECT w.doc_id, w.start, w.start + length(w.v) AS ending, lower(w.v) AS term FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = w.doc_id AND f.start < w.start + length(w.v) AND w.start < f.ending)),
te AS (SELECT term, entity, count(DISTINCT held.doc_id) AS n_te FROM held SEMI JOIN ent USING (entity) JOIN free ON free.doc_id = held.doc_id GROUP BY 1, 2),
told AS (SELECT DISTINCT term FROM te JOIN ent USING (entity) JOIN t USING (term), total WHERE n_te >= {SUPPORT} AND n_te * ic >= {EVIDENCE} AND log2(n_te * n / (n_t * n_e)::DOUBLE) / ic >= {GENERALISE}),
spans AS (SELECT doc_id, kind, no, start, ending FROM f UNION ALL SELECT doc_id, 'term', 4, start, ending FROM free SEMI JOIN told USING (term)),
said AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || ending, ',' ORDER BY start, no) AS spans, string_agg(kind || ':' || start || ':' || ending, ',' ORDER BY start, no) FILTER (kind <> 'term') AS base, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)} FROM spans GROUP BY 1)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said ON said.doc_id = d.doc_id"""

ORACLES = {"op1_exact_dedup": EXACT_DEDUP, "op3_personal_data": PERSONAL_DATA, "op6_near_duplicates": NEAR_DUPLICATES, "op8_quality": QUALITY}
