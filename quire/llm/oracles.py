"""DuckDB SQL that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from quire.llm import mixing, quality

WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

EXACT_DEDUP = rf"""
WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{WHITE_CLASS}', '', 'g')) AS d FROM documents),
r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS nth, count(*) OVER (PARTITION BY d) AS group_size FROM k WINDOW w AS (PARTITION BY d ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, d AS text_sha256 FROM r
"""


WARC = """
WITH d AS (SELECT page_id, coalesce(html, '') AS h FROM pages), k AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM d),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS best FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN best <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best <> page_id THEN best END AS refers_to FROM r
"""


LINE_DEDUP = rf"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, no, ls[no] AS line, list_distinct(regexp_extract_all(ls[no], '{WORD}')) AS s FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS no FROM d)),
w AS (SELECT *, row_number() OVER (ORDER BY doc_id, no) AS pos, len(s) AS n FROM l WHERE len(s) > 0),
u AS (SELECT pos, n, unnest(s) AS tok FROM w), f AS (SELECT tok, count(*) AS df FROM u GROUP BY tok),
p AS (SELECT pos, n, tok FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY df, tok) AS i FROM u JOIN f USING (tok)) WHERE i <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT a.pos AS x, b.pos AS y FROM p a JOIN p b ON a.tok = b.tok AND a.pos < b.pos AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
g AS (SELECT DISTINCT y FROM c JOIN w a ON a.pos = x JOIN w b ON b.pos = y WHERE 9 * len(list_intersect(a.s, b.s)) >= 4 * (a.n + b.n)),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.y) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (g.y IS NULL), '') AS kept
  FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.no = w.no LEFT JOIN g ON g.y = w.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN k.kept END AS text FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def quality_sql(table: str = "documents") -> str:
    """The measurements of each document, base_failed, kept and fail_bits."""
    rules = " | ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(quality.RULES.values()))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i:i + {quality.WINDOW - 1}] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {quality.WINDOW - 2})) AS i FROM w)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, sum(least({quality.WINDOW}, gap)) AS n FROM (SELECT doc_id, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {quality.WINDOW}) AS gap FROM c) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{WHITE_CLASS}', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
  (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals, (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaims
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, ({rules})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {quality.bits(quality.BASE)}) <> 0 AS base_failed, (fail_bits & {quality.bits(quality.BASE) | quality.bits(quality.POLICIES[quality.CURRENT])}) = 0 AS kept, fail_bits FROM b
"""


def mixing_sql(table: str = "documents", seed: str = "mix") -> str:
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(mixing.WEIGHTS))
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS k FROM {table}),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {weights} END AS weight, source_size * {mixing.MOST} AS cap FROM p),
c AS (SELECT *, sum(source_size) OVER () AS total, sum(cap) OVER w AS caps, sum(weight) OVER () - sum(weight) OVER w AS rest FROM o
  WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, caps * weight + cap * rest <= total * weight AS full_ FROM c),
t AS (SELECT source, source_size, CASE WHEN full_ THEN cap::DOUBLE ELSE weight * (total - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ())::DOUBLE
  / sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () END AS target FROM f),
s AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (rounds * size + least(greatest(floor(target)::BIGINT - rounds * source_size - start_, 0), size))::BIGINT AS taken FROM s
"""


def sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op2_exact_dedup": EXACT_DEDUP, "op4_warc": WARC, "op9_quality_rules": quality_sql(), "op10_mixing": mixing_sql()}
