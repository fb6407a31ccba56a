"""Queries by name over whole tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import script
from quire.functions import text as tx
from quire.operators import gates, geometry, memory, order, states, stats, terms
from quire.sources import blocks as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Blocks of documents in SQL: each line with text, numbered in its document.
LINES = r"""
d AS (SELECT doc_id, lang, source, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT doc_id, lang, source, unnest(ls) AS source_text, unnest(range(len(ls)))::INT AS spine_index FROM d),
b AS (SELECT *, doc_id || '#' || lpad(spine_index::VARCHAR, 5, '0') AS block_id FROM l)
"""


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def doc_blocks(spark: SparkSession, at: str) -> DataFrame:
    return src.line_blocks(table(spark, at, "documents").select("doc_id", "lang", "source", "text"))


def doc_sections(spark: SparkSession, at: str) -> DataFrame:
    """Blocks whose short lines without a sentence end open sections."""
    return order.sections(doc_blocks(spark, at), tx.looks_like_heading(F.col("source_text")))


def ledger(spark: SparkSession, at: str) -> DataFrame:
    """Events as a ledger of blocks: a job a user, states by event type, scores from values."""
    e = table(spark, at, "events")
    kinds = "array('pending','drafted','mtqe_passed','repair_pending','repaired','failed','needs_human','blocked_human')"
    return e.selectExpr(
        "user_id AS job_id", "event_id", f"{kinds}[int(event_id % 8)] AS status", "event_id % 7 = 0 AS skip_translate", "event_id % 11 = 0 AS tm_hit",
        "CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 37 % 1000) / 1000.0D END AS mtqe_score", "array('heuristic','llm_judge','tiered','comet')[int(event_id % 4)] AS mtqe_score_source",
        "filter(array(if(event_id % 3 = 0, 'omission:major', null), if(event_id % 4 = 0, 'length_ratio(3)', null), if(event_id % 10 = 0, 'untranslated', null)), x -> x is not null) AS error_flags",
    )


LEDGER = """
k AS (SELECT user_id AS job_id, event_id, ['pending','drafted','mtqe_passed','repair_pending','repaired','failed','needs_human','blocked_human'][event_id % 8 + 1] AS status,
  event_id % 7 = 0 AS skip_translate, event_id % 11 = 0 AS tm_hit, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id * 37 % 1000) / 1000.0::DOUBLE END AS mtqe_score,
  ['heuristic','llm_judge','tiered','comet'][event_id % 4 + 1] AS mtqe_score_source,
  list_filter([CASE WHEN event_id % 3 = 0 THEN 'omission:major' END, CASE WHEN event_id % 4 = 0 THEN 'length_ratio(3)' END, CASE WHEN event_id % 10 = 0 THEN 'untranslated' END], lambda x: x IS NOT NULL) AS error_flags FROM events),
s AS (SELECT *, mtqe_score IS NOT NULL AND NOT skip_translate AND (NOT tm_hit OR mtqe_score_source IN ('llm_judge','tiered')) AND mtqe_score_source NOT IN ('heuristic','mock','tm','skip') AS scored FROM k)
"""


def jobs(spark: SparkSession, at: str) -> DataFrame:
    """Orders as a queue of jobs: a tenant a customer."""
    return table(spark, at, "orders").selectExpr(
        "o_orderkey AS job_id", "o_custkey AS tenant_id", "int(substring(o_orderpriority, 1, 1)) AS priority", "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status",
        "unix_timestamp(o_orderdate) AS enqueued_at", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE unix_timestamp(o_orderdate) + o_orderkey % 5000 END AS finished_at",
        "unix_timestamp(o_orderdate) + o_orderkey % 900 AS lease_expires_at", "int(o_orderkey % 4) AS attempts", "3 AS max_attempts", "o_orderkey % 13 = 0 AS cancel_requested",
    )


JOBS = """
j AS (SELECT o_orderkey AS job_id, o_custkey AS tenant_id, substr(o_orderpriority, 1, 1)::INT AS priority, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'completed' END AS status,
  epoch(o_orderdate)::BIGINT AS enqueued_at, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch(o_orderdate)::BIGINT + o_orderkey % 5000 END AS finished_at,
  epoch(o_orderdate)::BIGINT + o_orderkey % 900 AS lease_expires_at, (o_orderkey % 4)::INT AS attempts, 3 AS max_attempts, o_orderkey % 13 = 0 AS cancel_requested FROM orders)
"""

#: A small glossary over the tables' invented words.
GLOSSARY = [
    ("the", "el", "global", 5, 10, ["le"]), ("The", "la", "chapter", 1, 3, []), ("tion", "ción", "global", 2, 7, []), ("und", "y", "global", 3, 9, []), ("und", "e", "domain", 3, 2, ["et"]),
    ("heed", "atento", "global", 1, 1, []), ("der", "el", "global", 1, 4, []), ("que", "which", "section", 4, 4, []), ("que", "that", "global", 9, 9, []), ("benchmark", "referencia", "global", 1, 1, []),
]
GLOSSARY_SQL = "g(source, translation, scope, priority, frequency) AS (VALUES " + ", ".join(f"('{s}', '{t}', '{c}', {p}, {f})" for s, t, c, p, f, _ in GLOSSARY) + ")"


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GLOSSARY, "source string, translation string, scope string, priority int, frequency int, aliases array<string>")


@query(f"WITH {LINES} SELECT doc_id, spine_index, block_id, source_text FROM b")
def blocks_from_documents(spark, at):
    return doc_blocks(spark, at).select("doc_id", "spine_index", "block_id", "source_text")


#: Lines of every kind, and which of the tests below they pass: page number, Markdown heading, list item, bullet, heading, archive marker.
_KINDS = [
    ("17", 1, 0, 0, 0, 1, 0), ("xiv", 1, 0, 0, 0, 1, 0), ("12345", 0, 0, 0, 0, 1, 0), ("## Part two", 0, 1, 0, 0, 1, 0), ("####### seven", 0, 0, 0, 0, 1, 0), ("- item", 0, 0, 1, 1, 0, 0), ("12) item", 0, 0, 1, 0, 1, 0),
    ("• point", 0, 0, 0, 1, 0, 0), ("A title", 0, 0, 0, 0, 1, 0), ("A sentence.", 0, 0, 0, 0, 0, 0), ("[Illustration: a map]", 0, 0, 0, 0, 1, 1), ("[illustrated]", 0, 0, 0, 0, 1, 0), ("word " * 20, 0, 0, 0, 0, 0, 0),
]
_KIND_NAMES = ("page_numbers", "md_headings", "list_items", "bullets", "headings", "gutenberg")


@query(f"""WITH k(i, {", ".join(_KIND_NAMES)}) AS (VALUES {", ".join(f"({i}, {', '.join(map(str, k[1:]))})" for i, k in enumerate(_KINDS))})
SELECT event_type, {", ".join(f"sum({n})::BIGINT AS {n}" for n in _KIND_NAMES)} FROM events JOIN k ON event_id % {len(_KINDS)} = i GROUP BY event_type""")
def line_kinds(spark, at):
    s = F.col("s")
    tests = (tx.is_bare_page_number(s), tx.markdown_heading(s)["level"] > 0, tx.markdown_list_item(s)["marker"] != "", tx.is_list_prefix(s), tx.looks_like_heading(s), tx.is_gutenberg_marker(s))
    line = F.element_at(F.array(*[F.lit(k[0].strip()) for k in _KINDS]), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    rows = table(spark, at, "events").select("event_type", line.alias("s"))
    return rows.groupBy("event_type").agg(*[F.count_if(c).alias(n) for n, c in zip(_KIND_NAMES, tests, strict=True)])


#: Blocks that are kept, by their verdict; lines of documents stand between them.
_KEPT = [
    ("— … 。", "placeholder"), ("https://example.org/a?b=1", "identifier_only"), ("doi: 10.1000/182", "identifier_only"), ("978-0-306-40615-7", "identifier_only"), ("0306406152", "identifier_only"), ("0a 1B " * 20, "hexdump"),
    ("0a 1b " * 15, "translate"), ("0a 1B " * 20 + "word or " * 20, "translate"), ("\n".join(f"term{k}" for k in range(12)), "index_list"), ("\n".join(["Ünze"] * 11 + ["two words"]), "index_list"), ("\n".join(["term"] * 11), "translate"), ("  ", "empty"),
]


@query(rf"""WITH {LINES}, k(i, t, verdict) AS (VALUES {", ".join("(%d, '%s', 'verdict:%s')" % (i, t, v) for i, (t, v) in enumerate(_KEPT))}), m AS (SELECT lang, (spine_index + doc_id) % {2 * len(_KEPT)} AS i, source_text FROM b),
v AS (SELECT lang, coalesce(t, source_text) AS t, coalesce(verdict, CASE WHEN regexp_matches(source_text, '[\p{{L}}\p{{N}}_]') THEN 'verdict:translate' ELSE 'verdict:placeholder' END) AS verdict FROM m LEFT JOIN k USING (i))
SELECT lang, verdict, count(*) AS n, sum(length(t))::BIGINT AS chars FROM v GROUP BY lang, verdict""")
def block_verdict(spark, at):
    """Lines of documents, every other one replaced by a block that some rule keeps, or nearly keeps."""
    i = (F.col("spine_index") + F.col("doc_id")) % (2 * len(_KEPT))
    text = F.when(i < len(_KEPT), F.element_at(F.array(*[F.lit(t) for t, _ in _KEPT]), (i % len(_KEPT) + 1).cast("int"))).otherwise(F.col("source_text"))
    rows = doc_blocks(spark, at).select("lang", text.alias("t")).select("lang", "t", tx.verdict(F.col("t")).alias("verdict"))
    return rows.groupBy("lang", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars"))


_COUNT = lambda p: f"len(regexp_extract_all(t, '{p}'))"
_SOLID = _COUNT(r"[^\s]")


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, " + ", ".join(f"CASE WHEN {_SOLID} > 0 THEN {_COUNT(script.SCRIPTS[s])} / {_SOLID}::DOUBLE ELSE 0 END AS {s}" for s in ("han", "latin", "cyrillic", "arabic")) + " FROM d")
def script_ratios(spark, at):
    t = F.coalesce("text", F.lit(""))
    return table(spark, at, "documents").select("doc_id", *[script.share(t, s).alias(s) for s in ("han", "latin", "cyrillic", "arabic")])


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, length(t) AS n, {_COUNT(r"[\x00-\x7F]")} AS a, {_COUNT(script.WIDE)} AS w FROM d)
SELECT doc_id, (a // 4 + ceil(w * 0.85) + ceil((n - a - w) * 0.31))::BIGINT AS tokens FROM c""")
def token_estimate(spark, at):
    return table(spark, at, "documents").select("doc_id", script.token_count(F.col("text")).alias("tokens"))


#: What is added to texts, by their id, so that every density occurs.
_MATHS = ["", " Set x = 5 and y_2.", " a_1 ∑" * 9, r" \frac{1}{2} of 3 cm 2 and Theorem 4.1", " Δ" * 40, " 1 - 10 15"]


@query("WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN left(coalesce(text, ''), 300) ELSE coalesce(text, '') END || [" + ", ".join(f"'{m}'" for m in _MATHS) + f"][doc_id % {len(_MATHS)} + 1] AS x FROM documents), u AS (SELECT doc_id, length(x) AS n, regexp_replace(x, '[À-ɏ]', '__', 'g') AS t FROM d), h AS (SELECT doc_id, " + " + ".join(_COUNT(f"(?i){p}") for p in script.MATH) + """ AS hits, n FROM u)
SELECT doc_id, CASE WHEN hits * 1000.0 / greatest(n, 1) >= 2 OR (hits >= 6 AND hits * 1000.0 / greatest(n, 1) >= 0.5) THEN 'high' WHEN hits * 1000.0 / greatest(n, 1) >= 0.5 OR hits >= 2 THEN 'low' ELSE 'none' END AS density FROM h""")
def math_density(spark, at):
    """Texts, every fifth one's opening, with mathematics added."""
    text = F.coalesce("text", F.lit(""))
    added = F.element_at(F.array(*[F.lit(m) for m in _MATHS]), (F.col("doc_id") % len(_MATHS) + 1).cast("int"))
    return table(spark, at, "documents").select("doc_id", script.math_density(F.concat(F.when(F.col("doc_id") % 5 == 0, F.left(text, F.lit(300))).otherwise(text), added)).alias("density"))


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, {_COUNT('https?://[^ )>]+')}::INT AS urls, {_COUNT('[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+')}::INT AS emails, {_COUNT('[0-9]+([.,][0-9]+)*')}::INT AS numbers FROM d""")
def url_email_counts(spark, at):
    count = lambda p: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p))
    return table(spark, at, "documents").select("doc_id", count("https?://[^ )>]+").alias("urls"), count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+").alias("emails"), count(r"[0-9]+([.,][0-9]+)*").alias("numbers"))


@query(f"""WITH {LINES} SELECT block_id, right(coalesce(string_agg(source_text, chr(10)) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ''), 300) AS tail_before,
  left(coalesce(string_agg(source_text, chr(10)) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), ''), 300) AS head_after FROM b""")
def neighbour_context(spark, at):
    return order.neighbours(doc_blocks(spark, at)).select("block_id", "tail_before", "head_after")


_HEADING = "length(source_text) < 80 AND NOT regexp_matches(source_text, '[.!?。]$') AND NOT regexp_matches(source_text, '^[•\\-*·–]')"


@query(rf"""WITH {LINES}, o AS (SELECT *, {_HEADING} AS op FROM b)
SELECT block_id, sum(op::INT) OVER w::BIGINT AS section, last_value(CASE WHEN op THEN source_text END IGNORE NULLS) OVER w AS heading FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY spine_index ROWS UNBOUNDED PRECEDING)""")
def section_tree(spark, at):
    return doc_sections(spark, at).select("block_id", "section", "heading")


@query(rf"""WITH {LINES}, e AS (SELECT *, regexp_matches(source_text, '[0-9]') AS entry, {_HEADING} AS head FROM b),
s AS (SELECT *, coalesce(max(entry::INT) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 0) = 1 AS soon FROM e),
v AS (SELECT *, CASE WHEN head AND soon THEN true WHEN head AND NOT soon THEN false WHEN NOT head AND NOT entry AND NOT soon THEN false END AS ev FROM s)
SELECT block_id, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS UNBOUNDED PRECEDING), false) AS in_bibliography FROM v""")
def bibliography_state(spark, at):
    s = F.col("source_text")
    return order.bibliography_state(doc_blocks(spark, at), s.rlike("[0-9]"), tx.looks_like_heading(s), F.lit(True)).select("block_id", "in_bibliography")


@query(rf"""WITH {LINES}, p AS (SELECT *, CASE WHEN {_HEADING} THEN 'heading' ELSE 'paragraph' END AS block_type FROM b),
m AS (SELECT *, NOT coalesce(lag(block_type) OVER w = 'paragraph' AND block_type = 'paragraph' AND NOT regexp_matches(lag(source_text) OVER w, '[.!?。！？:;"”)]$') AND regexp_matches(source_text, '^[\p{{Ll}}㐀-鿿]'), false) AS nw FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY spine_index)),
i AS (SELECT *, sum(nw::INT) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(spine_index) AS spine_index, count(*)::INT AS n_parts FROM i GROUP BY doc_id, island""")
def continuation_islands(spark, at):
    kind = F.when(tx.looks_like_heading(F.col("source_text")), "heading").otherwise("paragraph")
    return order.fuse_continuations(doc_blocks(spark, at).withColumn("block_type", kind)).select("doc_id", "spine_index", "n_parts")


@query(f"""WITH {LINES}, t AS (SELECT *, sum(length(source_text)) OVER (PARTITION BY doc_id ORDER BY spine_index DESC ROWS UNBOUNDED PRECEDING) AS c FROM b) SELECT doc_id, count(*) AS n, min(spine_index) AS first_index FROM t WHERE c <= 3000 GROUP BY doc_id""")
def running_char_budget(spark, at):
    return order.tail_budget(doc_blocks(spark, at)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("spine_index").alias("first_index"))


@query(f"""WITH {LINES}, n AS (SELECT regexp_replace(source_text, '\\s+', ' ', 'g') AS k, block_id, doc_id, spine_index FROM b)
SELECT sha256(k) AS src_hash, count(*) AS copies, count(DISTINCT doc_id) AS docs FROM n GROUP BY k HAVING count(*) > 1""")
def exact_duplicates(spark, at):
    rows = doc_blocks(spark, at).select("doc_id", tx.tm_hash(F.col("source_text")).alias("src_hash"))
    return rows.groupBy("src_hash").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("doc_id").alias("docs")).filter("copies > 1")


_MEMORY = """m AS (SELECT item_id, unnest(string_split(text, chr(10))) AS src_text, unnest(range(len(string_split(text, chr(10))))) AS line FROM benchmark UNION ALL SELECT doc_id + 1000000, unnest(string_split(text, chr(10))), unnest(range(len(string_split(text, chr(10))))) FROM documents), v(k) AS (VALUES (0), (1), (2), (3), (4)),
mm AS (SELECT (item_id * 100000 + line) * 10 + k AS id, src_text, CASE WHEN k = 4 THEN upper(left(src_text, 1)) || substr(src_text, 2) ELSE '→ ' || src_text END AS tgt_text, CASE WHEN k = 0 AND item_id % 3 = 0 THEN 'human_pe' ELSE 'machine' END AS provenance,
  ['', 'c1', 'c2', 'c9', ''][k + 1] AS context_hash, CASE WHEN k = 3 OR item_id % 4 = 0 THEN 'law' ELSE 'tech' END AS domain FROM m, v WHERE src_text <> '' AND (k <> 0 OR item_id % 3 < 2))"""


def tm(spark, at):
    """The lines of benchmark and documents as a memory: of each five rows in several contexts and domains, one of which only carries the line over."""
    lines = table(spark, at, "benchmark").select("item_id", "text").unionAll(table(spark, at, "documents").select(F.col("doc_id") + 1000000, "text"))
    lines = lines.select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "src_text")).filter("src_text <> ''")
    rows = lines.select("item_id", "line", "src_text", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).filter("k <> 0 or item_id % 3 < 2")
    return rows.selectExpr(
        "(item_id * 100000 + line) * 10 + k AS id", "src_text", "CASE WHEN k = 4 THEN concat(upper(left(src_text, 1)), substr(src_text, 2)) ELSE concat('→ ', src_text) END AS tgt_text",
        "CASE WHEN k = 0 AND item_id % 3 = 0 THEN 'human_pe' ELSE 'machine' END AS provenance", "array('', 'c1', 'c2', 'c9', '')[k] AS context_hash", "CASE WHEN k = 3 OR item_id % 4 = 0 THEN 'law' ELSE 'tech' END AS domain",
    )


@query(rf"""WITH {LINES}, {_MEMORY}, q AS (SELECT block_id, regexp_replace(source_text, '\s+', ' ', 'g') AS k, ['c1', 'c2', ''][doc_id % 3 + 1] AS c, CASE WHEN doc_id % 2 = 0 THEN 'law' END AS d FROM b),
r AS (SELECT block_id, mm.id, row_number() OVER (PARTITION BY block_id ORDER BY provenance = 'human_pe' DESC, context_hash = c DESC, coalesce(domain = d, false) DESC, mm.id DESC) AS n FROM q JOIN mm ON regexp_replace(src_text, '\s+', ' ', 'g') = k
  WHERE CASE WHEN provenance = 'human_pe' THEN src_text <> tgt_text ELSE lower(src_text) <> lower(tgt_text) END AND (provenance = 'human_pe' OR context_hash = c OR context_hash = '' OR coalesce(domain = d, false)))
SELECT block_id, id AS tm_id FROM r WHERE n = 1""")
def tm_exact_hits(spark, at):
    """Blocks by document in three contexts, every other one in a domain."""
    context, domain = F.element_at(F.array(F.lit("c1"), F.lit("c2"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int")), F.when(F.col("doc_id") % 2 == 0, "law")
    return memory.lookup_exact(doc_blocks(spark, at), tm(spark, at), context=context, domain=domain).filter("tm_id is not null").select("block_id", "tm_id")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(f) - 2, 1) + 1), lambda k: substr(f, k, 3)))"


@query(rf"""WITH q AS (SELECT item_id AS query, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS f FROM benchmark), c AS (SELECT doc_id AS candidate, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS f FROM documents),
qs AS (SELECT query, f, unnest(range(1, greatest(length(f) - 2, 1) + 1)) AS k FROM q), cs AS (SELECT candidate, f, unnest(range(1, greatest(length(f) - 2, 1) + 1)) AS k FROM c),
qg AS (SELECT query, g FROM (SELECT query, substr(f, k, 3) AS g, min(k) AS k FROM qs GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query ORDER BY k) <= 64),
cg AS (SELECT DISTINCT candidate, substr(f, k, 3) AS g FROM cs),
p AS (SELECT query, candidate, count(*) AS shared FROM qg JOIN cg USING (g) GROUP BY ALL)
SELECT query, candidate, shared FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, candidate) <= 20""")
def trigram_candidates(spark, at):
    return memory.trigram_candidates(table(spark, at, "benchmark"), table(spark, at, "documents"), "item_id", "text", "doc_id", "text", most=20)


@query()
def tm_fuzzy_hits(spark, at):
    return memory.lookup_fuzzy(table(spark, at, "benchmark"), doc_blocks(spark, at), "item_id", "text", "block_id", "source_text", least=0.6)


@query(f"""WITH {_MEMORY}, a AS (SELECT sha256(trim(regexp_replace(src_text, '\\s+', ' ', 'g'))) AS src_hash, min(id) AS id FROM mm GROUP BY 1), n AS (SELECT *, id % 3 = 0 AS human FROM a)
SELECT src_hash, CASE WHEN human AND id % 2 = 1 THEN 'old' WHEN id % 2 = 1 THEN 'new' ELSE 'old' END AS tgt_text FROM n""")
def tm_upsert_state(spark, at):
    rows = tm(spark, at).groupBy(tx.tm_hash(F.col("src_text")).alias("src_hash")).agg(F.min("id").alias("id"))
    old = rows.select("src_hash", F.lit("").alias("context_hash"), "id", F.lit("old").alias("tgt_text"), F.when(F.col("id") % 3 == 0, "human_pe").otherwise("machine").alias("provenance"), F.lit(1).alias("use_count"))
    new = rows.filter("id % 2 = 1").select("src_hash", F.lit("").alias("context_hash"), "id", F.lit("new").alias("tgt_text"), F.lit("machine").alias("provenance"))
    return memory.write_back(old, new).select("src_hash", "tgt_text")


@query(f"""WITH {LINES}, t AS (SELECT source, count(DISTINCT doc_id) AS total FROM b GROUP BY source), n AS (SELECT source, source_text, count(DISTINCT doc_id) AS n_docs FROM b GROUP BY ALL)
SELECT n.source, source_text, n_docs FROM n JOIN t ON n.source = t.source WHERE n_docs >= greatest(3, total * 0.05)""")
def boilerplate_lines(spark, at):
    return order.boilerplate(doc_blocks(spark, at), "source", share=0.05)


#: The glossary's terms are single words here, so the words of lines are counted once and joined with them.
_HITS = rf"""{LINES}, {GLOSSARY_SQL}, w AS (SELECT block_id, spine_index, unnest(regexp_extract_all(lower(source_text), '[\p{{L}}\p{{N}}_]+')) AS w FROM b), c AS (SELECT block_id, spine_index, w, count(*) AS n FROM w GROUP BY ALL),
h AS (SELECT DISTINCT block_id, spine_index, g.source AS term, n FROM c JOIN g ON c.w = lower(g.source))"""


@query(f"WITH {_HITS} SELECT DISTINCT block_id, term AS source, n::INT AS n FROM h WHERE n > 0")
def glossary_containment(spark, at):
    return terms.containment(doc_blocks(spark, at), glossary(spark).select("source").distinct(), keys=("block_id",))


@query(f"WITH {_HITS}, e AS (SELECT DISTINCT block_id, term, n, spine_index % 2 = 0 AS exact FROM h WHERE n > 0) SELECT term AS source, count(*) AS occ, count(*) FILTER (WHERE exact) AS exact, 1 - count(*) FILTER (WHERE exact) / count(*)::DOUBLE AS drift_rate FROM e GROUP BY term HAVING NOT bool_and(exact)")
def drift_summary(spark, at):
    hits = terms.containment(doc_blocks(spark, at), glossary(spark).select("source").distinct(), keys=("block_id", "spine_index")).withColumn("exact", F.col("spine_index") % 2 == 0)
    return terms.drift_summary(hits).drop("blocks")


@query(f"WITH {_HITS}, e AS (SELECT DISTINCT block_id, term, spine_index % 2 = 0 AS exact, spine_index % 3 > 0 AS fuzzy FROM h WHERE n > 0) SELECT avg(exact::INT) AS precision, avg(fuzzy::INT) AS fuzzy_precision, count(DISTINCT term) AS expected, count(DISTINCT CASE WHEN exact THEN term END) AS rendered FROM e")
def term_metrics(spark, at):
    hits = terms.containment(doc_blocks(spark, at), glossary(spark).select("source").distinct(), keys=("block_id", "spine_index"))
    return terms.term_metrics(hits.withColumns({"exact": F.col("spine_index") % 2 == 0, "fuzzy": F.col("spine_index") % 3 > 0}))


@query(f"WITH {GLOSSARY_SQL} SELECT lower(source) AS term, array_to_string(list_sort(list(DISTINCT translation)), ',') AS translations FROM g GROUP BY 1 HAVING count(DISTINCT translation) > 1")
def glossary_conflicts(spark, at):
    return terms.conflicts(glossary(spark)).withColumn("translations", F.array_join("translations", ","))


@query(f"""WITH {GLOSSARY_SQL} SELECT lower(source) AS term, translation, scope FROM g QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY list_position(['block','section','chapter','domain','global'], scope), priority DESC, frequency DESC, translation) = 1""")
def scope_winner(spark, at):
    return terms.arbitrate(glossary(spark)).select(F.lower("source").alias("term"), "translation", "scope")


@query(f"WITH {GLOSSARY_SQL} SELECT lower(source) AS term, scope, max(frequency) AS frequency, max(priority) AS priority, arg_max(translation, frequency) AS translation FROM g GROUP BY ALL")
def merged_glossary(spark, at):
    return terms.merge_entries(glossary(spark)).select("term", "scope", "frequency", "priority", "translation")


@query(f"""WITH {LEDGER}, r AS (SELECT job_id, mtqe_score, row_number() OVER (PARTITION BY job_id ORDER BY mtqe_score) AS n, count(*) OVER (PARTITION BY job_id) AS c FROM s WHERE scored),
lo AS (SELECT job_id, avg(mtqe_score) AS m FROM r WHERE n <= greatest(1, floor(c * 0.15)) GROUP BY job_id)
SELECT s.job_id, count(*) AS total_all, count(*) FILTER (WHERE skip_translate) AS skipped, count(*) FILTER (WHERE NOT skip_translate) AS total, count(*) FILTER (WHERE status IN ('mtqe_passed','repaired') AND NOT skip_translate) AS completed,
  {", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("drafted", "repair_pending", "repaired", "failed", "needs_human", "blocked_human"))}, count(*) FILTER (WHERE scored) AS scored,
  coalesce(avg(CASE WHEN scored THEN mtqe_score END), 0) AS avg_qe_score, avg(CASE WHEN scored THEN mtqe_score END) IS NOT NULL AS qe_measured, coalesce(any_value(m), 0) AS bottom_15_avg_qe
FROM s LEFT JOIN lo ON s.job_id = lo.job_id GROUP BY s.job_id""")
def job_stats(spark, at):
    return stats.job_stats(ledger(spark, at))


@query(f"""WITH {LEDGER} SELECT status, count(mtqe_score) AS n, avg(mtqe_score) AS mean, min(mtqe_score) AS low, max(mtqe_score) AS high, quantile_cont(mtqe_score, 0.1) AS p10, quantile_cont(mtqe_score, 0.5) AS p50, quantile_cont(mtqe_score, 0.9) AS p90,
  coalesce(count(*) FILTER (WHERE mtqe_score >= 0.7) / nullif(count(mtqe_score), 0)::DOUBLE, 1) AS pass_rate FROM k GROUP BY status""".replace("k GROUP", "s GROUP"))
def score_percentiles(spark, at):
    return stats.quality_report(ledger(spark, at), "status")


@query(f"WITH {LEDGER} SELECT regexp_replace(f, '[(:].*$', '') AS flag, count(*) AS n FROM (SELECT unnest(error_flags) AS f FROM s) GROUP BY 1")
def flag_histogram(spark, at):
    return stats.flag_histogram(ledger(spark, at))


@query("""WITH b AS (SELECT event_type AS name, avg(value) AS base FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT event_type AS name, avg(value) AS now FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT coalesce(b.name, n.name) AS name, base, now, CASE WHEN base IS NULL THEN 'new' WHEN now IS NULL THEN 'missing' WHEN now - base > 0.5 THEN 'better' WHEN now - base < -0.5 THEN 'worse' ELSE 'same' END AS verdict FROM b FULL JOIN n ON b.name = n.name""")
def kpi_compare(spark, at):
    e = table(spark, at, "events")
    side = lambda k: e.filter(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("name")).agg(F.avg("value").alias("value"))
    return stats.compare_kpis(side(0), side(1), e.select(F.col("event_type").alias("name")).distinct().withColumns({"direction": F.lit(1), "tolerance": F.lit(0.5)}))


@query("""WITH b AS (SELECT l_suppkey AS k, avg(l_discount) AS before FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), n AS (SELECT l_suppkey AS k, avg(l_discount) AS after FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
SELECT coalesce(b.k, n.k) AS case_id, CASE WHEN before IS NULL THEN 'NEW' WHEN after IS NULL THEN 'MISSING' WHEN after - before < -0.001 THEN 'REGRESSED' WHEN after - before > 0.001 THEN 'IMPROVED' ELSE 'STABLE' END AS drift FROM b FULL JOIN n ON b.k = n.k""")
def benchmark_drift(spark, at):
    li = table(spark, at, "lineitem")
    side = lambda k: li.filter(F.col("l_linenumber") % 2 == k).groupBy(F.col("l_suppkey").alias("case_id")).agg(F.avg("l_discount").alias("v"))
    return stats.benchmark_drift(side(0), side(1), "case_id", "v", 0.001).select("case_id", "drift")


@query("SELECT p_partkey, p_size, p_retailprice FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice < p.p_retailprice))")
def pareto_frontier(spark, at):
    return stats.pareto_frontier(table(spark, at, "part"), "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


PRICES = [("gen", 1.0, 3.0, 0.25), ("gen-large", 5.0, 15.0, 1.0), ("fast", 0.2, 0.6, 0.05)]


@query("""WITH u AS (SELECT user_id, ['gen-small','gen-large-2','fast-1','unknown'][event_id % 4 + 1] AS model, event_id % 500 AS p, event_id % 200 AS c, event_id % 100 AS k FROM events),
pr(pre, i, o, ci) AS (VALUES ('gen', 1.0::DOUBLE, 3.0::DOUBLE, 0.25::DOUBLE), ('gen-large', 5.0, 15.0, 1.0), ('fast', 0.2, 0.6, 0.05)),
b AS (SELECT u.*, (SELECT arg_max((i, o, ci), length(pre)) FROM pr WHERE starts_with(u.model, pre)) AS x FROM u)
SELECT user_id, CASE WHEN NOT bool_or(x IS NULL AND p + c > 0) THEN sum(((p - k) * x[1] + k * x[3] + c * x[2]) / 1e6) END AS cost_usd, least(coalesce(sum(k) / nullif(sum(p), 0)::DOUBLE, 0), 1) AS cache_hit_rate FROM b GROUP BY user_id""")
def price_cost(spark, at):
    usage = table(spark, at, "events").selectExpr("user_id", "array('gen-small','gen-large-2','fast-1','unknown')[int(event_id % 4)] AS model", "event_id % 500 AS prompt_tokens", "event_id % 200 AS completion_tokens", "event_id % 100 AS cached_tokens", "0 AS unmeasured_calls")
    return stats.usage_cost(usage, spark.createDataFrame(PRICES, "model_prefix string, input double, output double, cached_input double"), "user_id")


#: Blocks by number: type, what is added to the line, and its display and inline formulas and macros.
_HARD = [
    ("heading", "", 0, 0, 0), ("narrative", "", 0, 0, 0), ("table", " $a$ and $b$", 0, 2, 0), ("formula", r" \frac \sum \alpha", 0, 0, 3), ("code", " def f(x): return {}; y = x != 2", 0, 0, 0),
    ("list_item", r" $$x$$ \[y\]", 2, 1, 0), ("paragraph", " class if else for (a) (b) (c) -> => :: {} [] ; ; ; ;", 0, 0, 0),
]


@query(rf"""WITH {LINES}, k(i, kind, added, display, inline_, macros) AS (VALUES {", ".join(f"({i}, '{k}', '{a}', {d}, {n}, {m})" for i, (k, a, d, n, m) in enumerate(_HARD))}),
t AS (SELECT kind, display, inline_, macros, replace(CASE WHEN spine_index % 2 = 0 THEN left(source_text, 30) ELSE source_text END, '$', '') || added AS t FROM b JOIN k ON (spine_index + doc_id) % {len(_HARD)} = i),
f AS (SELECT *, least(len(regexp_extract_all(t, '{script.CODE_WORDS}')) * 0.08 + len(regexp_extract_all(t, '{script.CODE_SIGNS}')) * 0.03, 1.0)::DOUBLE AS syntax FROM t),
s AS (SELECT kind, t, display, inline_, CASE kind WHEN 'heading' THEN 0.05 WHEN 'table' THEN 0.5 WHEN 'code' THEN 0.65 WHEN 'formula' THEN 0.85 ELSE 0.2 END::DOUBLE + least(display * 0.2, 0.35) + least(inline_ * 0.08, 0.25) + least(macros * 0.03, 0.2)
  + CASE WHEN kind = 'code' OR syntax >= 0.35 THEN least(syntax * 0.35, 0.3) ELSE 0 END + least((length(t) - length(replace(t, ';', ''))) * 0.04 + (length(t) - length(replace(t, '(', ''))) * 0.02, 0.2) + CASE WHEN len(regexp_extract_all(t, '\S+')) > 35 THEN 0.05 ELSE 0 END AS s FROM f),
v AS (SELECT kind, round(least(CASE WHEN length(trim(t)) < 45 AND display + inline_ = 0 AND kind = 'narrative' THEN greatest(0.05, s * 0.4) ELSE s END, 1), 4) AS s FROM s)
SELECT kind, CASE WHEN s < 0.15 THEN 'trivial' WHEN s < 0.55 THEN 'standard' WHEN s < 0.8 THEN 'complex' ELSE 'extreme' END AS tier, count(*) AS n FROM v GROUP BY ALL""")
def routing_tiers(spark, at):
    """Lines as blocks of every type, every other one short, with mathematics and code added."""
    i = ((F.col("spine_index") + F.col("doc_id")) % len(_HARD) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(h[k]) for h in _HARD]), i)
    text = F.concat(F.replace(F.when(F.col("spine_index") % 2 == 0, F.left("source_text", F.lit(30))).otherwise(F.col("source_text")), F.lit("$"), F.lit("")), pick(1))
    rows = doc_blocks(spark, at).select(pick(0).alias("kind"), text.alias("t")).select("kind", script.complexity_tier(script.complexity(F.col("t"), F.col("kind"))).alias("tier"))
    return rows.groupBy("kind", "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {JOBS}, r AS (SELECT tenant_id, count(*) AS run FROM j WHERE status = 'running' GROUP BY 1),
q AS (SELECT j.*, coalesce(run, 0) AS run, row_number() OVER (PARTITION BY j.tenant_id ORDER BY priority DESC, enqueued_at, job_id) AS own FROM j LEFT JOIN r ON j.tenant_id = r.tenant_id WHERE status = 'queued'),
p AS (SELECT *, row_number() OVER (ORDER BY priority DESC, enqueued_at, job_id)::INT AS place FROM q WHERE own + run <= 2) SELECT job_id, tenant_id, place FROM p WHERE place + (SELECT count(*) FROM j WHERE status = 'running') <= 1000000""")
def queue_claim_order(spark, at):
    return states.claim_order(jobs(spark, at), cap=1_000_000)


@query(f"WITH {JOBS} SELECT tenant_id, status, count(*) AS n FROM j GROUP BY ALL")
def tenant_depth(spark, at):
    return jobs(spark, at).groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {JOBS} SELECT job_id, rank() OVER (ORDER BY priority DESC, enqueued_at)::INT AS position FROM j WHERE status = 'queued'")
def queue_position(spark, at):
    return states.queue_position(jobs(spark, at))


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN status = 'running' AND lease_expires_at < 850000000 THEN CASE WHEN cancel_requested THEN 'cancelled' WHEN attempts >= max_attempts THEN 'failed' ELSE 'queued' END ELSE status END AS status FROM j")
def lease_reclaim(spark, at):
    return states.reclaim(jobs(spark, at), 850_000_000).select("job_id", "status")


@query(f"WITH {JOBS}, t AS (SELECT job_id, status, row_number() OVER (PARTITION BY status = 'completed' ORDER BY coalesce(finished_at, enqueued_at) DESC, job_id) AS n FROM j) SELECT job_id, status FROM t WHERE status <> 'completed' OR n <= 100")
def prune_terminal(spark, at):
    return states.prune_terminal(jobs(spark, at), 100).select("job_id", "status")


@query()
def token_bucket(spark, at):
    e = table(spark, at, "events").select("event_id", "user_id", F.unix_timestamp("ts").cast("double").alias("at"), (F.col("event_id") % 5 + 1).cast("double").alias("need"))
    return states.token_bucket(e, "user_id", "at", "need", rate=0.001, burst=10.0).select("event_id", "granted")


@query(f"WITH {LINES} SELECT block_id, source_text FROM b WHERE (spine_index, block_id) > (2, '5#00002') ORDER BY spine_index, block_id LIMIT 50")
def keyset_page(spark, at):
    return order.keyset_page(doc_blocks(spark, at), (2, "5#00002"), 50).select("block_id", "source_text")


@query(f"WITH {LINES} SELECT block_id FROM b WHERE doc_id > 3 ORDER BY spine_index, doc_id OFFSET 80 LIMIT 40")
def paged_segments(spark, at):
    return order.page_of(doc_blocks(spark, at).filter("doc_id > 3"), [F.col("spine_index"), F.col("doc_id")], 2, 40).select("block_id")


@query(rf"WITH {LINES}, t AS (SELECT unnest(regexp_extract_all(lower(source_text), '[\p{{L}}]{{3,}}')) AS term FROM b) SELECT term, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, term LIMIT 50")
def top_terms(spark, at):
    words = doc_blocks(spark, at).select(F.explode(F.regexp_extract_all(F.lower("source_text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "term").limit(50)


@query(f"""WITH {LINES}, m AS (SELECT *, (source_text IS DISTINCT FROM lag(source_text) OVER w OR lag(spine_index) OVER w IS NULL)::INT AS nw FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY spine_index)),
r AS (SELECT doc_id, sum(nw) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT doc_id, max(c) AS run FROM (SELECT doc_id, g, count(*) AS c FROM r GROUP BY ALL) GROUP BY doc_id""")
def repetition_runs(spark, at):
    return order.longest_run(doc_blocks(spark, at))


_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query(f"""WITH {LINES}, p AS (SELECT block_id, source_text AS t, lag(source_text) OVER (PARTITION BY doc_id ORDER BY spine_index) AS s FROM b),
k AS (SELECT block_id, {_TOK.format('s')} AS sx, {_TOK.format('t')} AS tx FROM p WHERE s IS NOT NULL)
SELECT block_id, len(list_filter(tx, lambda w: list_contains(sx, w))) / len(tx)::DOUBLE AS share FROM k WHERE len(sx) >= 8 AND len(tx) >= 8""")
def near_echo_share(spark, at):
    rows = doc_blocks(spark, at).withColumn("s", F.lag("source_text").over(Window.partitionBy("doc_id").orderBy("spine_index")))
    return rows.select("block_id", gates.near_echo_share(F.col("s"), F.col("source_text")).alias("share")).filter("share is not null")


@query()
def fast_pass(spark, at):
    rows = doc_blocks(spark, at).withColumn("t", F.lead("source_text").over(Window.partitionBy("doc_id").orderBy("spine_index")))
    reason = gates.fast_pass(F.col("source_text"), F.col("t"))
    return rows.select("block_id", reason.alias("reason"), gates.band(reason).alias("score"))


@query(f"""WITH {LINES}, t AS (SELECT ['zh', 'ko', 'en'][doc_id % 3 + 1] AS target, source_text || CASE WHEN spine_index % 4 = 0 THEN 'ひカ한' ELSE '' END || CASE WHEN spine_index % 5 = 0 THEN '文字Жع' ELSE '' END AS t FROM b)
SELECT target, sum(len(regexp_extract_all(t, CASE target WHEN 'zh' THEN '[\\x{{3040}}-\\x{{30FF}}\\x{{AC00}}-\\x{{D7AF}}\\x{{0400}}-\\x{{04FF}}\\x{{0600}}-\\x{{06FF}}]' WHEN 'ko' THEN '[\\x{{3040}}-\\x{{30FF}}\\x{{0400}}-\\x{{04FF}}\\x{{0600}}-\\x{{06FF}}]' ELSE '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]' END)))::BIGINT AS residue, count(*) AS n FROM t GROUP BY target""")
def cross_script_residue(spark, at):
    """Lines as translations into three languages, with letters of other scripts added."""
    b = doc_blocks(spark, at)
    added = F.concat(F.when(F.col("spine_index") % 4 == 0, "ひカ한").otherwise(""), F.when(F.col("spine_index") % 5 == 0, "文字Жع").otherwise(""))
    target = F.element_at(F.array(F.lit("zh"), F.lit("ko"), F.lit("en")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = b.select(target.alias("target"), F.concat("source_text", added).alias("t"))
    return rows.groupBy("target").agg(F.sum(gates.foreign_script(F.col("t"), F.col("target"))).alias("residue"), F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT conv_id, turn, role, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, role, coalesce(right(before, 100), '') AS before, coalesce(left(after, 100), '') AS after FROM t""")
def dialogue_neighbours(spark, at):
    rows = table(spark, at, "conversations").withColumns({"spine_index": F.col("turn"), "block_id": F.col("turn")})
    return order.neighbours(rows, ("conv_id",), "text", 1, 100).select("conv_id", "turn", "role", F.col("tail_before").alias("before"), F.col("head_after").alias("after"))


@query("SELECT page_id::VARCHAR AS doc_id, len(regexp_extract_all(html, '<li[ >]'))::BIGINT AS list_items, len(regexp_extract_all(html, '<h1[ >]'))::BIGINT AS headings FROM pages")
def html_blocks(spark, at):
    kinds = src.read_html(table(spark, at, "pages"))
    return kinds.groupBy("doc_id").agg(F.count_if(F.col("block_type") == "list_item").alias("list_items"), F.count_if(F.col("block_type") == "heading").alias("headings"))


@query(f"""WITH {LINES} SELECT block_id, coalesce(sum(length(source_text) + 2) OVER (PARTITION BY doc_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(source_text)::INT AS n FROM b""")
def canonical_spans(spark, at):
    return src.spans(doc_blocks(spark, at)).select("block_id", "start", F.length("source_text").alias("n"))


@query()
def markdown_blocks(spark, at):
    return src.read_markdown(table(spark, at, "documents")).groupBy("block_type").count()


@query()
def section_chunks(spark, at):
    rows = doc_blocks(spark, at).withColumn("block_type", F.when(tx.looks_like_heading(F.col("source_text")), "heading").otherwise("paragraph"))
    return order.chunks(rows).select("block_id", "chunk")


@query(f"""WITH {LINES}, g AS (SELECT doc_id, spine_index, CASE WHEN spine_index % 12 = 6 THEN 999999 ELSE spine_index END AS v FROM b WHERE spine_index % 3 = 0),
k AS (SELECT *, v < 999999 OR spine_index = max(spine_index) OVER (PARTITION BY doc_id) AS keep, count(*) OVER (PARTITION BY doc_id) AS n FROM g), c AS (SELECT *, count(*) FILTER (WHERE keep) OVER (PARTITION BY doc_id) AS m FROM k)
SELECT doc_id, spine_index FROM c WHERE keep AND m >= 4 AND m * 2 >= n""")
def page_number_lines(spark, at):
    """Lines of documents, every third a number in order, some of those out of it."""
    i = F.col("spine_index")
    text = F.when(i % 12 == 6, "999999").when(i % 3 == 0, i.cast("string")).otherwise(F.concat(F.lit("t "), "source_text"))
    return order.page_number_lines(doc_blocks(spark, at).withColumn("source_text", text))


_LETTERS = "chr((65 + p_partkey % 26)::INT) AS a, chr((65 + p_partkey // 26 % 26)::INT) AS b, chr((65 + p_partkey // 676 % 26)::INT) AS c"


@query(f"""WITH p AS (SELECT p_partkey, {_LETTERS} FROM part), x AS (SELECT a || b || c AS acronym, a || 'pple ' || b || 'erry ' || c || 'hip' AS expansion FROM p WHERE p_partkey % 5 <> 0) SELECT DISTINCT acronym, expansion FROM x""")
def abbreviations(spark, at):
    """Parts as lines with a long name and its letters in brackets, every fifth with letters that do not fit."""
    letter = lambda div: F.char(65 + F.floor(F.col("p_partkey") / div) % 26)
    p = table(spark, at, "part").select("p_partkey", letter(1).alias("a"), letter(26).alias("b"), letter(676).alias("c"))
    acronym = F.when(F.col("p_partkey") % 5 == 0, F.lit("QQQQ")).otherwise(F.concat("a", "b", "c"))
    text = F.concat(F.lit("See the "), "a", F.lit("pple "), "b", F.lit("erry "), "c", F.lit("hip ("), acronym, F.lit(") for more."))
    return terms.abbreviations(p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("spine_index"), text.alias("source_text")))


@query()
def masked_text(spark, at):
    from quire.functions.masking import mask_udf

    rows = doc_blocks(spark, at).select("block_id", mask_udf()("source_text").alias("m"))
    return rows.filter(F.size("m.spans") > 0).select("block_id", "m.text", F.size("m.spans").alias("n_spans"))


@query()
def stated_numbers(spark, at):
    from pyspark.sql import types as T

    from quire.functions.numbers import values
    from quire.functions.udf import vectorized

    found = vectorized(values, T.ArrayType(T.StringType()))
    return doc_blocks(spark, at).filter(F.col("source_text").rlike("[0-9]")).select("block_id", F.array_join(found("source_text"), " ").alias("numbers"))


@query(r"SELECT page_id, length(regexp_replace(regexp_replace(html, '(?is)<script.*?</script\s*>', '', 'g'), '(?is)<style.*?</style\s*>', '', 'g')) AS n FROM pages")
def html_sanitize(spark, at):
    from quire.functions.cleaning import sanitized

    return table(spark, at, "pages").select("page_id", F.length(sanitized(F.col("html"))).cast("long").alias("n"))


_BOX = """x AS (SELECT l_orderkey // 64 AS page, (l_partkey % 20)::VARCHAR AS t, l_orderkey AS block_id, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 50)::DOUBLE AS y0, (l_partkey % 50 + l_quantity)::DOUBLE AS x1, (l_suppkey % 50 + l_quantity)::DOUBLE AS y1 FROM lineitem)"""


def boxes(spark, at):
    """Lines of orders as boxes, on pages of 64 orders each."""
    box = "named_struct('x0', double(l_partkey % 50), 'y0', double(l_suppkey % 50), 'x1', double(l_partkey % 50 + l_quantity), 'y1', double(l_suppkey % 50 + l_quantity)) AS bbox"
    return table(spark, at, "lineitem").selectExpr("l_orderkey div 64 AS page", "l_orderkey AS block_id", "string(l_partkey % 20) AS text", box)


@query(f"""WITH {_BOX}, n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY block_id, x0, y0, x1, y1) AS r FROM x WHERE (x1 - x0) * (y1 - y0) >= 1), s AS (SELECT * FROM n),
p AS (SELECT a.page, a.block_id AS a, b.block_id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS u FROM s a JOIN s b ON a.page = b.page AND a.r < b.r)
SELECT page, a, b, i / (u - i) AS iou FROM p WHERE i / (u - i) >= 0.6""")
def block_overlaps(spark, at):
    return geometry.overlaps(boxes(spark, at))


@query(f"""WITH {_BOX}, n AS (SELECT *, row_number() OVER w AS r, first_value(x0) OVER w AS kx0, first_value(y0) OVER w AS ky0, first_value(x1) OVER w AS kx1, first_value(y1) OVER w AS ky1 FROM x WINDOW w AS (PARTITION BY page, t ORDER BY (x1 - x0) * (y1 - y0) DESC, block_id, x0, y0, x1, y1)),
i AS (SELECT *, greatest(least(x1, kx1) - greatest(x0, kx0), 0) * greatest(least(y1, ky1) - greatest(y0, ky0), 0) AS i, (x1 - x0) * (y1 - y0) + (kx1 - kx0) * (ky1 - ky0) AS u FROM n)
SELECT block_id FROM i WHERE r = 1 OR coalesce(i / nullif(u - i, 0), 0) < 0.6""")
def duplicate_boxes(spark, at):
    return geometry.drop_duplicate_boxes(boxes(spark, at)).select("block_id")


_STATES = "['pending','drafted','mtqe_passed','repair_pending','repaired','failed','needs_human','blocked_human']"


@query(f"""WITH u AS (SELECT event_id AS id, {_STATES}[event_id % 8 + 1] AS o, {_STATES}[(event_id // 8) % 8 + 1] AS n FROM events)
SELECT id AS block_id, CASE WHEN CASE n WHEN 'pending' THEN false WHEN 'drafted' THEN o = 'pending' WHEN 'mtqe_passed' THEN true WHEN 'failed' THEN true
  WHEN 'repair_pending' THEN o NOT IN ('failed', 'blocked_human') WHEN 'repaired' THEN o NOT IN ('pending', 'drafted') ELSE o <> 'pending' END THEN n ELSE o END AS status FROM u""")
def checkpoint_merge(spark, at):
    states_ = _STATES.replace("[", "array(").replace("]", ")")
    rows = ledger(spark, at).select(F.lit(1).alias("job_id"), F.col("event_id").alias("block_id"), "status")
    news = ledger(spark, at).select(F.lit(1).alias("job_id"), F.col("event_id").alias("block_id"), F.expr(f"{states_}[int(event_id div 8 % 8)]").alias("status"))
    return states.merge_checkpoints(rows, news).select("block_id", "status")


@query(r"""WITH d AS (SELECT lang, source_text, CASE WHEN NOT regexp_matches(source_text, '[\p{L}\p{N}_]') THEN 'verdict:placeholder' ELSE 'verdict:translate' END AS verdict FROM b)
SELECT lang, verdict, count(*) AS n FROM d GROUP BY ALL""".replace("WITH d", "WITH " + LINES + ", v") .replace("FROM d GROUP", "FROM v GROUP"))
def flagship(spark, at):
    """Lines of documents by language and whether anything in them can be translated."""
    rows = doc_blocks(spark, at)
    kind = F.when(~F.col("source_text").rlike(r"[\p{L}\p{N}_]"), "verdict:placeholder").otherwise("verdict:translate")
    return rows.groupBy("lang", kind.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
