"""Queries over rules and ledger operators, each with DuckDB SQL that states the rule by itself; inputs reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import defects, names
from quire.operators import layout, ledger, scope
from quire.plans.catalogue import LEDGER, LINES, doc_blocks, query, table
from quire.plans.catalogue import ledger as event_ledger

# ---- defect flags -------------------------------------------------------------------------------------------------

#: Flags, and what each of them is by itself: critical, structural, format only, semantic only, declared severity, kind.
FLAGS = [
    ("Numeric fidelity: 3 lost", 1, 1, 0, 0, 0, "quality"), ("Glossary term violation: x", 0, 1, 0, 0, 0, "quality"), ("HTML delta failure: b", 0, 1, 1, 0, 0, "quality"),
    ("length_inflated:minor:2.1", 0, 1, 1, 0, 1, "quality"), ("omission:major:half", 0, 1, 0, 0, 2, "quality"), ("style:minor:stiff", 0, 0, 0, 0, 1, "quality"),
    ("judge said awkward", 0, 0, 0, 1, 0, "quality"), ("Drafting error: 500", 0, 1, 0, 0, 0, "drafting_transient"), ("Repair error: 500", 0, 1, 0, 0, 0, "repair_transient"),
    ("untranslated: x", 0, 0, 0, 0, 0, "untranslated"), ("needs_human_review", 0, 0, 0, 0, 0, "triage_verdict"), ("accuracy:critical:lost", 1, 1, 0, 0, 3, "quality"),
    ("Target text suspiciously truncated", 0, 1, 1, 0, 0, "quality"), ("numeric_advisory: order", 0, 0, 0, 0, 0, "quality"), ("Drafting config error: key", 0, 0, 0, 0, 0, "retryable_config"),
    ("Drafting unrecoverable: page", 0, 0, 0, 0, 0, "non_retryable"), ("Note:critical:x", 0, 0, 0, 0, 0, "quality"), ("Semantic drift", 0, 0, 0, 1, 0, "quality"),
]
_N = len(FLAGS)
_FLAGS_SQL = "f(i, flag, crit, struct, fmt, sem, sev, kind) AS (VALUES " + ", ".join(f"({i}, '{f[0]}', {f[1]}, {f[2]}, {f[3]}, {f[4]}, {f[5]}, '{f[6]}')" for i, f in enumerate(FLAGS)) + ")"
#: Up to two flags an event, none for every fifth, and a score that is null for every third.
_PICKS = f"e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 37 % 1000) / 1000.0::DOUBLE END AS score, event_id % {_N} AS a, (event_id // {_N}) % {_N} AS b, event_id % 5 = 0 AS none FROM events)"


def flagged(spark, at):
    flags = "array(" + ",".join(f"'{f[0]}'" for f in FLAGS) + ")"
    return table(spark, at, "events").selectExpr(
        "event_id", "user_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id * 37 % 1000) / 1000.0D END AS score",
        f"CASE WHEN event_id % 5 = 0 THEN array() ELSE array({flags}[int(event_id % {_N})], {flags}[int(event_id div {_N} % {_N})]) END AS flags",
    )


@query(f"""WITH {_FLAGS_SQL}, {_PICKS}, x AS (SELECT event_id, score, none, a.crit + b.crit > 0 AND NOT none AS crit, a.struct + b.struct > 0 AND NOT none AS struct, a.fmt + b.fmt = 2 AND NOT none AS fmt,
  a.sem + b.sem = 2 AND NOT none AS sem, CASE WHEN none THEN 0 ELSE greatest(a.sev, b.sev) END AS sev FROM e JOIN f a ON a.i = e.a JOIN f b ON b.i = e.b)
SELECT event_id, CASE sev WHEN 1 THEN 'minor' WHEN 2 THEN 'major' WHEN 3 THEN 'critical' END AS structured,
  CASE WHEN crit THEN 'critical' WHEN struct THEN 'major' WHEN sev = 1 THEN 'minor' END AS declared, fmt AS format_only,
  CASE WHEN crit OR struct THEN 'DETERMINISTIC_DEFECT' WHEN sem OR coalesce(score < 0.6, false) THEN 'SEMANTIC_DOUBT' ELSE 'PASS' END AS route, none AND coalesce(score, 0) >= 0.6 AS ships FROM x""")
def defect_routing(spark, at):
    f, s = F.col("flags"), F.col("score")
    return flagged(spark, at).select(
        "event_id", defects.structured_severity(f).alias("structured"), defects.declared_severity(f).alias("declared"), defects.format_only(f).alias("format_only"),
        defects.defect_class(f, s, 0.6).alias("route"), defects.shippable(s, f, 0.6).alias("ships"),
    )


@query(f"""WITH {_FLAGS_SQL}, {_PICKS}, p AS (SELECT a AS i FROM e WHERE NOT none UNION ALL SELECT b FROM e WHERE NOT none)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE flag LIKE 'Numeric%') AS numeric_ FROM p JOIN f USING (i) GROUP BY kind""")
def flag_kinds(spark, at):
    rows = flagged(spark, at).select(F.explode("flags").alias("flag"))
    return rows.groupBy(defects.flag_kind(F.col("flag")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(defects.numeric_defect(F.array("flag"))).alias("numeric_"))


@query(f"""WITH {LEDGER}, c AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS f, count(*) FILTER (WHERE status = 'blocked_human') AS b, count(*) FILTER (WHERE status = 'needs_human') AS w,
  count(*) FILTER (WHERE status IN ('mtqe_passed', 'repaired')) AS d, count(*) FILTER (WHERE status = 'repaired') AS r FROM s WHERE job_id % 2 = 0 OR status NOT IN ('failed', 'blocked_human') GROUP BY job_id)
SELECT job_id, CASE WHEN f + b > 0 OR d = 0 THEN 'blocked' WHEN w > 0 THEN 'warning' ELSE 'passed' END AS verdict, (r + f) / n::DOUBLE >= 0.15 AS hard, round((r + f) / n::DOUBLE, 3) AS repair_share FROM c""")
def delivery_verdicts(spark, at):
    rows = event_ledger(spark, at).filter("job_id % 2 = 0 or status not in ('failed', 'blocked_human')")  # odd jobs reach the other verdicts
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    c = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), n("failed").alias("f"), n("blocked_human").alias("b"), n("needs_human").alias("w"), n("mtqe_passed", "repaired").alias("d"), n("repaired").alias("r"))
    return c.select("job_id", defects.delivery_verdict(*[F.col(x) for x in "fbwd"]).alias("verdict"), defects.difficulty(F.col("n"), F.col("r"), F.col("f")).alias("x")).select("job_id", "verdict", "x.*")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 7 < 3 THEN ['completed', 'failed', 'cancelled'][o_orderkey % 7 + 1] WHEN o_orderkey % 5 = 0 AND o_custkey > 0 THEN 'completed'
  WHEN o_orderkey % 4 = 1 THEN 'awaiting_agent' WHEN o_orderkey % 4 = 2 THEN 'needs_attention' WHEN o_orderkey % 3 = 0 OR o_orderkey % 11 = 0 THEN 'running' ELSE 'failed' END AS status,
  NOT (o_orderkey % 7 < 3 OR (o_orderkey % 5 = 0 AND o_custkey > 0) OR o_orderkey % 4 IN (1, 2) OR o_orderkey % 3 = 0 OR o_orderkey % 11 = 0) AS interrupted FROM orders""")
def job_projection(spark, at):
    j = table(spark, at, "orders").selectExpr(
        "o_orderkey AS job_id", "array('completed','failed','cancelled','running','queued','submitted','running')[int(o_orderkey % 7)] AS stored", "o_custkey AS total",
        "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey ELSE o_custkey - 1 END AS done", "array('drafting','awaiting_agent','needs_attention',null)[int(o_orderkey % 4)] AS agent",
        "o_orderkey % 3 = 0 AS writer", "o_orderkey % 11 = 0 AS grace",
    )
    return j.select("job_id", defects.job_status(*[F.col(c) for c in ("stored", "total", "done", "agent", "writer", "grace")]).alias("x")).select("job_id", "x.*")


@query("""SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'unenforceable' WHEN o_totalprice > 150000 THEN 'over' END AS stop FROM orders""")
def budget_stops(spark, at):
    o = table(spark, at, "orders")
    cost, cap = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 4 != 0, F.lit(150000.0))
    return o.select(F.col("o_orderkey").alias("job_id"), defects.over_budget(cost, cap, F.col("o_orderkey") % 3 == 0).alias("stop"))


_SKIPS = ["render_skip:overflow(base=10.0)", "render_skip:overflow(base=7.5)", "render_skip:skip_translate", "render_skip:facsimile_preserved_opaque (ink)", "render_skip:", "omission:major:x", "render_skip:no_room"]


@query(f"""WITH s AS (SELECT [{", ".join(f"'{x}'" for x in _SKIPS)}][event_id % {len(_SKIPS)} + 1] AS flag FROM events), f AS (SELECT trim(split_part(substr(flag, 13), '(', 1)) AS family FROM s WHERE starts_with(flag, 'render_skip:'))
SELECT family, count(*) AS n, family NOT IN ('skip_translate', 'facsimile_preserved_opaque', 'table_preserved_source') AS lost FROM f WHERE family <> '' GROUP BY family""")
def render_skip_families(spark, at):
    flags = "array(" + ",".join(f"'{x}'" for x in _SKIPS) + ")"
    return ledger.render_skips(table(spark, at, "events").selectExpr(f"{flags}[int(event_id % {len(_SKIPS)})] AS flag"))


# ---- names, markers, pages ----------------------------------------------------------------------------------------

#: What lines start with, by their number: a marker and the text that should be left, or none.
_MARKS = ["1. ", "(2) ", "• ", "•", "- ", "-", "[12] ", "a) ", "一、 ", "1.5", "３．４． ", "", "* "]
_FOUND = ["1.", "(2)", "•", "•", "-", None, "[12]", "a)", "一、", None, "３．４．", None, "*"]


def _marked(spark, at):
    marks = "array(" + ",".join(f"'{m}'" for m in _MARKS) + ")"
    return doc_blocks(spark, at).selectExpr("block_id", "source_text AS s", f"concat('  ', {marks}[int(spine_index % {len(_MARKS)})], 'x', source_text) AS line", "spine_index")


@query(f"""WITH {LINES}, m AS (SELECT block_id, 'x' || source_text AS s, [{", ".join("NULL" if m is None else f"'{m}'" for m in _FOUND)}][spine_index % {len(_MARKS)} + 1] AS marker FROM b)
SELECT block_id, marker, CASE WHEN marker IS NOT NULL THEN s END AS item FROM m""")
def list_markers(spark, at):
    return _marked(spark, at).select("block_id", names.list_marker(F.col("line")).alias("m")).select("block_id", "m.marker", F.col("m.text").alias("item"))


_LINES = ["::: note", "text {.ct}", "{.cn}", "# Title", "Chapter 7", "", "Step by step. And on.", "A short line", "Ends here.", "结束。", "x" * 90, "- item;"]


@query(f"""WITH l(i, line, noise, title) AS (VALUES {", ".join(f"({i}, '{x}', {i < 3}, {i in (3, 4, 6, 7, 11)})" for i, x in enumerate(_LINES))}), e AS (SELECT event_type, event_id % {len(_LINES)} AS i FROM events)
SELECT event_type, count(*) FILTER (WHERE noise) AS noise, count(*) FILTER (WHERE title) AS titles FROM e JOIN l USING (i) GROUP BY event_type""")
def page_line_shapes(spark, at):
    lines = "array(" + ",".join(f"'{x}'" for x in _LINES) + ")"
    rows = table(spark, at, "events").selectExpr("event_type", f"{lines}[int(event_id % {len(_LINES)})] AS line")
    return rows.groupBy("event_type").agg(F.count_if(names.calibre_noise(F.col("line"))).alias("noise"), F.count_if(names.heading_or_item(F.col("line"))).alias("titles"))


@query("""SELECT l_orderkey, l_linenumber, lower(l_returnflag) || ' ' || lower(l_linestatus) AS key, l_linenumber % 2 = 0 OR l_linenumber % 3 = 0 AS data FROM lineitem""")
def table_cells(spark, at):
    li = table(spark, at, "lineitem")
    key = names.cell_key(F.concat(F.lit(" **"), "l_returnflag", F.lit("**  `"), "l_linestatus", F.lit("`$ ")))
    n = F.col("l_linenumber")
    first = F.when(n % 2 == 0, F.lit("$ 12.5 ms")).when(n % 3 == 0, F.lit("v10 a")).otherwise(F.lit("Name"))
    return li.select("l_orderkey", "l_linenumber", key.alias("key"), names.data_row(F.array(first, F.lit("  "), F.lit("Unit"))).alias("data"))


_TEXTS = [
    ("It is not done; sales increased", "neg", "increase", "", ""), ("Turn left, above all", "", "", "left", ""), ("It isn’t less than that", "neg", "", "", "less"), ("这不是", "neg", "", "", ""),
    ("The north has nothings", "", "", "", ""), ("Decreasing more", "", "", "", "more"), ("Sales decreased", "", "decrease", "", ""), ("", "", "", "", ""),
]


@query(f"""WITH t(i, s, neg, up, side, amount) AS (VALUES {", ".join(f"({i}, {', '.join(chr(39) + x + chr(39) for x in t)})" for i, t in enumerate(_TEXTS))}), e AS (SELECT event_id, event_id % {len(_TEXTS)} AS i, (event_id // 8) % {len(_TEXTS)} AS j FROM events)
SELECT event_id, a.neg, a.up, a.side, a.amount, (a.neg, a.up, a.side, a.amount, a.s LIKE '%above%') <> (b.neg, b.up, b.side, b.amount, b.s LIKE '%above%') AS diverges FROM e JOIN t a ON a.i = e.i JOIN t b ON b.i = e.j""")
def polarity_slots(spark, at):
    texts = "array(" + ",".join(f"'{t[0]}'" for t in _TEXTS) + ")"
    rows = table(spark, at, "events").selectExpr("event_id", f"{texts}[int(event_id % {len(_TEXTS)})] AS a", f"{texts}[int(event_id div 8 % {len(_TEXTS)})] AS b")
    rows = rows.select("event_id", names.polarity(F.col("a")).alias("p"), names.polarity_diverges(F.col("a"), F.col("b")).alias("diverges"))
    return rows.select("event_id", *[F.col("p")[k].alias(n) for k, n in ((0, "neg"), (1, "up"), (2, "side"), (4, "amount"))], "diverges")


@query("""SELECT l_orderkey, l_linenumber, len(list_distinct([l_orderkey::VARCHAR, l_linenumber || '%', '$x+' || l_partkey || '$', '+' || l_partkey, 'ID_' || l_suppkey, 'GPU9', 'WXYZ']))::INT AS entities, l_linenumber % 2 = 0 AS kept FROM lineitem""")
def entities_and_polarity(spark, at):
    li = table(spark, at, "lineitem")
    text = F.format_string("Order %s took %s%% of $x+%s$ in ID_%s on the GPU9, plain words, WXYZ and GPU9", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    back = F.when(F.col("l_linenumber") % 2 == 0, F.lit("it never works")).otherwise(F.lit("it works"))
    return li.select("l_orderkey", "l_linenumber", F.size(names.key_entities(text)).alias("entities"), names.polarity_kept(F.lit("It does not work"), back, F.lit(True)).alias("kept"))


@query("""WITH n AS (SELECT n_nationkey, ['zh-CN', 'EN_us', 'ru', 'he-IL', 'xx-YY', '', 'pt-BR'][n_nationkey % 7 + 1] AS a, ['en', 'ja', 'fr', 'uk', 'fa'][n_nationkey % 5 + 1] AS t FROM nation),
b AS (SELECT *, split_part(replace(lower(a), '_', '-'), '-', 1) AS s FROM n), f(c, fam) AS (VALUES ('zh', 1), ('en', 2), ('ru', 3), ('he', 4), ('pt', 2), ('ja', 1), ('fr', 2), ('uk', 3), ('fa', 4)),
x(p, q, low, high) AS (VALUES (2, 1, 0.18, 1.8), (1, 2, 0.8, 5.0), (2, 2, 0.5, 2.0), (1, 1, 0.5, 2.0), (3, 1, 0.2, 1.8), (1, 3, 0.8, 4.5), (3, 2, 0.5, 1.8), (2, 3, 0.6, 2.0), (2, 4, 0.5, 2.0), (4, 2, 0.5, 2.0), (1, 4, 0.5, 2.5), (4, 1, 0.3, 2.0))
SELECT n_nationkey, s AS base, coalesce(low, 0.4)::DOUBLE AS low, coalesce(high, 2.5)::DOUBLE AS high FROM b LEFT JOIN f g ON g.c = s LEFT JOIN f h ON h.c = t LEFT JOIN x ON x.p = g.fam AND x.q = h.fam""")
def language_bounds(spark, at):
    n = table(spark, at, "nation").selectExpr("n_nationkey", "array('zh-CN','EN_us','ru','he-IL','xx-YY','','pt-BR')[n_nationkey % 7] AS a", "array('en','ja','fr','uk','fa')[n_nationkey % 5] AS t")
    base = names.lang_base(F.col("a"))
    return n.select("n_nationkey", base.alias("base"), names.length_bounds(base, F.col("t"), 0.4, 2.5).alias("b")).select("n_nationkey", "base", "b.*")


@query(f"""WITH {LINES} SELECT CASE WHEN spine_index % 4 = 0 THEN '' WHEN spine_index % 4 = 3 THEN 'ch:' || doc_id ELSE 'ch_' || doc_id END AS chapter, count(*) FILTER (WHERE spine_index % 3 = 0) AS cjk, count(*) AS n
FROM b GROUP BY 1""")
def chapters_of_ids(spark, at):
    i = F.col("spine_index") % 4
    tail = F.when(i == 0, F.lit("")).when(i == 1, F.lit("#b:1")).when(i == 2, F.lit(":b1")).otherwise(F.lit("#b1"))
    block = F.concat(F.when(i == 0, F.lit("x")).when(i == 3, F.lit("ch:")).otherwise(F.lit("ch_")), F.col("doc_id").cast("string"), tail)
    text = F.when(F.col("spine_index") % 3 == 0, F.concat("source_text", F.lit("文"))).otherwise(F.translate("source_text", "文", ""))
    return doc_blocks(spark, at).groupBy(names.chapter_id(block).alias("chapter")).agg(F.count_if(names.contains_cjk(F.regexp_replace(text, r"[\x{3000}-\x{9FFF}\x{AC00}-\x{D7AF}](?!$)", ""))).alias("cjk"), F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '9787' ELSE '9780' END || lpad(p_partkey::VARCHAR, 8, '0') AS c FROM part),
d AS (SELECT p_partkey, c || ((10 - list_sum(list_transform(range(1, 13), lambda k: substr(c, k, 1)::INT * CASE WHEN k % 2 = 0 THEN 3 ELSE 1 END)) % 10) % 10)::INT AS i FROM p)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'no isbn ' || p_partkey WHEN p_partkey % 3 = 0 THEN substr(i, 1, 3) || '-' || substr(i, 4, 1) || '-' || substr(i, 5, 3) || '-' || substr(i, 8, 5) || '-' || substr(i, 13, 1)
  ELSE substr(i, 1, 3) || '-' || substr(i, 4, 2) || '-' || substr(i, 6, 4) || '-' || substr(i, 10, 3) || '-' || substr(i, 13, 1) END AS isbn,
  CASE WHEN p_size <= 1 THEN 1 WHEN p_size <= 3 THEN p_size WHEN p_size = 4 THEN 2 WHEN p_size <= 7 THEN 3 ELSE 4 END::INT AS columns_ FROM d JOIN part USING (p_partkey)""")
def isbn_and_grid(spark, at):
    from quire.functions import text as tx

    p = table(spark, at, "part")
    p = p.withColumn("c", F.concat(F.when(F.col("p_partkey") % 3 == 0, "9787").otherwise("9780"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")))
    digit = sum((F.substring("c", k, 1).cast("int") * (3 if k % 2 == 0 else 1) for k in range(2, 13)), F.substring("c", 1, 1).cast("int"))
    p = p.withColumn("i", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" no isbn "), "p_partkey")).otherwise(F.concat("c", ((10 - digit % 10) % 10).cast("string"))))
    return p.select("p_partkey", names.hyphenated_isbn(F.col("i"), tx.is_valid_isbn(F.col("i"))).alias("isbn"), names.grid_columns(F.col("p_size")).alias("columns_"))


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(rf"""WITH d AS (SELECT doc_id, {_TRIM.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE regexp_replace(substr(t, 1, 100), '\s+$', '') || chr(10) || '[...]' || chr(10) || regexp_replace(substr(t, length(t) - 199), '^\s+', '') END AS summary FROM d""")
def epoch_summaries(spark, at):
    return table(spark, at, "documents").select("doc_id", names.epoch_summary(F.coalesce("text", F.lit("")), 300).alias("summary"))


_PAGES = """pg AS (SELECT l_suppkey, (l_partkey * 7 % 2600)::BIGINT AS chars, l_linenumber % 3 AS images, l_linenumber % 4 AS fonts, l_partkey % 300 AS paths, l_discount * 5 AS right_rows, l_tax AS formulas, l_orderkey, l_linenumber FROM lineitem),
pk AS (SELECT *, CASE WHEN images >= 1 AND chars BETWEEN 32 AND 79 AND fonts <= 2 AND paths < 200 THEN 'poster_fixed' WHEN chars < 32 AND paths < 200 THEN 'scan_image' WHEN chars < 100 AND paths >= 200 THEN 'vector_heavy'
  WHEN right_rows > 0.25 OR formulas >= 0.10 OR images >= 1 OR paths >= 200 THEN 'mixed_complex' WHEN chars > 2000 THEN 'resume_dense' ELSE 'editable_text' END AS kind FROM pg)"""


def _pages(spark, at):
    return table(spark, at, "lineitem").selectExpr(
        "l_suppkey", "l_partkey * 7 % 2600 AS chars", "l_linenumber % 3 AS images", "l_linenumber % 4 AS fonts", "l_partkey % 300 AS paths", "l_discount * 5 AS right_rows", "l_tax AS formulas", "l_orderkey", "l_linenumber"
    )


@query(f"WITH {_PAGES} SELECT kind, count(*) AS n FROM pk GROUP BY kind")
def page_kinds(spark, at):
    p = _pages(spark, at)
    return p.groupBy(names.page_kind(*[F.col(c) for c in ("chars", "images", "fonts", "paths", "right_rows", "formulas")]).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_PAGES} SELECT l_suppkey, count(*) AS pages, count(*) FILTER (WHERE right_rows > 0.25) / count(*)::DOUBLE AS multicolumn,
  count(*) FILTER (WHERE kind IN ('mixed_complex', 'vector_heavy', 'scan_image', 'poster_fixed')) / count(*)::DOUBLE AS structural, count(*) FILTER (WHERE kind = 'scan_image') * 2 >= count(*) AS scanned, count(*) FILTER (WHERE kind = 'mixed_complex') * 2 >= count(*) AS complex
  FROM pk GROUP BY l_suppkey""")
def page_census(spark, at):
    return layout.page_census(_pages(spark, at), "l_suppkey")


_HEADS = ["Introduction", "Appendix B: Proofs", "附录 二", "References", "Glossary of terms", "Subject Index", "Epilogue", "Colophon:", "Appendix", "Indexing methods"]
_HEAD_KINDS = [None, "appendix", "appendix", "bibliography", "glossary", "index", "afterword", "colophon", "appendix", None]


@query(rf"""WITH {LINES}, h AS (SELECT doc_id, spine_index, block_id, spine_index % 5 = 0 AS head, (spine_index // 5 + doc_id) % 10 AS i FROM b),
k AS (SELECT *, CASE WHEN head THEN [{", ".join("NULL" if x is None else f"'{x}'" for x in _HEAD_KINDS)}][i + 1] END AS kind, CASE WHEN head THEN ['', 'B', 'B', '', '', '', '', '', '', ''][i + 1] END AS letter FROM h),
o AS (SELECT *, CASE WHEN head THEN kind IS NOT NULL END AS opens, sum(CASE WHEN kind = 'appendix' THEN 1 ELSE 0 END) OVER w AS nth, sum(CASE WHEN kind IS NOT NULL THEN 1 ELSE 0 END) OVER w AS number FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY spine_index)),
v AS (SELECT *, last_value(opens IGNORE NULLS) OVER w AS live, last_value(CASE WHEN opens THEN kind END IGNORE NULLS) OVER w AS lk, last_value(CASE WHEN opens THEN CASE WHEN kind = 'appendix' AND letter = '' THEN chr((64 + nth)::INT) ELSE letter END END IGNORE NULLS) OVER w AS ll
  FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY spine_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT block_id, CASE WHEN live THEN number END::BIGINT AS number, CASE WHEN live THEN lk END AS kind, CASE WHEN live THEN ll END AS letter FROM v""")
def backmatter_parts(spark, at):
    heads = "array(" + ",".join(f"'{x}'" for x in _HEADS) + ")"
    b = doc_blocks(spark, at).selectExpr("doc_id", "spine_index", "block_id", "spine_index % 5 = 0 AS head", f"CASE WHEN spine_index % 5 = 0 THEN {heads}[int((spine_index div 5 + doc_id) % 10)] ELSE source_text END AS source_text")
    out = layout.backmatter(b, "doc_id", F.col("head"))
    return out.select("block_id", F.col("part.number").alias("number"), "part.kind", "part.letter")


_EPIGRAPHS = [("> “To be.”\\n> — Ann", "To be.", "Ann"), ("Be well — Bo Li", "Be well", "Bo Li"), ("No source here", None, None), ("Line one\\nby Cy Day", "Line one", "Cy Day"), ("", None, None), ("One -- " + "z" * 61, None, None)]


@query(f"""WITH t(i, quote, source) AS (VALUES {", ".join(f"({i}, {'NULL' if q is None else repr(q)}, {'NULL' if s is None else repr(s)})" for i, (_, q, s) in enumerate(_EPIGRAPHS))})
SELECT event_id, quote, source FROM events JOIN t ON event_id % {len(_EPIGRAPHS)} = i""")
def epigraphs(spark, at):
    texts = "array(" + ",".join(f"'{t[0]}'" for t in _EPIGRAPHS) + ")"
    return table(spark, at, "events").selectExpr("event_id", f"{texts}[int(event_id % {len(_EPIGRAPHS)})] AS t").select("event_id", names.epigraph(F.col("t")).alias("e")).select("event_id", "e.quote", "e.source")


@query("""WITH o AS (SELECT o_custkey, list(DISTINCT (o_orderkey % 400)::INT) AS p FROM orders GROUP BY o_custkey), s AS (SELECT o_custkey, list_sort(p) AS p FROM o)
SELECT o_custkey, len(p) AS pages, ((len(p) + 3) // 4) AS chunks, p[len(p)] AS last_page, p[((len(p) - 1) // 4) * 4 + 1] AS last_chunk_from FROM s""")
def page_chunking(spark, at):
    o = table(spark, at, "orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 400).cast("int")).alias("p"))  # a customer's orders
    c = names.page_chunks(F.col("p"), 4)
    return o.select("o_custkey", F.size(F.array_distinct("p")).cast("long").alias("pages"), F.size(c).cast("long").alias("chunks"), F.array_max("p").alias("last_page"), F.element_at(F.element_at(c, -1), 1).alias("last_chunk_from"))


# ---- the ledger ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_id % 4 <> 0 AS policy_translate, CASE WHEN event_id % 4 = 0 THEN 'verdict:hexdump' ELSE 'verdict:translate' END AS policy_reason, event_id % 4 = 0 OR event_id % 7 = 0 AS skip_translate FROM events")
def applied_verdicts(spark, at):
    verdict = F.when(F.col("event_id") % 4 == 0, F.lit("verdict:hexdump")).otherwise(F.lit("verdict:translate"))
    return ledger.apply_verdict(event_ledger(spark, at), verdict).select("event_id", "policy_translate", "policy_reason", "skip_translate")


@query(f"WITH {LINES} SELECT block_id, spine_index, source_text FROM b")
def job_blocks(spark, at):
    return ledger.job_blocks(doc_blocks(spark, at), F.lit(True)).select("block_id", "spine_index", "source_text")


@query(f"WITH {LINES} SELECT source_text FROM b")
def source_texts(spark, at):
    return ledger.source_texts(doc_blocks(spark, at), F.lit(True))


@query(f"WITH {LINES} SELECT block_id, source_text AS source, 'T: ' || source_text AS target FROM b WHERE spine_index % 3 <> 0 AND spine_index % 5 NOT IN (0, 1)")
def translated_segments(spark, at):
    i = F.col("spine_index")
    target = F.when(i % 5 == 0, None).when(i % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit("T: "), "source_text"))
    skip = F.when(i % 3 == 0, F.lit(True)).when(i % 3 == 1, F.lit(False))
    return ledger.segments(doc_blocks(spark, at).withColumns({"target_text": target, "skip_translate": skip}))


@query(f"""WITH {_FLAGS_SQL}, {_PICKS}, x AS (SELECT event_id, NOT none AND a.struct + b.struct + a.crit + b.crit > 0 AS defect FROM e JOIN f a ON a.i = e.a JOIN f b ON b.i = e.b), {LEDGER}
SELECT x.event_id FROM x JOIN k USING (event_id) WHERE defect AND NOT skip_translate AND status IN ('pending', 'drafted', 'repair_pending') AND x.event_id % 6 < 3""")
def repair_candidates(spark, at):
    b = event_ledger(spark, at).drop("error_flags", "mtqe_score").join(flagged(spark, at).select("event_id", F.col("flags").alias("error_flags"), F.col("score").alias("mtqe_score")), "event_id")
    return ledger.repair_candidates(b.withColumn("repair_rounds", F.col("event_id") % 6), 0.6, 3).select("event_id")


def _memory(spark, at):
    return table(spark, at, "events").selectExpr(
        "event_id AS id", "array('en','fr')[int(event_id % 2)] AS src_lang", "array('zh','ja','de')[int(event_id % 3)] AS tgt_lang", "concat('s_', event_type, '%', event_id % 50) AS src_text", "concat('T ', event_id % 30) AS tgt_text",
        "CASE WHEN event_id % 5 = 0 THEN 'human_pe' ELSE 'machine' END AS provenance", "event_id % 4 AS use_count", "unix_timestamp(ts) AS updated_at",
    )


_MEMORY_SQL = """m AS (SELECT event_id AS id, ['en','fr'][event_id % 2 + 1] AS src_lang, ['zh','ja','de'][event_id % 3 + 1] AS tgt_lang, 's_' || event_type || '%' || event_id % 50 AS src_text, 'T ' || event_id % 30 AS tgt_text,
  CASE WHEN event_id % 5 = 0 THEN 'human_pe' ELSE 'machine' END AS provenance, event_id % 4 AS use_count, floor(epoch(ts))::BIGINT AS updated_at FROM events)"""


@query(f"""WITH {_MEMORY_SQL}, f AS (SELECT * FROM m WHERE src_lang = 'en' AND (contains(lower(src_text), '%1') OR contains(lower(tgt_text), '%1')))
SELECT id, use_count, updated_at, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE provenance = 'machine') AS machine, (SELECT count(*) FROM f WHERE provenance = 'human_pe') AS human, (SELECT count(*) FROM f WHERE use_count = 0) AS never_used
FROM f ORDER BY use_count DESC, updated_at DESC, id DESC LIMIT 25 OFFSET 10""")
def memory_page(spark, at):
    page = ledger.memory_page(_memory(spark, at), 25, 10, "most_used", F.col("src_lang") == "en", "%1")
    return page.select("id", "use_count", "updated_at", "total", "machine", "human", "never_used")


@query(f"WITH {_MEMORY_SQL} SELECT src_lang, tgt_lang, count(*) AS entries FROM m GROUP BY ALL")
def memory_counts(spark, at):
    return ledger.entry_counts(_memory(spark, at))


_QUEUE_SQL = """q AS (SELECT o_orderkey AS job_id, o_custkey % 20 AS tenant_id, (o_orderkey % 5)::INT AS priority, ['queued','running','failed','cancelled','completed'][o_orderkey % 5 + 1] AS status, 'w' || o_orderkey % 3 AS worker_id,
  (o_orderkey % 4)::INT AS attempts, 3 AS max_attempts, epoch(o_orderdate)::DOUBLE AS enqueued_at, epoch(o_orderdate)::DOUBLE AS heartbeat_at, epoch(o_orderdate) + 60.0::DOUBLE AS lease_expires_at FROM orders)"""


def _queue(spark, at):
    return table(spark, at, "orders").selectExpr(
        "o_orderkey AS job_id", "o_custkey % 20 AS tenant_id", "int(o_orderkey % 5) AS priority", "array('queued','running','failed','cancelled','completed')[int(o_orderkey % 5)] AS status", "concat('w', o_orderkey % 3) AS worker_id",
        "int(o_orderkey % 4) AS attempts", "3 AS max_attempts", "double(unix_timestamp(o_orderdate)) AS enqueued_at", "double(unix_timestamp(o_orderdate)) AS heartbeat_at", "double(unix_timestamp(o_orderdate) + 60) AS lease_expires_at",
    )


@query(f"WITH {_QUEUE_SQL} SELECT job_id, status, enqueued_at FROM q WHERE status <> 'completed' ORDER BY enqueued_at DESC, job_id LIMIT 40")
def latest_jobs(spark, at):
    return ledger.list_jobs(_queue(spark, at), 40, F.col("status") != "completed").select("job_id", "status", "enqueued_at")


@query(f"""WITH {_QUEUE_SQL}, n AS (SELECT o_orderkey + 3 * (o_orderkey % 2) * 10000000 AS job_id, (o_custkey % 20) + (o_orderkey % 7 = 0)::INT AS tenant_id, 9 AS priority, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 = 0),
r AS (SELECT (SELECT count(*) FROM orders) // 4 AS most, count(*) AS queued FROM q WHERE status = 'queued'), fresh AS (SELECT n.*, row_number() OVER (ORDER BY seq, job_id) AS place FROM n WHERE job_id NOT IN (SELECT job_id FROM q))
SELECT q.job_id, CASE WHEN n.job_id IS NOT NULL AND q.status IN ('failed', 'cancelled') AND n.tenant_id = q.tenant_id THEN 'queued' ELSE q.status END AS status,
  CASE WHEN n.job_id IS NOT NULL AND q.status IN ('failed', 'cancelled') AND n.tenant_id = q.tenant_id THEN 0 ELSE attempts END::INT AS attempts,
  CASE WHEN n.job_id IS NOT NULL AND q.status IN ('failed', 'cancelled') AND n.tenant_id = q.tenant_id THEN 9 ELSE q.priority END::INT AS priority FROM q LEFT JOIN n USING (job_id)
UNION ALL SELECT job_id, 'queued', 0, 9 FROM fresh, r WHERE place <= most - queued""")
def enqueued(spark, at):
    orders = table(spark, at, "orders")
    news = orders.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey + 3 * (o_orderkey % 2) * 10000000 AS job_id", "(o_custkey % 20) + int(o_orderkey % 7 = 0) AS tenant_id", "9 AS priority", "o_orderkey AS at")
    return ledger.enqueue(_queue(spark, at), news, 2e9, orders.count() // 4).select("job_id", "status", "attempts", "priority")


@query(f"""WITH {_QUEUE_SQL} SELECT job_id, CASE WHEN status = 'running' AND worker_id = 'w1' THEN 1000.0 ELSE heartbeat_at END::DOUBLE AS heartbeat_at, CASE WHEN status = 'running' AND worker_id = 'w1' THEN 1060.0 ELSE lease_expires_at END::DOUBLE AS lease_expires_at FROM q""")
def heartbeats(spark, at):
    q = _queue(spark, at)
    return ledger.heartbeat(q, q.select("job_id", F.lit("w1").alias("worker_id")), 1000.0).select("job_id", "heartbeat_at", "lease_expires_at")


@query(f"""WITH {LINES}, r AS (SELECT CASE WHEN spine_index % 4 = 0 THEN block_id || 'x' ELSE block_id END AS block_id, CASE WHEN spine_index % 4 = 1 THEN 'T: ' || source_text || ' ' ELSE 'new' END AS text, spine_index % 7 = 3 AS other, spine_index % 4 = 0 AS lost, 'T: ' || source_text AS old FROM b)
SELECT block_id, text, CASE WHEN other THEN 'unbound' WHEN lost THEN 'unknown' WHEN trim(text) = trim(old) THEN 'unchanged' ELSE 'applied' END AS state FROM r""")
def imported_revisions(spark, at):
    b = doc_blocks(spark, at).withColumns({"job_id": F.lit("j"), "target_text": F.concat(F.lit("T: "), "source_text")})
    i = F.col("spine_index")
    rev = b.select(
        F.when(i % 4 == 0, F.concat("block_id", F.lit("x"))).otherwise(F.col("block_id")).alias("block_id"), F.when(i % 4 == 1, F.concat(F.lit("T: "), "source_text", F.lit(" "))).otherwise(F.lit("new")).alias("text"),
        F.when(i % 7 == 3, F.lit("other")).when(i % 2 == 0, F.lit("j")).alias("job_id"),
    )
    return ledger.import_revisions(b.select("block_id", "job_id", "target_text"), rev, F.lit("j"))


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN (event_id % 100)::VARCHAR END AS before, 'v' || event_id AS after_, CASE WHEN event_id % 3 <> 0 THEN 2 ELSE 1 END::INT AS keys FROM events""")
def job_metadata(spark, at):
    e = table(spark, at, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.to_json(F.struct(F.lit("x").alias("other"), (F.col("event_id") % 100).cast("string").alias("mode")))).alias("meta"))
    after = ledger.with_metadata(F.col("meta"), "mode", F.concat(F.lit("v"), "event_id"))
    return e.select("event_id", ledger.metadata_value(F.col("meta"), "mode").alias("before"), ledger.metadata_value(after, "mode").alias("after_"), F.size(F.from_json(after, "map<string,string>")).alias("keys"))


@query("""WITH u AS (SELECT user_id AS job_id, event_type AS model, sum(event_id)::BIGINT AS prompt, count(*) AS calls FROM events GROUP BY ALL), d AS (SELECT user_id AS job_id, 'extra' AS model, count(*)::BIGINT AS calls FROM events GROUP BY ALL)
SELECT job_id, model, sum(prompt)::BIGINT AS prompt, sum(calls)::BIGINT AS calls FROM (SELECT * FROM u UNION ALL SELECT * FROM u UNION ALL SELECT job_id, model, 0, calls FROM d) GROUP BY ALL""")
def job_bills(spark, at):
    e = table(spark, at, "events")
    u = e.groupBy(F.col("user_id").alias("job_id"), F.col("event_type").alias("model")).agg(F.sum("event_id").alias("prompt"), F.count(F.lit(1)).alias("calls"))
    return ledger.merged_usage(u, u, e.groupBy(F.col("user_id").alias("job_id"), F.lit("extra").alias("model")).agg(F.count(F.lit(1)).alias("calls")))


@query("""WITH h AS (SELECT l_orderkey AS block_id, 't' || l_partkey % 7 AS source, 'e' || l_partkey % 7 AS expected FROM lineitem WHERE l_linenumber % 3 = 0), t AS (SELECT block_id, source, min(expected) AS expected FROM h GROUP BY ALL),
c AS (SELECT DISTINCT block_id FROM t ORDER BY block_id LIMIT 200) SELECT block_id, source, expected, 'terminology_consistency:major:render ''' || source || ''' as ''' || expected || '''' AS flag FROM t JOIN c USING (block_id)""")
def consistency_tasks(spark, at):
    h = table(spark, at, "lineitem").selectExpr("l_orderkey AS block_id", "concat('t', l_partkey % 7) AS source", "concat('e', l_partkey % 7) AS expected", "l_linenumber % 3 <> 0 AS exact")
    return ledger.consistency_tasks(h, 200)


@query("""SELECT l_returnflag AS direction, count(*) AS samples, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS passed, round_even(count(*) FILTER (WHERE l_linenumber % 3 <> 0) * 100.0::DOUBLE / count(*), 1) AS pass_rate, round_even(avg(l_quantity), 4) AS avg_composite,
  round_even(avg(l_linenumber), 4) AS avg_bleu, round_even(count(*) FILTER (WHERE l_linenumber % 2 = 0) * 100.0::DOUBLE / count(*), 1) AS polarity_rate, count(*) FILTER (WHERE l_linenumber % 3 = 0) AS critical, count(*) FILTER (WHERE l_linenumber % 3 = 1) AS major, 0::BIGINT AS minor FROM lineitem GROUP BY l_returnflag""")
def pair_summaries(spark, at):
    r = table(spark, at, "lineitem").selectExpr("l_returnflag AS direction", "l_linenumber % 3 <> 0 AS passed", "l_quantity AS composite", "double(l_linenumber) AS bleu", "l_linenumber % 2 = 0 AS polarity_kept", "array('critical','major','none')[l_linenumber % 3] AS severity")
    return ledger.pair_summary(r)


@query("""WITH k AS (SELECT event_id AS run_id, ['recall', 'cost', 'odd'][event_id % 3 + 1] AS name, CASE WHEN event_id % 10 = 0 THEN 'nan'::DOUBLE ELSE event_id % 100 / 100.0::DOUBLE END AS value FROM events)
SELECT run_id, name, CASE WHEN event_id_bad THEN 0 ELSE value END AS value, violation FROM (SELECT run_id, name, value, isnan(value) AS event_id_bad, CASE WHEN isnan(value) THEN 'non-finite' WHEN name = 'recall' AND value < 0.3 THEN 'below floor' WHEN name = 'cost' AND value > 0.8 THEN 'above ceiling' END AS violation FROM k WHERE name <> 'odd') WHERE violation IS NOT NULL""")
def kpi_bounds(spark, at):
    k = table(spark, at, "events").selectExpr("event_id AS run_id", "array('recall','cost','odd')[int(event_id % 3)] AS name", "CASE WHEN event_id % 10 = 0 THEN double('NaN') ELSE event_id % 100 / 100.0D END AS value")
    bounds = spark.createDataFrame([("recall", 0.3, None), ("cost", None, 0.8)], "name string, floor double, ceiling double")
    return ledger.out_of_bounds(k, bounds).withColumn("value", F.nanvl("value", F.lit(0.0)))


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 10 AS total, o_orderkey % 6 AS delivered, o_orderkey % 3 AS verbatim, o_orderkey % 4 AS kept, o_orderkey % 5 AS errors, o_orderkey % 2 AS missing FROM orders),
x AS (SELECT id, errors > CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS a, missing > 0 AS b, id % 3 = 0 AND kept > 1 AS c, CASE WHEN total > 0 THEN (delivered + verbatim) / total::DOUBLE ELSE 1 END < 0.9 AS d, id % 5 = 0 AND CASE WHEN total > 0 THEN delivered / total::DOUBLE ELSE 1 END < 0.5 AS e FROM r)
SELECT id, concat_ws(',', CASE WHEN a THEN 'max_errors' END, CASE WHEN b THEN 'max_missing_assets' END, CASE WHEN c THEN 'max_source_kept' END, CASE WHEN d THEN 'min_accounted_ratio' END, CASE WHEN e THEN 'min_delivered_ratio' END) AS failures FROM x""")
def expectation_failures(spark, at):
    r = table(spark, at, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey % 10 AS total", "o_orderkey % 6 AS delivered", "o_orderkey % 3 AS verbatim", "o_orderkey % 4 AS source_kept", "o_orderkey % 5 AS errors", "o_orderkey % 2 AS missing_assets",
        "CASE WHEN o_orderkey % 2 = 0 THEN 2 END AS max_errors", "int(null) AS max_missing_assets", "CASE WHEN o_orderkey % 3 = 0 THEN 1 END AS max_source_kept", "0.9D AS min_accounted_ratio", "CASE WHEN o_orderkey % 5 = 0 THEN 0.5D END AS min_delivered_ratio",
    )
    return ledger.expectation_failures(r).select("id", F.array_join("failures", ",").alias("failures"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat_ws(',', CASE WHEN o_orderkey % 3 = 0 THEN 'lang' END, 'pages', CASE WHEN o_orderkey % 2 = 0 THEN 'provider' END) END AS keys FROM orders""")
def resubmissions(spark, at):
    o = table(spark, at, "orders")
    k = F.col("o_orderkey")
    prior = F.when(k % 4 != 0, F.create_map(F.lit("lang"), F.lit("zh"), F.lit("provider"), F.lit("a"), F.lit("dry_run"), F.lit("no")))
    asked = F.create_map(F.lit("lang"), F.when(k % 3 == 0, F.lit("ja")).otherwise(F.lit("zh")), F.lit("provider"), F.when(k % 2 == 0, F.lit("b")).otherwise(F.lit("a")), F.lit("pages"), F.lit("1-3"), F.lit("dry_run"), F.lit("yes"))
    return o.select(k.alias("id"), F.array_join(ledger.differing_keys(prior, asked), ",").alias("keys"))


@query("""SELECT event_id, sha256('{"i": ["' || event_type || '", "' || user_id || '"], "k": "draft", "p": {"a": "x\\"y", "n": "' || event_id % 7 || '"}}') AS key FROM events""")
def step_keys(spark, at):
    e = table(spark, at, "events")
    params = F.create_map(F.lit("n"), (F.col("event_id") % 7).cast("string"), F.lit("a"), F.lit('x"y'))
    return e.select("event_id", ledger.step_key(F.lit("draft"), F.array("event_type", F.col("user_id").cast("string")), params).alias("key"))


# ---- scopes -------------------------------------------------------------------------------------------------------

_SCOPES = ["*", "chapter:2", "ch3", "4", "section:2.1", "sec: Methods", "block:B7", "domain:LAW", "odd", "chapter: intro", None]


@query(f"""WITH s(i, spec) AS (VALUES {", ".join(f"({i}, {'NULL' if x is None else repr(x)})" for i, x in enumerate(_SCOPES))}), c AS (SELECT event_id, event_id % 5 AS chapter, 'b' || event_id % 9 AS block, '2.' || event_id % 3 AS section, ['law', 'tech'][event_id % 2 + 1] AS domain FROM events)
SELECT spec, count(*) AS blocks, count(*) FILTER (WHERE CASE i WHEN 1 THEN chapter = 2 WHEN 2 THEN chapter = 3 WHEN 3 THEN chapter = 4 WHEN 4 THEN section = '2.1' WHEN 5 THEN event_id % 3 = 0 WHEN 6 THEN block = 'b7' WHEN 7 THEN domain = 'law' WHEN 9 THEN chapter = 0 ELSE true END) AS covered
FROM c JOIN s ON true GROUP BY spec""")
def scope_coverage(spark, at):
    specs = spark.createDataFrame([(x,) for x in _SCOPES], "spec string")
    e = table(spark, at, "events").selectExpr("event_id % 5 AS chapter", "concat('b', event_id % 9) AS block", "concat('2.', event_id % 3) AS section", "array('law','tech')[int(event_id % 2)] AS domain", "CASE WHEN event_id % 3 = 0 THEN 'The methods' END AS title", "CASE WHEN event_id % 5 = 0 THEN 'Introduction' END AS head")
    context = {"block_id": F.col("block"), "section_index": F.col("section"), "section_title": F.col("title"), "chapter_index": F.col("chapter"), "chapter_title": F.col("head"), "domain": F.col("domain")}
    rows = e.select(F.explode(F.array(*[F.struct(F.lit(x).cast("string").alias("spec"), scope.covers(F.lit(x).cast("string"), context).alias("hit")) for x in _SCOPES])).alias("x"))
    del specs
    return rows.groupBy("x.spec").agg(F.count(F.lit(1)).alias("blocks"), F.count_if("x.hit").alias("covered"))


@query("""WITH g(source, translation, scope, lvl, priority, frequency) AS (VALUES ('Term', 'A', '*', 1, 5, 1), ('term', 'B', 'chapter:2', 3, 1, 1), ('Word', 'C', '*', 1, 3, 9), ('word', 'D', '*', 1, 4, 1), ('Tie', 'E', '*', 1, 1, 2), ('tie', 'F', '*', 1, 1, 3), ('Same', 'G', '*', 1, 1, 1), ('same', 'H', '*', 1, 1, 1), ('Lone', 'I', 'domain:law', 2, 0, 0)),
c AS (SELECT event_id, event_id % 5 AS chapter, ['law', 'tech'][event_id % 2 + 1] AS domain FROM events),
m AS (SELECT event_id, lower(source) AS k, g.* FROM c JOIN g ON scope = '*' OR (scope = 'chapter:2' AND chapter = 2) OR (scope = 'domain:law' AND domain = 'law')),
r AS (SELECT *, row_number() OVER w AS n, lead(lvl) OVER w AS l2, lead(priority) OVER w AS p2, lead(frequency) OVER w AS f2, count(*) OVER (PARTITION BY event_id, k) - 1 AS rivals FROM m WINDOW w AS (PARTITION BY event_id, k ORDER BY lvl DESC, priority DESC, frequency DESC, translation))
SELECT event_id, source, translation, scope, CASE WHEN l2 IS NULL THEN 'only' WHEN lvl > l2 THEN 'resolved_by_scope' WHEN priority > p2 THEN 'resolved_by_priority' WHEN frequency > f2 THEN 'resolved_by_frequency' ELSE 'unresolved_ambiguous' END AS verdict, rivals FROM r WHERE n = 1""")
def effective_glossary(spark, at):
    rows = [("Term", "A", "*", 5, 1), ("term", "B", "chapter:2", 1, 1), ("Word", "C", "*", 3, 9), ("word", "D", "*", 4, 1), ("Tie", "E", "*", 1, 2), ("tie", "F", "*", 1, 3), ("Same", "G", "*", 1, 1), ("same", "H", "*", 1, 1), ("Lone", "I", "domain:law", 0, 0)]
    entries = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("source", "translation", "scope", "priority", "frequency"), r, strict=True)]) for r in rows]))
    e = table(spark, at, "events").select("event_id", (F.col("event_id") % 5).alias("chapter"), F.when(F.col("event_id") % 2 == 0, "law").otherwise("tech").alias("domain"), entries.alias("g")).select("event_id", "chapter", "domain", "g.*")
    none = F.lit(None).cast("string")
    context = {"block_id": none, "section_index": none, "section_title": none, "chapter_index": F.col("chapter"), "chapter_title": none, "domain": F.col("domain")}
    return scope.effective(e, ["event_id"], context)


# ---- columns of pages ---------------------------------------------------------------------------------------------

_BOXES = "bx AS (SELECT l_orderkey AS page, l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id, l_quantity * 10 AS x0, l_quantity * 10 + CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey % 300 END AS x1 FROM lineitem), tr(track, t0, t1) AS (VALUES (0, 0.0, 250.0), (1, 260.0, 500.0))"


def _boxes(spark, at):
    b = table(spark, at, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey AS box_id", "l_quantity * 10 AS x0", "l_quantity * 10 + CASE WHEN l_linenumber = 1 THEN 0 ELSE l_partkey % 300 END AS x1")
    return b, b.select("page").distinct().selectExpr("page", "inline(array(struct(0 AS track, 0.0D AS t0, 250.0D AS t1), struct(1 AS track, 260.0D AS t0, 500.0D AS t1)))")


_HITS = f"""{_BOXES}, sh AS (SELECT page, box_id, x1, track, t1, CASE WHEN x1 > x0 THEN greatest(least(x1, t1) - greatest(x0, t0), 0) / (x1 - x0) ELSE 0 END AS s FROM bx JOIN tr ON true),
h AS (SELECT page, box_id, min(track) AS track, min(t1) AS t1, min(x1) AS x1 FROM sh WHERE s >= 0.2 GROUP BY ALL HAVING count(*) = 1)"""


@query(f"WITH {_HITS} SELECT bx.page, bx.box_id, h.track FROM bx LEFT JOIN h USING (page, box_id)")
def column_lines(spark, at):
    return layout.assign_lines(*_boxes(spark, at)).select("page", "box_id", "track")


@query(f"WITH {_HITS} SELECT page, box_id, track, (x1 - t1)::DOUBLE AS overrun FROM h WHERE x1 - t1 > 0.5")
def column_overruns(spark, at):
    return layout.overruns(*_boxes(spark, at))


@query("""WITH b AS (SELECT l_suppkey AS page, l_linenumber AS row_, l_quantity * 10 AS x0, l_quantity * 10 + l_partkey % 20 AS x1 FROM lineitem),
r AS (SELECT *, max(x1) OVER (PARTITION BY page, row_ ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b), c AS (SELECT *, CASE WHEN x0 - reach > 12 THEN 1 ELSE 0 END AS cut FROM r),
p AS (SELECT *, sum(cut) OVER (PARTITION BY page, row_ ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS part FROM c) SELECT page, row_ AS "row", part::BIGINT AS part, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM p GROUP BY page, row_, part""")
def merged_rows(spark, at):
    b = table(spark, at, "lineitem").selectExpr("l_suppkey AS page", "l_linenumber AS row", "l_quantity * 10 AS x0", "l_quantity * 10 + l_partkey % 20 AS x1")
    return layout.row_fragments(b)
