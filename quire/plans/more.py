"""More queries: skip rules, formulas, slots, runs, boxes, replies, images, signals, domains, samples, prices; each with SQL that states the expected rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import marks, names, skip
from quire.operators import layout, order, signals
from quire.plans.catalogue import LINES, doc_blocks, query, table
from quire.sources import sinks


def _cases(rows: list[tuple], n: int) -> str:
    """VALUES of the last n columns of rows, numbered."""
    value = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join(f"({i}, {', '.join(value(v) for v in r[-n:])})" for i, r in enumerate(rows))


def _pick(rows: list[tuple], k: int, by: str = "event_id"):
    return F.element_at(F.array(*[F.lit(r[k]) for r in rows]), (F.col(by) % len(rows) + 1).cast("int"))


#: Texts that some rule keeps as they are, or nearly; why.
_SKIPS = [
    ("@techNmak follows", "handle"), ("Vaswani, A. et al. Attention is all you need. In Proceedings of NeurIPS, pages 5998-6008, 2017.", "bibliography"), ("see arXiv:1706.03762 for more", "bibliography"),
    ("[12] Smith, Title of it, 2019", "bibliography"), ("[12] We show that 2019 was good", None), ("Jane Doe 1, John Q. Public 2, Ann Li", "byline"), ("Purpose, Scope, and Audience", None), ("War and Peace", None),
    ("∗ Corresponding author. † Equal work", "identity"), ("DeepMind ‡ Tsinghua University", "identity"), ("Contact: someone@example.org, Institute of Things", "identity"), ("12 34 + 5", "debris"), ("12 34 文", None), ("", None),
    ("According to Smith et al. (2019), this paper relies on Springer", None), ("B. Murmann, “ADC survey,” 1997.", "bibliography"), ("Plain words in a line", None), ("Python documentation, accessed May 2021", "bibliography"),
    ("K. Lee, IEEE Access 12 (3), 45-67, 2020", "bibliography"), ("Smith, J. https://example.org 2020", "bibliography"), ("J. Doe wrote in 2020", None), ("P. Norvig. Artificial Intelligence, Pearson, 2010", "bibliography"),
]


@query(f"WITH t(i, why) AS (VALUES {_cases(_SKIPS, 1)}) SELECT event_id, why, CASE WHEN why NOT IN ('byline', 'identity') THEN why END AS in_heading FROM events JOIN t ON event_id % {len(_SKIPS)} = i")
def skip_reasons(spark, at):
    e = table(spark, at, "events").select("event_id", _pick(_SKIPS, 0).alias("t"))
    return e.select("event_id", skip.skip_kind(F.col("t")).alias("why"), skip.skip_kind(F.col("t"), F.lit(True)).alias("in_heading"))


@query(f"WITH {LINES} SELECT block_id, CASE WHEN spine_index % 2 = 0 THEN 'bibliography' END AS why FROM b WHERE regexp_matches(source_text, '^[a-z]{{3,}}')")
def skipped_lines(spark, at):
    """Lines of prose in and out of a bibliography."""
    b = doc_blocks(spark, at).filter(F.col("source_text").rlike("^[a-z]{3,}"))
    plain = F.regexp_replace("source_text", "(?s)^([a-z]{3,}).*$", "$1 plain words")
    return b.select("block_id", skip.skip_kind(plain, None, F.col("spine_index") % 2 == 0).alias("why"))


#: Formulas: source, target, first phrase that may be translated, whether the skeleton holds, whether it is the same, commands that are new.
_FORMULAS = [
    (r"x = \text{if it holds} + y", r"x = \text{若成立} + y", "if it holds", 1, 0, ""), (r"x = \text{a} + y", r"x=\text{a}+y", "", 1, 1, ""), (r"\mathrm{max} f", r"\text{max} f", "", 0, 0, "text"),
    (r"a + b", r"a + c", "", 0, 0, ""), (r"\text{rate of \alpha} x", r"\text{x} x", "", 1, 0, ""), (r"\text{phase 2 of} x", r"\weird{x}", "", 0, 0, "weird"), (r"\mbox {for all x}", r"\mbox{for all x}", "for all x", 1, 1, ""), ("", "", "", 1, 1, ""),
]


@query(f"WITH t(i, phrase, holds, same, novel) AS (VALUES {_cases(_FORMULAS, 4)}) SELECT event_id, phrase, holds = 1 AS holds, same = 1 AS same, novel FROM events JOIN t ON event_id % {len(_FORMULAS)} = i")
def formula_checks(spark, at):
    e = table(spark, at, "events").select("event_id", _pick(_FORMULAS, 0).alias("s"), _pick(_FORMULAS, 1).alias("t"))
    s, t = F.col("s"), F.col("t")
    return e.select(
        "event_id", F.array_join(F.slice(marks.translatable_texts(s), 1, 1), "").alias("phrase"), marks.skeleton_holds(s, t).alias("holds"),
        marks.formula_intact(F.lit("formula"), s, t).alias("same"), F.array_join(marks.novel_commands(s, t, F.array(F.lit("frac"))), ",").alias("novel"),
    )


#: Replies of judges and their scores; texts with single letters and their share.
_REPLIES = [
    ('{"score": 85}', 0.85, "a b c", 2 / 3), ("Score: 90/100", 0.9, "P. Zijlstra and D. Guo wrote", 0.0), ("**score** = 0.73", 0.73, "K V x text", 0.75), (" 7 / 10 ", 0.7, "I am A man", 0.0), ("1", 0.01, "", 0.0), ("no idea", None, "12 34", 0.0),
    ("250", 1.0, "x", 1.0), ("", None, "prose words here", 0.0), ('{"score": "bad"} score: 5/0', 0.0, "a I", 0.0),
]


@query(f"WITH r(i, score, t, share) AS (VALUES {_cases(_REPLIES, 3)}) SELECT event_id, score::DOUBLE AS score, share::DOUBLE AS singles FROM events JOIN r ON event_id % {len(_REPLIES)} = i")
def judge_replies(spark, at):
    e = table(spark, at, "events").select("event_id", _pick(_REPLIES, 0).alias("r"), _pick(_REPLIES, 2).alias("t"))
    return e.select("event_id", marks.judge_score(F.col("r")).alias("score"), marks.debris_share(F.col("t")).alias("singles"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'S2' ELSE '' END AS missing, CASE WHEN event_id % 4 = 0 THEN 'S9' ELSE '' END AS hallucinated, event_id % 3 <> 0 AND event_id % 4 <> 0 AS valid,
  CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END::INT AS runs, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'w' || event_id END AS bold, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END::INT AS boxes FROM events""")
def slots_runs_boxes(spark, at):
    """Slots that drafts keep, and emphasis runs and chains of boxes through JSON and back, some of it malformed."""
    i = F.col("event_id")
    observed = F.map_concat(F.create_map(F.lit("S1"), F.lit(1), F.lit("S2"), F.when(i % 3 == 0, 0).otherwise(2)), F.when(i % 4 == 0, F.create_map(F.lit("S9"), F.lit(1))).otherwise(F.create_map().cast("map<string,int>")))
    seen = F.map_filter(observed, lambda _, n: n > 0)
    run = lambda t, b: F.struct(t.alias("text"), F.lit(b).alias("bold"), F.lit(not b).alias("italic"))
    runs = F.when(i % 5 == 0, F.lit("{not json")).otherwise(marks.runs_json(F.array(run(F.concat(F.lit("w"), i), True), run(F.lit("x"), False))))
    box = lambda page: F.struct(page.cast("int").alias("page"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("bbox"))
    boxes = F.when(i % 2 == 0, marks.boxes_json(F.array(box(i), box(i + 1)))).when(i % 3 == 0, marks.boxes_json(F.array(box(i)))).otherwise(F.lit('[{"page": 1}, {"bbox": [1]}]'))
    out = table(spark, at, "events").select("event_id", marks.slots(F.array(F.lit("S1"), F.lit("S2")), seen).alias("s"), marks.runs_of(runs).alias("r"), marks.boxes_of(boxes).alias("b"))
    return out.select(
        "event_id", F.array_join("s.missing", ",").alias("missing"), F.array_join("s.hallucinated", ",").alias("hallucinated"), "s.valid", F.size("r").alias("runs"),
        F.array_join(F.transform(F.filter("r", lambda x: x["bold"]), lambda x: x["text"]), ",").alias("bold"), F.size("b").alias("boxes"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'a.png' WHEN event_id % 3 = 1 THEN '' ELSE 'md:b.png' END AS missing, CASE WHEN event_id % 2 = 0 THEN 'c.png' ELSE '' END AS extra, CASE WHEN event_id % 5 = 0 THEN 'http://x.org/' || event_id ELSE '' END AS links FROM events""")
def markup_deltas(spark, at):
    i = F.col("event_id")
    link = F.concat(F.lit('<a class="k" href="http://x.org/'), i, F.lit('">x</a>'))
    source = F.concat(F.lit('<p><img src="a.png" alt="x"> and <img src="a.png"/> ![b](b.png "t") '), link)
    pictures = F.when(i % 3 == 0, F.lit('<img src="a.png"> ![b](b.png)')).when(i % 3 == 1, F.lit("<img src='a.png'><img src='a.png'> ![b](b.png)")).otherwise(F.lit('<img src="a.png"><img src="a.png">'))
    target = F.concat(pictures, F.when(i % 2 == 0, F.lit('<IMG SRC="c.png">')).otherwise(F.lit("")), F.when(i % 5 == 0, F.lit("x")).otherwise(link))
    out = table(spark, at, "events").select("event_id", marks.image_delta(source, target).alias("d"), marks.lost_links(source, target).alias("l"))
    return out.select("event_id", F.array_join("d.missing", ",").alias("missing"), F.array_join("d.extra", ",").alias("extra"), F.array_join("l", ",").alias("links"))


_TYPES = ("heading", "narrative", "formula", "table", "list_item", "code", "dialogue", "image")
_TYPED = f"{LINES}, k AS (SELECT doc_id, spine_index, source_text, [{', '.join(repr(t) for t in _TYPES)}][(spine_index * 3 + doc_id) % 8 + 1] AS block_type, spine_index // 4 + 1 AS page, spine_index % 6 = 0 AS skip_translate FROM b)"


def _typed(spark, at):
    kinds = "array(" + ",".join(repr(t) for t in _TYPES) + ")"
    return doc_blocks(spark, at).selectExpr("doc_id", "spine_index", "source_text", f"{kinds}[int((spine_index * 3 + doc_id) % 8)] AS block_type", "spine_index div 4 + 1 AS page", "spine_index % 6 = 0 AS skip_translate")


@query(f"""WITH {_TYPED} SELECT doc_id, count(*) AS blocks, max(page)::BIGINT AS pages, count(*) FILTER (WHERE block_type IN ('formula', 'table', 'image', 'code')) / max(page)::DOUBLE AS interruption, count(*) FILTER (WHERE block_type IN ('formula', 'table', 'image', 'code')) / count(*)::DOUBLE AS struct_share,
  count(*) FILTER (WHERE skip_translate) / count(*)::DOUBLE AS skip_share, count(*) FILTER (WHERE length(trim(source_text)) < 25) / count(*)::DOUBLE AS fragment_share, sum(CASE WHEN block_type IN ('narrative', 'heading', 'list_item', 'dialogue') THEN length(source_text) ELSE 0 END) / sum(length(source_text))::DOUBLE AS prose_share FROM k GROUP BY doc_id""")
def layout_signals(spark, at):
    return signals.signals(_typed(spark, at), "doc_id")


@query(f"""WITH {_TYPED}, r AS (SELECT doc_id, spine_index, row_number() OVER (PARTITION BY doc_id ORDER BY CASE block_type WHEN 'formula' THEN 0 WHEN 'table' THEN 1 WHEN 'heading' THEN 2 ELSE 3 END, NOT contains(source_text, '$'), spine_index) AS n FROM k) SELECT doc_id, spine_index FROM r WHERE n <= 5""")
def preflight_samples(spark, at):
    return signals.preflight_sample(_typed(spark, at), "doc_id").select("doc_id", "spine_index")


@query(f"""WITH {_TYPED}, t AS (SELECT doc_id, ['trivial', 'standard', 'complex'][spine_index % 3 + 1] AS tier, length(source_text) AS tokens FROM k), c AS (SELECT doc_id, count(*) AS blocks, sum(tokens * CASE tier WHEN 'trivial' THEN 0.1 WHEN 'standard' THEN 0.5 ELSE 3 END / 1e6) AS cost, sum(tokens * 3 / 1e6) AS flagship_cost, count(*) FILTER (WHERE tier = 'complex') AS on_flagship FROM t GROUP BY doc_id)
SELECT *, flagship_cost - cost AS saved, round((flagship_cost - cost) / flagship_cost * 100, 2) AS saved_percent FROM c""")
def routed_costs(spark, at):
    rates = spark.createDataFrame([("trivial", 0.1), ("standard", 0.5), ("complex", 3.0)], "tier string, rate double")
    b = _typed(spark, at).selectExpr("doc_id", "array('trivial','standard','complex')[spine_index % 3] AS tier", "length(source_text) AS tokens")
    return signals.routed_cost(b, "doc_id", rates, "complex")


_RUNS = "r AS (SELECT o_orderkey AS run_id, o_custkey % 9 AS total, o_orderkey % 3 AS drifted, o_orderkey % 4 AS audited, o_orderkey % 5 AS lost, o_totalprice AS cost, o_orderkey % 7 * 1000 AS chars FROM orders)"


@query(f"""WITH {_RUNS} SELECT run_id, 'term_consistency' AS name, 1 - CASE WHEN audited > 0 THEN drifted / audited::DOUBLE ELSE 0 END AS value FROM r UNION ALL SELECT run_id, 'render_skip_rate', CASE WHEN total > 0 THEN lost / total::DOUBLE ELSE 0 END FROM r
UNION ALL SELECT run_id, 'render_preserved_rate', CASE WHEN total + 1 > 0 THEN 1 / (total + 1)::DOUBLE ELSE 0 END FROM r UNION ALL SELECT run_id, 'cost_per_1k_chars', CASE WHEN chars > 0 THEN cost / (chars / 1000.0) ELSE 0 END FROM r""")
def run_indicators(spark, at):
    r = table(spark, at, "orders").selectExpr(
        "o_orderkey AS run_id", "o_custkey % 9 AS total", "o_orderkey % 3 AS terms_drifted", "o_orderkey % 4 AS terms_audited", "o_orderkey % 5 AS fail_closed", "1 AS preserved", "0 AS repaired", "0 AS needs_human", "0 AS blocked_human",
        "0 AS critical", "0 AS major", "1 AS pages", "0 AS untranslated", "o_totalprice AS cost", "o_orderkey % 7 * 1000 AS chars",
    )
    return signals.indicators(r).filter(F.col("name").isin("term_consistency", "render_skip_rate", "render_preserved_rate", "cost_per_1k_chars"))


_FIELDS = [("", "general", 0.1), ("protein genome antibody enzyme", "biomedicine", 0.6), ("equity equity equity portfolio", "finance", 0.6), ("compiler latency", "general", 0.1), ("gradient " * 20, "computer_science", 1.0), ("MOSFET doping gate oxide source-drain bandgap", "semiconductor", 0.65), ("gene gene rna rna equity equity equity equity", "biomedicine", 0.6)]


@query(f"WITH t(i, domain, confidence) AS (VALUES {_cases(_FIELDS, 2)}) SELECT doc_id, domain, confidence::DOUBLE AS confidence FROM documents JOIN t ON doc_id % {len(_FIELDS)} = i")
def document_domains(spark, at):
    """Texts without the letters that field words have, and such words added."""
    text = F.concat(F.translate(F.coalesce("text", F.lit("")), "aeiouvtAEIOUVT", ""), F.lit(" "), _pick(_FIELDS, 0, "doc_id"))
    return table(spark, at, "documents").select("doc_id", signals.domain(text).alias("d")).select("doc_id", "d.*")


@query("""SELECT p_partkey, round_even(((13000 - 4550) * p_size + 4550 * p_size / 10.0 + 10000 * p_retailprice / 7.0) / 1e6, 4) AS cost_usd FROM part""")
def model_costs(spark, at):
    m = table(spark, at, "part").selectExpr("p_partkey", "double(p_size) AS input", "p_size / 10.0D AS cached_input", "p_retailprice / 7.0D AS output")
    return signals.model_points(m).select("p_partkey", "cost_usd")


@query(f"""WITH {LINES} SELECT doc_id, string_agg(CASE WHEN spine_index % 4 = 0 THEN '## ' || source_text WHEN spine_index % 4 = 1 THEN '* ' || source_text ELSE source_text END, chr(10) || chr(10) ORDER BY spine_index) || chr(10) AS content FROM b GROUP BY doc_id""")
def written_markdown(spark, at):
    i = F.col("spine_index") % 4
    b = doc_blocks(spark, at).withColumns({"block_type": F.when(i == 0, "heading").when(i == 1, "list_item").otherwise("paragraph"), "level": F.lit(2), "marker": F.when(i == 1, "*")})
    return sinks.markdown(b, F.col("source_text"))


@query()
def page_samples(spark, at):
    """Pages to look at of documents of as many pages as an order's key, with flagged ones."""
    o = table(spark, at, "orders").select("o_orderkey", (F.col("o_orderkey") % 400).cast("int").alias("total"), F.array((F.col("o_custkey") % 500).cast("int"), F.lit(7)).alias("flagged"))
    return o.select("o_orderkey", F.array_join(names.sample_pages(F.col("total"), F.col("flagged"), (F.col("o_orderkey") % 9).cast("int")), ",").alias("pages"))


# ---- terminology --------------------------------------------------------------------------------------------------

#: Pairs with what becomes of the term deep learning (DL), rendered Tiefenlernen or Tiefen-Lernens.
_PAIRS = [
    ("On deep learning now", "Zu Tiefenlernen jetzt", "rendered"), ("Deep Learning works", "Es wirkt", "drifted"), ("The DL way", "Der Weg des Tiefen-Lernens", "rendered"), ("The dl way", "Der Weg", None),
    ("deep  space learning", "x", None), ("On deep learning", "Zu “Tiefenlernen” hier", "protected"), ("See `deep learning` only", "x", None), ("deep learnings", "x", None), ("Of deep learning", "tiefenlernen.", "rendered"),
]


@query(f"WITH t(i, state) AS (VALUES {_cases(_PAIRS, 1)}) SELECT event_id AS block_id, 'deep learning' AS source, 'Tiefenlernen' AS expected, state FROM events JOIN t ON event_id % {len(_PAIRS)} = i WHERE state IS NOT NULL")
def term_drift(spark, at):
    from quire.operators import terminology

    pairs = table(spark, at, "events").select(F.col("event_id").alias("block_id"), _pick(_PAIRS, 0).alias("source_text"), _pick(_PAIRS, 1).alias("target_text"))
    glossary = spark.createDataFrame([("deep learning", "Tiefenlernen", ["DL"], ["Tiefen-Lernens"]), ("unseen", "nie", [], [])], "source string, translation string, aliases array<string>, inflected_variants array<string>")
    return terminology.term_drift(pairs, glossary)


#: Targets, and what enforcement makes of them.
_TARGETS = [
    ("The net is a neural net.", "The network is a neural network."), ("A NET and `net` and http://net.org", "A network and `net` and http://net.org"), ("Networks only", None), ("“net” quoted", None),
    ("neural network", None), ("使用机器学习法", "使用机器学习方法"), ("机器学习方法", None),
]


@query(f"WITH t(i, t) AS (VALUES {_cases(_TARGETS, 1)}) SELECT event_id AS block_id, t AS text FROM events JOIN t ON event_id % {len(_TARGETS)} = i WHERE t IS NOT NULL")
def enforced_terms(spark, at):
    from quire.operators import terminology

    blocks = table(spark, at, "events").select(F.col("event_id").alias("block_id"), _pick(_TARGETS, 0).alias("target_text"))
    variants = spark.createDataFrame([("net", "network"), ("neural net", "neural network"), ("机器学习法", "机器学习方法")], "surface string, canonical string")
    return terminology.wrong_surfaces(blocks, variants).select("block_id", "text")


_NAMED = f"{LINES}, n AS (SELECT doc_id, block_id, 'GPT-' || spine_index || ' and DATA, ' || CASE WHEN doc_id % 2 = 0 THEN 'Data' ELSE 'nothing' END || ' LSTM pagedAttention AI' AS t FROM b)"


@query(f"WITH {_NAMED} SELECT block_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [split_part(t, ' ', 1), 'LSTM', 'pagedAttention'] ELSE [split_part(t, ' ', 1), 'LSTM', 'pagedAttention', 'DATA'] END) AS term FROM n")
def identifier_terms(spark, at):
    """Lines with identifiers, and a word in capitals that every other document has in ordinary case too."""
    from quire.operators import terminology

    text = F.concat(F.lit("GPT-"), F.col("spine_index"), F.lit(" and DATA, "), F.when(F.col("doc_id") % 2 == 0, "Data").otherwise("nothing"), F.lit(" LSTM pagedAttention AI"))
    return terminology.identifiers(doc_blocks(spark, at).withColumn("source_text", text)).select("block_id", "term")


@query(rf"""WITH {LINES}, w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(source_text, '[^\x00-\x7F]', 'x', 'g'), '\b[A-Z][A-Z0-9]+\b', ' ', 'g'), '[A-Za-z]+')) AS w FROM b) SELECT doc_id, count(DISTINCT lower(w)) AS words FROM w GROUP BY doc_id""")
def document_words(spark, at):
    from quire.operators import terminology

    return terminology.vocabulary(doc_blocks(spark, at).withColumn("source_text", F.regexp_replace("source_text", r"[^\x00-\x7F]", "x"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"))


@query("""WITH g AS (SELECT p_name AS source, p_brand AS translation, ['term', 'person', 'place', 'work'][p_size % 4 + 1] AS kind, p_size AS frequency FROM part), r AS (SELECT *, row_number() OVER (ORDER BY kind NOT IN ('person', 'place'), frequency DESC, source, translation) AS place FROM g)
SELECT place::INT AS place, source, translation FROM r WHERE place <= 60""")
def glossary_sheet(spark, at):
    from quire.operators import terminology

    g = table(spark, at, "part").selectExpr("p_name AS source", "p_brand AS translation", "array('term','person','place','work')[p_size % 4] AS kind", "p_size AS frequency")
    return terminology.glossary_table(g, 60)


# ---- passages -----------------------------------------------------------------------------------------------------

_CAPTIONS = [
    ("Figure 3: Ablation studies. (a) Learning rate decay; (b) Batch size variation.", "Figure 3: Ablation studies.", "(a)|(b)", "Learning rate decay|Batch size variation."), ("图 2：结果（一）甲，（二）乙", "图 2：结果（一）甲，", "(二)", "乙"),
    ("Table 1: Plain", "Table 1: Plain", "", ""), ("a) first b) second", "", "(a)|(b)", "first|second"), ("Fig. 4: A: left; B: right", "Fig. 4", "(A)|(B)", "left|right"), ("", "", "", ""),
]


@query(f"WITH t(i, main, labels, texts) AS (VALUES {_cases(_CAPTIONS, 3)}) SELECT event_id, main, labels, texts FROM events JOIN t ON event_id % {len(_CAPTIONS)} = i")
def figure_captions(spark, at):
    from quire.functions import passages

    e = table(spark, at, "events").select("event_id", passages.caption_parts(_pick(_CAPTIONS, 0)).alias("c"))
    joined = lambda k: F.array_join(F.transform("c.parts", lambda p: p[k]), "|")
    return e.select("event_id", F.col("c.main").alias("main"), joined("label").alias("labels"), joined("text").alias("texts"))


_SENTENCES = [
    ("One is here. Two is there! Three?", "One is here.|Two is there!|Three?"), ("See Fig. 3 for it. Then go.", "See Fig. 3 for it.|Then go."), ("It is 0.85 now. Of 12. Items.", "It is 0.85 now.|Of 12. Items."), ("甲是。乙是！丙", "甲是。|乙是！|丙"),
    ("Smith et al. wrote (e.g. this). Yes.", "Smith et al. wrote (e.g. this).|Yes."), ("", ""), ("He said “so.” She left.", "He said “so.|She left."),
]


@query(f"WITH t(i, s) AS (VALUES {_cases(_SENTENCES, 1)}) SELECT event_id, s AS sentences FROM events JOIN t ON event_id % {len(_SENTENCES)} = i")
def split_sentences(spark, at):
    from quire.functions import passages

    return table(spark, at, "events").select("event_id", F.array_join(passages.sentences(_pick(_SENTENCES, 0)), "|").alias("sentences"))


_TERMS = [("本章主要讨论注意力机制", "注意力机制"), ("使用基于图的方法", "图的方法"), ("和平", "和平"), ("对比学习", "比学习"), ("该模型", "模型"), ("网络", "网络"), ("我们提出该", "提出该")]


@query(f"WITH t(i, s) AS (VALUES {_cases(_TERMS, 1)}) SELECT event_id, s AS core FROM events JOIN t ON event_id % {len(_TERMS)} = i")
def chinese_terms(spark, at):
    from quire.functions import passages

    return table(spark, at, "events").select("event_id", passages.term_core(_pick([(f" {a}", b) if k % 2 else (a, b) for k, (a, b) in enumerate(_TERMS)], 0)).alias("core"))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, spine_index, spine_index % 7 AS i FROM b), c AS (SELECT *, sum((i = 0)::INT) OVER (PARTITION BY doc_id ORDER BY spine_index)::BIGINT AS chapter FROM k)
SELECT doc_id, spine_index, chapter, CASE WHEN i = 1 THEN 'what it is' END AS abstract, CASE WHEN i = 2 THEN 'To be' END AS quote, CASE WHEN i = 2 THEN 'Ann' END AS source FROM c""")
def chapter_preambles(spark, at):
    """Lines as chapters of seven blocks: a heading, an abstract, a quotation, text, and a quotation that opens nothing."""
    i = F.col("spine_index") % 7
    text = F.when(i == 1, "Abstract: what it is").when(i.isin(2, 4), "To be — Ann").otherwise(F.concat(F.lit("plain "), F.regexp_replace("source_text", "[—–-]", " ")))
    out = layout.preamble(doc_blocks(spark, at).select("doc_id", "spine_index", text.alias("t")), "doc_id", i == 0, F.col("t"))
    return out.select("doc_id", "spine_index", "chapter", "abstract", "quote", "source")


@query(f"""WITH {LINES}, k AS (SELECT doc_id, spine_index // 6 AS g, count(*) FILTER (WHERE spine_index % 6 < 3 AND spine_index % 6 <= spine_index // 6 % 3) AS images, count(*) FILTER (WHERE spine_index % 6 = spine_index // 6 % 3 + 1) AS after_ FROM b GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g)::INT AS panel, images::INT AS images, images::INT AS columns, CASE WHEN after_ > 0 THEN 'Figure ' || g || ': All.' END AS caption,
  CASE WHEN images = 1 AND after_ > 0 THEN '(x)' WHEN images = 1 THEN '' WHEN images = 2 AND after_ > 0 THEN '(x),(b)' WHEN images = 2 THEN '(a),(b)' WHEN after_ > 0 THEN '(x),(b),(c)' ELSE '(a),(b),(c)' END AS labels FROM k WHERE images > 0""")
def figure_panels(spark, at):
    """Lines as groups of six blocks: one to three images, a caption with one part, and text."""
    i, g = F.col("spine_index") % 6, F.floor(F.col("spine_index") / 6)
    image = (i < 3) & (i <= g % 3)
    text = F.when(i == g % 3 + 1, F.concat(F.lit("Figure "), g.cast("string"), F.lit(": All. (x) part"))).otherwise("plain")
    out = layout.figure_panels(doc_blocks(spark, at), "doc_id", image, text)
    return out.withColumn("labels", F.array_join("labels", ","))


_BACK = [
    ("It costs 12 units of GPU9 today", "It costs 12 units of GPU9 today", "none", 1), ("It costs 12 units today", "It costs units today", "critical", 0), ("It is not safe here", "It is safe here", "major", 0), ("", "x", "critical", 0),
    ("The quick brown fox jumps", "Completely other words were said there", "minor", 0),
]


@query(f"WITH t(i, severity, passed) AS (VALUES {_cases(_BACK, 2)}) SELECT event_id, severity, passed = 1 AS passed FROM events JOIN t ON event_id % {len(_BACK)} = i")
def pair_verdicts(spark, at):
    from quire.functions import passages

    e = table(spark, at, "events").select("event_id", _pick(_BACK, 0).alias("s"), _pick(_BACK, 1).alias("b")).withColumn("x", passages.pair_scores()("s", "b"))
    return e.select("event_id", passages.pair_verdict(F.col("s"), F.col("b"), F.col("x")).alias("v")).select("event_id", "v.severity", "v.passed")


@query(f"""WITH {LINES} SELECT block_id, (spine_index % 10)::BIGINT AS kind FROM b WHERE spine_index % 10 NOT IN (7, 8)""")
def cleaned_lines(spark, at):
    """Lines in groups of ten: a list that counts on after a colon, a number out of order, noise, and a number beside it."""
    i, base = F.col("spine_index") % 10, 100_000 - F.floor(F.col("spine_index") / 10) * 100
    number = lambda k: (base + k).cast("string")
    text = (
        F.when(i == 0, "Items are these:").when(i == 1, number(1)).when(i == 3, number(2)).when(i == 5, number(7)).when(i == 7, "::: box").when(i == 8, number(5)).otherwise("A whole sentence here.")
    )
    b = doc_blocks(spark, at).select("doc_id", "spine_index", "block_id", text.alias("source_text"))
    return order.clean_lines(b).select("block_id", (F.col("spine_index") % 10).cast("long").alias("kind"))


@query(r"""WITH r(i, a, b) AS (VALUES (0, 'NET', 'neural'), (1, 'net', 'web'), (2, 'CPU', 'x'), (3, 'GPU', 'y')), t AS (SELECT o_orderkey AS doc, (o_orderkey % 4)::INT AS p, ((o_orderkey + 1) % 4)::INT AS q FROM orders)
SELECT doc, '| 原文 | 译文 |' || chr(10) || '|---|---|' || chr(10) || '| ' || x.a || ' | ' || x.b || ' |' || chr(10) || '| ' || y.a || ' | ' || y.b || ' |' AS merged FROM t JOIN r x ON x.i = p JOIN r y ON y.i = q""")
def merged_tables(spark, at):
    """Two rendered tables an order, which share a row."""
    from quire.operators import terminology

    rows = [("NET", "neural"), ("net", "web"), ("CPU", "x"), ("GPU", "y")]
    row = lambda k: F.element_at(F.array(*[F.lit(f"| {a} | {b} |") for a, b in rows]), ((F.col("o_orderkey") + k) % 4 + 1).cast("int"))
    head = F.lit("| 原文 | 译文 |\n|---|---|\n")
    o = table(spark, at, "orders")
    tables = F.array(F.concat(head, row(0)), F.concat(head, row(0), F.lit("\n"), row(1)))
    return o.select(F.col("o_orderkey").alias("doc"), terminology.merged_tables(tables).alias("merged"))
