"""Documents at a glance: layout signals, indicators, domains, routing and price simulations, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types of blocks, sample preferences, domain words, indicator names.
STRUCT_TYPES, PROSE_TYPES = ("formula", "table", "image", "code"), ("narrative", "heading", "list_item", "dialogue")
FRAGMENT_CHARS, SAMPLE_FIRST = 25, ("formula", "table", "heading")
DOMAINS = {
    "semiconductor": (
        r"\bfinfet\b", r"\bmosfet\b", r"\bsubthreshold\b", r"\bt_?fin\b", r"\bt_?ox\b", r"\bv_?ch\b", r"\bv_?ds\b", r"\bv_?gs\b", r"\bdoping\b", r"\bsemiconductor\b", r"\bcapacitance\b", r"\bbandgap\b",
        r"\bquasifermi\b", r"\bsource[- ]drain\b", r"\bgate (?:oxide|dielectric|length|leakage|voltage|stack)\b",
    ),
    "biomedicine": (
        r"\bprotein\b", r"\bgenome\b", r"\bantibody\b", r"\benzyme\b", r"\bcellular\b", r"\bpathway\b", r"\breceptor\b", r"\bassay\b", r"\bclinical\b", r"\bgene\b", r"\brna\b", r"\bdna\b", r"\bin vitro\b", r"\bin vivo\b",
    ),
    "finance": (
        r"\bequity\b", r"\bportfolio\b", r"\bdividend\b", r"\basset\b", r"\bvolatility\b", r"\barbitrage\b", r"\bbalance sheet\b", r"\bmacroeconomic\b", r"\binflation\b", r"\bfiscal\b", r"\bliquidity\b",
    ),
    "computer_science": (
        r"\bneural network\b", r"\btransformer\b", r"\bbackpropagation\b", r"\blatency\b", r"\bthroughput\b", r"\bcompiler\b", r"\bcuda\b", r"\balgorithm\b", r"\bgradient\b", r"\bconvolutional\b",
    ),
}
DOMAIN_HITS, INPUT_PER_WORD, CACHED_SHARE = 4, 1.3, 0.35


def signals(blocks: DataFrame, key: str) -> DataFrame:
    """By document (block_type, page, source_text, skip_translate): shares of structure, skipped blocks, fragments and prose, structural blocks a page."""
    t, text = F.col("block_type"), F.coalesce("source_text", F.lit(""))
    n, pages = F.count(F.lit(1)), F.greatest(F.coalesce(F.max(F.when(F.col("page") > 0, F.col("page"))), F.lit(1)), F.lit(1))
    struct, chars = F.count_if(t.isin(*STRUCT_TYPES)), F.sum(F.length(text))
    return blocks.groupBy(key).agg(
        n.alias("blocks"), pages.alias("pages"), (struct / pages).alias("interruption"), (struct / n).alias("struct_share"), (F.count_if(F.coalesce("skip_translate", F.lit(False))) / n).alias("skip_share"),
        (F.count_if(F.length(F.trim(text)) < FRAGMENT_CHARS) / n).alias("fragment_share"), F.coalesce(F.try_divide(F.sum(F.when(t.isin(*PROSE_TYPES), F.length(text)).otherwise(0)), chars), F.lit(0.0)).alias("prose_share"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def indicators(reports: DataFrame) -> DataFrame:
    """One row an indicator of each report: (run_id, name, value), from counts of terms, blocks, findings, cost and characters."""
    c = F.col
    values = {
        "term_consistency": 1 - ratio(c("terms_drifted"), c("terms_audited")), "render_skip_rate": ratio(c("fail_closed"), c("total")), "render_preserved_rate": ratio(c("preserved"), c("total") + c("preserved")),
        "repair_rate": ratio(c("repaired"), c("total")), "needs_human_rate": ratio(c("needs_human"), c("total")), "blocked_human_rate": ratio(c("blocked_human"), c("total")),
        "visual_critical_rate": ratio(c("critical"), c("pages")), "visual_major_rate": ratio(c("major"), c("pages")), "untranslated_leak_rate": ratio(c("untranslated"), c("total")),
        "cost_per_1k_chars": ratio(F.coalesce(c("cost"), F.lit(0.0)), c("chars") / 1000.0),
    }
    return reports.select("run_id", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in values.items()])).alias("x")).select("run_id", "x.*")


def domain(text: Column) -> Column:
    """(domain, confidence): the field with most of its words, if there are enough, else general; of equal ones the first listed."""
    t = F.coalesce(text, F.lit(""))
    hits = F.array(*[F.struct(F.regexp_count(t, F.lit("(?iU)" + "|".join(ps))).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, (d, ps) in enumerate(DOMAINS.items())])
    best = F.array_max(hits)
    found = F.struct(best["d"].alias("domain"), F.bround(F.least(F.lit(1.0), 0.4 + best["n"] * 0.05), 2).alias("confidence"))
    none = F.struct(F.lit("general").alias("domain"), F.when(t == "", 0.0).otherwise(0.1).alias("confidence"))
    return F.when(best["n"] >= DOMAIN_HITS, found).otherwise(none)


def preflight_sample(blocks: DataFrame, key: str, limit: int = 5) -> DataFrame:
    """By document the blocks that try markup hardest: formulas, tables, headings, then others, those with inline mathematics first."""
    rank = F.coalesce(*[F.when(F.col("block_type") == t, k) for k, t in enumerate(SAMPLE_FIRST)], F.lit(len(SAMPLE_FIRST)))
    by = Window.partitionBy(key).orderBy(rank, F.when(F.contains("source_text", F.lit("$")), 0).otherwise(1), "spine_index")
    return blocks.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= limit).drop("_n")


def routed_cost(blocks: DataFrame, key: str, rates: DataFrame, flagship: str) -> DataFrame:
    """By document: what blocks (tier, tokens) cost on the model of their tier (rates: tier, rate a million) and all on the flagship tier, what that saves, and the share of cheap blocks."""
    dear = rates.filter(F.col("tier") == flagship).select("rate").scalar()
    priced = blocks.join(F.broadcast(rates.select("tier", "rate").limit(100)), "tier")  # one row a tier, a fixed handful
    cost, most = F.sum(F.col("tokens") * F.col("rate") / 1e6), F.sum(F.col("tokens") * F.col("_dear") / 1e6)
    out = priced.withColumn("_dear", dear).groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), cost.alias("cost"), most.alias("flagship_cost"), F.count_if(F.col("tier") == flagship).alias("on_flagship"))
    return out.withColumn("saved", F.greatest(F.lit(0.0), F.col("flagship_cost") - F.col("cost"))).withColumn("saved_percent", F.bround(ratio(F.col("saved"), F.col("flagship_cost")) * 100, 2))


def model_points(models: DataFrame, words: int = 10_000) -> DataFrame:
    """models (model, quality, input, output, cached_input: rates a million) with their cost for so many words and for ten thousand; a third of the input is cached."""
    tokens, out = int(words * INPUT_PER_WORD), words
    cached = int(tokens * CACHED_SHARE)
    cost = ((tokens - cached) * F.col("input") + cached * F.col("cached_input") + out * F.col("output")) / 1e6
    return models.withColumns({"cost_usd": F.bround(cost, 4), "cost_per_10k": F.bround(cost / max(words, 1) * 10_000, 4)})
