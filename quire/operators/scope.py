"""Scopes of glossary entries: which cover a block, and which entry wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Levels from wide to narrow, and the prefixes that name them.
LEVELS = ("global", "domain", "chapter", "section", "block")
PREFIXES = {"block": "block", "blk": "block", "section": "section", "sec": "section", "chapter": "chapter", "ch": "chapter", "domain": "domain", "dom": "domain"}
DISQUALIFIED = -100.0


def scope(spec: Column) -> Column:
    """(level, ident) of a scope's specification; a bare number or ch and a number is a chapter, anything unknown is global."""
    raw = F.trim(F.coalesce(spec, F.lit("")))
    head, ident = F.lower(F.trim(F.substring_index(raw, ":", 1))), F.trim(F.regexp_replace(raw, r"^[^:]*:", ""))
    made = lambda level, x: F.struct(F.lit(level).alias("level"), x.alias("ident"))
    out = F.when(raw.isin("", "*", "global"), made("global", F.lit("*")))
    for level in LEVELS[1:]:
        out = out.when(raw.contains(":") & head.isin(*[p for p, of in PREFIXES.items() if of == level]), made(level, ident))
    return out.when(raw.rlike("(?i)^ch[0-9]+$"), made("chapter", F.substr(raw, F.lit(3)))).when(raw.rlike("^[0-9]+$"), made("chapter", raw)).otherwise(made("global", raw))


def covers(spec: Column, context: dict[str, Column]) -> Column:
    """Whether a scope covers a block with (block_id, section_index, section_title, chapter_index, chapter_title, domain), any of them null."""
    s = scope(spec)
    ident = F.lower(s["ident"])
    same = lambda c: F.coalesce((F.lower(context[c].cast("string")) == ident) & (context[c].cast("string") != ""), F.lit(False))
    inside = lambda c: F.coalesce((context[c] != "") & (F.instr(F.lower(context[c]), ident) > 0), F.lit(False))
    return (
        F.when(s["level"] == "global", True).when(s["level"] == "block", same("block_id")).when(s["level"] == "section", same("section_index") | inside("section_title"))
        .when(s["level"] == "chapter", F.coalesce(context["chapter_index"].cast("string") == s["ident"], F.lit(False)) | inside("chapter_title")).otherwise(same("domain"))
    )


def affinity(text: Column, hints: Column, against: Column) -> Column:
    """Hints found in the text; a hint against it found there disqualifies."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = lambda xs: F.filter(F.coalesce(xs, F.array().cast("array<string>")), lambda h: (h != "") & (F.instr(low, F.lower(F.trim(h))) > 0))
    return F.when(low == "", 0.0).when(F.size(found(against)) > 0, F.lit(DISQUALIFIED)).otherwise(F.size(found(hints)).cast("double"))


def effective(candidates: DataFrame, keys: list[str], context: dict[str, Column], text: Column | None = None) -> DataFrame:
    """Of candidates (keys, source, translation, scope, priority, frequency, context_hints, negative_hints) the winner for each key and source in lower case.

    Scopes that do not cover the context are out. Narrower scopes win, then affinity to the text, priority, frequency, at last the
    translation in order. verdict says by which of these the winner beats the best other translation, rivals how many there are.
    """
    level = F.array_position(F.array(*map(F.lit, LEVELS)), scope(F.col("scope"))["level"])
    empty = F.array().cast("array<string>")
    hints = [F.col(c) if c in candidates.columns else empty for c in ("context_hints", "negative_hints")]
    rows = candidates.filter(covers(F.col("scope"), context)).withColumns({"_source": F.lower("source"), "_rank": F.struct(
        level.alias("scope"), (affinity(text, *hints) if text is not None else F.lit(0.0)).alias("context"), F.col("priority").alias("priority"), F.col("frequency").alias("frequency"))})
    best = rows.groupBy(*keys, "_source", "translation").agg(F.max_by(F.struct("source", "scope"), "_rank").alias("row"), F.max("_rank").alias("_rank"))
    by = Window.partitionBy(*keys, "_source").orderBy(F.col("_rank").desc(), "translation")  # a term's rival translations
    best = best.select("*", F.row_number().over(by).alias("_n"), F.lead("_rank").over(by).alias("_next"), (F.count(F.lit(1)).over(Window.partitionBy(*keys, "_source")) - 1).alias("rivals"))
    verdict = F.when(F.col("_next").isNull(), F.lit("only"))
    for name in ("scope", "context", "priority", "frequency"):
        verdict = verdict.when(F.col(f"_rank.{name}") > F.col(f"_next.{name}"), F.lit(f"resolved_by_{name}"))
    return best.filter("_n = 1").select(*keys, "row.source", "translation", "row.scope", verdict.otherwise(F.lit("unresolved_ambiguous")).alias("verdict"), "rivals")
