"""Passages: captions with their parts, abstracts, sentences, Chinese terms, and pairs held against a back-translation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import names

# Markers of parts, openers of captions and abstracts, abbreviations that end no sentence, words that lead a Chinese term, weights of a pair's score.
PART = r"(?:(?<=^)|(?<=\s)|(?<=[，。；;,：:]))(?:\(([a-zA-Z]|\d+)\)|（([a-zA-Z]|\d+|[一二三四五六七八九十]+)）|([a-zA-Z])\)|([a-zA-Z])[:：])"
CAPTION = r"(?i)^\s*(?:Figure|Fig\.?|Table|Listing|Algorithm|图|表|附图|附表)\s*[\d.]+\s*[:：.|｜]?"
ABSTRACT = r"(?is)^\s*(?:>)?\s*(?:\*\*)?(?:【)?(?:本章导读|内容提要|本章提要|章节导读|导读|Chapter Summary|Abstract|Summary)(?:】)?(?:\*\*)?[:：\s]*(.*)$"
SENTENCE = r"(?<=[。！？])[\"'”’）)\]]*\s*|(?<=[.!?])[\"'”’）)\]]*\s+"
ABBREVIATIONS = "fig figs eq eqs sec al e.g i.e etc vs cf no resp approx ref refs tab pp vol".split()
LEADS = (
    "本章主要讨论 本章讨论 本节讨论 我们讨论 另外还涉及 主要涉及 主要讨论 本章 主要 我们 另外 涉及 讨论 学习 提出 使用 引入 基于 支持 对于 关于 称为 即是 即 和 与 及 或 还 在 由 对 将 为 并 则 该 此 这 那 个 种 项 类".split()
)
WEIGHTS, FLIPPED, PASS = {"bleu": 0.40, "entities": 0.35, "fuzzy": 0.15, "length": 0.10}, 0.40, 0.65


def _s(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def caption_parts(text: Column) -> Column:
    """(main, parts): a caption without its parts, and their labels, as (x), with texts."""
    # a mark stands in for each marker, so that one split gives the texts between them
    marked = F.split(F.regexp_replace(text, PART, "\x1f"), "\x1f")
    labels = F.transform(F.regexp_extract_all(text, F.lit(PART), F.lit(0)), lambda m: F.concat(F.lit("("), F.regexp_replace(m, r"[()（）:：]", ""), F.lit(")")))
    clean = lambda t: _s(F.regexp_replace(_s(F.regexp_replace(_s(t), r"^[:：—–-]\s*", "")), r"[;；,，]\s*$", ""))
    parts = F.transform(labels, lambda x, k: F.struct(x.alias("label"), clean(F.get(marked, k + 1)).alias("text")))
    main = _s(F.get(marked, 0))
    return F.struct(F.when(F.size(labels) > 0, _s(F.regexp_replace(main, r"[:：—–-]\s*$", ""))).otherwise(main).alias("main"), parts.alias("parts"))


def abstract_text(text: Column) -> Column:
    """What follows the word that opens an abstract, or null."""
    return F.when(text.rlike(ABSTRACT), _s(F.regexp_extract(text, ABSTRACT, 1)))


def sentences(text: Column) -> Column:
    """Sentences of a text: no break after a known abbreviation or a bare number."""
    pieces = F.filter(F.transform(F.split(_s(F.coalesce(text, F.lit(""))), SENTENCE), _s), lambda p: p != "")
    open_ = lambda t: F.lower(F.regexp_extract(F.regexp_replace(t, r"[.!?。！？\"'”’）)\]]+$", ""), r"([^\s(\"']*)$", 1))
    goes_on = lambda t: open_(t).isin(*ABBREVIATIONS) | open_(t).rlike(r"^\d+$")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(state: Column, piece: Column) -> Column:
        whole = F.when(state["held"] == "", piece).otherwise(F.concat(state["held"], F.lit(" "), piece))
        return F.struct(F.when(goes_on(whole), state["out"]).otherwise(F.concat(state["out"], F.array(whole))).alias("out"), F.when(goes_on(whole), whole).otherwise(F.lit("")).alias("held"))

    return F.aggregate(pieces, start, step, lambda state: F.when(state["held"] == "", state["out"]).otherwise(F.concat(state["out"], F.array(state["held"]))))


def term_core(term: Column) -> Column:
    """A Chinese term without the verbs and particles that lead it, as long as two characters stay."""
    return F.regexp_replace(_s(term), "^(?:(?:" + "|".join(LEADS) + r")\s*(?=.{2}))+", "")


def pair_scores():
    """(bleu, fuzzy) of a source and a back-translation: smoothed BLEU on words, and the Indel ratio of sorted words."""
    from quire.functions.similarity import sentence_bleu, token_sort_ratio

    def run(source: pd.Series, back: pd.Series) -> pd.DataFrame:
        s, b = source.fillna("").str.strip(), back.fillna("").str.strip()
        return pd.DataFrame({"bleu": map(sentence_bleu, s, b), "fuzzy": map(token_sort_ratio, s, b)})

    return F.pandas_udf(run, "bleu double, fuzzy double")


def pair_verdict(source: Column, back: Column, scores: Column) -> Column:
    """(composite, missing, kept, severity, passed) of a pair: weighted BLEU, entities, sorted words and length; a flipped polarity caps it, a lost entity is critical."""
    own, there = names.key_entities(_s(source)), names.key_entities(_s(back))
    missing, kept = F.array_except(own, there), names.polarity_kept(source, back, F.lit(True))
    held = F.when(F.size(own) > 0, F.size(F.array_intersect(own, there)) / F.size(own)).otherwise(F.lit(1.0))
    n, m = F.length(_s(source)), F.length(_s(back))
    length = F.least(n, m) / F.greatest(n, m, F.lit(1))
    raw = scores["bleu"] * WEIGHTS["bleu"] + held * WEIGHTS["entities"] + scores["fuzzy"] * WEIGHTS["fuzzy"] + length * WEIGHTS["length"]
    composite = F.when(kept, raw).otherwise(F.least(raw, F.lit(FLIPPED)))
    empty = (n == 0) | (m == 0)
    passed = ~empty & (composite >= PASS) & kept & (F.size(missing) == 0)
    severity = F.when(empty | (F.size(missing) > 0), "critical").when(~kept, "major").when(passed, "none").otherwise("minor")
    return F.struct(F.when(empty, 0.0).otherwise(F.bround(composite, 4)).alias("composite"), missing.alias("missing"), kept.alias("kept"), severity.alias("severity"), passed.alias("passed"))
