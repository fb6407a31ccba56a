"""Terminology: containment, drift, conflicts, arbitration, abbreviations, concordance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scope levels from the narrowest, and what counts as an acronym pair.
SCOPES = ("block", "section", "chapter", "domain", "global")
ACRONYM = r"([A-Za-z][A-Za-z -]{3,60}?)\s*\(([A-Z]{2,8})\)"


CJK = "[㐀-鿿぀-ヿ가-힯]"


def escaped(term: Column) -> Column:
    return F.regexp_replace(term, r"([\\^$.|?*+()\[\]{}])", r"\\$1")


def occurrences(text: Column, term: Column) -> Column:
    """How often a term stands in a text: CJK terms of over one character as substrings, others as whole words in any case."""
    cjk = term.rlike(CJK) & (F.length(term) > 1)
    plain = F.when(term == "", 0).otherwise((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int")
    return F.when(cjk, plain).otherwise(F.regexp_count(text, F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])"), escaped(term), F.lit(r"(?![\p{L}\p{N}_])"))))


def first_words(glossary: DataFrame, source: str = "source") -> DataFrame:
    """glossary with _first, what a block that has the term has too: one or two CJK characters, else the first word, else nothing."""
    s = F.col(source)
    return glossary.withColumn("_first", F.when(s.rlike(CJK), F.regexp_extract(s, CJK + "{1,2}", 0)).otherwise(F.lower(F.regexp_extract(s, r"[\p{L}\p{N}_]+", 0))))


def block_words(text: Column) -> Column:
    """Distinct words of a block, its CJK characters and pairs of them, and the empty word, which terms of signs alone have."""
    found = lambda t, p, k: F.regexp_extract_all(t, F.lit(p), F.lit(k))
    return F.array_distinct(F.concat(F.array(F.lit("")), found(F.lower(text), r"[\p{L}\p{N}_]+", 0), found(text, CJK, 0), found(text, f"(?=({CJK}{{2}}))", 1)))


def containment(blocks: DataFrame, glossary: DataFrame, text: str = "source_text", source: str = "source", keys: tuple[str, ...] = ("doc_id", "spine_index")) -> DataFrame:
    """(keys, source, n): terms that stand in blocks, and how often.

    Terms meet blocks on their first word, CJK ones on their first characters, an equi-join over what blocks have of
    those, without their texts; only such pairs are searched. keys name a block.
    """
    heads = first_words(glossary, source).filter(F.col(source) != "").select(source, "_first")
    words = blocks.select(*keys, F.explode(block_words(F.col(text))).alias("_first"))
    pairs = words.join(heads, "_first").select(*keys, source)
    rows = blocks.select(*keys, text).join(pairs, list(keys))  # texts move once, for the blocks that may have a term
    return rows.withColumn("n", occurrences(F.col(text), F.col(source))).filter("n > 0").select(*keys, source, "n")


def term_metrics(hits: DataFrame) -> DataFrame:
    """Precision of terms over hits (block, source, exact, fuzzy): exact and fuzzy shares, terms expected and rendered; 0 for none."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return hits.agg(share("exact").alias("precision"), share("fuzzy").alias("fuzzy_precision"), F.countDistinct("source").alias("expected"), F.countDistinct(F.when(F.col("exact"), F.col("source"))).alias("rendered"))


def drift_summary(hits: DataFrame, most: int = 50) -> DataFrame:
    """Of terms that drifted: occurrences, exact ones, drift rate and the first `most` blocks that drifted, worst first. Block lists are cut by rank before they are collected."""
    rate = hits.groupBy("source").agg(F.count(F.lit(1)).alias("occ"), F.count_if("exact").alias("exact")).withColumn("drift_rate", 1 - F.col("exact") / F.col("occ"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("block_id"))
    drifted = hits.filter(~F.col("exact")).withColumn("_n", nth).filter(F.col("_n") <= most)
    return rate.join(drifted.groupBy("source").agg(F.sort_array(F.collect_list("block_id")).alias("blocks")), "source").orderBy(F.col("drift_rate").desc(), F.col("occ").desc(), "source")


def conflicts(glossary: DataFrame, key: Column | None = None, translation: str = "translation") -> DataFrame:
    """Terms with more than one translation, those in order."""
    key = F.lower(F.col("source")) if key is None else key
    return glossary.groupBy(key.alias("term")).agg(F.sort_array(F.collect_set(translation)).alias("translations")).filter(F.size("translations") > 1)


def arbitrate(entries: DataFrame, affinity: Column | None = None) -> DataFrame:
    """One entry a lower-case source: narrowest scope, then affinity (only if positive), priority, frequency, smallest translation."""
    level = F.array_position(F.array(*[F.lit(s) for s in SCOPES]), F.coalesce(F.col("scope"), F.lit("global")))
    fit = F.lit(0) if affinity is None else F.greatest(affinity, F.lit(0))
    rank = Window.partitionBy(F.lower("source")).orderBy(F.when(level == 0, 99).otherwise(level), fit.desc(), F.coalesce("priority", F.lit(0)).desc(), F.coalesce("frequency", F.lit(0)).desc(), "translation")
    return entries.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").drop("_n")


def affinity(text: Column, hints: Column, negative: Column) -> Column:
    """+1 for each hint in the text; any negative hint makes it -100."""
    has = lambda h: F.contains(F.lower(text), F.lower(h))
    return F.when(F.exists(F.coalesce(negative, F.array().cast("array<string>")), has), F.lit(-100)).otherwise(F.size(F.filter(F.coalesce(hints, F.array().cast("array<string>")), has)))


def merge_entries(entries: DataFrame) -> DataFrame:
    """Entries of equal lower-case source and scope as one: the winner's texts, all aliases, the highest frequency and priority."""
    better = F.struct(F.col("frequency").cast("long"), -F.length("source"), "source", "translation")
    return entries.groupBy(F.lower("source").alias("term"), F.coalesce("scope", F.lit("global")).alias("scope")).agg(
        F.max_by("source", better).alias("source"), F.max_by("translation", better).alias("translation"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"), F.max("frequency").alias("frequency"), F.max("priority").alias("priority"),
    )


def abbreviations(blocks: DataFrame) -> DataFrame:
    """(acronym, expansion) of "Expansion (ACR)" whose initials fit; the first in reading order wins."""
    found = blocks.select("doc_id", "spine_index", F.posexplode(F.regexp_extract_all("source_text", F.lit(ACRONYM), F.lit(0))).alias("k", "m"))
    found = found.withColumns({"acronym": F.regexp_extract("m", ACRONYM, 2), "words": F.split(F.trim(F.regexp_extract("m", ACRONYM, 1)), r"[\s-]+")})
    tail = F.slice("words", -F.least(F.length("acronym"), F.size("words")), F.length("acronym"))
    fits = F.upper(F.array_join(F.transform(tail, lambda w: F.substring(w, 1, 1)), "")) == F.col("acronym")
    found = found.filter(fits).withColumn("expansion", F.array_join(tail, " "))
    first = found.groupBy(F.lower("acronym").alias("_a")).agg(F.min_by(F.struct("acronym", "expansion"), F.struct("doc_id", "spine_index", "k")).alias("x"))
    return first.select("x.acronym", "x.expansion").orderBy("acronym")


def concordance(blocks: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """(term, n, first_block): terms that stand in blocks at least `least` times, and where first."""
    hits = containment(blocks, terms, keys=("doc_id", "spine_index", "block_id"))
    return hits.groupBy("source").agg(F.sum("n").alias("n"), F.min_by("block_id", F.struct("doc_id", "spine_index")).alias("first_block")).filter(F.col("n") >= least)


def harmonic_names(blocks: DataFrame, least: int = 15, most: int = 40) -> DataFrame:
    """(name, n): capitalised words that stand in mid-sentence, by frequency."""
    words = blocks.select(F.explode(F.regexp_extract_all("source_text", F.lit(r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}{2,}"), F.lit(0))).alias("name"))
    return words.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).orderBy(F.col("n").desc(), "name").limit(most)
