"""Terminology over block pairs: drift, wrong surfaces, enforcement, vocabularies, identifiers, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import protection
from quire.operators.terms import containment

# Tokens in capitals, Latin runs, labels and capitals that are plain words, persons and places first in a table.
ALL_CAPS, LETTERS, LATIN_RUN = r"\b[A-Z][A-Z0-9]+\b", r"[A-Za-z]+", r"[A-Za-z][A-Za-z0-9]*(?:[-_.][A-Za-z0-9]+)*"
CAMEL = r"[a-z][A-Z]|[A-Z]{2,}[a-z]"
FIRST_KINDS = ("person", "place")


def normal_terms(glossary: DataFrame) -> DataFrame:
    """(source, expected, surfaces, renderings) of a glossary (source, translation, aliases, inflected_variants); rows without source or translation are out."""
    empty = F.array().cast("array<string>")
    full = lambda first, more: F.array_distinct(F.filter(F.concat(F.array(first), F.coalesce(F.col(more), empty) if more in glossary.columns else empty), lambda x: F.trim(x) != ""))
    rows = glossary.filter((F.trim("source") != "") & (F.trim("translation") != ""))
    return rows.select(F.trim("source").alias("source"), F.trim("translation").alias("expected"), full(F.trim("source"), "aliases").alias("surfaces"), full(F.trim("translation"), "inflected_variants").alias("renderings"))


def term_drift(pairs: DataFrame, glossary: DataFrame, keys: tuple[str, ...] = ("block_id",), source: str = "source_text", target: str = "target_text") -> DataFrame:
    """(keys, source, expected, state) for each term that a block's source carries: rendered, protected (only in code or quotes) or drifted.

    Blocks meet terms on the first words of the terms' surfaces; only such pairs are searched, outside protected spans.
    """
    terms = normal_terms(glossary).withColumn("term", F.xxhash64("source", "expected"))
    surfaces = terms.select(F.explode("surfaces").alias("source")).distinct()
    met = containment(pairs, surfaces, source, "source", keys).select(*keys, F.col("source").alias("surface"))
    asked = met.join(terms.select("term", F.explode("surfaces").alias("surface")), "surface").select(*keys, "term").distinct()
    rows = pairs.select(*keys, source, target).join(asked, list(keys)).join(terms.withColumnRenamed("source", "_source"), "term")
    state = protection.drift_udf()(F.col(source), F.col(target), F.col("surfaces"), F.col("renderings"))
    return rows.withColumn("state", state).filter("state <> 'absent'").select(*keys, F.col("_source").alias("source"), "expected", "state")


def wrong_surfaces(blocks: DataFrame, variants: DataFrame, keys: tuple[str, ...] = ("block_id",), target: str = "target_text") -> DataFrame:
    """(keys, text, applied): targets with surfaces (surface, canonical) that are not canonical rewritten, and what was; the others are left out.

    A block gets the rules whose surface it has, at most the glossary.
    """
    met = containment(blocks, variants.select(F.col("surface").alias("source")).distinct(), target, "source", keys).withColumnRenamed("source", "surface")
    rules = met.join(variants.select("surface", "canonical"), "surface").groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("surface", "canonical"))).alias("rules"))
    done = blocks.select(*keys, target).join(rules, list(keys)).withColumn("x", protection.enforce_udf()(F.col(target), F.col("rules")))
    return done.filter(F.size("x.applied") > 0).select(*keys, "x.text", "x.applied")


def vocabulary(blocks: DataFrame, doc: str = "doc_id", text: str = "source_text") -> DataFrame:
    """(doc, word): the words that a document has in ordinary case, in lower case; runs of capitals are no evidence."""
    words = F.regexp_extract_all(F.regexp_replace(text, ALL_CAPS, " "), F.lit(LETTERS), F.lit(0))
    return blocks.select(doc, F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word")).distinct()


def identifier_shaped(term: Column) -> Column:
    """Digits, a hump, an underscore or dot inside, or three capitals at least."""
    return term.rlike("[0-9]") | term.rlike(CAMEL) | term.rlike(r"[_.]") | (term.rlike(r"^[A-Z]+$") & (F.length(term) >= 3))


def identifiers(blocks: DataFrame, doc: str = "doc_id", text: str = "source_text", keys: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """(keys, doc, term): tokens of blocks that a translation must keep: of an identifier's shape, and capitals only if the document never has them as a word."""
    terms = blocks.select(*keys, doc, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(LATIN_RUN), F.lit(0)))).alias("term")).filter((F.length("term") >= 2) & identifier_shaped(F.col("term")))
    capitals = F.col("term").rlike(r"^[A-Z]+$")
    words = vocabulary(blocks, doc, text).select(doc, F.col("word").alias("_w"))
    kept = terms.filter(capitals).withColumn("_w", F.lower("term")).join(words, [doc, "_w"], "left_anti").drop("_w")
    return terms.filter(~capitals).unionByName(kept.select(*terms.columns))


def glossary_table(glossary: DataFrame, most: int) -> DataFrame:
    """(place, source, translation) of the `most` entries that a book's sheet shows: persons and places, then by frequency and source."""
    order = [F.when(F.col("kind").isin(*FIRST_KINDS), 0).otherwise(1), F.coalesce("frequency", F.lit(0)).desc(), "source", "translation"]
    top = glossary.filter(F.coalesce("source", F.lit("")) != "").orderBy(*order).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "source", "translation")  # of `most` rows


#: First cells of the heads of rendered tables.
TABLE_HEADS = ("原文", "缩写")


def merged_tables(tables: Column) -> Column:
    """Rendered tables as one a head, in the order of heads: the head, then each row once by its first cell, the first one's.

    Lines outside tables are left out. Rows belong to the last head before them.
    """
    lines = F.filter(F.transform(F.split(F.array_join(F.coalesce(tables, F.array().cast("array<string>")), "\n"), "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    cell = lambda x: F.trim(F.get(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), 0))
    empty = F.array().cast("array<struct<head:string,first:string,line:string>>")

    def step(state: Column, line: Column) -> Column:
        first = cell(line)
        head = F.when(first.isin(*TABLE_HEADS), first).otherwise(state["head"])
        rule = line.rlike(r"^[|:\- ]+$")
        key = F.when(rule, F.lit("\x00rule")).otherwise(first)
        known = F.exists(state["rows"], lambda r: (r["head"] == head) & (r["first"] == key))
        new = (head != "") & ((first != "") | rule) & ~known
        return F.struct(head.alias("head"), F.when(new, F.concat(state["rows"], F.array(F.struct(head.alias("head"), key.alias("first"), line.alias("line"))))).otherwise(state["rows"]).alias("rows"))

    rows = F.aggregate(lines, F.struct(F.lit("").alias("head"), empty.alias("rows")), step)["rows"]
    heads = F.array_distinct(F.transform(rows, lambda r: r["head"]))
    return F.array_join(F.transform(heads, lambda h: F.array_join(F.transform(F.filter(rows, lambda r: r["head"] == h), lambda r: r["line"]), "\n")), "\n\n")
