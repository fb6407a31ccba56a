"""Marks in texts: formula skeletons, slots, emphasis runs and boxes as JSON, commands, judges' replies, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Commands whose text may be translated, reply shapes, emphasis marks, abbreviations that end no sentence, name initials.
TEXT_SPAN = r"\\(text|mathrm|operatorname|textrm|mbox)\s*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}"
SCORE = r"(?i)\*{0,2}score\*{0,2}\s*[:=]\*{0,2}\s*(\d+(?:\.\d+)?)(?:\s*/\s*(\d+(?:\.\d+)?))?"
BARE_NUMBER = r"^\s*(\d+(?:\.\d+)?)(?:\s*/\s*(\d+(?:\.\d+)?))?\s*$"
INNER_FORBIDDEN, INNER_CHARS = r"[\\{}$^_&%#]", 120
NAME_INITIALS, PROSE_LETTERS = r"\b[A-Z]\.(?:\s*[A-Z]\.)*\s+[A-Z][a-z]+", ("a", "A", "I")
RUNS = "array<struct<text:string,bold:boolean,italic:boolean>>"
BOXES = "array<struct<page:int,bbox:array<double>>>"


def formula_texts(latex: Column) -> Column:
    """What stands in the text commands of a formula, in order; braces may nest two deep."""
    return F.regexp_extract_all(latex, F.lit(TEXT_SPAN), F.lit(2))


def translatable_texts(latex: Column) -> Column:
    """Of those the plain phrases of several words."""
    trimmed = F.transform(formula_texts(latex), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: (s != "") & (F.length(s) <= INNER_CHARS) & ~s.rlike(INNER_FORBIDDEN) & s.rlike(r"(?U)\s") & ~s.rlike(r"(?U)\d"))


def skeleton(latex: Column) -> Column:
    """A formula with the text of its text commands blanked; the commands stay."""
    return F.regexp_replace(latex, TEXT_SPAN, r"\\$1{}")


def skeleton_holds(source: Column, target: Column) -> Column:
    """Whether two formulas differ in nothing but what stands in as many text commands, white space aside."""
    bare = lambda c: F.regexp_replace(skeleton(c), r"(?U)\s+", "")
    return (bare(source) == bare(target)) & (F.size(formula_texts(source)) == F.size(formula_texts(target)))


def formula_intact(block_type: Column, source: Column, target: Column) -> Column:
    """Whether a formula's target, if it has one, is its source but for white space."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return (block_type != "formula") | (F.coalesce(target, F.lit("")) == "") | (bare(source) == bare(target))


def novel_commands(source: Column, target: Column, allowed: Column) -> Column:
    """Commands of the target that neither the source has nor are allowed, in order."""
    commands = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\\([a-zA-Z]+)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(commands(target)), F.concat(commands(source), allowed)))


def debris_share(text: Column) -> Column:
    """Single letters that prose does not have among words, initials of names aside; 0 without words."""
    words = F.regexp_extract_all(F.regexp_replace(text, NAME_INITIALS, " "), F.lit("[A-Za-z]+"), F.lit(0))
    singles = F.filter(words, lambda w: (F.length(w) == 1) & ~w.isin(*PROSE_LETTERS))
    return F.when(F.size(words) > 0, F.size(singles) / F.size(words)).otherwise(F.lit(0.0))


def slots(expected: Column, observed: Column) -> Column:
    """(missing, hallucinated, valid): slots that a draft lost and made up; expected an array, observed a map of counts."""
    seen = F.map_keys(F.map_filter(observed, lambda _, n: n > 0))
    missing, made_up = F.array_except(expected, seen), F.array_except(F.map_keys(observed), expected)
    return F.struct(missing.alias("missing"), made_up.alias("hallucinated"), ((F.size(missing) == 0) & (F.size(made_up) == 0)).alias("valid"))


def runs_json(runs: Column) -> Column:
    return F.to_json(F.coalesce(runs, F.array().cast(RUNS)), {"ignoreNullFields": "false"})


def runs_of(text: Column) -> Column:
    """Runs from JSON; none for anything malformed, items without a text left out."""
    return F.coalesce(F.filter(F.from_json(text, RUNS), lambda r: r.isNotNull() & r["text"].isNotNull()), F.array().cast(RUNS))


def boxes_json(boxes: Column) -> Column:
    return F.to_json(boxes)


def boxes_of(text: Column) -> Column:
    """A chain of boxes (page, bbox) from JSON; none unless it is a chain of two or more and each is whole."""
    boxes, none = F.from_json(text, BOXES), F.array().cast(BOXES)
    whole = F.forall(boxes, lambda b: b["page"].isNotNull() & (F.size(b["bbox"]) == 4) & F.forall(b["bbox"], lambda x: x.isNotNull()))
    return F.when(boxes.isNotNull() & (F.size(boxes) >= 2) & whole, boxes).otherwise(none)


def judge_score(reply: Column) -> Column:
    """The score in a judge's reply as a share: from JSON, after the word score, or a bare number; by its denominator or else from 1 on as percent. null without one."""
    from_json = F.get_json_object(reply, "$.score").try_cast("double")
    percent = lambda x: F.least(F.lit(1.0), F.when(x >= 1, x / 100).otherwise(x))
    number = lambda p, k: F.nullif(F.regexp_extract(reply, p, k), F.lit("")).cast("double")
    of = lambda p: F.when(number(p, 2).isNull(), percent(number(p, 1))).when(number(p, 2) > 0, F.least(F.lit(1.0), number(p, 1) / number(p, 2))).otherwise(F.lit(0.0))
    return F.when(from_json.isNotNull(), F.greatest(F.lit(0.0), percent(from_json))).when(reply.rlike(SCORE), of(SCORE)).when(reply.rlike(BARE_NUMBER), of(BARE_NUMBER))


def image_references(text: Column) -> Column:
    """Sources of images, HTML's and Markdown's, repeats included."""
    html = F.regexp_extract_all(text, F.lit(r"(?i)<img\b[^>]*?\bsrc\s*=\s*[\"']([^\"']*)[\"'][^>]*>"), F.lit(1))
    return F.concat(html, F.transform(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1)), lambda u: F.concat(F.lit("md:"), u)))


def image_delta(source: Column, target: Column) -> Column:
    """(missing, extra): image references whose numbers differ, each once."""
    a, b = image_references(source), image_references(target)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    more = lambda xs, ys: F.array_sort(F.filter(F.array_distinct(xs), lambda x: count(xs, x) > count(ys, x)))
    return F.struct(more(a, b).alias("missing"), more(b, a).alias("extra"))


def lost_links(source: Column, target: Column) -> Column:
    """Link targets of the source that the target lacks, in order."""
    links = lambda c: F.regexp_extract_all(c, F.lit(r"(?i)<a\b[^>]*?href\s*=\s*[\"']([^\"']+)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(links(source)), links(target)))
