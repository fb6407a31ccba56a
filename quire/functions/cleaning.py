"""Cleaning as Column expressions: tags, sentinels, CJK spacing and punctuation, tables, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# CJK classes and marks that may not begin or end a line.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}]"
NOT_FIRST, NOT_LAST = "、。，．：；？！）］｝」』】〉》’”", "（［｛「『【〈《‘“"


def _chain(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda t, s: F.regexp_replace(t, s[0], s[1]), steps, text)


def strip_protocol_tags(text: Column) -> Column:
    return _chain(text, (r"</?(?:error_span|correction|final_translation)\b[^>]*>", ""))


def strip_mark_tags(text: Column) -> Column:
    return _chain(text, (r"</?mark\b[^>]*>", ""))


def strip_format_tags(text: Column) -> Column:
    return _chain(text, (r"(?i)</?(?:b|i|u|em|strong|span|font|sub|sup|small|br)\b[^>]*/?>", ""))


def strip_calibre(text: Column) -> Column:
    return _chain(text, (r"(?m)^:::.*$", ""), (r"\{\.[^}]*\}", ""), (r"\[\]\{#[^}]*\}", ""), (r"\n{3,}", "\n\n"))


def sanitized(text: Column) -> Column:
    """HTML without what can run: scripts, styles, handlers, script links."""
    return _chain(
        text, (r"(?is)<(script|style|iframe|object|embed)\b.*?(?:</\1\s*>|$)", ""), (r"""(?i)\s+on[a-z]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)""", ""),
        (r"""(?i)(href|src)\s*=\s*(["']?)\s*(?:javascript|vbscript|data):[^"'\s>]*\2""", ""),
    )


def scrub_css(text: Column) -> Column:
    return _chain(text, (r"(?i)@import[^;]*;?", ""), (r"(?i)url\([^)]*\)", "none"), (r"(?i)expression\([^)]*\)", "none"))


def sentinels(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"⟦[^⟧]*⟧"), F.lit(0))


def without_sentinels(text: Column) -> Column:
    return _chain(text, (r"⟦[^⟧]*⟧", "⟨missing⟩"))


def without_thoughts(text: Column) -> Column:
    """A model's answer without its reasoning, fences and lead-in."""
    return F.trim(_chain(text, (r"(?is)<think(?:ing)?>.*?</think(?:ing)?>", ""), (r"(?s)^\s*```[a-z]*\n(.*?)\n```\s*$", "$1"), (r"(?i)^\s*(?:here is|sure)[^\n:]*:\s*", "")))


def heading_only(text: Column) -> Column:
    """The first paragraph."""
    return F.trim(F.regexp_extract(F.trim(text), r"(?s)^(.*?)(?:\n\s*\n|$)", 1))


def cjk_spacing(text: Column) -> Column:
    """No spaces between CJK characters."""
    return _chain(text, (f"(?<={CJK})[ \\t]+(?={CJK})", ""))


def pangu(text: Column) -> Column:
    """A space between CJK and Latin letters or digits."""
    return _chain(text, (f"(?<={CJK})(?=[A-Za-z0-9])", " "), (f"(?<=[A-Za-z0-9])(?={CJK})", " "))


def cjk_punctuation(text: Column) -> Column:
    return _chain(text, (r"-{2,}|—{1,}", "——"), (r"\.{3,}|…{1,}", "……"))


def compressed_punctuation(text: Column) -> Column:
    return _chain(text, (r"([。，、；：！？])\1+", "$1"))


def word_joiners(text: Column) -> Column:
    """Breaks before marks that may not begin a line, and after those that may not end one, are forbidden."""
    return _chain(text, (f"(?<=[^\\s\\x{{2060}}])(?=[{NOT_FIRST}])", "\u2060"), (f"(?<=[{NOT_LAST}])(?=[^\\s\\x{{2060}}])", "\u2060"))


def kinsoku_errors(text: Column) -> Column:
    """Lines that begin or end with a mark that may not."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"^[{NOT_FIRST}]|[{NOT_LAST}]$")))


def typst(text: Column) -> Column:
    return _chain(text, (r"([\\#$*_`<>@\[\]])", r"\\$1"))


def summary(text: Column, chars: int = 400) -> Column:
    """Up to the last sentence end within so many characters; else those characters."""
    head = F.left(text, F.lit(chars))
    cut = F.regexp_extract(head, r"(?s)^(.{4,}[.!?。！？])", 1)
    return F.when(F.length(text) <= chars, text).when(cut != "", cut).otherwise(head)


def head_and_tail(text: Column, chars: int) -> Column:
    """A third from the front, two from the end."""
    return F.when(F.length(text) <= chars, text).otherwise(F.concat(F.left(text, F.lit(chars // 3)), F.lit("[...]"), F.right(text, F.lit(chars - chars // 3))))


def cells(table: Column) -> Column:
    """A Markdown table as rows of cells, the delimiter row left out."""
    lines = F.filter(F.transform(F.split(table, "\n"), F.trim), lambda x: (x != "") & ~x.rlike(r"^\|?(\s*:?-+:?\s*\|)*\s*:?-+:?\s*\|?$"))
    inner = lambda x: F.regexp_replace(x, r"^\||(?<!\\)\|$", "")
    return F.transform(lines, lambda x: F.transform(F.split(inner(x), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))


def grid(table: Column) -> Column:
    """How many cells each row of a table has."""
    return F.transform(cells(table), F.size)


def same_grid(source: Column, target: Column) -> Column:
    return grid(source) == grid(target)


def is_dense_table(table: Column) -> Column:
    """Whether most data cells are numbers, marks or short labels."""
    body = F.flatten(F.slice(cells(table), 2, 1_000_000))
    full = F.filter(body, lambda c: c != "")
    dense = F.filter(full, lambda c: c.rlike(r"^[\d\s.,%±+\-–—*/()]+$|^(?i:n/?a)$") | ((F.length(c) <= 18) & (F.size(F.split(c, r"\s+")) <= 2) & ~c.rlike(CJK)))
    return (F.size(cells(table)) >= 3) & (F.size(F.get(cells(table), 0)) >= 3) & (F.size(dense) >= F.size(full) * 0.7)
