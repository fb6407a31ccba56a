"""Small rules over names, markers, languages, pages and sentences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker shapes, polarity cues, language families with length bounds, domain patterns, page facts' limits.
ORDERED_MARKER = (
    r"^\s*([（(]?[0-9０-９]{1,3}(?:[.．][0-9０-９]{1,3})*[.．、)）]|\[[0-9０-９]{1,3}\]|[（(]?[a-zA-ZＡ-Ｚａ-ｚ][.．)）]|[一二三四五六七八九十百]+[、.．)）])\s+"
)
BULLETS, DASHES = "•◦‣▪●", "-*·–"
HEADING_STARTS = ("#", "-", "*", "•", "Chapter", "Section", "Part", "Step")
SENTENCE_ENDS = (".", "?", "!", "。", "？", "！", ";", "；")
DATA_CELL = r"(?i)^[\s$€¥£]*[-+]?\d+(?:[.,]\d+)*(?:\s*(?:%|ms|s|m|km|kg|g|kb|mb|gb|tb|hz|khz|mhz|ghz|db|pt|px|em|deg|°c|°f|k))?[\s$€¥£]*$"
NEGATIONS = ("not", "no", "never", "without", "none", "neither", "nor", "nothing", "nobody", "cannot")
CJK_NEGATIONS = ("不", "没", "没有", "别", "无", "勿", "ない", "ず", "ぬ")
ANTONYMS = (("increase", "decrease"), ("left", "right"), ("exothermic", "endothermic"), ("more", "less"), ("above", "below"))
BACK_NEGATIONS = (
    "not no never none neither nor without cannot cant couldnt wouldnt shouldnt dont doesnt didnt isnt arent wasnt werent hardly scarcely barely fail failed fails failing".split()
)
ZH_BACK_NEGATIONS = ("不", "没", "未", "无", "非", "否", "莫", "勿", "难以", "毫无", "绝不", "从不", "未能", "无法")
PROFILES = ("zh", "ja", "ko", "fr", "de", "es", "en", "ru", "ar", "he")
FAMILIES = {"latin": ("en", "fr", "de", "es", "it", "pt", "nl"), "cjk": ("zh", "ja", "ko"), "cyrillic": ("ru", "uk", "bg"), "rtl": ("ar", "he", "fa", "ur", "ps", "sd", "ug", "yi", "dv")}
FAMILY_BOUNDS = {
    ("latin", "cjk"): (0.18, 1.8), ("cjk", "latin"): (0.8, 5.0), ("latin", "latin"): (0.5, 2.0), ("cjk", "cjk"): (0.5, 2.0), ("cyrillic", "cjk"): (0.2, 1.8), ("cjk", "cyrillic"): (0.8, 4.5),
    ("cyrillic", "latin"): (0.5, 1.8), ("latin", "cyrillic"): (0.6, 2.0), ("latin", "rtl"): (0.5, 2.0), ("rtl", "latin"): (0.5, 2.0), ("cjk", "rtl"): (0.5, 2.5), ("rtl", "cjk"): (0.3, 2.0),
}
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2B73F}]"
MIN_CHARS, POSTER_CHARS, POSTER_FONTS, PATH_OPS, VECTOR_TEXT, COLUMN_SHARE, FORMULA_SHARE, RESUME_CHARS = 32, 80, 2, 200, 100, 0.25, 0.10, 2000
STRUCTURAL_PAGES = ("mixed_complex", "vector_heavy", "scan_image", "poster_fixed")
BACKMATTER = (
    ("bibliography", r"^(?:(?:references|bibliography|works\s+cited)\b|(?:参考文献|引用文献|文献列表))[:：\s]*(.*)"), ("glossary", r"^(?:(?:glossary|notations?|terminology)\b|(?:术语表|词汇表|符号表))[:：\s]*(.*)"),
    ("index", r"^(?:(?:index|subject\s+index|author\s+index)\b|(?:索引|主题索引))[:：\s]*(.*)"), ("afterword", r"^(?:(?:afterword|epilogue|postscripts?)\b|(?:后记|跋|结语|尾声))[:：\s]*(.*)"),
    ("colophon", r"^(?:(?:colophon|publication\s+data)\b|(?:版权页|图书在版编目))[:：\s]*(.*)"),
)
APPENDIX = r"^(?:附录\s*([A-Za-z0-9一二三四五六七八九十]*)|appendix\s*([A-Za-z0-9]*))[:：\s]*(.*)"
APPENDIX_LETTERS = dict(zip("一二三四五六七八九十123456789", "ABCDEFGHIJABCDEFGHI", strict=True))
LEAD_QUOTES, TAIL_QUOTES = r"^[“\"「『\s]+", r"[”\"」』\s]+$"


def _s(c: Column) -> Column:
    """Text without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def list_marker(text: Column) -> Column:
    """(marker, text) of a list item's line, or null: unmistakable bullets, dashes before white space, ordered markers."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+", "")
    first, rest = F.substring(bare, 1, 1), F.substr(bare, F.lit(2))
    pair = lambda m, t: F.struct(m.alias("marker"), _s(t).alias("text"))
    dash = F.when(F.substring(bare, 2, 1).rlike(r"(?U)^\s"), pair(first, rest))
    ordered = F.when(text.rlike(f"(?U){ORDERED_MARKER}"), pair(F.regexp_extract(text, f"(?U){ORDERED_MARKER}", 1), F.regexp_replace(text, f"(?U){ORDERED_MARKER}", "")))
    return F.when(bare == "", None).when(F.instr(F.lit(BULLETS), first) > 0, pair(first, rest)).when(F.instr(F.lit(DASHES), first) > 0, dash).otherwise(ordered)


def calibre_noise(line: Column) -> Column:
    s = _s(line)
    return (s != "") & (s.startswith(":::") | s.endswith(".ct}") | s.endswith(".cn}"))


def heading_or_item(line: Column) -> Column:
    """A title, an entry of a table of contents or a numbered item: by how it starts, or short without a sentence's end."""
    s = _s(line)
    starts, ends = (F.lit(False) for _ in range(2))
    for x in HEADING_STARTS:
        starts = starts | s.startswith(x)
    for x in SENTENCE_ENDS:
        ends = ends | s.endswith(x)
    return (s != "") & ~calibre_noise(line) & (starts | ((F.length(s) < 80) & ~ends))


def cell_key(cell: Column) -> Column:
    return F.lower(_s(F.regexp_replace(F.regexp_replace(cell, r"[*_`$]", ""), r"(?U)\s+", " ")))


def data_row(cells: Column) -> Column:
    """Whether at least half of the cells with text look like values."""
    full = F.filter(F.transform(cells, _s), lambda c: c != "")
    values = F.filter(full, lambda c: c.rlike(DATA_CELL) | (F.regexp_count(c, F.lit(r"\d")) >= 2))
    return (F.size(full) > 0) & (F.size(values) * 2 >= F.size(full))


def polarity(text: Column) -> Column:
    """One slot for negation and one for each antonym group: what the text says of it, or empty."""
    low = F.translate(F.lower(text), "‘’ʼ`´", "'''''")
    words = F.regexp_extract_all(low, F.lit("([a-z]+)"), F.lit(1))
    negated = F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS))) | low.contains("n't") | low.rlike("|".join(CJK_NEGATIONS))
    slots = [F.when(negated, F.lit("neg")).otherwise(F.lit(""))]
    for a, b in ANTONYMS:
        hit = F.lower(F.regexp_extract(text, rf"(?i)\b({a}|{b})(?:s|es|ed|d|ing)?\b", 1))
        slots.append(hit)
    return F.array(*slots)


def polarity_diverges(a: Column, b: Column) -> Column:
    return polarity(a) != polarity(b)


def key_entities(text: Column) -> Column:
    """Numbers, formulas between dollars, and identifiers (capitals, an underscore or a digit), each once."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    numbers = F.transform(found(r"(?i)[-+]?\b\d+(?:\.\d+)?(?:e[-+]?\d+)?%?"), F.lower)
    names = F.filter(found(r"\b[A-Za-z_][A-Za-z0-9_]{3,}\b"), lambda t: ((t == F.upper(t)) & t.rlike("[A-Z]")) | t.rlike(r"[_0-9]"))
    return F.array_sort(F.array_distinct(F.concat(numbers, found(r"\$[^$]+\$"), names)))


def polarity_kept(source: Column, back: Column, english: Column) -> Column:
    """Whether source and back-translation both have a negation word, or neither."""
    has = lambda t, words: F.arrays_overlap(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\b\w+\b"), F.lit(0)), F.array(*map(F.lit, words)))
    return F.when(english, has(source, BACK_NEGATIONS) == has(back, BACK_NEGATIONS)).otherwise(has(source, ZH_BACK_NEGATIONS) == has(back, ZH_BACK_NEGATIONS))


def lang_base(code: Column) -> Column:
    """The base of a language tag, in lower case; empty for none."""
    tag = F.lower(F.replace(F.trim(F.coalesce(code, F.lit(""))), F.lit("_"), F.lit("-")))
    return F.when(tag.isin(*PROFILES), tag).otherwise(F.substring_index(tag, "-", 1))


def length_bounds(src: Column, tgt: Column, low: float, high: float) -> Column:
    """(low, high) of target length by source length for the script families of two languages; the given bounds where none is known."""
    out = None
    for (a, b), (lo, hi) in FAMILY_BOUNDS.items():
        test, value = src.isin(*FAMILIES[a]) & tgt.isin(*FAMILIES[b]), F.struct(F.lit(lo).alias("low"), F.lit(hi).alias("high"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit(low).alias("low"), F.lit(high).alias("high")))


def contains_cjk(text: Column) -> Column:
    return F.coalesce(text.rlike(CJK), F.lit(False))


def chapter_id(block_id: Column) -> Column:
    """What stands before the first # or, without one, the first colon; empty without either."""
    return F.when(block_id.contains("#"), F.substring_index(block_id, "#", 1)).when(block_id.contains(":"), F.substring_index(block_id, ":", 1)).otherwise(F.lit(""))


def hyphenated_isbn(isbn: Column, valid: Column) -> Column:
    """A valid ISBN in its groups, which Chinese ones have elsewhere; others as they are, trimmed."""
    c = F.upper(F.regexp_replace(isbn, r"[^0-9Xx]", ""))
    cut = lambda *sizes: F.concat_ws("-", *[F.substring(c, 1 + sum(sizes[:k]), n) for k, n in enumerate(sizes)])
    long_ = F.when(c.rlike("^(?:9787|9797)"), cut(3, 1, 3, 5, 1)).otherwise(cut(3, 2, 4, 3, 1))
    return F.when(valid & (F.length(c) == 13), long_).when(valid & (F.length(c) == 10), cut(1, 3, 5, 1)).otherwise(_s(isbn))


def epoch_summary(text: Column, most: int) -> Column:
    """A text that is longer than `most`: its first third of that and its last two."""
    t, head = _s(text), max(1, most // 3)
    cut = F.concat(F.regexp_replace(F.substring(t, 1, head), r"(?U)\s+$", ""), F.lit("\n[...]\n"), F.regexp_replace(F.right(t, F.lit(max(1, most - head))), r"(?U)^\s+", ""))
    return F.when(F.length(t) <= most, t).otherwise(cut)


def grid_columns(count: Column, most: int = 4) -> Column:
    """Columns for so many panels."""
    want = F.when(count <= 1, 1).when(count <= 3, count).when(count == 4, 2).when(count <= 6, 3).otherwise(F.greatest(F.lit(2), F.floor(count / 2)))
    return F.when(count <= 1, 1).otherwise(F.least(want, F.lit(most))).cast("int")


def page_kind(chars: Column, images: Column, fonts: Column, paths: Column, right_rows: Column, formulas: Column) -> Column:
    """How a page is to be read, from its counts and shares."""
    poster = (images >= 1) & (chars >= MIN_CHARS) & (chars < POSTER_CHARS) & (fonts <= POSTER_FONTS) & (paths < PATH_OPS)
    vector = paths >= PATH_OPS
    mixed = (right_rows > COLUMN_SHARE) | (formulas >= FORMULA_SHARE) | (images >= 1) | vector
    return (
        F.when(poster, "poster_fixed").when((chars < MIN_CHARS) & ~vector, "scan_image").when((chars < VECTOR_TEXT) & vector, "vector_heavy")
        .when(mixed, "mixed_complex").when(chars > RESUME_CHARS, "resume_dense").otherwise("editable_text")
    )


def backmatter_kind(heading: Column) -> Column:
    """(kind, letter, title) of a heading that opens back matter, or null."""
    s, app = _s(heading), f"(?iUs){APPENDIX}"
    raw = F.upper(F.concat(F.regexp_extract(s, app, 1), F.regexp_extract(s, app, 2)))
    letter = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in APPENDIX_LETTERS.items() for x in kv]), raw), raw)
    title = _s(F.regexp_extract(s, app, 3))
    made = lambda k, a, t: F.struct(F.lit(k).alias("kind"), a.alias("letter"), t.alias("title"))
    out = F.when(s == "", None).when(s.rlike(app), made("appendix", letter, F.when(title == "", s).otherwise(title)))
    for kind, pattern in BACKMATTER:
        out = out.when(s.rlike(f"(?iUs){pattern}"), made(kind, F.lit(""), s))
    return out


def epigraph(text: Column) -> Column:
    """(quote, source) of a quotation with its source on the last line or after a dash, or null."""
    t = _s(F.regexp_replace(text, r"(?Um)^\s*>\s*", ""))
    line = r"(?iUs)^(.*?)\r?\n\s*(?:>)?\s*(?:——|--|—|by\s+)\s*([^\n]*)$"
    dash = r"(?U)^(.*?)\s*(?:——|--|—)\s*([^—–\n\r]+)$"
    bare = lambda q: F.regexp_replace(F.regexp_replace(_s(q), LEAD_QUOTES, ""), TAIL_QUOTES, "")
    parts = lambda p: (bare(F.regexp_extract(t, p, 1)), _s(F.regexp_extract(t, p, 2)))
    (q1, s1), (q2, s2) = parts(line), parts(dash)
    pair = lambda q, s: F.struct(q.alias("quote"), s.alias("source"))
    return F.when((q1 != "") & (s1 != ""), pair(q1, s1)).when((q2 != "") & (s2 != "") & (F.length(s2) <= 60), pair(q2, s2))


def page_chunks(pages: Column, size: int = 50) -> Column:
    """Distinct pages in order, cut into chunks."""
    p = F.array_sort(F.array_distinct(pages))
    return F.when(F.size(p) == 0, F.array().cast("array<array<int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda k: F.slice(p, k * size + 1, size)))


def sample_pages(total: Column, flagged: Column, most: Column) -> Column:
    """Flagged pages first, then of long documents the first two and the last, then an even spread, then from the end; in order."""
    inside = F.slice(F.array_sort(F.filter(F.array_distinct(flagged), lambda p: (p >= 1) & (p <= total))), F.lit(1), most)
    ends = F.when((total > 100) & (F.size(inside) < most), F.array(F.lit(1), F.lit(2), total)).otherwise(F.array().cast("array<int>"))
    first = F.slice(F.array_distinct(F.concat(inside, ends)), F.lit(1), most)
    step = F.greatest(F.lit(1), F.floor(total / F.greatest(most - F.size(first) + 1, F.lit(1))).cast("int"))
    every = F.array_distinct(F.concat(first, F.sequence(F.lit(1), total, step), F.reverse(F.sequence(F.lit(1), total))))
    return F.when((total <= 0) | (most <= 0), F.array().cast("array<int>")).otherwise(F.array_sort(F.slice(every, F.lit(1), most)))
