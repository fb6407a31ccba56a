"""Pages and columns: page kinds, lines by column, overruns, rows of fragments, back matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import names

# Share of a line in a column, tolerance at its edge, gap between fragments of a row.
STRADDLE, EDGE, GAP = 0.2, 0.5, 12.0


def assign_lines(boxes: DataFrame, tracks: DataFrame) -> DataFrame:
    """boxes (page, box_id, x0, x1) with track, the index of the only column (page, track, t0, t1) that holds a fifth of their width; null for
    lines over several columns or beside all. A page has few columns, so the join on the page stays small."""
    both = boxes.join(tracks, "page")
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))
    share = F.when(width > 0, F.greatest(F.least("x1", "t1") - F.greatest("x0", "t0"), F.lit(0.0)) / width).otherwise(F.lit(0.0))
    hits = both.filter(share >= STRADDLE).groupBy("page", "box_id").agg(F.count(F.lit(1)).alias("_n"), F.min("track").alias("track"), F.min("t1").alias("t1")).filter("_n = 1").drop("_n")
    return boxes.join(hits, ["page", "box_id"], "left")


def overruns(boxes: DataFrame, tracks: DataFrame) -> DataFrame:
    """(page, box_id, track, overrun) of lines that go beyond the right edge of their column."""
    return assign_lines(boxes, tracks).withColumn("overrun", F.col("x1") - F.col("t1")).filter(F.col("overrun") > EDGE).select("page", "box_id", "track", "overrun")


def row_fragments(boxes: DataFrame, gap: float = GAP) -> DataFrame:
    """(page, row, part, x0, x1, n): fragments of one row (page, row, x0, x1) joined while the gap to those before is at most `gap`; parts count from 0."""
    by = Window.partitionBy("page", "row").orderBy("x0", "x1")
    reach = F.max("x1").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce(F.col("x0") - reach > gap, F.lit(False)).cast("int")
    parts = boxes.withColumn("_cut", cut).withColumn("part", F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("page", "row", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.count(F.lit(1)).alias("n"))


def page_census(pages: DataFrame, key: str) -> DataFrame:
    """By document: pages, shares of pages in several columns and of pages that cannot be reflowed, whether half of them are scans or mixed."""
    kind = names.page_kind(*[F.col(c) for c in ("chars", "images", "fonts", "paths", "right_rows", "formulas")])
    share = lambda c: (F.count_if(c) / F.count(F.lit(1)))
    return pages.withColumn("kind", kind).groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), share(F.col("right_rows") > names.COLUMN_SHARE).alias("multicolumn"), share(F.col("kind").isin(*names.STRUCTURAL_PAGES)).alias("structural"),
        (F.count_if(F.col("kind") == "scan_image") * 2 >= F.count(F.lit(1))).alias("scanned"), (F.count_if(F.col("kind") == "mixed_complex") * 2 >= F.count(F.lit(1))).alias("complex"),
    )


def backmatter(blocks: DataFrame, doc: str, is_chapter: Column) -> DataFrame:
    """blocks with part: null before the first heading of back matter, then (number, kind, letter, title) of the part that a block is in.

    Headings of chapters open and close parts; an appendix without a letter gets the next one by its number.
    """
    order = Window.partitionBy(doc).orderBy("spine_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.when(is_chapter, names.backmatter_kind(F.col("source_text")))
    out = blocks.withColumn("_k", found).withColumn("_open", F.when(is_chapter, F.col("_k").isNotNull()))
    appendix = F.sum(F.coalesce((F.col("_k.kind") == "appendix").cast("int"), F.lit(0))).over(order)
    letter = F.when((F.col("_k.kind") == "appendix") & (F.col("_k.letter") == ""), F.char(F.lit(64) + appendix)).otherwise(F.col("_k.letter"))
    number = F.sum(F.coalesce(F.col("_open").cast("int"), F.lit(0))).over(order)
    out = out.withColumn("_part", F.when(F.col("_open"), F.struct(number.alias("number"), F.col("_k.kind").alias("kind"), letter.alias("letter"), F.col("_k.title").alias("title"))))
    live = F.last("_open", ignorenulls=True).over(order)
    return out.withColumn("part", F.when(live, F.last("_part", ignorenulls=True).over(order))).drop("_k", "_open", "_part")


def preamble(blocks: DataFrame, doc: str, is_chapter: Column, text: Column) -> DataFrame:
    """blocks with chapter (a running number), and quote, source or abstract for those that open a chapter, before its first other text."""
    from quire.functions.passages import abstract_text

    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    order = Window.partitionBy(doc).orderBy("spine_index")
    out = blocks.withColumns({"_a": F.when(~is_chapter, abstract_text(t)), "_e": F.when(~is_chapter, names.epigraph(t))})
    out = out.withColumns({"_body": (~is_chapter & (t != "") & F.col("_a").isNull() & F.col("_e").isNull()).cast("int"), "chapter": F.sum(is_chapter.cast("int")).over(order)})
    before = F.coalesce(F.sum("_body").over(Window.partitionBy(doc, "chapter").orderBy("spine_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opens = (F.col("chapter") > 0) & (before == 0) & (t != "")
    out = out.withColumn("_o", opens)
    quoted = F.col("_o") & F.col("_a").isNull()
    return out.withColumns({"abstract": F.when(F.col("_o"), F.col("_a")), "quote": F.when(quoted, F.col("_e.quote")), "source": F.when(quoted, F.col("_e.source"))}).drop("_a", "_e", "_body", "_o")


def figure_panels(blocks: DataFrame, doc: str, is_image: Column, text: Column, most: int = 4) -> DataFrame:
    """(doc, panel, images, columns, caption, labels): images that follow each other, with the caption after them and the labels of its parts; without
    such labels several images are (a), (b) and so on. A run of images is bounded by its page's."""
    from quire.functions.passages import CAPTION, caption_parts

    order = Window.partitionBy(doc).orderBy("spine_index")
    rows = blocks.select(doc, "spine_index", "block_id", is_image.alias("_i"), text.alias("_t"))
    rows = rows.withColumns({"_run": F.sum((~F.col("_i")).cast("int")).over(order), "_next": F.lead("_t").over(order), "_more": F.coalesce(F.lead("_i").over(order), F.lit(False))})
    runs = rows.filter("_i").groupBy(doc, "_run").agg(F.min("spine_index").alias("at"), F.count(F.lit(1)).cast("int").alias("images"), F.max(F.when(~F.col("_more"), F.col("_next"))).alias("_c"))
    runs = runs.withColumn("_p", F.when(F.col("_c").rlike(CAPTION), caption_parts(F.col("_c"))))
    letters = F.transform(F.sequence(F.lit(0), F.col("images") - 1), lambda k: F.concat(F.lit("("), F.char(97 + k % 26), F.lit(")")))
    given = F.slice(F.coalesce(F.transform("_p.parts", lambda p: p["label"]), F.array().cast("array<string>")), F.lit(1), F.col("images"))
    labels = F.when(F.col("images") > 1, F.concat(given, F.slice(letters, F.size(given) + 1, F.col("images")))).otherwise(given)
    number = F.row_number().over(Window.partitionBy(doc).orderBy("at"))
    return runs.withColumns({"panel": number, "labels": labels}).select(doc, "panel", "images", names.grid_columns(F.col("images"), most).alias("columns"), F.col("_p.main").alias("caption"), "labels")
