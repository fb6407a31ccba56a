"""Boxes on pages: overlap, duplicates, columns, anomalies. A box is struct(x0, y0, x1, y1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IOU = 0.6
SIDES = ("bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Overlap over union; 0 for empty boxes."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def drop_duplicate_boxes(blocks: DataFrame, least: float = IOU) -> DataFrame:
    """blocks (page, text, bbox, block_id) without those that repeat a larger block's text on its page and overlap it."""
    w = Window.partitionBy("page", F.lower(F.trim("text"))).orderBy(area(F.col("bbox")).desc(), "block_id", *SIDES)
    out = blocks.withColumns({"_keep": F.first("bbox").over(w), "_n": F.row_number().over(w)})
    return out.filter((F.col("_n") == 1) | (iou(F.col("bbox"), F.col("_keep")) < least)).drop("_keep", "_n")


def overlaps(blocks: DataFrame, least: float = IOU, smallest: float = 1.0) -> DataFrame:
    """(page, a, b, iou) of all pairs of boxes on a page that overlap by `least`, above 0.

    Widths of such boxes differ by a factor of 1 / least at most, and their centres by less than the wider one's width, so boxes
    meet on page, class of width and column of a grid as wide as the class; each pair meets once.
    """
    if least <= 0:
        raise ValueError("every pair overlaps by 0 or more")
    n = F.row_number().over(Window.partitionBy("page").orderBy("block_id", *SIDES))
    base = (1 + 1e-6) / least  # a little wider, so that rounding parts no pair by two classes
    box = F.col("bbox")
    centre = (box["x0"] + box["x1"]) / 2
    column = lambda kind: F.floor(centre / F.pow(F.lit(base), kind + 2))
    some = blocks.filter(area(box) >= smallest).withColumn("_n", n).withColumn("_w", F.floor(F.log(box["x1"] - box["x0"]) / math.log(base)))
    keys = F.array(*[F.struct((F.col("_w") + k).alias("w"), (column(F.col("_w") + k) + c).alias("c")) for k in (-1, 0, 1) for c in (-1, 0, 1)])
    a, b = some.withColumn("_key", F.explode(keys)).alias("a"), some.withColumn("_c", column(F.col("_w"))).alias("b")
    pairs = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a._key.w") == F.col("b._w")) & (F.col("a._key.c") == F.col("b._c")) & (F.col("a._n") < F.col("b._n")))
    return pairs.withColumn("iou", iou(F.col("a.bbox"), F.col("b.bbox"))).filter(F.col("iou") >= least).select("a.page", F.col("a.block_id").alias("a"), F.col("b.block_id").alias("b"), "iou")


def out_of_bounds(blocks: DataFrame, width: float, height: float) -> DataFrame:
    b = F.col("bbox")
    return blocks.filter((b["x0"] < 0) | (b["y0"] < 0) | (b["x1"] > width) | (b["y1"] > height))


def columns_of(blocks: DataFrame, gutter: float = 8.0) -> DataFrame:
    """blocks with column (from 0) on their page: a gap of `gutter` between all boxes on its left and right starts a new one."""
    w = Window.partitionBy("page").orderBy(F.col("bbox.x0"), F.col("block_id"))
    right = F.max(F.col("bbox.x1")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = blocks.withColumn("_new", (F.col("bbox.x0") - right >= gutter).cast("int"))
    return marked.withColumn("column", F.coalesce(F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_new")


def body_metrics(lines: DataFrame) -> DataFrame:
    """The size that carries most text (bins of 0.1)."""
    bins = lines.groupBy(F.round("font_size", 1).alias("size")).agg(F.sum(F.length("text")).alias("weight"))
    return bins.agg(F.coalesce(F.max_by("size", F.struct("weight", -F.col("size"))), F.lit(9.0)).alias("body_size"))
