"""Operators over blocks in reading order: neighbours, sections, running states, paging, packing."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx

_ORDER = ("spine_index", "block_id")


def _w(*keys: str):
    return Window.partitionBy(*keys).orderBy(*_ORDER)


def neighbours(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "source_text", reach: int = 5, chars: int = 300) -> DataFrame:
    """blocks with the last `chars` of up to `reach` texts before, and the first of those after, joined by newlines."""
    before = F.array_join(F.collect_list(text).over(_w(*keys).rowsBetween(-reach, -1)), "\n")
    after = F.array_join(F.collect_list(text).over(_w(*keys).rowsBetween(1, reach)), "\n")
    return blocks.withColumns({"tail_before": F.right(before, F.lit(chars)), "head_after": F.left(after, F.lit(chars))})


def sections(blocks: DataFrame, is_opener: Column, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """blocks with section (how many openers so far) and heading (the latest opener's text)."""
    w = _w(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumns({"section": F.sum(is_opener.cast("int")).over(w), "heading": F.last(F.when(is_opener, F.col("source_text")), ignorenulls=True).over(w)})


def section_trail(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",), levels: int = 6) -> DataFrame:
    """blocks with trail, the headings above them by level: a heading ends all of its level and below."""
    w = _w(*keys).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(_w(*keys))
    out = blocks.withColumn("_at", place)
    for k in range(1, levels + 1):
        here = F.last(F.when(F.col("level") == k, F.struct("_at", "source_text")), ignorenulls=True).over(w)
        cut = F.max(F.when(F.col("level") < k, F.col("_at"))).over(w)
        out = out.withColumns({f"_h{k}": here, f"_c{k}": cut})
    alive = [F.when(F.col(f"_h{k}._at") > F.coalesce(f"_c{k}", F.lit(0)), F.col(f"_h{k}.source_text")) for k in range(1, levels + 1)]
    return out.withColumn("trail", F.array_compact(F.array(*alive))).drop("_at", *[f"_{a}{k}" for a in "hc" for k in range(1, levels + 1)])


def bibliography_state(blocks: DataFrame, is_entry: Column, is_heading: Column, is_title: Column, keys: tuple[str, ...] = ("doc_id",), look: int = 6) -> DataFrame:
    """blocks with in_bibliography: a bibliography title opens it if an entry follows within `look` blocks; another heading or running text with none in sight closes it; else it holds."""
    soon = F.coalesce(F.max(is_entry.cast("int")).over(_w(*keys).rowsBetween(1, look)), F.lit(0)) == 1
    event = F.when(is_heading & is_title & soon, True).when(is_heading & ~soon, False).when(~is_heading & ~is_entry & ~soon, False)
    out = blocks.withColumn("_event", event)
    return out.withColumn("in_bibliography", F.coalesce(F.last("_event", ignorenulls=True).over(_w(*keys).rowsBetween(Window.unboundedPreceding, 0)), F.lit(False))).drop("_event")


def fuse_continuations(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Paragraphs split in two are one again: a paragraph follows one that does not end a sentence and starts in lower case or CJK. One row an island."""
    w = _w(*keys)
    goes_on = (F.lag("block_type").over(w) == "paragraph") & (F.col("block_type") == "paragraph") & ~F.lag("source_text").over(w).rlike(r"""[.!?。！？:;"”)]$""") & F.col("source_text").rlike(r"^[\p{Ll}㐀-鿿]")
    marked = blocks.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("spine_index", "block_id", "source_text")))
    out = marked.groupBy(*keys, "_island").agg(parts.alias("_p"), F.first("block_type").alias("block_type"))
    return out.select(*keys, F.get("_p", 0)["spine_index"].alias("spine_index"), F.get("_p", 0)["block_id"].alias("block_id"), "block_type", F.size("_p").alias("n_parts"), tx.joined(F.transform("_p", lambda x: x["source_text"])).alias("source_text"))


def tail_budget(blocks: DataFrame, keys: tuple[str, ...] = ("doc_id",), chars: int = 3000) -> DataFrame:
    """The last blocks of each key whose texts fit in `chars` together."""
    back = Window.partitionBy(*keys).orderBy(F.col("spine_index").desc(), F.col("block_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("_sum", F.sum(F.length("source_text")).over(back)).filter(F.col("_sum") <= chars).drop("_sum")


def keyset_page(blocks: DataFrame, after: tuple[int, str], limit: int) -> DataFrame:
    """The next `limit` blocks after a (spine_index, block_id)."""
    a, b = after
    later = (F.col("spine_index") > a) | ((F.col("spine_index") == a) & (F.col("block_id") > b))
    return blocks.filter(later).orderBy(*_ORDER).limit(limit)


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """A page, its size clamped to 1 .. 500."""
    size = max(1, min(500, size))
    return rows.orderBy(*order).offset(max(0, page) * size).limit(size)


def longest_run(lines: DataFrame, key: str = "doc_id", place: str = "spine_index", text: str = "source_text") -> DataFrame:
    """key, run: the longest run of equal lines in a row."""
    w = Window.partitionBy(key).orderBy(place)
    marked = lines.withColumn("_new", (~F.col(text).eqNullSafe(F.lag(text).over(w)) | F.lag(place).over(w).isNull()).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_run").count().groupBy(key).agg(F.max("count").alias("run"))


def longest_non_decreasing(numbers: list[int]) -> list[int]:
    """Places of a longest non-decreasing subsequence, in n log n."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, x in enumerate(numbers):
        at = bisect_right(tails, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(k)
        else:
            tails[at], ends[at] = x, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def page_number_lines(lines: DataFrame, least: int = 4, share: float = 0.5) -> DataFrame:
    """(doc_id, spine_index) of lines that are page numbers: digit lines in a longest non-decreasing order, if at least `least` and that share of them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        digits = pdf[pdf.source_text.str.fullmatch(r"\s*[0-9]{1,6}\s*")].sort_values("spine_index")
        keep = longest_non_decreasing([int(x) for x in digits.source_text])
        if len(keep) < least or len(keep) < share * len(digits):
            keep = []
        return digits.iloc[keep][["doc_id", "spine_index"]]

    return lines.filter(F.col("source_text").rlike(r"^\s*[0-9]{1,6}\s*$")).select("doc_id", "spine_index", "source_text").groupBy("doc_id").applyInPandas(run, lines.select("doc_id", "spine_index").schema)


def chunks(blocks: DataFrame, size: int = 8) -> DataFrame:
    """blocks with chunk: a new one at a heading after other text, or when `size` blocks are in it. Sequential, a document at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["spine_index", "block_id"])
        out, chunk, n, prose = [], 0, 0, False
        for kind in pdf.block_type:
            if n and (n >= size or (kind == "heading" and prose)):
                chunk, n, prose = chunk + 1, 0, False
            n, prose = n + 1, prose or kind != "heading"
            out.append(chunk)
        return pdf.assign(chunk=out)

    from pyspark.sql import types as T

    return blocks.groupBy("doc_id").applyInPandas(run, T.StructType([*blocks.schema.fields, T.StructField("chunk", T.IntegerType())]))


def boilerplate(lines: DataFrame, by: str, share: float = 0.4, least: int = 3, doc: str = "doc_id", text: str = "source_text") -> DataFrame:
    """(by, text, n_docs): lines in at least max(least, share) of a group's documents. Distinct pairs are counted, so a common line costs a row a document."""
    total = lines.groupBy(by).agg(F.countDistinct(doc).alias("_total"))
    n = lines.select(by, doc, text).distinct().groupBy(by, text).agg(F.count(F.lit(1)).alias("n_docs"))
    return n.join(total, by).filter(F.col("n_docs") >= F.greatest(F.lit(least), F.col("_total") * share)).drop("_total")




def dropped_lines(lines: DataFrame, all_numbers: bool = False) -> DataFrame:
    """(doc_id, spine_index) of lines that are structural noise or page numbers.

    A line of digits goes if it is a page number (or all_numbers) or stands beside noise, but stays before a title or item, after
    a line that ends in a colon, and while such a list counts on by one. Blank lines are passed over.
    """
    from quire.functions import names

    by = Window.partitionBy("doc_id").orderBy("spine_index")
    full = lines.select("doc_id", "spine_index", "source_text").filter(F.col("source_text").rlike(r"(?U)\S"))
    rows = full.select("*", F.lag("source_text").over(by).alias("_before"), F.lead("source_text").over(by).alias("_after"))
    noise = rows.filter(names.calibre_noise(F.col("source_text"))).select("doc_id", "spine_index")
    digits = rows.filter(F.col("source_text").rlike(r"^\s*[0-9]{1,18}\s*$") & ~F.coalesce(names.heading_or_item(F.col("_after")), F.lit(False)))
    digits = digits.withColumns({"_v": F.trim("source_text").cast("long"), "_opens": F.coalesce(F.col("_before").rlike(r"(?U):\s*$"), F.lit(False))})
    breaks = (F.col("_opens") | F.coalesce(F.col("_v") != F.lag("_v").over(by) + 1, F.lit(True))).cast("int")
    digits = digits.withColumn("_breaks", breaks).withColumn("_run", F.sum("_breaks").over(by))
    listed = F.first("_opens").over(Window.partitionBy("doc_id", "_run").orderBy("spine_index").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beside = F.coalesce(names.calibre_noise(F.col("_before")), F.lit(False)) | F.coalesce(names.calibre_noise(F.col("_after")), F.lit(False))
    loose = digits.withColumn("_listed", listed).filter(~F.col("_listed")).select("doc_id", "spine_index", beside.alias("_beside"))
    if all_numbers:
        return noise.unionByName(loose.select("doc_id", "spine_index"))
    numbers = page_number_lines(lines).withColumn("_number", F.lit(True))
    gone = loose.join(numbers, ["doc_id", "spine_index"], "left").filter(F.col("_beside") | F.col("_number"))
    return noise.unionByName(gone.select("doc_id", "spine_index"))


def clean_lines(lines: DataFrame, all_numbers: bool = False) -> DataFrame:
    """lines without those that dropped_lines names."""
    return lines.join(dropped_lines(lines, all_numbers), ["doc_id", "spine_index"], "left_anti")
