"""Operators over whole documents: citations and notes, differences between versions, tables over pages, running memory, budgets."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.similarity import indel_ratio

# What mentions and anchors look like, by kind.
KINDS = {"fig": r"(?:Figure|Fig\.)", "tbl": r"(?:Table|Tab\.)", "eq": r"(?:Equation|Eq\.)", "sec": r"(?:Section|Sec\.|§)"}
KEY = r"([0-9]+(?:\.[0-9]+)*)"
SNAPSHOT_CHARS, SNAPSHOT_LEAST, EPOCH = 3500, 300, 5
PAIRED, SAME_TYPE = 0.40, 0.05


def mentions(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, kind, key) of each mention of a figure, table, equation or section in running text; captions are none."""
    parts = [
        blocks.filter(~F.col("source_text").rlike(rf"^\s*{name}\s*{KEY}\s*[:.]")).select("doc_id", "block_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("source_text", F.lit(rf"\b{name}\s*{KEY}"), F.lit(1))).alias("key"))
        for kind, name in KINDS.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def anchors(blocks: DataFrame) -> DataFrame:
    """(doc_id, kind, key, block_id) of captions and the like; of several for a key the last in reading order."""
    rows = blocks.select("doc_id", "spine_index", "block_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("source_text", rf"^\s*{name}\s*{KEY}\s*[:.]", 1).alias("key")) for k, name in KINDS.items()])).alias("a"))
    return rows.filter("a.key <> ''").groupBy("doc_id", "a.kind", "a.key").agg(F.max_by("block_id", F.struct("spine_index", "block_id")).alias("block_id"))


def citation_topology(blocks: DataFrame) -> DataFrame:
    """By document: mentions, those with an anchor, and their share (1 for none)."""
    found = mentions(blocks).withColumnRenamed("block_id", "from_block").join(anchors(blocks), ["doc_id", "kind", "key"], "left")
    out = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("found"), F.count("block_id").alias("resolved"))
    return out.withColumn("resolution_rate", F.coalesce(F.try_divide("resolved", "found"), F.lit(1.0)))


def notes(callouts: DataFrame, definitions: DataFrame) -> DataFrame:
    """Callouts and definitions (chapter, key, place) of notes paired one to one in order; what has no partner stands alone."""
    nth = F.row_number().over(Window.partitionBy("chapter", "key").orderBy("place"))
    a = callouts.withColumn("n", nth).withColumnRenamed("place", "callout")
    b = definitions.withColumn("n", nth).withColumnRenamed("place", "definition")
    return a.join(b, ["chapter", "key", "n"], "full_outer").select("chapter", "key", "callout", "definition", F.when(F.col("definition").isNull(), "orphan_callout").when(F.col("callout").isNull(), "orphan_definition").otherwise("paired").alias("state"))


def diff_blocks(base: DataFrame, revised: DataFrame) -> DataFrame:
    """(doc_id, op, base_id, revised_id) between versions of documents: equal, changed, added or removed.

    Sequences of texts are aligned a document at a time; in replaced stretches blocks pair by similarity, at least PAIRED, best first.
    """
    sides = base.select("doc_id", F.lit(0).alias("side"), "spine_index", "block_id", "block_type", "source_text").unionByName(revised.select("doc_id", F.lit(1).alias("side"), "spine_index", "block_id", "block_type", "source_text"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf.side == k].sort_values(["spine_index", "block_id"]).to_dict("records") for k in (0, 1))
        key = lambda r: " ".join(r["source_text"].split())
        out = []
        for op, i, j, k, m in SequenceMatcher(None, list(map(key, a)), list(map(key, b)), autojunk=False).get_opcodes():
            if op == "equal":
                out += [("equal", x["block_id"], y["block_id"]) for x, y in zip(a[i:j], b[k:m], strict=True)]
                continue
            scored = sorted(((indel_ratio(key(x), key(y)) + SAME_TYPE * (x["block_type"] == y["block_type"]), -p, -q) for p, x in enumerate(a[i:j]) for q, y in enumerate(b[k:m])), reverse=True)
            left, right = set(range(j - i)), set(range(m - k))
            for s, p, q in scored:
                if s >= PAIRED and -p in left and -q in right:
                    left.discard(-p)
                    right.discard(-q)
                    out.append(("changed", a[i - p]["block_id"], b[k - q]["block_id"]))
            out += [("removed", a[i + p]["block_id"], None) for p in sorted(left)] + [("added", None, b[k + q]["block_id"]) for q in sorted(right)]
        return pd.DataFrame([(pdf.doc_id.iloc[0], *r) for r in out], columns=["doc_id", "op", "base_id", "revised_id"])

    kind, block = sides.schema["doc_id"].dataType, sides.schema["block_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("op", T.StringType()), T.StructField("base_id", block), T.StructField("revised_id", block)])
    return sides.groupBy("doc_id").applyInPandas(run, schema)


def snapshots(blocks: DataFrame, chars: int = SNAPSHOT_CHARS, least: int = SNAPSHOT_LEAST, epoch: int = EPOCH) -> DataFrame:
    """blocks (doc_id, chapter_id) with snapshot and epoch: a snapshot ends at `chars` characters, or with its chapter if it has `least` characters or two blocks; `epoch` of them make an epoch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["spine_index", "block_id"])
        out, number, n, blocks_in, chapter = [], 0, 0, 0, None
        for c, t in zip(pdf.chapter_id, pdf.source_text, strict=True):
            if blocks_in and (n >= chars or (c != chapter and (n >= least or blocks_in >= 2))):
                number, n, blocks_in = number + 1, 0, 0
            n, blocks_in, chapter = n + len(t), blocks_in + 1, c
            out.append(number)
        return pdf.assign(snapshot=out, epoch=[x // epoch for x in out])

    return blocks.groupBy("doc_id").applyInPandas(run, T.StructType([*blocks.schema.fields, T.StructField("snapshot", T.IntegerType()), T.StructField("epoch", T.IntegerType())]))


def stitched_tables(tables: DataFrame) -> DataFrame:
    """tables (doc_id, spine_index, page, n_columns, header, label) with part_of: the first table that each continues: next page at most, as many columns, and a label of continuation or the same header."""
    w = Window.partitionBy("doc_id").orderBy("spine_index")
    goes_on = (F.col("n_columns") == F.lag("n_columns").over(w)) & (F.col("page") - F.lag("page").over(w) <= 1) & (F.coalesce(F.col("label"), F.lit("")).rlike(r"(?i)continued|cont\.|续表") | (F.col("header") == F.lag("header").over(w)))
    marked = tables.withColumn("_first", F.when(~F.coalesce(goes_on, F.lit(False)), F.col("spine_index")))
    return marked.withColumn("part_of", F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def text_in_budget(text: str, tokens: int, cost) -> str:
    """Whole paragraphs while they fit, the first in any case; a single one that does not fit by lines, then by characters."""
    if cost(text) <= tokens:
        return text
    for mark in ("\n\n", "\n"):
        parts, kept = text.split(mark), []
        for p in parts:
            if cost(mark.join([*kept, p])) > tokens:
                break
            kept.append(p)
        if kept:
            return mark.join(kept)
    return text[: tokens * 3]


def table_in_budget(table: str, tokens: int, cost) -> str:
    """Header and delimiter, then each row that still fits, in order; rows that do not fit are passed over."""
    head, *rows = [x for x in table.split("\n") if x.strip()]
    kept = [head, *rows[:1]]
    for r in rows[1:]:
        if cost("\n".join([*kept, r])) <= tokens:
            kept.append(r)
    return "\n".join(kept)
