"""Mixing sources to target weights; DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, free_name, written

#: Weights by the source's place among all sources in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A source is used this many times at most.
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """One row a source: source_size, weight, target.

    Water filling: targets are in proportion to the weights, but stop at `most` times the source's
    size, and what is over goes to the others by weight until none is above. With sources in order of
    cap / weight, those that stop at their cap come first, which two running sums decide.
    The windows are over one row a source, in one task: good for millions of sources, not for billions.
    """
    per = sizes.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("_cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col(source_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    per = per.withColumns({
        "_total": F.sum("source_size").over(whole) * F.lit(share), "_caps": F.sum("_cap").over(by_ratio),
        "_rest": F.sum("weight").over(whole) - F.sum("weight").over(by_ratio),
    })
    per = per.withColumn("_full", F.col("_caps") * F.col("weight") + F.col("_cap") * F.col("_rest") <= F.col("_total") * F.col("weight"))
    left = F.col("_total") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(F.lit(0))).over(whole)
    open_ = F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(F.lit(0))).over(whole)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * left.cast("double") / open_)
    return per.select(source_col, "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """id, source, size, source_size, target and taken of every row of docs.

    size: words of the text (null: 0). taken: words that the mix takes of the row, repeats counted:
    a source goes round whole as often as its target allows, then its rows in hash order follow up to
    the rest of the target, the last one cut inside. A source's taken words add up to its target, rounded down;
    no row is taken more than `most` times. Null ids and sources are values like any other;
    rows that repeat an id and a size are interchangeable. Empty texts take nothing. An empty table gives an empty result.

    The hash keys are uniform, so fixed ranges of them are a range partition without sampling.
    With sqrt(rows) ranges, each task sums about sqrt(rows) rows of a source and each source's
    ranges are as many again: two small levels of prefix sums, whatever share of rows one source holds.
    """
    spark = docs.sparkSession
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    sizes = docs.select(F.col(id_col), F.col(source_col), word_count(F.col(text_col)).alias("size"), key.alias("_key"))
    sizes = written(sizes)
    ranges = max(1, math.isqrt(sizes.count()))
    targets = written(source_targets(sizes, source_col, weights, most, share))
    width = 2**60 // ranges + 1
    sizes = sizes.withColumn("_range", F.floor(F.col("_key") / F.lit(width)).cast("long") if ranges > 1 else F.lit(0).cast("long"))

    sums = sizes.groupBy(source_col, "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy(source_col).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    t, s = targets.alias("t"), sums.alias("s")
    bases = s.join(t, F.col(f"s.{source_col}").eqNullSafe(F.col(f"t.{source_col}"))).select("s.*", "t.source_size", "t.target").alias("b")
    rows = sizes.alias("r").join(bases, F.col(f"r.{source_col}").eqNullSafe(F.col(f"b.{source_col}")) & (F.col("r._range") == F.col("b._range"))).select("r.*", "b._base", "b.source_size", "b.target")

    inside = Window.partitionBy(source_col, "_range").orderBy("_key", F.col(id_col).asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - F.col("_rounds") * F.col("source_size")
    rows = rows.withColumns({"_start": start, "_rounds": rounds})
    taken = F.col("_rounds") * F.col("size") + F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size"))
    return rows.select(id_col, source_col, "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """The mixed corpus: rows of docs as often as the mix takes them whole, and the row of a source that the budget cuts with its first words.

    Columns are those of docs; n_chars, where there is one, follows a cut text. Rows match their shares by id, source and size, and
    rows that repeat all three one by one. Rows of which nothing is taken, those without words included, are left out.
    """
    shares = mix(docs, id_col, text_col, source_col, **how)
    size, taken, nth = (free_name(docs, f"_{x}") for x in ("size", "taken", "nth"))
    numbered = lambda df, keys, by: df.withColumn(nth, F.row_number().over(Window.partitionBy(*keys).orderBy(by)))
    shares = numbered(shares.select(id_col, source_col, F.col("size").alias(size), F.col("taken").alias(taken)), [id_col, source_col, size], F.col(taken).desc()).alias("s")
    rows = numbered(docs.withColumn(size, word_count(F.col(text_col))), [id_col, source_col, size], F.lit(1)).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (id_col, source_col)] + [F.col(f"r.{c}") == F.col(f"s.{c}") for c in (size, nth)]
    rows = rows.join(shares, reduce(and_, same)).select("r.*", F.col(f"s.{taken}").alias(taken)).filter(F.col(taken) > 0)
    # an entry for each whole copy (-1), and one with the number of words left over
    whole, part = F.floor(F.col(taken) / F.col(size)).cast("int"), (F.col(taken) % F.col(size)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn(nth, F.explode(copies))
    pieces = F.split(F.col(text_col), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    rows = rows.withColumn(text_col, F.when(F.col(nth) < 0, F.col(text_col)).otherwise(F.array_join(F.slice(pieces, 1, F.col(nth)), "")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(nth) < 0, F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
