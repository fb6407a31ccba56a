"""Exact dedup: local, salted, then global combining of equal texts; DataFrame functions only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, salt_of, without_white

#: Salts fit the bits of one long.
SALTS = 64
_ID = 2**65  # room for every long and, last, for null


def _order_key(n_points: Column, id_: Column) -> Column:
    """A decimal that sorts by code points downwards, then id upwards, null last.

    A fixed-width number keeps the aggregation hash-based, where a struct would force a sort of whole texts.
    """
    wide = F.coalesce(id_.cast("decimal(20,0)") + F.lit(Decimal(2**63)), F.lit(Decimal(2**64)))
    return ((F.lit(2**31) - n_points).cast("decimal(10,0)") * F.lit(Decimal(_ID)) + wide).cast("decimal(38,0)")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after deleting white space; null counts as empty. Of equal
    texts the row with the most code points in the original text stays, then the smallest id
    (a null id is last; ids that are no whole numbers go by their own order). Rows that repeat id and length of the row that stays: one of them has kept = true.
    An empty table gives an empty result. Columns of docs come first; one that clashes with an added name is replaced.

    Stage 1 combines equal texts inside each input split (Spark's partial aggregation), stage 2
    merges the (digest, salt, text) groups, stage 3 the salt winners of each (digest, text).
    The text itself is a grouping key throughout, so two texts are merged only if they are the
    same. The salt is a hash of all other columns. Stage 3 reads at most SALTS rows of any text, however hot and long. Rows then meet their
    group's result on digest, length and a second hash of the text, and salt; no text moves there.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("keep_id", "group_size", "kept", "text_sha256")])
    kind = docs.schema[id_col].dataType
    norm, points, digest, size, second, salt, first, most = (free_name(docs, f"_{n}") for n in ("norm", "points", "digest", "bytes", "second", "salt", "first", "most"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({norm: without_white(text), points: F.length(text)})
    keyed = keyed.withColumns({digest: F.unhex(F.sha2(F.col(norm).cast("binary"), 256)), salt: salt_of(*[F.col(c) for c in docs.columns if c != text_col], salts=SALTS)})

    whole = isinstance(kind, T.IntegralType)
    order = _order_key(F.col(points), F.col(id_col)) if whole else F.struct((-F.col(points)).alias("less"), F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"))
    cells = keyed.groupBy(digest, salt, norm).agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_n"))
    groups = cells.groupBy(digest, norm).agg(
        F.min("_best").alias("_best"), F.sum("_n").alias("group_size"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col(salt))).alias("_salts"),
    )
    wide = F.col("_best") % F.lit(Decimal(_ID)) if whole else None
    keep = F.when(wide < F.lit(Decimal(2**64)), (wide - F.lit(Decimal(2**63))).cast("long")).cast(kind) if whole else F.col("_best.id")
    longest = F.lit(2**31) - F.floor(F.col("_best") / F.lit(Decimal(_ID))) if whole else -F.col("_best.less")
    groups = groups.select(
        digest, F.octet_length(norm).alias(size), F.xxhash64(norm).alias(second), keep.alias("keep_id"), "group_size",
        longest.cast("long").alias(most),
        F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(F.col("_salts"), s) == 1)).alias(salt),
    )

    rows = keyed.withColumns({size: F.octet_length(norm), second: F.xxhash64(norm)}).select(*docs.columns, points, digest, size, second, salt)
    out = rows.join(groups, [digest, size, second, salt])
    stays = F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col(points) == F.col(most))
    return _one_of_repeats(out.withColumn(first, stays), first, [digest, salt, id_col, first]).select(
        *docs.columns, "keep_id", "group_size", F.col(first).alias("kept"), F.lower(F.hex(digest)).alias("text_sha256")
    )


def _one_of_repeats(df: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """flag stays true in one row a key; only rows that repeat an id share a key, and all lie in one partition already."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    return df.withColumn(flag, F.col(flag) & (nth == 1))
