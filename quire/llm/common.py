"""Pieces that the operators share: white space, shared storage, skew-safe lookups."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
#: One word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's setting that removes a query's shuffle files at its end; lost ones are computed again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the size of the hash map in compiled code, by a power of two.
FAST_MAP = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (as in tests) gets a temporary one; a cluster is an error, since no machine's own folder is shared."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def written(df: DataFrame, codec: str = "zstd", conf: dict[str, str] | None = None) -> DataFrame:
    """df, computed once and read back from a table in the shared folder; lineage ends there, so a lost executor costs no recomputation.

    The write's shuffle files go when it ends, so they do not pile up. Settings in conf hold for the write alone.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire/{uuid.uuid4().hex}"
    conf = {CLEANUP: "true"} | (conf or {})
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df.write.option("compression", codec).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def without_white(text: Column) -> Column:
    """text without any character of WHITE; each replace is a plain byte scan."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """The words of a text. A split at one plain character is several times as fast as a pattern."""
    for c in WHITE[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use yet (names compare without case)."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def salt_of(*cols: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_lookup(rows: DataFrame, table: DataFrame, keys: list[str], salt: Column, how: str = "inner", keep_salt: bool = False) -> DataFrame:
    """rows joined with table (one row a key) on keys, safe where one key holds a large share of rows.

    The distinct (key, salt) cells of rows, at most as many a key as there are salts, take the key's values from
    table first; rows then meet their cell on (key, salt). No task reads more than about
    1 / salts of a hot key's rows. Keys that are null match nothing. With keep_salt the result
    has _salt, and is partitioned by the keys and it.
    """
    own = "_salt"
    while not keep_salt and own in {c.lower() for c in (*rows.columns, *table.columns)}:
        own += "_"
    rows = rows.withColumn(own, salt)
    cells = rows.select(*keys, own).distinct().join(table, keys)
    out = rows.join(cells, [*keys, own], how)
    return out if keep_salt else out.drop(own)
