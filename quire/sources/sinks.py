"""Writers: reports, block documents as Markdown, revisions from CSV, and a cache by content."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a revision table, how block types look in Markdown, entries of a cache and how far it is cut back.
REVISION_COLUMNS = ("block_id", "revised_translation")
CACHE_ENTRIES, CACHE_KEEP, SHARD = 100_000, 0.9, 2


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def write_whole(df: DataFrame, path: str, form: str = "json", partition_by: tuple[str, ...] = ()) -> str:
    """Writes df beside path and moves it there when it is whole, so readers see the old result or the new one; works on any Hadoop file system."""
    fs, path_of = _files(df.sparkSession, path)
    beside, old = f"{path.rstrip('/')}.{uuid.uuid4().hex}", f"{path.rstrip('/')}.old.{uuid.uuid4().hex}"
    try:
        df.write.format(form).partitionBy(*partition_by).save(beside)
        if fs.exists(path_of(path)):
            fs.rename(path_of(path), path_of(old))
        if not fs.rename(path_of(beside), path_of(path)):
            raise OSError(f"could not move the result to {path}")
    finally:
        for rest in (beside, old):
            fs.delete(path_of(rest), True)
    return path


def save_report(report: DataFrame, path: str, key: str) -> str:
    """One JSON line a report, in files of their own folder by key."""
    return write_whole(report, path, "json", (key,))


def markdown(blocks: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """(key, content): documents written from blocks (block_type, level, marker) in order, an empty line between blocks.

    A document's blocks meet in one row, as its file must; their texts are rendered before that.
    """
    t = F.coalesce(text, F.lit(""))
    line = (
        F.when(F.col("block_type") == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1))))), F.lit(" "), t))
        .when(F.col("block_type") == "list_item", F.concat(F.coalesce(F.nullif("marker", F.lit("")), F.lit("-")), F.lit(" "), t))
        .when(F.col("block_type") == "code", F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(F.col("block_type") == "formula", F.concat(F.lit("$$\n"), t, F.lit("\n$$")))
        .when(F.col("block_type") == "quote", F.concat(F.lit("> "), F.replace(t, F.lit("\n"), F.lit("\n> ")))).otherwise(t)
    )
    rows = blocks.select(key, "spine_index", line.alias("_line")).filter(F.trim("_line") != "")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("spine_index", "_line"))), lambda x: x["_line"])
    return rows.groupBy(key).agg(F.concat(F.array_join(ordered, "\n\n"), F.lit("\n")).alias("content"))


def csv_revisions(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, text, job_id or null) from CSV files with a header; a file without the columns is an error, rows without id or text are left out, of repeated ids one stays."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    named = {c.lstrip("\ufeff"): c for c in rows.columns}
    if lacks := [c for c in REVISION_COLUMNS if c not in named]:
        raise ValueError(f"the table of revisions lacks {', '.join(lacks)}; it has {', '.join(named)}")
    clean = lambda c: F.nullif(F.trim(F.col(f"`{named[c]}`")), F.lit(""))
    job = clean("job_id") if "job_id" in named else F.lit(None).cast("string")
    return rows.select(clean("block_id").alias("block_id"), clean("revised_translation").alias("text"), job.alias("job_id")).dropna(subset=["block_id", "text"]).dropDuplicates(["block_id"])


def _shard() -> Column:
    """A folder's name from the key; the letter keeps it from being read as a number."""
    return F.concat(F.lit("s"), F.substring("key", 1, SHARD)).alias("shard")


class ContentCache:
    """Values by content key, as a table partitioned by the first digits of the key; every put is a whole new part.

    get joins on the key, so only asked shards are read. prune drops the oldest beyond the limit, down to CACHE_KEEP of it.
    """

    def __init__(self, spark: SparkSession, path: str, entries: int = CACHE_ENTRIES):
        self.spark, self.path, self.entries = spark, path, entries

    def _rows(self) -> DataFrame | None:
        fs, path_of = _files(self.spark, self.path)
        return self.spark.read.parquet(self.path) if fs.exists(path_of(self.path)) else None

    def put(self, rows: DataFrame, now: float) -> None:
        """rows: key, value."""
        rows.select("key", "value", F.lit(now).alias("at"), _shard()).write.mode("append").partitionBy("shard").parquet(self.path)

    def get(self, keys: DataFrame) -> DataFrame:
        """keys (key) with value, the newest of the key, or null."""
        rows = self._rows()
        if rows is None:
            return keys.withColumn("value", F.lit(None).cast("string"))
        asked = keys.withColumn("shard", _shard())
        newest = rows.join(asked.select("shard", "key").distinct(), ["shard", "key"], "left_semi").groupBy("key").agg(F.max_by("value", "at").alias("value"))
        return keys.join(newest, "key", "left")

    def prune(self) -> None:
        rows = self._rows()
        if rows is None:
            return
        newest = rows.groupBy("key").agg(F.max("at").alias("at"), F.max_by("value", "at").alias("value"))
        if newest.count() > self.entries:
            kept = newest.orderBy(F.col("at").desc(), "key").limit(int(self.entries * CACHE_KEEP))
            write_whole(kept.select("key", "value", "at", _shard()), self.path, "parquet", ("shard",))
