"""Structured Streaming: blocks of arriving documents, job progress with late events, and upserts into a table."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators.states import merge_checkpoints
from quire.operators.terms import abbreviations
from quire.sources.blocks import line_blocks, typed


def stream_of(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder, at most `files` a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def block_stream(documents: DataFrame) -> DataFrame:
    """Typed blocks of arriving documents; row-local, so no state is kept."""
    return typed(line_blocks(documents))


def progress(events: DataFrame, at: str = "ts", key: str = "user_id", kind: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events counted by window, key and kind; those later than the watermark are dropped with their window's state."""
    w = F.window(at, window)
    return events.withWatermark(at, late).groupBy(w, key, kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, kind, "n")


def upsert(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Folds batches of updates (job_id, block_id, status, target_text, seq) into a table of blocks in folder: batch n is read from version n - 1 and written as version n, so a batch that runs again repeats itself.

    In a batch the highest seq of a block wins.
    """

    def fold(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("job_id", "block_id").agg(F.max_by(F.struct("status", "target_text"), "seq").alias("x")).select("job_id", "block_id", "x.status", "x.target_text")
        if n:
            old = spark.read.parquet(f"{folder}/version={n - 1}")
            fresh = last.join(old, ["job_id", "block_id"], "left_anti")
            last = merge_checkpoints(old, last).unionByName(fresh)
        last.write.mode("overwrite").parquet(f"{folder}/version={n}")

    return updates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flushed(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, seconds: float = 0.0, tries: int = 3, pause: float = 0.2) -> StreamingQuery:
    """Hands batches to `write`, as soon as there are rows or every so many seconds. A failing write is tried again; after `tries` the query fails, and a
    restart begins with that batch."""

    def flush(batch: DataFrame, n: int) -> None:
        for k in range(tries):
            try:
                return write(batch, n)
            except Exception:
                if k + 1 == tries:
                    raise
                time.sleep(pause * 2**k)

    out = rows.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def abbreviation_stream(blocks: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Abbreviations of arriving blocks (doc_id, spine_index, source_text), one row an acronym: version n of the table is version n - 1 and
    what batch n adds; an acronym that is known keeps its expansion."""

    def fold(batch: DataFrame, n: int) -> None:
        news = abbreviations(batch)
        if n:
            old = batch.sparkSession.read.parquet(f"{folder}/version={n - 1}")
            news = old.unionByName(news.join(old.select(F.lower("acronym").alias("_a")), F.lower("acronym") == F.col("_a"), "left_anti"))
        news.write.mode("overwrite").parquet(f"{folder}/version={n}")

    return blocks.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def name_counts(blocks: DataFrame, pattern: str = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}{2,}") -> DataFrame:
    """(name, n) of capitalised words in mid-sentence of arriving blocks, counted as they come; a block is counted once, so no text is counted twice."""
    names = blocks.select(F.explode(F.regexp_extract_all("source_text", F.lit(pattern), F.lit(0))).alias("name"))
    return names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def changes(snapshots: DataFrame, at: str = "ts", key: str = "job_id", values: tuple[str, ...] = ("status", "percent"), late: str = "10 minutes") -> DataFrame:
    """Of arriving snapshots of jobs the first of each state, for all who listen; state is kept for as long as the watermark."""
    return snapshots.withWatermark(at, late).dropDuplicatesWithinWatermark([key, *values])


class WriterLease:
    """One writer a table: a lease file that only its owner renews and anyone may take once it has run out. Files are made beside and renamed, which a Hadoop file system does for one of several."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 60.0):
        self.spark, self.path, self.seconds, self.owner = spark, path, seconds, uuid.uuid4().hex

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def holder(self, now: float) -> str | None:
        """Who holds the lease now."""
        fs, path_of = self._fs()
        if not fs.exists(path_of(self.path)):
            return None
        owner, until = self.spark.read.text(self.path).first()[0].split()
        return owner if float(until) > now else None

    def acquire(self, now: float) -> bool:
        """Takes or renews the lease; False while another holds it."""
        if self.holder(now) not in (None, self.owner):
            return False
        fs, path_of = self._fs()
        beside = f"{self.path}.{uuid.uuid4().hex}"
        stream = fs.create(path_of(beside))
        stream.write(f"{self.owner} {now + self.seconds}".encode())
        stream.close()
        fs.delete(path_of(self.path), False)
        return bool(fs.rename(path_of(beside), path_of(self.path))) and self.holder(now) == self.owner

    def release(self, now: float) -> None:
        if self.holder(now) == self.owner:
            fs, path_of = self._fs()
            fs.delete(path_of(self.path), False)
