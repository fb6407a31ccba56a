"""From documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import written
from quire.llm.line_dedup import dedup_lines, drop_similar
from quire.llm.mixing import apply_mix
from quire.llm.packing import pack
from quire.llm.quality import apply_policy, stored_ledger
from quire.llm.queries import tokenizer_path
from quire.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. Null and empty texts have too few words and go; rows that repeat an id are judged one by one. Empty in, empty out."""
    return apply_policy(stored_ledger(docs)).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line is similar to; one that loses every line stays, empty.

    Earlier is by id (null last), then by place. Null texts stay null; rows that repeat id and text share their lines' fate. Empty in, empty out.
    """
    return dedup_lines(docs).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, on five-word shingles: by covering fingerprints, and then of those left none that an earlier one is similar to by 0.8.

    The smallest id of a group stays. Texts without words, null ones included, are one group of the first step. Empty in, empty out.
    """
    return drop_similar(written(drop_near_copies(docs, shingle=5)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by whole copies and at most one cut a source. Texts without words, null ones included, go; a null source is a source. Empty in, empty out."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences. Repeated rows are packed each; a null text is the end token alone. Empty in, empty out."""
    return pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near), ("mixing to target weights", mixing), ("best-fit packing", packing)]
#: Fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
