"""Translation memory: exact and fuzzy lookup, write-back, eviction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.functions.similarity import Pack

FUZZY, CANDIDATES, SHINGLES = 0.85, 200, 64
#: Texts and characters of a pack of queries, about.
PACK_TEXTS, PACK_CHARS = 256, 65536


#: Which stored rows may answer, from best to worst: whether a human's, whether of the same context, whether of the same domain.
#: A machine's row of another context answers only within its domain, or if it was stored without a context.
SLOTS = ((True, True, True), (True, True, False), (True, False, True), (True, False, False), (False, True, True), (False, True, False), (False, False, True), (False, False, False))


def echoes(provenance: Column, source: Column, target: Column) -> Column:
    """Whether a stored row only carries its source over: a machine's in any case, a human's to the letter."""
    s, t = tx.collapsed(source), tx.collapsed(target)
    return F.when(provenance == "human_pe", s == t).otherwise(F.lower(s) == F.lower(t))


def may_answer(provenance: Column, row_context: Column, row_domain: Column, context: Column, domain: Column) -> Column:
    """Whether a stored row may serve a lookup: a human's always, a machine's of that context, without one, or of that domain."""
    stored = F.coalesce(row_context, F.lit(""))
    return (provenance == "human_pe") | (stored == F.coalesce(context, F.lit(""))) | (stored == "") | F.coalesce((row_domain != "") & (row_domain == domain), F.lit(False))


def _slots(context: Column, domain: Column, human: Column | None = None) -> Column:
    """The slots in which a row is kept (human given) or looked for: struct(slot, c, d), empty strings where context or domain don't matter."""
    c, d, any_ = F.coalesce(context, F.lit("")), F.coalesce(domain, F.lit("")), F.lit("")
    cells = []
    for k, (by_human, same_context, same_domain) in enumerate(SLOTS):
        use = F.lit(True) if human is None else human == F.lit(by_human)
        if same_domain:
            use = use & (d != "")
        if human is not None and not any((by_human, same_context, same_domain)):
            use = use & (c == "")
        cells.append(F.when(use, F.struct(F.lit(k).alias("slot"), (c if same_context else any_).alias("c"), (d if same_domain else any_).alias("d"))))
    return F.filter(F.array(*cells), lambda x: x.isNotNull())


def lookup_exact(blocks: DataFrame, memory: DataFrame, text_col: str = "source_text", context: Column | None = None, domain: Column | None = None) -> DataFrame:
    """blocks with tm_text and tm_id, the best exact hit of memory (src_text, tgt_text, provenance, domain, context_hash, id), or null.

    Texts are equal with white space collapsed (by 128 bits of hash); ids name rows. Rows that carry their source over are out, as are those that may not answer. Best: human before machine, the
    block's context, its domain, then the largest id. Each text keeps one row a slot, context and domain, and each different
    question (text, context, domain) asks eight slots, so neither a hot text nor repeated blocks multiply.
    """
    none = F.lit("")
    asks = [(none if x is None else F.coalesce(x, none)) for x in (context, domain)]
    stored = [F.col(c) if c in memory.columns else none for c in ("context_hash", "domain")]
    keys, cells = ["_k1", "_k2"], ["slot", "c", "d"]
    hashed = lambda text: {"_k1": F.xxhash64(tx.collapsed(text)), "_k2": F.xxhash64(F.lit(1), tx.collapsed(text))}
    rows = memory.filter(~echoes(F.col("provenance"), F.col("src_text"), F.col("tgt_text"))).withColumns(hashed(F.col("src_text")))
    rows = rows.select(*keys, "id", F.explode(_slots(*stored, F.col("provenance") == "human_pe")).alias("s"))
    best = rows.groupBy(*keys, "s.slot", "s.c", "s.d").agg(F.max("id").alias("id"))  # of ids alone, so the combining is by hash
    keyed = blocks.withColumns(hashed(F.col(text_col)) | {"_c": asks[0], "_d": asks[1]})
    asked = keyed.select(*keys, "_c", "_d").distinct().withColumn("s", F.explode(_slots(F.col("_c"), F.col("_d")))).select("*", "s.*").drop("s")
    found = asked.join(best, [*keys, *cells]).groupBy(*keys, "_c", "_d").agg(F.min_by("id", "slot").alias("tm_id"))
    texts = memory.select(F.col("id").alias("tm_id"), F.col("tgt_text").alias("tm_text"))
    found = found.join(texts, "tm_id")
    return keyed.join(found, [*keys, "_c", "_d"], "left").drop(*keys, "_c", "_d")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the words, in order."""
    chars = F.split(F.lower(tx.collapsed(text)), "")
    # bound by an outer lambda, the characters are split once and not for each gram
    cut = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(c, k, n), ""))
    return F.array_distinct(F.get(F.transform(F.array(chars), cut), 0))


def trigram_candidates(queries: DataFrame, memory: DataFrame, query_id: str, query_text: str, memory_id: str, memory_text: str, most: int = CANDIDATES) -> DataFrame:
    """(query, candidate, shared): the `most` memory rows with most shared trigrams, by an inverted index.

    A query asks for its first SHINGLES trigrams; memory rows are indexed whole.
    """
    q = queries.select(F.col(query_id).alias("query"), F.explode(F.slice(shingles(F.col(query_text)), 1, SHINGLES)).alias("g"))
    m = memory.select(F.col(memory_id).alias("candidate"), F.explode(shingles(F.col(memory_text))).alias("g"))
    pairs = q.join(m, "g").groupBy("query", "candidate").agg(F.count(F.lit(1)).alias("shared"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("shared").desc(), "candidate"))
    return pairs.withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")


def lookup_fuzzy(queries: DataFrame, memory: DataFrame, query_id: str, query_text: str, memory_id: str, memory_text: str, least: float = FUZZY) -> DataFrame:
    """(query, candidate, ratio) of all pairs whose Indel ratio is at least `least`, above 0.

    Exact: equal texts are compared once, and any two whose lengths allow the ratio are. Such lengths lie in the same or in
    neighbouring classes. The queries of a class are dealt over packs of bounded size; memory texts are spread over all
    tasks, each of which reads a pack and then its memory texts, by length, as a stream. Rows are found again by 128 bits of hash.
    """
    if least <= 0:
        raise ValueError("every pair has a ratio of 0 or more")
    q = queries.select(F.col(query_id).alias("query"), tx.collapsed(F.col(query_text)).alias("a")).filter("a is not null")
    m = memory.select(F.col(memory_id).alias("candidate"), tx.collapsed(F.col(memory_text)).alias("b")).filter("b is not null")
    step = math.log((2 - least) / least) + 1e-6  # a little wider, so that rounding parts no pair by two classes
    kind = lambda t: F.floor(F.log(F.greatest(F.length(t), F.lit(1))) / step)
    asked = q.select("a").distinct().withColumn("_class", F.explode(F.array(*[kind("a") + k for k in (-1, 0, 1)])))
    packs = asked.groupBy("_class").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PACK_TEXTS, F.sum(F.length("a")) / PACK_CHARS)).alias("_packs"))
    tasks = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.join(packs, "_class").withColumns({"_pack": F.pmod(F.xxhash64("a"), F.col("_packs")), "_task": F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))})
    known = m.select("b").distinct().withColumn("_class", kind("b")).join(packs, "_class").withColumn("_pack", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_packs") - 1)))
    known = known.withColumn("_task", F.pmod(F.xxhash64("b", "_pack"), F.lit(tasks)).cast("int"))
    side = lambda rows, stored, text: rows.select("_task", "_class", "_pack", F.lit(stored).alias("_stored"), F.col(text).alias("_text"))
    both = side(asked, False, "a").unionAll(side(known, True, "b")).repartitionById(tasks, F.col("_task"))
    both = both.sortWithinPartitions("_class", "_pack", "_stored", F.length("_text")).select("_class", "_pack", "_stored", "_text")
    hits = both.mapInArrow(_meet(least), "a string, b string, ratio double")
    keys = lambda text: {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)}
    hits = hits.withColumns(keys("b")).drop("b").join(q, "a").drop("a")
    return hits.join(m.withColumns(keys("b")).drop("b"), ["_k1", "_k2"]).select("query", "candidate", "ratio")


def _meet(least: float):
    """Rows by pack, first its queries, then memory texts by length -> (a, b, ratio)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, texts, pack, held = None, [], None, []

        def found() -> Iterator[pa.RecordBatch]:
            nonlocal pack
            if held and texts:
                pack = pack or Pack(texts, least)
                hits = pack.hits(held)
                columns = [[texts[k] for _, k, _ in hits], [held[k] for k, _, _ in hits], [r for _, _, r in hits]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)], ["a", "b", "ratio"])
            held.clear()

        for batch in batches:
            for *its, stored, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if its != key:
                    yield from found()
                    key, texts, pack = its, [], None
                if stored:
                    held.append(text)
                    if len(held) == Pack.LINES:
                        yield from found()
                else:
                    texts.append(text)
        yield from found()

    return run


def write_back(memory: DataFrame, news: DataFrame, keys: tuple[str, ...] = ("src_hash", "context_hash")) -> DataFrame:
    """memory after an upsert of news: a machine row never replaces a human one, use_count stays, rows of equal keys in news: the last id wins."""
    last = news.groupBy(*keys).agg(F.max_by(F.struct("tgt_text", "provenance", "id"), "id").alias("n"))
    both = memory.join(last, list(keys), "full_outer")
    takes = F.col("n").isNotNull() & (F.col("provenance").isNull() | (F.col("provenance") != "human_pe") | (F.col("n.provenance") == "human_pe"))
    pick = lambda c: F.when(takes, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, F.coalesce("id", "n.id").alias("id"), pick("tgt_text"), pick("provenance"), F.coalesce("use_count", F.lit(0)).alias("use_count"))


def evict(memory: DataFrame, condition: Column) -> DataFrame:
    return memory.filter(~F.coalesce(condition, F.lit(False)))
