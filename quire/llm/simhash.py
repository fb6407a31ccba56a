"""SimHash near-dedup with covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, salt_of, salted_lookup, written
from quire.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks such that any `radius` bit positions lie outside at least one of them.

    Each position gets a nonzero vector of radius + 1 bits; mask v keeps the positions whose
    vector has odd overlap with v. `radius` vectors never span the space, so some nonzero v is orthogonal to
    all of them: that mask keeps none of those positions. 2^(radius+1) - 1 masks keep about 4/7 of the bits at radius 2.
    """
    span = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % span + 1) & v).bit_count() % 2) for v in range(1, span + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is 1 if set in over half of the shingles' hashes; 0 for a text without words."""
    from xxhash import xxh64_intdigest as h

    words = text.encode("utf-8", "replace").lower().split()  # of bytes: A-Z only, and the six white-space bytes
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return h(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.array([h(flat[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")  # noqa: B905
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        counts += np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fingerprint long) of every row; null texts count as empty."""
    schema = T.StructType([*(docs.schema[c] for c in (id_col, *carry)), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(x.as_py() or "", shingle)) for x in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], schema.names)

    return docs.select(id_col, *carry, text_col).mapInArrow(run, schema)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column f) at most two bits apart, enough of them to connect all such pairs.

    Covering tables find who may be close: within the radius two fingerprints share a masked key in some
    table, so only members of keys with company go on. Those are verified by meeting half-way: two
    fingerprints at most two bits apart, equal under the mask, share a value that is at most one unmasked bit
    from each; and any two that share one are at most two bits apart. At most BITS + 1 fingerprints can share
    a value, so a value's members make a small star, and cost is linear in members however large a key's group is.
    """
    if radius != 2:
        raise ValueError("verification by shared neighbours is for a radius of 2")
    tables = masks(radius)
    keyed = prints.select("f", F.explode(F.array(*[F.struct(F.lit(k).alias("t"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(tables)])).alias("x")).select("f", "x.t", "x.key")
    company = keyed.groupBy("t", "key").count().filter("count > 1").drop("count")
    members = salted_lookup(keyed, company, ["t", "key"], salt_of(F.col("f"), salts=64)).select("f", "t").distinct()
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in tables]), F.col("t") + 1)
    near = members.select("f", F.explode(flips).alias("flip")).select("f", F.col("f").bitwiseXOR(F.col("flip")).alias("value"))
    shared = near.groupBy("value").agg(F.min("f").alias("v"), F.collect_set("f").alias("all")).filter(F.size("all") > 1)
    return shared.select(F.explode("all").alias("u"), "v").filter("u <> v").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, fingerprint as 16 hex digits, component_id) of every row of docs.

    component_id is the smallest id among all rows reachable by links between fingerprints that differ in at most two bits; rows with
    equal fingerprints, texts without words included, are one. Null texts count as empty, null ids never name a component
    (a component of null ids alone has a null one), and rows that repeat an id are kept. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle, carry))
    distinct = written(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min(id_col).alias("least")))
    roots = components(links(distinct))
    labelled = written(distinct.join(roots, distinct.f == roots.node, "left").select("f", "least", F.coalesce("root", "f").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = salted_lookup(labelled, smallest, ["root"], salt_of(F.col("f"), salts=64)).select(F.col("f").alias("fingerprint"), "component_id")
    out = salted_lookup(prints, written(named), ["fingerprint"], salt_of(F.col(id_col), salts=64))
    return out.select(id_col, *carry, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with one row of each component: that of the smallest id (of the null id, where a component has no other).

    Where several rows have that id, one of each distinct text of them in the component stays. Columns are those of docs.
    """
    own = free_name(docs, "_text")
    docs_ = docs.withColumn(own, F.xxhash64(text_col))
    first = near_dedup(docs_, id_col, text_col, shingle, (own,)).filter(F.col(id_col).eqNullSafe(F.col("component_id")))
    first = first.select(F.col(id_col).alias("id"), F.col(own).alias("of")).distinct().alias("f")
    rows = docs_.alias("d").join(first, F.col(f"d.{id_col}").eqNullSafe(F.col("f.id")) & (F.col(f"d.{own}") == F.col("f.of")), "left_semi")
    return rows.dropDuplicates([id_col, own]).select(*docs.columns)
