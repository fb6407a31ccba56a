"""Connected components of a graph given as edges, for graphs and components of any size."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import salt_of, salted_lookup, written

#: Links that one task contracts in memory.
LOCAL = 1_000_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task -> links from each of their nodes to the least one that they connect it with."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], ["u", "v"])


def _to_least(links: DataFrame, salts: int) -> DataFrame:
    """links (u, v) with m, the least of u and its neighbours; a hub's links are salted."""
    least = links.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return salted_lookup(links, least, ["u"], salt_of(F.col("v"), salts=salts))


def components(edges: DataFrame, salts: int = 64, local: int = LOCAL) -> DataFrame:
    """(node, root): for each node of edges (u, v), two longs, the least node of its component.

    Tasks first contract what links they hold, at most about `local` each, to stars. If that took one task, all is
    connected. Otherwise a large-star and a small-star round hang neighbours on the least neighbour, which never adds links and
    brings far ends together, and tasks contract again. Nothing is collected but counts; each round is a
    table in the shared folder. Nodes without links (and empty tables) have no row.
    """
    links = (written(edges.select("u", "v").filter("u <> v")))
    seen = None
    while True:
        tasks = max(1, math.ceil(links.count() / local))
        links = (written(links.repartition(tasks).mapInArrow(_contracted, "u long, v long").filter("u <> v").distinct()))
        if tasks > 1:
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = _to_least(both, salts).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            near = _to_least(large, salts)
            small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
            links = (written(small.filter("u <> v").distinct()))
            now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now != seen:
                seen = now
                continue
        roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
