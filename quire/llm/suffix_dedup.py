"""Suffix-array dedup: every byte of a repeated string of LENGTH bytes goes, wherever its copies are.

A global suffix array has no bounded part, so the corpus is cut by content first. In each window of LENGTH bytes
the least hash of its GRAM-byte strings marks an anchor; equal windows have equal anchors at equal places. Windows that
follow each other with the same anchor are a run. Copies of a window thus lie in runs of one anchor hash, and
enhanced suffix arrays over the runs of each such hash find all of them. Where an anchor has more kinds of runs than one
array takes, its runs are cut once more by content, at fixed places relative to the anchor, and each part with the
same core has its own array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import free_name, salt_of, salted_lookup, written

LENGTH = 200
GRAM = 32
#: Bytes whose anchors are found at once; a place takes PLACE bits.
CHUNK, PLACE = 1 << 21, 22
#: Kinds of runs that one suffix array takes: it bounds a task's memory, at about a hundred windows of LENGTH bytes a kind.
KINDS = 1000
#: Where there are more, runs are cut into parts of so many windows, then, of parts whose core still has more, into single windows.
WIDTHS = (16, 1)
_BYTE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_TEXT = (("t1", "long"), ("t2", "long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(data: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    x = xxh3_128_intdigest(data)
    return _signed(x >> 64), _signed(x & (1 << 64) - 1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, by doubling; gram is a power of two."""
    h, width, base = _BYTE[data], 1, np.uint64(0x9E3779B97F4A7C15)
    while width < gram:
        h = h[:-width] * base + h[width:]
        base, width = base * base, 2 * width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def runs_of(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end (ends: where each ends): anchor hashes, first windows, last windows and anchors' places of runs."""
    found = []
    step, first = CHUNK - length, 0
    raw = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        while first + length <= len(raw):
            part = raw[first : first + CHUNK]
            h = _gram_hashes(part, gram)
            m = (h & ~np.uint64((1 << PLACE) - 1)) | np.arange(len(h), dtype=np.uint64)
            width, want = 1, length - gram + 1
            while 2 * width <= want:
                m, width = np.minimum(m[:-width], m[width:]), 2 * width
            if want > width:
                m = np.minimum(m[: len(m) - (want - width)], m[want - width :])
            anchor = (m & np.uint64((1 << PLACE) - 1)).astype(np.int64)[: step + 1]
            starts = np.arange(first, first + len(anchor))
            inside = starts + length <= ends[np.minimum(np.searchsorted(ends, starts, "right"), len(ends) - 1)]
            fresh = np.ones(len(anchor), bool)
            fresh[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
            lo = np.flatnonzero(inside & fresh)
            last = np.ones(len(anchor), bool)
            last[:-1] = (anchor[1:] != anchor[:-1]) | ~inside[1:]
            hi = np.flatnonzero(inside & last)
            found.append((h[anchor[lo]], lo + first, hi + first, anchor[lo] + first))
            first += step + 1
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(length: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from xxhash import xxh3_64_intdigest

    names = ["key", "digest", "t1", "t2", "lo", "n", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode("utf-8", "replace") for x in batch.column(0)]
            data, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            if not len(data):
                continue
            key, lo, hi, at_ = runs_of(data, ends, length, gram)
            of = np.searchsorted(ends, lo, "right")
            digest = np.fromiter((xxh3_64_intdigest(data[a : b + length]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))
            ids = np.array([_halves(t) for t in texts], np.int64).reshape(-1, 2)[of]
            columns = [key.view(np.int64), digest.view(np.int64), ids[:, 0], ids[:, 1], lo - (ends - sizes)[of], (hi - lo + 1).astype(np.int32), (at_ - lo).astype(np.int32)]
            for at in range(0, len(lo), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at : at + 50_000])) for c in columns], names)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they move, with the hash that names them."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [(x.as_py() or "").encode("utf-8", "replace") for x in batch.column(batch.num_columns - 1)]
        ids = [_halves(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([x for x, _ in ids], pa.int64()), pa.array([x for _, x in ids], pa.int64()), pa.array(map(pack.compress, texts), pa.binary())],
            [*batch.schema.names[:-1], "t1", "t2", "blob"],
        )


def _suffixes(strings: list[bytes], windows: list[int]) -> list[tuple[bytes, int, int]]:
    """Sorted suffixes (bytes, string, start) that start at the first windows[k] places of string k."""
    return sorted((s[at:], k, at) for k, (s, n) in enumerate(zip(strings, windows, strict=True)) for at in range(n))


def _intervals(suffixes: list[tuple[bytes, int, int]], strings: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(size, first, last) of the maximal repeats of at least `length` bytes among sorted suffixes, inner ones before outer ones.

    A stack over the common prefixes of neighbours walks the tree of intervals. Each knows the byte before all its suffixes, or that
    they differ (None, as at a string's start); one whose suffixes all follow the same byte is part of a longer repeat and is left out.
    """

    def common(x: bytes, y: bytes) -> int:
        if x[:length] != y[:length]:
            return 0
        n = min(len(x), len(y))
        differ = int.from_bytes(x[length:n], "big") ^ int.from_bytes(y[length:n], "big")
        return n - (differ.bit_length() + 7) // 8

    stack: list[list] = []  # common prefix, first suffix, byte before
    for k in range(1, len(suffixes) + 1):
        x, which, at = suffixes[k - 1]
        size, first, before = common(x, suffixes[k][0]) if k < len(suffixes) else 0, k - 1, strings[which][at - 1] if at else None
        while stack and stack[-1][0] > size:
            top, first, own = stack.pop()
            before = own if own == before else None
            if before is None:
                yield top, first, k - 1
        if size and stack and stack[-1][0] == size:
            stack[-1][2] = before if before == stack[-1][2] else None
        elif size:
            stack.append([size, first, before])


def maximal_repeats(strings: list[bytes], windows: list[int], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least `length` bytes among strings: (size, all occurrences as (string, start))."""
    suffixes = _suffixes(strings, windows)
    return [(size, [(k, at) for _, k, at in suffixes[first : last + 1]]) for size, first, last in _intervals(suffixes, strings, length)]


def longest_repeats(strings: list[bytes], windows: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(string, start, size) of the longest maximal repeat at each place that has one; memory follows the places, not the groups."""
    suffixes, without = _suffixes(strings, windows), []
    seen = 0
    for size, first, last in _intervals(suffixes, strings, length):
        without.extend(range(seen, last + 1))
        seen = last + 1
        while without and without[-1] >= first:
            _, k, at = suffixes[without.pop()]
            yield k, at, size


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


_CUT = pa.schema([("key", pa.int64()), ("digest", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64()), ("lo", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("bytes", pa.binary())])
_PART = pa.schema([*_CUT, ("k0", pa.int64()), ("d0", pa.int64()), ("off", pa.int32())])
_DDL = "key long, digest long, t1 long, t2 long, lo long, n int, at int, bytes binary"
_PART_DDL = f"{_DDL}, k0 long, d0 long, off int"
_SPAN_DDL = "t1 long, t2 long, a long, b long"
_SPAN = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
_GROUP_DDL = "group long, size long, key long, digest long, off int"
_GROUP = pa.schema([("group", pa.int64()), ("size", pa.int64()), ("key", pa.int64()), ("digest", pa.int64()), ("off", pa.int32())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema.names)


def _cut(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with the runs asked of them -> the runs with their bytes, and whether their anchor has too many kinds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for t1, t2, blob, asked in zip(*(batch.column(c) for c in ("t1", "t2", "blob", "asked")), strict=True):
                data, t1, t2 = unpack.decompress(blob.as_py()), t1.as_py(), t2.as_py()
                for x in asked.as_py():
                    yield x["key"], x["digest"], t1, t2, x["lo"], x["n"], x["at"], data[x["lo"] : x["lo"] + x["n"] + length - 1], x["many"]

    return lambda batches: _batches(rows(batches), pa.schema([*_CUT, ("many", pa.bool_())]))


def _parts(width: int, length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs -> their parts of at most `width` windows, cut where the windows' distance to the anchor is a multiple of it.

    All windows of a part hold its core: the bytes that windows at any distance of its range have in common. Equal windows lie at
    equal distances, so they are in parts of equal range and core, which are the new key.
    """
    from xxhash import xxh3_64_intdigest as h

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, _, t1, t2, lo, n, at, data, k0, d0, off in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = 0
                while first < n:
                    k = (at - first) // width  # distances from k * width on
                    last = min(n - 1, at - k * width)
                    core = data[at - k * width : at - (k + 1) * width + 1 + length]
                    part = data[first : last + length]
                    yield _signed(h(core, (key + k) & (1 << 64) - 1)), _signed(h(part)), t1, t2, lo + first, last - first + 1, at - first, part, k0, d0, off + first
                    first = last + 1

    return lambda batches: _batches(rows(batches), _PART)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Groups of rows of one key, from rows sorted by it; one group is held at a time."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in _CUT.names), strict=True))
    return (list(group) for _, group in groupby(rows, key=lambda r: r[0]))


def _spans(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs sorted by key -> spans of repeats in texts, merged within each run."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for members in _by_key(batches):
            spans: dict[int, list[tuple[int, int]]] = {}
            for k, at, size in longest_repeats([m[7] for m in members], [m[5] for m in members], length):
                spans.setdefault(k, []).append((at, at + size))
            for k, found in spans.items():
                _, _, t1, t2, lo, *_ = members[k]
                yield from ((t1, t2, lo + a, lo + b) for a, b in _union(found))

    return lambda batches: _batches(rows(batches), _SPAN)


def _groups(length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Runs sorted by key -> a row for each member of each maximal repeat: group, size, the run and the place in it."""
    from xxhash import xxh3_64_intdigest as h

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for members in _by_key(batches):
            strings = [m[7] for m in members]
            suffixes = _suffixes(strings, [m[5] for m in members])
            for size, first, last in _intervals(suffixes, strings, length):
                group = _signed(h(suffixes[first][0][:size], members[0][0] & (1 << 64) - 1))
                yield from ((group, size, members[k][0], members[k][1], at) for _, k, at in suffixes[first : last + 1])

    return lambda batches: _batches(rows(batches), _GROUP)


def _searched(docs: DataFrame, text_col: str, length: int, gram: int, most: int) -> tuple[DataFrame, DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """What the suffix arrays work on: all runs of anchors with several, those that equal another, and levels.

    A level has a table of runs or parts with bytes, all kinds of a key at most `most` rows, and a table that says which runs each kind
    stands for: key, digest, k0, d0 (the run's anchor and digest), off (where in the run it starts).

    1. Runs of all texts, and per anchor hash how many there are and whether their bytes differ (by a 64-bit digest each).
    2. Anchors with one run are out. Runs that equal another of their anchor are covered whole, and no text moves for them.
    3. One run of each kind goes to its anchor's suffix array.
    4. Anchors with more than `most` kinds are split: parts of runs are grouped by the core that their windows share, equal parts are
       covered, and one of each kind goes to the core's suffix array, or is split again, at last into single windows, whose kinds are one.
    """
    runs = written(docs.select(text_col).mapInArrow(_runs(length, gram), "key long, digest long, t1 long, t2 long, lo long, n int, at int"))
    keys = runs.groupBy("key").agg(F.count(F.lit(1)).alias("runs"), (F.min("digest") != F.max("digest")).alias("differ")).filter("runs > 1").drop("runs")
    hits = written(runs.join(written(keys), "key"))  # two plain exchanges, so adaptive execution can split a hot anchor's runs
    differ = hits.filter("differ")
    kinds = written(differ.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("t1", "t2", "lo", "n", "at")).alias("one")))
    copies = kinds.filter("copies > 1").select("key", "digest")
    several = salted_lookup(differ, copies, ["key", "digest"], salt_of(F.col("t1"), F.col("lo"), salts=64))
    equal = hits.filter("not differ").unionByName(several).select("key", "digest", "t1", "t2", "lo", "n")

    sizes = kinds.groupBy("key").agg((F.count(F.lit(1)) > most).alias("many"))
    asked = salted_lookup(kinds, sizes, ["key"], salt_of(F.col("digest"), salts=64)).select("key", "digest", "many", "one.*")
    asked = asked.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "digest", "lo", "n", "at", "many")).alias("asked"))  # a text's runs
    texts = docs.select(text_col).mapInArrow(_packed, "t1 long, t2 long, blob binary").dropDuplicates(["t1", "t2"])
    cut = written(texts.join(asked, ["t1", "t2"]).mapInArrow(_cut(length), f"{_DDL}, many boolean"))
    own = [F.col("key").alias("k0"), F.col("digest").alias("d0"), F.lit(0).alias("off")]
    levels = [(cut.filter("not many").drop("many"), kinds.select("key", "digest", *own))]
    rest = cut.filter("many").drop("many").select("*", *own)
    for width in WIDTHS:
        if rest.isEmpty():
            break
        parts = written(rest.mapInArrow(_parts(width, length), _PART_DDL))
        found = written(parts.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("copies")))
        kinds_ = salted_lookup(found, found.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")), ["key"], salt_of(F.col("digest"), salts=64)).filter("copies > 1 or kinds > 1")
        marked = written(salted_lookup(parts, kinds_, ["key", "digest"], salt_of(F.col("t1"), F.col("lo"), salts=64)))
        equal = equal.unionByName(marked.filter("copies > 1").select("key", "digest", "t1", "t2", "lo", "n"))
        ones = written(marked.dropDuplicates(["key", "digest"]))
        levels.append((ones.filter(F.col("kinds") <= most).select(*_CUT.names), marked.select("key", "digest", "k0", "d0", "off")))
        rest = ones.filter(F.col("kinds") > most).select(*_PART.names)
    return hits, equal, levels


def _arrays(table: DataFrame) -> DataFrame:
    return table.repartition("key").sortWithinPartitions("key")


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = KINDS) -> DataFrame:
    """(t1, t2, a, b): byte spans [a, b) of texts, named by their 128-bit hash, that repeats of `length` bytes cover; spans may overlap."""
    _, equal, levels = _searched(docs, text_col, length, gram, most)
    out = equal.select("t1", "t2", F.col("lo").alias("a"), (F.col("lo") + F.col("n") + (length - 1)).alias("b"))
    for table, _ in levels:
        out = out.unionByName(_arrays(table).mapInArrow(_spans(length), _SPAN_DDL))
    return out


def repeat_groups(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = KINDS) -> DataFrame:
    """(group, size, t1, t2, start): every occurrence of each maximal repeat of at least `length` bytes, texts named by their 128-bit hash.

    A repeat is maximal within the runs that one suffix array holds: one that goes on beyond a run is there in pieces, one for
    each anchor, which overlap by length - 1 bytes. Repeated texts are one text. Empty tables and texts without repeats give no rows.
    """
    hits, equal, levels = _searched(docs, text_col, length, gram, most)
    place = lambda df: df.select("group", "size", "t1", "t2", "start").distinct()
    out = place(equal.select(F.xxhash64("key", "digest").alias("group"), (F.col("n") + (length - 1)).cast("long").alias("size"), "t1", "t2", F.col("lo").alias("start")))
    for table, stands in levels:
        found = _arrays(table).mapInArrow(_groups(length), _GROUP_DDL).withColumnRenamed("off", "in_part")
        found = found.join(stands, ["key", "digest"]).select("group", "size", F.col("k0").alias("key"), F.col("d0").alias("digest"), (F.col("off") + F.col("in_part")).alias("off"))
        out = out.unionByName(place(found.join(hits, ["key", "digest"]).withColumn("start", F.col("lo") + F.col("off"))))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = KINDS) -> DataFrame:
    """A row for each row of docs: id, n_bytes, n_removed, n_spans, kept (bytes), kept_sha256.

    Every byte that a string of `length` bytes found elsewhere too covers is removed, judged on the input; n_spans counts
    maximal removed runs. Texts are UTF-8, null as empty; shorter texts than `length` lose nothing; copies of a text all lose it.
    kept is what is left, which may cut characters. Ids pass through, nulls and repeats too; an empty table gives an empty result.
    """
    own = free_name(docs, "_spans")
    spans = repeated_spans(docs, text_col, length, gram, most).groupBy("t1", "t2").agg(F.collect_set(F.struct("a", "b")).alias(own))  # bounded by a text's length
    kind = docs.schema[id_col].dataType
    packed = docs.select(id_col, text_col).mapInArrow(_packed, T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n, _ in _TEXT), T.StructField("blob", T.BinaryType())]))
    rows = salted_lookup(packed, written(spans), ["t1", "t2"], salt_of(F.col(id_col), salts=64), how="left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = ([], [], [], [], [])
            for blob, found in zip(batch.column(1), batch.column(2), strict=True):
                data = unpack.decompress(blob.as_py())
                gone = _union([(x["a"], x["b"]) for x in found.as_py() or ()])
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for column, v in zip(out, (len(data), len(data) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())])
    return rows.select(id_col, "blob", own).mapInArrow(run, schema)
