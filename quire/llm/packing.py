"""Best-fit packing: documents as token pieces, pieces into sequences by vector best-fit."""

from __future__ import annotations

import functools
import json
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.common import written

LENGTH = 4096
END_ID = 1
#: Pieces that one task packs; the sequences it leaves part-filled are a handful.
GROUP = 100_000
#: Encoded words in one of the two generations that a worker keeps; bytes of texts, and distinct words of them, encoded at once.
CACHE, PORTION, WORDS = 400_000, 8 << 20, 16_384
_PACKED = (("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("sequence_id", "long"), ("offset", "long"))


class Encoder:
    """Texts -> ids, equal to encoding the whole texts.

    The tokenizer drops white space and no token spans it, so each distinct word of many texts is encoded once. Words that
    need the tokenizer are kept, in two generations of at most CACHE; when the young one is full it becomes the old one, and
    old words that come again move back.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        self.merges = Merges.of_file(path)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        ids, edges = self.encode_all(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]

    def encode_all(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts in a row, the id end after each of them if one is given, and where texts start and end there. Null texts are empty.

        Words are split and told apart on arrays; only distinct ones are encoded.
        """
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        rows = words.offsets.to_numpy().astype(np.int64)
        rows -= rows[0]
        coded = words.flatten().dictionary_encode()
        at, (ids, sizes) = coded.indices.to_numpy(), self._distinct(coded.dictionary)
        if end is not None:
            at, rows = np.insert(at, rows[1:], len(sizes)), rows + np.arange(len(rows))
            ids, sizes = np.append(ids, np.uint32(end)), np.append(sizes, 1)
        starts, sizes = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.append(0, np.cumsum(sizes))
        starts -= ends[:-1]
        places = np.repeat(starts, sizes)
        places += np.arange(len(places))
        return ids[places], ends[rows].tolist()

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after another, and how many each has."""
        plain = self.merges.plain_ones(words) if self.merges else np.zeros(len(words), bool)
        known = words.filter(pa.array(plain))
        groups = [self.merges.encode(known.slice(k, WORDS)) for k in range(0, len(known), WORDS)]
        ids, sizes = zip(*groups, strict=True) if groups else ([], [])
        if plain.all():
            return np.concatenate([np.empty(0, "<u4"), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])
        rest = self._asked(words.filter(pa.array(~plain)).to_pylist())
        mixed = np.empty(len(words), np.int64)
        mixed[~plain] = [len(x) // 4 for x in rest]
        if groups:
            mixed[plain] = np.concatenate(sizes)
        out, whose = np.empty(mixed.sum(), "<u4"), np.repeat(plain, mixed)
        out[~whose] = np.frombuffer(b"".join(rest), "<u4")
        if groups:
            out[whose] = np.concatenate(ids)
        return out, mixed

    def _asked(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, kept for later texts."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        fresh = []
        for w in words:
            if w not in self.young:
                if (x := self.old.get(w)) is not None:
                    self.young[w] = x
                else:
                    fresh.append(w)
        if fresh:
            self._learn(fresh)
        return [self.young[w] for w in words]

    @staticmethod
    @functools.lru_cache(maxsize=1)
    def of_worker(path: str) -> Encoder:
        """One for all tasks of a Python worker, which Spark uses again."""
        return Encoder(path)

    def _learn(self, fresh: list[str]) -> None:
        """Words of plain characters by merges, all at once; the others by the tokenizer."""
        plain = [w for w in fresh if self.merges.plain(w)] if self.merges else []
        if plain:
            ids, sizes = self.merges.encode(pa.array(plain))
            edges = np.append(0, np.cumsum(sizes)).tolist()
            self.young.update((w, ids[a:b].tobytes()) for w, a, b in zip(plain, edges, edges[1:], strict=False))
        if len(plain) < len(fresh) and (rest := [w for w in fresh if w not in self.young]):
            self._ask(rest)

    def _ask(self, fresh: list[str]) -> None:
        """Encodes words laid side by side; offsets tell whose the tokens are."""
        encoded = self.tokenizer.encode(" ".join(fresh), add_special_tokens=False)
        starts = np.zeros(len(fresh), np.int64)
        np.cumsum([len(w) + 1 for w in fresh[:-1]], out=starts[1:])
        ids = np.array(encoded.ids, "<u4").tobytes()
        at = np.array(encoded.offsets, np.int64).reshape(-1, 2)[:, 0]
        edges = (4 * np.searchsorted(at, starts)).tolist() + [len(ids)]
        for k, w in enumerate(fresh):
            self.young[w] = ids[edges[k] : edges[k + 1]]


class Merges:
    """The merges of a byte-level BPE tokenizer, over many words at once.

    For words of PLAIN characters only: composed, with lower case of one character, and the same letters, digits and signs to every
    version of Unicode. Words of over 64 characters and what may hold an added token are left to the tokenizer.
    """

    SIGNS, LONGEST = "!-~×÷¿¡«»“”‘’–—…€À-ÖØ-öø-įı-ž", 64
    PLAIN = re.compile(f"[{SIGNS}]{{1,{LONGEST}}}").fullmatch
    LETTER, DIGIT, SIGN = 1, 2, 3
    NONE = np.int32(2**31 - 1)
    SLOTS = 18
    #: What a tokenizer file has to say for this class to follow its rule.
    RULE = {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    }

    def __init__(self, rule: dict):
        vocab, merges = rule["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in rule["model"]["merges"]]
        # bytes that are no visible character of Latin-1 have the characters from 256 on, in order
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        signs = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in seen)}
        self.inner, self.last = (np.array([vocab[signs[b] + end] for b in range(256)], np.int32) for end in ("", "</w>"))
        self.kinds = np.full(0x2100, self.SIGN, np.int8)
        for letters in ("az", "ßö", "øž"):
            self.kinds[ord(letters[0]) : ord(letters[1]) + 1] = self.LETTER
        self.kinds[48:58], self.kinds[32] = self.DIGIT, 0
        # ranks of pairs lie in slots; the pairs whose slot another one has are sorted
        pairs = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        slots = self._slots(pairs)
        self.pairs, self.rank = np.full(1 << self.SLOTS, -1, np.int64), np.full(1 << self.SLOTS, self.NONE, np.int32)
        self.pairs[slots], self.rank[slots] = pairs, np.arange(len(pairs))
        self.rest_rank = np.flatnonzero(self.pairs[slots] != pairs)
        self.rest_rank = self.rest_rank[np.argsort(pairs[self.rest_rank])].astype(np.int32)
        # a last one above all pairs
        self.rest, self.rest_rank = np.append(pairs[self.rest_rank], 2**62), np.append(self.rest_rank, self.NONE)
        self.shared = np.zeros(1 << self.SLOTS, bool)
        self.shared[self._slots(self.rest[:-1])] = True
        self.added = sorted({t["content"][:2] for t in rule["added_tokens"]})

    @classmethod
    def of_file(cls, path: str) -> Merges | None:
        """None if the tokenizer follows another rule."""
        with open(path, encoding="utf-8") as f:
            rule = json.load(f)
        model = {k: v for k, v in rule["model"].items() if k not in ("vocab", "merges")}
        known = rule | {"model": model} == rule | cls.RULE and all(t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and len(t["content"]) > 1 for t in rule["added_tokens"])
        return cls(rule) if known else None

    def plain(self, word: str) -> bool:
        return self.PLAIN(word) is not None and not ("<" in word and any(t in word for t in self.added))

    def plain_ones(self, words: pa.Array) -> np.ndarray:
        """plain, of each of many words."""
        odd = pc.match_substring_regex(words, f"^$|[^{self.SIGNS}]").to_numpy(zero_copy_only=False) | (pc.utf8_length(words).to_numpy() > self.LONGEST)
        for t in self.added:
            odd |= pc.match_substring(words, t).to_numpy(zero_copy_only=False)
        return ~odd

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs ^ (pairs >> 25)) * -7046029254386353131 >> (64 - self.SLOTS)) & ((1 << self.SLOTS) - 1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs = (a.astype(np.int64) << 32) | b
        slots = self._slots(pairs)
        hit = self.pairs[slots] == pairs
        out = np.where(hit, self.rank[slots], self.NONE)
        if len(more := np.flatnonzero(~hit & self.shared[slots])):
            at = np.searchsorted(self.rest, pairs[more])
            out[more] = np.where(self.rest[at] == pairs[more], self.rest_rank[at], self.NONE)
        return out

    def _cut(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words joined by blanks: the bytes of all words, and where parts and words start in them.

        Parts are runs of letters, single digits, runs of signs, and 's 't 're 've 'm 'll 'd where a part may start.
        """
        signs = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        kinds = self.kinds[signs]
        before = np.append(np.int8(0), kinds[:-1])
        new = (kinds != before) | (kinds == self.DIGIT)
        at = np.flatnonzero((signs == ord("'")) & (before != self.SIGN))
        after = np.append(signs, [0, 0, 0])
        one, two = after[at + 1], after[at + 1] << 8 | after[at + 2]
        single, double = np.isin(one, [ord(c) for c in "stmd"]), np.isin(two, [ord(a) << 8 | ord(b) for a, b in ("re", "ve", "ll")])
        new = np.append(new, [False] * 3)
        new[at[single | double] + 1] = False
        new[at[single] + 2] = new[at[double] + 3] = True
        new = new[: len(signs)] & (kinds != 0)
        size = np.where(kinds == 0, 0, 1 + (signs >= 0x80) + (signs >= 0x800))
        starts = np.cumsum(size) - size
        raw = np.frombuffer(text.encode(), np.uint8)
        return raw[raw != 32], starts[new], starts[(before == 0) & (kinds != 0)]

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, one after another, and how many each has: in each of its parts the pair of bytes or merges of the lowest rank, the first of equal ones, is merged until none is left.

        All parts merge a pair a turn; those without one are done and leave.
        """
        raw, starts, heads = self._cut(" ".join(words.to_numpy(zero_copy_only=False)).lower())
        sizes = np.diff(np.append(starts, len(raw)))
        out, place, ids = np.full(len(raw), -1, np.int32), np.arange(len(raw)), self.inner[raw]
        ids[starts + sizes - 1] = self.last[raw[starts + sizes - 1]]
        ranks = np.append(self._ranks(ids[:-1], ids[1:]), self.NONE)
        ranks[starts + sizes - 1] = self.NONE
        while len(starts):
            best = np.minimum.reduceat(ranks, starts)
            live = best != self.NONE
            if not live.all():
                on = np.repeat(live, sizes)
                out[place[~on]] = ids[~on]
                place, ids, ranks, sizes, best = place[on], ids[on], ranks[on], sizes[live], best[live]
                if not len(sizes):
                    break
            part = np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(ranks == best[part])
            at = at[np.diff(part[at], prepend=-1) != 0]
            ids[at] = self.made[best]
            on = np.ones(len(ids), bool)
            on[at + 1] = False
            place, ids, ranks, sizes = place[on], ids[on], ranks[on], sizes - 1
            at -= np.arange(len(at))
            starts = np.cumsum(sizes) - sizes
            ranks[at] = self.NONE
            pairs = np.concatenate([at[at > starts] - 1, at[at < starts + sizes - 1]])
            ranks[pairs] = self._ranks(ids[pairs], ids[pairs + 1])
        kept = out >= 0
        return out[kept].astype("<u4"), np.add.reduceat(kept, heads, dtype=np.int64)


class Bins:
    """Sequences being filled; each has tokens, documents and attention cost (sum of squared lengths) left.

    They lie by tokens left, then by the other two, so equal ones count once. A bit a value of tokens left
    says where any lie. The search goes up from the tightest fit and ends as soon as tokens alone
    rule out anything better: every open sequence that meets all limits competes.
    """

    def __init__(self, tokens: int, documents: int, attention: int, weights: tuple[float, float, float], rule: str):
        self.cap, self.weights, self.rule = (tokens, documents, attention), weights, rule
        self.at: dict[int, dict[tuple[int, int], list[int]]] = {}
        self.mask = self.opened = 0

    def score(self, left: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        """Lower is better: the weighted norm of what would be left, or minus the weighted dot product of need and what is left."""
        if self.rule == "norm":
            return sum(w * ((a - b) / c) ** 2 for w, a, b, c in zip(self.weights, left, need, self.cap, strict=True))
        return -sum(w * (a / c) * (b / c) for w, a, b, c in zip(self.weights, left, need, self.cap, strict=True))

    def bound(self, tokens: int, need: tuple[int, int, int]) -> float:
        """No sequence with so many tokens left scores lower."""
        if self.rule == "norm":
            return self.weights[0] * ((tokens - need[0]) / self.cap[0]) ** 2
        return self.score((tokens, self.cap[1], self.cap[2]), need)

    def place(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and its offset there."""
        need, best, where = (length, 1, length * length), math.inf, None
        rest = self.mask >> length
        while rest:
            up = (rest & -rest).bit_length() - 1 if self.rule == "norm" else rest.bit_length() - 1
            tokens, rest = length + up, rest ^ (1 << up)
            if self.bound(tokens, need) >= best:
                break
            for (documents, attention), _ in self.at[tokens].items():
                if documents >= 1 and attention >= need[2] and (s := self.score((tokens, documents, attention), need)) < best:
                    best, where = s, (tokens, documents, attention)
        if where is None:
            bin_, left = self.opened, self.cap
            self.opened += 1
        else:
            tokens, left = where[0], where
            same = self.at[tokens][where[1:]]
            bin_ = same.pop()
            if not same:
                del self.at[tokens][where[1:]]
                if not self.at[tokens]:
                    del self.at[tokens]
                    self.mask ^= 1 << tokens
        after = (left[0] - length, left[1] - 1, left[2] - need[2])
        if after[0]:
            self.at.setdefault(after[0], {}).setdefault(after[1:], []).append(bin_)
            self.mask |= 1 << after[0]
        return bin_, self.cap[0] - left[0]


def _portions(texts: pa.Array) -> list[tuple[int, int]]:
    """Rows in portions of about PORTION bytes, as first row and number of rows; all rows are in one."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    firsts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // PORTION, prepend=-1)).tolist()
    return [(a, b - a) for a, b in zip(firsts, [*firsts[1:], len(sizes)], strict=False)]


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a piece of each row of docs: id, piece, start, length, ids_crc32. Null and empty texts are their end id alone."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T._parse_datatype_string(k)) for n, k in _PACKED[:4])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(tokenizer)
        for batch in batches:
            ids, texts, rows = batch.column(0), batch.column(1), ([], [], [], [], [])
            for first, n in _portions(texts):
                tokens, edges = encoder.encode_all(texts.slice(first, n), END_ID)
                tokens = memoryview(tokens.view(np.uint8))
                for at in range(n):
                    for k, start in enumerate(range(edges[at], edges[at + 1], length)):
                        stop = min(start + length, edges[at + 1])
                        for column, v in zip(rows, (first + at, k, k * length, stop - start, zlib.crc32(tokens[4 * start : 4 * stop])), strict=True):
                            column.append(v)
            columns = [ids.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, documents: int = LENGTH, attention: int = LENGTH * LENGTH, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """A row for each piece of each row of docs: id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents become ids and an end id; those longer than `length` are cut into pieces of that length, the last may be shorter.
    A sequence holds at most `length` tokens, `documents` pieces and `attention` squared tokens; a piece
    goes, longest first, into the open sequence with the best score among all that meet every limit. With the
    defaults the last two never bind, so sequences are as few as tokens allow. A piece beyond `attention` alone gets a sequence of its own.
    Null ids pass through; rows that repeat an id are packed one by one. Empty tables give empty results.

    Pieces, not texts, are dealt evenly over tasks of about `group` pieces, each packed in memory; sequences never
    cross tasks, which costs under one part-filled sequence a task.
    """
    cut = written(pieces(docs, tokenizer, id_col, text_col, length))
    n = max(1, math.ceil(cut.count() / group))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table, bins = pa.Table.from_batches(held), Bins(length, documents, attention, weights, rule)
        first, lengths = TaskContext.get().partitionId() << 40, table.column("length").to_pylist()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for at in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
            bin_, offset[at] = bins.place(lengths[at])
            sequence[at] = first + bin_
        table = table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    return cut.repartition(n).mapInArrow(fill, schema)
