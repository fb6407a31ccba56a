"""Text similarity: Arrow functions where a measure needs an algorithm, plain Python twins for tests and other functions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """1 for equal strings; 2 LCS / (len a + len b)."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


class Pack:
    """Texts that are held against many others: all ratios of at least `least`, the same as indel_ratio's.

    Two bounds leave few pairs to compare. An LCS is no longer than the characters that both texts have, nor than the sum of
    the LCS of two projections, each on one half of the alphabet. The bit-parallel recurrence runs on all texts' projections
    and a batch of others at once, on arrays of words of 63 bits; the last bit of a word is its carry.
    """

    BUCKETS, LINES, BITS, CODES = 32, 256, 63, 0x110000
    LOW = np.uint64((1 << BITS) - 1)
    ONES = np.array([k.bit_count() for k in range(1 << 16)], np.uint8)

    def __init__(self, texts: list[str], least: float):
        self.texts, self.least = texts, least
        self.sizes = np.array([len(t) for t in texts], np.int64)
        counts = Counter()
        for t in texts:
            counts.update(t)
        # the most frequent characters, up to half of all, are one half of the alphabet; the rest share the last bucket if too many
        self.bucket, halves, seen, self.first = np.full(self.CODES, self.BUCKETS, np.uint8), ({}, {}), 0, 0
        for k, (c, n) in enumerate(counts.most_common()):
            half = int(2 * seen >= counts.total())
            halves[half][c] = len(halves[half])
            self.bucket[ord(c)] = min(k, self.BUCKETS - 1)
            if not half:
                self.first = min(k + 1, self.BUCKETS - 1)  # buckets of the first half alone
            seen += n
        self.bags = np.array([self._bag(self._points(t)) for t in texts], np.int32)
        # of each half: a character's row in its tables (the last row is empty), and by word a table of the texts that have so many, longest first
        self.row, self.order, self.tables = [], [], []
        for places in halves:
            row = np.full(self.CODES, len(places), np.int32)
            for c, k in places.items():
                row[ord(c)] = k
            own = [[places[c] for c in t if c in places] for t in texts]
            order = sorted(range(len(texts)), key=lambda k: -len(own[k]))
            tables = []
            for word in range(max(1, -(-len(own[order[0]]) // self.BITS))):
                width = sum(len(x) > word * self.BITS for x in own) if word else len(texts)
                table = np.zeros((len(places) + 1, width), np.uint64)
                for column, k in enumerate(order[:width]):
                    for at, code in enumerate(own[k][word * self.BITS : (word + 1) * self.BITS]):
                        table[code, column] |= np.uint64(1 << at)
                tables.append(table)
            self.row.append(row)
            self.order.append(np.array(order))
            self.tables.append(tables)

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _bag(self, points: np.ndarray) -> np.ndarray:
        return np.bincount(self.bucket[points], minlength=self.BUCKETS + 1)[: self.BUCKETS]

    def _lcs(self, half: int, use: np.ndarray, points: list[np.ndarray]) -> np.ndarray:
        """LCS of the half's projections: a row for each of points, a column for each text (0 where use is false)."""
        order, empty = self.order[half], len(self.tables[half][0]) - 1
        codes = [r[r < empty] for r in (self.row[half][x] for x in points)]
        steps = np.full((max(map(len, codes)), len(codes)), empty, np.int64)
        for k, c in enumerate(codes):
            steps[: len(c), k] = c
        asked = np.flatnonzero(use[order])
        tables = [np.ascontiguousarray(t[:, asked[asked < t.shape[1]]]) for t in self.tables[half]]
        tables = [t for t in tables if t.shape[1]]
        rows = [np.full((len(codes), t.shape[1]), self.LOW) for t in tables]
        hits, kept = [np.empty_like(r) for r in rows], [np.empty_like(r) for r in rows]
        carries = [np.empty_like(r) for r in rows[1:]]
        for step in steps:
            for word, row in enumerate(rows):
                hit, rest = hits[word], kept[word]
                tables[word].take(step, 0, hit, "clip")
                np.bitwise_and(row, hit, hit)
                np.bitwise_xor(row, hit, rest)
                np.add(row, hit, row)
                if word:
                    np.add(row, carries[word - 1], row)
                if word < len(carries):
                    np.right_shift(row[:, : carries[word].shape[1]], 63, carries[word])
                    np.bitwise_or(row, rest, row)
                    np.bitwise_and(row, self.LOW, row)
                else:
                    np.bitwise_or(row, rest, row)
        out = np.zeros((len(codes), len(order)), np.int64)
        for row in rows:
            left = self.ONES[(row & self.LOW).view(np.uint16)].reshape(*row.shape, 4).sum(2, dtype=np.int64)
            out[:, order[asked[: row.shape[1]]]] += self.BITS - left
        return out

    def hits(self, others: list[str]) -> list[tuple[int, int, float]]:
        """(place in others, place in texts, ratio); batches are best of others of similar lengths."""
        found = []
        for at in range(0, len(others), self.LINES):
            batch = others[at : at + self.LINES]
            found += [(at + k, place, 1.0) for k, t in enumerate(batch) if not t for place in np.flatnonzero(self.sizes == 0).tolist()]
            points = [self._points(t) for t in batch]
            total = np.maximum(self.sizes + np.array([len(t) for t in batch])[:, None], 1)
            common = np.minimum(self.bags, np.array([self._bag(x) for x in points], np.int32)[:, None])
            bound, rest = common[:, :, : self.first].sum(2), common[:, :, self.first :].sum(2)
            for half in (0, 1, 2):
                fits = 2 * (bound + rest) / total >= self.least
                lines = np.flatnonzero(fits.any(1))
                if half == 2 or not len(lines):
                    break
                part = self._lcs(half, fits.any(0), [points[k] for k in lines])
                if half:
                    rest[lines] = part
                else:
                    bound[lines] = part
                gone = ~fits
                bound[gone], rest[gone] = 0, 0
            for k, place in np.argwhere(fits).tolist():
                if (ratio := indel_ratio(self.texts[place], batch[k])) >= self.least:
                    found.append((at + k, place, ratio))
        return found


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer one."""
    a, b = sorted((a, b), key=len)
    return max((indel_ratio(a, b[k : k + len(a)]) for k in range(len(b) - len(a) + 1)), default=1.0) if a else float(not b)


def words(text: str) -> list[str]:
    """Lower-case words and marks; wide scripts by character."""
    return re.findall(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]|[^\W\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]+|[^\w\s]", text.lower())


def sentence_bleu(reference: str, candidate: str, most: int = 4) -> float:
    """BLEU of one sentence with add-one smoothing and a brevity penalty, to four places."""
    r, c = words(reference), words(candidate)
    if not r or not c:
        return 0.0
    total = 0.0
    for n in range(1, most + 1):
        if min(len(r), len(c)) < n:
            total -= math.log(len(c) + 1)
            continue
        grams = lambda x: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))  # noqa: B023, E731
        have, want = grams(c), grams(r)
        total += math.log((sum((have & want).values()) + 1) / (sum(have.values()) + 1))
    return round(min(1.0, math.exp(1 - len(r) / len(c))) * math.exp(total / most), 4)


def chrf_recall(reference: str, candidate: str) -> float:
    """Share of the reference's character 2- to 4-grams that the candidate has; 1 for none."""
    squeeze = lambda t: re.sub(r"\s+", "", t)
    grams = lambda t: Counter(t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1))
    want, have = grams(squeeze(reference)), grams(squeeze(candidate))
    return sum((want & have).values()) / sum(want.values()) if want else 1.0


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


indel_ratio_udf, token_sort_udf, partial_ratio_udf, bleu_udf, chrf_udf = map(_pairwise, (indel_ratio, token_sort_ratio, partial_ratio, sentence_bleu, chrf_recall))
