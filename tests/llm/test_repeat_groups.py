"""Suffix-array dedup: groups with all occurrences, and hot anchors, against brute force."""

import random
from collections import defaultdict

import pytest
from quire.llm.suffix_dedup import _halves, remove_repeats, repeat_groups

LENGTH = 40


def texts() -> list[str]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    passage, other = (" ".join(word() for _ in range(25)) for _ in range(2))
    out = [f"{' '.join(word() for _ in range(rng.randint(0, 9)))} {passage[rng.randint(0, 30) :]} {' '.join(word() for _ in range(rng.randint(0, 9)))}" for _ in range(60)]
    return [*out, other + other, "x" * 150, passage + "\n" + other, "short", "", out[0], None]


def brute(rows: list[bytes]) -> dict[bytes, set[int]]:
    where = defaultdict(set)
    for k, b in enumerate(rows):
        for at in range(len(b) - LENGTH + 1):
            where[b[at : at + LENGTH]].add((k, at))
    return {w: places for w, places in where.items() if len(places) > 1}


@pytest.mark.parametrize("most", [1000, 4])
def test_groups_hold_every_occurrence(spark, most):
    rows = sorted({(t or "").encode() for t in texts()})
    names = {_halves(b): k for k, b in enumerate(rows)}
    docs = spark.createDataFrame([(k, b.decode()) for k, b in enumerate(rows)], "doc_id long, text string")
    groups = defaultdict(set)
    for r in repeat_groups(docs, length=LENGTH, gram=16, most=most).collect():
        groups[r.group, r.size].add((names[r.t1, r.t2], r.start))
    together = defaultdict(set)
    for (_, size), places in groups.items():
        strings = {rows[k][at : at + size] for k, at in places}
        assert len(strings) == 1 and len(places) > 1 and size >= LENGTH
        (string,) = strings
        for off in range(size - LENGTH + 1):
            together[string[off : off + LENGTH]] |= {(k, at + off) for k, at in places}
    assert dict(together) == brute(rows)


@pytest.mark.parametrize("most", [1000, 4])
def test_hot_anchors_are_split(spark, most):
    rows = [(t or "").encode() for t in texts()]
    seen = defaultdict(int)
    for b in rows:
        for at in range(len(b) - LENGTH + 1):
            seen[b[at : at + LENGTH]] += 1
    got = {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string"), length=LENGTH, gram=16, most=most).collect()}
    for k, b in enumerate(rows):
        gone = {x for at in range(len(b) - LENGTH + 1) if seen[b[at : at + LENGTH]] > 1 for x in range(at, at + LENGTH)}
        assert got[k] == len(gone)
