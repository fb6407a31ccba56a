import random

from quire.functions.similarity import Pack, indel_ratio
from quire.operators import memory


def test_trigrams_of_whole_rows(spark):
    """A passage past a row's first 64 trigrams is found, and `shared` counts all of the row's trigrams."""
    passage = "the quick brown fox jumps over the lazy dog"
    rows = [(1, "0123456789" * 3 + " ".join(f"{k:03d}" for k in range(200)) + " " + passage), (2, "nothing of it")]
    got = memory.trigram_candidates(spark.createDataFrame([(7, passage)], "q long, t string"), spark.createDataFrame(rows, "m long, s string"), "q", "t", "m", "s").collect()
    grams = lambda t: {t[k : k + 3] for k in range(len(t) - 2)}
    assert {(r.query, r.candidate, r.shared) for r in got} == {(7, i, len(grams(passage) & grams(t))) for i, t in rows if grams(passage) & grams(t)}


def test_fuzzy_is_exact(spark):
    """Over 200 rows that share more trigrams do not hide a similar one; all pairs are those of brute force."""
    rng = random.Random(3)
    query = "the cat sat on the mat"
    rows = [query + " " + "the cat sat on the mat " * 4] * 250 + ["tha cot set an tho met", query, "", "the cat sat"] + ["".join(rng.choice("the catsm") for _ in range(22)) for _ in range(60)]
    rows = [(k, " ".join(t.split())) for k, t in enumerate(rows)]
    got = memory.lookup_fuzzy(spark.createDataFrame([(7, query), (8, "")], "q long, t string"), spark.createDataFrame(rows, "m long, s string"), "q", "t", "m", "s", least=0.6).collect()
    want = {(i, k) for i, a in ((7, query), (8, "")) for k, t in rows if indel_ratio(a, t) >= 0.6}
    assert sorted((r["query"], r.candidate) for r in got) == sorted(want) and (7, 250) in want


def test_packs_are_exact():
    """A pack's hits are those of brute force, over alphabets, lengths and limits; few pairs are compared."""
    rng = random.Random(5)
    for trial in range(150):
        letters = rng.choice(["ab", "the catsm", "abcdefghijklmnopqrstuvwxyz é", "".join(map(chr, range(0x4E00, 0x4E50))) + "\U0001F600"])
        text = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))  # noqa: B023, E731
        texts = list({text(rng.choice([9, 40, 300])) for _ in range(rng.randint(1, 40))})
        others = sorted([text(rng.choice([9, 40, 300])) for _ in range(10)] + [texts[0], texts[-1][1:]], key=len)
        least = rng.choice([0.3, 0.5, 0.6, 0.75, 0.85, 1.0])
        want = [(i, k, r) for i, b in enumerate(others) for k, a in enumerate(texts) if (r := indel_ratio(a, b)) >= least]
        assert sorted(Pack(texts, least).hits(others)) == sorted(want), trial


def test_fuzzy_over_packs(spark, monkeypatch):
    """Queries of one class in several packs, repeated queries and memory rows, nulls."""
    monkeypatch.setattr(memory, "PACK_TEXTS", 3)
    rng = random.Random(8)
    text = lambda: "".join(rng.choice("the catsm") for _ in range(rng.randint(5, 60))).strip()
    q, m = [" ".join(text().split()) for _ in range(20)], [" ".join(text().split()) for _ in range(150)]
    q, m = list(enumerate([*q, q[0], None])), list(enumerate([*m, m[3], m[3], q[5], q[5], None]))
    got = memory.lookup_fuzzy(spark.createDataFrame(q, "q long, t string"), spark.createDataFrame(m, "m long, s string"), "q", "t", "m", "s", least=0.6).collect()
    want = [(i, k, indel_ratio(a, b)) for i, a in q for k, b in m if a is not None and b is not None and indel_ratio(a, b) >= 0.6]
    assert sorted(map(tuple, got)) == sorted(want) and {(5, 152), (5, 153)} <= {w[:2] for w in want}
