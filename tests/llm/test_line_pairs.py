import random

from pyspark.sql import functions as F

from quire.llm import line_dedup as d
from quire.llm.common import FAST_MAP, words_of


def test_words_as_words_of(spark):
    """The lines' words are those of words_of, for every kind of white space, empty and null texts."""
    texts = [None, "", " \t", "a b", "a\tb\x0bc\x0cd\re", "a\nb  c\r\nd", "é ü x \x1cy"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(d._words(F.col("text")).alias("got"), words_of(F.col("text")).alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_pairs_by_short_prefixes(spark):
    """Of classes of any sizes, all similar pairs whose later one is not done meet, and no pair of two that are done."""
    rng, sets = random.Random(5), []
    for _ in range(25):
        base = rng.sample(range(400), rng.randint(1, 40))
        sets.append(sorted(base))
        for _ in range(5):  # smaller, larger and changed copies
            copy = set(base) - set(rng.sample(base, rng.randint(0, len(base) // 5))) | set(rng.sample(range(400), rng.randint(0, len(base) // 6)))
            sets.append(sorted(copy))
    rng.shuffle(sets)

    def bits(s):
        x = 0
        for k in s:
            x ^= 1 << k % 63
        return x

    prefix = lambda s: s[: len(s) - -(-len(s) * d.NUM // d.DEN) + 1]
    classes = spark.createDataFrame([(c, len(s), bits(s), prefix(s)) for c, s in enumerate(sets)], "c long, n int, bits long, prefix array<int>")
    done = set(rng.sample(range(len(sets)), 40))
    got = [(r.a, r.b) for r in d._pairs(classes, spark.createDataFrame([(c,) for c in done], "b long")).collect()]
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if d.DEN * len({*sets[a]} & {*sets[b]}) >= d.NUM * len({*sets[a]} | {*sets[b]})}
    want = {p for p in similar if p[1] not in done}
    assert len(got) == len(set(got)) and want <= set(got) and all(a < b and b not in done for a, b in got)
    assert {len(sets[a]) > len(sets[b]) for a, b in want} == {True, False} and any(a in done for a, _ in want)


def test_marked_texts(spark):
    """Every asked text stays; of the others nearly all go before texts are dealt out."""
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), F.xxhash64("id").alias("t"))
    asked = rows.filter("id is null or id % 50 = 0")
    got = {r.id for r in d._marked(rows, asked, ["id", "t"]).collect()}
    assert {r.id for r in asked.collect()} <= got and len(got) < 200
    assert d._marked(rows, asked.limit(0), ["id", "t"]).count() == 0


def test_keys_of_words(spark):
    """A line's keys are those of its distinct words, rarer ones first, in an array that is said to hold no null; settings are as before."""
    before = spark.conf.get(FAST_MAP)
    docs = spark.createDataFrame([("a b a\nrare\tb",), (None,), ("a a b  c é",)], "text string")
    table = d.rarity(docs, "text")
    assert spark.conf.get(FAST_MAP) == before
    rows = docs.select(table.scalar().alias("levels"), F.explode(F.split("text", "\n")).alias("line")).select("line", d._keys(F.col("line"), F.col("levels")).alias("s"))
    assert not rows.schema["s"].dataType.containsNull
    got = {r.line: r.s for r in rows.collect()}
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in ("a", "b", "c", "rare", "é")], "w string").select("w", F.shiftrightunsigned(F.xxhash64("w"), 8).alias("h")).collect()}
    for line, s in got.items():
        assert s == sorted(s) and sorted(k & (1 << 56) - 1 for k in s) == sorted(hashes[w] for w in {*line.split()})
    level = {w: k >> 56 for s in got.values() for k in s for w in hashes if hashes[w] == k & (1 << 56) - 1}
    assert level["a"] > level["b"] > level["c"] == level["rare"] == level["é"] > 0
    tokens = lambda c: F.array(F.lit(3 << 40), F.lit(7 << 40))
    assert [k & (1 << 56) - 1 for k in rows.limit(1).select(d._keys(F.col("line"), F.array(F.lit(1).cast("tinyint")), tokens).alias("s")).first().s] == [3 << 32, 7 << 32]
