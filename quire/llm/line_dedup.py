"""Line dedup: an exact set-similarity join of lines; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import FAST_MAP, WHITE, free_name, words_of, written

#: Similarity of word sets from which the later line goes: NUM / DEN.
NUM, DEN = 4, 5
#: Token counts are kept in 2^BUCKETS buckets: a table of that many bytes, whatever the corpus.
BUCKETS = 20
#: Levels of rarity a doubling; a level fits seven bits.
FINE = 4
#: Asked texts are marked in 2^MARKS words of 64 bits: a megabyte, whatever the corpus.
MARKS = 17


def _plain(text: Column) -> Column:
    """text with spaces for all other white space. One search is cheaper than five replaces, and few lines have any."""
    plain = text
    for c in WHITE[1:]:
        plain = F.replace(plain, F.lit(c), F.lit(" "))
    return F.when(text.rlike(r"[\t-\r]"), plain).otherwise(text)


def _words(text: Column) -> Column:
    """As words_of, with less work for texts without unusual white space."""
    return F.array_remove(F.split(_plain(F.replace(text, F.lit("\n"), F.lit(" "))), " "), "")


def _line_words(line: Column) -> Column:
    return F.array_remove(F.split(_plain(line), " "), "")


def _tokens(line: Column) -> Column:
    """Distinct words of a line, as 64-bit hashes."""
    return F.array_distinct(F.transform(_line_words(line), lambda w: F.xxhash64(w)))


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct runs of n words in lower case, as 64-bit hashes; a shorter text is one run."""
    # bound by an outer lambda, the words are split once and not for each run
    runs = lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - n + 1, F.lit(1))), lambda k: F.xxhash64(F.slice(ws, k, n)))
    return F.array_distinct(F.get(F.transform(F.array(words_of(F.lower(text))), runs), 0))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bucket(token: Column) -> Column:
    return token.bitwiseAND(F.lit((1 << BUCKETS) - 1))


def _bit(token: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), token.bitwiseAND(F.lit(63)).cast("int"))


def _table(rows: DataFrame, size: int, merge: Callable[[Column], Column], value: Callable[[Column], Column]) -> DataFrame:
    """One row with one array, cells, of 2^size values: that of merge(v) over the rows (b, v) of each place b; places without rows have v = 0.

    The array has a fixed size and is put together from parts of 1,024; it is a table that queries read by a subquery, no literal
    in their plans.
    """
    every = rows.sparkSession.range(1 << size).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("v"))
    merged = rows.groupBy("b").agg(merge(F.col("v")).alias("v")).unionByName(every).groupBy("b").agg(value(merge(F.col("v"))).alias("k"))
    values = lambda name: F.transform(F.sort_array(F.collect_list(F.struct(name, "k"))), lambda x: x["k"])
    parts = merged.groupBy(F.shiftright("b", 10).alias("p")).agg(values("b").alias("k"))
    # a task's places fit the hash map of compiled code, which by default holds 2^16 keys and leaves others to a slower one
    return written(parts.groupBy().agg(F.flatten(values("p")).alias("cells")), conf={FAST_MAP: str(max(size, 16))})


def rarity(docs: DataFrame, text_col: str, tokens: Callable[[Column], Column] | None = None) -> DataFrame:
    """A table of bytes: how often the corpus has the words (or tokens) of a bucket, on a log scale.

    All words of all texts are counted. Any total order of tokens keeps the join exact; buckets and levels only make it
    coarser than counts.
    """
    found = docs.select(F.explode((tokens or _words)(F.col(text_col))).alias("w"))
    found = found.select(_bucket(F.col("w") if tokens else F.hash("w")).alias("b"), F.lit(1).cast("long").alias("v"))
    return _table(found, BUCKETS, F.sum, lambda n: F.least(F.lit(126), F.floor(F.log2(n + 1) * FINE)).cast("tinyint"))


def _marked(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """rows without most of those whose keys asked lacks: those whose bit of a hash no row of asked sets. A join decides on the rest."""
    h = F.xxhash64(*keys)
    place = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit((1 << MARKS) - 1))
    marks = _table(asked.select(place.alias("b"), _bit(h).alias("v")), MARKS, F.bit_or, lambda v: v)
    return rows.filter(F.get(marks.scalar(), place).bitwiseAND(_bit(h)) != 0)


def _keys(line: Column, levels: Column, tokens: Callable[[Column], Column] | None = None) -> Column:
    """Distinct tokens of a line (of words, without tokens) in order of rarity: a byte of the table of levels, then 56 bits of hash each.

    A word gives its place in the table and its hash at once, so words need no array of hashes in between.
    """
    place, h = ((lambda w: w), (lambda w: w)) if tokens else (F.hash, F.xxhash64)
    # never null, and said to be so: such arrays of numbers are sorted as they are, without an object for each
    level = lambda w: F.coalesce(F.get(levels, _bucket(place(w))), F.lit(0).cast("tinyint"))
    key = lambda w: F.shiftleft(level(w).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h(w), 8))
    return F.sort_array(F.array_distinct(F.transform((tokens or _line_words)(line), key)))


def _up(a: Column, num: int, den: int) -> Column:
    """ceil(a * num / den) of whole numbers."""
    return F.floor((a * num + (den - 1)) / den).cast("int")


def _overlap(n: Column, m: Column) -> Column:
    """Tokens that sets of n and m share at least if similar: J >= t iff overlap >= t / (1 + t) (n + m)."""
    return _up(n + m, NUM, NUM + DEN)


def _prefix_size(n: Column) -> Column:
    """Of a set of n in the order of tokens, so many first ones share a token with any similar set's first ones."""
    return n - _up(n, NUM, DEN) + 1


def _short_size(n: Column) -> Column:
    """Of a set of n, so many first ones share a token with the first _prefix_size ones of any similar set that is not smaller."""
    return n - _overlap(n, n) + 1


def _prefixes(classes: DataFrame, short: bool = False) -> DataFrame:
    """A row for each token of each prefix: tok, c, n, i (place, from 1), bits."""
    prefix = F.slice("prefix", F.lit(1), _short_size(F.col("n"))) if short else F.col("prefix")
    return classes.select("c", "n", "bits", F.posexplode(prefix).alias("i", "tok")).select("tok", "c", "n", (F.col("i") + 1).alias("i"), "bits")


def _with_earliest(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a class b and the earliest class a that has one of its tokens too, where the filters let them meet.

    Of the prefixes that part is enough in which similar sets of equal size share a token. A token's rows are read once in order
    of c, none of them is held.
    """
    first = F.first(F.struct("c", "n", "i", "bits")).over(Window.partitionBy("tok").orderBy("c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = _prefixes(classes, short=True).select("*", first.alias("a")).alias("b")
    return rows.filter((F.col("a.c") < F.col("b.c")) & _may_match()).select(F.col("a.c").alias("a"), F.col("b.c").alias("b")).distinct()


def _may_match() -> Column:
    """Length, positional and bit filters for rows a and b that share a token.

    Positional: with the first shared token at places i and j, at most 1 + min(n - i, m - j) are shared. Bits: each
    set's tokens xor one bit each, so bits that differ are at most the tokens that differ.
    """
    n, m, least = F.col("a.n"), F.col("b.n"), _overlap(F.col("a.n"), F.col("b.n"))
    return (
        (n * DEN >= m * NUM) & (m * DEN >= n * NUM)
        & (F.least(n - F.col("a.i"), m - F.col("b.i")) + 1 >= least)
        & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= n + m - least * 2)
    )


def _pairs(classes: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes, b later and not done, that share a token of their prefixes where the filters let them meet, distinct.

    Two classes that are not done meet by the short prefix of the smaller one (of equal ones, the earlier) and the whole prefix of the other;
    which of them is later does not matter. Done ones are only earlier: they bring their whole prefixes, and two of them never meet.
    """
    done = done.withColumnRenamed("b", "c")
    rest = classes.join(done, "c", "left_anti")
    few = _prefixes(rest, short=True).withColumn("done", F.lit(False)).unionByName(_prefixes(classes.join(done, "c", "left_semi")).withColumn("done", F.lit(True)))
    earlier = F.col("a.c") < F.col("b.c")
    turn = F.when(F.col("a.done") | (F.col("a.n") == F.col("b.n")), earlier).otherwise(F.col("a.n") < F.col("b.n"))
    both = few.alias("a").join(_prefixes(rest).alias("b"), (F.col("a.tok") == F.col("b.tok")) & turn & _may_match())
    return both.select(F.least("a.c", "b.c").alias("a"), F.greatest("a.c", "b.c").alias("b")).distinct()


def _sharing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose prefixes share tokens enough, with the places of both lines.

    Of two prefixes, the one that ends first in the order of tokens has all of its tokens that the other set holds in the
    other prefix too. A set of n has at most n - overlap tokens of its own, so the prefixes share at least the rest of that one.
    """
    side = lambda x: classes.select(F.col("c").alias(x), F.struct("c", "id", "t", "no").alias(f"at_{x}"), F.col("n").alias(f"n_{x}"), F.col("prefix").alias(f"prefix_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    least = F.least(*[_prefix_size(F.col(x)) - F.col(x) + _overlap(F.col("n_a"), F.col("n_b")) for x in ("n_a", "n_b")])
    return both.filter(F.size(F.array_intersect("prefix_a", "prefix_b")) >= least).select("a", "b", "at_a", "at_b")


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, parts: Callable[[Column], Column], tokens: Callable[[Column], Column]) -> DataFrame:
    """Of pairs (a, b) of classes those whose whole token sets are similar: the later ones, b, distinct."""
    pairs = written(_sharing(written(pairs), classes))  # written first, so the join's shuffle is gone when classes are dealt out
    needed = pairs.select("at_a.*").unionByName(pairs.select("at_b.*")).distinct()
    pairs = pairs.select("a", "b")
    asked = written(needed.groupBy("id", "t").agg(F.collect_list(F.struct("no", "c")).alias("asked"))).alias("q")  # bounded by a text's lines
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    texts = _marked(texts, asked, ["id", "t"]).alias("d")
    # asked grows with the corpus, so it is never broadcast
    found = texts.join(asked.hint("merge"), F.col("d.id").eqNullSafe(F.col("q.id")) & (F.col("d.t") == F.col("q.t")))
    # bound by an outer lambda, a text is split once and not for each of its lines
    picked = F.transform(F.array(parts(F.col("text"))), lambda ls: F.transform("asked", lambda a: F.struct(a["c"].alias("c"), F.get(ls, a["no"]).alias("line"))))
    found = found.select(F.explode(F.get(picked, 0)).alias("x"))
    sets = written(found.select(F.col("x.c").alias("c"), tokens(F.col("x.line")).alias("s")).dropDuplicates(["c"]))
    both = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return written(both.filter(shared * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM).select("b").distinct())


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that an earlier one is similar to: sets of five-word shingles, Jaccard NUM / DEN or more, exactly.

    The join of dedup_lines over whole texts; where lines break does not count. Texts without a word stay.
    """
    return dedup_lines(docs, id_col, text_col, F.array, shingles).filter("n_removed = 0").select(*docs.columns)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: Callable[[Column], Column] = _lines, tokens: Callable[[Column], Column] = _tokens
) -> DataFrame:
    """Every row of docs with its text without the lines that an earlier line is similar to, and n_lines, n_removed.

    Lines are the parts between newlines; their tokens are their distinct words, unless parts and tokens say otherwise. A line goes if any line before it, by
    id (null last), place of its text among rows that repeat the id, and line number, has a Jaccard similarity of NUM / DEN or
    more, whether or not that line goes itself. Lines without a word stay and match nothing. Null texts stay null; rows
    that repeat both id and text share their lines' fate. Lines of any length are compared whole. An empty table gives an empty result.
    Columns of docs that clash with an added name are replaced.

    1. Equal token sets are one class, that of its first line; classes are numbered in order of first lines. (Sets
       are equal if 128 bits of hash over 56 bits a token are.)
    2. Each class's tokens are ordered by rarity; only its prefix, in which any similar set must share a
       token, is joined.
    3. First each class meets only the earliest class of each of its prefix tokens, which is linear in any group of
       near copies. Classes found similar there are done; the others, as later lines, meet all that pass the filters of length, bits, places and shared tokens.
    4. Similarity is computed from the tokens of both lines. (Tokens are 64-bit hashes of words; the sizes that filters go by count 56 bits a token.)
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    text = F.col(text_col)
    own = None if tokens is _tokens else tokens
    table = rarity(docs, text_col, own).scalar()
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), table.alias("levels"), F.posexplode(parts(text)).alias("no", "line"))
    # the row of levels is used in one place, so the optimizer moves its subquery there and no row carries it
    lines = lines.filter(F.ltrim("line", F.lit(WHITE)) != "").select("id", "t", "no", _keys(F.col("line"), F.col("levels"), own).alias("s"))
    n = F.size("s")
    # in prefixes 31 bits of a token do: equal ones by chance are only candidates that the filters and the similarity turn down
    short = lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    lines = lines.select(
        "id", "t", "no", n.alias("n"), F.xxhash64("s").alias("c1"), F.xxhash64(F.lit(1), "s").alias("c2"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(_bit(k))).alias("bits"), F.transform(F.slice("s", 1, _prefix_size(n)), short).alias("prefix"),
    )
    order = F.struct(F.col("id").isNull().alias("last"), "id", "t", "no")
    classes = lines.groupBy("c1", "c2").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("prefix").alias("prefix"))
    # ranges of first lines are partitions in order, so the ids that partitions give their rows are too
    classes = classes.select("first.id", "first.t", "first.no", "n", "bits", "prefix").orderBy(F.col("id").asc_nulls_last(), "t", "no")
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()))

    done = _similar(_with_earliest(classes), classes, docs, id_col, text_col, parts, tokens)
    more = _similar(_pairs(classes, done), classes, docs, id_col, text_col, parts, tokens)
    gone = done.unionByName(more).withColumnRenamed("b", "c")
    stay = classes.select("c", "id", "t", "no").join(gone, "c", "left_anti").groupBy("id", "t").agg(F.collect_list("no").alias("stay"))

    t, k, ls = (free_name(docs, x) for x in ("_t", "_stay", "_lines"))
    rows, stay = docs.withColumn(t, F.xxhash64(text_col)).alias("d"), stay.alias("s")
    out = rows.join(stay, F.col(f"d.{id_col}").eqNullSafe(F.col("s.id")) & (F.col(f"d.{t}") == F.col("s.t")), "left").select("d.*", F.col("s.stay").alias(k))
    out = out.withColumn(ls, parts(text))
    blank = F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.ltrim(F.get(F.col(ls), i), F.lit(WHITE)) == "")
    stays = F.sort_array(F.array_union(F.coalesce(F.col(k), F.array().cast("array<int>")), blank))
    out = out.withColumn(k, F.when(text.isNotNull(), stays))
    kept = F.when(text.isNotNull(), F.array_join(F.transform(k, lambda i: F.get(F.col(ls), i)), "\n"))
    count = lambda x: F.when(text.isNotNull(), x).otherwise(0).cast("long")
    named = {text_col: kept, "n_lines": count(F.size(ls)), "n_removed": count(F.size(ls) - F.size(k))}
    if "n_chars" in docs.columns:
        named["n_chars"] = F.coalesce(F.length(kept), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(named).select(*docs.columns, "n_lines", "n_removed")
