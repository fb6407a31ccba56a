"""Quality rules: a ledger of failure bits and measurements, policies over the bits, ablations; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WORD, free_name, without_white, written

#: Words in a window whose repeats count.
WINDOW = 5
#: The rules, by bit. Each is SQL over the measurements and means failure; both engines read it.
RULES = {
    "few_words": "n_words < 10",
    "repeated_words": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "10 * word_chars < 15 * n_words",
    "exclaims": "5 * n_exclaims > n_words",
}
BASE = ("few_words", "repeated_words")
#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines"),
    "v2": (*BASE, "symbols", "repeated_lines", "capitals", "long_words", "short_words", "exclaims"),
}
CURRENT = "v2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclaims")


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of each window of WINDOW words."""
    window = lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, WINDOW)])
    return F.slice(F.transform(words, window), 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))


def quality_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of docs with the measurements and fail_bits, bit k set if rule k of RULES fails.

    Null and empty texts have no words (and so fail few_words). Nothing is shuffled: a row's
    measurements come from its own text. n_repeat_words counts words in windows found twice or more
    in the text, the first included: windows are compared by a 64-bit hash; texts without a repeat, most of
    them, stop at a comparison of counts; for the others windows are sorted by hash with their
    place, so cost is n log n in the longest text. Columns of docs that clash with an added name are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (*MEASURES, "fail_bits")])
    w, t, h, s, g = (free_name(docs, f"_{x}") for x in ("words", "text", "hashes", "sorted", "lines"))
    out = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({
        w: F.regexp_extract_all(F.col(t), F.lit(WORD), F.lit(0)),
        g: F.filter(F.split(F.col(t), "\n"), lambda x: x.rlike(WORD)),
    })
    out = out.withColumn(h, window_hashes(F.col(w)))
    out = out.withColumn(s, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    places = F.transform(F.filter(F.col(s), lambda x, i: same(x, F.get(F.col(s), i - 1)) | same(x, F.get(F.col(s), i + 1))), lambda x: x["i"])
    start = F.struct(F.lit(-WINDOW).cast("int").alias("last"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum"))
    repeats = F.when(F.col(s).isNull(), F.lit(0).cast("long")).otherwise(F.aggregate(F.sort_array(places), start, step, lambda a: a["sum"]))
    count = lambda pattern: F.regexp_count(F.col(t), F.lit(pattern)).cast("long")
    out = out.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(without_white(F.col(t))).cast("long"),
        "n_symbols": count(r"[#*$%&|<>]"),
        "n_lines": F.size(g).cast("long"),
        "n_dup_lines": (F.size(g) - F.size(F.array_distinct(g))).cast("long"),
        "n_repeat_words": repeats,
        "n_capitals": count(r"\p{Lu}"),
        "n_exclaims": count("!"),
    })
    fails = [F.when(F.expr(rule), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(RULES.values())]
    mask = fails[0]
    for f in fails[1:]:
        mask = mask.bitwiseOR(f)
    return out.withColumn("fail_bits", mask).select(*docs.columns, *MEASURES, "fail_bits")


def stored_ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """quality_ledger(docs) as a table in the shared folder: rules are evaluated once, and filters on verdicts never pull them apart.

    (Over the ledger's plan itself the optimizer pushes a filter below the measurements, which repeats them inside one another.)
    """
    return written(quality_ledger(docs, text_col))


def apply_policy(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept, the verdict of a policy; no text is read again."""
    fails = lambda rules: F.col("fail_bits").bitwiseAND(F.lit(bits(rules)).cast("long")) != 0
    base = fails(BASE)
    return ledger.withColumns({"base_failed": base, "kept": ~(base | fails(POLICIES[version]))})


def ablations(ledger: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept again without it).

    One aggregation over fail_bits; the ledger's rows collapse to counts per distinct mask on the map side first.
    An empty ledger gives zero counts.
    """
    policy = bits(POLICIES[version])
    masks = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy).cast("long")).alias("mask")).count()
    rules = ledger.sparkSession.createDataFrame([(r, 1 << list(RULES).index(r)) for r in POLICIES[version]], "rule string, bit long")
    hits = masks.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in POLICIES[version]])).alias("r"), "mask", "count")
    hits = hits.groupBy("r.rule").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only"),
    )
    return rules.drop("bit").join(hits, "rule", "left").fillna(0)
