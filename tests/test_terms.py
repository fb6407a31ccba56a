from pyspark.sql import functions as F

from quire.operators import terms


def test_containment_against_all_pairs(spark):
    """CJK terms inside clauses, terms that begin with a sign, and terms of signs alone meet their blocks."""
    texts = ["我们研究机器学习方法的应用", "uses .NET and C++ here", "A型号 and AI技术好", "a ++ b", "the NET total", "カタカナの語", "", None]
    names = ["机器学习", "机器", "学习", ".NET", "C++", "A型", "AI技术", "++", "the", "タカ", "net total", "型", "我"]
    blocks = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "block_id long, source_text string")
    glossary = spark.createDataFrame([(n,) for n in names], "source string")
    got = sorted((r.block_id, r.source, r.n) for r in terms.containment(blocks, glossary, keys=("block_id",)).collect())
    every = blocks.crossJoin(glossary).withColumn("n", terms.occurrences(F.col("source_text"), F.col("source"))).filter("n > 0")
    assert got == sorted((r.block_id, r.source, r.n) for r in every.collect())
    assert {(0, "机器学习", 1), (1, ".NET", 1), (2, "A型", 1), (3, "++", 1)} <= set(got)


def test_all_abbreviations(spark):
    letters = "ABCDEFGHIJ"
    pairs = [(a + b, f"{a}xx {b}yy") for a in letters for b in letters]
    blocks = spark.createDataFrame([(1, k, f"{x} ({a})") for k, (a, x) in enumerate(pairs)], "doc_id long, spine_index int, source_text string")
    assert [tuple(r) for r in terms.abbreviations(blocks).collect()] == sorted(pairs)
