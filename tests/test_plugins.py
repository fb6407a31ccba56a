"""Plug-in surfaces, SQL functions and sinks."""

import pytest
from pyspark.sql import functions as F

from quire import plugins as p
from quire.sources import sinks


def made():
    """Classes of their own, so that they travel to the workers by value."""

    class Length(p.Scorer):
        def score(self, source, target):
            return target.str.len() / source.str.len().clip(lower=1)

    class Digits(p.Validator):
        def check(self, source, target):
            lost = set(filter(str.isdigit, source)) - set(filter(str.isdigit, target))
            return p.Finding(not lost, "NUMERIC" if lost else "", ",".join(sorted(lost)), "RETRY" if lost else "")

    class Brackets(p.Masker):
        family = "B"

        def spans(self, text):
            return [(k, k + 1) for k, c in enumerate(text) if c in "[]"]

    return Length(), Digits(), Brackets()


def test_scorer_validator_masker(spark):
    length, digits, brackets = made()
    rows = spark.createDataFrame([("abc 1", "ab", "[x]"), (None, "a", None), ("", "", "")], "s string, t string, m string")
    got = rows.select(length.column()("s", "t").alias("score"), digits.column()("s", "t").alias("f"), brackets.column()("m").alias("spans")).collect()
    assert [round(r.score, 2) for r in got] == [0.4, 1.0, 0.0] and [r.f.code for r in got] == ["NUMERIC", "", ""]
    assert [[(x.start, x.end) for x in r.spans] for r in got] == [[(0, 1), (2, 3)], [], []]


def test_providers(spark):
    blocks = spark.createDataFrame([("a",), (None,), ("known",)], "source_text string")
    assert [r.draft_text for r in p.MockProvider("fr", {"known": "connu"}).drafts(blocks).collect()] == ["[fr] a", None, "connu"]
    assert [r.draft_text for r in p.EchoProvider().drafts(blocks).collect()] == ["a", None, "known"]
    with pytest.raises(Exception, match="told to"):
        p.MockProvider(fails=("know",)).drafts(blocks).collect()


def test_advice(spark):
    docs = spark.createDataFrame([(0.5, 1), (0.0, 2)], "struct_share double, id int")
    rules = [p.AdvisorRule("structure", F.col("struct_share") > 0.2, {"dual": 0.4, "mono": 0.1})]
    got = {r.id: r for r in p.advise(docs, rules, {"dual": 0.05, "mono": 0.1}).collect()}
    assert (got[1].recommended, got[1].score_dual, got[1].reasons) == ("mono", 0.55, ["structure"]) and (got[2].recommended, got[2].reasons) == ("dual", [])


def test_drivers():
    p.register_driver("plain", dict, local=True)
    p.register_driver("far", list)
    assert p.driver("plain", upload=False, a=1) == {"a": 1}
    for error, call in ((PermissionError, lambda: p.driver("far", upload=False)), (KeyError, lambda: p.driver("none")), (ValueError, lambda: p.register_driver("plain", set))):
        with pytest.raises(error):
            call()


def test_sql_functions(spark):
    names = p.register_sql(spark)
    rows = spark.createDataFrame([("ch_1#b2", "zh-CN", "Score: 85/100", "x = $a$")], "i string, l string, j string, m string")
    rows.createOrReplaceTempView("plug")
    got = spark.sql("SELECT quire_chapter(i) c, quire_lang(l) l, quire_judge_score(j) s, quire_tokens(m) t, quire_flag_kind('Repair error: 1') k, quire_delivery(0, 0, 1, 5) d, quire_complexity(m, 'heading') x, quire_cjk('文') z FROM plug").first()
    assert (got.c, got.l, got.s, got.t, got.k, got.d, got.x, got.z) == ("ch_1", "zh", 0.85, 1, "repair_transient", "warning", 0.13, True) and len(names) == 11


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "report")
    for n in (1, 2):
        sinks.write_whole(spark.createDataFrame([(n, "x")], "n int, run string"), at)
    assert [r.n for r in spark.read.json(at).collect()] == [2] and [x.name for x in tmp_path.iterdir()] == ["report"]
    assert spark.read.json(sinks.save_report(spark.createDataFrame([(1, "x")], "n int, run string"), str(tmp_path / "by"), "run")).first().run == "x"
    blocks = spark.createDataFrame([("d", 1, "paragraph", "One", None, None), ("d", 0, "heading", "Title", 2, None), ("d", 2, "list_item", "two", None, "*"), ("d", 3, "code", "x", None, None), ("d", 4, "paragraph", " ", None, None)], "doc_id string, spine_index int, block_type string, t string, level int, marker string")
    assert sinks.markdown(blocks, F.col("t")).first().content == "## Title\n\nOne\n\n* two\n\n```\nx\n```\n"
    (tmp_path / "r.csv").write_text('block_id,revised_translation,job_id\nb1," two, words ",j\nb2,,j\n,x,\nb3,"a\nb",\n')
    assert sorted((r.block_id, r.text, r.job_id) for r in sinks.csv_revisions(spark, str(tmp_path / "r.csv")).collect()) == [("b1", "two, words", "j"), ("b3", "a\nb", None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="revised_translation"):
        sinks.csv_revisions(spark, str(tmp_path / "bad.csv"))


def test_cache(spark, tmp_path):
    cache = sinks.ContentCache(spark, str(tmp_path / "cache"), entries=10)
    keys = spark.createDataFrame([("00a",), ("ffx",)], "key string")
    assert [r.value for r in cache.get(keys).collect()] == [None, None]
    cache.put(spark.createDataFrame([("00a", "old"), ("01b", "x")], "key string, value string"), 1.0)
    cache.put(spark.createDataFrame([("00a", "new")], "key string, value string"), 2.0)
    assert {r.key: r.value for r in cache.get(keys).collect()} == {"00a": "new", "ffx": None}
    cache.put(spark.createDataFrame([(f"{k:02d}z", str(k)) for k in range(20)], "key string, value string"), 3.0)
    cache.prune()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 9


