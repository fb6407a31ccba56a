import pytest
from pyspark.sql import functions as F

from quire.functions import cleaning as cl
from quire.functions import masking as mk
from quire.functions import numbers as nb


def test_masking_round_trip():
    text = "See https://a.example/x, mail a@b.example. `code $x$` and $a_1 = 2$ costs $5 and $6 [12-14] (Smith et al., 2020)."
    m = mk.mask(text)
    assert [f for _, f, _ in m.spans] == ["EMAIL", "EMAIL", "CODE", "MATH", "CITE", "CITE"] and "$5 and $6" in m.text
    assert mk.restore(m.text, m).text == text
    tokens = [t for t, *_ in m.spans]
    bad = mk.restore(m.text.replace(tokens[0], "").replace(tokens[3], tokens[3] * 2) + "⟦CODE_MASK_0009-abc⟧", m)
    assert bad.missing == [tokens[0]] and bad.duplicated == [tokens[3]] and bad.mutated == ["⟦CODE_MASK_0009-abc⟧"]
    swapped = mk.restore(m.text.replace(tokens[4], "X").replace(tokens[5], tokens[4]).replace("X", tokens[5]), m)
    assert set(swapped.reordered) == {tokens[4], tokens[5]}
    assert mk.lost_literals("write a@b.example", "nothing") == ["a@b.example"]


@pytest.mark.parametrize("token,want", [("1,250.50", "1250.5"), ("1.250,50", "1250.5"), ("007.10", "7.1"), ("0.0", "0"), ("-3", "-3"), ("１２", "12"), ("1,000,000", "1000000"), ("3,5", "3.5")])
def test_canonical_numbers(token, want):
    assert nb.canonical(token) == want


def test_values():
    assert nb.values("12.5 million and 1250万, 三十五 pages, 1,000") == ["12500000", "12500000", "35", "1000"]
    assert nb.cjk_value("三千二百万") == 32_000_000 and nb.cjk_value("二〇二四") == 2024 and nb.cjk_value("x") is None
    assert nb.lost_and_invented("5 and 7", "5 and 8") == (["7"], ["8"]) and nb.page_ranges("1-3, 5") == {1, 2, 3, 5}
    with pytest.raises(ValueError):
        nb.page_ranges("3-1")


def test_cleaning(spark):
    cases = [
        (cl.strip_protocol_tags, "<error_span id=1>x</error_span>", "x"), (cl.sanitized, '<p onclick="x()">a</p><script>b</script><a href="javascript:c">d</a>', "<p>a</p><a >d</a>"),
        (cl.without_sentinels, "a ⟦X⟧", "a ⟨missing⟩"), (cl.without_thoughts, "<think>no</think>Here is it:\nyes", "yes"), (cl.cjk_spacing, "中 文 ab", "中文 ab"), (cl.pangu, "中文ab1中", "中文 ab1 中"),
        (cl.cjk_punctuation, "啊...--", "啊……——"), (cl.compressed_punctuation, "啊。。。", "啊。"), (cl.typst, "a_b #c", "a\\_b \\#c"), (cl.heading_only, "T\n\nmore", "T"), (cl.word_joiners, "中。", "中⁠。"),
        (lambda t: cl.summary(t, 12), "One two. Three four.", "One two."), (lambda t: cl.grid(t).cast("string"), "|a|b\\|c|\n|-|-|\n|1|2|", "[2, 2]"), (lambda t: cl.is_dense_table(t).cast("string"), "|a|b|c|\n|-|-|-|\n|1|2|3|\n|4|5|6|", "true"),
        (lambda t: cl.kinsoku_errors(t).cast("string"), "。a\nb（", "2"),
    ]
    row = spark.range(1).select(*[f(F.lit(t)).alias(f"c{k}") for k, (f, t, _) in enumerate(cases)]).first()
    assert list(row) == [want for *_, want in cases]


def test_stream_upsert(spark, tmp_path):
    from quire.streaming.flows import stream_of, upsert

    ddl = "job_id long, block_id string, status string, target_text string, seq long"
    news = [[(1, "a", "pending", None, 1), (1, "b", "pending", None, 1)], [(1, "a", "drafted", "x", 2), (1, "a", "drafted", "y", 3)]]
    for k, rows in enumerate(news):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{tmp_path}/in", mode="append")
        query = upsert(stream_of(spark, f"{tmp_path}/in", ddl), f"{tmp_path}/out", f"{tmp_path}/at")
        assert query.awaitTermination(120)
        got = {(r.block_id, r.status, r.target_text) for r in spark.read.parquet(f"{tmp_path}/out/version={k}").collect()}
    assert got == {("a", "drafted", "y"), ("b", "pending", None)}
