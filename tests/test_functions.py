import random

import pytest
from pyspark.sql import functions as F

from quire.functions import script
from quire.functions import similarity as sim
from quire.functions import text as tx
from quire.operators import gates, states
from quire.operators.order import longest_non_decreasing
from quire.sources.blocks import decoded, html_elements, markdown_elements, pipe_table


def one(spark, column, text="", **more):
    row = spark.createDataFrame([(text, *more.values())], ["t", *more]) if text is not None else spark.createDataFrame([(None,)], "t string")
    return row.select(column.alias("x")).first()["x"]


VERDICTS = [
    ("", "empty"), (None, "empty"), ("— · —", "placeholder"), ("https://a.example/x", "identifier_only"), ("978-3-16-148410-0", "identifier_only"),
    ("0f " * 40, "hexdump"), ("\n".join(f"word{k}" for k in range(12)), "index_list"), ("A plain sentence.", "translate"),
]


def test_verdict(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(VERDICTS)], "k int, t string")
    got = {r.k: r.v for r in rows.select("k", tx.verdict(F.col("t")).alias("v")).collect()}
    assert got == {k: f"verdict:{v}" for k, (_, v) in enumerate(VERDICTS)}


def test_verdict_word_characters(spark):
    """Numbers of every kind are word characters, marks and ties are not, as in Python's regexes and the query's SQL."""
    cases = [("½", "translate"), ("③ — ③", "translate"), ("\u0301", "placeholder"), ("\u203f", "placeholder"), ("\n".join(["²a"] * 12), "index_list"), ("\n".join(["a\u0301"] * 12), "translate")]
    rows = spark.createDataFrame(list(enumerate(t for t, _ in cases)), "k int, t string")
    got = {r.k: r.v for r in rows.select("k", tx.verdict(F.col("t")).alias("v")).collect()}
    assert got == {k: f"verdict:{v}" for k, (_, v) in enumerate(cases)}


def test_shapes(spark):
    cases = {
        "page": (tx.is_bare_page_number(F.col("t")), ["12", " xiv "], ["12345", "page 1", ""]), "heading": (tx.looks_like_heading(F.col("t")), ["A title"], ["Ends.", "- item", "x" * 90]),
        "math": (tx.is_display_math(F.col("t")), ["$$x$$"], ["$$$", "$x$"]), "listing": (tx.looks_like_listing(F.col("t")), ["def f(x)", "class Net(Base):"], ["class imbalance: it"]),
        "isbn": (tx.is_valid_isbn(F.col("t")), ["978-3-16-148410-0", "0-306-40615-2", "0-8044-2957-X"], ["978-3-16-148410-1", "123", ""]),
        "table": (tx.is_markdown_table(F.col("t")), ["|a|b|\n|-|-|\n|1|2|"], ["a|b", "|a|b|\n|1|2|"]), "gutenberg": (tx.is_gutenberg_marker(F.col("t")), ["[Illustration: x]"], ["Illustration"]),
    }
    rows = spark.createDataFrame([(n, t, ok) for n, (_, yes, no) in cases.items() for ok, ts in ((True, yes), (False, no)) for t in ts], "n string, t string, ok boolean")
    for name, (column, _, _) in cases.items():
        assert rows.filter((F.col("n") == name) & (column != F.col("ok"))).count() == 0, name


def test_normalisation(spark):
    assert one(spark, tx.normalized(F.col("t")), "of­ﬁce ﬂow​") == "office flow"
    assert one(spark, tx.collapsed(F.col("t")), " a　 b\n\nc ") == "a b c"
    assert one(spark, tx.xml_safe(F.col("t")), "a\x01b퟿") == "ab퟿"
    assert one(spark, tx.joined(F.array(F.lit("co-"), F.lit("op"), F.lit("中"), F.lit("文"))), "x") == "coop 中文"


def test_scripts_and_tokens(spark):
    assert one(spark, script.share(F.col("t"), "han"), "中文 ab") == 0.5
    for text, want in (("abcdefgh", 2), ("", 0), (None, 0), ("中文", 2), ("привет", 2)):
        assert one(spark, script.token_count(F.col("t")), text) == want
    assert one(spark, script.math_density(F.col("t")), "plain words only") == "none" and one(spark, script.math_density(F.col("t")), "x = 1 ∑ ∫ α") == "high"


def test_similarity():
    rng = random.Random(1)

    def lcs(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert sim.lcs_length(a, b) == lcs(a, b)
    assert sim.indel_ratio("", "") == 1 and sim.token_sort_ratio("b a", "a b") == 1 and sim.partial_ratio("bcd", "abcde") == 1
    assert sim.sentence_bleu("a b c d e", "a b c d e") == 1.0 and 0 < sim.sentence_bleu("a b c d", "a b x d") < 1 and sim.chrf_recall("abc", "abc") == 1


def test_gates(spark):
    pairs = [
        ("A source sentence here.", "", "empty"), ("A source sentence here.", "A source sentence here.", "other"), ("It costs 12.50 now.", "Das kostet jetzt 12.5.", "pass"),
        ("It costs 12 now.", "Das kostet jetzt 13.", "numeric"), ("As shown [1].", "Wie gezeigt [1, 2].", "fabricated"), ("A text ⟦M⟧", "Ein Text ⟦M⟧", "markup"), ("One. Two. Three. Four.", "Eins zwei drei vier alles.", "omission"),
    ]
    rows = spark.createDataFrame(pairs, "s string, g string, want string")
    assert [r.want for r in rows.select("want", gates.fast_pass(F.col("s"), F.col("g")).alias("r")).filter("want <> r").collect()] == []
    assert one(spark, gates.references(F.col("t")), "x [3-5, 9] y [4]") == [3, 4, 5, 9]


def test_states(spark):
    blocks = spark.createDataFrame([(1, "a", "pending", "old"), (1, "b", "failed", "old"), (1, "c", "drafted", "old")], "job_id int, block_id string, status string, target_text string")
    news = spark.createDataFrame([(1, "a", "drafted", "new"), (1, "b", "drafted", "new"), (1, "c", None, None)], "job_id int, block_id string, status string, target_text string")
    got = {r.block_id: (r.status, r.target_text) for r in states.merge_checkpoints(blocks, news).collect()}
    assert got == {"a": ("drafted", "new"), "b": ("failed", "old"), "c": ("drafted", "old")}


@pytest.mark.parametrize("raw,want", [(b"\xef\xbb\xbfa", "a"), ("é".encode("latin-1"), "é"), (b'<meta charset="latin-1">\xe9', '<meta charset="latin-1">é')])
def test_decoding(raw, want):
    assert decoded(raw) == want


def test_readers():
    assert html_elements("<h2>T</h2><ol><li>x<li>y</ol><table><tr><td>1<td>a|b</table>") == [("heading", 2, None, "T"), ("list_item", None, "1.", "x"), ("list_item", None, "2.", "y"), ("table", None, None, "| 1 | a\\|b |\n| --- | --- |")]
    assert [e[0] for e in markdown_elements("# T\n\ntext\n\n```\nc\n```\n- i\n\n|a|b|\n|-|-|\n|1|2|")] == ["heading", "paragraph", "code", "list_item", "table"]
    assert pipe_table([["a"], ["", ""], ["b", "c"]]).count("\n") == 2 and pipe_table([]) == ""


def test_longest_non_decreasing():
    assert [[3, 1, 2, 2, 5, 4][k] for k in longest_non_decreasing([3, 1, 2, 2, 5, 4])] == [1, 2, 2, 4] and longest_non_decreasing([]) == []
