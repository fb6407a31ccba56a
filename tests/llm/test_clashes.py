"""Every operator with each of its internal names as an extra column, and with ids that are strings."""

import pytest
from quire.llm.exact_dedup import exact_dedup
from quire.llm.html_extract import extract_pages
from quire.llm.line_dedup import dedup_lines, drop_similar
from quire.llm.mixing import apply_mix, mix
from quire.llm.quality import apply_policy, quality_ledger
from quire.llm.secrets import scan_secrets
from quire.llm.simhash import drop_near_copies, near_dedup
from quire.llm.suffix_dedup import remove_repeats

EXTRA = "_most _best _n _salts _salt _norm _points _digest _bytes _second _first _id _of _i _s _z _t _stay _lines _text _spans _size _taken _nth _key _range id t c tok s stay size f least root keep kept n_lines a b".split()
TEXTS = ["one two three four five six\nseven", "one two three four five six\nseven", "", None, "other words that stand here alone " * 40, "one two three four five six\nseven eight"]


def frame(spark, kind):
    ids = [k if kind == "long" else f"d{k}" for k in (0, 1, 2, 3, 4, 4)]
    rows = [(i, t, "s", *[f"{c}{k}" for c in EXTRA]) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))]
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, source string, " + ", ".join(f"`{c}` string" for c in EXTRA))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_clashing_columns(spark, kind):
    docs = frame(spark, kind).cache()
    for f in (exact_dedup, dedup_lines):
        got = f(docs)
        assert set(docs.columns) - {"kept"} <= set(got.columns) and got.count() == 6
    got = {r.doc_id: r for r in exact_dedup(docs).collect() if r.text == TEXTS[0]}
    assert sum(r.kept for r in got.values()) == 1 and {r.keep_id for r in got.values()} == ({0} if kind == "long" else {"d0"})
    for f in (apply_mix, drop_near_copies, drop_similar):
        assert f(docs).columns == docs.columns and 0 < f(docs).count() <= 6
    for f in (mix, scan_secrets, remove_repeats, near_dedup):
        assert f(docs).count() == 6
    assert apply_policy(quality_ledger(docs.select("doc_id", "text", "size"))).count() == 6
    assert extract_pages(docs.withColumnRenamed("s", "html")).count() == 6
