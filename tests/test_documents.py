from quire.operators import documents as dc

BLOCK = "doc_id int, spine_index int, block_id string, block_type string, source_text string"


def blocks(spark, *texts, doc=1, start="b"):
    return spark.createDataFrame([(doc, k, f"{start}{k}", "paragraph", t) for k, t in enumerate(texts)], BLOCK)


def test_citations(spark):
    rows = blocks(spark, "Figure 1: A plot.", "As Figure 1 and Fig. 2 show, and Table 3.", "Table 3. Sizes.", "See Section 4.1.")
    got = dc.citation_topology(rows).first()
    assert (got.found, got.resolved, got.resolution_rate) == (4, 2, 0.5)


def test_notes(spark):
    a = spark.createDataFrame([("c", "1", 5), ("c", "1", 9), ("c", "2", 7)], "chapter string, key string, place int")
    b = spark.createDataFrame([("c", "1", 50), ("d", "1", 60)], "chapter string, key string, place int")
    got = {(r.chapter, r.key, r.callout, r.definition, r.state) for r in dc.notes(a, b).collect()}
    assert got == {("c", "1", 5, 50, "paired"), ("c", "1", 9, None, "orphan_callout"), ("c", "2", 7, None, "orphan_callout"), ("d", "1", None, 60, "orphan_definition")}


def test_diff(spark):
    base, now = blocks(spark, "same", "a sentence of text", "gone entirely 123", "end"), blocks(spark, "same", "a sentence of tests", "end", "new", start="r")
    got = {(r.op, r.base_id, r.revised_id) for r in dc.diff_blocks(base, now).collect()}
    assert got == {("equal", "b0", "r0"), ("changed", "b1", "r1"), ("removed", "b2", None), ("equal", "b3", "r2"), ("added", None, "r3")}


def test_snapshots_and_tables(spark):
    rows = spark.createDataFrame([(1, k, f"b{k}", "c1" if k < 4 else "c2", "x" * 2000) for k in range(6)], "doc_id int, spine_index int, block_id string, chapter_id string, source_text string")
    assert [r.snapshot for r in dc.snapshots(rows).orderBy("spine_index").collect()] == [0, 0, 1, 1, 2, 2]
    tables = spark.createDataFrame([(1, 0, 1, 3, "h", None), (1, 1, 2, 3, "h", None), (1, 2, 3, 3, "x", "Table 1 continued"), (1, 3, 4, 2, "x", None)], "doc_id int, spine_index int, page int, n_columns int, header string, label string")
    assert [r.part_of for r in dc.stitched_tables(tables).orderBy("spine_index").collect()] == [0, 0, 0, 3]


def test_budgets():
    cost = len
    assert dc.text_in_budget("ab\n\ncdef", 4, cost) == "ab" and dc.text_in_budget("abcdefghij", 2, cost) == "abcdef"
    assert dc.table_in_budget("|h|\n|-|\n|long long|\n|x|", 12, cost) == "|h|\n|-|\n|x|"
