"""Rules against brute force, and the cases that queries over the tables do not reach."""

import random

from pyspark.sql import functions as F

from quire.functions import defects, marks, names, passages, protection
from quire.operators import ledger, memory, order


def test_page_samples(spark):
    def sample(total, flagged, most):
        if total <= 0 or most <= 0:
            return []
        chosen = sorted({p for p in flagged if 1 <= p <= total})[:most]
        for p in (1, 2, total) if total > 100 else ():
            if len(chosen) < most and p not in chosen:
                chosen.append(p)
        step = max(1, total // max(most - len(chosen) + 1, 1))
        for p in [*range(1, total + 1, step), *range(total, 0, -1)]:
            if len(chosen) < most and p not in chosen:
                chosen.append(p)
        return sorted(chosen)

    rng = random.Random(1)
    rows = [(k, rng.choice([0, 1, 5, 99, 101, 400]), [rng.randint(-3, 500) for _ in range(rng.randint(0, 6))], rng.randint(0, 9)) for k in range(120)]
    frame = spark.createDataFrame(rows, "k int, total int, flagged array<int>, most int")
    got = {r.k: list(r.p) for r in frame.select("k", names.sample_pages(F.col("total"), F.col("flagged"), F.col("most")).alias("p")).collect()}
    assert got == {k: sample(t, f, m) for k, t, f, m in rows}


def test_protection():
    text = 'Use `net` in <b net> at http://net.org/net and "net" or $net_1$ but net costs $5 and $6 net'
    inside = [text[a:b] for a, b in protection.protected(text)]
    assert inside == ["`net`", "<b net>", "http://net.org/net", '"net"', "$net_1$"]
    assert [text[a - 4 : b + 6] for a, b in protection.occurrences(text, "net", protection.protected(text))] == ["but net costs", " $6 net"]
    out, applied = protection.enforce("CPU调度 and CPU 调度; net nets NET", [("CPU调度", "处理器调度"), ("net", "network")])
    assert out == "处理器调度 and 处理器调度; network nets network" and len(applied) == 4
    assert protection.enforce(out, [("CPU调度", "处理器调度"), ("net", "network")]) == (out, [])
    assert protection.enforce("", []) == ("", []) and protection.occurrences("x", " ", []) == []


def test_nulls_and_empty_values(spark):
    row = spark.createDataFrame([(None, None, None)], "t string, f array<string>, n int")
    t, f, n = (F.col(c) for c in "tfn")
    got = row.select(
        names.list_marker(t), names.contains_cjk(t), names.lang_base(t).alias("l"), defects.declared_severity(f), defects.format_only(f).alias("o"), defects.defect_class(f, n.cast("double"), 0.5).alias("c"),
        defects.shippable(n.cast("double"), f, 0.5).alias("s"), marks.judge_score(t), marks.runs_of(t).alias("r"), marks.boxes_of(t).alias("b"), passages.sentences(t).alias("x"), names.backmatter_kind(t), names.epigraph(t),
    ).first()
    assert [got[k] for k in (0, 1, 2, 3)] == [None, False, "", None] and (got.o, got.c, got.s, got.r, got.b, got.x) == (False, "PASS", False, [], [], [])
    assert got[7] is None and got[11] is None and got[12] is None


def test_who_may_answer(spark):
    rows = [(p, rc, rd, c, d) for p in ("human_pe", "machine") for rc in ("", "a", None) for rd in (None, "law") for c in ("", "a", "b") for d in (None, "law", "")]
    frame = spark.createDataFrame(rows, "p string, rc string, rd string, c string, d string").withColumn("ok", memory.may_answer(*[F.col(x) for x in ("p", "rc", "rd", "c", "d")]))
    for r in frame.collect():
        assert r.ok == (r.p == "human_pe" or (r.rc or "") == r.c or not r.rc or bool(r.d and r.rd and r.d == r.rd))


def test_empty_tables(spark):
    lines = spark.createDataFrame([], "doc_id long, spine_index int, source_text string, block_id string")
    assert order.clean_lines(lines).count() == 0 and order.page_number_lines(lines).count() == 0
    jobs = spark.createDataFrame([], "job_id long, tenant_id long, priority int, status string, attempts int, max_attempts int, enqueued_at double")
    news = spark.createDataFrame([(1, 1, 5, 2.0), (2, 1, 5, 1.0), (2, 1, 6, 3.0)], "job_id long, tenant_id long, priority int, at double")
    assert [(r.job_id, r.priority) for r in ledger.enqueue(jobs, news, 9.0, 1).collect()] == [(2, 5)]
    hits = spark.createDataFrame([], "block_id long, source string, expected string, exact boolean")
    assert ledger.consistency_tasks(hits, 5).count() == 0 and ledger.list_jobs(jobs, 3).count() == 0
