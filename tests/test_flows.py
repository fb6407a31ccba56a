"""Streams: flushing with retries, abbreviations in versions, name counts, changes of state, and the writer's lease."""

import pytest

from quire.streaming import flows


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(str(path))
    return flows.stream_of(spark, str(path), schema)


def test_flush_tries_again(spark, tmp_path):
    seen, fails = [], [2]

    def write(batch, n):
        if fails[0]:
            fails[0] -= 1
            raise OSError("busy")
        seen.append(sorted(r.a for r in batch.collect()))

    rows = stream(spark, tmp_path / "in", [(1,), (2,)], "a int")
    flows.flushed(rows, write, str(tmp_path / "c"), pause=0.01).awaitTermination(60)
    assert seen == [[1, 2]]
    fails[0] = 9
    stream(spark, tmp_path / "in", [(3,)], "a int")
    with pytest.raises(Exception, match="busy"):
        flows.flushed(rows, write, str(tmp_path / "c"), pause=0.01).awaitTermination(60)


def test_abbreviations_keep_the_first(spark, tmp_path):
    schema = "doc_id long, spine_index int, source_text string"
    blocks = stream(spark, tmp_path / "in", [(1, 0, "Use Long Short Term Memory (LSTM) here")], schema)
    run = lambda: flows.abbreviation_stream(blocks, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(60)
    run()
    stream(spark, tmp_path / "in", [(2, 0, "A Large Scale Tree Model (LSTM) and Natural Language (NL)")], schema)
    run()
    got = {r.acronym: r.expansion for r in spark.read.parquet(str(tmp_path / "t" / "version=1")).collect()}
    assert got["LSTM"] == "Long Short Term Memory" and got["NL"] == "Natural Language"


def test_names_and_changes(spark, tmp_path):
    blocks = stream(spark, tmp_path / "b", [("then Alice met, Bob and Alice",), (None,), ("",)], "source_text string")
    q = flows.name_counts(blocks).writeStream.format("memory").queryName("names").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.name: r.n for r in spark.table("names").collect()} == {"Alice": 2, "Bob": 1}
    rows = [("j", "running", 10.0, 0), ("j", "running", 10.0, 1), ("j", "running", 20.0, 2), ("k", "running", 10.0, 2)]
    spark.createDataFrame(rows, "job_id string, status string, percent double, s int").selectExpr("job_id", "status", "percent", "timestamp_seconds(s) AS ts").write.parquet(str(tmp_path / "s"))
    q = flows.changes(flows.stream_of(spark, str(tmp_path / "s"), "job_id string, status string, percent double, ts timestamp")).writeStream.format("memory").queryName("moves").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.job_id, r.percent) for r in spark.table("moves").collect()) == [("j", 10.0), ("j", 20.0), ("k", 10.0)]


def test_lease(spark, tmp_path):
    a, b = (flows.WriterLease(spark, str(tmp_path / "lease"), 10) for _ in range(2))
    assert a.acquire(0.0) and not b.acquire(5.0) and a.acquire(9.0) and a.holder(12.0) == a.owner
    assert not b.acquire(18.0) and b.acquire(20.0) and not a.acquire(21.0)
    b.release(22.0)
    assert a.holder(22.0) is None and a.acquire(23.0)
