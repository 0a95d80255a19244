"""Ordered lines by byte ranges in batch and stream, and the log of runs under retries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skylattice.operators import losses, search
from skylattice.sources import lines, runs


def test_lines_keep_their_order_over_many_tasks(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"t": float(rng.randrange(40)), "x": float(i), "s": "ü" * rng.randrange(30)} for i in range(500)]
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    for size in (7, 100, 4096, 1 << 20):
        read = lines.read_lines(spark, str(path), range_bytes=size)
        assert [r.line for r in read.orderBy("place").collect()] == path.read_text().split("\n")
    assert read.rdd.getNumPartitions() == 1 and lines.read_lines(spark, str(path), range_bytes=1000).rdd.getNumPartitions() > 10
    got = lines.in_time_order(lines.parsed(lines.read_lines(spark, str(path), range_bytes=300), "t double, x double")).collect()
    assert [r.x for r in got] == [r["x"] for r in sorted(rows, key=lambda r: r["t"])]


def test_odd_files_and_broken_lines(spark, tmp_path):
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "_hidden").write_text("no")
    (tmp_path / "b.txt").write_bytes(b'{"t": 1.0}\r\n\n{"t": 2.0}\n{broken\n[3]\n{"t": "x"}\n\n')
    read = lines.read_lines(spark, str(tmp_path), range_bytes=9)
    assert [r.line for r in read.orderBy("path", "place").collect()] == ['{"t": 1.0}', "", '{"t": 2.0}', "{broken", "[3]", '{"t": "x"}', ""]
    assert [r.t for r in lines.in_time_order(lines.parsed(read, "t double", strict=False)).collect()] == [1.0, 2.0]
    with pytest.raises(Exception, match="not a measurement"):
        lines.parsed(read, "t double").collect()
    (tmp_path / "none").mkdir()
    assert lines.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_lines_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(lines.OrderedLines)

    def drain() -> set:
        stream = spark.readStream.format("ordered_lines").options(path=str(folder), range_bytes="5", files_per_batch="1").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        try:
            want = sum(len(p.read_text().split()) for p in folder.iterdir())
            for _ in range(120):
                q.processAllAvailable()
                got = spark.read.schema(lines.SCHEMA).parquet(str(tmp_path / "out")).select("line").collect()
                if len(got) >= want:
                    break
        finally:
            q.stop()
        assert len(got) == want
        return {r.line for r in got}

    (folder / "1").write_text("one\ntwo\nthree\n")
    (folder / "2").write_text("four\n")
    assert drain() == {"one", "two", "three", "four"}
    (folder / "3").write_text("five\nsix")  # a restart takes only what is new
    assert drain() == {"one", "two", "three", "four", "five", "six"}


def test_runs_survive_repeated_batches_and_failures(spark, tmp_path):
    log = runs.RunLog(spark, str(tmp_path / "runs"))
    assert log.runs().count() == 0
    rows = spark.createDataFrame([(1.0, 2), (3.0, 4)], "a double, b int")
    sink = log.sink("one", lambda df: df.agg(F.avg("a").alias("mean"), F.count("*").alias("n")))
    with log.run("one", {"gate": 5}, {"kind": "test"}):
        for batch in (0, 1, 1, 0):  # Spark repeats batches
            sink(rows, batch)
        log.keep("one", "rows", rows)
        log.keep("one", "rows", rows)
    with pytest.raises(ValueError, match="boom"), log.run("two"):
        raise ValueError("boom")
    got = {r.run_id: r for r in log.runs().collect()}
    assert (got["one"].status, got["one"].metrics, got["one"].params) == ("FINISHED", {"mean": 2.0, "n": 2.0}, {"gate": "5"})
    assert got["two"].status == "FAILED" and "boom" in got["two"].error and got["two"].metrics is None
    assert sorted((r.batch, r.value) for r in log.history("n").collect()) == [(0, 2.0), (1, 2.0)] and log.artifact("one", "rows").count() == 2
    with log.run("two"):  # started again
        assert {r.run_id: r.status for r in log.runs().collect()}["two"] in ("RUNNING", "FAILED")
    assert {r.run_id: r.status for r in log.runs().collect()}["two"] == "FINISHED"
    with pytest.raises(ValueError):
        log.mark("../up", "RUNNING")


def test_halving_is_reproducible(spark):
    matches = spark.createDataFrame([(f, 100.0 * (1 + f % 7)) for f in range(64)], "frame long, dist double")
    side = spark.createDataFrame([(f, i) for f in range(64) for i in range(2)], "frame long, id long")
    score = search.gate_scores(side, side, matches)
    rows = [tuple(r) for r in search.halving(score, [50.0, 250.0, 450.0, 650.0, 900.0], 3, spark).collect()]
    assert rows == [tuple(r) for r in search.halving(score, [900.0, 50.0, 650.0, 250.0, 450.0], 3, spark).collect()]
    assert [sum(r[0] == i for r in rows) for i in (1, 2, 3)] == [5, 3, 2] and [r[1] for r in rows if r[0] == 3 and r[4]] == [900.0]


def test_losses_of_extreme_logits_and_empty_sides(spark):
    df = spark.createDataFrame([(l, t) for l in (-1e4, -1.0, 0.0, 2.5, 1e4) for t in (0.0, 0.08, 1.0)], "l double, t double")
    for r in df.select("l", "t", losses.cross_entropy(F.col("l"), F.col("t")).alias("e"), losses.focal(F.col("l"), F.col("t")).alias("f")).collect():
        assert r.e >= 0 and r.f >= 0 and r.e < 2e4
    schema = "frame long, id long, x double, y double, z double, vx double, vy double, vz double"
    pred = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, None, 0.0, 0.0, 0.5), (2, 2, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, -0.5)], f"{schema}, logit double")
    truth = spark.createDataFrame([(1, 7, 0.5, 3.0, 0.0, 0.0, 0.0, 0.0), (3, 8, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], schema)
    got = {r.frame: r for r in losses.set_loss(pred, truth, spark.createDataFrame([(1, 1, 7)], "frame long, pred_id long, gt_id long")).collect()}
    assert got[1].regression == pytest.approx((0.125 + 2.5) / 6) and got[1].matched_logit == pytest.approx(12.25) and got[1].miss == 0
    assert (got[2].n_gt, got[2].false_alarm, got[2].cardinality) == (0, 0.0, 0.5) and (got[3].n_pred, got[3].miss, got[3].cardinality) == (0, 2.0, 0.5)
