import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlcore.sources import files, generators, sinks
from marlcore.streaming import traces


def test_features(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b,name,cls\n" + "".join(f"{i},{'' if i == 3 else i * 2},n{i},{'xyz'[i % 3]}\n" for i in range(30)))
    rows = files.read_features(spark, str(p)).orderBy("f").collect()
    assert {r.y for r in rows} == {0, 1, 2} and len(rows[0].f) == 2
    mean = sum(i * 2 for i in range(30) if i != 3) / 29
    assert [r.f[1] for r in rows if r.f[0] == 3] == [mean]
    with pytest.raises(ValueError):
        files.read_features(spark, "x.txt")
    assert files.read_metadata(spark, str(tmp_path / "none.json")) == {}


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "x.npz", features=np.arange(6.0).reshape(3, 2), labels=np.array([0, 1, 1]))
    assert [tuple(r) for r in files.read_arrays(spark, str(tmp_path / "x.npz")).orderBy("id").collect()] == [(0, [0.0, 1.0], 0), (1, [2.0, 3.0], 1), (2, [4.0, 5.0], 1)]


def test_expression_is_turned(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("gene\tS1\tS2\nG1\t1\t2\nG2\t3\tx\n")
    (tmp_path / "p.tsv").write_text("id\tgrp\nS1\ta\nS3\tb\n")
    expr, pheno = files.read_expression(spark, str(tmp_path / "e.tsv"), str(tmp_path / "p.tsv"))
    assert sorted(map(tuple, expr.collect())) == [("S1", "G1", 1.0), ("S1", "G2", 3.0)] and pheno.count() == 1
    (tmp_path / "c.tsv").write_text("#a\n#b\nPID\tSUB\np1\tLumA\n")
    assert files.read_after_lines(spark, str(tmp_path / "c.tsv"), 2).collect()[0].asDict() == {"PID": "p1", "SUB": "LumA"}


def test_documents_and_trace(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "a.txt").write_text("x" * 1300)
    (d / "b.txt").write_text("y")
    got = files.read_new_documents(spark, str(d), spark.createDataFrame([("b.txt",)], "source string")).orderBy("chunk_no").collect()
    assert [(r.source, r.chunk_no, len(r.chunk)) for r in got] == [("a.txt", 0, 800), ("a.txt", 1, 700), ("a.txt", 2, 100)]
    t = tmp_path / "trace"
    t.mkdir()
    (t / "1.json").write_text(json.dumps({"caller": "a", "cost_usd": 0.5, "is_retry": True}) + "\n{broken\n" + json.dumps({"caller": "a", "cost_usd": 0.25}) + "\n")
    assert files.read_trace(spark, str(t)).count() == 2
    s = traces.running_costs(traces.trace_stream(spark, str(t)).filter("caller is not null"))
    q = s.writeStream.outputMode("complete").format("memory").queryName("costs").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select * from costs").collect()] == [("a", 2, 1, 0.75)]


@pytest.mark.parametrize("name", generators.DATASETS)
def test_generators(spark, name):
    rows = generators.generate(spark, name, 60).collect()
    assert len(rows) == 60 and rows == generators.generate(spark, name, 60).collect()
    with pytest.raises(ValueError):
        generators.generate(spark, "no")


def test_cohort(spark):
    long, pheno = generators.cohort(spark, 20, 30)
    assert long.count() == 600 and pheno.count() == 20


def test_sinks(spark, tmp_path):
    p = spark.createDataFrame([(1, 0), (0, 1)], "id bigint, label bigint")
    sinks.write_labels(p, str(tmp_path / "l"))
    assert spark.read.csv(str(tmp_path / "l"), header=True).count() == 2
    sinks.write_report(spark.createDataFrame([(float("nan"), 1)], "a double, b int"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()[0] == '{"a":null,"b":1}'
    old = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, t int, v int")
    new = spark.createDataFrame([("a", 3, 11), ("c", 0, 5)], "k string, t int, v int")
    assert [tuple(r) for r in sinks.upsert(old, new, "k", "t", 2).collect()] == [("a", 3, 11), ("b", 2, 20)]
    tex = sinks.latex_report(spark.createDataFrame([(1, "K_Means", 0.5, None)], "rank int, algorithm string, ari double, nmi double"), "50 %")
    assert r"K\_Means & 0.500 & n/a" in tex and r"50 \%" in tex
    heavy = spark.createDataFrame([(1, ([1], "a"))], "id int, m struct<labels: array<int>, name: string>")
    assert sinks.strip_heavy(heavy).first().asDict(True) == {"id": 1, "m": {"name": "a"}}


def test_streams(spark, sf, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(str(src))
    e = traces.event_stream(spark, str(src))
    traces.drain(traces.tumbling(e, "1 day"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "o1"))
    batch = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).count()
    assert 0 < got.count() <= batch.count()
    assert got.join(batch.select("event_type", F.col("w.start").alias("start"), "count"), ["event_type", "start"]).filter("n <> count").count() == 0
    traces.drain(traces.sessions(traces.event_stream(spark, str(src))), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "o2")).count() > 0
    traces.drain(traces.once(traces.event_stream(spark, str(src))), str(tmp_path / "o3"), str(tmp_path / "c3"))
    assert spark.read.parquet(str(tmp_path / "o3")).count() == 1000
