import json

from scenemill.streaming import logs


def run(query):
    query.processAllAvailable()
    query.stop()


def test_log_is_followed_and_resumed(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text('{"token": "a", "n": 1}\n{"token": "b", "n": 2}\n{"tok')
    stream = lambda: logs.follow_log(spark, str(source), "token string, n int", "token")
    sink = lambda: stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    sink().awaitTermination()
    (source / "b.json").write_text('{"token": "b", "n": 2}\n{"token": "c", "n": 3}\n')
    sink().awaitTermination()
    assert sorted(r.token for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_consecutive_failures(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [("x", True, False)] * 3 + [("x", True, True)] + [("x", True, False)] * 2 + [("y", True, False)] * 4 + [("y", False, False), ("y", True, False)]
    (source / "a.json").write_text("\n".join(json.dumps({"key": k, "failed": f, "error": e}) for k, f, e in rows))
    stream = spark.readStream.schema("key string, failed boolean, error boolean").json(str(source))
    run(logs.consecutive_failures(stream, "key", "failed", "error").writeStream.outputMode("update").format("memory").queryName("failures").start())
    got = {r.key: (r.run, r.stopped) for r in spark.table("failures").collect()}
    assert got == {"x": (5, True), "y": (1, False)}


def test_online_hysteresis(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    values = [0, 1, 5, 1, 0, 1, 1, 0, -6, 0]
    (source / "a.json").write_text("\n".join(json.dumps({"key": "s", "t": float(i), "x": float(v)}) for i, v in enumerate(values)))
    stream = spark.readStream.schema("key string, t double, x double").json(str(source))
    run(logs.online_hysteresis(stream, "key", "t", "x", 4.0, 0.5).writeStream.outputMode("append").format("memory").queryName("online").start())
    assert sorted((r.start, r.end, r.peak) for r in spark.table("online").collect()) == [(1.0, 3.0, 5.0), (8.0, 8.0, -6.0)]
