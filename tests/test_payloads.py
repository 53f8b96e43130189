"""Landed payload folders as a data source, in batches and as a stream."""

import json

import pytest
from pyspark.sql import functions as F

from tidewell.scratch import new_folder
from tidewell.sources import connectors, payloads


@pytest.fixture(autouse=True)
def known(spark):
    payloads.register(spark)


def land(folder, run, files, done=True):
    (folder / run).mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / run / name).write_text(text, encoding="utf-8")
    if done:
        (folder / run / "_SUCCESS").touch()


def read(spark, folder, **options):
    return spark.read.format(payloads.FORMAT).option("path", str(folder)).options(**options).load()


def jobs(*ids):
    return json.dumps({"jobs": [{"id": i, "title": f"T{i}é", "absolute_url": "u"} for i in ids]})


def test_files_of_complete_runs(spark, tmp_path):
    land(tmp_path, "run=1", {"b.json": jobs(1, 2), "a.json": jobs(3), ".hidden": "x", "_x": "y", "c.html": ""})
    land(tmp_path, "run=2", {"a.json": jobs(3, 4)})
    land(tmp_path, "run=3", {"a.json": jobs(5)}, done=False)
    rows = read(spark, tmp_path, labels='{"a": "Acme"}').orderBy("ord").collect()
    assert [(r.run, r.token, r.label) for r in rows] == [("run=1", "a", "Acme"), ("run=1", "b", "b"), ("run=1", "c", "c"), ("run=2", "a", "Acme")] and rows[2].payload == ""
    assert len({r.ord for r in rows}) == 4
    found = connectors.read_payloads(read(spark, tmp_path), connectors.source_by_id("greenhouse")).collect()
    assert sorted(r.sourceJobId for r in found) == ["a:3", "a:4", "b:1", "b:2"] and {r.title for r in found} == {f"T{i}é" for i in range(1, 5)}
    assert [r.run for r in read(spark, tmp_path, **{"from": "run=2", "to": "run=2"}).collect()] == ["run=2"]
    assert read(spark, tmp_path / "none").count() == 0


def test_rows_that_spark_has_landed(spark):
    folder = new_folder(spark, "test-landing")
    sent = [("t1", "Label", "line\nbreak \"q\" 日本"), (None, None, "{}"), ("t2", "L", None)] * 300
    spark.createDataFrame(sent, "token string, label string, payload string").repartition(3).write.option("ignoreNullFields", "false").json(f"{folder}/run=7")
    rows = read(spark, folder, form="rows")
    got = rows.select("token", "label", "payload").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, sent)) and rows.select("ord").distinct().count() == 900


def test_tasks_get_several_files(spark, tmp_path, monkeypatch):
    land(tmp_path, "run=1", {f"{k}.json": "x" * 100 for k in range(10)})
    monkeypatch.setattr(payloads, "FILE_BYTES", 350)
    parts = payloads.Landing({"path": str(tmp_path)}).partitions(["run=1"])
    assert [len(p.files) for p in parts] == [3, 3, 3, 1]


def test_stream_reads_each_run_once(spark, tmp_path):
    landing, out, at = tmp_path / "landing", str(tmp_path / "out"), str(tmp_path / "at")

    def turn():
        stream = spark.readStream.format(payloads.FORMAT).option("path", str(landing)).load()
        stream.select("run", "token", F.length("payload").alias("n")).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.run, r.token) for r in spark.read.schema("run string, token string, n int").parquet(out).collect())

    land(landing, "run=1", {"a.json": "{}"})
    land(landing, "run=2", {"b.json": "{}"}, done=False)
    assert turn() == [("run=1", "a")]
    land(landing, "run=2", {"c.json": "{}"})
    assert turn() == [("run=1", "a"), ("run=2", "b"), ("run=2", "c")] == turn()
