"""The queue data source: order, acknowledgement, and nothing lost or doubled when queries die between steps."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lawframe.sources import queue as Q


@pytest.fixture
def source(spark):
    Q.register(spark)
    return spark


def put(spark, path, low, high):
    spark.range(low, high).select(F.col("id").cast("string").alias("query_id"), F.concat(F.lit("é \n"), F.col("id")).alias("query_text")).coalesce(2).write.format(Q.NAME).option("path", path).mode("append").save()


def drain(spark, path, at, fail=None):
    stream = spark.readStream.format(Q.NAME).option("path", path).load().select(F.get_json_object("value", "$.query_id").cast("long").alias("id"), "segment")
    if fail:
        stream = stream.withColumn("id", F.when(F.col("id") == fail, F.raise_error(F.lit("killed"))).otherwise(F.col("id")))
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def ids(spark, at):
    return sorted(r["id"] for r in spark.read.parquet(f"{at}/out").collect())


def test_messages_are_taken_once_and_deleted(source, tmp_path):
    path, at = str(tmp_path / "queue"), str(tmp_path / "reader")
    put(source, path, 0, 20)
    first = Q.Folder(path).last()
    line = open(Q.Folder(path).segment(1), encoding="utf-8").readline()
    assert first == 2 and json.loads(line) == {"query_id": "0", "query_text": "é \n0"}
    drain(source, path, at)
    put(source, path, 20, 30)
    drain(source, path, at)
    assert ids(source, at) == list(range(30))
    assert Q.Folder(path).acked() >= first and not os.path.exists(Q.Folder(path).segment(1))
    drain(source, path, at)  # nothing new
    assert ids(source, at) == list(range(30)) and not os.listdir(f"{path}/parts")


def test_a_failing_batch_comes_again(source, tmp_path):
    path, at = str(tmp_path / "queue"), str(tmp_path / "reader")
    put(source, path, 0, 10)
    drain(source, path, at)
    put(source, path, 10, 20)
    with pytest.raises(Exception, match="killed"):
        drain(source, path, at, fail=15)
    assert ids(source, at) == list(range(10))  # nothing of the batch that died, and its segments are still there
    put(source, path, 20, 25)
    drain(source, path, at)  # the same batch first
    assert ids(source, at) == list(range(20))
    drain(source, path, at)
    assert ids(source, at) == list(range(25))


def test_a_reader_killed_before_its_commit(source, tmp_path):
    """The sink has the batch, the source was not told: the next run neither reads it anew nor leaves it behind."""
    path, at = str(tmp_path / "queue"), str(tmp_path / "reader")
    put(source, path, 0, 10)
    commit, Q.QueueReader.commit = Q.QueueReader.commit, lambda self, end: None
    try:
        drain(source, path, at)
    finally:
        Q.QueueReader.commit = commit
    put(source, path, 10, 12)
    drain(source, path, at)
    assert ids(source, at) == list(range(12))


def test_a_stream_writes_each_batch_once(source, tmp_path):
    taken, given, at = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "pipe")
    put(source, taken, 0, 10)

    def pipe():
        stream = source.readStream.format(Q.NAME).option("path", taken).load().select(F.get_json_object("value", "$.query_id").alias("query_id"))
        stream.writeStream.format(Q.NAME).option("path", given).option("writer", "pipe").option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()

    pipe()
    # the commit is forgotten, as if the query had died right after the sink's commit: the same batch comes again
    last = max(int(n) for n in os.listdir(f"{at}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{at}/commits/{name}"):
            os.unlink(f"{at}/commits/{name}")
    pipe()
    put(source, taken, 10, 15)
    pipe()
    pipe()
    drain(source, given, str(tmp_path / "reader"))
    assert ids(source, str(tmp_path / "reader")) == list(range(15))


def test_writers_that_meet_and_half_done_commits(tmp_path):
    folder = Q.Folder(str(tmp_path / "queue"))

    def part(text):
        name = f"{folder.path}/parts/{text}"
        open(name, "w").write(text)
        return name

    os.link(part("other"), folder.segment(1))  # another writer has just taken number 1
    last, folder.last = folder.last, lambda: 0
    assert folder.add(part("own")) == 2
    folder.last = last
    writer = Q.QueueStreamWriter(folder.path, "w")
    a, b = part("a"), part("b")
    folder.replace("commits/w-000000000000", json.dumps([a, b]))
    folder.add(a)  # died after the first of two
    writer.commit([Q.Part(part("c"), 1)], 0)
    assert [open(folder.segment(n)).read() for n in (2, 3, 4)] == ["own", "a", "b"]
    folder.acknowledge(3)
    assert folder.acked() == 3 and folder.last() == 4 and not os.path.exists(folder.segment(2))
