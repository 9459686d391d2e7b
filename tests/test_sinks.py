"""Files of round trips that rotate, whose records are there once whatever fails; requests across batches; typed attributes."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wirelake.operators import decoders
from wirelake.sinks import rotating, writers


def lines(path):
    names = sorted(x for x in os.listdir(path) if x.startswith("roundtrips-"))
    return [[json.loads(x) for x in open(f"{path}/{n}", encoding="utf-8")] for n in names]


def test_batch_writes_rotate_and_append(spark, tmp_path):
    rotating.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(0, 500, 1, 4).select("id", F.struct(F.lit("GET").alias("method"), F.lit(None).cast("string").alias("path")).alias("request"), F.lit(b"\xc3\xa9").alias("raw"), F.array(F.lit(1.5)).alias("list"))
    df.write.format("roundtrips").mode("append").option("path", path).option("max_bytes", 2000).save()
    files = lines(path)
    assert len(files) > 10 and all(len(f) < 40 for f in files)
    assert sorted(r["id"] for f in files for r in f) == [*range(500)]
    assert files[0][0] == {"id": 0, "request": {"method": "GET"}, "raw": "é", "list": [1.5]}
    df.write.format("roundtrips").mode("append").option("path", path).save()
    assert sorted(r["id"] for f in lines(path) for r in f) == sorted([*range(500)] * 2)
    df.limit(3).write.format("roundtrips").mode("overwrite").option("path", path).save()
    assert sorted(r["id"] for f in lines(path) for r in f) == [0, 1, 2]
    df.limit(0).write.format("roundtrips").mode("append").option("path", path).save()
    assert len(lines(path)) == 1 and os.listdir(f"{path}/_staging") == []


def test_failed_and_repeated_attempts_leave_each_record_once(tmp_path):
    writer = rotating.BatchWriter({"path": str(tmp_path)}, False)
    rows = [Row(id=k) for k in range(10)]

    def broken():
        yield from rows[:6]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    first, again = writer.write(iter(rows)), writer.write(iter(rows))
    assert first.files != again.files and lines(tmp_path) == []
    writer.commit([again, None])
    assert [r["id"] for f in lines(tmp_path) for r in f] == [*range(10)]
    aborted = rotating.BatchWriter({"path": str(tmp_path)}, False)
    aborted.abort([aborted.write(iter(rows))])
    assert [r["id"] for f in lines(tmp_path) for r in f] == [*range(10)] and os.listdir(tmp_path / "_staging") == []


def test_micro_batches_that_run_again(tmp_path):
    make = lambda: rotating.StreamWriter({"path": str(tmp_path)})
    one = make()
    one.commit([one.write(iter([Row(id=1)])), one.write(iter([Row(id=2)]))], 7)
    again = make()
    again.commit([again.write(iter([Row(id=1), Row(id=2)]))], 7)
    assert [r["id"] for f in lines(tmp_path) for r in f] == [1, 2]
    # The driver was lost after it had moved a file and before the batch was marked.
    half = make()
    half.publish([half.write(iter([Row(id=3)]))], f"{8:020d}")
    last = make()
    last.commit([last.write(iter([Row(id=3), Row(id=4)]))], 8)
    assert [r["id"] for f in lines(tmp_path) for r in f] == [1, 2, 3, 4]


def test_oldest_files_go(tmp_path):
    for k in range(6):
        w = rotating.StreamWriter({"path": str(tmp_path), "max_files": "4", "max_bytes": "1"})
        w.commit([w.write(iter([Row(id=2 * k), Row(id=2 * k + 1)]))], k)
    assert [r["id"] for f in lines(tmp_path) for r in f] == [8, 9, 10, 11]


def test_stream_into_files(spark, tmp_path):
    rotating.register(spark)
    for k in range(3):
        spark.range(k * 10, k * 10 + 10, 1, 2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        q = stream.writeStream.format("roundtrips").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(r["id"] for f in lines(tmp_path / "out") for r in f) == [*range(30)]
    assert len(os.listdir(tmp_path / "out/_commits")) == 3


def test_requests_go_across_batches():
    batches = [pd.DataFrame({"k": range(a, a + 7)}) for a in range(0, 35, 7)]
    assert [len(g) for g in writers._grouped(iter(batches), 10, 60)] == [10, 10, 10, 5]
    assert [r["k"] for g in writers._grouped(iter(batches), 10, 60) for r in g] == [*range(35)]
    assert [len(g) for g in writers._grouped(iter(batches), 10, 0)] == [1] * 35


def test_attributes_have_types():
    body = json.loads(writers.trace_request([{"trace_id": "1", "span_id": "2", "name": "n", "start_ns": 1, "end_ns": 2, "attributes": {"http.request.size": "12", "server.port": "80", "url.full": "/1", "http.request.header.accept": '["a","b"]', "error.code": "x"}}], "s"))
    own = {a["key"]: a["value"] for a in body["resourceSpans"][0]["scopeSpans"][0]["spans"][0]["attributes"]}
    assert own["http.request.size"] == {"intValue": "12"} and own["server.port"] == {"intValue": "80"} and own["url.full"] == {"stringValue": "/1"} and own["error.code"] == {"stringValue": "x"}
    assert own["http.request.header.accept"] == {"arrayValue": {"values": [{"stringValue": "a"}, {"stringValue": "b"}]}}


def test_postgresql_sessions(spark):
    def message(kind, body):
        return bytearray(kind + (len(body) + 4).to_bytes(4, "big") + body)

    parse = lambda n, q: message(b"P", n + b"\0" + q + b"\0\0\0")
    bind = lambda p, n: message(b"B", p + b"\0" + n + b"\0" + b"\0" * 6)
    execute = lambda p: message(b"E", p + b"\0\0\0\0\0")
    close = lambda k, n: message(b"C", k + n + b"\0")
    said = [parse(b"", b"one"), bind(b"", b""), execute(b""), parse(b"a", b"two"), bind(b"p", b"a"), execute(b"p"), execute(b""), close(b"P", b"p"), execute(b"p"), close(b"S", b"a"), bind(b"", b"a"), execute(b"")]
    want = ["one", "one", "one", "two", "two", "two", "one", None, None, None, None, None]
    said += [parse(b"%d" % k, b"q%d" % k) for k in range(20)] + [bind(b"", b"%d" % k) for k in range(20)]
    want += [f"q{k}" for k in range(20)] + [None] * 4 + [f"q{k}" for k in range(4, 20)]
    # Given anew, a name is the youngest.
    said += [parse(b"4", b"new"), parse(b"x", b"x"), bind(b"", b"4"), bind(b"", b"5")]
    want += ["new", "x", "new", None]
    rows = [(c, "Request", m, len(m), k) for c in (1, 2) for k, m in enumerate(said)]
    df = spark.createDataFrame(rows, "conn long, role string, message binary, size long, first_ns long").repartition(3)
    got = decoders.postgresql_statements(df).orderBy("conn", "first_ns").collect()
    assert [r["statement"] for r in got] == want * 2
