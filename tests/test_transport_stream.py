"""A capture replayed in one, some and many micro-batches gives the rows of the batch plan."""

import pickle
import random

import pytest
from pyspark.sql import functions as F

from tests.test_assembly import h2
from wirelake.operators import framing, http2, l4
from wirelake.streaming import transport

TOP = 2**32 - 1


def literal(name, value):
    return b"\x40" + bytes([len(name)]) + name + bytes([len(value)]) + value


def segments():
    """(conn, role, proto, seq, payload, fin, capture_ns) in order of time: pipelined HTTP and HTTP/2 whose tables carry over, cut anywhere, with repeats, wraps and connections that
    go on after their end."""
    rng = random.Random(6)
    out, now = [], 0
    for conn in range(12):
        sides = {"Request": b"", "Response": b""}
        if conn % 2:
            for k in range(25):
                sides["Request"] += h2(1, 5, 2 * k + 1, (literal(b"x-id", b"v%d" % conn) if not k else b"") + b"\x82\x87\x84\xbe")
                sides["Response"] += h2(1, 4, 2 * k + 1, b"\x88" + (literal(b"x-a", b"b") if not k else b"\xbe")) + h2(0, 1, 2 * k + 1, b"body" * (k % 5))
        else:
            for k in range(25):
                sides["Request"] += b"HEAD /%d HTTP/1.1\r\n\r\n" % k if k % 3 == 0 else b"GET /%d HTTP/1.1\r\n\r\n" % k
                sides["Response"] += b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % k + (b"" if k % 3 == 0 else b"x" * k)
        at, start = {"Request": 0, "Response": 0}, {r: rng.choice([0, 1000, TOP - 300]) for r in sides}
        while any(at[r] < len(sides[r]) for r in sides):
            role = "Request" if at["Request"] < len(sides["Request"]) and rng.random() < 0.6 else "Response"
            if at[role] >= len(sides[role]):
                role = "Request" if role == "Response" else "Response"
            n = rng.randrange(1, 60)
            back = rng.choice([0, 0, 0, min(20, at[role])])
            payload = sides[role][at[role] - back : at[role] + n]
            seq = (start[role] + at[role] - back) % TOP
            now += 1000
            if seq < TOP <= seq + len(payload):
                payload = payload[: TOP - seq]  # a segment ends where numbers start again
            out.append((conn, role, ("http", "http2")[conn % 2], seq, payload, False, now))
            if rng.random() < 0.2:
                now += 1
                out.append((*out[-1][:6], now))
            at[role] = max(at[role], at[role] - back + len(payload))
        if conn % 3 == 0:
            head = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"
            now += 1000
            out.append((conn, "Response", ("http", "http2")[conn % 2], 9, b"", True, now))
            out.append((conn, "Response", "http", 10, b"late", False, now + 1))
            out.append((conn, "Response", "http", 10, head, False, now + 2))
            now += 2
    return sorted(out, key=lambda r: r[6])


SCHEMA = "conn long, role string, proto string, seq long, payload binary, fin boolean, capture_ns long"
HTTP, H2 = ["conn", "epoch", "role", "message", "size", "first_ns", "last_ns", "exchange", "ending"], ["conn", "epoch", "role", "key", "ending", "size", "first_ns", "last_ns", "fields"]


def plain(rows):
    return sorted(str([bytes(v) if isinstance(v, bytearray) else sorted(v.items()) if isinstance(v, dict) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def batch(spark):
    df = spark.createDataFrame(segments(), SCHEMA).withColumn("len", F.octet_length("payload"))
    epochs = l4.closing_epochs(df, ["conn"], "role", ["capture_ns"]).where("NOT refused")
    new = framing.deliver(l4.cursor(epochs, ["conn", "epoch", "role"], ["capture_ns"]), ends=True)
    http = framing.exchanges(new.where("proto = 'http'"), ["conn", "epoch"], ["capture_ns"])
    streams = http2.streams(new.where("proto = 'http2'"), ["conn", "epoch", "role"], ["capture_ns"])
    return plain(http.select(*HTTP).collect()), plain(streams.select(*H2).collect())


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_states_between_micro_batches_equal_batch(batch, parts):
    """The state alone: each micro-batch starts from what the one before has written."""
    rows, held, got = segments(), {}, ([], [])
    for k in range(parts):
        now = {conn: pickle.loads(x) for conn, x in held.items()}
        for conn, role, proto, seq, payload, fin, ns in rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]:
            for m in now.setdefault(conn, transport.Connection()).feed(role, proto, seq, payload, fin, ns):
                r = dict(zip(["conn", *(x.split()[0] for x in transport.COLUMNS.split(", "))], (conn, *m)))
                got[m[2] == "http2"].append([r[c] for c in (H2 if m[2] == "http2" else HTTP)])
        held = {conn: pickle.dumps(x) for conn, x in now.items()}
    assert plain(got[0]) == batch[0] and plain(got[1]) == batch[1]
    assert len(batch[0]) > 250 and len(batch[1]) >= 290


def test_replay_in_spark_equals_batch(spark, tmp_path, batch):
    rows, parts = segments(), 3
    for k in range(parts):
        own = rows[len(rows) * k // parts : len(rows) * (k + 1) // parts]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = transport.messages(stream, "conn", ["capture_ns"], None).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    got = spark.table("replayed")
    assert plain(got.where("proto = 'http'").select(*HTTP).collect()) == batch[0]
    assert plain(got.where("proto = 'http2'").select(*H2).collect()) == batch[1]
