"""Capture files, framing, sinks, configuration and streams."""

import json
import os
import struct
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wirelake.operators.framing import Buffer
from wirelake.plans import config
from wirelake.sinks import writers
from wirelake.sources import pcap


def ip4(proto, body, src=(10, 0, 0, 1), dst=(10, 0, 0, 2)):
    return struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, *src, *dst) + body


def tcp(sport, dport, seq, data, fin=0):
    return struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, fin | 0x10, 0, 0, 0) + data


def capture(frames, order="<", ns=False, link=1):
    magic = 0xA1B23C4D if ns else 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    return out + b"".join(struct.pack(order + "IIII", 5, 7, len(f), len(f)) + f for f in frames)


def test_pcap_source(spark, tmp_path):
    eth = b"\0" * 12
    v6 = struct.pack(">IHBB", 6 << 28, 8 + 3, 17, 64) + bytes.fromhex("20010db8" + "00" * 11 + "01") + bytes.fromhex("fe80" + "00" * 6 + "0001000200030004")
    frames = [eth + b"\x08\x00" + ip4(6, tcp(4000, 80, 77, b"GET", 1)) + b"\0\0", eth + b"\x86\xdd" + v6 + struct.pack(">HHHH", 53, 5000, 11, 0) + b"abc", eth + b"\x81\x00\0\1\x08\x00" + ip4(6, tcp(80, 4000, 1, b"")), eth + b"\x08\x06" + b"\0" * 28]
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    (tmp_path / "b.pcap").write_bytes(capture(frames[:1], ">", True) + b"\0\0\0")
    pcap.register(spark)
    rows = pcap.decode(spark.read.format("pcap").load(str(tmp_path))).orderBy("file", "packet_no").collect()
    assert len(rows) == 4
    a = rows[0]
    assert (a.l4, a.src_ip, a.dst_ip, a.src_port, a.dst_port, a.seq, a.fin, bytes(a.payload), a.capture_ns) == ("tcp", "10.0.0.1", "10.0.0.2", 4000, 80, 77, True, b"GET", 5_000_007_000)
    b = rows[1]
    assert (b.l4, b.src_ip, b.dst_ip, bytes(b.payload), b.ip_version) == ("udp", "2001:db8::1", "fe80::1:2:3:4", b"abc", 6)
    assert rows[2].len == 0 and rows[2].src_port == 80
    assert rows[3].capture_ns == 5_000_000_007


MESSAGES = {
    "redis": [b"*2\r\n$3\r\nGET\r\n$1\r\nk\r\n", b"$-1\r\n", b"+OK\r\n", b"*1\r\n*1\r\n:5\r\n"],
    "http": [b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"],
    "mysql": [b"\x03\0\0\0abc", b"\x01\0\0\1\0"],
    "postgresql": [b"\0\0\0\x08\x04\xd2\x16\x2f", b"Q\0\0\0\x06a\0"],
    "kafka": [b"\0\0\0\x02ab"],
    "mongodb": [b"\x12\0\0\0" + b"x" * 14],
    "amqp": [b"AMQP\0\0\x09\x01", b"\x01\0\1\0\0\0\4abcd\xce"],
    "http2": [b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n", b"\0\0\2\0\1\0\0\0\1hi"],
}


@pytest.mark.parametrize("proto", sorted(MESSAGES))
@pytest.mark.parametrize("step", [1, 2, 5, 1000])
def test_framing_does_not_depend_on_segments(proto, step):
    data = b"".join(MESSAGES[proto])
    b = Buffer()
    got = [m for at in range(0, len(data), step) for m in b.feed(proto, data[at : at + step], at)]
    assert [m[0] for m in got] == [m.replace(b"3\r\nabc\r\n0\r\n\r\n", b"abc") for m in MESSAGES[proto]]  # what chunks hold
    assert all(first <= last for _, _, first, last in got) and not b.data


def test_foreign_bytes_are_dropped():
    b = Buffer()
    assert list(b.feed("redis", b"hello\r\n", 1)) == []
    assert [m[0] for m in b.feed("redis", b"+OK\r\n", 2)] == [b"+OK\r\n"]


@pytest.mark.parametrize("size", [80_001, 150_000, 17 << 20])
@pytest.mark.parametrize("chunked", [False, True])
def test_long_http_bodies(spark, size, chunked):
    from wirelake.operators import decoders

    body = "é".encode() * (size // 2) + b"z" * (size % 2)
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (body[k : k + 30_000] for k in range(0, size, 30_000))) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + (b"Transfer-Encoding: chunked" if chunked else b"Content-Length: %d" % size) + b"\r\n\r\n"
    message, after = head + (chunks if chunked else body), MESSAGES["http"][1]
    b = Buffer()
    got = []
    for at in range(0, len(message + after), 60_000):
        got.extend(b.feed("http", (message + after)[at : at + 60_000], at))
        assert len(b.data) + len(b.kept) < 250_000
    assert [m[1] for m in got] == [len(head) + size, len(after)] and got[1][0] == after
    assert got[0][0] == (head + body)[: len(head) + 102_400]
    rows = spark.createDataFrame([(bytearray(got[0][0]), got[0][1])], "message binary, size bigint")
    r = decoders.http(rows).select("status", "body_bytes", "body").first()
    assert (r["status"], r["body_bytes"], r["body"]) == ("200", size, body[:102_400].decode())


def test_chunks_with_trailers_and_small_segments():
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"
    data = head + b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\nA: b\r\n\r\n" + head + b"0\r\n\r\n"
    for step in (1, 3, 1000):
        b = Buffer()
        got = [m for at in range(0, len(data), step) for m in b.feed("http", data[at : at + step], at)]
        assert [m[:2] for m in got] == [(head + b"abcde", len(head) + 5), (head, len(head))]


def test_long_redis_values_are_read_once():
    value = b"v" * (20 << 20)
    message = b"*3\r\n$3\r\nSET\r\n$1\r\nk\r\n$%d\r\n%s\r\n" % (len(value), value)
    b, got = Buffer(), []
    for at in range(0, len(message) + 5, 60_000):
        got.extend(b.feed("redis", (message + b"+OK\r\n")[at : at + 60_000], at))
        assert len(b.data) + len(b.kept) < 250_000
    assert [(m[0], m[1]) for m in got] == [(message[:65_536], len(message)), (b"+OK\r\n", 5)]


def test_largest_mysql_packet():
    b = Buffer()
    message = b"\xff\xff\xff\0" + b"x" * 0xFFFFFF
    got = [m[1] for at in range(0, len(message), 1 << 20) for m in b.feed("mysql", message[at : at + (1 << 20)], at)]
    assert got == [len(message)]


@pytest.mark.parametrize("status", [b"100 Continue", b"204 No Content", b"304 Not Modified"])
def test_answers_without_a_body(status):
    b = Buffer()
    first = b"HTTP/1.1 " + status + b"\r\nContent-Length: 10\r\n\r\n"
    assert [m[0] for m in b.feed("http", first + MESSAGES["http"][1], 1)] == [first, MESSAGES["http"][1]]


def test_capture_stream_reads_late_files_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    eth = b"\0" * 12 + b"\x08\x00"

    def put(name, port):
        (tmp_path / name).write_bytes(capture([eth + ip4(6, tcp(port, 80, 1, b"x"))]))
        os.utime(tmp_path / name, (time.time(), time.time() - 5 + (port - 4000)))
        (tmp_path / name).rename(folder / name)

    pcap.register(spark)
    frames = spark.readStream.format("pcap").load(str(folder))
    query = pcap.decode(frames).writeStream.format("memory").queryName("captured").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, name in enumerate(["m.pcap", "z.pcap", "a.pcap"]):
            put(name, 4000 + k)
            query.processAllAvailable()
            assert sorted(r.src_port for r in spark.table("captured").collect()) == [4000 + i for i in range(k + 1)]
    finally:
        query.stop()


def test_last_rule_of_a_port_counts(spark):
    from wirelake.operators import filters

    packets = spark.createDataFrame([(4000, 80), (80, 4000)], "src_port int, dst_port int")
    for a, b in (("http", "grpc"), ("grpc", "http")):
        rows = filters.route(packets, [filters.Rule(a, (80,)), filters.Rule(b, (80,))]).collect()
        assert [r["proto"] for r in rows] == [b, b]


def test_fields_of_rare_messages(spark):
    from wirelake.operators import decoders

    def one(proto, message, role, *names):
        rows = spark.createDataFrame([(bytearray(message), len(message), role)], "message binary, size bigint, role string")
        return tuple(decoders.DECODERS[proto](rows).select(*names).first())

    my = lambda body, n=0: len(body).to_bytes(3, "little") + bytes([n]) + body
    assert one("mysql", my(b"\x02shop"), "Request", "command", "statement") == ("INIT_DB", "shop")
    assert one("mysql", my(b"\x1f"), "Request", "command", "statement") == ("RESET_CONNECTION", None)
    assert one("mysql", my(b"\xff\x28\x04#42000You have an error", 1), "Response", "error_code", "sql_state", "error") == (1064, "42000", "You have an error")
    pg = lambda kind, body: kind + (len(body) + 4).to_bytes(4, "big") + body
    assert one("postgresql", pg(b"E", b"SERROR\0VERROR\0C42P01\0Mrelation \"x\" does not exist\0\0"), "Response", "severity", "error_code", "error", "packet_kind") == ("ERROR", "42P01", 'relation "x" does not exist', "ErrorResponse")
    assert one("redis", b"*3\r\n$6\r\nconfig\r\n$3\r\nget\r\n$1\r\n*\r\n", "Request", "command") == ("CONFIG GET",)
    assert one("redis", b"*2\r\n$3\r\nget\r\n$3\r\nget\r\n", "Request", "command") == ("GET",)
    assert one("redis", b"-WRONGTYPE no\r\n", "Response", "data_type", "error") == ("Error", "WRONGTYPE no")
    short = lambda x: bytes([len(x)]) + x
    am = lambda cls, method, body: b"\1\0\7" + (len(body) + 4).to_bytes(4, "big") + cls.to_bytes(2, "big") + method.to_bytes(2, "big") + body + b"\xce"
    names = ("class_method", "exchange", "routing_key", "queue_name", "error_code", "error")
    assert one("amqp", am(50, 10, b"\0\0" + short(b"jobs") + b"\0\0\0\0\0"), "Request", *names) == ("Queue.Declare", None, None, "jobs", None, None)
    assert one("amqp", am(50, 20, b"\0\0" + short(b"jobs") + short(b"ex") + short(b"key")), "Request", *names) == ("Queue.Bind", "ex", "key", "jobs", None, None)
    assert one("amqp", am(60, 60, short(b"tag") + bytes(9) + short(b"ex") + short(b"key")), "Response", *names) == ("Basic.Deliver", "ex", "key", None, None, None)
    assert one("amqp", am(60, 71, bytes(9) + short(b"ex") + short(b"key")), "Response", *names) == ("Basic.Get-Ok", "ex", "key", None, None, None)
    assert one("amqp", am(60, 50, b"\x01\x38" + short(b"NO_ROUTE") + short(b"ex") + short(b"key")), "Response", *names) == ("Basic.Return", "ex", "key", None, 312, "NO_ROUTE")
    assert one("amqp", am(20, 40, b"\x01\x94" + short(b"gone") + bytes(4)), "Response", *names) == ("Channel.Close", None, None, None, 404, "NOT_FOUND")
    assert one("amqp", b"\2\0\7\0\0\0\x0e\0\x3c\0\0" + (5_000_000_000).to_bytes(8, "big") + b"\0\0\xce", "Request", "frame_kind", "body_size") == ("Header", 5_000_000_000)
    ka = lambda code: (8).to_bytes(4, "big") + bytes(4) + code.to_bytes(2, "big", signed=True) + bytes(2)
    assert [one("kafka", ka(c), "Response", "error")[0] for c in (-1, 0, 3, 36, 106, 999)] == ["UnknownServerError", "NoError", "UnknownTopicOrPartition", "TopicAlreadyExists", "FetchSessionTopicIDError", "999"]


def test_sizes_of_name_tables():
    from wirelake.functions import names as n

    assert [len(t) for t in (n.KAFKA_APIS, n.KAFKA_ERRORS, n.AMQP_CLASSES, n.AMQP_ERRORS, n.MYSQL_COMMANDS, n.MONGO_OPCODES, n.DNS_TYPES, n.DNS_CLASSES, n.DNS_RCODES, n.DNS_OPERATIONS)] == [64, 108, 7, 12, 31, 10, 9, 5, 6, 3]
    assert sum(map(len, n.AMQP_METHODS.values())) == 55 and (len(n.POSTGRES_CLIENT), len(n.POSTGRES_SERVER)) == (14, 24)


def test_statements_of_binds(spark):
    from wirelake.operators import decoders

    pg = lambda kind, body: bytearray(kind + (len(body) + 4).to_bytes(4, "big") + body)
    sent = [pg(b"P", b"a\0select 1\0\0\0"), pg(b"B", b"\0a\0\0\0"), pg(b"P", b"a\0select 2\0\0\0"), pg(b"P", b"b\0select 3\0\0\0"), pg(b"B", b"\0a\0\0\0"), pg(b"B", b"\0c\0\0\0")]
    rows = spark.createDataFrame([(1, k, m, len(m), "Request") for k, m in enumerate(sent)], "conn int, first_ns bigint, message binary, size bigint, role string")
    got = decoders.postgresql_statements(rows).where("command = 'Bind'").orderBy("first_ns").select("statement").collect()
    assert [r[0] for r in got] == ["select 1", "select 2", None]


def test_mysql_counts_of_all_widths(spark):
    from wirelake.operators import decoders

    counts = {250: b"\xfa", 251: b"\xfc\xfb\0", 65_535: b"\xfc\xff\xff", 70_000: b"\xfd" + (70_000).to_bytes(3, "little"), 1 << 40: b"\xfe" + (1 << 40).to_bytes(8, "little")}
    rows = [(n, bytearray(b"\x07\0\0\1\0" + c + b"\0\2\0\0\0"), 20, "Response") for n, c in counts.items()]
    got = decoders.mysql(spark.createDataFrame(rows, "n long, message binary, size long, role string")).select("n", "affected_rows").collect()
    assert len(got) == 5 and all(n == found for n, found in got)


def test_mongodb_reads_the_whole_body_section(spark):
    from wirelake.operators import decoders

    text = lambda name, v: b"\x02" + name + b"\0" + (len(v) + 1).to_bytes(4, "little") + v + b"\0"
    number = lambda name, v: b"\x10" + name + b"\0" + v.to_bytes(4, "little")

    def message(answers, doc):
        doc = (len(doc) + 5).to_bytes(4, "little") + doc + b"\0"
        return bytearray(b"\0" * 4 + (7).to_bytes(4, "little") + answers.to_bytes(4, "little") + (2013).to_bytes(4, "little") + b"\0" * 5 + doc)

    one = b"\x01ok\0" + struct.pack("<d", 1.0)
    docs = [(0, text(b"insert", b"things") + text(b"c", b"x" * 30_000) + text(b"$db", b"ninechars")), (7, number(b"n", 5) + one), (7, b"\x01ok\0" + struct.pack("<d", 0.0) + number(b"code", 11000))]
    rows = [(k, message(*d), 0) for k, d in enumerate(docs)]
    got = decoders.mongodb(spark.createDataFrame(rows, "k int, message binary, size long")).orderBy("k").select("command", "command_value", "source", "ok", "code").collect()
    assert [tuple(r) for r in got] == [("insert", "things", "ninechars", None, None), (None, None, None, 1, None), (None, None, None, 0, 11000)]


def test_remote_write(spark, tmp_path):
    folder = str(tmp_path)

    def post(body, headers):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "wb") as f:
            f.write(body)
        return 200

    df = spark.sql("SELECT array(struct('__name__' AS name, 'm' AS value), struct('a' AS name, 'b' AS value)) AS labels, 2.0D AS sample_value, 1000L AS sample_ms")
    assert [tuple(r) for r in writers.remote_write(df, post).collect()] == [(200, 1)]
    message = writers.write_request([([("__name__", "m"), ("a", "b")], 2.0, 1000)])
    body = next(tmp_path.iterdir()).read_bytes()
    assert pa.decompress(body, decompressed_size=len(message), codec="snappy", asbytes=True) == message
    assert message.startswith(b"\x0a") and b"__name__" in message and struct.pack("<d", 2.0) in message


def test_trace_request():
    got = json.loads(writers.trace_request([{"trace_id": "t", "span_id": "s", "name": "GET", "start_ns": 1, "end_ns": 2, "attributes": {"a": "b"}}], "svc"))
    span = got["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert span["name"] == "GET" and span["endTimeUnixNano"] == "2" and span["attributes"] == [{"key": "a", "value": {"stringValue": "b"}}]


def test_config():
    s = config.load({"rules": [{"protocol": "http", "ports": [80]}], "pipeline": {"p": ["roundtripstometrics"]}, "labels": ["client.address"]})
    assert s.rules[0].transport == "tcp"
    for bad in ({"nope": 1}, {"pipeline": {"p": ["x"]}}, {"pipeline": {"p": []}}, {"labels": ["server.host"]}, {"rules": [{"protocol": "zzz", "ports": [1]}]}):
        with pytest.raises(ValueError):
            config.load(bad)
    assert config.parse_rule("http;80,8080;h").ports == (80, 8080)
    with pytest.raises(ValueError):
        config.parse_rule("http")


def test_stream_matches_batch(spark, tmp_path):
    from wirelake.operators import matching
    from wirelake.streaming import jobs

    rows = [(c, i, (c + i) % 2, "Request" if (i * 7 + c) % 3 else "Response", c * 100 + i) for c in range(5) for i in range(20)]
    df = spark.createDataFrame(rows, "conn int, seq bigint, key int, role string, id bigint")
    for part in range(2):
        df.where((F.col("seq") >= part * 10) & (F.col("seq") < part * 10 + 10)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).json(str(tmp_path / "in"))
    q = jobs.match(stream, "conn", "key", "seq", "id", 3).writeStream.format("memory").queryName("matched").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(tuple(r) for r in matching.bounded(df, ["conn"], "key", ["seq"], 3, "id").select("conn", "req", "rsp").collect())
    assert sorted(tuple(r) for r in spark.table("matched").collect()) == want and want


def test_stream_counter(spark, tmp_path):
    from wirelake.streaming import jobs

    spark.sql("SELECT timestamp'2024-01-01 00:00:10' + make_interval(0,0,0,0,0,0,id) AS ts, id % 2 AS k FROM range(100)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k bigint").parquet(str(tmp_path / "in"))
    q = jobs.windowed_counter(stream, ["k"], "ts").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r["value"] for r in spark.table("counted").collect()) == 100


def test_watch_ends_at_its_limit_or_when_idle(spark, tmp_path):
    from wirelake.streaming.operations import watch

    spark.range(30).selectExpr("id AS k").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("k bigint").parquet(str(tmp_path / "in"))
    assert len(watch(stream(), most=7, idle_seconds=30)) == 7
    lines = watch(stream(), most=100, idle_seconds=8)
    assert sorted(lines) == sorted(f'{{"k":{k}}}' for k in range(30))


def test_header_compression():
    from wirelake.operators.hpack import Decoder, Headers

    d = Decoder()
    host = (":authority", "www.example.com")
    assert d.read(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")) == [(":method", "GET"), (":scheme", "http"), (":path", "/"), host]
    assert d.read(bytes.fromhex("828684be5886a8eb10649cbf"))[3:] == [host, ("cache-control", "no-cache")]
    assert d.read(bytes.fromhex("828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf"))[2:] == [(":path", "/index.html"), host, ("custom-key", "custom-value")]
    h = Headers()
    frame = lambda kind, flags, body: len(body).to_bytes(3, "big") + bytes([kind, flags]) + b"\0\0\0\1" + body
    assert h.feed(frame(1, 8, b"\2\x82\x86" + b"\0\0")) is None
    assert h.feed(frame(9, 4, b"\x84")) == {":method": "GET", ":scheme": "http", ":path": "/"}
    assert h.feed(frame(1, 4, b"\xff\xff\xff")) is None


def test_huffman_codes_of_all_bytes():
    from wirelake.operators import hpack

    code = {c: (n, v) for (n, v), c in hpack.CODES.items()}
    assert sorted(code) == list(range(256)) and sum(2.0**-n for n, _ in code.values()) + 2.0**-30 == 1
    text = bytes(range(128)) + "äß€".encode()
    bits = "".join(f"{code[c][1]:0{code[c][0]}b}" for c in text)
    bits += "1" * (-len(bits) % 8)
    assert hpack.huffman(int(bits, 2).to_bytes(len(bits) // 8, "big")) == text.decode()


def test_dns_data_formats():
    from wirelake.operators.decoders import _dns_sections

    head = b"\0\1\x81\x80\0\0\0\5\0\0\0\0"
    name = b"\1a\0"
    record = lambda kind, data: name + kind.to_bytes(2, "big") + b"\0\1\0\0\0\x05" + len(data).to_bytes(2, "big") + data
    soa = name + b"\1b\0" + (1).to_bytes(4, "big") + (2).to_bytes(4, "big") + (3).to_bytes(4, "big") + (4).to_bytes(4, "big") + (5).to_bytes(4, "big")
    body = record(16, b"\2hi\3you") + record(15, b"\0\x0a" + name) + record(33, b"\0\1\0\2\0\x50" + name) + record(6, soa) + record(28, b"\0" * 15 + b"\1")
    got = _dns_sections(head + body)
    assert [(r["type"], r["data"]) for r in got] == [("TXT", "hi/you"), ("MX", "a."), ("SRV", "a.:80/W:2/P:1"), ("SOA", "a./b./T:5/E:4"), ("AAAA", "::1")]
    assert all(r["ttl"] == 5 for r in got)


def test_rules_are_read_for_every_batch(spark):
    from wirelake.operators.filters import Rule
    from wirelake.streaming.operations import routed_batches

    rules, seen = [Rule("http", (80,))], []
    run = routed_batches(lambda: rules, lambda df, n: seen.append([r["proto"] for r in df.collect()]))
    packets = spark.createDataFrame([("tcp", "a", "b", 5000, 80), ("udp", "a", "b", 53, 5000)], "l4 string, src_ip string, dst_ip string, src_port int, dst_port int")
    run(packets, 0)
    rules.append(Rule("dns", (53,)))
    run(packets, 1)
    assert seen[0] == ["http"] and sorted(seen[1]) == ["dns", "http"]


def test_self_metrics():
    from types import SimpleNamespace

    from wirelake.streaming.operations import SelfMetrics

    m = SelfMetrics()
    m.onQueryStarted(None)
    m.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(numInputRows=5)))
    m.onQueryTerminated(SimpleNamespace(exception=None))
    assert "rows_total 5.000000" in m.lines() and m.values["streams_failed_total"] == 0
