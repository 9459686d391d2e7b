"""Protocols whose messages need more than one stream's bytes or an order of frames: hand-written bytes and plain simulations."""

import random
import struct
import time

import pytest

from wirelake.operators import amqp, bson, framing, http2, kafka
from wirelake.operators.framing import Buffer, Talk

# HTTP over both sides


def talk(turns, step=1000, ends=True):
    """(role, message, exchange, ending) of what both sides say in turn."""
    shared = Talk()
    sides = {r: Buffer(talk=shared, role=r) for r in ("Request", "Response")}
    out = []

    def take(role, found):
        for m in found:
            out.append((role, m[0], sides[role].exchange, sides[role].ending))

    for role, data in turns:
        for at in range(0, len(data), step):
            take(role, sides[role].feed("http", data[at : at + step], at))
    if ends:
        take("Response", sides["Response"].close(9))
    return out


GET, HEAD, POST = b"GET /a HTTP/1.1\r\n\r\n", b"HEAD /a HTTP/1.1\r\n\r\n", b"POST /a HTTP/1.1\r\nContent-Length: 2\r\n\r\nhi"
OK = b"HTTP/1.1 200 OK\r\nContent-Length: 10\r\n\r\n"


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_answers_to_head_have_no_body(step):
    got = talk([("Request", HEAD), ("Response", OK), ("Request", GET), ("Response", OK + b"0123456789")], step)
    assert [(m, x) for r, m, x, _ in got if r == "Response"] == [(OK, 0), (OK + b"0123456789", 1)]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_pipelined_requests_and_interim_answers(step):
    interim = b"HTTP/1.1 103 Early Hints\r\nLink: x\r\n\r\n"
    none = b"HTTP/1.1 304 Not Modified\r\nContent-Length: 10\r\n\r\n"
    got = talk([("Request", GET + HEAD + POST + GET), ("Response", interim + interim + none + OK + b"HTTP/1.1 100 Continue\r\n\r\n" + OK + b"x" * 10 + OK + b"y" * 10)], step)
    assert [x for r, _, x, _ in got if r == "Request"] == [0, 1, 2, 3]
    assert [(x, e) for r, _, x, e in got if r == "Response"] == [(0, "interim"), (0, "interim"), (0, "length"), (1, "length"), (2, "interim"), (2, "length"), (3, "length")]


@pytest.mark.parametrize("step", [1, 3, 1000])
@pytest.mark.parametrize("head", [b"HTTP/1.1 200 OK\r\n\r\n", b"HTTP/1.0 200 OK\r\nConnection: close\r\n\r\n", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip\r\nContent-Length: 2\r\n\r\n"])
def test_answers_that_end_with_their_side(step, head):
    body = b"line\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 3
    got = talk([("Request", GET), ("Response", head + body)], step)
    assert [m for r, m, *_ in got if r == "Response"] == [head + body] and got[-1][3] == "close"
    assert not [m for r, *m in talk([("Request", GET), ("Response", head + body)], step, ends=False) if r == "Response"]


def test_after_an_upgrade_bytes_are_not_http():
    switch = b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\n\r\n"
    got = talk([("Request", GET), ("Response", switch + OK + b"0123456789"), ("Request", GET), ("Response", OK)])
    assert [(r, e) for r, _, _, e in got] == [("Request", "length"), ("Response", "tunnel")]
    connect = b"CONNECT b:443 HTTP/1.1\r\n\r\n"
    assert [r for r, *_ in talk([("Request", connect), ("Response", OK + b"TLS"), ("Request", GET)])] == ["Request", "Response"]
    refused = b"HTTP/1.1 407 No\r\nContent-Length: 1\r\n\r\nx"
    assert [e for _, _, _, e in talk([("Request", connect), ("Response", refused), ("Request", GET)])] == ["length"] * 3


def test_long_heads_are_searched_once_and_given_up():
    b = Buffer()
    began = time.time()
    for k in range(3000):
        assert not [*b.feed("http", b"GET / HTTP/1.1 " + b"x" * 1400, k)]
        assert len(b.data) <= framing.HEAD + 1500
    assert time.time() - began < 2
    b = Buffer()
    long = b"GET / HTTP/1.1\r\nCookie: " + b"c" * 60_000 + b"\r\n\r\n"
    assert [m[0] for at in range(0, len(long), 100) for m in b.feed("http", long[at : at + 100], at)] == [long]


def test_exchanges_in_spark(spark):
    rows = []
    for conn in range(20):
        for at, (role, data, fin) in enumerate([("Request", HEAD + GET, False), ("Response", OK + b"HTTP/1.1 200 OK\r\n\r\nab", False), ("Response", b"cd", conn % 2 == 0), ("Request", b"", True)]):
            rows.append((conn, role, "http", bytearray(data), at, fin))
    df = spark.createDataFrame(rows, "conn long, role string, proto string, payload binary, capture_ns long, fin boolean").repartition(5)
    got = framing.exchanges(df, ["conn"], ["capture_ns"]).where("role = 'Response'").select("conn", "message", "exchange", "ending").collect()
    assert len(got) == 40 and {(bytes(r[1]), r[2], r[3]) for r in got} == {(OK, 0, "length"), (b"HTTP/1.1 200 OK\r\n\r\nabcd", 1, "close")}


def test_one_byte_answers_of_postgresql():
    ask = b"\0\0\0\x08\x04\xd2\x16\x2f"
    start = b"\0\0\0\x09\0\3\0\0\0"
    ready = b"R\0\0\0\x08\0\0\0\0"
    for byte, after in ((b"N", [b"N", ready]), (b"S", [b"S"])):
        shared = Talk()
        client, server = (Buffer(talk=shared, role=r) for r in ("Request", "Response"))
        assert [m[0] for m in client.feed("postgresql", ask, 1)] == [ask]
        got = [m[0] for m in server.feed("postgresql", byte, 2)] + [m[0] for m in client.feed("postgresql", start, 3)] + [m[0] for m in server.feed("postgresql", ready, 4)]
        assert got == ([byte, start, ready] if byte == b"N" else after)
    # Without a wish for encryption an N is a notice.
    notice = b"N\0\0\0\x05\0"
    assert [m[0] for m in Buffer(talk=Talk(), role="Response").feed("postgresql", notice, 1)] == [notice]


# MongoDB


def document(*elements):
    inside = b"".join(bytes([k]) + n.encode() + b"\0" + v for k, n, v in elements)
    return struct.pack("<i", len(inside) + 5) + inside + b"\0"


def string(v):
    return struct.pack("<i", len(v.encode()) + 1) + v.encode() + b"\0"


def op_msg(body, before=b"", opcode=2013):
    rest = struct.pack("<ii", 0, opcode) + b"\0\0\0\0" + before + b"\0" + body
    return struct.pack("<ii", len(rest) + 8, 7) + rest


EVERY = [(1, struct.pack("<d", 2.5)), (2, string("x\0y")), (3, document((2, "$db", string("evil")))), (4, document()), (5, struct.pack("<i", 3) + b"\0abc"), (6, b""), (7, b"o" * 12), (8, b"\1"), (9, b"\2" * 8), (10, b""), (11, b"a.*\0i\0"), (12, string("ns") + b"o" * 12), (13, string("code")), (14, string("sym")), (15, struct.pack("<i", 15) + string("f") + document()), (16, struct.pack("<i", -4)), (17, b"\3" * 8), (18, struct.pack("<q", 1 << 40)), (19, b"\4" * 16), (255, b""), (127, b"")]


def test_walk_steps_over_every_type():
    d = document(*[(k, f"k{k}", v) for k, v in EVERY])
    got = [*bson.elements(b"??" + d, 2)]
    assert [(k, n) for k, n, *_ in got] == [(k, f"k{k}") for k, _ in EVERY]
    assert all((b"??" + d)[a:b] == v for (_, _, a, b), (_, v) in zip(got, EVERY))
    for cut in range(len(d)):
        assert [x[:2] for x in bson.elements(d[:cut], 0)] == [x[:2] for x in got][: len([*bson.elements(d[:cut], 0)])]


@pytest.mark.parametrize(
    "body,want",
    [
        (document((2, "insert", string("kästchen")), (4, "documents", document((3, "0", document((2, "$db", string("evil")))))), (2, "$db", string("shop"))), ("insert", "kästchen", "kästchen", "shop", None, None, None)),
        (document((18, "getMore", struct.pack("<q", 1 << 40)), (2, "collection", string("items")), (2, "$db", string("shop"))), ("getMore", str(1 << 40), "items", "shop", None, None, None)),
        (document((1, "hello", struct.pack("<d", 1.0)), (2, "$db", string("admin"))), ("hello", "1", None, "admin", None, None, None)),
        (document((16, "listDatabases", struct.pack("<i", 1)), (2, "$db", string("admin"))), ("listDatabases", "1", None, "admin", None, None, None)),
        (document((2, "noCommand", string("x")), (2, "find", string("y")), (2, "$db", string("shop"))), (None, None, None, "shop", None, None, None)),
        (document((4, "writeErrors", document((3, "0", document((16, "code", struct.pack("<i", 11000)))))), (1, "ok", struct.pack("<d", 1.0))), (None, None, None, None, 1, None, None)),
        (document((1, "ok", struct.pack("<d", 0.0)), (16, "code", struct.pack("<i", 43)), (2, "codeName", string("CursorNotFound"))), (None, None, None, None, 0, 43, "CursorNotFound")),
        (document((1, "ok", struct.pack("<d", 0.0)), (16, "code", struct.pack("<i", 999_999))), (None, None, None, None, 0, 999_999, "999999")),
        (document((1, "ok", struct.pack("<d", float("nan"))), (1, "hello", struct.pack("<d", float("inf")))), (None,) * 7),
        (document(), (None,) * 7),
    ],
)
def test_what_mongodb_messages_say(body, want):
    assert bson.say(op_msg(body)) == want
    sequence = b"documents\0" + document((2, "$db", string("evil")))
    assert bson.say(op_msg(body, b"\1" + struct.pack("<i", len(sequence) + 4) + sequence)) == want


def test_foreign_and_cut_mongodb_messages():
    whole = op_msg(document((2, "find", string("a")), (2, "$db", string("b"))))
    assert bson.say(op_msg(document((2, "find", string("a"))), opcode=2004)) == (None,) * 7
    for cut in range(len(whole)):
        bson.say(whole[:cut])
    assert bson.say(None) == bson.say(b"") == (None,) * 7
    rng = random.Random(1)
    for _ in range(300):
        bson.say(bytes(rng.randrange(256) if k > 20 and rng.random() < 0.2 else c for k, c in enumerate(whole)))


# Kafka


def request(api, version, body, tagged=False):
    rest = struct.pack(">hhi", api, version, 9) + b"\0\1c" + (b"\1\0\2zz" if tagged else b"") + body
    return struct.pack(">i", len(rest)) + rest


def classic(v):
    return struct.pack(">h", len(v)) + v


def compact(v):
    n, out = len(v) + 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n]) + v


ONE, LONG = b"\0\0\0\1", b"t" * 20_000
UUID = bytes(range(16))


@pytest.mark.parametrize(
    "message,want",
    [
        (request(0, 2, b"\0\1" + bytes(4) + ONE + classic(b"a")), ("a", None, None)),
        (request(0, 8, b"\xff\xff\0\1" + bytes(4) + ONE + classic(b"a")), ("a", None, None)),
        (request(0, 9, b"\0\0\1" + bytes(4) + b"\2" + compact(LONG), True), (LONG.decode(), None, None)),
        (request(0, 13, b"\3tx\0\1" + bytes(4) + b"\2" + UUID, True), (None, "00010203-0405-0607-0809-0a0b0c0d0e0f", None)),
        (request(1, 3, bytes(16) + ONE + classic(b"a")), ("a", None, None)),
        (request(1, 12, bytes(25) + b"\2" + compact(b"a"), True), ("a", None, None)),
        (request(1, 16, bytes(21) + b"\2" + UUID, True), (None, "00010203-0405-0607-0809-0a0b0c0d0e0f", None)),
        (request(2, 6, bytes(5) + b"\2" + compact(b"a"), True), ("a", None, None)),
        (request(3, 1, b"\xff\xff\xff\xff"), (None, None, None)),
        (request(3, 12, b"\2" + bytes(16) + compact(b"a"), True), ("a", None, None)),
        (request(3, 9, b"\0", True), (None, None, None)),
        (request(8, 7, classic(b"g") + bytes(4) + classic(b"m") + b"\xff\xff" + ONE + classic(b"a")), ("a", None, "g")),
        (request(9, 9, b"\2" + compact(b"g") + b"\0" + bytes(4) + b"\2" + compact(b"a"), True), ("a", None, "g")),
        (request(10, 0, classic(b"g")), (None, None, "g")),
        (request(10, 2, classic(b"g") + b"\0"), (None, None, "g")),
        (request(10, 2, classic(b"x") + b"\1"), (None, None, None)),
        (request(10, 4, b"\0\2" + compact(b"g"), True), (None, None, "g")),
        (request(10, 4, b"\1\2" + compact(b"x"), True), (None, None, None)),
        (request(12, 4, compact(b"g") + bytes(4), True), (None, None, "g")),
        (request(28, 3, compact(b"tx") + compact(b"g") + bytes(14) + compact(b"m") + b"\0\2" + compact(b"a"), True), ("a", None, "g")),
        (request(18, 3, compact(b"lib") + compact(b"1"), True), (None, None, None)),
        (request(999, 3, b""), (None, None, None)),
    ],
)
def test_first_names_of_kafka_requests(message, want):
    assert kafka.named(message) == want
    for cut in range(min(len(message), 200)):
        kafka.named(message[:cut])


# AMQP


def frame(kind, channel, body):
    return bytes([kind]) + struct.pack(">HI", channel, len(body)) + body + b"\xce"


def short(v):
    return bytes([len(v)]) + v


def publish(channel, exchange=b"ex", key=b"k"):
    return frame(1, channel, struct.pack(">HHH", 60, 40, 0) + short(exchange) + short(key) + b"\0")


def content(channel, size):
    return frame(2, channel, struct.pack(">HHQH", 60, 0, size, 0))


NAMES = "channel class method class_method exchange routing_key queue_name body_size error_code error frames size first_ns last_ns".split()


def rows_of(data, step=1000, most=128):
    fold = amqp.Channels(most)
    return [dict(zip(NAMES, r)) for at in range(0, len(data), step) for r in fold.feed(data[at : at + step], at)]


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_frames_of_channels_interleave(step):
    bind = frame(1, 9, struct.pack(">HHH", 50, 20, 0) + short(b"q") + short(b"e") + short(b"r") + bytes(5))
    data = b"AMQP\0\0\x09\x01" + publish(1, b"one") + publish(2, b"two") + content(1, 10) + frame(8, 0, b"") + content(2, 0) + frame(3, 1, b"x" * 4) + bind + frame(3, 1, b"x" * 6)
    got = rows_of(data, step)
    assert [(r["channel"], r["class_method"], r["exchange"], r["queue_name"], r["body_size"], r["frames"]) for r in got] == [(2, "Basic.Publish", "two", None, 0, 2), (9, "Queue.Bind", "e", "q", None, 1), (1, "Basic.Publish", "one", None, 10, 4)]
    assert sum(r["size"] for r in got) == len(data) - 8 - 8


def test_other_methods_with_content_and_errors():
    deliver = frame(1, 1, struct.pack(">HH", 60, 60) + short(b"tag") + bytes(9) + short(b"e") + short(b"r"))
    returned = frame(1, 1, struct.pack(">HHH", 60, 50, 312) + short(b"NO_ROUTE") + short(b"e") + short(b"r"))
    got_ok = frame(1, 1, struct.pack(">HH", 60, 71) + bytes(9) + short(b"e") + short(b"r") + bytes(4))
    shut = frame(1, 1, struct.pack(">HHH", 20, 40, 404) + short(b"no queue") + bytes(4))
    got = rows_of(b"".join(m + content(1, 3) + frame(3, 1, b"abc") for m in (deliver, returned, got_ok)) + shut)
    assert [(r["method"], r["exchange"], r["routing_key"], r["error"], r["body_size"]) for r in got] == [("Deliver", "e", "r", None, 3), ("Return", "e", "r", "NO_ROUTE", 3), ("Get-Ok", "e", "r", None, 3), ("Close", None, None, "NOT_FOUND", None)]
    # A method in the middle takes the place of what was open; content without a method is left out.
    assert [r["method"] for r in rows_of(publish(1) + content(1, 9) + shut + frame(3, 1, b"x" * 9) + content(1, 1) + frame(3, 1, b"x"))] == ["Close"]


def test_channels_beyond_the_bound_against_a_plain_simulation():
    rng = random.Random(3)
    data, slots, want = b"", {}, []
    for _ in range(3000):
        channel = rng.randrange(1, 12)
        if channel in slots and rng.random() < 0.7:
            stage = slots[channel]
            if stage == 0:
                size = rng.randrange(0, 3)
                data += content(channel, size)
                slots[channel] = size
                if size == 0:
                    want.append((channel, 0))
                    del slots[channel]
                else:
                    slots[channel] = (size, size)
            else:
                left, whole = stage
                data += frame(3, channel, b"x")
                if left == 1:
                    want.append((channel, whole))
                    del slots[channel]
                else:
                    slots[channel] = (left - 1, whole)
        else:
            slots.pop(channel, None)
            if len(slots) >= 4:
                del slots[min(slots)]
            slots[channel] = 0
            data += publish(channel)
    assert [(r["channel"], r["body_size"]) for r in rows_of(data, 100, 4)] == want


# HTTP/2


def h2(kind, flags, stream, body=b""):
    return struct.pack(">I", len(body))[1:] + bytes([kind, flags]) + struct.pack(">I", stream) + body


def streams_of(data, step=1000, alive=100):
    fold = http2.Streams(alive)
    return [r for at in range(0, len(data), step) for r in fold.feed(data[at : at + step], at)]


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_streams_end_are_reset_and_promised(step):
    data = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n" + h2(4, 0, 0, b"")
    data += h2(1, 4, 1, b"\x88") + h2(1, 4, 3, b"\x88") + h2(0, 0, 1, b"body") + h2(0, 8, 3, b"\2abcd\0\0")
    data += h2(5, 0, 1, struct.pack(">I", 2) + b"\x82\x87") + h2(9, 4, 1, b"\x84")
    data += h2(1, 1, 1, b"\0\x0bgrpc-") + h2(9, 4, 1, b"status\x017") + h2(3, 0, 3, struct.pack(">I", 8)) + h2(3, 0, 99, struct.pack(">I", 8))
    got = streams_of(data, step)
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(2, "promise", 0, None), (1, "end", 4, None), (3, "reset", 4, 8)]
    assert got[0][2] == {":method": "GET", ":scheme": "https", ":path": "/"} and got[1][2] == {":status": "200", "grpc-status": "7"}


def test_many_streams_in_bounded_memory():
    fold, n = http2.Streams(10), 0
    for k in range(100_000):
        number = 2 * k + 1
        for r in fold.feed(h2(1, 4, number, b"\x88") + (h2(0, 1, number, b"x") if k % 2 else b""), k):
            n += 1
            assert r[1] == ("end" if r[0] % 4 == 3 else "evicted")
        assert len(fold.open) <= 10
    assert n == 100_000 - len(fold.open)
