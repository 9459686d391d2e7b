"""Captures read by ranges, with what is not wanted left out while reading, and IPv6 extension headers."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tests.test_wire import capture, ip4, tcp
from wirelake.sources import pcap


def ip6(kind, body, src="20010db8" + "00" * 11 + "01", dst="fe80" + "00" * 13 + "02"):
    return struct.pack(">IHBB", 6 << 28, len(body), kind, 64) + bytes.fromhex(src) + bytes.fromhex(dst) + body


def records(n, seed, order="<", inner=True):
    """A capture with frames of all sizes, some of which hold captures."""
    rng = random.Random(seed)
    out = [struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 4096, 101)]
    for k in range(n):
        body = rng.randbytes(rng.choice([0, 1, 15, 16, 60, 900]))
        if inner and k % 7 == 0:
            body = b"".join(struct.pack(order + "IIII", 1000, j, 20, 20) + rng.randbytes(20) for j in range(rng.randrange(1, 80)))
        elif inner and k % 11 == 0:
            body = b"\0" * rng.randrange(3000)
        frame = ip4(6, tcp(4000 + k % 3, 80, k, body))
        out.append(struct.pack(order + "IIII", 1000 + k // 50, k % 50, len(frame), len(frame)) + frame)
    return b"".join(out)


@pytest.mark.parametrize("order", ["<", ">"])
def test_ranges_of_a_capture_have_each_record_once(tmp_path, order):
    data = records(900, 3, order)
    path = tmp_path / "a.pcap"
    path.write_bytes(data)
    want = [*pcap.frames(iter([data]))]
    assert len(want) == 900
    head = pcap.Head.of(data)
    for split in (5_000, 30_011, 100_000, 10**9):
        got = []
        for part in pcap._ranges(f"file://{path}", len(data), split):
            got += [(r["capture_ns"], r["packet_no"], bytes(r["frame"])) for b in pcap._read(part, lambda *_: True) for r in b.to_pylist()]
        assert got == [(t, n, f) for t, n, _, f in want]
    # Each start is found by the chain itself where enough stands before it.
    places = [n for _, n, _, _ in want]
    for start in range(40_000, len(data) - 30_000, 977):
        back = start - pcap.BACK * (head.longest + 16)
        found = pcap.first_record(data[back : start + pcap.LINKS * (head.longest + 16)], back, start, head, False)
        assert found == min(n for n in places if n >= start)


def test_ranges_without_a_chain_are_read_from_the_head(tmp_path):
    """Times that jump by more than a chain allows."""
    frame = ip4(6, tcp(1, 80, 0, b"x" * 500))
    data = records(0, 1) + b"".join(struct.pack("<IIII", k % 2 * 4_000_000_000, 0, len(frame), len(frame)) + frame for k in range(100))
    (tmp_path / "a.pcap").write_bytes(data)
    got = [r["packet_no"] for part in pcap._ranges(f"file://{tmp_path}/a.pcap", len(data), 9_000) for b in pcap._read(part, lambda *_: True) for r in b.to_pylist()]
    assert got == [24 + k * (16 + len(frame)) for k in range(100)]


def test_split_scan_in_spark(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(records(3000, 9))
    (tmp_path / "b.pcap").write_bytes(records(500, 4))
    one = pcap.load(spark, str(tmp_path))
    many = pcap.load(spark, str(tmp_path), split=60_000)
    assert many.rdd.getNumPartitions() >= 16 > one.rdd.getNumPartitions()
    digest = lambda df: sorted(map(tuple, df.select("file", "packet_no", "capture_ns", F.md5("frame")).collect()))
    assert digest(one) == digest(many) and one.count() == 3500


def test_unwanted_frames_are_left_out_while_reading(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(records(300, 5))
    every = pcap.decode(pcap.load(spark, str(tmp_path)))
    some = pcap.load(spark, str(tmp_path), ports=[4001, 9])
    assert some.count() == pcap.decode(some).count() == every.where("src_port = 4001").count() == 100
    assert pcap.load(spark, str(tmp_path), ip_version=6).count() == 0
    assert pcap.load(spark, str(tmp_path), hosts=["10.0.0.2"]).count() == 300 and pcap.load(spark, str(tmp_path), hosts=["10.0.0.9"]).count() == 0
    late = pcap.load(spark, str(tmp_path)).where("capture_ns >= 1002000000000 AND capture_ns < 1004000000000")
    assert late.count() == 100
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in plan and "<" not in plan  # the reader keeps to the bounds
    reader = pcap._Reader({"path": str(tmp_path)})
    left = list(reader.pushFilters([pcap.GreaterThan(("capture_ns",), 5), pcap.LessThanOrEqual(("capture_ns",), 9), pcap.EqualTo(("file",), "x")]))
    assert left == [pcap.EqualTo(("file",), "x")] and (reader.wanted.since, reader.wanted.until) == (6, 9)
    with pytest.raises(ValueError):
        pcap.Wanted.of({"hosts": "no address"})


def test_extension_headers(spark, tmp_path):
    segment = tcp(5000, 443, 7, b"hello")
    hop = bytes([43, 0]) + b"\0" * 6
    routing = bytes([51, 1]) + b"\0" * 14
    authentication = bytes([60, 4]) + b"\0" * 22
    options = bytes([6, 0]) + b"\0" * 6
    whole = bytes([6, 0, 0, 1]) + b"\0" * 4
    later = bytes([6, 0, 0, 0x19]) + b"\0" * 4
    frames = [ip6(6, segment), ip6(0, hop + routing + authentication + options + segment), ip6(44, whole + segment), ip6(44, later + segment), ip6(59, b""), ip6(0, hop)]
    (tmp_path / "a.pcap").write_bytes(capture(frames, link=101))
    rows = pcap.decode(pcap.load(spark, str(tmp_path))).orderBy("packet_no").collect()
    assert [(r["src_port"], r["dst_port"], r["seq"], bytes(r["payload"])) for r in rows] == [(5000, 443, 7, b"hello")] * 3
    assert pcap.load(spark, str(tmp_path), ports=443).count() == 3
    for f in frames:
        for cut in range(len(f)):
            pcap.parsed(101, f[:cut])
