"""Capture files as a Spark data source, and packets decoded by column expressions.

``spark.read.format("pcap").load(path)`` gives one row for each captured frame. Files are read by ranges of ``split`` bytes, each in a task as a stream of bounded pieces. A range
begins within some record; where the next one begins is found by a chain of plausible record heads that starts some of the longest records before the range, so that
what looks like a capture within a frame has ended by then. Options ``ports``, ``hosts`` and ``ip_version`` leave frames out as they are read, as do filters on capture_ns that Spark
hands down. Link, network and transport headers are then taken apart by ``decode`` with built-in functions on the binary column.
"""

from __future__ import annotations

import ipaddress
import struct
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "capture_ns bigint, packet_no bigint, file string, link_type int, frame binary"
#: The first four bytes of a capture file say byte order and unit of time.
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1000), b"\xd4\xc3\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1)}
#: Link types.
LINK_NULL, LINK_ETHERNET, LINK_RAW = 0, 1, 101
PIECE = 4 << 20
SETTLED = 1_000_000_000
BATCH_ROWS, BATCH_BYTES = 4096, 16 << 20


#: Bytes of a file that a task reads, about, and the longest record that is taken for one.
SPLIT, LONGEST = 64 << 20, 262_144
#: Seconds by which the times of a file's records may differ from that of its first.
SPAN = 10 * 365 * 86_400
#: Records that a chain must have at least, and how many times the longest record before a range it begins.
LINKS, BACK = 6, 8
#: Seconds by which the times of neighbouring records may differ for a chain to be plausible.
APART = 7 * 86_400


@dataclass(frozen=True)
class Head:
    """What the head of a capture file says: byte order, nanoseconds in a unit of the second time field, the longest frame, link type; and the second of the first record."""

    order: str
    unit: int
    longest: int
    link: int
    began: int = 0

    @classmethod
    def of(cls, data: bytes) -> Head | None:
        if len(data) < 24:
            return None
        if data[:4] not in MAGIC:
            raise ValueError("not a capture file")
        order, unit = MAGIC[data[:4]]
        longest, link = struct.unpack(order + "II", data[16:24])
        began = struct.unpack(order + "I", data[24:28])[0] if len(data) >= 28 else 0
        return cls(order, unit, min(longest or LONGEST, LONGEST), link & 0xFFFF, began)

    @property
    def record(self):  # noqa: ANN201
        return struct.Struct(self.order + "IIII").unpack_from


def chain(data: bytes, at: int, head: Head, enough: int, last: bool) -> bool:
    """Whether at least ``LINKS`` records follow one another from ``at`` on for ``enough`` bytes, or records up to the end of the file (``last``). Empty frames, as which zeros would
    count, are not plausible."""
    begin, before, links = at, None, 0
    read = head.record
    while at - begin < enough or links < LINKS:
        if at + 16 > len(data):
            return last and at > begin and len(data) - at < 16
        sec, part, size, whole = read(data, at)
        if not 0 < size <= min(head.longest, whole) or whole > LONGEST or abs(sec - head.began) > SPAN or part * head.unit >= 1_000_000_000 or before is not None and abs(sec - before) > APART:
            return False
        before = sec
        at, links = at + 16 + size, links + 1
        if at > len(data):
            return last and at - begin > 16
    return True


def first_record(data: bytes, offset: int, start: int, head: Head, last: bool) -> int | None:
    """Where the first record at or after ``start`` begins in a file of which ``data`` holds what stands from ``offset`` on; None if no chain leads there.

    A record begins within the longest one's size from ``offset``, or at the head's end. The first that a chain of plausible records leads from to ``start`` may be a false one,
    within a frame; but its chain goes on, so it has met the true one at a frame's end, and many frames lie between.
    """
    reach = head.longest + 16
    for at in [24 - offset] if offset <= 24 else range(min(reach + 1, len(data))):
        if chain(data, at, head, max(reach, start - offset - at), last):
            while offset + at < start:
                at += 16 + head.record(data, at)[2]
            return offset + at
    return None


def frames(chunks: Iterator[bytes], head: Head | None = None, offset: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(time in ns, place in the file, link type, bytes) of each frame of a capture given in pieces, from a record that begins at ``offset`` (or from the head of the file, if none is
    given) to the last that begins before ``stop``; a cut last frame is left out."""
    held = b""
    for chunk in chunks:
        held += chunk
        at = 0
        if head is None:
            head = Head.of(held)
            if head is None:
                continue
            at = 24
        read = head.record
        while len(held) - at >= 16:
            if stop is not None and offset + at >= stop:
                return
            sec, part, size, _ = read(held, at)
            if len(held) - at - 16 < size:
                break
            yield sec * 1_000_000_000 + part * head.unit, offset + at, head.link, held[at + 16 : at + 16 + size]
            at += 16 + size
        held, offset = held[at:], offset + at


@dataclass(frozen=True)
class Wanted:
    """Which frames are read on. Empty fields ask for nothing; a frame that is not understood is not wanted where something is asked for."""

    ports: frozenset[int] = frozenset()
    hosts: frozenset[str] = frozenset()
    ip_version: int = 0
    since: int | None = None
    until: int | None = None

    @classmethod
    def of(cls, options: dict[str, str]) -> Wanted:
        parts = lambda name: [x.strip() for x in options.get(name, "").split(",") if x.strip()]
        hosts = frozenset(str(ipaddress.ip_address(x)) for x in parts("hosts"))
        return cls(frozenset(map(int, parts("ports"))), hosts, int(options.get("ip_version") or 0))

    def takes(self, ns: int, link: int, frame: bytes) -> bool:
        if self.since is not None and ns < self.since or self.until is not None and ns > self.until:
            return False
        if not (self.ports or self.hosts or self.ip_version):
            return True
        found = parsed(link, frame)
        if found is None:
            return False
        version, source, target, ports = found
        if self.ip_version and version != self.ip_version or self.ports and self.ports.isdisjoint(ports):
            return False
        return not self.hosts or not self.hosts.isdisjoint(str(ipaddress.ip_address(x)) for x in (source, target))


#: Headers that may stand between that of IPv6 and the transport's: options, routing, fragment, authentication, destination, mobility and others of the same form.
EXTENSIONS = (0, 43, 44, 51, 60, 135, 139, 140)


def parsed(link: int, frame: bytes) -> tuple[int, bytes, bytes, tuple[int, ...]] | None:
    """(IP version, source, target, ports if there are some) of a frame."""
    at = {LINK_ETHERNET: 18 if frame[12:14] == b"\x81\x00" else 14, LINK_NULL: 4, LINK_RAW: 0}.get(link)
    if at is None or len(frame) < at + 20:
        return None
    version = frame[at] >> 4
    if version == 4:
        kind, source, target, body = frame[at + 9], frame[at + 12 : at + 16], frame[at + 16 : at + 20], at + (frame[at] & 15) * 4
        parted = int.from_bytes(frame[at + 6 : at + 8], "big") & 0x1FFF
    elif version == 6 and len(frame) >= at + 40:
        kind, source, target, body = frame[at + 6], frame[at + 8 : at + 24], frame[at + 24 : at + 40], at + 40
        parted = 0
        while kind in EXTENSIONS and body + 8 <= len(frame):
            if kind == 44:
                parted = int.from_bytes(frame[body + 2 : body + 4], "big") >> 3
            size = 8 if kind == 44 else (frame[body + 1] + 2) * 4 if kind == 51 else (frame[body + 1] + 1) * 8
            kind, body = frame[body], body + size
    else:
        return None
    if kind not in (6, 17) or parted or len(frame) < body + 4:
        return version, source, target, ()
    return version, source, target, (int.from_bytes(frame[body : body + 2], "big"), int.from_bytes(frame[body + 2 : body + 4], "big"))


@dataclass
class CaptureFile(InputPartition):
    """Records of a file that begin from ``start`` (the head's end for the first range) to before ``stop`` (the end, if None)."""

    uri: str
    start: int = 24
    stop: int | None = None

    def __post_init__(self) -> None:
        super().__init__(self.uri)


def _files(uri: str) -> list[tuple[int, str, int]]:
    """(time of the last change in ns, name, size) of the capture files of a folder, or of the one file."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    found = store.get_file_info(path)
    scheme = uri.split("://")[0] if "://" in uri else "file"
    if found.type == fs.FileType.Directory:
        inside = store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((x.mtime_ns or 0, f"{scheme}://{x.path}", x.size or 0) for x in inside if x.type == fs.FileType.File and x.base_name.endswith((".pcap", ".cap")))
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return [(found.mtime_ns or 0, f"{scheme}://{path}", found.size or 0)]


def _ranges(name: str, size: int, split: int) -> list[CaptureFile]:
    """A file in ranges of about ``split`` bytes."""
    many = max(1, size // split)
    cuts = [24, *(size * k // many for k in range(1, many)), None]
    return [CaptureFile(name, a, b) for a, b in zip(cuts, cuts[1:])]


def _read(part: CaptureFile, wanted: Callable[[int, int, bytes], bool]) -> Iterator[pa.RecordBatch]:
    uri = part.uri
    store, path = fs.FileSystem.from_uri(uri)

    def chunks(at: int) -> Iterator[bytes]:
        with store.open_input_file(path) as f:
            f.seek(at)
            while piece := f.read(PIECE):
                yield piece

    def within() -> Iterator[tuple[int, int, int, bytes]]:
        if part.start <= 24:
            return frames(chunks(0), stop=part.stop)
        with store.open_input_file(path) as f:
            head = Head.of(f.read(28))
            if head is None:
                return iter(())
            back = max(24, part.start - BACK * (head.longest + 16))
            f.seek(back)
            data = f.read(part.start - back + LINKS * (head.longest + 16))
            first = first_record(data, back, part.start, head, back + len(data) >= f.size())
        if first is None:
            # No chain of records leads here; the records from the head on do.
            return (x for x in frames(chunks(0), stop=part.stop) if x[1] >= part.start)
        return frames(chunks(first), head, first, part.stop)

    def batch() -> pa.RecordBatch:
        t, n, link, data = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array([uri] * len(t)), pa.array(link, pa.int32()), pa.array(data, pa.binary())], names=["capture_ns", "packet_no", "file", "link_type", "frame"])

    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for f in within():
        if not wanted(f[0], f[2], f[3]):
            continue
        held.append(f)
        size += len(f[3])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.split, self.wanted = options["path"], int(options.get("split") or SPLIT), Wanted.of(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds on capture_ns are kept to while reading; Spark sees to the other filters."""
        for f in filters:
            if getattr(f, "attribute", None) != ("capture_ns",) or not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or not isinstance(f.value, int):
                yield f
                continue
            low = f.value + isinstance(f, GreaterThan) if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) else None
            high = f.value - isinstance(f, LessThan) if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) else None
            since = max((x for x in (self.wanted.since, low) if x is not None), default=None)
            until = min((x for x in (self.wanted.until, high) if x is not None), default=None)
            self.wanted = replace(self.wanted, since=since, until=until)

    def partitions(self) -> list[InputPartition]:
        return [r for _, name, size in sorted(_files(self.uri), key=lambda x: x[1]) for r in _ranges(name, size, self.split)]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.wanted.takes)


class _StreamReader(DataSourceStreamReader):
    """An offset is the last change of the newest file read, and its name. Files count from ``SETTLED`` ns after their last change on, so that none of the same time can come
    after an offset; a file that comes late is read whatever its name. Files are to be moved into the folder once they are whole, as tools that rotate captures do."""

    def __init__(self, options: dict[str, str]):
        self.uri, self.split, self.wanted = options["path"], int(options.get("split") or SPLIT), Wanted.of(options)

    def initialOffset(self) -> dict:
        return {"changed": -1, "file": ""}

    def latestOffset(self) -> dict:
        now = time.time_ns()
        changed, name = max((x[:2] for x in _files(self.uri) if x[0] <= now - SETTLED), default=(-1, ""))
        return {"changed": changed, "file": name}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = ((x["changed"], x["file"]) for x in (start, end))
        return [r for *x, size in _files(self.uri) if after < tuple(x) <= upto for r in _ranges(x[1], size, self.split)]

    def read(self, partition: CaptureFile) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.wanted.takes)


class PcapSource(DataSource):
    """Registered as ``pcap``; takes a file or a folder as its path, for batch and stream. packet_no goes up through a file: it is where the record begins."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The frames of a file or folder; ``ports``, ``hosts``, ``ip_version`` and ``split`` as options, lists as such."""
    register(spark)
    reader = spark.read.format("pcap")
    for name, value in options.items():
        reader = reader.option(name, ",".join(map(str, value)) if isinstance(value, (list, tuple, set, frozenset)) else str(value))
    return reader.load(path)


def uint(data: Column, at: Column | int, size: int, little: bool = False) -> Column:
    """An unsigned number of ``size`` bytes from offset ``at`` on; null where the bytes are not there."""
    at = F.lit(at) if isinstance(at, int) else at
    raw = F.substring(data, at + 1, F.lit(size))
    text = F.hex(raw)
    if little:
        text = F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when(F.octet_length(raw) == size, F.conv(text, 16, 10).cast("bigint"))


def ipv4_text(data: Column, at: Column) -> Column:
    return F.concat_ws(".", *[uint(data, at + k, 1).cast("string") for k in range(4)])


def ipv6_text(data: Column, at: Column) -> Column:
    """The canonical text: no leading zeros, the first longest run of zero groups as ``::``."""
    groups = [F.lower(F.conv(F.hex(F.substring(data, at + 2 * k + 1, F.lit(2))), 16, 16)) for k in range(8)]
    full = F.concat_ws(":", *groups)
    text, done = full, F.lit(False)
    for n in range(8, 1, -1):
        run = rf"^(|.*?:)0(?::0){{{n - 1}}}(:.*|)$"
        hit = ~done & full.rlike(run)
        head, tail = F.regexp_extract(full, run, 1), F.regexp_extract(full, run, 2)
        text = F.when(hit, F.concat(F.when(head == "", ":").otherwise(head), F.when(tail == "", ":").otherwise(tail))).otherwise(text)
        done = done | hit
    return text


MOST_EXTENSIONS = 8


def _transport6(f: Column, ip: Column) -> Column:
    """Of an IPv6 packet: the transport's number, how far after the IPv6 header's start it begins, and the place of the fragment, behind any extension headers."""

    def step(s: Column, _: Column) -> Column:
        at = (ip + s["at"]).cast("int")
        kind, units = s["kind"], uint(f, at + 1, 1)
        size = F.when(kind == 44, F.lit(8)).when(kind == 51, (units + 2) * 4).otherwise((units + 1) * 8)
        place = F.when(kind == 44, F.shiftright(uint(f, at + 2, 2), 3)).otherwise(s["place"])
        moved = F.struct(uint(f, at, 1).alias("kind"), (s["at"] + size).cast("bigint").alias("at"), place.alias("place"))
        return F.when(kind.isin(*EXTENSIONS), moved).otherwise(s)

    start = F.struct(uint(f, ip + 6, 1).alias("kind"), F.lit(40).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("place"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_EXTENSIONS)), start, step)


def decode(captured: DataFrame) -> DataFrame:
    """packets: capture_ns, packet_no, file, ip_version, l4, src_ip, dst_ip, src_port, dst_port, fin, seq, payload, len.

    Ethernet (with one VLAN tag), BSD loopback and raw IP; IPv4 with options, IPv6 with up to ``MOST_EXTENSIONS`` extension headers; TCP and UDP. Other frames and later fragments are
    left out.
    """
    f = F.col("frame")
    vlan = uint(f, 12, 2) == 0x8100
    start = F.when(F.col("link_type") == LINK_ETHERNET, F.when(vlan, 18).otherwise(14)).when(F.col("link_type") == LINK_NULL, 4).when(F.col("link_type") == LINK_RAW, 0)
    df = captured.withColumn("_ip", start).where("_ip IS NOT NULL")
    df = df.withColumn("ip_version", F.shiftright(uint(f, F.col("_ip"), 1), 4).cast("int")).where("ip_version IN (4, 6)")
    ip, four = F.col("_ip"), F.col("ip_version") == 4
    df = df.withColumn("_six", F.when(~four, _transport6(f, ip)))
    six = F.col("_six")
    df = df.withColumns(
        {
            "_head": F.when(four, uint(f, ip, 1).bitwiseAND(15) * 4).otherwise(six["at"]),
            "_next": F.when(four, uint(f, ip + 9, 1)).otherwise(six["kind"]),
            "_total": F.when(four, uint(f, ip + 2, 2)).otherwise(uint(f, ip + 4, 2) + 40),
            "_fragment": F.when(four, uint(f, ip + 6, 2).bitwiseAND(0x1FFF)).otherwise(six["place"]),
        }
    ).where("_next IN (6, 17) AND _fragment = 0")
    tcp = F.col("_next") == 6
    df = df.withColumn("_l4", (ip + F.col("_head")).cast("int"))
    at = F.col("_l4")
    body = F.when(tcp, at + F.shiftright(uint(f, at + 12, 1), 4).cast("int") * 4).otherwise(at + 8)
    size = F.greatest(F.lit(0), (ip + F.col("_total")).cast("int") - body)
    df = df.withColumns(
        {
            "l4": F.when(tcp, "tcp").otherwise("udp"),
            "src_ip": F.when(four, ipv4_text(f, ip + 12)).otherwise(ipv6_text(f, ip + 8)),
            "dst_ip": F.when(four, ipv4_text(f, ip + 16)).otherwise(ipv6_text(f, ip + 24)),
            "src_port": uint(f, at, 2).cast("int"),
            "dst_port": uint(f, at + 2, 2).cast("int"),
            "seq": F.when(tcp, uint(f, at + 4, 4)),
            "fin": tcp & (uint(f, at + 13, 1).bitwiseAND(1) == 1),
            "payload": F.substring(f, body + 1, size),
        }
    ).where("src_port IS NOT NULL AND dst_port IS NOT NULL AND payload IS NOT NULL")
    return df.select("capture_ns", "packet_no", "file", "ip_version", "l4", "src_ip", "dst_ip", "src_port", "dst_port", "fin", "seq", "payload", F.octet_length("payload").alias("len"))
