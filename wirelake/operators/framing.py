"""Cutting byte streams into protocol messages.

Segments are shuffled once by stream, sorted within partitions, and read on in order; a task holds the unfinished message of one stream at a time, so memory does not
grow with a connection. Of each message its first bytes are handed on (``KEPT``; of HTTP the head and ``BODY`` bytes after it), with its whole size and the times of its
first and last segment; the others are counted and let go, so that a body or value may have any length. What the bytes mean is worked out by column expressions in ``decoders``.

``messages`` cuts each direction by itself. ``exchanges`` goes over both directions of a connection in order of time, for protocols in which an answer's length follows from
what was asked: an answer to HEAD has no body, one without a length ends with its side of the connection, and after an upgrade the bytes are another protocol's.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hpack import Headers

#: Most bytes that may wait for a length; a stream beyond it is read on from its next segment, as is one that gives a length above ``LONGEST``, which no protocol allows.
MOST = 16 << 20
LONGEST = 1 << 30
KEPT = 65_536
#: Bytes after the head that are kept of an HTTP message.
BODY = 102_400
#: Longest head of an HTTP/1 message; bytes without the end of a head that are more are dropped.
HEAD = 65_536
#: Longest line between chunks, and of Redis.
LINE = 65_536
#: Requests of a connection that may wait for their answers.
PIPELINED = 65_536
#: What a client says first in HTTP/2 and AMQP.
PREFACE_HTTP2, PREFACE_AMQP = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n", b"AMQP"


def _sized(head: int, at: int, width: int, order: str, add: int) -> Callable[[bytes], int | None]:
    return lambda b: None if len(b) < head else int.from_bytes(b[at : at + width], order) + add


def _postgresql(b: bytes) -> int | None:
    if len(b) < 5:
        return None
    # The first message of a client has no kind and so begins with a zero.
    return int.from_bytes(b[:4], "big") if b[0] == 0 else int.from_bytes(b[1:5], "big") + 1


def _amqp(b: bytes) -> int | None:
    if b.startswith(PREFACE_AMQP):
        return 8
    return None if len(b) < 7 else int.from_bytes(b[3:7], "big") + 8


def _http2(b: bytes) -> int | None:
    if PREFACE_HTTP2.startswith(b[:24]) and b:
        return 24
    return None if len(b) < 9 else int.from_bytes(b[:3], "big") + 9


def http_plan(head: bytes, method: str = "") -> tuple[int, str] | None:
    """How much follows the head of an HTTP/1 message, and how it ends: with "length", in chunks ("size" comes next), with the "close" of its side, as an "interim" answer,
    or as the last message before a "tunnel". ``method`` is what was asked, if known. None if the head is none."""
    lines = head.rstrip(b"\r\n").split(b"\r\n")
    if b"HTTP/1." not in lines[0]:
        return None
    answer = lines[0].startswith(b"HTTP/1.")
    status = lines[0][9:12]
    if answer and (status == b"101" or method == "CONNECT" and status[:1] == b"2"):
        return 0, "tunnel"
    if answer and status[:1] == b"1":
        return 0, "interim"
    if answer and (status in (b"204", b"304") or method == "HEAD"):
        return 0, "length"
    fields: dict[bytes, bytes] = {}
    for k, _, v in (x.partition(b":") for x in lines[1:]):
        fields.setdefault(k.strip().lower(), v.strip())
    coded = fields.get(b"transfer-encoding", b"").lower()
    if coded.endswith(b"chunked"):
        return 0, "size"
    size = fields.get(b"content-length")
    if size is None or coded:
        return (0, "close") if answer else (0, "length")
    return (int(size), "length") if size.isdigit() else None


#: For each protocol the length of the message that a buffer begins with: None where more bytes are needed to say, -1 where the bytes are not of the protocol. HTTP/1 and Redis
#: are read by lines.
LENGTH: dict[str, Callable[[bytes], int | None]] = {
    "mysql": _sized(4, 0, 3, "little", 4),
    "postgresql": _postgresql,
    "mongodb": _sized(4, 0, 4, "little", 0),
    "kafka": _sized(4, 0, 4, "big", 4),
    "amqp": _amqp,
    "http2": _http2,
    "grpc": _http2,
    "redis": lambda b: 0,
    "http": lambda b: 0,
    "dns": lambda b: len(b) or None,
}


#: How PostgreSQL clients ask for an encrypted connection, which the server answers with one byte.
SEALING = (b"\0\0\0\x08\x04\xd2\x16\x2f", b"\0\0\0\x08\x04\xd2\x16\x30")


@dataclass
class Talk:
    """What the two sides of a connection know of one another: the number and method of the requests without an answer so far, at most ``PIPELINED`` of them (the oldest go),
    whether the server owes the one byte that answers a wish for encryption, and whether what follows is another protocol's."""

    waiting: deque[tuple[int, str]] = field(default_factory=lambda: deque(maxlen=PIPELINED))
    asked: int = 0
    sealing: bool = False
    tunnel: bool = False


@dataclass
class Buffer:
    """The unfinished message of a stream: ``data`` not yet read, and of the open message what is kept (``most`` bytes of it; 0: none is open), its size so far and the bytes
    ``left`` of it or, in chunks, of its head or chunk."""

    data: bytearray = field(default_factory=bytearray)
    first_ns: int = 0
    kept: bytearray = field(default_factory=bytearray)
    most: int = 0
    size: int = 0
    left: int = 0
    chunked: str = ""  # of a message in chunks, what follows: "size" line, the "end" of a chunk, or "trailer" lines; "values" in one of Redis, "close" if it ends with its side
    open: int = 0  # Redis values still to come
    searched: int = 0  # bytes of a head in which no end was found
    talk: Talk | None = None
    role: str = ""
    exchange: int | None = None  # number of the request that the open message is or answers
    ending: str = ""

    def feed(self, proto: str, payload: bytes, ns: int) -> Iterator[tuple[bytes, int, int, int]]:
        """(kept bytes, size, first time, last time) of the messages that this segment completes."""
        if self.talk and self.talk.tunnel:
            self.data.clear()
            return
        if not self.data and not self.most:
            self.first_ns = ns
        self.data += payload
        while self.data:
            if not self.most and not self._open(proto) or not self._read():
                return
            yield bytes(self.kept), self.size, self.first_ns, ns
            if self.ending == "tunnel" and self.talk:
                self.talk.tunnel = True
                self.data.clear()
            self._reset()
            self.first_ns = ns

    def close(self, ns: int) -> Iterator[tuple[bytes, int, int, int]]:
        """The open message, if it ends with its side of the connection."""
        if self.most and self.chunked == "close":
            yield bytes(self.kept), self.size, self.first_ns, ns
        self.data.clear()
        self._reset()

    def _reset(self) -> None:
        self.kept, self.most, self.size, self.left, self.chunked, self.open = bytearray(), 0, 0, 0, "", 0
        self.searched, self.exchange, self.ending = 0, None, ""

    def _open_http(self) -> bool:
        end = self.data.find(b"\r\n\r\n", max(0, self.searched - 3))
        if end < 0:
            self.searched = len(self.data)
            if len(self.data) > HEAD or len(self.data) >= 4096 and b"HTTP/1." not in self.data[:4096]:
                self.data.clear()
                self.searched = 0
            return False
        head = bytes(self.data[: end + 4])
        talk = self.talk or Talk()
        answer = head.startswith(b"HTTP/1.")
        number, method = talk.waiting[0] if answer and talk.waiting else (None, "")
        plan = http_plan(head, method)
        if plan is None:
            self.data.clear()
            self.searched = 0
            return False
        size, self.ending = plan
        if not answer:
            number = talk.asked
            talk.asked += 1
            talk.waiting.append((number, head.split(b" ", 1)[0].decode("latin-1")))
        elif self.ending != "interim" and talk.waiting:
            talk.waiting.popleft()
        self.exchange = number
        self.most, self.left, self.chunked = len(head) + BODY, len(head) + size, self.ending if self.ending in ("size", "close") else ""
        return True

    def _open(self, proto: str) -> bool:
        if proto == "redis":
            self.most, self.chunked, self.open = KEPT, "values", 1
            return True
        if proto == "http":
            return self._open_http()
        if proto == "postgresql" and self.talk and self._seals():
            return True
        n = LENGTH[proto](bytes(self.data[:64]) if proto != "dns" else bytes(self.data))
        if n is None and len(self.data) <= MOST:
            return False
        if n is None or n <= 0 or n > LONGEST:
            self.data.clear()
            return False
        self.most, self.left = KEPT, n
        return True

    def _seals(self) -> bool:
        """Takes the byte by which a server grants or refuses encryption, and notes that it is asked for."""
        if self.role == "Response" and self.talk.sealing:
            self.talk.sealing = False
            self.most, self.left, self.ending = KEPT, 1, "tunnel" if self.data[:1] in (b"S", b"G") else ""
            return True
        self.talk.sealing |= self.role == "Request" and bytes(self.data[:8]) in SEALING
        return False

    def _read(self) -> bool:
        """Whether the open message is complete. Of a body in chunks only what they hold is kept and counted."""
        while True:
            n = min(self.left, len(self.data))
            self.kept += self.data[: min(n, max(0, self.most - len(self.kept)))]
            del self.data[:n]
            self.size, self.left = self.size + n, self.left - n
            if self.left:
                return False
            if self.chunked == "close":
                if not self.data:
                    return False
                self.left = len(self.data)
                continue
            if not self.chunked or self.chunked == "values" and not self.open:
                return True
            stop = self.data.find(b"\r\n")
            if stop < 0 and len(self.data) <= LINE:
                return False
            line = bytes(self.data[: max(stop, 0)])
            if self.chunked == "values" and stop >= 0 and self._value(line):
                continue
            if self.chunked == "size":
                digits = line.split(b";")[0].strip()
                try:
                    self.left = int(digits, 16) if digits.isalnum() else -1
                except ValueError:
                    self.left = -1
            if self.left < 0 or stop < 0 or self.chunked == "values" or self.chunked == "end" and line:
                self.data.clear()
                self._reset()
                return False
            del self.data[: stop + 2]
            if self.chunked == "trailer" and not line:
                return True
            self.chunked = {"size": "end" if self.left else "trailer", "end": "size", "trailer": "trailer"}[self.chunked]

    def _value(self, line: bytes) -> bool:
        """Takes a line of Redis: what of it and after it belongs to the value, and how many values follow. False if it is none."""
        kind, text = line[:1], line[1:]
        if kind not in (b"*", b"$", b"+", b"-", b":") or kind in (b"*", b"$") and not text.lstrip(b"-").isdigit():
            return False
        n = int(text) if kind in (b"*", b"$") else 0
        self.left = len(line) + 2 + (n + 2 if kind == b"$" and n >= 0 else 0)
        self.open += (max(n, 0) if kind == b"*" else 0) - 1
        return True


def messages(segments: DataFrame, stream: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(stream, proto, message, size, first_ns, last_ns, fields) from segments with proto, payload (what the cursor delivers) and capture_ns; ``order`` is total within a stream.

    A stream whose bytes are not of its protocol is read on from the segment after. ``fields`` holds the header fields of HTTP/2 frames that end a header block; they depend
    on all blocks before in the stream and so are read where the stream is.
    """
    types = dict(segments.dtypes)
    keys = list(stream)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, buffer, headers = None, Buffer(), Headers()
        for b in batches:
            rows = []
            for row in b.itertuples(index=False):
                own = tuple(row[: len(keys)])
                if own != now:
                    now, buffer, headers = own, Buffer(), Headers()
                proto, payload, ns = row[len(keys) : len(keys) + 3]
                if payload is not None and proto in LENGTH:
                    packed = proto in ("http2", "grpc")
                    rows.extend((*own, proto, *m, headers.feed(m[0]) if packed else None) for m in buffer.feed(proto, payload, ns))
            yield pd.DataFrame(rows, columns=[*keys, "proto", "message", "size", "first_ns", "last_ns", "fields"])

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "proto string, message binary, size bigint, first_ns bigint, last_ns bigint, fields map<string,string>"])
    rest = [c for c in order if c not in (*keys, "proto", "payload", "capture_ns")]
    sorted_ = segments.select(*keys, "proto", "payload", "capture_ns", *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(run, schema)


def exchanges(segments: DataFrame, connection: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(connection, role, proto, message, size, first_ns, last_ns, exchange, ending) from segments as for ``messages`` with role and fin, of both directions of each connection;
    ``order`` is total within a connection and goes by time.

    ``exchange`` is the number of the request in its connection that a message is or answers, null for other protocols than HTTP/1 and for answers to what was not captured.
    ``ending`` says how an HTTP message ended: "length", "size" (in chunks), "close", "interim", "tunnel"; a message that the end of the capture cuts is given if its length was to
    follow from the close.
    """
    types = dict(segments.dtypes)
    keys = list(connection)
    cols = ["role", "proto", "payload", "capture_ns", "fin"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sides, last = None, {}, 0
        out: list[tuple] = []

        def taken(buffer: Buffer, proto: str, found: Iterator[tuple]) -> None:
            for m in found:
                out.append((*now, buffer.role, proto, *m, buffer.exchange, buffer.ending or None))

        def end() -> None:
            for proto, own in sides.items():
                for buffer in own.values():
                    taken(buffer, proto, buffer.close(last))

        for b in batches:
            own_keys = zip(*(b[k].tolist() for k in keys))
            for own, role, proto, payload, ns, fin in zip(own_keys, *(b[c].tolist() for c in cols)):
                if own != now:
                    end()
                    now, sides = own, {}
                if proto not in LENGTH:
                    continue
                if proto not in sides:
                    talk = Talk()
                    sides[proto] = {r: Buffer(talk=talk, role=r) for r in ("Request", "Response")}
                buffer, last = sides[proto][role], ns
                if payload:
                    taken(buffer, proto, buffer.feed(proto, payload, ns))
                if fin:
                    taken(buffer, proto, buffer.close(ns))
            yield _exchange_rows(out, keys)
            out.clear()
        end()
        yield _exchange_rows(out, keys)

    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "role string, proto string, message binary, size bigint, first_ns bigint, last_ns bigint, exchange bigint, ending string"])
    rest = [c for c in order if c not in (*keys, *cols)]
    sorted_ = segments.select(*keys, *cols, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(run, schema)


def _exchange_rows(rows: list[tuple], keys: list[str]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=[*keys, "role", "proto", "message", "size", "first_ns", "last_ns", "exchange", "ending"])
    return df.assign(exchange=df["exchange"].astype("Int64"))


def deliver(cursored: DataFrame, ends: bool = False) -> DataFrame:
    """Keeps segments with something new and cuts what was seen before; with ``ends`` also those that close their side, whose payload may be empty."""
    new = (F.col("delivered") > 0) & ~F.col("closed")
    if ends:
        new = new | F.col("fin") & ~F.col("closed")
    payload = F.when(F.col("delivered") > 0, F.expr("substring(payload, CAST(trim AS INT) + 1)"))
    return cursored.where(new).withColumn("payload", payload)


class Fold:
    """What is gathered over the messages of one stream. ``feed`` gives the rows that a segment completes, ``end`` those that the end of the capture does."""

    def feed(self, payload: bytes, ns: int) -> Iterator[tuple]:
        raise NotImplementedError

    def end(self) -> Iterator[tuple]:
        return iter(())


def folded(segments: DataFrame, stream: Sequence[str], order: Sequence[str], make: Callable[[], Fold], schema: str) -> DataFrame:
    """Rows of ``schema`` for each stream from segments with payload and capture_ns, in one pass in order; a task holds one stream's fold at a time."""
    types = dict(segments.dtypes)
    keys = list(stream)
    names = [*keys, *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = None, None
        for b in batches:
            rows: list[tuple] = []
            for own, payload, ns in zip(zip(*(b[k].tolist() for k in keys)), b["payload"].tolist(), b["capture_ns"].tolist()):
                if own != now:
                    if fold:
                        rows.extend((*now, *r) for r in fold.end())
                    now, fold = own, make()
                if payload:
                    rows.extend((*own, *r) for r in fold.feed(payload, ns))
            yield pd.DataFrame(rows, columns=names, dtype=object)
        if fold:
            yield pd.DataFrame([(*now, *r) for r in fold.end()], columns=names, dtype=object)

    rest = [c for c in order if c not in (*keys, "payload", "capture_ns")]
    sorted_ = segments.select(*keys, "payload", "capture_ns", *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), schema]))
