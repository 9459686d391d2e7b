"""HTTP/2 streams put together from segments in one ordered pass, with a bounded table of those that are alive."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .framing import Buffer, Fold, folded
from .hpack import Headers

DATA, HEADERS, RESET, PROMISE, CONTINUATION = 0, 1, 3, 5, 9
END_STREAM, END_HEADERS = 1, 4
#: Streams of one direction of a connection that are alive at most; a further one sends away the smallest number, as the oldest.
ALIVE = 100


@dataclass
class Stream:
    """One direction of a stream so far: fields of its header blocks (the last of equal names counts), bytes of its frames, and whether its last block ends it."""

    first_ns: int
    last_ns: int = 0
    size: int = 0
    body: int = 0
    fields: dict[str, str] = field(default_factory=dict)
    ending: bool = False


class Streams(Fold):
    """(key, ending, fields, size, body_bytes, error_code, first_ns, last_ns) of streams: "end", "reset" (with the code), "evicted", or "promise", which is the request that a
    server makes for its client."""

    def __init__(self, alive: int = ALIVE):
        self.buffer, self.headers, self.alive = Buffer(), Headers(), alive
        self.open: dict[int, Stream] = {}
        self.promised = 0

    def feed(self, payload: bytes, ns: int) -> Iterator[tuple]:
        for frame, size, first, last in self.buffer.feed("http2", payload, ns):
            if len(frame) >= 9 and not frame.startswith(b"PRI * HTTP/2"):
                yield from self._frame(frame, size, first, last)

    def _frame(self, frame: bytes, size: int, first: int, last: int) -> Iterator[tuple]:
        kind, flags, number = frame[3], frame[4], int.from_bytes(frame[5:9], "big") & 0x7FFFFFFF
        fields = self.headers.feed(frame)
        if kind == PROMISE:
            at = 10 if flags & 8 else 9
            self.promised = int.from_bytes(frame[at : at + 4], "big") & 0x7FFFFFFF
        if self.promised and kind in (PROMISE, CONTINUATION):
            if flags & END_HEADERS:
                promised, self.promised = self.promised, 0
                yield promised, "promise", fields or {}, size, 0, None, first, last
            return
        if not number or kind not in (DATA, HEADERS, RESET, CONTINUATION):
            return
        if number not in self.open:
            if kind == RESET or kind == CONTINUATION:
                return
            if len(self.open) >= self.alive:
                yield self._done(min(self.open), "evicted")
            self.open[number] = Stream(first)
        s = self.open[number]
        s.last_ns, s.size = last, s.size + size
        if kind == DATA:
            s.body += size - 9 - ((frame[9] + 1) if flags & 8 and len(frame) > 9 else 0)
        s.fields |= fields or {}
        if kind == RESET:
            yield self._done(number, "reset", int.from_bytes(frame[9:13], "big"))
            return
        if kind in (DATA, HEADERS):
            s.ending |= bool(flags & END_STREAM)
        # A block that ends the stream may go on in further frames.
        if s.ending and (kind == DATA or flags & END_HEADERS):
            yield self._done(number, "end")

    def _done(self, number: int, ending: str, code: int | None = None) -> tuple:
        s = self.open.pop(number)
        return number, ending, s.fields, s.size, s.body, code, s.first_ns, s.last_ns


_STREAMS = "key bigint, ending string, fields map<string,string>, size bigint, body_bytes bigint, error_code bigint, first_ns bigint, last_ns bigint"
#: Fields that get columns of their own.
_FIELDS = {"method": ":method", "path": ":path", "scheme": ":scheme", "authority": ":authority", "status": ":status", "grpc_status": "grpc-status"}


def streams(segments: DataFrame, stream: Sequence[str], order: Sequence[str], alive: int = ALIVE) -> DataFrame:
    """The streams of each direction that ended, were reset or sent away, and the promised requests, with all their header and trailer fields and the common ones as columns."""
    df = folded(segments, stream, order, lambda: Streams(alive), _STREAMS)
    return df.withColumns({name: df["fields"][key] for name, key in _FIELDS.items()})
