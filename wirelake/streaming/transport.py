"""The transport cursor, closing connections and framing over a stream of segments, with state between micro-batches.

A connection's state is what the batch plan would know of it at that place: for each direction how far its sequence numbers have come, whether it is closed, and its unfinished
message, with the requests that wait for answers and the header tables of HTTP/2. It is one binary value, as large as the unfinished messages, and goes when the
connection has been silent for long enough. So a capture gives the same messages in one micro-batch or in many.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import http2
from ..operators.framing import LENGTH, Buffer, Talk
from ..operators.l4 import WRAP

ROLES = ("Request", "Response")
STREAMED = ("http2", "grpc")


@dataclass
class Cursor:
    """How far a direction has come, and whether it is closed."""

    reached: int = 0
    closed: bool = False

    def new(self, seq: int, payload: bytes, fin: bool) -> bytes:
        """What of a segment was not seen before; nothing of one on a closed side."""
        if self.closed:
            return b""
        self.closed = fin
        if not payload:
            return b""
        end = seq + len(payload)
        if end >= WRAP:
            self.reached, end = 0, end - WRAP
        if self.reached >= end:
            return b""
        trim, self.reached = max(0, self.reached - seq), end
        return payload[trim:]


@dataclass
class Connection:
    """Both directions of a connection. What a direction sends after its fin ends it, and a new one begins with the segment after that."""

    epoch: int = 0
    cursors: dict[str, Cursor] = field(default_factory=lambda: {r: Cursor() for r in ROLES})
    talk: Talk = field(default_factory=Talk)
    buffers: dict[tuple[str, str], Buffer | http2.Streams] = field(default_factory=dict)

    def feed(self, role: str, proto: str, seq: int, payload: bytes, fin: bool, ns: int) -> Iterator[tuple]:
        """(epoch, role, proto, key, message, size, first_ns, last_ns, exchange, ending, fields)"""
        cursor = self.cursors[role]
        if cursor.closed:
            self.__init__(self.epoch + 1)
            return
        new = cursor.new(seq, payload, fin)
        if proto not in LENGTH:
            return
        found = self.buffers.get((proto, role))
        if found is None:
            found = self.buffers[proto, role] = http2.Streams() if proto in STREAMED else Buffer(talk=self.talk, role=role)
        if isinstance(found, http2.Streams):
            for key, ending, fields, size, _, _, first, last in found.feed(new, ns) if new else ():
                yield self.epoch, role, proto, key, None, size, first, last, None, ending, fields
            return
        for part in (found.feed(proto, new, ns) if new else (), found.close(ns) if fin else ()):
            for message, size, first, last in part:
                yield self.epoch, role, proto, None, message, size, first, last, found.exchange, found.ending or None, None


COLUMNS = "epoch long, role string, proto string, key long, message binary, size long, first_ns long, last_ns long, exchange long, ending string, fields map<string,string>"


def messages(segments: DataFrame, connection: str, order: Sequence[str], idle_ms: int | None = 300_000) -> DataFrame:
    """Messages, and streams of HTTP/2, from a stream of segments with connection, role, proto, seq, payload, fin and capture_ns.

    Segments of a connection that meet in a micro-batch are put in ``order``; across micro-batches the source's order holds. A task holds one connection's segments of a
    micro-batch, which the source's limits for a trigger bound, and its state. Without ``idle_ms`` no connection is ever forgotten; with it the query goes on by the clock, also
    where no data come.
    """
    cols = ["role", "proto", "seq", "payload", "fin", "capture_ns"]
    names = [connection, *(x.split()[0] for x in COLUMNS.split(", "))]
    rest = [c for c in order if c not in (*cols, connection)]

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pickle.loads(state.get[0]) if state.exists else Connection()  # noqa: S301  written below
        rows: list[tuple] = []
        for b in batches:
            rows.extend(zip(zip(*(b[c].tolist() for c in order)), *(b[c].tolist() for c in cols)))
        rows.sort(key=lambda r: r[0])
        out = [(*name, *m) for _, role, proto, seq, payload, fin, ns in rows for m in own.feed(role, proto, seq, bytes(payload or b""), fin, ns)]
        state.update((pickle.dumps(own),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=names, dtype=object)

    kind = dict(segments.dtypes)[connection]
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    picked = segments.select(connection, *cols, *rest)
    return picked.groupBy(connection).applyInPandasWithState(step, f"{connection} {kind}, {COLUMNS}", "held binary", "append", timeout)
