"""The operators over streams: watermarked counters and rates, series that expire, framing and matching with state.

Messages of a connection may meet in one micro-batch or in several; state holds no more than a matcher's bounded list or one unfinished message for each connection, and goes
when the connection has been silent for long enough.
"""

from __future__ import annotations

import json
from base64 import b64decode, b64encode
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.framing import Buffer
from ..operators.matching import REQUEST


def event_time(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_counter(rows: DataFrame, by: Sequence[str], ts: str, window: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    w = event_time(rows, ts, delay).groupBy(F.window(ts, window).alias("w"), *by).agg(F.count("*").alias("value"))
    return w.select(F.col("w.start").alias("window_start"), *by, "value")


def expiring_series(rows: DataFrame, by: Sequence[str], ts: str, idle: str = "5 minutes", delay: str = "2 minutes") -> DataFrame:
    """A session for each stretch of a series without a gap longer than ``idle``."""
    s = event_time(rows, ts, delay).groupBy(F.session_window(ts, idle).alias("s"), *by).agg(F.count("*").alias("value"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return s.select(*by, "first_ts", "last_ts", "value")


def match(messages: DataFrame, connection: str, key: str, order: str, carry: str, size: int, idle_ms: int = 300_000, either_first: bool = False) -> DataFrame:
    """(connection, req, rsp) from a stream of messages with role, key, order (bigint) and carry (bigint): the bounded list matcher, with state between micro-batches.

    Within a micro-batch messages are put in order; across them the source's order holds.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        waiting = json.loads(state.get[0]) if state.exists else []
        pairs = []
        rows = pd.concat(list(batches)).sort_values(order)
        for role, k, value in zip(rows["role"], rows[key].astype(str), rows[carry].tolist()):
            opens = either_first or role == REQUEST
            if opens and len(waiting) >= size:
                waiting.pop(0)
            may = either_first or role != REQUEST
            found = next((i for i, x in enumerate(waiting) if x[0] != role and x[1] == k), None) if may else None
            if found is not None:
                mate = waiting.pop(found)[2]
                pairs.append((mate, value) if role != REQUEST else (value, mate))
            elif opens:
                waiting.append([role, k, value])
        state.update((json.dumps(waiting),))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({connection: [name[0]] * len(pairs), "req": [p[0] for p in pairs], "rsp": [p[1] for p in pairs]})

    kind = dict(messages.dtypes)[connection]
    return messages.groupBy(connection).applyInPandasWithState(step, f"{connection} {kind}, req bigint, rsp bigint", "waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def messages(segments: DataFrame, connection: str, order: str, idle_ms: int = 300_000) -> DataFrame:
    """Framing over a stream: segments with connection, role, proto, payload, capture_ns; one unfinished message a direction is kept between micro-batches."""

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        buffer = Buffer()
        if state.exists:
            held, buffer.first_ns = state.get
            data, kept, buffer.most, buffer.size, buffer.left, buffer.chunked, buffer.open = json.loads(held)
            buffer.data, buffer.kept = bytearray(b64decode(data)), bytearray(b64decode(kept))
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for proto, payload, ns in zip(rows["proto"], rows["payload"], rows["capture_ns"]):
            out.extend((*name, proto, *m) for m in buffer.feed(proto, bytes(payload), int(ns)))
        text = lambda b: b64encode(bytes(b)).decode()
        state.update((json.dumps([text(buffer.data), text(buffer.kept), buffer.most, buffer.size, buffer.left, buffer.chunked, buffer.open]), int(buffer.first_ns)))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=[connection, "role", "proto", "message", "size", "first_ns", "last_ns"])

    kind = dict(segments.dtypes)[connection]
    schema = f"{connection} {kind}, role string, proto string, message binary, size bigint, first_ns bigint, last_ns bigint"
    return segments.groupBy(connection, "role").applyInPandasWithState(step, schema, "data string, first_ns bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
