"""Where results go: JSON lines, metric text, remote-write and trace requests. Requests are made and sent by the tasks that hold the rows."""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics

Post = Callable[[bytes, dict[str, str]], int]


def json_lines(trips: DataFrame, path: str) -> None:
    """One JSON object a line."""
    trips.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def metric_text(series: DataFrame) -> DataFrame:
    """(line) in the text format, in no order."""
    return series.select(metrics.prometheus_line(F.col("name"), F.col("labels"), F.col("value")).alias("line"))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def write_request(series: list[tuple[list[tuple[str, str]], float, int]]) -> bytes:
    """The protobuf message of (labels, value, time in ms) rows."""
    out = b""
    for labels, value, ms in series:
        own = b"".join(_field(1, _field(1, k.encode()) + _field(2, v.encode())) for k, v in labels)
        sample = b"\x09" + struct.pack("<d", value) + b"\x10" + _varint(ms & (1 << 64) - 1)
        out += _field(1, own + _field(2, sample))
    return out


def _grouped(batches: Iterator[pd.DataFrame], rows: int, seconds: float) -> Iterator[list[dict]]:
    """Rows in groups of ``rows``, across batches; a group that has waited for ``seconds`` goes with what it has."""
    held: list[dict] = []
    since = time.monotonic()
    for b in batches:
        for r in b.to_dict("records"):
            if not held:
                since = time.monotonic()
            held.append(r)
            if len(held) >= rows or time.monotonic() - since >= seconds:
                yield held
                held = []
    if held:
        yield held


def remote_write(series: DataFrame, post: Post, rows: int = 5000, seconds: float = 5.0) -> DataFrame:
    """(status, series) of each request; rows of (labels, sample_value, sample_ms), up to ``rows`` of them in a request, snappy-compressed. Nothing is sent twice by
    design of the sender; a task that runs again sends its rows again, which remote write takes as the same samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _grouped(batches, rows, seconds):
            message = write_request([([(x["name"], x["value"] or "") for x in r["labels"]], float(r["sample_value"]), int(r["sample_ms"])) for r in part])
            body = pa.compress(message, codec="snappy", asbytes=True)
            status = post(body, {"Content-Type": "application/x-protobuf", "Content-Encoding": "snappy", "X-Prometheus-Remote-Write-Version": "0.1.0"})
            yield pd.DataFrame({"status": [status], "series": [len(part)]})

    return series.select("labels", "sample_value", "sample_ms").mapInPandas(run, "status int, series long")


#: Attributes that are whole numbers, by the end of their names.
WHOLE = (".size", ".port", ".affected_rows", ".returned_rows", ".last_insert_id", ".warnings", ".info", "error.code", "db.response.ok")
#: How the names of attributes begin that hold lists of texts.
LISTS = ("http.request.header.", "http.response.header.", "rpc.grpc.request.metadata.", "rpc.grpc.response.metadata.")


def attribute(key: str, value: str) -> dict:
    """An attribute with the type that its name asks for; a text where the value is not of that type."""
    if key.endswith(WHOLE) and value.lstrip("-").isdigit():
        return {"key": key, "value": {"intValue": value}}
    if key.startswith(LISTS) and value.startswith("["):
        return {"key": key, "value": {"arrayValue": {"values": [{"stringValue": x} for x in json.loads(value)]}}}
    return {"key": key, "value": {"stringValue": value}}


def trace_request(spans: list[dict], service: str) -> bytes:
    """Spans as an OTLP/HTTP request in JSON."""
    resource = {"attributes": [{"key": k, "value": {"stringValue": v}} for k, v in {"service.name": service, "telemetry.sdk.name": "wirelake", "telemetry.sdk.language": "python"}.items()]}
    body = [
        {
            "traceId": s["trace_id"],
            "spanId": s["span_id"],
            "parentSpanId": s.get("parent_span_id") or "",
            "name": s["name"],
            "startTimeUnixNano": str(s["start_ns"]),
            "endTimeUnixNano": str(s["end_ns"]),
            "attributes": [attribute(k, v) for k, v in sorted(dict(s["attributes"]).items()) if v is not None],
        }
        for s in spans
    ]
    return json.dumps({"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": body}]}]}).encode()


def otlp(spans: DataFrame, post: Post, service: str = "wirelake", rows: int = 100, seconds: float = 3.0) -> DataFrame:
    """(status, spans) of each request of up to ``rows`` spans, or those of ``seconds``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _grouped(batches, rows, seconds):
            yield pd.DataFrame({"status": [post(trace_request(part, service), {"Content-Type": "application/json"})], "spans": [len(part)]})

    return spans.mapInPandas(run, "status int, spans long")
