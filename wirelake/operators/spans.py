"""Trace spans of round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACEPARENT = r"^00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([^-]*)$"


def trace_id(header: Column) -> Column:
    """The trace id of a version 00 traceparent, in lower case; null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(header, TRACEPARENT, 1)), F.lit(""))


def parent_id(header: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(header, TRACEPARENT, 2)), F.lit(""))


def made_up(bytes_: int, *seed: Column) -> Column:
    """Hex ids from what identifies a round trip, so that a task that runs again makes the same ones."""
    return F.substring(F.md5(F.concat_ws("|", *[s.cast("string") for s in seed])), 1, 2 * bytes_)


def http_span(trips: DataFrame) -> DataFrame:
    """name, trace_id, span_id, parent_span_id, start_ns, end_ns, attributes of HTTP round trips with columns trip_id, method, status, url, scheme, req_bytes, rsp_bytes,
    traceparent, req_ns, rsp_ns. Without a valid traceparent both ids are made up."""
    context = F.col("traceparent")
    seed = F.col("trip_id")
    attributes = F.create_map(
        *[
            x
            for name, c in {
                "http.request.method": F.col("method"),
                "http.response.status_code": F.col("status").cast("string"),
                "http.request.size": F.col("req_bytes").cast("string"),
                "http.response.size": F.col("rsp_bytes").cast("string"),
                "url.full": F.col("url"),
                "url.scheme": F.col("scheme"),
                "network.transport": F.lit("tcp"),
                "network.protocol.name": F.lit("http"),
            }.items()
            for x in (F.lit(name), c)
        ]
    )
    return trips.select(
        F.col("method").alias("name"),
        F.coalesce(trace_id(context), made_up(16, F.lit("trace"), seed)).alias("trace_id"),
        made_up(8, F.lit("span"), seed).alias("span_id"),
        F.coalesce(parent_id(context), made_up(8, F.lit("parent"), seed)).alias("parent_span_id"),
        F.col("req_ns").alias("start_ns"),
        F.col("rsp_ns").alias("end_ns"),
        attributes.alias("attributes"),
    )


#: For each protocol the field that names its span, the attributes that are always the same, and those that come from fields.
SPAN_FIELDS = {
    "http2": ("method", {"network.transport": "tcp", "network.protocol.name": "http2", "network.protocol.version": "2.0"}, {"http.request.method": "method", "http.response.status_code": "status", "http.request.size": "req_bytes", "http.response.size": "rsp_bytes", "url.full": "path"}),
    "grpc": ("service", {"rpc.system": "grpc", "rpc.method": "POST"}, {"rpc.service": "service", "rpc.grpc.status_code": "status", "rpc.request.size": "req_bytes", "rpc.response.size": "rsp_bytes"}),
    "dns": ("question", {}, {"dns.question.type": "question_type", "dns.request.size": "req_bytes", "dns.response.size": "rsp_bytes"}),
    "redis": ("command", {"db.system.name": "redis"}, {"db.operation.name": "command", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "response.data_type": "data_type"}),
    "mysql": ("command", {"db.system.name": "mysql"}, {"db.operation.name": "command", "db.query.text": "statement", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "db.response.affected_rows": "affected_rows", "db.response.last_insert_id": "last_insert_id", "db.response.warnings": "warnings", "db.response.info": "server_status", "db.response.returned_rows": "returned_rows", "error.type": "error", "error.code": "error_code", "error.sql_state": "sql_state"}),
    "postgresql": ("command", {"db.system.name": "postgresql"}, {"db.operation.name": "command", "db.query.text": "statement", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "db.response.returned_rows": "affected_rows", "error.type": "severity", "error.code": "error_code", "error.sql_state": "error"}),
    "mongodb": ("command", {"db.system.name": "mongodb"}, {"db.operation.name": "command", "db.query.text": "command_value", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "db.namespace": "source", "db.response.status_code": "code", "db.response.ok": "ok", "error.type": "code_name"}),
    "kafka": ("api", {"messaging.name": "kafka"}, {"messaging.operation.name": "api", "messaging.operation.version": "version", "messaging.client.id": "client_id", "messaging.consumer.group.name": "group_id", "messaging.message.body.size": "rsp_bytes", "error.type": "error"}),
    "amqp": ("class_method", {"messaging.name": "amqp"}, {"messaging.operation.name": "class_method", "messaging.message.body.size": "rsp_bytes", "messaging.amqp.destination.routing_key": "routing_key", "messaging.amqp.destination.exchange_name": "exchange", "messaging.amqp.destination.queue_name": "queue_name", "error.type": "error"}),
}
#: Attributes of all protocols with the columns they come from.
PEER_FIELDS = {"server.address": "server_address", "server.port": "server_port", "network.peer.address": "client_address", "network.peer.port": "client_port"}


#: Protocols whose requests may carry a trace context, and what attributes with their header fields begin with.
HEADER_PREFIXES = {"http2": ("http.request.header.", "http.response.header."), "grpc": ("rpc.grpc.request.metadata.", "rpc.grpc.response.metadata.")}


def _header_pairs(proto: str, trips: DataFrame) -> list[Column]:
    """Attributes of header fields, named in small letters, each with a JSON list of its values; from maps of lists in req_headers and rsp_headers, where there are such."""
    out = []
    for prefix, c in zip(HEADER_PREFIXES.get(proto, ()), ("req_headers", "rsp_headers")):
        if c in trips.columns:
            pairs = F.transform(F.map_entries(c), lambda x, p=prefix: F.struct(F.concat(F.lit(p), F.lower(x["key"])).alias("key"), F.to_json(x["value"]).alias("value")))
            out.append(F.coalesce(pairs, F.array().cast("array<struct<key:string,value:string>>")))
    return out


def span(trips: DataFrame, proto: str) -> DataFrame:
    """Spans from columns named in ``SPAN_FIELDS``; fields that are null are left out. For http2 and grpc a column traceparent, if there is one, gives trace and parent where it
    is valid; there is a parent_span_id then, and it is made up without a valid context, as for HTTP/1."""
    name, fixed, fields = SPAN_FIELDS[proto]
    values = [(k, F.col(c).cast("string")) for k, c in (fields | PEER_FIELDS).items() if c in trips.columns] + [(k, F.lit(v)) for k, v in fixed.items()]
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values])
    if headers := _header_pairs(proto, trips):
        pairs = F.concat(pairs, *headers)
    seed = F.col("trip_id")
    trace, parent = made_up(16, F.lit("trace"), seed), []
    if proto in HEADER_PREFIXES:
        context = F.col("traceparent") if "traceparent" in trips.columns else F.lit(None).cast("string")
        trace = F.coalesce(trace_id(context), trace)
        parent = [F.coalesce(parent_id(context), made_up(8, F.lit("parent"), seed)).alias("parent_span_id")]
    return trips.select(
        F.col(name).alias("name"),
        trace.alias("trace_id"),
        made_up(8, F.lit("span"), seed).alias("span_id"),
        *parent,
        F.col("req_ns").alias("start_ns"),
        F.col("rsp_ns").alias("end_ns"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("attributes"),
    )
