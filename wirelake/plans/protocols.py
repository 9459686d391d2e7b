"""Metrics and spans of round trips of every protocol, from the events table; and the SQL that gives the same rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, spans
from . import config, views
from .catalogue import _RANGES, register

_N = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
#: Columns of all round trips, and of each protocol's, as expressions on events that mean the same in both engines.
COMMON = {
    "trip_id": "event_id",
    "ts": "ts",
    "secs": "value / 100",
    "req_bytes": f"{_N} * 1024",
    "rsp_bytes": f"{_N} * 20",
    "client_address": "'10.0.0.' || CAST(user_id % 4 AS STRING)",
    "server_port": f"{_N} % 3 + 8000",
    "req_ns": "event_id * 1000",
    "rsp_ns": "event_id * 1000 + 500",
}
#: A valid context on every third trip, one of another version on others.
_CONTEXT = f"CASE {_N} % 3 WHEN 0 THEN '00-' || md5('t' || CAST(event_id AS STRING)) || '-' || substr(md5('p' || CAST(event_id AS STRING)), 1, 16) || '-01' WHEN 1 THEN '01-' || md5('t') || '-00' END"
FIELDS = {
    "http2": {"traceparent": _CONTEXT, "method": "upper(event_type)", "path": f"'/p/' || CAST({_N} % 3 AS STRING)", "status_code": f"CAST(200 + {_N} % 5 AS STRING)", "status": f"CAST(200 + {_N} % 5 AS STRING)"},
    "grpc": {"traceparent": _CONTEXT, "service": "'pkg.S.' || event_type", "status_code": f"CAST(200 + {_N} % 2 AS STRING)", "status": f"CAST({_N} % 4 AS STRING)"},
    "dns": {"question": "event_type || '.test.'", "question_type": f"CASE {_N} % 2 WHEN 0 THEN 'A' ELSE 'AAAA' END"},
    "redis": {"command": "upper(event_type)", "data_type": f"CASE {_N} % 2 WHEN 0 THEN 'Integer' ELSE 'Array' END"},
    "mysql": {
        "command": f"CASE {_N} % 4 WHEN 0 THEN 'PING' ELSE 'QUERY' END",
        "statement": f"CASE WHEN {_N} % 4 > 0 THEN 'select ' || event_type END",
        "affected_rows": f"CASE WHEN {_N} % 4 < 2 THEN {_N} END",
        "last_insert_id": f"CASE WHEN {_N} % 4 < 2 THEN event_id END",
        "warnings": f"CASE WHEN {_N} % 4 < 2 THEN {_N} % 3 END",
        "server_status": f"CASE WHEN {_N} % 4 < 2 THEN 2 END",
        "returned_rows": f"CASE WHEN {_N} % 4 = 2 THEN {_N} END",
        "error": f"CASE WHEN {_N} % 4 = 3 THEN 'no such table' END",
        "error_code": f"CASE WHEN {_N} % 4 = 3 THEN 1146 END",
        "sql_state": f"CASE WHEN {_N} % 4 = 3 THEN '42S02' END",
    },
    "postgresql": {"command": f"CASE {_N} % 2 WHEN 0 THEN 'Query' ELSE 'Bind' END", "statement": "'select ' || event_type", "affected_rows": f"CASE WHEN {_N} % 3 > 0 THEN {_N} END", "severity": f"CASE WHEN {_N} % 3 = 0 THEN 'ERROR' END"},
    "mongodb": {"command": "event_type", "source": f"'db' || CAST({_N} % 5 AS STRING)", "ok": f"CASE {_N} % 7 WHEN 0 THEN 0 ELSE 1 END", "command_value": f"CASE WHEN {_N} % 2 = 0 THEN 'things' END", "code": f"CASE WHEN {_N} % 7 = 0 THEN 11000 END"},
    "kafka": {"api": f"CASE {_N} % 2 WHEN 0 THEN 'Produce' ELSE 'Fetch' END", "version": f"{_N} % 9", "client_id": "'c' || CAST(user_id % 10 AS STRING)", "group_id": f"CASE WHEN {_N} % 2 = 1 THEN 'g' END", "error": "'NoError'"},
    "amqp": {"queue_name": f"CASE WHEN {_N} % 2 = 0 THEN 'q-' || event_type END", "class": "'Basic'", "method": f"CASE {_N} % 2 WHEN 0 THEN 'Get' ELSE 'Publish' END", "class_method": f"'Basic.' || CASE {_N} % 2 WHEN 0 THEN 'Get' ELSE 'Publish' END", "routing_key": f"CASE WHEN {_N} % 2 = 1 THEN event_type END", "exchange": f"CASE WHEN {_N} % 2 = 1 THEN 'ex' END"},
}


def trips(spark: SparkSession, sf_dir: str, proto: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {c}" for c, e in (COMMON | FIELDS[proto]).items()])


#: Fixed values, for the SQL alone, which so does not follow what the operators say: labels by metric name, with the column of the trips.
WANTED_LABELS = {
    "http2": (("method", "method"), ("path", "path"), ("status_code", "status_code")),
    "grpc": (("service", "service"), ("status_code", "status_code")),
    "dns": (("question", "question"),),
    "redis": (("command", "command"),),
    "mysql": (("command", "command"),),
    "postgresql": (("command", "command"),),
    "mongodb": (("service", "command"), ("source", "source"), ("ok", "ok")),
    "kafka": (("api", "api"), ("version", "version")),
    "amqp": (("queue_name", "queue_name"), ("class", "class"), ("method", "method")),
}
#: Likewise metrics besides the common ones, as name, model, unit and column.
WANTED_METRICS = {
    "mysql": (("mysql_response_affected_rows", "counter", "", "affected_rows"), ("mysql_response_resultset_rows", "histogram", "bytes", "returned_rows")),
    "postgresql": (("postgresql_response_affected_rows", "counter", "", "affected_rows"),),
}
#: Likewise the column that names a span, and its attributes as SQL.
WANTED_SPANS = {
    "http2": ("method", {"http.request.method": "method", "http.response.status_code": "status", "http.request.size": "req_bytes", "http.response.size": "rsp_bytes", "url.full": "path", "network.transport": "'tcp'", "network.protocol.name": "'http2'", "network.protocol.version": "'2.0'"}),
    "grpc": ("service", {"rpc.system": "'grpc'", "rpc.method": "'POST'", "rpc.service": "service", "rpc.grpc.status_code": "status", "rpc.request.size": "req_bytes", "rpc.response.size": "rsp_bytes"}),
    "dns": ("question", {"dns.question.type": "question_type", "dns.request.size": "req_bytes", "dns.response.size": "rsp_bytes"}),
    "redis": ("command", {"db.system.name": "'redis'", "db.operation.name": "command", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "response.data_type": "data_type"}),
    "mysql": (
        "command",
        {
            "db.system.name": "'mysql'",
            "db.operation.name": "command",
            "db.query.text": "statement",
            "db.request.size": "req_bytes",
            "db.response.size": "rsp_bytes",
            "db.response.affected_rows": "affected_rows",
            "db.response.last_insert_id": "last_insert_id",
            "db.response.warnings": "warnings",
            "db.response.info": "server_status",
            "db.response.returned_rows": "returned_rows",
            "error.type": "error",
            "error.code": "error_code",
            "error.sql_state": "sql_state",
        },
    ),
    "postgresql": ("command", {"db.system.name": "'postgresql'", "db.operation.name": "command", "db.query.text": "statement", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "db.response.returned_rows": "affected_rows", "error.type": "severity"}),
    "mongodb": ("command", {"db.system.name": "'mongodb'", "db.operation.name": "command", "db.query.text": "command_value", "db.request.size": "req_bytes", "db.response.size": "rsp_bytes", "db.namespace": "source", "db.response.status_code": "code", "db.response.ok": "ok"}),
    "kafka": ("api", {"messaging.name": "'kafka'", "messaging.operation.name": "api", "messaging.operation.version": "version", "messaging.client.id": "client_id", "messaging.consumer.group.name": "group_id", "messaging.message.body.size": "rsp_bytes", "error.type": "error"}),
    "amqp": ("class_method", {"messaging.name": "'amqp'", "messaging.operation.name": "class_method", "messaging.message.body.size": "rsp_bytes", "messaging.amqp.destination.routing_key": "routing_key", "messaging.amqp.destination.exchange_name": "exchange", "messaging.amqp.destination.queue_name": "queue_name"}),
}


def _labels(proto: str) -> list[str]:
    return ["client.address", *metrics.LABELS[proto].values(), "server.port"]


def _trips_sql(proto: str) -> str:
    return f"trips AS (SELECT {', '.join(f'{e} AS {c}' for c, e in (COMMON | FIELDS[proto]).items())} FROM events)"


def _metrics_sql(proto: str) -> str:
    pairs = [("client_address", "client_address"), *WANTED_LABELS[proto], ("server_port", "server_port")]
    text = " || ',' || ".join(f"'{n}=' || coalesce(CAST({c} AS STRING), '')" for n, c in pairs)
    rows = [(f"{proto}_requests_total", "counter", "", "1"), (f"{proto}_request_duration_seconds", "histogram", "seconds", "secs"), (f"{proto}_request_body_bytes", "histogram", "bytes", "req_bytes"), (f"{proto}_response_body_bytes", "histogram", "bytes", "rsp_bytes"), *WANTED_METRICS.get(proto, ())]
    union = " UNION ALL ".join(f"SELECT '{n}' AS name, '{m}' AS model, '{u}' AS unit, {text} AS labels, CAST({v} AS DOUBLE) AS value FROM trips" for n, m, u, v in rows)
    return f"WITH {_trips_sql(proto)}, m AS ({union}) SELECT name, model, unit, labels, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS value FROM m WHERE value IS NOT NULL GROUP BY ALL"


def _spans_sql(proto: str) -> str:
    name, fields = WANTED_SPANS[proto]
    own = {k: f"CAST({c} AS STRING)" for k, c in (fields | {"server.port": "server_port", "network.peer.address": "client_address"}).items()}
    text = ", ".join(f"'{k}=' || {own[k]}" for k in sorted(own))
    trace = parent = ""
    if proto in ("http2", "grpc"):
        trace = ", CASE WHEN traceparent LIKE '00-%' THEN md5('t' || CAST(trip_id AS STRING)) ELSE md5('trace|' || CAST(trip_id AS STRING)) END AS trace_id"
        parent = ", substr(CASE WHEN traceparent LIKE '00-%' THEN md5('p' || CAST(trip_id AS STRING)) ELSE md5('parent|' || CAST(trip_id AS STRING)) END, 1, 16) AS parent_span_id"
    return f"WITH {_trips_sql(proto)} SELECT trip_id, {name} AS name, CAST(req_ns AS BIGINT) AS start_ns, CAST(rsp_ns AS BIGINT) AS end_ns, concat_ws(';', {text}) AS attributes{trace}{parent} FROM trips"


def metrics_of(proto: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.of_protocol(trips(spark, sf_dir, proto), proto, _labels(proto))
    agg = m.groupBy("name", "model", "unit", "labels").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value"))
    return agg.withColumn("labels", F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["value"], F.lit("")))), ","))


def spans_of(proto: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trips(spark, sf_dir, proto)
    s = spans.span(t.withColumn("trip_id", F.col("trip_id").cast("bigint")), proto)
    own = F.col("attributes")
    text = F.array_join(F.transform(F.sort_array(F.map_keys(own)), lambda k: F.concat(k, F.lit("="), own[k])), ";")
    # start_ns is the trip's number times 1000.
    return s.select((F.col("start_ns") / 1000).cast("bigint").alias("trip_id"), "name", F.col("start_ns").cast("bigint").alias("start_ns"), F.col("end_ns").cast("bigint").alias("end_ns"), text.alias("attributes"), *(["trace_id", "parent_span_id"] if "parent_span_id" in s.columns else []))


for _proto in FIELDS:
    register(f"metrics_{_proto}", _metrics_sql(_proto))(partial(metrics_of, _proto))
    register(f"spans_{_proto}", _spans_sql(_proto))(partial(spans_of, _proto))

_AT = f"(log10(value) - {metrics.DECIMAL_LOW}) * {metrics.PER_DECIMAL}"
#: The bucket of the column value.
_BUCKET = f"CASE WHEN value = 0 THEN -1 WHEN {_AT} < 0 THEN -1 WHEN {_AT} >= {metrics.LOG_BUCKETS} THEN {metrics.LOG_BUCKETS} WHEN {_AT} = floor({_AT}) AND {_AT} > 0 THEN floor({_AT}) - 1 ELSE floor({_AT}) END"
_ALL_RANGES = f"r(b, part) AS (VALUES (-1, '{metrics.LOWEST}'), {_RANGES}, ({metrics.LOG_BUCKETS}, '{metrics.HIGHEST}'))"


@register(
    "metric_dispatch_log",
    f"""WITH {_trips_sql("redis")}, {_ALL_RANGES}, m AS (
SELECT 'redis_request_duration_seconds' AS name, command, CAST(secs AS DOUBLE) AS value FROM trips
UNION ALL SELECT 'redis_request_body_bytes', command, CAST(req_bytes AS DOUBLE) FROM trips UNION ALL SELECT 'redis_response_body_bytes', command, CAST(rsp_bytes AS DOUBLE) FROM trips),
x AS (SELECT name, command, {_BUCKET} AS b FROM (SELECT name, command, CASE WHEN value = 0 THEN 1e-12 ELSE value END AS value FROM m WHERE value >= 0))
SELECT 'redis_requests_total' AS name, command, CAST(NULL AS STRING) AS part, CAST(count(*) AS DOUBLE) AS value FROM trips GROUP BY command
UNION ALL SELECT name, command, part, CAST(count(*) AS DOUBLE) FROM x JOIN r USING (b) GROUP BY name, command, part""",
)
def metric_dispatch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series by model with logarithmic buckets, as the setting asks."""
    s = config.load({"log_histogram": True, "labels": ["request.command"], "pipeline": {}})
    return config.to_series(trips(spark, sf_dir, "redis"), s, "redis").select("name", F.col("labels")[0]["value"].alias("command"), "part", "value")


@register(
    "vmrange_quantile_p95",
    f"""WITH {_trips_sql("redis")}, x AS (SELECT command, {_BUCKET} AS b FROM (SELECT command, CASE WHEN secs = 0 THEN 1e-12 ELSE CAST(secs AS DOUBLE) END AS value FROM trips WHERE secs >= 0)),
c AS (SELECT command, b, count(*) AS n FROM x GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY command ORDER BY b) AS upto, sum(n) OVER (PARTITION BY command) AS total FROM c),
e AS (SELECT *, CASE WHEN b < 0 THEN 0 ELSE pow(10, {metrics.DECIMAL_LOW} + b / {metrics.PER_DECIMAL}) END AS low, pow(10, {metrics.DECIMAL_LOW} + (b + 1) / {metrics.PER_DECIMAL}) AS high FROM s WHERE upto >= 0.95 * total AND upto - n < 0.95 * total)
SELECT command, round(CAST(low + (high - low) * (0.95 * total - (upto - n)) / n AS DOUBLE), 9) AS value FROM e""",
)
def vmrange_quantile_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = metrics.log_histogram(trips(spark, sf_dir, "redis"), ["command"], "secs")
    return metrics.log_quantile(buckets, ["command"], 0.95).select("command", F.round("value", 9).alias("value"))
