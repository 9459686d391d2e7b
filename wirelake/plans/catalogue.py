"""The registered queries and, for each, the SQL that gives the same rows."""

from __future__ import annotations

import functools

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, l4, matching, metrics, spans
from . import config, views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_K = "CAST(regexp_extract(props, '[0-9]+') AS INT)"
_STATUS = f"CASE {_K} % 5 WHEN 0 THEN '500' WHEN 1 THEN '404' WHEN 2 THEN '302' ELSE '200' END"
_TRIPS = f"trips AS (SELECT event_id AS trip_id, ts, user_id AS client, event_type AS method, {_STATUS} AS status, value / 100 AS secs, {_K} * 1024 AS req_bytes, value * 20000 AS rsp_bytes, {_K} AS k FROM events)"
_MESSAGES = f"messages AS (SELECT user_id AS conn, {_K} % 4 AS key, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'Request' ELSE 'Response' END AS role FROM events WHERE event_type <> 'signup')"
_ARRIVAL = ", ".join(views.ARRIVAL)
_SEGMENTS = f"segments AS (SELECT l_orderkey AS conn, {_ARRIVAL}, CAST((l_linenumber - 1) * 25 AS BIGINT) AS seq, CAST(l_quantity AS INT) AS len, l_returnflag = 'R' AS fin FROM lineitem)"
_CURSOR = f"""{_SEGMENTS},
c0 AS (SELECT *, coalesce(max(CAST(fin AS INT)) OVER (PARTITION BY conn ORDER BY {_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS closed FROM segments),
c1 AS (SELECT *, coalesce(max(CASE WHEN NOT closed AND len > 0 THEN seq + len END) OVER (PARTITION BY conn ORDER BY {_ARRIVAL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM c0),
cursored AS (SELECT *, NOT closed AND len > 0 AND reached >= seq + len AS skip,
  CASE WHEN NOT closed AND len > 0 AND reached < seq + len THEN greatest(0, reached - seq) END AS trim,
  NOT closed AND len > 0 AND reached < seq + len AND reached > 0 AND reached < seq AS gap FROM c1)"""
_PORT = f"CASE {_K} % 5 WHEN 0 THEN 80 WHEN 1 THEN 3306 WHEN 2 THEN 53 WHEN 3 THEN 6379 ELSE 9999 END"
_CLIENT = "'10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR)"
_PACKETS = f"""packets AS (SELECT event_id AS packet_no, ts, CASE WHEN {_K} % 5 = 2 THEN 'udp' ELSE 'tcp' END AS l4, CASE WHEN {_K} % 7 = 0 THEN 6 ELSE 4 END AS ip_version,
  CASE WHEN event_id % 2 = 0 THEN {_CLIENT} ELSE '10.9.9.9' END AS src_ip, CASE WHEN event_id % 2 = 0 THEN '10.9.9.9' ELSE {_CLIENT} END AS dst_ip,
  CAST(CASE WHEN event_id % 2 = 0 THEN 40000 + user_id ELSE {_PORT} END AS INT) AS src_port, CAST(CASE WHEN event_id % 2 = 0 THEN {_PORT} ELSE 40000 + user_id END AS INT) AS dst_port, {_K} * 10 AS len FROM events)"""
RULES = (filters.Rule("http", (80, 8080)), filters.Rule("mysql", (3306,)), filters.Rule("dns", (53,)), filters.Rule("redis", (6379,), "10.9.9.9"))
_ROUTES = "CASE {p} WHEN 80 THEN 'http' WHEN 8080 THEN 'http' WHEN 3306 THEN 'mysql' WHEN 53 THEN 'dns' WHEN 6379 THEN 'redis' END"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = views.round_trips(spark, sf_dir)
    names = metrics.labels([("method", F.col("method")), ("status_code", F.col("status"))])
    return metrics.unpivot(trips, "http", names, F.col("secs"), F.col("req_bytes"), F.col("rsp_bytes"))


# Counters, gauges, histograms


@register("counter_by_label", f"WITH {_TRIPS} SELECT method, status, CAST(count(*) AS BIGINT) AS requests FROM trips GROUP BY method, status")
def counter_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = views.round_trips(spark, sf_dir).withColumn("one", F.lit(1).cast("bigint"))
    return metrics.counter(trips, ["method", "status"], "one").withColumnRenamed("value", "requests")


@register("counter_affected_rows", f"WITH {_TRIPS} SELECT method, CAST(sum(k) AS BIGINT) AS affected FROM trips WHERE status = '200' GROUP BY method")
def counter_affected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counter(views.round_trips(spark, sf_dir).where("status = '200'"), ["method"], "k").withColumnRenamed("value", "affected")


@register(
    "counter_series_text",
    f"""WITH {_TRIPS} SELECT 'http_requests_total' AS name, 'method="' || method || '",status_code="' || status || '"' AS labels, CAST(count(*) AS DOUBLE) AS value FROM trips GROUP BY method, status""",
)
def counter_series_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = metrics.counter(_labelled(spark, sf_dir).where("model = 'counter'"), ["name", "labels"])
    shown = F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit('="'), x["value"], F.lit('"'))), ",")
    return series.select("name", shown.alias("labels"), "value")


@register("gauge_last", f"WITH {_TRIPS} SELECT method, status, arg_max(secs, ts) AS last_secs FROM trips GROUP BY method, status")
def gauge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gauge(views.round_trips(spark, sf_dir), ["method", "status"], ["ts", "trip_id"], "secs").withColumnRenamed("value", "last_secs")


def _hist_sql(value: str, unit: str) -> str:
    bounds = ", ".join(f"({b!r}::DOUBLE, '{metrics.bound_text(b)}')" for b in metrics.BOUNDS[unit]) + ", ('Infinity'::DOUBLE, '+Inf')"
    return f"WITH {_TRIPS}, b(bound, le) AS (VALUES {bounds}) SELECT method, le, CAST(sum(CASE WHEN {value} <= bound THEN 1 ELSE 0 END) AS BIGINT) AS count FROM trips CROSS JOIN b GROUP BY method, le"


@register("hist_seconds_cumulative", _hist_sql("secs", "seconds"))
def hist_seconds_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(views.round_trips(spark, sf_dir), ["method"], "secs", "seconds").select("method", "le", "count")


@register("hist_bytes_cumulative", _hist_sql("req_bytes", "bytes"))
def hist_bytes_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(views.round_trips(spark, sf_dir), ["method"], "req_bytes", "bytes").select("method", "le", "count")


@register("hist_response_bytes", _hist_sql("rsp_bytes", "bytes"))
def hist_response_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(views.round_trips(spark, sf_dir), ["method"], "rsp_bytes", "bytes").select("method", "le", "count")


@register("hist_sum_count", f"WITH {_TRIPS} SELECT method, CAST(count(*) AS BIGINT) AS total, round(sum(secs), 4) AS sum FROM trips GROUP BY method")
def hist_sum_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = metrics.histogram(views.round_trips(spark, sf_dir), ["method"], "secs", "")
    return h.select("method", "total", F.round("sum", 4).alias("sum"))


_IDX = "(log10(secs) + 9) * 18"
_RANGES = ", ".join(f"({i}, '{r}')" for i, r in enumerate(metrics.log_ranges()))


@register(
    "vmrange_hist",
    f"""WITH {_TRIPS}, r(b, vmrange) AS (VALUES (-1, '{metrics.LOWEST}'), {_RANGES}, ({metrics.LOG_BUCKETS}, '{metrics.HIGHEST}')),
x AS (SELECT method, CASE WHEN secs = 0 THEN -1 WHEN {_IDX} < 0 THEN -1 WHEN {_IDX} >= {metrics.LOG_BUCKETS} THEN {metrics.LOG_BUCKETS} WHEN {_IDX} = floor({_IDX}) AND {_IDX} > 0 THEN floor({_IDX}) - 1 ELSE floor({_IDX}) END AS b
 FROM (SELECT method, CASE WHEN secs = 0 THEN NULL ELSE secs END AS secs FROM trips WHERE secs > 0))
SELECT method, vmrange, CAST(count(*) AS BIGINT) AS count FROM x JOIN r USING (b) GROUP BY method, vmrange""",
)
def vmrange_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = views.round_trips(spark, sf_dir).where("secs > 0")
    return metrics.log_histogram(trips, ["method"], "secs").select("method", "vmrange", "count")


@register(
    "metrics_unpivot",
    f"""WITH {_TRIPS}, m AS (
SELECT 'http_requests_total' AS name, 'counter' AS model, '' AS unit, method, status, CAST(1 AS DOUBLE) AS value FROM trips
UNION ALL SELECT 'http_request_duration_seconds', 'histogram', 'seconds', method, status, secs FROM trips
UNION ALL SELECT 'http_request_body_bytes', 'histogram', 'bytes', method, status, req_bytes FROM trips
UNION ALL SELECT 'http_response_body_bytes', 'histogram', 'bytes', method, status, rsp_bytes FROM trips)
SELECT name, model, unit, method, status, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS value FROM m GROUP BY ALL""",
)
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _labelled(spark, sf_dir)
    agg = m.groupBy("name", "model", "unit", "labels").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("value"))
    return agg.select("name", "model", "unit", F.col("labels")[0]["value"].alias("method"), F.col("labels")[1]["value"].alias("status"), "n", "value")


@register(
    "series_expiry",
    f"""WITH {_TRIPS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY client, method ORDER BY ts)) > 300000000 THEN 1 ELSE 0 END AS fresh FROM trips),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY client, method ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT client, method, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS value FROM s GROUP BY client, method, session""",
)
def series_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.expire(views.round_trips(spark, sf_dir), ["client", "method"], "ts")


# Matching

_SINGLE = """t AS (SELECT *, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS turn, lead(role) OVER w AS nxt, lead({id}) OVER w AS rsp_id FROM m WINDOW w AS (PARTITION BY conn ORDER BY {order})),
r AS (SELECT *, sum(turn) OVER (PARTITION BY conn ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY conn, run ORDER BY {order}) AS place FROM r)
SELECT conn, {id} AS req_{id}, rsp_id AS rsp_{id} FROM p WHERE role = 'Request' AND nxt = 'Response' AND place % 2 = 1"""


@register(
    "match_single",
    "WITH m AS (SELECT conv_id AS conn, turn AS seq, CASE role WHEN 'user' THEN 'Request' ELSE 'Response' END AS role FROM conversations WHERE role IN ('user', 'assistant')), " + _SINGLE.format(id="seq", order="seq"),
)
def match_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.single(views.conversation_messages(spark, sf_dir), ["conn"], ["seq"], ["seq"])


@register("match_single_events", f"WITH {_MESSAGES}, m AS (SELECT * FROM messages), " + _SINGLE.format(id="event_id", order="ts, event_id"))
def match_single_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.single(views.event_messages(spark, sf_dir), ["conn"], ["ts", "event_id"], ["event_id"])


_OPEN = f"""{_MESSAGES}, s AS (SELECT *, sum(CASE role WHEN 'Request' THEN 1 ELSE -1 END) OVER (PARTITION BY conn, key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total FROM messages),
l AS (SELECT *, coalesce(min(total) OVER (PARTITION BY conn, key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM s),
kept AS (SELECT *, row_number() OVER (PARTITION BY conn, key, role ORDER BY ts, event_id) AS j FROM l WHERE NOT (role = 'Response' AND total < least(0, low)))"""
_PAIRED = "SELECT a.conn, a.key, a.event_id AS req_event_id, b.event_id AS rsp_event_id FROM {t} a JOIN {t} b ON a.conn = b.conn AND a.key = b.key AND a.j = b.j AND a.role = 'Request' AND b.role = 'Response'"


@register("match_list", f"WITH {_OPEN} " + _PAIRED.format(t="kept"))
def match_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.by_key(views.event_messages(spark, sf_dir), ["conn", "key"], ["ts", "event_id"], ["event_id"])


@register("match_fuzzy", f"WITH {_MESSAGES}, f AS (SELECT *, row_number() OVER (PARTITION BY conn, key, role ORDER BY ts, event_id) AS j FROM messages) " + _PAIRED.format(t="f"))
def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fuzzy(views.event_messages(spark, sf_dir), ["conn", "key"], ["ts", "event_id"], ["event_id"])


@register(
    "unanswered_requests",
    f"WITH {_OPEN} SELECT a.conn, a.key, a.event_id FROM kept a LEFT JOIN kept b ON a.conn = b.conn AND a.key = b.key AND a.j = b.j AND b.role = 'Response' WHERE a.role = 'Request' AND b.role IS NULL",
)
def unanswered_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.unanswered(views.event_messages(spark, sf_dir), ["conn", "key"], ["ts", "event_id"], ["event_id"])


@register("match_evict")
def match_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of four: connections that cannot overflow by window functions, the others by the fold."""
    marked = matching.mark_overflow(views.event_messages(spark, sf_dir), ["conn"], "key", ["ts", "event_id"], 4)
    safe = matching.by_key(marked.where("NOT overflow"), ["conn", "key"], ["ts", "event_id"], ["event_id"]).select("conn", F.col("req_event_id").alias("req"), F.col("rsp_event_id").alias("rsp"))
    return safe.unionByName(matching.bounded(marked.where("overflow"), ["conn"], "key", ["ts", "event_id"], 4, "event_id"))


@register("match_fuzzy_evict")
def match_fuzzy_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As match_evict, where either side may come first."""
    marked = matching.mark_fuzzy_overflow(views.event_messages(spark, sf_dir), ["conn"], "key", ["ts", "event_id"], 4)
    safe = matching.fuzzy(marked.where("NOT overflow"), ["conn", "key"], ["ts", "event_id"], ["event_id"]).select("conn", F.col("req_event_id").alias("req"), F.col("rsp_event_id").alias("rsp"))
    return safe.unionByName(matching.bounded(marked.where("overflow"), ["conn"], "key", ["ts", "event_id"], 4, "event_id", either_first=True))


_AMQP = f"""a AS (SELECT user_id AS conn, {_K} % 3 AS channel, 'Basic' AS class, ts, event_id, CASE event_type WHEN 'view' THEN 'Publish' WHEN 'click' THEN 'Get' WHEN 'purchase' THEN 'Get-Ok' WHEN 'error' THEN 'Ack' ELSE 'Publish-Ok' END AS method FROM events),
r AS (SELECT *, CASE WHEN method LIKE '%-Ok' OR method IN ('Ack', 'Nack', 'Reject') THEN 'Response' ELSE 'Request' END AS role, CASE WHEN channel = 0 THEN regexp_replace(method, '-Ok$', '') ELSE '' END AS asked FROM a),
j AS (SELECT *, row_number() OVER (PARTITION BY conn, channel, asked, role ORDER BY ts, event_id) AS j FROM r)"""


@register(
    "match_amqp",
    f"WITH {_AMQP} SELECT a.conn, a.channel, a.class, a.event_id AS req_event_id, b.event_id AS rsp_event_id FROM j a JOIN j b ON a.conn = b.conn AND a.channel = b.channel AND a.asked = b.asked AND a.j = b.j AND a.role = 'Request' AND b.role = 'Response'",
)
def match_amqp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.amqp(_amqp_frames(spark, sf_dir), ["conn"], ["ts", "event_id"], ["event_id"])


def _amqp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    method = F.when(t == "view", "Publish").when(t == "click", "Get").when(t == "purchase", "Get-Ok").when(t == "error", "Ack").otherwise("Publish-Ok")
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("conn"), (views.number() % 3).alias("channel"), F.lit("Basic").alias("class"), method.alias("method"), "ts", "event_id")


@register(
    "match_amqp_sides",
    f"""WITH {_AMQP}, s AS (SELECT conn, channel, class, method, asked, event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'Request' ELSE 'Response' END AS side, role = 'Response' AS answers FROM r),
f AS (SELECT *, row_number() OVER (PARTITION BY conn, channel, asked, side ORDER BY ts, event_id) AS j FROM s)
SELECT a.conn, a.channel, a.class, CASE WHEN a.answers THEN b.event_id ELSE a.event_id END AS req_event_id, CASE WHEN a.answers THEN a.event_id ELSE b.event_id END AS rsp_event_id
FROM f a JOIN f b ON a.conn = b.conn AND a.channel = b.channel AND a.asked = b.asked AND a.j = b.j AND a.side = 'Request' AND b.side = 'Response'""",
)
def match_amqp_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As match_amqp, with the side that speaks: even events are the client's."""
    side = F.when(F.col("event_id") % 2 == 0, matching.REQUEST).otherwise(matching.RESPONSE)
    return matching.amqp(_amqp_frames(spark, sf_dir).withColumn("role", side), ["conn"], ["ts", "event_id"], ["event_id"])


# Transport


@register(
    "tcp_cursor",
    f"WITH {_CURSOR} SELECT conn, seq, len, fin, l_partkey, l_suppkey, closed, skip, CAST(trim AS BIGINT) AS trim, gap, CAST(CASE WHEN trim IS NOT NULL THEN len - trim ELSE 0 END AS BIGINT) AS delivered FROM cursored",
)
def tcp_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = l4.cursor(views.segments(spark, sf_dir), ["conn"], views.ARRIVAL)
    return c.select("conn", "seq", "len", "fin", "l_partkey", "l_suppkey", "closed", "skip", F.col("trim").cast("bigint").alias("trim"), "gap", F.col("delivered").cast("bigint").alias("delivered"))


_ONE = f"segments AS (SELECT 1 AS conn, l_orderkey, {_ARRIVAL}, CAST((l_orderkey * 40 + (l_linenumber - 1) * 25) % 1000000 + CASE WHEN l_orderkey % 50000 = 3 THEN 4293967000 ELSE 0 END AS BIGINT) AS seq, CAST(l_quantity AS INT) AS len, false AS fin FROM lineitem)"


@register(
    "tcp_cursor_one_connection",
    f"WITH {_CURSOR.replace(_SEGMENTS, _ONE).replace(f'ORDER BY {_ARRIVAL}', f'ORDER BY l_orderkey, {_ARRIVAL}')} SELECT l_orderkey, l_linenumber, seq, len, closed, skip, CAST(trim AS BIGINT) AS trim, gap, CAST(CASE WHEN trim IS NOT NULL THEN len - trim ELSE 0 END AS BIGINT) AS delivered FROM cursored",
)
def tcp_cursor_one_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments are of one connection, which is gone through in stretches."""
    k = F.col("l_orderkey")
    seq = (k * 40 + (F.col("l_linenumber") - 1) * 25) % 1_000_000 + F.when(k % 50_000 == 3, 4_293_967_000).otherwise(0)
    rows = views.table(spark, sf_dir, "lineitem").select(F.lit(1).alias("conn"), "l_orderkey", *views.ARRIVAL, seq.cast("bigint").alias("seq"), F.col("l_quantity").cast("int").alias("len"), F.lit(False).alias("fin"))
    c = l4.cursor_by_stretch(rows, ["conn"], ["l_orderkey", *views.ARRIVAL], F.floor(k / 1000))
    return c.select("l_orderkey", "l_linenumber", "seq", "len", "closed", "skip", F.col("trim").cast("bigint").alias("trim"), "gap", F.col("delivered").cast("bigint").alias("delivered"))


@register(
    "l4_stats",
    f"WITH {_CURSOR} SELECT conn, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes, CAST(sum(CAST(skip AS INT)) AS BIGINT) AS skipped FROM cursored WHERE NOT closed GROUP BY conn",
)
def l4_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l4.statistics(l4.cursor(views.segments(spark, sf_dir), ["conn"], views.ARRIVAL), ["conn"])


@register(
    "l4_metrics_by_port",
    f"WITH {_PACKETS} SELECT l4, dst_port, CAST(count(*) AS BIGINT) AS packets, CAST(sum(len) AS BIGINT) AS bytes FROM packets WHERE dst_port < 10000 GROUP BY l4, dst_port",
)
def l4_metrics_by_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.packets(spark, sf_dir).where("dst_port < 10000")
    return p.groupBy("l4", "dst_port").agg(F.count("*").alias("packets"), F.sum(F.col("len").cast("bigint")).alias("bytes"))


@register("fin_close", f"WITH {_CURSOR} SELECT conn, CAST(count(*) AS BIGINT) AS refused FROM cursored WHERE closed GROUP BY conn")
def fin_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l4.cursor(views.segments(spark, sf_dir), ["conn"], views.ARRIVAL).where("closed").groupBy("conn").agg(F.count("*").alias("refused"))


@register(
    "conn_closed",
    f"""WITH {_SEGMENTS}, o AS (SELECT conn, fin, row_number() OVER (PARTITION BY conn ORDER BY {_ARRIVAL}) AS i FROM segments),
g AS (SELECT *, i - row_number() OVER (PARTITION BY conn, fin ORDER BY i) AS run FROM o),
p AS (SELECT *, CASE WHEN fin THEN row_number() OVER (PARTITION BY conn, fin, run ORDER BY i) ELSE 0 END AS place FROM g),
r AS (SELECT *, coalesce(lag(place) OVER (PARTITION BY conn ORDER BY i), 0) % 2 = 1 AS refused FROM p),
e AS (SELECT *, coalesce(sum(CAST(refused AS INT)) OVER (PARTITION BY conn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM r)
SELECT conn, CAST(epoch AS BIGINT) AS epoch, CAST(count(*) FILTER (WHERE NOT refused) AS BIGINT) AS packets, CAST(count(*) FILTER (WHERE refused) AS BIGINT) AS refused FROM e GROUP BY conn, epoch""",
)
def conn_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections that a segment after the fin ends, and those that follow them."""
    s = views.segments(spark, sf_dir).select("conn", *views.ARRIVAL, "fin", F.lit(0).alias("side"))
    e = l4.closing_epochs(s, ["conn"], "side", views.ARRIVAL)
    return e.groupBy("conn", "epoch").agg(F.count_if(~F.col("refused")).alias("packets"), F.count_if("refused").alias("refused"))


_EPOCHS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 300000000 THEN 1 ELSE 0 END AS fresh FROM events),
e AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM g),
c AS (SELECT user_id, CAST(epoch AS BIGINT) AS epoch, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) AS BIGINT) AS packets FROM e GROUP BY user_id, epoch)"""


def _connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = l4.idle_epochs(views.table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"])
    return l4.connections(e, ["user_id"], "ts")


@register("conn_expired", f"WITH {_EPOCHS} SELECT user_id, epoch, first_ts, last_ts, packets FROM c")
def conn_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _connections(spark, sf_dir)


@register(
    "active_conns",
    f"WITH {_EPOCHS}, h AS (SELECT DISTINCT user_id, epoch, unnest(generate_series(date_trunc('hour', first_ts), date_trunc('hour', last_ts), INTERVAL 1 HOUR)) AS hour FROM c) SELECT hour, CAST(count(*) AS BIGINT) AS active FROM h GROUP BY hour",
)
def active_conns(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = F.sequence(F.date_trunc("hour", "first_ts"), F.date_trunc("hour", "last_ts"), F.expr("INTERVAL 1 HOUR"))
    c = _connections(spark, sf_dir).select("user_id", "epoch", F.explode(hours).alias("hour"))
    return c.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("active"))


@register(
    "frozen_tuples",
    """WITH w AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)
SELECT event_id, user_id, coalesce(us - last <= 120000000, false) AS frozen FROM w""",
)
def frozen_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = l4.frozen(views.table(spark, sf_dir, "events"), ["user_id"], "ts", ["ts", "event_id"], F.col("event_type") == "error")
    return e.select("event_id", "user_id", "frozen")


# Filters


@register(
    "filter_bpf",
    f"WITH {_PACKETS} SELECT packet_no, l4, src_port, dst_port FROM packets WHERE (l4 = 'tcp' AND (src_port IN (80, 8080) OR dst_port IN (80, 8080))) OR (l4 = 'tcp' AND (src_port = 3306 OR dst_port = 3306)) OR (l4 = 'udp' AND (src_port = 53 OR dst_port = 53)) OR (l4 = 'tcp' AND (src_port = 6379 OR dst_port = 6379) AND (src_ip = '10.9.9.9' OR dst_ip = '10.9.9.9'))",
)
def filter_bpf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).where(filters.rule_predicate(RULES)).select("packet_no", "l4", "src_port", "dst_port")


@register("ipv_pick", f"WITH {_PACKETS} SELECT packet_no, src_ip FROM packets WHERE ip_version = 6")
def ipv_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).where(filters.ip_version_predicate("v6")).select("packet_no", "src_ip")


_ROUTED = f"routed AS (SELECT *, coalesce({_ROUTES.format(p='src_port')}, {_ROUTES.format(p='dst_port')}) AS proto, CASE WHEN {_ROUTES.format(p='src_port')} IS NOT NULL THEN src_port ELSE dst_port END AS server_port FROM packets)"


@register(
    "route_port",
    f"WITH {_PACKETS}, {_ROUTED} SELECT packet_no, proto, server_port, CASE WHEN dst_port = server_port THEN 'Request' ELSE 'Response' END AS role FROM routed WHERE proto IS NOT NULL",
)
def route_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.route(views.packets(spark, sf_dir), RULES).select("packet_no", "proto", "server_port", filters.role().alias("role"))


@register(
    "connection_ids",
    f"WITH {_PACKETS}, x AS (SELECT src_ip || ':' || src_port AS a, dst_ip || ':' || dst_port AS b FROM packets) SELECT least(a, b) || '-' || greatest(a, b) AS conn_id, CAST(count(*) AS BIGINT) AS packets FROM x GROUP BY ALL",
)
def connection_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.packets(spark, sf_dir).groupBy(l4.connection_id().alias("conn_id")).agg(F.count("*").alias("packets"))


@register(
    "validate_rt",
    f"WITH {_OPEN}, p AS ({_PAIRED.format(t='kept')}) SELECT p.conn, p.req_event_id, p.rsp_event_id, (epoch_us(b.ts) - epoch_us(a.ts)) * 1000 AS duration_ns FROM p JOIN events a ON a.event_id = p.req_event_id JOIN events b ON b.event_id = p.rsp_event_id WHERE b.ts > a.ts",
)
def validate_rt(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = views.event_messages(spark, sf_dir).withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    pairs = matching.by_key(m, ["conn", "key"], ["ts", "event_id"], ["event_id", "ns"]).withColumnsRenamed({"req_ns": "req_ns", "rsp_ns": "rsp_ns"})
    return pairs.where(filters.valid_round_trip()).select("conn", "req_event_id", "rsp_event_id", (F.col("rsp_ns") - F.col("req_ns")).alias("duration_ns"))


# Rates and quantiles


@register("rate_1m", f"WITH {_TRIPS} SELECT date_trunc('minute', ts) AS window_start, method, status, count(*) / 60.0 AS rate FROM trips GROUP BY ALL")
def rate_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.rate(views.round_trips(spark, sf_dir), ["method", "status"], "ts")
    return r.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "method", "status", "rate")


_QUANTILE = """q AS (SELECT {by}, bound, count, coalesce(lag(count) OVER w, 0) AS below, coalesce(lag(bound) OVER w, 0.0) AS low, max(count) OVER (PARTITION BY {by}) AS total FROM h WINDOW w AS (PARTITION BY {by} ORDER BY bound)),
v AS (SELECT {by}, CASE WHEN isinf(bound) THEN low ELSE low + (bound - low) * ((0.95 * total - below) / (count - below)) END AS value FROM q WHERE count >= 0.95 * total AND below < 0.95 * total)"""


def _quantile_sql(value: str, unit: str) -> str:
    bounds = ", ".join(f"({b!r}::DOUBLE)" for b in metrics.BOUNDS[unit]) + ", ('Infinity'::DOUBLE)"
    return f"WITH {_TRIPS}, b(bound) AS (VALUES {bounds}), h AS (SELECT method, status, bound, CAST(sum(CASE WHEN {value} <= bound THEN 1 ELSE 0 END) AS DOUBLE) AS count FROM trips CROSS JOIN b GROUP BY ALL), {_QUANTILE.format(by='method, status')} SELECT method, status, round(value, 6) AS p95 FROM v"


def _p95(spark: SparkSession, sf_dir: str, value: str, unit: str) -> DataFrame:
    h = metrics.histogram(views.round_trips(spark, sf_dir), ["method", "status"], value, unit)
    return metrics.quantile(h, ["method", "status"], 0.95, metrics.BOUNDS[unit]).select("method", "status", F.round("value", 6).alias("p95"))


@register("hist_quantile_p95", _quantile_sql("secs", "seconds"))
def hist_quantile_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p95(spark, sf_dir, "secs", "seconds")


@register("hist_quantile_request_bytes", _quantile_sql("req_bytes", "bytes"))
def hist_quantile_request_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p95(spark, sf_dir, "req_bytes", "bytes")


@register("hist_quantile_response_bytes", _quantile_sql("rsp_bytes", "bytes"))
def hist_quantile_response_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p95(spark, sf_dir, "rsp_bytes", "bytes")


# Spans, text and JSON

_PARENT = "CASE WHEN k % 3 = 0 THEN '00-' || md5('t' || CAST(trip_id AS VARCHAR)) || '-' || substr(md5('p' || CAST(trip_id AS VARCHAR)), 1, 16) || '-01' WHEN k % 3 = 1 THEN '01-' || md5('t') || '-00' ELSE NULL END"


def _traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = views.round_trips(spark, sf_dir)
    own = F.concat(F.lit("00-"), F.md5(F.concat(F.lit("t"), F.col("trip_id").cast("string"))), F.lit("-"), F.substring(F.md5(F.concat(F.lit("p"), F.col("trip_id").cast("string"))), 1, 16), F.lit("-01"))
    bad = F.concat(F.lit("01-"), F.md5(F.lit("t")), F.lit("-00"))
    return trips.withColumn("traceparent", F.when(F.col("k") % 3 == 0, own).when(F.col("k") % 3 == 1, bad))


@register(
    "traceparent_parse",
    f"WITH {_TRIPS}, t AS (SELECT trip_id, {_PARENT} AS h FROM trips) SELECT trip_id, nullif(lower(regexp_extract(h, '^00-([0-9a-fA-F]{{32}})-([0-9a-fA-F]{{16}})-([^-]*)$', 1)), '') AS trace_id, nullif(lower(regexp_extract(h, '^00-([0-9a-fA-F]{{32}})-([0-9a-fA-F]{{16}})-([^-]*)$', 2)), '') AS parent_id FROM t",
)
def traceparent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("traceparent")
    return _traced(spark, sf_dir).select("trip_id", spans.trace_id(h).alias("trace_id"), spans.parent_id(h).alias("parent_id"))


@register(
    "span_projection",
    f"""WITH {_TRIPS}, t AS (SELECT *, {_PARENT} AS h FROM trips)
SELECT method AS name, CASE WHEN k % 3 = 0 THEN md5('t' || CAST(trip_id AS VARCHAR)) ELSE md5('trace|' || CAST(trip_id AS VARCHAR)) END AS trace_id, substr(md5('span|' || CAST(trip_id AS VARCHAR)), 1, 16) AS span_id,
CASE WHEN k % 3 = 0 THEN substr(md5('p' || CAST(trip_id AS VARCHAR)), 1, 16) ELSE substr(md5('parent|' || CAST(trip_id AS VARCHAR)), 1, 16) END AS parent_span_id,
epoch_us(ts) * 1000 AS start_ns, epoch_us(ts) * 1000 + CAST(req_bytes AS BIGINT) AS end_ns, status AS status_code FROM t""",
)
def span_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    trips = _traced(spark, sf_dir).withColumns({"url": F.lit("/"), "scheme": F.lit("http"), "req_ns": start, "rsp_ns": start + F.col("req_bytes").cast("bigint")})
    return spans.http_span(trips).select("name", "trace_id", "span_id", "parent_span_id", "start_ns", "end_ns", F.col("attributes")["http.response.status_code"].alias("status_code"))


@register(
    "http_url_parts",
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query FROM pages""",
)
def http_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    parts = [F.parse_url(u, F.lit(p)) for p in ("PROTOCOL", "HOST", "PATH", "QUERY")]
    return views.table(spark, sf_dir, "pages").select("page_id", *[p.alias(n) for p, n in zip(parts, ("scheme", "host", "path", "query"))])


@register("body_capture", "SELECT page_id, substr(html, 1, 102400) AS body, CAST(length(html) AS INT) AS size, false AS is_json FROM pages")
def body_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", text.captured_body(F.col("html"), F.lit("text/html")).alias("body"), F.length("html").alias("size"), text.body_is_json(F.col("html")).alias("is_json"))


@register(
    "prom_text",
    f"""WITH {_TRIPS} SELECT 'http_requests_total{{method="' || method || '",status_code="' || status || '"}} ' || printf('%.6f', CAST(count(*) AS DOUBLE)) AS line FROM trips GROUP BY method, status""",
)
def prom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = metrics.counter(_labelled(spark, sf_dir).where("model = 'counter'"), ["name", "labels"])
    return series.select(metrics.prometheus_line(F.col("name"), F.col("labels"), F.col("value")).alias("line"))


@register(
    "remote_write_series",
    f"WITH {_TRIPS} SELECT '__name__=http_requests_total,method=' || method || ',status_code=' || status AS labels, CAST(count(*) AS DOUBLE) AS sample_value, CAST(1700000000000 AS BIGINT) AS sample_ms FROM trips GROUP BY method, status",
)
def remote_write_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = metrics.counter(_labelled(spark, sf_dir).where("model = 'counter'"), ["name", "labels"])
    out = metrics.remote_write_series(series, F.lit(1_700_000_000))
    return out.withColumn("labels", F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit("="), x["value"])), ","))


_NS = "(event_id * 7919 % 1000) * CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 WHEN 3 THEN 1000000000 ELSE 12345 END"
_FRACTION = "regexp_replace(lpad(CAST({x} % {u} AS VARCHAR), {w}, '0'), '0+$', '')"


def _decimal_sql(u: int, w: int) -> str:
    f = _FRACTION.format(x="ns", u=u, w=w)
    return f"CAST(ns // {u} AS VARCHAR) || CASE WHEN {f} <> '' THEN '.' || {f} ELSE '' END"


_SECS = _FRACTION.format(x="(ns % 60000000000)", u=1000000000, w=9)


#: The text of a duration of the column ns.
_DURATION = f"""CASE WHEN ns = 0 THEN '0s' WHEN ns < 1000 THEN CAST(ns AS VARCHAR) || 'ns' WHEN ns < 1000000 THEN {_decimal_sql(1000, 3)} || 'µs' WHEN ns < 1000000000 THEN {_decimal_sql(1000000, 6)} || 'ms'
ELSE CASE WHEN ns >= 3600000000000 THEN CAST(ns // 3600000000000 AS VARCHAR) || 'h' ELSE '' END || CASE WHEN ns >= 60000000000 THEN CAST(ns // 60000000000 % 60 AS VARCHAR) || 'm' ELSE '' END || CAST(ns % 60000000000 // 1000000000 AS VARCHAR) || CASE WHEN {_SECS} <> '' THEN '.' || {_SECS} ELSE '' END || 's' END"""


@register("go_duration", f"WITH n AS (SELECT event_id, {_NS} AS ns FROM events) SELECT event_id, {_DURATION} AS duration FROM n")
def go_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    unit = F.when(i % 5 == 0, 1).when(i % 5 == 1, 1000).when(i % 5 == 2, 1_000_000).when(i % 5 == 3, 1_000_000_000).otherwise(12345).cast("bigint")
    return views.table(spark, sf_dir, "events").select("event_id", text.go_duration((i * 7919 % 1000) * unit).alias("duration"))


@register(
    "roundtrip_json",
    f"""WITH {_TRIPS}, n AS (SELECT *, CAST(round(secs * 1000000000) AS BIGINT) AS ns FROM trips) SELECT trip_id, '{{"Proto":"http","Request":{{"Method":"' || method || '","Size":' || CAST(req_bytes AS VARCHAR) || '}},"Response":{{"Status":"' || status || '"}},"Duration":"' || {_DURATION} || '"}}' AS line FROM n""",
)
def roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = views.round_trips(spark, sf_dir)
    request = F.struct(F.col("method").alias("Method"), F.col("req_bytes").alias("Size"))
    took = text.go_duration(F.round(F.col("secs") * 1_000_000_000).cast("bigint"))
    line = F.to_json(F.struct(F.lit("http").alias("Proto"), request.alias("Request"), F.struct(F.col("status").alias("Status")).alias("Response"), took.alias("Duration")))
    return trips.select("trip_id", line.alias("line"))


@register(
    "scalar_functions",
    """SELECT conv_id, turn, translate(split_part(trim(text), ' ', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS command, regexp_replace(text, '[^A-Za-z0-9_:/-]', '', 'g') AS plain, substr(replace(text, chr(10), ' '), 1, 1024) AS statement, trim(replace('/' || role || '/' || CAST(turn AS VARCHAR) || '/', '/', '.'), '.') AS service FROM conversations""",
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    t = F.col("text")
    path = F.concat(F.lit("/"), "role", F.lit("/"), F.col("turn").cast("string"), F.lit("/"))
    return c.select("conv_id", "turn", text.command_word(t).alias("command"), text.plain_name(t).alias("plain"), text.one_line(t).alias("statement"), text.service_of(path).alias("service"))


@register(
    "plain_names",
    """SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z0-9_:/-]', '', 'g') AS plain FROM conversations""",
)
def plain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain_name of whole texts, whatever their length."""
    return views.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain_name(F.col("text")).alias("plain"))


#: The first eight hex digits of a text's MD5 as a number.
_MARK = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@register(
    "pipeline_fan_out",
    f"""WITH {_TRIPS}, t AS (SELECT *, {_PARENT} AS h FROM trips),
s AS (SELECT method || '|' || CASE WHEN k % 3 = 0 THEN md5('t' || CAST(trip_id AS VARCHAR)) ELSE md5('trace|' || CAST(trip_id AS VARCHAR)) END || '|' || status || '|' || CAST(trip_id * 1000 AS VARCHAR) AS said FROM t),
m AS (SELECT 'http_requests_total' AS name, method, status, CAST(1 AS DOUBLE) AS value FROM t UNION ALL SELECT 'http_request_duration_seconds', method, status, secs FROM t UNION ALL SELECT 'http_request_body_bytes', method, status, req_bytes FROM t UNION ALL SELECT 'http_response_body_bytes', method, status, rsp_bytes FROM t),
d AS (SELECT name || '|' || method || '|' || status AS said, round(value, 6) AS value FROM m WHERE value IS NOT NULL)
SELECT pipeline, processor, CAST(records AS BIGINT) AS records, CAST(mark AS BIGINT) AS mark, round(total, 4) AS total FROM (VALUES ('first', 'roundtripstometrics'), ('first', 'roundtripstotraces'), ('second', 'roundtripstotraces')) AS v(pipeline, processor)
JOIN (SELECT 'roundtripstometrics' AS processor, count(*) AS records, sum({_MARK.format('said')}) AS mark, sum(value) AS total FROM d UNION ALL SELECT 'roundtripstotraces', count(*), sum({_MARK.format('said')}), CAST(0 AS DOUBLE) FROM s) USING (processor)""",
)
def pipeline_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each processor of each pipeline takes the round trips themselves, not what another made of them. The rows of each are told by their number, a sum of marks of what they say, and
    the sum of values."""
    s = config.load({"pipeline": {"first": ["roundtripstometrics", "roundtripstotraces"], "second": ["roundtripstotraces"]}})
    start = F.col("trip_id") * 1000
    trips = _traced(spark, sf_dir).withColumns({"url": F.lit("/"), "scheme": F.lit("http"), "req_ns": start, "rsp_ns": start + 500})
    mark = lambda *parts: F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")).alias("mark")
    out = []
    for (name, step), rows in config.plan(trips, s).items():
        if step == "roundtripstometrics":
            label = lambda n: F.filter("labels", lambda x: x["name"] == n)[0]["value"]
            said, total = mark("name", label("method"), label("status_code")), F.sum(F.round("value", 6))
        else:
            said, total = mark("name", "trace_id", F.col("attributes")["http.response.status_code"], F.col("start_ns").cast("string")), F.lit(0.0)
        out.append(rows.agg(F.count("*").alias("records"), said, F.round(total, 4).alias("total")).select(F.lit(name).alias("pipeline"), F.lit(step).alias("processor"), "records", "mark", "total"))
    return functools.reduce(DataFrame.unionByName, out)


@register(
    "metric_dispatch_models",
    f"""WITH {_TRIPS}, b AS (SELECT method, unnest([10240, 102400, 256000, 512000, 1048576, 5242880, 10485760, 20971520, 31457280, 52428800, 83886080, 104857600, 157286400, 209715200, 524288000]) AS le FROM (SELECT DISTINCT method FROM trips))
SELECT 'in_flight' AS name, method, CAST(NULL AS VARCHAR) AS part, CAST(max_by(k, ROW(ts, k)) AS DOUBLE) AS value FROM trips GROUP BY method
UNION ALL SELECT 'retries', method, '+Inf', CAST(count(*) AS DOUBLE) FROM trips GROUP BY method
UNION ALL SELECT 'http_requests_total', method, NULL, CAST(count(*) AS DOUBLE) FROM trips GROUP BY method
UNION ALL SELECT 'size', b.method, CAST(b.le AS VARCHAR), CAST(count(*) FILTER (WHERE req_bytes <= b.le) AS DOUBLE) FROM b JOIN trips USING (method) GROUP BY b.method, b.le
UNION ALL SELECT 'size', method, '+Inf', CAST(count(*) AS DOUBLE) FROM trips GROUP BY method""",
)
def metric_dispatch_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of counters, gauges, and histograms with and without a unit, from one table of metrics."""
    trips = views.round_trips(spark, sf_dir)
    rows = [("http_requests_total", "counter", "", F.lit(1.0)), ("in_flight", "gauge", "", F.col("k")), ("retries", "histogram", "", F.col("k")), ("size", "histogram", "bytes", F.col("req_bytes"))]
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("model"), F.lit(u).alias("unit"), v.cast("double").alias("value")) for n, m, u, v in rows])
    return metrics.dispatch(trips.select("ts", "method", F.inline(each)), ["method"])
