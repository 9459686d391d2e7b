"""Traffic of each protocol made from the driver's tables, so that framing, decoding and matching run end to end on rows that Spark derives; with the SQL that says what must
come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import amqp, decoders, framing, http2, l4, matching
from ..functions.text import service_of
from . import views
from .catalogue import _K, register

SEGMENT = 1400


def big(value: Column | int, size: int) -> Column:
    """A number as ``size`` bytes, the highest first."""
    value = F.lit(value) if isinstance(value, int) else value
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def little(value: Column | int, size: int) -> Column:
    value = F.lit(value) if isinstance(value, int) else value
    text = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))]))


def raw(value: Column | str | bytes) -> Column:
    return (F.lit(value) if not isinstance(value, Column) else value).cast("binary")


def cat(*parts: Column) -> Column:
    return F.concat(*parts)


def sized(body: Column, size: int = 4, add: int = 0) -> Column:
    return cat(big(F.octet_length(body) + add, size), body)


def sent(rows: DataFrame, proto: str) -> DataFrame:
    """Segments of messages (conn, role, at, bytes): each message is cut, numbered as TCP does, every fifth segment is sent twice."""
    w = Window.partitionBy("conn", "role").orderBy("at")
    df = rows.withColumn("size", F.octet_length("bytes")).withColumn("start", F.sum("size").over(w) - F.col("size"))
    df = df.withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("size") - 1) / SEGMENT).cast("int"))))
    df = df.select("conn", "role", F.lit(proto).alias("proto"), "at", "part", (F.col("start") + F.col("part") * SEGMENT).alias("seq"), F.expr(f"substring(bytes, part * {SEGMENT} + 1, {SEGMENT})").alias("payload"))
    df = df.withColumn("copy", F.explode(F.when((F.col("at") + F.col("part")) % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return df.withColumns({"len": F.octet_length("payload"), "fin": F.lit(False), "capture_ns": F.col("at") * 1000 + F.when(F.col("role") == "Response", 500).otherwise(0)})


def heard(segments: DataFrame) -> DataFrame:
    """Messages of both directions: the cursor drops what comes twice, then streams are cut into messages. Both steps need the same grouping."""
    order = ["at", "part", "copy"]
    new = framing.deliver(l4.cursor(segments, ["conn", "role"], order))
    return framing.messages(new, ["conn", "role"], order)


def _new(segments: DataFrame) -> DataFrame:
    return framing.deliver(l4.cursor(segments, ["conn", "role"], ["at", "part", "copy"]))


def talked(segments: DataFrame) -> DataFrame:
    """As heard, for protocols whose framing needs both directions of a connection at once."""
    new = framing.deliver(l4.cursor(segments, ["conn", "role"], ["at", "part", "copy"]), ends=True)
    return framing.exchanges(new, ["conn"], ["capture_ns", "role", "at", "part", "copy"])


def _messages(rows: DataFrame, proto: str) -> DataFrame:
    return decoders.DECODERS[proto]((talked if proto in ("http", "postgresql") else heard)(sent(rows, proto)))


def _both(rows: DataFrame, request: Column, response: Column) -> DataFrame:
    ways = F.array(F.struct(F.lit("Request").alias("role"), request.alias("bytes")), F.struct(F.lit("Response").alias("role"), response.alias("bytes")))
    return rows.select("conn", "at", F.inline(ways))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("at"), "event_type", views.number().alias("k"))


@register(
    "decode_http",
    """SELECT page_id AS conn, '/en/' || CAST(page_id AS VARCHAR) AS path, 'h' || CAST(page_id % 7 AS VARCHAR) || '.test' AS remote_host, 'GET' AS method, '200' AS status, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS body_bytes, CASE WHEN octet_length(encode(coalesce(html, ''))) <= 102400 THEN coalesce(html, '') END AS body FROM pages""",
)
def decode_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _http_pairs(spark, sf_dir)
    return pairs.select("conn", F.col("req_path").alias("path"), F.col("req_remote_host").alias("remote_host"), F.col("req_method").alias("method"), F.col("rsp_status").alias("status"), F.col("rsp_body_bytes").alias("body_bytes"), _whole_body())


def _whole_body() -> Column:
    """Null for bodies that are longer than what framing keeps."""
    return F.when(F.octet_length("rsp_body") == F.col("rsp_body_bytes"), F.col("rsp_body")).alias("body")


def _http_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("conn"), F.col("page_id").alias("at"), "html")
    ask = raw(F.concat(F.lit("GET /en/"), F.col("conn").cast("string"), F.lit("?a=1 HTTP/1.1\r\nHost: h"), (F.col("conn") % 7).cast("string"), F.lit(".test\r\nAccept: */*\r\n\r\n")))
    tell = raw(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"), "html"))
    m = _messages(_both(p.withColumn("html", F.coalesce("html", F.lit(""))), ask, tell), "http")
    return matching.single(m, ["conn"], ["first_ns"], ["path", "remote_host", "method", "status", "body_bytes", "body"])


@register(
    "decode_http_body",
    """SELECT page_id AS conn, CAST(octet_length(encode(html)) AS BIGINT) AS body_bytes, CASE WHEN octet_length(encode(html)) <= 102400 THEN html END AS body FROM pages""",
)
def decode_http_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as captured, whole; null for those longer than what framing keeps."""
    pairs = _http_pairs(spark, sf_dir)
    return pairs.select("conn", F.col("rsp_body_bytes").alias("body_bytes"), _whole_body())


@register(
    "decode_http_exchanges",
    """SELECT page_id AS conn, CAST(n AS BIGINT) AS exchange, m AS method, CASE n WHEN 2 THEN '101' ELSE '200' END AS status, e AS ending, CAST(CASE n WHEN 1 THEN octet_length(encode(coalesce(html, ''))) ELSE 0 END AS BIGINT) AS body_bytes FROM pages, (VALUES (0, 'HEAD', 'length'), (1, 'POST', CASE page_id % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'size' ELSE 'close' END), (2, 'GET', 'tunnel')) AS v(n, m, e) WHERE n < 2 OR page_id % 3 < 2""",
)
def decode_http_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests sent before their answers. The answer to HEAD gives the length of a body that it does not have; that to POST, after an interim one, has its body by length, in chunks or up
    to the end of its side; after the first two of these a third request upgrades the connection, and what follows is no HTTP."""
    p = views.table(spark, sf_dir, "pages").select(F.col("page_id").alias("conn"), F.col("page_id").alias("at"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    form, size = F.col("conn") % 3, F.octet_length("html").cast("string")
    line = lambda *parts: raw(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    upgrade = F.when(form < 2, raw("GET /chat HTTP/1.1\r\nUpgrade: websocket\r\n\r\n")).otherwise(raw(""))
    ask = cat(raw("HEAD /a HTTP/1.1\r\n\r\nPOST /a HTTP/1.1\r\nExpect: 100-continue\r\nContent-Length: 4\r\n\r\nbody"), upgrade)
    half = F.floor(F.octet_length("html") / 2).cast("int")
    pieces = (F.substring("html", F.lit(1), half), F.substring("html", half + 1, F.octet_length("html")))
    chunk = lambda c: F.when(F.octet_length(c) > 0, cat(line(F.hex(F.octet_length(c)), "\r\n"), c, raw("\r\n"))).otherwise(raw(""))
    body = F.when(form == 0, cat(line("Content-Length: ", size, "\r\n\r\n"), F.col("html"))).when(form == 1, cat(raw("Transfer-Encoding: chunked\r\n\r\n"), chunk(pieces[0]), chunk(pieces[1]), raw("0\r\n\r\n"))).otherwise(cat(raw("\r\n"), F.col("html")))
    switch = F.when(form < 2, raw(b"HTTP/1.1 101 Switching Protocols\r\n\r\n\x81\x05HTTP/1.1 200 hello")).otherwise(raw(""))
    tell = cat(line("HTTP/1.1 200 OK\r\nContent-Length: ", size, "\r\n\r\nHTTP/1.1 100 Continue\r\n\r\nHTTP/1.1 200 OK\r\n"), body, switch)
    segments = sent(_both(p, ask, tell), "http").withColumn("fin", (F.col("role") == "Response") & (F.col("part") == F.max("part").over(Window.partitionBy("conn", "role"))))
    m = decoders.http(talked(segments)).where("NOT ending <=> 'interim'")
    pairs = matching.by_key(m, ["conn", "exchange"], ["first_ns", "role"], ["method", "status", "ending", "body_bytes"])
    return pairs.select("conn", "exchange", F.col("req_method").alias("method"), F.col("rsp_status").alias("status"), F.col("rsp_ending").alias("ending"), F.col("rsp_body_bytes").alias("body_bytes"))


@register("decode_redis", "SELECT user_id AS conn, upper(event_type) AS command, 'Integer' AS data_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def decode_redis(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    key = F.concat(F.lit("key:"), F.col("k").cast("string"))
    ask = raw(F.concat(F.lit("*2\r\n$"), F.length(t).cast("string"), F.lit("\r\n"), t, F.lit("\r\n$"), F.length(key).cast("string"), F.lit("\r\n"), key, F.lit("\r\n")))
    tell = raw(F.concat(F.lit(":"), F.col("k").cast("string"), F.lit("\r\n")))
    m = _messages(_both(_events(spark, sf_dir), ask, tell), "redis")
    pairs = matching.single(m, ["conn"], ["first_ns"], ["command", "data_type"])
    return pairs.groupBy("conn", F.col("req_command").alias("command"), F.col("rsp_data_type").alias("data_type")).agg(F.count("*").alias("n"))


@register("decode_mysql", f"SELECT user_id AS conn, 'QUERY' AS command, 'select ' || CAST({_K} AS VARCHAR) || ' from t' AS statement, 'OK' AS packet_kind, CAST(sum({_K}) AS BIGINT) AS affected_rows FROM events GROUP BY user_id, {_K}")
def decode_mysql(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = cat(big(3, 1), raw(F.concat(F.lit("select "), F.col("k").cast("string"), F.lit("\nfrom t"))))
    # A count in each of the widths that the protocol has for one.
    wide = lambda mark, size: cat(big(mark, 1), little(F.col("k"), size))
    turn = F.col("at") % 4
    count = F.when(turn == 0, big(F.col("k"), 1)).when(turn == 1, wide(252, 2)).when(turn == 2, wide(253, 3)).otherwise(wide(254, 8))
    ok = cat(big(0, 1), count, big(0, 1), little(2, 2), little(0, 2))
    frame = lambda b, n: cat(little(F.octet_length(b), 3), big(n, 1), b)
    m = _messages(_both(_events(spark, sf_dir), frame(body, 0), frame(ok, 1)), "mysql")
    pairs = matching.single(m, ["conn"], ["first_ns"], ["command", "statement", "packet_kind", "affected_rows"])
    names = {"req_command": "command", "req_statement": "statement", "rsp_packet_kind": "packet_kind"}
    return pairs.groupBy("conn", *[F.col(a).alias(b) for a, b in names.items()]).agg(F.sum("rsp_affected_rows").alias("affected_rows"))


@register("decode_postgresql", f"SELECT user_id AS conn, 'select ' || CAST({_K} AS VARCHAR) AS statement, 'SELECT' AS tag, CAST(sum({_K}) AS BIGINT) AS affected_rows FROM events GROUP BY user_id, {_K}")
def decode_postgresql(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    frame = lambda kind, text: cat(raw(kind), sized(raw(F.concat(text, F.lit("\0"))), 4, 4))
    m = _messages(_both(_events(spark, sf_dir), frame("Q", F.concat(F.lit("select "), k)), frame("C", F.concat(F.lit("SELECT "), k))), "postgresql")
    pairs = matching.single(m, ["conn"], ["first_ns"], ["statement", "tag", "affected_rows"])
    return pairs.groupBy("conn", F.col("req_statement").alias("statement"), F.col("rsp_tag").alias("tag")).agg(F.sum("rsp_affected_rows").alias("affected_rows"))


@register("decode_kafka", f"SELECT user_id AS conn, event_id AS key, CASE {_K} % 3 WHEN 0 THEN 'Produce' WHEN 1 THEN 'Fetch' ELSE 'ListOffsets' END AS api, CAST({_K} % 9 AS BIGINT) AS version, 'client' || CAST(user_id AS VARCHAR) AS client_id, CAST({_K} AS BIGINT) AS error_code FROM events")
def decode_kafka(spark: SparkSession, sf_dir: str) -> DataFrame:
    client = raw(F.concat(F.lit("client"), F.col("conn").cast("string")))
    ask = sized(cat(big(F.col("k") % 3, 2), big(F.col("k") % 9, 2), big(F.col("at"), 4), sized(client, 2)))
    tell = sized(cat(big(F.col("at"), 4), big(F.col("k"), 2)))
    m = _messages(_both(_events(spark, sf_dir), ask, tell), "kafka")
    pairs = matching.by_key(m, ["conn", "key"], ["first_ns", "role"], ["api", "version", "client_id", "error_code"])
    return pairs.select("conn", "key", F.col("req_api").alias("api"), F.col("req_version").alias("version"), F.col("req_client_id").alias("client_id"), F.col("rsp_error_code").alias("error_code"))


@register("decode_mongodb", "SELECT user_id AS conn, event_id AS key, 'MSG' AS opcode, 'find' AS command, 'db' || CAST(user_id AS VARCHAR) AS source FROM events")
def decode_mongodb(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("name", raw(F.concat(F.lit("db"), F.col("conn").cast("string"))))
    fixed = F.lit(b"\x02find\0" + _bson_text("things") + b"\x02comment\0" + _bson_text("long " * 200) + b"\x02$db\0")
    e = e.withColumn("inside", cat(fixed, little(F.octet_length("name") + 1, 4), F.col("name"), F.lit(b"\0\0")))
    e = e.withColumn("asked", cat(F.lit(bytes(5)), little(F.octet_length("inside") + 4, 4), F.col("inside"))).withColumn("told", F.lit(bytes(5) + _bson()))
    frame = lambda asked, answered, c: cat(little(F.octet_length(c) + 16, 4), little(asked, 4), little(answered, 4), little(2013, 4), F.col(c))
    ask, tell = frame(F.col("at") + 1, 0, "asked"), frame(F.col("at") + 2, F.col("at") + 1, "told")
    m = _messages(_both(e, ask, tell), "mongodb")
    pairs = matching.by_key(m, ["conn", "key"], ["first_ns", "role"], ["opcode", "command", "source"])
    return pairs.select("conn", (F.col("key") - 1).alias("key"), F.col("req_opcode").alias("opcode"), F.col("req_command").alias("command"), F.col("req_source").alias("source"))


@register("decode_amqp", "SELECT user_id AS conn, CAST(user_id % 8 + 1 AS BIGINT) AS channel, 'Basic' AS class, 'Publish' AS method, 'ex' AS exchange, event_type AS routing_key, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def decode_amqp(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda v: sized(v, 1)
    body = cat(big(60, 2), big(40, 2), big(0, 2), name(raw("ex")), name(raw(F.col("event_type"))), big(0, 1))
    ack = cat(big(60, 2), big(80, 2), big(F.col("at"), 8), big(0, 1))
    frame = lambda b: cat(big(1, 1), big(F.col("conn") % 8 + 1, 2), sized(b), big(0xCE, 1))
    m = _messages(_both(_events(spark, sf_dir), frame(body), frame(ack)), "amqp").where("role = 'Request'")
    return m.groupBy("conn", "channel", "class", "method", "exchange", "routing_key").agg(F.count("*").alias("n"))


@register("decode_dns", f"SELECT user_id AS conn, event_id % 65536 AS key, event_type || '.u' || CAST(user_id AS VARCHAR) || '.test.' AS question, 'A' AS question_type, CASE {_K} % 2 WHEN 0 THEN 'Success' ELSE 'NameError' END AS status FROM events")
def decode_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datagram is a message; there is nothing to put together."""
    label = lambda v: sized(raw(v), 1)
    question = cat(label(F.col("event_type")), label(F.concat(F.lit("u"), F.col("conn").cast("string"))), label("test"), big(0, 1), big(1, 2), big(1, 2))
    head = lambda flags: cat(big(F.col("at") % 65536, 2), flags, big(1, 2), big(0, 6))
    ask, tell = cat(head(big(0x0100, 2)), question), cat(head(big(F.when(F.col("k") % 2 == 0, 0x8180).otherwise(0x8183), 2)), question)
    e = _events(spark, sf_dir)
    rows = _both(e, ask, tell).select("conn", "at", F.col("bytes").alias("message"), F.octet_length("bytes").alias("size"))
    m = decoders.dns(rows)
    pairs = matching.by_key(m, ["conn", "key"], ["at", "role"], ["question", "question_type", "status"])
    return pairs.select("conn", "key", F.col("req_question").alias("question"), F.col("req_question_type").alias("question_type"), F.col("rsp_status").alias("status"))


@register(
    "stream_segments",
    """WITH s AS (SELECT page_id, octet_length(encode(html)) AS n FROM pages WHERE html IS NOT NULL AND html <> '') SELECT page_id AS conn, CAST(n AS BIGINT) AS delivered FROM s""",
)
def stream_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes delivered by the cursor of bodies sent in segments, some of them twice."""
    p = views.table(spark, sf_dir, "pages").where("html IS NOT NULL AND html <> ''")
    rows = p.select(F.col("page_id").alias("conn"), F.lit("Response").alias("role"), F.col("page_id").alias("at"), F.col("html").cast("binary").alias("bytes"))
    c = l4.cursor(sent(rows, "raw"), ["conn", "role"], ["at", "part", "copy"])
    return c.groupBy("conn").agg(F.sum(F.col("delivered").cast("bigint")).alias("delivered"))


def _h2(kind: int, flags: int, stream: Column, body: Column) -> Column:
    return cat(big(F.octet_length(body), 3), big(kind, 1), big(flags, 1), big(stream, 4), body)


def _literal(name: str, value: Column | str) -> Column:
    """A header field that the receiver puts into its table."""
    return cat(big(0x40, 1), sized(raw(name), 1), sized(raw(value), 1))


def _h2_rows(spark: SparkSession, sf_dir: str, path: Column, trailers: bool, proto: str) -> DataFrame:
    stream = F.col("at") * 2 + 1
    ask = cat(_h2(1, 4, stream, cat(big(0x83, 1), big(0x86, 1), _literal(":path", path), _literal(":authority", "svc.test"))), _h2(0, 1, stream, raw("hello")))
    status = F.when(F.col("k") % 2 == 0, F.lit("200")).otherwise("404")
    head = _h2(1, 4, stream, cat(_literal(":status", status), big(0xBE, 1)))
    tail = cat(_h2(0, 0, stream, raw("body")), _h2(1, 5, stream, _literal("grpc-status", (F.col("k") % 3).cast("string")))) if trailers else _h2(0, 1, stream, raw("body"))
    return http2.streams(_new(sent(_both(_events(spark, sf_dir), ask, cat(head, tail)), proto)), ["conn", "role"], ["at", "part", "copy"])


@register("decode_http2", f"SELECT user_id AS conn, event_id AS trip, 'POST' AS method, '/' || event_type AS path, 'svc.test' AS authority, CASE {_K} % 2 WHEN 0 THEN '200' ELSE '404' END AS status FROM events")
def decode_http2(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _h2_rows(spark, sf_dir, F.concat(F.lit("/"), "event_type"), False, "http2")
    pairs = matching.by_key(m, ["conn", "key"], ["first_ns", "role"], ["method", "path", "authority", "status"])
    return pairs.select("conn", ((F.col("key") - 1) / 2).cast("bigint").alias("trip"), F.col("req_method").alias("method"), F.col("req_path").alias("path"), F.col("req_authority").alias("authority"), F.col("rsp_status").alias("status"))


@register("decode_grpc", f"SELECT user_id AS conn, 'pkg.S.' || event_type AS service, CASE {_K} % 2 WHEN 0 THEN '200' ELSE '404' END AS status, CAST({_K} % 3 AS VARCHAR) AS grpc_status, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def decode_grpc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _h2_rows(spark, sf_dir, F.concat(F.lit("/pkg.S/"), "event_type"), True, "grpc").withColumn("service", service_of(F.col("path")))
    pairs = matching.by_key(m, ["conn", "key"], ["first_ns", "role"], ["service", "status", "grpc_status"])
    return pairs.groupBy("conn", F.col("req_service").alias("service"), F.col("rsp_status").alias("status"), F.col("rsp_grpc_status").alias("grpc_status")).agg(F.count("*").alias("n"))


@register("decode_dns_records", "SELECT user_id AS conn, event_id AS at, 'answer' AS section, 'a.test.' AS name, 'A' AS type, CAST(300 AS BIGINT) AS ttl, '10.0.' || CAST(user_id // 256 % 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS data FROM events UNION ALL SELECT user_id, event_id, 'authority', 'test.', 'NS', NULL, 'ns.a.test.' FROM events")
def decode_dns_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = cat(sized(raw("a"), 1), sized(raw("test"), 1), big(0, 1), big(1, 2), big(1, 2))
    answer = cat(big(0xC00C, 2), big(1, 2), big(1, 2), big(300, 4), sized(cat(big(10, 1), big(0, 1), big(F.floor(F.col("conn") / 256) % 256, 1), big(F.col("conn") % 256, 1)), 2))
    authority = cat(big(0xC00E, 2), big(2, 2), big(1, 2), big(60, 4), sized(cat(sized(raw("ns"), 1), big(0xC00C, 2)), 2))
    message = cat(big(F.col("at") % 65536, 2), big(0x8180, 2), big(1, 2), big(1, 2), big(1, 2), big(0, 2), question, answer, authority)
    rows = _events(spark, sf_dir).select("conn", "at", message.alias("message")).withColumn("size", F.octet_length("message"))
    return decoders.dns_records(rows).select("conn", "at", F.inline("records"))


@register("decode_kafka_topics", f"SELECT user_id AS conn, event_id AS key, CASE {_K} % 2 WHEN 0 THEN 'topic-' || event_type END AS topic, CASE {_K} % 2 WHEN 1 THEN 'group-' || event_type END AS group_id FROM events")
def decode_kafka_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p: sized(raw(F.concat(F.lit(p), "event_type")), 2)
    produce = cat(big(0, 2), big(1, 2), big(F.col("at"), 4), sized(raw("c"), 2), big(1, 2), big(1000, 4), big(1, 4), name("topic-"))
    heartbeat = cat(big(12, 2), big(0, 2), big(F.col("at"), 4), big(0xFFFF, 2), name("group-"), big(3, 4))
    ask = sized(F.when(F.col("k") % 2 == 0, produce).otherwise(heartbeat))
    m = _messages(_events(spark, sf_dir).select("conn", "at", F.lit("Request").alias("role"), ask.alias("bytes")), "kafka")
    return m.select("conn", "key", "topic", "group_id")


@register("decode_mysql_rows", f"SELECT user_id AS conn, 'select ' || CAST({_K} AS VARCHAR) AS statement, 'ResultSet' AS packet_kind, CAST({_K} % 4 AS BIGINT) AS returned_rows, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def decode_mysql_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda b, n: cat(little(F.octet_length(b), 3), big(n, 1), b)
    ask = frame(cat(big(3, 1), raw(F.concat(F.lit("select "), F.col("k").cast("string")))), 0)
    end = cat(big(0xFE, 1), little(0, 4))
    rows = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= F.col("k") % 4, frame(cat(big(1, 1), raw("x")), i + 3)).otherwise(F.lit(b"")))
    body = F.unhex(F.array_join(F.transform(rows, F.hex), ""))
    tell = cat(frame(big(1, 1), 1), frame(raw("column"), 2), frame(end, 3), body, frame(end, F.col("k") % 4 + 4))
    e = _events(spark, sf_dir)
    m = decoders.mysql_exchanges(heard(sent(_both(e, ask, tell), "mysql")))
    pairs = matching.single(m, ["conn"], ["first_ns"], ["statement", "packet_kind", "returned_rows"])
    out = pairs.groupBy("conn", F.col("req_statement").alias("statement"), F.col("rsp_packet_kind").alias("packet_kind"), F.col("rsp_returned_rows").alias("returned_rows"))
    return out.agg(F.count("*").alias("n"))


def _bson(*elements: tuple[int, str, bytes]) -> bytes:
    """A document of fixed content."""
    inside = b"".join(bytes([kind]) + name.encode() + b"\0" + value for kind, name, value in elements)
    return (len(inside) + 5).to_bytes(4, "little") + inside + b"\0"


def _bson_text(value: str) -> bytes:
    return (len(value.encode()) + 1).to_bytes(4, "little") + value.encode() + b"\0"


@register(
    "decode_mongodb_fields",
    f"""WITH e AS (SELECT user_id AS conn, event_id AS id, event_type, {_K} AS k, {_K} % 4 AS t FROM events)
SELECT conn, id + 1 AS key, CASE t WHEN 0 THEN 'insert' WHEN 1 THEN 'getMore' WHEN 2 THEN 'hello' ELSE 'find' END AS command, CASE t WHEN 0 THEN 'kästchen' WHEN 1 THEN CAST(k * 5000000000 AS VARCHAR) WHEN 2 THEN '1' ELSE event_type END AS command_value,
  CASE t WHEN 0 THEN 'kästchen' WHEN 1 THEN event_type WHEN 3 THEN event_type END AS collection, 'db' || CAST(conn AS VARCHAR) AS source, CAST(CASE t WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS ok, CASE t WHEN 1 THEN CAST(43 AS INTEGER) END AS code,
  CASE t WHEN 1 THEN 'CursorNotFound' END AS code_name FROM e""",
)
def decode_mongodb_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the same name at the top and in nested documents, before and after; commands with a text, a whole and a fractional number; documents before the body."""
    turn, zero = F.col("k") % 4, F.lit(b"\0")
    one = bytes.fromhex("000000000000f03f")
    nested = b"\x03filter\0" + _bson((2, "$db", _bson_text("evil")), (16, "code", (11000).to_bytes(4, "little")), (2, "find", _bson_text("nothing")))
    many = b"\x04documents\0" + _bson((3, "0", _bson((2, "$db", _bson_text("evil")), (1, "ok", bytes(8)))))
    text = lambda key, v: cat(F.lit(b"\x02" + key + b"\0"), little(F.octet_length(v) + 1, 4), v, zero)
    e = _events(spark, sf_dir).withColumn("name", raw(F.concat(F.lit("db"), F.col("conn").cast("string")))).withColumn("thing", raw(F.col("event_type")))
    first = (
        F.when(turn == 0, F.lit(b"\x02insert\0" + _bson_text("kästchen") + many))
        .when(turn == 1, cat(F.lit(b"\x12getMore\0"), little(F.col("k") * 5_000_000_000, 8), text(b"collection", F.col("thing")), F.lit(nested)))
        .when(turn == 2, F.lit(b"\x01hello\0" + one + nested))
        .otherwise(cat(text(b"find", F.col("thing")), F.lit(nested)))
    )
    e = e.withColumn("inside", cat(first, text(b"$db", F.col("name")))).withColumn("body", cat(little(F.octet_length("inside") + 5, 4), F.col("inside"), zero))
    sequence = b"documents\0" + _bson((2, "$db", _bson_text("evil")))
    before = F.when(turn == 3, F.lit(b"\1" + (len(sequence) + 4).to_bytes(4, "little") + sequence)).otherwise(F.lit(b""))
    e = e.withColumn("asked", cat(F.lit(bytes(4)), before, zero, F.col("body")))
    wrong = (4, "writeErrors", _bson((3, "0", _bson((16, "code", (11000).to_bytes(4, "little"))))))
    told = F.when(turn == 0, F.lit(_bson(wrong, (1, "ok", one)))).when(turn == 1, F.lit(_bson((1, "ok", bytes(8)), (16, "code", (43).to_bytes(4, "little"))))).otherwise(F.lit(_bson((16, "ok", (1).to_bytes(4, "little")))))
    e = e.withColumn("told", cat(F.lit(bytes(5)), told))
    frame = lambda asked, answered, c: cat(little(F.octet_length(c) + 16, 4), little(asked, 4), little(answered, 4), little(2013, 4), F.col(c))
    m = _messages(_both(e, frame(F.col("at") + 1, 0, "asked"), frame(F.col("at") + 2, F.col("at") + 1, "told")), "mongodb")
    asked, answered = ["command", "command_value", "collection", "source"], ["ok", "code", "code_name"]
    pairs = matching.by_key(m, ["conn", "key"], ["first_ns", "role"], [*asked, *answered])
    return pairs.select("conn", "key", *[F.col(f"req_{c}").alias(c) for c in asked], *[F.col(f"rsp_{c}").alias(c) for c in answered])


@register(
    "decode_kafka_versions",
    f"""WITH e AS (SELECT user_id AS conn, event_id AS key, event_type, {_K} % 6 AS t FROM events)
SELECT conn, key, CASE t WHEN 0 THEN 'Produce' WHEN 1 THEN 'Fetch' WHEN 2 THEN 'Fetch' WHEN 3 THEN 'OffsetCommit' WHEN 4 THEN 'OffsetFetch' ELSE 'Metadata' END AS api, CAST(CASE t WHEN 0 THEN 9 WHEN 1 THEN 11 WHEN 2 THEN 15 WHEN 3 THEN 8 WHEN 4 THEN 8 ELSE 12 END AS BIGINT) AS version,
  CASE WHEN t <> 2 THEN 'topic-' || event_type || repeat('x', 150) END AS topic, CASE WHEN t IN (2, 5) THEN '00000000-0000-0000-0000-' || lpad(lower(hex(key + 1)), 12, '0') END AS topic_id, CASE WHEN t IN (3, 4) THEN 'group-' || event_type END AS group_id FROM e""",
)
def decode_kafka_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with compact strings, whose lengths take one or two bytes, tagged fields in the head, ids of topics, and fixed and nullable fields before the names."""
    t = F.col("k") % 6

    def compact(name: str) -> Column:
        n = F.octet_length(name) + 1
        return cat(F.when(n < 128, big(n, 1)).otherwise(cat(big(n % 128 + 128, 1), big(F.floor(n / 128), 1))), F.col(name))

    e = _events(spark, sf_dir).withColumns({"topic": raw(F.concat(F.lit("topic-"), "event_type", F.lit("x" * 150))), "group": raw(F.concat(F.lit("group-"), "event_type"))})
    e = e.withColumns({"topic_": compact("topic"), "group_": compact("group")})
    topic, group, member = F.col("topic_"), F.col("group_"), F.lit(b"\7member")
    identity = cat(big(0, 8), big(F.col("at") + 1, 8))
    head = lambda api, version, tagged=True: cat(big(api, 2), big(version, 2), big(F.col("at"), 4), F.lit(b"\0\6client" + (b"\1\0\3tag" if tagged else b"")))
    bodies = [
        cat(head(0, 9), F.lit(b"\0\0\1\0\0\3\xe8\2"), topic),
        cat(head(1, 11, False), F.lit(bytes(25) + b"\0\0\0\1"), sized(F.col("topic"), 2)),
        cat(head(1, 15), F.lit(bytes(21) + b"\2"), identity),
        cat(head(8, 8), group, F.lit(b"\0\0\0\7"), member, F.lit(b"\0\2"), topic),
        cat(head(9, 8), F.lit(b"\2"), group, F.lit(b"\2"), topic),
        cat(head(3, 12), F.lit(b"\2"), identity, topic),
    ]
    e = e.withColumn("asked", F.coalesce(*[F.when(t == k, body) for k, body in enumerate(bodies)]))
    m = _messages(e.select("conn", "at", F.lit("Request").alias("role"), sized(F.col("asked")).alias("bytes")), "kafka")
    return m.select("conn", "key", "api", "version", "topic", "topic_id", "group_id")


@register(
    "decode_amqp_channels",
    f"""WITH e AS (SELECT user_id AS conn, event_id AS id, event_type, {_K} AS k FROM events)
SELECT conn, CAST(k % 5 + 1 AS BIGINT) AS channel, 'Basic.Publish' AS class_method, 'ex-' || CAST(conn AS VARCHAR) AS exchange, event_type AS routing_key, CAST(NULL AS VARCHAR) AS queue_name, CAST(k * 40 AS BIGINT) AS body_size, CAST(2 + CAST(k > 0 AS INTEGER) + CAST(k > 25 AS INTEGER) AS BIGINT) AS frames, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL
UNION ALL SELECT conn, CAST(k % 5 + 6 AS BIGINT), 'Queue.Bind', 'ex', 'key', 'q-' || event_type, NULL, 1, CAST(count(*) AS BIGINT) FROM e GROUP BY ALL""",
)
def decode_amqp_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published messages of no, one and two body frames, between whose frames stands a method of another channel."""
    e = _events(spark, sf_dir).withColumns({"exchange": raw(F.concat(F.lit("ex-"), F.col("conn").cast("string"))), "key": raw(F.col("event_type")), "queue": raw(F.concat(F.lit("q-"), "event_type"))})
    name = lambda v: sized(v, 1)
    frame = lambda kind, channel, c: cat(big(kind, 1), big(channel, 2), sized(F.col(c)), big(0xCE, 1))
    size = F.col("k") * 40
    e = e.withColumns(
        {
            "publish": cat(F.lit(b"\0\x3c\0\x28\0\0"), name(F.col("exchange")), name(F.col("key")), big(0, 1)),
            "header": cat(F.lit(b"\0\x3c\0\0"), big(size, 8), big(0, 2)),
            "bind": cat(F.lit(b"\0\x32\0\x14\0\0"), name(F.col("queue")), F.lit(b"\2ex\3key\0\0\0\0\0")),
            "one": raw(F.repeat(F.lit("x"), F.least(size, F.lit(1000)).cast("int"))),
            "two": raw(F.repeat(F.lit("y"), F.greatest(size - 1000, F.lit(0)).cast("int"))),
        }
    )
    own, other = F.col("k") % 5 + 1, F.col("k") % 5 + 6
    body = lambda c: F.when(F.octet_length(c) > 0, frame(3, own, c)).otherwise(F.lit(b""))
    rows = e.select("conn", "at", F.lit("Request").alias("role"), cat(frame(1, own, "publish"), frame(1, other, "bind"), frame(2, own, "header"), body("one"), body("two")).alias("bytes"))
    m = amqp.messages(_new(sent(rows, "amqp")), ["conn", "role"], ["at", "part", "copy"])
    by = ["conn", "channel", "class_method", "exchange", "routing_key", "queue_name", "body_size", "frames"]
    return m.groupBy(*by).agg(F.count("*").alias("n"))


@register(
    "decode_http2_streams",
    f"""WITH e AS (SELECT user_id AS conn, event_id AS id, event_type, {_K} % 3 AS t FROM events)
SELECT conn, CASE t WHEN 0 THEN 'end' WHEN 1 THEN 'reset' ELSE 'promise' END AS ending, CASE t WHEN 2 THEN '/push/' || event_type END AS path, CASE WHEN t < 2 THEN '200' END AS status, CASE t WHEN 0 THEN '0' END AS grpc_status, CAST(CASE t WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 0 END AS BIGINT) AS body_bytes,
  CASE t WHEN 1 THEN CAST(8 AS BIGINT) END AS error_code, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL""",
)
def decode_http2_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with trailers in two frames, answers that are reset, and promised requests."""
    stream, t = F.col("at") * 2 + 1, F.col("k") % 3
    e = _events(spark, sf_dir).withColumn("path", raw(F.concat(F.lit("/push/"), "event_type")))
    frame = lambda kind, flags, body: cat(big(len(body), 3), F.lit(bytes([kind, flags])), big(stream, 4), F.lit(body))
    head, data = frame(1, 4, b"\x88"), frame(0, 0, b"body")
    trailers = cat(frame(1, 1, b"\0\x0bgrpc-"), frame(9, 4, b"status\x010"))
    promised = cat(big(F.octet_length("path") + 6, 3), F.lit(b"\5\4"), big(stream, 4), big(stream + 1, 4), F.lit(b"\4"), sized(F.col("path"), 1))
    told = F.when(t == 0, cat(head, data, data, trailers)).when(t == 1, cat(head, data, frame(3, 0, b"\0\0\0\x08"))).otherwise(promised)
    rows = e.select("conn", "at", F.lit("Response").alias("role"), told.alias("bytes"))
    m = http2.streams(_new(sent(rows, "http2")), ["conn", "role"], ["at", "part", "copy"])
    return m.groupBy("conn", "ending", "path", "status", "grpc_status", "body_bytes", "error_code").agg(F.count("*").alias("n"))


@register(
    "decode_mysql_ok",
    f"""SELECT user_id AS conn, CAST({_K} AS BIGINT) AS affected_rows, CAST({_K} * 1000 AS BIGINT) AS last_insert_id, CAST(2 AS BIGINT) AS server_status, CAST({_K} % 3 AS BIGINT) AS warnings, CASE WHEN {_K} % 2 = 1 THEN 'Rows matched: ' || CAST({_K} AS VARCHAR) END AS info, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""",
)
def decode_mysql_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of packets that grant a command; the second count stands where the width of the first one leaves it."""
    turn, k = F.col("at") % 3, F.col("k")
    first = F.when(turn == 0, big(k, 1)).when(turn == 1, cat(big(252, 1), little(k, 2))).otherwise(cat(big(254, 1), little(k, 8)))
    told = F.when(k % 2 == 1, raw(F.concat(F.lit("Rows matched: "), k.cast("string")))).otherwise(F.lit(b""))
    e = _events(spark, sf_dir).withColumn("ok", cat(F.lit(b"\0"), first, big(253, 1), little(k * 1000, 3), little(2, 2), little(k % 3, 2), told))
    rows = e.select("conn", "at", F.lit("Response").alias("role"), cat(little(F.octet_length("ok"), 3), F.lit(b"\1"), F.col("ok")).alias("bytes"))
    by = ["conn", "affected_rows", "last_insert_id", "server_status", "warnings", "info"]
    return _messages(rows, "mysql").groupBy(*by).agg(F.count("*").alias("n"))


@register(
    "decode_postgresql_session",
    """WITH e AS (SELECT user_id AS conn, event_type, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events)
SELECT conn, r, n.step AS step, CASE WHEN n.step = 'Parse' THEN 'select ' || CAST(r AS VARCHAR) WHEN r % 40 < 16 THEN 'select ' || CAST(r - r % 40 AS VARCHAR) END AS statement FROM e, (VALUES ('Parse'), ('Bind')) AS n(step)""",
)
def decode_postgresql_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event prepares a statement under a name of its own and binds the one that the first of its forty events prepared, which is forgotten after sixteen names."""
    e = _events(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("conn").orderBy("at")) - 1)
    base = F.col("r") - F.col("r") % 40
    e = e.withColumns({"parse": raw(F.concat(F.lit("s"), F.col("r").cast("string"), F.lit("\0select "), F.col("r").cast("string"), F.lit("\0\0\0"))), "bind": raw(F.concat(F.lit("\0s"), base.cast("string"), F.lit("\0" + "\0" * 6)))})
    steps = F.array(F.struct((F.col("r") * 2).alias("at"), cat(raw("P"), sized(F.col("parse"), 4, 4)).alias("bytes")), F.struct((F.col("r") * 2 + 1).alias("at"), cat(raw("B"), sized(F.col("bind"), 4, 4)).alias("bytes")))
    rows = e.select("conn", F.inline(steps)).withColumn("role", F.lit("Request"))
    m = decoders.postgresql_statements(talked(sent(rows, "postgresql")))
    return m.select("conn", F.floor(F.col("first_ns") / 2000).alias("r"), F.col("command").alias("step"), "statement")
