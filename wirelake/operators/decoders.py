"""What protocol messages say, as column expressions on their bytes.

Each function adds the protocol's fields to rows with ``message`` (its first bytes), ``size`` and ``role``, as request_* and response_* parts of one flat row; fields of the
other role are null. Names of numbers are in ``functions.names``.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import (
    AMQP_CLASSES,
    AMQP_ERRORS,
    AMQP_METHODS,
    DNS_CLASSES,
    DNS_OPERATIONS,
    DNS_RCODES,
    DNS_TYPES,
    HTTP2_FRAMES,
    KAFKA_APIS,
    KAFKA_ERRORS,
    MONGO_OPCODES,
    MYSQL_COMMANDS,
    POSTGRES_CLIENT,
    POSTGRES_SERVER,
    REDIS_CONTAINERS,
    REDIS_TYPES,
)
from ..functions.names import look_up as _name
from ..sources.pcap import uint
from . import bson
from . import kafka as kafka_fields


def _m() -> Column:
    return F.col("message")


def _text(at: Column | int, size: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    size = F.lit(size) if isinstance(size, int) else size
    return F.decode(F.substring(_m(), (at + 1).cast("int"), size.cast("int")), "UTF-8")


def _is(role: str) -> Column:
    return F.col("role") == role


def _dns_question(messages: pd.Series) -> pd.DataFrame:
    """The question's name and where its end is, a batch of messages at a time: labels are as many as a message has, which expressions could only follow in steps of a fixed
    number. A name ends at an empty label, at what is none, or with the message."""
    names, ends = [], []
    for b in messages:
        at, labels = 12, []
        while b is not None and at < len(b) and 0 < b[at] < 64:
            labels.append(bytes(b[at + 1 : at + 1 + b[at]]).decode("utf-8", "replace"))
            at += b[at] + 1
        names.append("".join(x + "." for x in labels))
        ends.append(at)
    return pd.DataFrame({"name": names, "at": ends})


def dns(rows: DataFrame) -> DataFrame:
    """key (the id), question, its type and class, operation, status, answers."""
    flags = uint(_m(), 2, 2)
    df = rows.withColumn("_q", F.pandas_udf(_dns_question, "name string, at int")(_m()))
    kind = uint(_m(), (F.col("_q.at") + 1).cast("int"), 2)
    return df.withColumns(
        {
            "key": uint(_m(), 0, 2),
            "role": F.when(flags.bitwiseAND(0x8000) == 0, "Request").otherwise("Response"),
            "question": F.col("_q.name"),
            "question_type": _name(kind, DNS_TYPES),
            "question_class": _name(uint(_m(), (F.col("_q.at") + 3).cast("int"), 2), DNS_CLASSES),
            "operation": _name(F.shiftright(flags, 11).bitwiseAND(15), DNS_OPERATIONS),
            "status": F.when(flags.bitwiseAND(0x8000) != 0, _name(flags.bitwiseAND(15), DNS_RCODES)),
            "answers": uint(_m(), 6, 2),
        }
    ).drop("_q")


DNS_RECORDS = "array<struct<section:string,name:string,type:string,ttl:bigint,data:string>>"


def _dns_name(b: bytes, at: int) -> tuple[str, int]:
    """A name and where it ends; a name may point back to an earlier one."""
    out, end, hops = [], None, 0
    while at < len(b):
        n = b[at]
        if n >= 192:
            if at + 1 >= len(b) or hops > 32:
                break
            end = at + 2 if end is None else end
            at, hops = (n & 63) << 8 | b[at + 1], hops + 1
        elif n == 0:
            return ".".join(out) + ".", at + 1 if end is None else end
        else:
            out.append(b[at + 1 : at + 1 + n].decode("utf-8", "replace"))
            at += n + 1
    raise ValueError("cut name")


def _dns_data(b: bytes, kind: int, at: int, size: int) -> str | None:
    number = lambda k, n: int.from_bytes(b[k : k + n], "big")
    if kind in (1, 28):
        return str(ipaddress.ip_address(b[at : at + size]))
    if kind in (2, 5, 12):
        return _dns_name(b, at)[0]
    if kind == 15:
        return _dns_name(b, at + 2)[0]
    if kind == 33:
        return f"{_dns_name(b, at + 6)[0]}:{number(at + 4, 2)}/W:{number(at + 2, 2)}/P:{number(at, 2)}"
    if kind == 6:
        host, k = _dns_name(b, at)
        box, k = _dns_name(b, k)
        return f"{host}/{box}/T:{number(k + 16, 4)}/E:{number(k + 12, 4)}"
    if kind == 16:
        parts, k = [], at
        while k < at + size:
            parts.append(b[k + 1 : k + 1 + b[k]].decode("utf-8", "replace"))
            k += b[k] + 1
        return "/".join(parts)
    return None


def _dns_sections(b: bytes) -> list[dict]:
    """Records of the known types of the three sections after the question; what is cut is left out."""
    out: list[dict] = []
    try:
        at = 12
        for _ in range(int.from_bytes(b[4:6], "big")):
            at = _dns_name(b, at)[1] + 4
        for section, k in (("answer", 6), ("authority", 8), ("additional", 10)):
            for _ in range(int.from_bytes(b[k : k + 2], "big")):
                name, at = _dns_name(b, at)
                kind, ttl, size = int.from_bytes(b[at : at + 2], "big"), int.from_bytes(b[at + 4 : at + 8], "big"), int.from_bytes(b[at + 8 : at + 10], "big")
                at += 10
                data = _dns_data(b, kind, at, size)
                if data is not None:
                    out.append({"section": section, "name": name, "type": DNS_TYPES[kind], "ttl": ttl if section == "answer" else None, "data": data})
                at += size
    except (ValueError, IndexError):
        pass
    return out


def dns_records(rows: DataFrame) -> DataFrame:
    """dns, and the records of its sections. Names point into the message, which expressions cannot follow, so batches of messages go through Python."""
    kept = dns(rows)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), f"records {DNS_RECORDS}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(records=[_dns_sections(bytes(m)) for m in b["message"]])

    return kept.mapInPandas(run, schema)


def redis(rows: DataFrame) -> DataFrame:
    """command of a request (its first word in capitals, with the second one where the command is a container of others), data_type of a response, error of one that is."""
    text = F.decode(F.substring(_m(), 1, 256), "ISO-8859-1")
    word = r"\$\d+\r\n([A-Za-z][A-Za-z0-9._-]{0,63})\r\n"
    first = F.upper(F.regexp_extract(text, r"^\*\d+\r\n" + word, 1))
    second = F.upper(F.regexp_extract(text, r"^\*\d+\r\n\$\d+\r\n[^\r\n]*\r\n" + word, 1))
    command = F.when(first.isin(*REDIS_CONTAINERS) & (second != ""), F.concat_ws(" ", first, second)).otherwise(F.nullif(first, F.lit("")))
    kind = F.create_map(*[F.lit(x) for kv in REDIS_TYPES.items() for x in kv])[F.substring(text, 1, 1)]
    return rows.withColumns(
        {
            "command": F.when(_is("Request"), command),
            "data_type": F.when(_is("Response"), kind),
            "error": F.when(_is("Response") & text.startswith("-"), F.regexp_extract(text, r"^-([^\r\n]*)", 1)),
        }
    )


def http(rows: DataFrame) -> DataFrame:
    """method, path, remote_host of requests; status of responses; headers (the first of equal names), header_values (all of them) and body (text types, as far as framing keeps it) of both.

    Bytes that are no UTF-8 become U+FFFD; a character that the end of what is kept cuts is left out.
    """
    whole = F.octet_length(_m()) >= F.col("size")
    raw = F.make_valid_utf8(_m().cast("string"))
    text = F.when(whole, raw).otherwise(F.regexp_replace(raw, "\ufffd+$", ""))
    head = F.substring_index(text, "\r\n\r\n", 1)
    line = F.substring_index(head, "\r\n", 1)
    named = F.transform(F.filter(F.split(head, "\r\n"), lambda x, i: (i > 0) & x.contains(":")), lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    headers = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, x: F.when(F.map_contains_key(m, x["k"]), m).otherwise(F.map_concat(m, F.create_map(x["k"], x["v"]))))
    lists = F.transform(F.array_distinct(F.transform(named, lambda x: x["k"])), lambda k: F.struct(k.alias("key"), F.transform(F.filter(named, lambda x: x["k"] == k), lambda x: x["v"]).alias("value")))
    df = rows.withColumn("headers", headers).withColumn("header_values", F.map_from_entries(lists))
    return df.withColumns(
        {
            "role": F.when(line.startswith("HTTP/1."), "Response").otherwise("Request"),
            "method": F.when(~line.startswith("HTTP/1."), F.substring_index(line, " ", 1)),
            "path": F.when(~line.startswith("HTTP/1."), F.regexp_extract(line, r"^\S+ ([^ ?]*)", 1)),
            "remote_host": F.when(~line.startswith("HTTP/1."), F.col("headers")["host"]),
            "status": F.when(line.startswith("HTTP/1."), F.regexp_extract(line, r"^HTTP/1\.\d (\d{3})", 1)),
            "body_bytes": F.col("size") - F.octet_length(F.substring_index(_m().cast("string"), "\r\n\r\n", 1)) - 4,
            "body": F.when(F.col("headers")["content-type"].rlike("json|plain|html"), F.substring(text, F.length(head) + 5, 102400)),
        }
    )


def _counted(at: Column | int) -> Column:
    """MySQL's integer whose first byte says how many follow."""
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    first = uint(_m(), at, 1)
    wide = F.shiftleft(uint(_m(), at + 5, 4, little=True), 32).bitwiseOR(uint(_m(), at + 1, 4, little=True))
    return F.when(first < 251, first).when(first == 251, 0).when(first == 252, uint(_m(), at + 1, 2, little=True)).when(first == 253, uint(_m(), at + 1, 3, little=True)).when(first == 254, wide)


def _counted_end(at: Column | int) -> Column:
    """Where such an integer ends."""
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    first = uint(_m(), at, 1)
    return at + F.when(first == 252, 3).when(first == 253, 4).when(first == 254, 9).otherwise(1)


def mysql(rows: DataFrame) -> DataFrame:
    """command and statement of requests (line feeds as blanks; none for commands whose bytes are no text); packet_kind, affected_rows, last_insert_id, server_status, warnings
    and info (what an OK says in words), error_code, sql_state or error text of responses."""
    code = uint(_m(), 4, 1)
    said = F.translate(_text(5, F.least(F.lit(1024), F.col("size") - 5)), "\n", " ")
    failed = _is("Response") & (code == 255)
    state = F.decode(F.substring(_m(), 8, 6), "ISO-8859-1").rlike("^#[0-9A-Z]{5}$")
    granted = _is("Response") & (code == 0)
    # Two counts, the server's status and the number of warnings follow one another; the rest is text.
    rows = rows.withColumn("_id", F.when(granted, _counted_end(5))).withColumn("_rest", F.when(granted, _counted_end(F.col("_id"))))
    after = F.col("_rest").cast("int")
    return rows.withColumns(
        {
            "command": F.when(_is("Request"), _name(code, MYSQL_COMMANDS)),
            "statement": F.when(_is("Request") & ~code.isin(5, 10, 13) & (F.col("size") > 5), said),
            "packet_kind": F.when(_is("Response"), F.when(code == 0, "OK").when(code == 255, "ERR").when(code == 254, "EOF").otherwise("ResultSet")),
            "affected_rows": F.when(granted, _counted(5)),
            "last_insert_id": F.when(granted, _counted(F.col("_id"))),
            "server_status": F.when(granted, uint(_m(), after, 2, little=True)),
            "warnings": F.when(granted, uint(_m(), after + 2, 2, little=True)),
            "info": F.when(granted & (F.col("size") > after + 4), _text(after + 4, F.least(F.lit(1024), F.col("size") - after - 4))),
            "error_code": F.when(failed, uint(_m(), 5, 2, little=True)),
            "sql_state": F.when(failed & state, _text(8, 5)),
            "error": F.when(failed, F.when(state, _text(13, F.least(F.lit(256), F.col("size") - 13))).otherwise(_text(7, F.least(F.lit(256), F.col("size") - 7)))),
        }
    ).drop("_id", "_rest")


def mysql_exchanges(rows: DataFrame, connection: str = "conn") -> DataFrame:
    """As mysql, with all packets of an answer as one row, and returned_rows of result sets.

    An answer begins with the packet numbered 1. In a result set the rows stand between the packet that ends the columns and the one that ends it all; both begin with
    0xFE and are short. Numbers count on through an answer, so a running count of first packets tells answers apart, and no packet needs another's bytes.
    """
    w = Window.partitionBy(connection, "role").orderBy("first_ns", F.when(_is("Response"), uint(_m(), 3, 1)).otherwise(0))
    df = mysql(rows)
    df = df.withColumn("_answer", F.sum(F.when(uint(_m(), 3, 1) <= F.when(_is("Response"), 1).otherwise(0), 1).otherwise(0)).over(w))
    end = (uint(_m(), 4, 1) == 0xFE) & (F.col("size") < 13)
    answer = Window.partitionBy(connection, "role", "_answer").orderBy("first_ns", uint(_m(), 3, 1))
    df = df.withColumns({"_end": end.cast("int"), "_ends": F.sum(end.cast("int")).over(answer)})
    first = lambda c: F.min_by(c, F.struct("first_ns", uint(_m(), 3, 1))).alias(c)
    out = df.groupBy(connection, "role", "_answer").agg(
        *[first(c) for c in ("command", "statement", "packet_kind", "affected_rows", "last_insert_id", "server_status", "warnings", "info", "error_code", "sql_state", "error")],
        F.count_if((F.col("_ends") == 1) & (F.col("_end") == 0)).alias("_rows"),
        F.sum("size").alias("size"),
        F.min("first_ns").alias("first_ns"),
        F.max("last_ns").alias("last_ns"),
    )
    return out.withColumn("returned_rows", F.when(F.col("packet_kind") == "ResultSet", F.col("_rows"))).drop("_rows", "_answer")


def postgresql(rows: DataFrame) -> DataFrame:
    """command of requests, statement of queries and parses, the name a prepared statement has in parses and binds; packet_kind of responses, tag and affected_rows of
    completions, severity, error_code and error of errors."""
    kind = F.decode(F.substring(_m(), 1, 1), "ISO-8859-1")
    parts = F.split(_text(5, F.least(F.lit(1024), F.col("size") - 5)), "\0")
    latin = F.decode(F.substring(_m(), 6, 1024), "ISO-8859-1")
    asked, answered = (lambda *k: _is("Request") & kind.isin(*k)), (lambda *k: _is("Response") & kind.isin(*k))
    tag = F.substring_index(latin, "\0", 1)
    part = lambda letter: F.when(answered("E"), F.regexp_extract(F.concat(F.lit("\0"), latin), f"\0{letter}([^\0]*)", 1))
    return rows.withColumns(
        {
            "command": F.when(_is("Request"), _name(kind, POSTGRES_CLIENT)),
            "statement": F.when(asked("Q"), F.get(parts, F.lit(0))).when(asked("P"), F.get(parts, F.lit(1))),
            "prepared": F.when(asked("P"), F.get(parts, F.lit(0))).when(asked("B"), F.split_part(latin, F.lit("\0"), F.lit(2))),
            "packet_kind": F.when(_is("Response"), _name(kind, POSTGRES_SERVER)),
            "tag": F.when(answered("C"), F.substring_index(tag, " ", 1)),
            "affected_rows": F.when(answered("C"), F.try_to_number(F.regexp_extract(tag, r" (\d+)$", 1), F.lit("999999999999")).cast("bigint")),
            "severity": part("S"),
            "error_code": part("C"),
            "error": part("M"),
        }
    )


#: Prepared statements and portals that a connection's session knows at most; the oldest goes first.
STATEMENTS = 16


def postgresql_statements(rows: DataFrame, connection: str = "conn", most: int = STATEMENTS) -> DataFrame:
    """As postgresql, with the statement of binds and executes.

    A parse gives a name to a statement, a bind gives a portal the statement of a name, an execute runs a portal. Of both kinds of names a session knows the ``most`` that
    were given last; giving a name anew moves it to the end, and closing it takes it away. What was forgotten gives no statement. A task holds one session's names.
    """
    df = postgresql(rows)
    letter = F.decode(F.substring(_m(), 1, 1), "ISO-8859-1")
    latin = F.decode(F.substring(_m(), 6, 1024), "ISO-8859-1")
    word = lambda k: F.get(F.split(latin, "\0"), F.lit(k))
    # Closing says with a letter whether a statement or a portal is meant.
    asked = _is("Request")
    df = df.withColumns({"_letter": F.when(asked, letter), "_portal": F.when(asked & letter.isin("B", "E"), word(0)).when(asked & (letter == "C"), word(0))})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, statements, portals = None, {}, {}

        def give(table: dict[str, str | None], name: str, value: str | None) -> None:
            table.pop(name, None)
            table[name] = value
            if len(table) > most:
                del table[next(iter(table))]

        for b in batches:
            said = []
            for own, kind, name, portal, text in zip(b[connection], b["_letter"], b["prepared"], b["_portal"], b["statement"]):
                if own != now:
                    now, statements, portals = own, {}, {}
                if kind == "P":
                    give(statements, name or "", text)
                elif kind == "B":
                    text = statements.get(name or "")
                    give(portals, portal or "", text)
                elif kind == "E":
                    text = portals.get(portal or "")
                elif kind == "C" and portal:
                    (statements if portal[0] == "S" else portals).pop(portal[1:], None)
                said.append(text)
            yield b.assign(statement=said)

    ordered = df.repartition(connection).sortWithinPartitions(connection, "first_ns")
    return ordered.mapInPandas(run, schema).drop("_letter", "_portal")


def mongodb(rows: DataFrame) -> DataFrame:
    """key (request id, or the id answered), opcode; command, command_value (a text or a number), collection and source of requests; ok, code and its name of answers.

    The body's top-level keys are read, in batches of messages (``bson.say``); what is nested in it is stepped over.
    """
    asked, answers = uint(_m(), 4, 4, little=True), uint(_m(), 8, 4, little=True)
    df = rows.withColumn("_s", F.pandas_udf(bson.said, bson.SAID)(_m()))
    request = answers == 0
    return df.withColumns(
        {
            "role": F.when(request, "Request").otherwise("Response"),
            "key": F.when(request, asked).otherwise(answers),
            "opcode": _name(uint(_m(), 12, 4, little=True), MONGO_OPCODES),
            **{c: F.when(request, F.col(f"_s.{c}")) for c in ("command", "command_value", "collection", "source")},
            **{c: F.when(~request, F.col(f"_s.{c}")) for c in ("ok", "code", "code_name")},
        }
    ).drop("_s")


def kafka(rows: DataFrame) -> DataFrame:
    """key (correlation id), api, version, client_id of requests, the topic (by name or by id) and group_id that they name first, error_code and its name of responses.

    Where the names stand depends on the API and its version; field programs say it (``kafka.PROGRAMS``), and run on batches of messages.
    """
    size = uint(_m(), 12, 2)
    df = rows.withColumn("_n", F.pandas_udf(kafka_fields.names, kafka_fields.NAMED)(F.when(_is("Request"), _m())))
    plain = lambda c: F.regexp_replace(F.col(f"_n.{c}"), r"[^A-Za-z0-9_.:/-]", "")
    return df.withColumns(
        {
            "key": F.when(_is("Request"), uint(_m(), 8, 4)).otherwise(uint(_m(), 4, 4)),
            "api": F.when(_is("Request"), _name(uint(_m(), 4, 2), KAFKA_APIS)),
            "version": F.when(_is("Request"), uint(_m(), 6, 2)),
            "client_id": F.when(_is("Request") & (size != 0xFFFF), F.regexp_replace(_text(14, size), r"[^A-Za-z0-9_:/-]", "")),
            "group_id": plain("group_id"),
            "topic": plain("topic"),
            "topic_id": F.col("_n.topic_id"),
            "error_code": F.when(_is("Response"), uint(_m(), 8, 2)),
            "error": F.when(_is("Response"), _name(F.when(uint(_m(), 8, 2) > 32767, uint(_m(), 8, 2) - 65536).otherwise(uint(_m(), 8, 2)), KAFKA_ERRORS)),
        }
    ).drop("_n")


def amqp(rows: DataFrame) -> DataFrame:
    """channel and frame_kind; class, method and both joined of method frames, with the names of exchange, routing key and queue that the method has among its first
    arguments, and the error of closes and returns; body_size of content headers."""
    frame, cls, number = uint(_m(), 0, 1), uint(_m(), 7, 2), uint(_m(), 9, 2)
    method = frame == 1
    names = F.create_map(*[F.lit(x) for c, own in AMQP_METHODS.items() for n, name in own.items() for x in (c << 16 | n, name)])
    name = F.coalesce(names[F.shiftleft(cls, 16).bitwiseOR(number).cast("int")], number.cast("string"))
    is_ = lambda c, *n: method & (cls == c) & number.isin(*n)
    # Short texts follow one another: each is a byte with its length and as many bytes. Two bytes are reserved before them, in a return there is the reply code.
    skip = F.when(is_(60, 60), F.lit(0)).when(is_(60, 71), F.lit(9)).otherwise(F.lit(2)) + 11
    text, at = [], skip
    for k in range(3):
        # After its consumer's tag, a delivery has a number and a flag.
        text.append(_text((at + 1).cast("int"), uint(_m(), at.cast("int"), 1)))
        at = at + 1 + uint(_m(), at.cast("int"), 1) + (F.when(is_(60, 60), 9).otherwise(0) if k == 0 else 0)
    code = F.when(is_(60, 50) | is_(10, 50) | is_(20, 40), uint(_m(), 11, 2))
    return rows.withColumns(
        {
            "channel": uint(_m(), 1, 2),
            "frame_kind": F.when(method, "Method").when(frame == 2, "Header").when(frame == 3, "Body").when(frame == 8, "Heartbeat"),
            "class": F.when(method, _name(cls, AMQP_CLASSES)),
            "method": F.when(method, name),
            "class_method": F.when(method, F.concat_ws(".", _name(cls, AMQP_CLASSES), name)),
            "exchange": F.when(is_(40, 10, 20) | is_(60, 40, 71), text[0]).when(is_(50, 20, 50) | is_(60, 50, 60), text[1]),
            "routing_key": F.when(is_(60, 40, 71), text[1]).when(is_(50, 20, 50) | is_(60, 50, 60), text[2]),
            "queue_name": F.when(is_(50, 10, 20, 30, 40, 50) | is_(60, 20, 70), text[0]),
            "error_code": code,
            "error": F.when(code.isNotNull(), _name(code, AMQP_ERRORS, F.lit("Unknown"))),
            "body_size": F.when(frame == 2, F.shiftleft(uint(_m(), 11, 4), 32).bitwiseOR(uint(_m(), 15, 4))),
        }
    )


def http2_frames(rows: DataFrame) -> DataFrame:
    """frame_kind, key (the stream's number) and end_stream of each frame."""
    return rows.withColumns(
        {
            "frame_kind": _name(uint(_m(), 3, 1), HTTP2_FRAMES),
            "key": uint(_m(), 5, 4).bitwiseAND(0x7FFFFFFF),
            "end_stream": uint(_m(), 3, 1).isin(0, 1) & (uint(_m(), 4, 1).bitwiseAND(1) == 1),
        }
    ).where(~F.substring(_m(), 1, 3).eqNullSafe(F.lit(b"PRI")))


def http2(rows: DataFrame, connection: str = "conn") -> DataFrame:
    """One row for each direction of each stream that has ended: method, path, scheme, authority, status, grpc_status, size of all its frames, first and last time."""
    frames = http2_frames(rows).where((F.col("key") > 0) & F.col("frame_kind").isin("HEADERS", "CONTINUATION", "DATA", "PUSH_PROMISE", "RST_STREAM"))
    pick = lambda name: F.max(F.col("fields")[name])
    names = {"method": ":method", "path": ":path", "scheme": ":scheme", "authority": ":authority", "status": ":status", "grpc_status": "grpc-status"}
    ended = frames.groupBy(connection, "role", "key").agg(*[pick(v).alias(k) for k, v in names.items()], F.sum("size").alias("size"), F.min("first_ns").alias("first_ns"), F.max("last_ns").alias("last_ns"), F.bool_or("end_stream").alias("ended"))
    return ended.where("ended").drop("ended")


def grpc(rows: DataFrame, connection: str = "conn") -> DataFrame:
    """As http2, with the service that the path names."""
    from ..functions.text import service_of

    return http2(rows, connection).withColumn("service", service_of(F.col("path")))


DECODERS: dict[str, Callable[[DataFrame], DataFrame]] = {"dns": dns, "redis": redis, "http": http, "mysql": mysql, "postgresql": postgresql, "mongodb": mongodb, "kafka": kafka, "amqp": amqp, "http2": http2, "grpc": grpc}
