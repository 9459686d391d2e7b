"""Selecting packets: port rules, IP versions, routing to protocols, and the check of round trips."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The transport of each application protocol.
TRANSPORT = {"amqp": "tcp", "dns": "udp", "grpc": "tcp", "http": "tcp", "http2": "tcp", "kafka": "tcp", "mongodb": "tcp", "mysql": "tcp", "postgresql": "tcp", "redis": "tcp"}


@dataclass(frozen=True)
class Rule:
    """Traffic of one protocol: any of the ports, and the host if one is given."""

    protocol: str
    ports: Sequence[int] = field(default_factory=tuple)
    host: str = ""

    @property
    def transport(self) -> str:
        if self.protocol not in TRANSPORT:
            raise ValueError(f"unknown protocol {self.protocol!r}")
        return TRANSPORT[self.protocol]


def bpf_text(rules: Sequence[Rule]) -> str:
    """The rules as a packet filter expression; rules without ports say nothing."""
    out = []
    for r in rules:
        head = r.transport + (f" and host {r.host}" if r.host else "")
        if len(r.ports) == 1:
            out.append(f"({head} and port {r.ports[0]})")
        elif r.ports:
            out.append(f"({head} and ( {' or '.join(f'port {p}' for p in r.ports)} ) )")
    return " or ".join(out)


def rule_predicate(rules: Sequence[Rule]) -> Column:
    """The same as a predicate over l4, src_ip, dst_ip, src_port, dst_port. The capture source takes no filters; Spark applies it in the stage of the scan, before any shuffle."""
    keep = F.lit(False)
    for r in rules:
        ports = list(r.ports)
        if not ports:
            continue
        one = (F.col("l4") == r.transport) & (F.col("src_port").isin(ports) | F.col("dst_port").isin(ports))
        if r.host:
            one = one & ((F.col("src_ip") == r.host) | (F.col("dst_ip") == r.host))
        keep = keep | one
    return keep


def ip_version_predicate(version: str) -> Column:
    """``v4`` or ``v6``; anything else means both."""
    wanted = {"v4": [4], "v6": [6]}.get(version, [4, 6])
    return F.col("ip_version").isin(wanted)


def route(packets: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds proto and server_port: the source port's protocol, else the destination port's. Packets of other ports go.

    Of several rules with one port the last counts. The rules, and so the table, are configuration.
    """
    spark = packets.sparkSession
    table = spark.createDataFrame(list({p: r.protocol for r in rules for p in r.ports}.items()), "port int, proto string")
    src = F.broadcast(table.select(F.col("port").alias("src_port"), F.col("proto").alias("_src")))
    dst = F.broadcast(table.select(F.col("port").alias("dst_port"), F.col("proto").alias("_dst")))
    both = packets.join(src, "src_port", "left").join(dst, "dst_port", "left")
    both = both.withColumns({"proto": F.coalesce("_src", "_dst"), "server_port": F.when(F.col("_src").isNotNull(), F.col("src_port")).otherwise(F.col("dst_port"))})
    return both.where("proto IS NOT NULL").drop("_src", "_dst")


def role() -> Column:
    """Who speaks: what goes to the server's port is a request."""
    return F.when(F.col("dst_port") == F.col("server_port"), "Request").otherwise("Response")


def valid_round_trip() -> Column:
    """A response comes strictly after its request."""
    return F.col("rsp_ns") > F.col("req_ns")
