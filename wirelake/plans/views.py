"""The driver's tables seen as the engine's inputs: messages, round trips, segments, packets and HTTP exchanges. Each has its SQL twin in ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conn, seq, role."""
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant"))
    return c.select(F.col("conv_id").alias("conn"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "Request").otherwise("Response").alias("role"))


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conn, key, ts, event_id, role."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "signup")
    role = F.when(F.col("event_type").isin("view", "click"), "Request").otherwise("Response")
    return e.select(F.col("user_id").alias("conn"), (number() % 4).alias("key"), "ts", "event_id", role.alias("role"))


def number():
    return F.regexp_extract("props", "[0-9]+", 0).cast("int")


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, ts, client, method, status, secs, req_bytes, rsp_bytes, k."""
    k = number()
    status = F.when(k % 5 == 0, "500").when(k % 5 == 1, "404").when(k % 5 == 2, "302").otherwise("200")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("trip_id"),
        "ts",
        F.col("user_id").alias("client"),
        F.col("event_type").alias("method"),
        status.alias("status"),
        (F.col("value") / 100).alias("secs"),
        (k * 1024).alias("req_bytes"),
        (F.col("value") * 20000).alias("rsp_bytes"),
        k.alias("k"),
    )


#: Total order of the segments of a connection.
ARRIVAL = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conn, the columns of arrival, seq, len, fin."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("conn"),
        *ARRIVAL,
        ((F.col("l_linenumber") - 1) * 25).cast("bigint").alias("seq"),
        F.col("l_quantity").cast("int").alias("len"),
        (F.col("l_returnflag") == "R").alias("fin"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """packet_no, l4, ip_version, src_ip, dst_ip, src_port, dst_port, len from events."""
    k = number()
    port = F.when(k % 5 == 0, 80).when(k % 5 == 1, 3306).when(k % 5 == 2, 53).when(k % 5 == 3, 6379).otherwise(9999)
    to_server = F.col("event_id") % 2 == 0
    client = F.concat(F.lit("10.0."), (F.col("user_id") / 256).cast("int").cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    client_port = (F.lit(40000) + F.col("user_id")).cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("packet_no"),
        "ts",
        F.when(k % 5 == 2, "udp").otherwise("tcp").alias("l4"),
        F.when(k % 7 == 0, 6).otherwise(4).alias("ip_version"),
        F.when(to_server, client).otherwise("10.9.9.9").alias("src_ip"),
        F.when(to_server, F.lit("10.9.9.9")).otherwise(client).alias("dst_ip"),
        F.when(to_server, client_port).otherwise(port).cast("int").alias("src_port"),
        F.when(to_server, port).otherwise(client_port).cast("int").alias("dst_port"),
        (k * 10).alias("len"),
    )
