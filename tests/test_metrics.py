from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wirelake.functions import text
from wirelake.operators import filters, metrics, spans


def test_histogram_bounds_hold_their_value(spark):
    df = spark.createDataFrame([(v,) for v in (0.001, 0.0010001, 600.0, 601.0, -1.0)], "v double").withColumn("g", F.lit(1))
    got = {r["le"]: r["count"] for r in metrics.histogram(df, ["g"], "v", "seconds").collect()}
    assert got["0.001"] == 2 and got["0.005"] == 3 and got["600"] == 4 and got["+Inf"] == 5


def test_log_buckets(spark):
    values = {0.0: -1, 1e-10: -1, 1e18: 486, 1e19: 486, 1.0: 161, 2.0: 167, float("nan"): None, -1.0: None}
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", metrics.log_bucket(F.col("v")).alias("b"))
    for r in df.collect():
        want = next(b for v, b in values.items() if v == r["v"] or v != v and r["v"] != r["v"])
        assert r["b"] == want, r
    names = metrics.log_ranges()
    assert len(names) == 486 and names[0] == "1.000e-09...1.136e-09" and names[-1].endswith("1.000e+18")


def test_expiry(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(seconds=s)) for s in (0, 300, 600.5, 2000)]
    got = metrics.expire(spark.createDataFrame(rows, "k string, ts timestamp"), ["k"], "ts").orderBy("session").collect()
    assert [r["value"] for r in got] == [2, 1, 1]


def test_quantile(spark):
    rows = [("x", le, c) for le, c in (("1", 10), ("2", 20), ("+Inf", 20))]
    got = metrics.quantile(spark.createDataFrame(rows, "k string, le string, count bigint"), ["k"], 0.75, (1.0, 2.0)).first()
    assert abs(got["value"] - 1.5) < 1e-12


def test_filter_text():
    R = filters.Rule
    assert filters.bpf_text([R("http", (80, 8080), "example.com"), R("dns", (53,))]) == "(tcp and host example.com and ( port 80 or port 8080 ) ) or (udp and port 53)"
    assert filters.bpf_text([R("redis")]) == ""
    try:
        filters.bpf_text([R("gopher", (70,))])
        raise AssertionError
    except ValueError:
        pass


def test_durations(spark):
    want = {0: "0s", 1: "1ns", 1500: "1.5µs", 681536: "681.536µs", 2_000_000: "2ms", 1_500_000_000: "1.5s", 60_000_000_000: "1m0s", 3_661_000_000_001: "1h1m1.000000001s", -1500: "-1.5µs"}
    df = spark.createDataFrame([(n,) for n in want], "n bigint").select("n", text.go_duration(F.col("n")).alias("d"))
    assert {r["n"]: r["d"] for r in df.collect()} == want


def test_traceparent(spark):
    good = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01"
    rows = [(good,), ("01" + good[2:],), ("00-xyz-00f067aa0ba902b7-01",), (None,), (good.upper().replace("00-", "00-", 1),)]
    df = spark.createDataFrame(rows, "h string").select(spans.trace_id(F.col("h")).alias("t"), spans.parent_id(F.col("h")).alias("p"))
    got = [tuple(r) for r in df.collect()]
    assert got[0] == ("4bf92f3577b34da6a3ce929d0e0e4736", "00f067aa0ba902b7")
    assert got[1] == got[2] == got[3] == (None, None)
    assert got[4] == got[0]


def test_text_functions(spark):
    r = spark.sql("SELECT ' get  key' AS c, '/a.B/C/' AS p, 'ff' AS h, 'x y!' AS n").select(text.command_word(F.col("c")), text.service_of(F.col("p")), text.from_hex(F.col("h")), text.plain_name(F.col("n"))).first()
    assert tuple(r) == ("GET", "a.B.C", 255, "xy")
