"""The cursor's window form against one that goes segment by segment."""

import random
from datetime import datetime, timedelta

from wirelake.operators import l4

TOP = 2**32 - 1


def cursor(segments):
    last, closed, out = 0, False, []
    for seq, n, fin in segments:
        row = {"closed": closed, "skip": False, "trim": None}
        if not closed:
            closed = fin
            if n:
                end = seq + n
                if end >= TOP:
                    last, end = 0, end - TOP
                if last >= end:
                    row["skip"] = True
                else:
                    row["trim"] = max(0, last - seq)
                    last = end
        out.append(row)
    return out


def test_cursor(spark):
    rng = random.Random(5)
    streams = {}
    for c in range(200):
        base = rng.choice([0, 1000, TOP - 60])
        streams[c] = [((base + rng.randrange(0, 120)) % TOP, rng.choice([0, 5, 10, 30]), rng.random() < 0.05) for _ in range(rng.randrange(1, 20))]
    rows = [(c, i, s, n, f) for c, v in streams.items() for i, (s, n, f) in enumerate(v)]
    df = l4.cursor(spark.createDataFrame(rows, "conn int, i int, seq bigint, len int, fin boolean"), ["conn"], ["i"])
    got = {(r["conn"], r["i"]): r for r in df.collect()}
    for c, v in streams.items():
        for i, want in enumerate(cursor(v)):
            r = got[c, i]
            assert (r["closed"], bool(r["skip"]), r["trim"]) == (want["closed"], want["skip"], want["trim"]), (v, i)


def test_idle_gap_is_strict(spark):
    t = datetime(2024, 1, 1)
    steps = [0, 300, 600.000001, 700]
    rows = [(1, i, t + timedelta(seconds=s)) for i, s in enumerate(steps)]
    df = l4.idle_epochs(spark.createDataFrame(rows, "conn int, i int, ts timestamp"), ["conn"], "ts", ["ts", "i"])
    assert [r["epoch"] for r in df.orderBy("i").collect()] == [0, 0, 1, 1]


def test_connection_id_has_no_direction(spark):
    df = spark.createDataFrame([("a", 1, "b", 2), ("b", 2, "a", 1)], "src_ip string, src_port int, dst_ip string, dst_port int")
    assert df.select(l4.connection_id()).distinct().count() == 1


def test_closing_epochs_of_two_directions(spark):
    rng = random.Random(9)
    conns = {c: [(rng.choice("lr"), rng.random() < 0.3) for _ in range(rng.randrange(1, 30))] for c in range(100)}
    rows = [(c, i, d, f) for c, v in conns.items() for i, (d, f) in enumerate(v)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = l4.closing_epochs(spark.createDataFrame(rows, "conn int, i int, side string, fin boolean"), ["conn"], "side", ["i"])
        got = {(r["conn"], r["i"]): (r["epoch"], r["refused"]) for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c, v in conns.items():
        epoch, open_ = 0, {"l": True, "r": True}
        for i, (d, f) in enumerate(v):
            assert got[c, i] == (epoch, not open_[d])
            if not open_[d]:
                epoch, open_ = epoch + 1, {"l": True, "r": True}
            elif f:
                open_[d] = False


def test_stretches_of_a_stream_give_the_same(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    streams = {}
    for c in range(60):
        base = rng.choice([0, 1000, TOP - 60, TOP - 200])
        streams[c] = [((base + rng.randrange(0, 250)) % TOP, rng.choice([0, 5, 10, 30]), rng.random() < 0.01) for _ in range(rng.randrange(1, 90))]
    rows = [(c, i, s, n, f) for c, v in streams.items() for i, (s, n, f) in enumerate(v)]
    df = spark.createDataFrame(rows, "conn int, i int, seq bigint, len int, fin boolean")
    cols = ["conn", "i", "closed", "skip", "trim", "gap", "delivered"]
    want = sorted(map(tuple, l4.cursor(df, ["conn"], ["i"]).select(*cols).collect()))
    for size in (1, 7, 1000):
        assert sorted(map(tuple, l4.cursor_by_stretch(df, ["conn"], ["i"], F.floor(F.col("i") / size)).select(*cols).collect())) == want
