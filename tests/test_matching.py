"""Window forms of the matchers against matchers that go message by message."""

import random

import pytest

from wirelake.operators import matching

PUBLISHED = {"RR": 0, "SR": 0, "RS": 1, "SSR": 0, "SRS": 1, "RRS": 0, "RRSS": 0, "RRSSSRS": 1}


def single(seq):
    held, out = None, []
    for k, r in seq:
        if r == "R":
            held = None if held is not None else k
        elif held is not None:
            out.append((held, k))
            held = None
    return out


def listed(seq, size, either=False):
    waiting, out = [], []
    for i, (r, k) in enumerate(seq):
        if (either or r == "R") and len(waiting) >= size:
            waiting.pop(0)
        hit = next((x for x in waiting if x[1] != r and x[2] == k), None) if either or r == "S" else None
        if hit:
            waiting.remove(hit)
            out.append((i, hit[0]) if r == "R" else (hit[0], i))
        elif either or r == "R":
            waiting.append((i, r, k))
    return sorted(out)


def frame(spark, seqs):
    rows = [(c, i, k, "Request" if r == "R" else "Response") for c, s in seqs.items() for i, (r, k) in enumerate(s)]
    return spark.createDataFrame(rows, "conn int, seq int, key int, role string")


def found(df, a, b):
    out = {}
    for r in df.collect():
        out.setdefault(r["conn"], []).append((r[a], r[b]))
    return {c: sorted(v) for c, v in out.items()}


@pytest.fixture(scope="module")
def seqs():
    rng = random.Random(3)
    return {c: [(rng.choice("RS"), rng.randrange(3)) for _ in range(rng.randrange(0, 25))] for c in range(300)}


def test_single(spark, seqs):
    for c, s in enumerate(PUBLISHED):
        assert len(single(list(enumerate(s)))) == PUBLISHED[s]
        seqs[1000 + c] = [(r, 0) for r in s]
    got = found(matching.single(frame(spark, seqs), ["conn"], ["seq"], ["seq"]), "req_seq", "rsp_seq")
    for c, s in seqs.items():
        assert got.get(c, []) == single([(i, r) for i, (r, _) in enumerate(s)]), s


def test_by_key_and_unanswered(spark, seqs):
    df = frame(spark, seqs)
    got = found(matching.by_key(df, ["conn", "key"], ["seq"], ["seq"]), "req_seq", "rsp_seq")
    left = {(r["conn"], r["seq"]) for r in matching.unanswered(df, ["conn", "key"], ["seq"], ["seq"]).collect()}
    for c, s in seqs.items():
        want = listed(s, 10**6)
        assert got.get(c, []) == want
        answered = {a for a, _ in want}
        assert {q for k, q in left if k == c} == {i for i, (r, _) in enumerate(s) if r == "R" and i not in answered}


def test_fuzzy(spark, seqs):
    got = found(matching.fuzzy(frame(spark, seqs), ["conn", "key"], ["seq"], ["seq"]), "req_seq", "rsp_seq")
    assert all(got.get(c, []) == listed(s, 10**6, True) for c, s in seqs.items())


@pytest.mark.parametrize("either", [False, True])
def test_bounded(spark, seqs, either):
    got = found(matching.bounded(frame(spark, seqs), ["conn"], "key", ["seq"], 3, "seq", either), "req", "rsp")
    assert all(got.get(c, []) == listed(s, 3, either) for c, s in seqs.items())


def test_overflow_split_is_exact(spark, seqs):
    marked = matching.mark_overflow(frame(spark, seqs), ["conn"], "key", ["seq"], 3)
    safe = matching.by_key(marked.where("NOT overflow"), ["conn", "key"], ["seq"], ["seq"])
    got = found(safe, "req_seq", "rsp_seq")
    over = {r["conn"] for r in marked.where("overflow").select("conn").distinct().collect()}
    assert over and over != set(seqs)
    assert all(got.get(c, []) == listed(s, 3) for c, s in seqs.items() if c not in over)


def test_fuzzy_overflow_split_is_exact(spark, seqs):
    marked = matching.mark_fuzzy_overflow(frame(spark, seqs), ["conn"], "key", ["seq"], 3)
    got = found(matching.fuzzy(marked.where("NOT overflow"), ["conn", "key"], ["seq"], ["seq"]), "req_seq", "rsp_seq")
    over = {r["conn"] for r in marked.where("overflow").select("conn").distinct().collect()}
    assert over and over != set(seqs)
    assert all(got.get(c, []) == listed(s, 3, True) for c, s in seqs.items() if c not in over)


def test_bounded_carries_its_list_over_batches(spark):
    """A connection comes to the fold in pieces, never as one group."""
    rng = random.Random(8)
    s = [(rng.choice("RS"), rng.randrange(3)) for _ in range(500)]
    assert listed(s, 3, True)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = matching.bounded(frame(spark, {1: s, 2: s}), ["conn"], "key", ["seq"], 3, "seq", True)
        assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()
        assert found(df, "req", "rsp") == {1: listed(s, 3, True), 2: listed(s, 3, True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("size", [None, 4])
def test_amqp_pairs_opposite_sides(spark, size):
    rng = random.Random(4)
    methods = ["Publish", "Ack", "Deliver", "Get", "Get-Ok"]
    conns = {c: [(rng.choice("RS"), rng.randrange(3), rng.choice(methods)) for _ in range(rng.randrange(0, 25))] for c in range(150)}
    rows = [(c, i, k, "Basic", m, "Request" if r == "R" else "Response") for c, s in conns.items() for i, (r, k, m) in enumerate(s)]
    df = matching.amqp(spark.createDataFrame(rows, "conn int, seq int, channel int, class string, method string, role string"), ["conn"], ["seq"], ["seq"], size)
    assert df.columns == ["conn", "channel", "class", "req_seq", "rsp_seq"]
    got = found(df, "req_seq", "rsp_seq")
    answers = lambda m: m.endswith("-Ok") or m == "Ack"
    for c, s in conns.items():
        keyed = [(r, (k, m.removesuffix("-Ok") if k == 0 else "")) for r, k, m in s]
        want = listed(keyed, size or 10**6, True)
        assert got.get(c, []) == sorted((b, a) if answers(s[a][2]) else (a, b) for a, b in want)
