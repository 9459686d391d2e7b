"""Ranked search, prefix trie and near-duplicate vectors against brute force and SQL, with nulls, empty tables, repeats, long rows, ties and clashing columns."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.conftest import SF
from wirelake.llm import multiindex, prefixtrie, queries, ranked
from wirelake.llm.storage import Scratch

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_prefix_trie", "op13_multi_index"])
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cur = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert set(names) == set(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


# Ranked search


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def brute_ranks(docs, items, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, length = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    own = defaultdict(set)
    for i, t in items:
        own[i] |= set(terms(t))
    out = []
    for item, wanted in own.items():
        found = []
        for i, c in bags:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def some_documents():
    rng = random.Random(5)
    vocabulary = [rng.choice(["der", "Über", "a", "x1", "fi"]) + str(k % 7) * (k % 3) + rng.choice("abcé") for k in range(90)]
    docs = [(k, rng.choice([" ", "-", "\n", "  "]).join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for k in range(120)]
    docs += [(500, None), (501, ""), (502, " \x00.,-"), (3, docs[3][1]), (7, docs[9][1]), (None, docs[4][1]), (None, docs[4][1]), (503, vocabulary[0]), (504, " ".join(rng.choices(vocabulary, k=250_000))), (505, "z" * 1_500_000), (506, "Q\x00" + "\x00".join(vocabulary[:9]))]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 20)))) for k in range(30)]
    items += [(100, None), (101, ""), (102, "nowhere found"), (103, "z" * 1_500_000), (None, vocabulary[1]), (2, vocabulary[5]), (2, vocabulary[5] + " q")]
    return docs, items


@pytest.mark.parametrize("block", [16 << 20, 3000])
def test_ranked_search_against_brute_force(spark, block, monkeypatch):
    docs, items = some_documents()
    monkeypatch.setattr(ranked, "SCORED", 500)
    d = spark.createDataFrame([(i, t, 1.0, "x") for i, t in docs], "doc_id long, text string, score double, rank string").repartition(5)
    b = spark.createDataFrame([(i, t, 9, "y") for i, t in items], "item_id long, text string, doc_id long, term string")
    got = ranked.search(d, b, ranked.RankParams(block_bytes=block)).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute_ranks(docs, items)


def test_ranked_search_of_nothing(spark):
    docs, items = some_documents()
    d = spark.createDataFrame(docs[:5], "doc_id long, text string")
    b = spark.createDataFrame(items[:3], "item_id long, text string")
    none_d, none_b = d.where("false"), b.where("false")
    for x, y in ((d, none_b), (none_d, b), (none_d, none_b)):
        assert ranked.search(x, y).count() == 0
    assert ranked.search(d, none_b).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_match_only_whole():
    own = ranked.Terms([b"a", b"aa", b"b"], np.array([0, 1, 2, 3]), np.array([0, 0, 0], np.int32))
    n, text, term, tf = ranked.counted([b"A aa-aaa b.B", None, b"", b"aa", b"ab ba"], own)
    assert n.tolist() == [5, 0, 0, 1, 2]
    assert [*zip(text.tolist(), term.tolist(), tf.tolist())] == [(0, 0, 1), (0, 1, 1), (0, 2, 2), (3, 1, 1)]


# Prefix trie


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    plain = {c: [x[3:] for x in sorted(own)] for c, own in convs.items()}
    new = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = plain.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members, ending, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in new.items():
        path = b""
        paths = [path]
        for t in turns:
            path = hashlib.sha256(path + repr(t).encode()).digest()
            paths.append(path)
        for d, x in enumerate(paths):
            members[x].append((c, d, len(turns[d - 1][1].encode()) if d else 0))
            if d:
                children[paths[d - 1]].add(x)
        ending[paths[-1]].append(c)
    parent = {x: k for k, own in children.items() for x in own}
    total = {}
    for x in sorted(members, key=lambda x: -members[x][0][1]):
        own = [total[y] for y in children[x]]
        total[x] = (sum(t[0] for t in own) or 1, sum(t[1] for t in own) + (len(members[x]) - 1) * members[x][0][2])
    out = []
    for x, own in members.items():
        top = min(m[0] for m in members[parent[x]]) if x in parent else None
        out.append((min(m[0] for m in own), own[0][1], top, len(own), len(children[x]), *total[x], hashlib.sha256(",".join(map(str, sorted(ending[x]))).encode()).hexdigest()))
    return sorted(out, key=str)


def some_conversations():
    rng = random.Random(8)
    rows = []
    for c in range(-6, 70):
        shared = rng.randrange(0, 4)
        for turn in range(rng.randrange(1, 14)):
            text = f"common {turn}" if turn < shared * 3 else rng.choice(["yes", "no", f"turn {turn} é", ""])
            rows.append((c, turn, ["user", "assistant"][turn % 2], text))
    rows += [(200, None, None, None), (200, 0, "user", None), (200, 0, "user", "tie"), (200, 0, "user", "tie"), (200, 0, "a", "tie"), (None, 0, "user", "lost"), (203, 5, "user", "only"), (4_000_000_001, 1, "system", "x")]
    rows += [(205, k, "user", f"long {k}") for k in range(300)] + [(206, k, "user", f"long {k}") for k in range(300)] + [(207, k, "user", f"long {k}" if k < 150 else "other") for k in range(200)]
    return rows


@pytest.mark.parametrize("stretch", [4096, 7])
def test_trie_against_brute_force(spark, stretch):
    rows = some_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, id string").repartition(6)
    got = prefixtrie.trie(df, prefixtrie.TrieParams(stretch=stretch, chunk=20)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_no_turns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(empty).count() == 0
    lost = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(lost).count() == 0
    # Conversation 1 takes its first turns from conversation 0, which is absent, and has no more than those itself.
    short = [(c, 0, "user", "x") for c in range(1, 5)]
    got = prefixtrie.trie(spark.createDataFrame(short, empty.schema)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_trie(short)


def test_deep_chains_contract_in_few_rounds(spark):
    n = 400
    tree = spark.range(n).selectExpr("named_struct('x', id, 'y', 0L) AS id", "CASE WHEN id > 0 THEN named_struct('x', id - 1, 'y', 0L) END AS parent", "1L AS v", "id AS w")
    scratch = Scratch(spark, "chain")
    got = {r["id"]["x"]: (r["v"], r["w"]) for r in prefixtrie.contract(tree, ["v", "w"], scratch).collect()}
    assert got == {k: (n - k, sum(range(k, n))) for k in range(n)}


# Near-duplicate vectors


def brute_links(rows, least=0.93):
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v, lab in rows]
    n = len(rows)
    parent, count = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.array(v) / np.abs(v).max() if o else None for (_, v, _), o in zip(rows, ok)]
    unit = [v / np.linalg.norm(v) if o else None for v, o in zip(unit, ok)]
    for i in range(n):
        for j in range(i + 1, n):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= least:
                count[i] += 1
                count[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(rows[i][0])
    out = []
    for i in range(n):
        ids = [x for x in groups[find(i)] if x is not None]
        first = min(ids, default=None) if ok[i] else rows[i][0]
        out.append((rows[i][0], count[i], first, rows[i][0] is not None and rows[i][0] == first))
    return sorted(out, key=str)


def some_vectors(spread, size, seed=3):
    """Groups of noisy copies, of which one is large, among other vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate([size, 9, 5, 2, 2, 1, 1, 1, 1] + [1] * 40):
        c = rng.normal(size=16)
        c /= np.linalg.norm(c)
        for _ in range(n):
            v = c + rng.normal(size=16) * spread / 4
            rows.append((len(rows), (v * rng.uniform(0.5, 2)).tolist(), g % 2 if n > 1 else 0))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(4)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [float("nan")] * 16, 0), (1004, [None] * 16, 0), (1005, [float("inf")] + [1.0] * 15, 0), (1006, rows[0][1], None), (1007, rows[0][1][:5], 0), (1008, rows[0][1][:5], 0), (5, rows[5][1], rows[5][2]), (6, rows[7][1], rows[7][2]), (None, rows[8][1], rows[8][2]), (1009, [-0.0] * 15 + [1.0], 1), (1010, [0.0] * 15 + [1.0], 1), (1011, [1e200] * 16, 3), (1012, [1e-200] * 16, 3), (None, [1.0] + [0.0] * 15, 3)]
    return rows


@pytest.mark.parametrize("spread,crowd,block", [(0.15, 64, 1000), (0.15, 8, 30), (0.45, 8, 25), (0.3, 10**9, 10)])
def test_near_duplicates_against_brute_force(spark, spread, crowd, block):
    rows = some_vectors(spread, 90)
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "vec_id long, embedding array<double>, label int, cosine double, kept boolean").repartition(4)
    got = multiindex.near_duplicates(df, multiindex.DedupParams(crowd=crowd, block=block, recall=1.0)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows)


def test_near_duplicates_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert multiindex.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0], 3), (2, None, 3), (3, [1.0], None)], schema)
    assert sorted(map(tuple, multiindex.near_duplicates(one).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_multi_sequence_gives_pairs_in_order():
    rng = random.Random(2)
    for n, m in ((1, 1), (5, 3), (9, 12)):
        a, b = sorted(rng.choices(range(20), k=n)), sorted(rng.choices(range(20), k=m))
        got = [*multiindex.multi_sequence(a, b, 22)]
        every = sorted((x + y) for x in a for y in b if x + y <= 22)
        assert [t for _, _, t in got] == every
        assert len({(i, j) for i, j, _ in got}) == len(got) and all(a[i] + b[j] == t for i, j, t in got)
    assert heapq.nsmallest(1, [0]) and not [*multiindex.multi_sequence([], [1], 5)]


def test_recall_at_exactly_the_least_cosine():
    """Partners at cosine 0.93 of vectors that the grid was not fitted on, in 64 components: as many as wanted meet from either side."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(300, 64))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    make = lambda n: unit(centers[rng.integers(0, 300, n)] + 0.7 * rng.normal(size=(n, 64)))
    p = multiindex.DedupParams()
    grid = multiindex.fit(make(8000), 40_000, p)
    x = make(1500)
    noise = rng.normal(size=x.shape)
    y = 0.93 * x + math.sqrt(1 - 0.93**2) * unit(noise - (noise * x).sum(1, keepdims=True) * x)
    dx, dy = grid.distances(x), grid.distances(y)
    width = len(grid.second)
    own = lambda d: (d[0].argmin(1) * width + d[1].argmin(1)).tolist()
    cells = [*multiindex.visited(grid, *dx)]
    found = [b in u or a in v for a, b, u, v in zip(own(dx), own(dy), cells, multiindex.visited(grid, *dy))]
    assert np.mean(found) >= 0.98
    assert np.mean([len(c) for c in cells]) < 0.1 * width * width


def test_balls_link_all_their_members():
    rng = np.random.default_rng(4)
    p = multiindex.DedupParams()
    u = rng.normal(size=(3, 32))[rng.integers(0, 3, 400)] + 0.15 * rng.normal(size=(400, 32))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ball = multiindex.balls(u, p)
    assert ball.max() >= 0
    for k in range(ball.max() + 1):
        own = u[ball == k]
        assert len(own) >= p.ball and (own @ own.T).min() >= p.cosine - 1e-9
