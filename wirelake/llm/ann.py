"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that brings all to the same length, so that the largest inner product is the smallest distance. Centroids are fitted on a bounded sample
with a penalty on large lists; a graph over them, kept in memory, finds the lists of a vector. A vector near a border stands in up to ``copies`` lists; a query reads
all lists whose distance is within a ratio of the nearest one's, however many. Lists that outgrow their share, as with one very common vector, are dealt into sublists, and equal
query vectors are searched once. Lists of neighbouring centroids make a shard, which is what one task compares, so that a query gets one answer a shard and not one a
list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, skew_join


@dataclass(frozen=True)
class AnnParams:
    """``sample`` bounds the rows that centroids are fitted on and ``centroids`` their number; ``sublist`` and ``query_block`` bound what one task compares; ``probes`` is
    how many lists of a query the graph is asked for at first, not how many are read."""

    k: int = 20
    sample: int = 20_000
    list_size: int = 250
    centroids: int = 4096
    copies: int = 3
    copy_ratio: float = 1.05
    probes: int = 256
    least_probes: int = 24
    probe_ratio: float = 1.23
    shard_lists: int = 12
    sublist: int = 12_000
    query_block: int = 1000
    degree: int = 16
    beam: int = 32


@dataclass(frozen=True)
class CentroidGraph:
    points: np.ndarray  # K x (d + 1)
    links: np.ndarray  # K x degree
    shards: np.ndarray  # K
    entries: np.ndarray
    norm: float

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the nearest centroids found, nearest first, and their squared distances: best-first walks over the links, all rows in step."""
        n, k = len(x), len(self.points)
        beam = min(beam, k)
        seen = np.zeros((n, k), bool)
        row = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entries, (n, len(self.entries)))
        seen[:, self.entries] = True
        dist = self._distance(x, ids)
        pad = max(0, beam - ids.shape[1])
        ids, dist = np.pad(ids, ((0, 0), (0, pad))), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        ids, dist = ids[row, order], dist[row, order]
        opened = ~np.isfinite(dist)
        while not opened.all():
            pick = np.argsort(np.where(opened, np.inf, dist), axis=1, kind="stable")[:, :3]
            idle = opened[row, pick]
            opened[row, pick] = True
            near = self.links[ids[row, pick]].reshape(n, -1)
            old = seen[row, near] | np.repeat(idle, self.links.shape[1], axis=1)
            seen[row, np.where(old, ids[:, :1], near)] = True
            first = np.sort(np.where(old, -1, near), axis=1)
            new = np.where(np.diff(first, axis=1, prepend=-1) != 0, first, -1)
            d = np.where(new < 0, np.inf, self._distance(x, np.maximum(new, 0)))
            ids, dist, opened = np.hstack((ids, np.maximum(new, 0))), np.hstack((dist, d)), np.hstack((opened, new < 0))
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, opened = ids[row, order], dist[row, order], opened[row, order]
        return ids, dist

    def _distance(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.maximum(((x * x).sum(1)[:, None] + (self.points * self.points).sum(1)[ids] - 2 * np.einsum("nd,nmd->nm", x, self.points[ids])), 0)


def lengthen(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(norm * norm - (x * x).sum(1, keepdims=True), 0))))


def fit_graph(sample: np.ndarray, rows: int, norm: float, p: AnnParams) -> CentroidGraph:
    x = np.unique(lengthen(sample, norm), axis=0)
    rng = np.random.default_rng(9)
    k = int(max(1, min(p.centroids, rows // p.list_size, max(1, len(x) // 4))))
    points = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    square = (x * x).sum(1)[:, None]
    load = np.zeros(k)
    step = max(1, (1 << 22) // k)  # rows compared with all centroids at once: 32 MB
    for _ in range(15):
        distances = lambda at: square[at : at + step] + (points * points).sum(1) - 2 * x[at : at + step] @ points.T
        scale = 0.05 * np.median(np.concatenate([distances(at).min(1) for at in range(0, len(x), step)]))
        own = np.concatenate([(distances(at) + scale * load).argmin(1) for at in range(0, len(x), step)])
        sizes = np.bincount(own, minlength=k)
        load += 0.3 * (np.minimum(sizes / (len(x) / k), 4) - 1)
        for c in np.flatnonzero(sizes):
            # All points have the same length; a mean is brought back to it, or it would be near to everything.
            mean = x[own == c].mean(0)
            points[c] = mean * (norm / max(np.sqrt(mean @ mean), 1e-12))
        for c in np.flatnonzero(sizes == 0):
            points[c] = x[rng.integers(len(x))]
    near = []
    for at in range(0, k, step):
        d = (points[at : at + step] ** 2).sum(1)[:, None] + (points * points).sum(1) - 2 * points[at : at + step] @ points.T
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        near.append(np.argsort(d, axis=1, kind="stable")[:, : max(1, min(p.degree, k - 1))])
    near = np.concatenate(near)
    far = rng.integers(0, k, (k, 4))
    return CentroidGraph(points, np.hstack((near, far)), _shards(points, p.shard_lists), np.sort(rng.choice(k, min(k, 16), replace=False)), norm)


def _shards(points: np.ndarray, lists: int) -> np.ndarray:
    """Puts neighbouring centroids into groups of about ``lists``."""
    k = max(1, len(points) // lists)
    heads = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    own = np.zeros(len(points), np.int64)
    for _ in range(5):
        own = ((heads * heads).sum(1) - 2 * points @ heads.T).argmin(1)
        for c in np.unique(own):
            heads[c] = points[own == c].mean(0)
    return own.astype(np.int32)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), 1000):
            yield b.iloc[at : at + 1000]


def lists_of(batches: Iterator[pd.DataFrame], graph: CentroidGraph, p: AnnParams) -> Iterator[pd.DataFrame]:
    """Rows of each batch once for each of their lists: the nearest and those within the ratio, ``copies`` at the most."""
    for part in _parts(batches):
        ids, dist = graph.search(lengthen(_matrix(part["embedding"]), graph.norm), max(p.beam, p.copies))
        near = (dist <= dist[:, :1] * p.copy_ratio**2 + 1e-12) | (np.arange(ids.shape[1]) < 1)
        near &= (np.arange(ids.shape[1]) < p.copies) & np.isfinite(dist)
        row, col = np.nonzero(near)
        lists = ids[row, col]
        yield part.iloc[row].assign(list=lists.astype(np.int32), shard=graph.shards[lists])


def probes_of(batches: Iterator[pd.DataFrame], graph: CentroidGraph, p: AnnParams) -> Iterator[pd.DataFrame]:
    """Queries once for each shard with the lists to read there: the nearest ``least_probes`` and all within the ratio. The graph gives the nearest ``probes``; where even
    the last of them is within, there may be more, and the query is compared with every centroid."""
    k = len(graph.points)
    for part in _parts(batches):
        x = _matrix(part["embedding"])
        x = np.hstack((x, np.zeros((len(x), 1))))
        ids, dist = graph.search(x, max(p.beam, p.probes))
        near = ((dist <= dist[:, :1] * p.probe_ratio**2 + 1e-12) | (np.arange(ids.shape[1]) < p.least_probes)) & np.isfinite(dist)
        chosen = np.zeros((len(x), k), bool)
        row, col = np.nonzero(near)
        chosen[row, ids[row, col]] = True
        more = np.flatnonzero(near.all(1)) if ids.shape[1] < k else np.zeros(0, np.int64)
        if len(more):
            y = x[more]
            every = np.maximum((y * y).sum(1)[:, None] + (graph.points * graph.points).sum(1) - 2 * y @ graph.points.T, 0)
            chosen[more] |= every <= every.min(1, keepdims=True) * p.probe_ratio**2 + 1e-12
        row, lists = np.nonzero(chosen)
        shards = graph.shards[lists]
        order = np.lexsort((lists, shards, row))
        row, lists, shards = row[order], lists[order].astype(np.int32), shards[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shards[1:] != shards[:-1])]) if len(row) else np.zeros(0, np.int64)
        yield part.iloc[row[starts]].assign(lists=np.split(lists, starts[1:]) if len(starts) else [], shard=shards[starts])


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of the commonest length that is finite throughout and not zero."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").where(ok)
    size = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (size["n"] if size else 0))


@dataclass(frozen=True)
class Index:
    """``postings``: (shard, sub, list, vec_id, embedding), every row at least once; ``subs``: into how many parts a shard is dealt."""

    graph: CentroidGraph
    postings: DataFrame
    subs: dict[int, int]
    rows: int


def build(vectors: DataFrame, scratch: Scratch, p: AnnParams = AnnParams()) -> Index | None:
    rows = usable(vectors)
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))).first()
    if not n:
        return None
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, p.sample / n)) + 1).select("vec_id", "embedding").orderBy("vec_id").limit(2 * p.sample).toPandas()
    sample = _matrix(chosen["embedding"]) if len(chosen) else _matrix(rows.orderBy("vec_id").limit(1).toPandas()["embedding"])
    graph = fit_graph(sample, n, norm, p)
    held = rows.sparkSession.sparkContext.broadcast(graph)
    assigned = rows.mapInPandas(lambda it: lists_of(it, held.value, p), "vec_id long, embedding array<float>, list int, shard int")
    assigned = scratch.table(assigned, "assigned")
    sizes = {r["shard"]: r["count"] for r in assigned.groupBy("shard").count().collect()}  # one row for each centroid at most
    subs = {k: -(-v // p.sublist) for k, v in sizes.items()}
    large = {k: v for k, v in subs.items() if v > 1}
    many = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("shard")], F.lit(1)) if large else F.lit(1)
    return Index(graph, assigned.withColumn("sub", F.pmod(F.xxhash64("vec_id"), many).cast("int")), subs, n)


def best(q: np.ndarray, v: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of the k largest inner products of each row of ``q``, ties to smaller ids. Sums run over the components in order, so that equal vectors
    have equal scores wherever they stand."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    score = np.zeros((len(q), len(v)))
    for c in range(q.shape[1]):
        score += q[:, c : c + 1] * v[:, c]
    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(q)), top.shape[1])
    return row, ids[top.ravel()], score[row, top.ravel()]


def search(index: Index, queries: DataFrame, scratch: Scratch, p: AnnParams = AnnParams()) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows found of each query (query_id, embedding), without the row of the query's own id."""
    need = p.k + 1
    asked = scratch.table(queries.select("query_id", "embedding", F.xxhash64(F.col("embedding").cast("array<double>")).alias("qkey")), "queries")
    # Equal vectors share a key (two that differ would need equal 64-bit hashes).
    distinct = asked.groupBy("qkey").agg(F.min("embedding").alias("embedding")).repartition(max(12, index.rows // 20_000), "qkey")
    held = queries.sparkSession.sparkContext.broadcast(index.graph)
    probed = scratch.table(distinct.mapInPandas(lambda it: probes_of(it, held.value, p), "qkey long, embedding array<float>, lists array<int>, shard int"), "probed")
    counts = {r["shard"]: r["n"] for r in probed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    table = [(int(k), s, -(-counts.get(k, 0) // p.query_block)) for k, s in index.subs.items()]
    cells = F.broadcast(queries.sparkSession.createDataFrame([t for t in table if t[2]] or [(-1, 1, 1)], "shard int, subs int, blocks int"))
    left = probed.join(cells, "shard").withColumn("block", F.pmod(F.col("qkey"), F.col("blocks")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    right = index.postings.join(cells, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def compare(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qkey": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        out = [none]
        there = {k: own for k, own in v.groupby("list")}
        for k, asked_here in q.explode("lists").groupby("lists"):
            if k not in there:
                continue
            vectors, ids = _matrix(there[k]["embedding"]), there[k]["vec_id"].to_numpy(np.int64)
            for at in range(0, len(asked_here), 200):
                part = asked_here.iloc[at : at + 200]
                row, vec, score = best(_matrix(part["embedding"]), vectors, ids, need)
                out.append(pd.DataFrame({"qkey": part["qkey"].to_numpy()[row], "vec_id": vec, "score": score}))
        every = pd.concat(out).drop_duplicates(["qkey", "vec_id"]).sort_values(["qkey", "score", "vec_id"], ascending=[True, False, True])
        return every[every.groupby("qkey").cumcount() < need]

    keys = ["shard", "sub", "block"]
    found = left.select(*keys, "lists", "qkey", "embedding").groupBy(*keys).cogroup(right.select(*keys, "list", "vec_id", "embedding").groupBy(*keys)).applyInPandas(compare, "qkey long, vec_id long, score double")
    top = _ranked(found.groupBy("qkey", "vec_id").agg(F.max("score").alias("score")), "qkey").where(F.col("rank") <= need)
    rows = top.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))  # at most k + 1 of them
    rows = scratch.table(rows, "found")
    short = rows.where(F.size("found") < min(need, index.rows)).select("qkey").join(distinct, "qkey")
    if not short.isEmpty():
        rows = rows.join(short.select("qkey"), "qkey", "left_anti").unionByName(_exhaustive(index, short, need, p))
    joined = skew_join(asked.select("query_id", "qkey"), rows, "qkey")
    own = F.filter("found", lambda r: r["vec_id"] != F.col("query_id"))
    out = joined.select("query_id", F.posexplode(F.slice(own, 1, p.k)).alias("pos", "r"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("r.vec_id").alias("vec_id"), F.col("r.score").alias("score"))


def _ranked(df: DataFrame, by: str) -> DataFrame:
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")))


def _exhaustive(index: Index, queries: DataFrame, need: int, p: AnnParams) -> DataFrame:
    """The exact way for queries whose lists hold too few rows: in blocks of bounded size against all rows."""
    spark = queries.sparkSession
    rows = index.postings.select("vec_id", "embedding")
    parts = []
    block: list = []

    def against(own: list) -> DataFrame:
        keys, q = np.array([r["qkey"] for r in own]), np.array([r["embedding"] for r in own], np.float64)
        held = spark.sparkContext.broadcast((keys, q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keys, q = held.value
            for b in batches:
                for at in range(0, len(b), p.sublist):
                    part = b.iloc[at : at + p.sublist]
                    row, vec, score = best(q, _matrix(part["embedding"]), part["vec_id"].to_numpy(np.int64), need)
                    yield pd.DataFrame({"qkey": keys[row], "vec_id": vec, "score": score})

        return rows.mapInPandas(run, "qkey long, vec_id long, score double")

    for r in queries.toLocalIterator():
        block.append(r)
        if len(block) == p.query_block // 5:
            parts.append(against(block))
            block = []
    if block:
        parts.append(against(block))
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    top = _ranked(every.groupBy("qkey", "vec_id").agg(F.max("score").alias("score")), "qkey").where(F.col("rank") <= need)
    return top.groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))


def neighbours(vectors: DataFrame, every: int = 20, p: AnnParams = AnnParams()) -> DataFrame:
    """Queries: rows whose vec_id is divisible by ``every``; candidates: all others.

    Null, zero and non-finite vectors, those of another length than most, and rows without vec_id take no part; rows that repeat a vec_id are one candidate with the
    larger score; with fewer than k candidates all are returned; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    index = build(vectors, scratch, p)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = usable(vectors).where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    return search(index, queries, scratch, p)
