"""Near-duplicate vectors by an inverted multi-index.

Each half of the vectors, brought to length 1, has a codebook of its own; the pairs of their centroids are the cells of a product grid. A vector stands in the cell of its
nearest centroids and visits the cells of its group (equal label and number of components) in the order of their distance, which the multi-sequence traversal gives from
the two sorted lists of distances. It stops where cells are further than its own by more than a slack. The slack is fitted so that, of sampled vectors and partners made
at exactly the least cosine, the wanted share find one another from either side; nearer partners are found the more surely. What meets in a cell is verified in double precision.

Equal vectors are one node with a weight. Where a cell holds many nodes, those so near to a common centre that any two of them link by the triangle inequality make a
ball, which goes on as one unit; two balls link with all members or with none if the angles between centres say so, and only otherwise are their members compared. So a
large group of near copies costs about as many comparisons as it has balls, squared, and not as it has members. Units of a cell meet in blocks of bounded size; a block gives
counts and a spanning forest of its links, not the links.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .components import components
from .storage import Scratch, hot_values, skew_join


#: Stands for the id of vectors without one; it is above all others.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class DedupParams:
    """``recall`` is wanted of pairs at exactly ``cosine``; 1 visits all cells of a group. Codebooks are fitted on about ``sample`` vectors, at most twice as many, and have as many centroids that a cell
    would hold ``occupancy`` vectors if all cells were used alike, ``centroids`` at the most. ``block`` bounds the units that meet, ``crowd`` is the number of nodes from
    which a cell's nodes are gathered in balls, ``ball`` the least number of nodes in one."""

    cosine: float = 0.93
    recall: float = 0.99
    sample: int = 20_000
    occupancy: float = 16.0
    centroids: int = 4096
    block: int = 1000
    crowd: int = 64
    ball: int = 8


@dataclass(frozen=True)
class Grid:
    """The two codebooks and by how much a visited cell may be further away than the nearest one, in squared distance."""

    first: np.ndarray
    second: np.ndarray
    slack: float

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of each row to all centroids."""
        half = self.first.shape[1]
        return _distances(x[:, :half], self.first), _distances(x[:, half:], self.second)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * x @ centroids.T, 0)


def multi_sequence(a: list[float], b: list[float], limit: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of places in two sorted lists in the order of the sum of what stands there, as long as that is within ``limit``.

    A pair enters the queue once the pairs before it in both lists have left it, so the queue stays as short as the traversal's front."""
    if not a or not b or a[0] + b[0] > limit:
        return
    front = [(a[0] + b[0], 0, 0)]
    left = [0] * len(a)  # how many pairs of each row have left the queue
    while front:
        total, i, j = heapq.heappop(front)
        yield i, j, total
        left[i] = j + 1
        if i + 1 < len(a) and left[i + 1] == j and a[i + 1] + b[j] <= limit:
            heapq.heappush(front, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < len(b) and (i == 0 or left[i - 1] > j + 1) and a[i] + b[j + 1] <= limit:
            heapq.heappush(front, (a[i] + b[j + 1], i, j + 1))


def visited(grid: Grid, d1: np.ndarray, d2: np.ndarray) -> Iterator[list[int]]:
    """For each row the cells within the slack, nearest first."""
    width = len(grid.second)
    least1, least2 = d1.min(1), d2.min(1)
    for r in range(len(d1)):
        limit = least1[r] + least2[r] + grid.slack
        near1, near2 = np.flatnonzero(d1[r] <= limit - least2[r]), np.flatnonzero(d2[r] <= limit - least1[r])
        near1, near2 = near1[np.argsort(d1[r, near1], kind="stable")], near2[np.argsort(d2[r, near2], kind="stable")]
        # The nearest cell is always visited, whatever rounding does to the limit.
        own = int(d1[r].argmin()) * width + int(d2[r].argmin())
        order1, order2 = near1.tolist(), near2.tolist()
        cells = [order1[i] * width + order2[j] for i, j, _ in multi_sequence(d1[r, near1].tolist(), d2[r, near2].tolist(), limit)]
        yield cells if own in cells else [own, *cells]


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    points = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    step = max(1, (1 << 22) // k)  # 32 MB of distances at once
    for _ in range(8):
        own = np.concatenate([_distances(x[at : at + step], points).argmin(1) for at in range(0, len(x), step)])
        order = np.argsort(own, kind="stable")
        full, start = np.unique(own[order], return_index=True)
        points[full] = np.add.reduceat(x[order], start, axis=0) / np.diff(np.append(start, len(x)))[:, None]
    return points


def fit(sample: np.ndarray, rows: int, p: DedupParams) -> Grid:
    """Codebooks and slack from vectors of length 1."""
    rng = np.random.default_rng(13)
    k = int(max(1, min(np.sqrt(rows / p.occupancy), p.centroids, len(sample) // 2)))
    half = (sample.shape[1] + 1) // 2
    first, second = _codebook(sample[:, :half], k, rng), _codebook(sample[:, half:], k, rng)
    if p.recall >= 1:
        return Grid(first, second, float("inf"))
    grid = Grid(first, second, 0.0)
    x = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    y = p.cosine * x + np.sqrt(1 - p.cosine**2) * noise
    row = np.arange(len(x))

    def beyond(d: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return sum(a[row, b.argmin(1)] - a.min(1) for a, b in zip(d, other))

    here, there = grid.distances(x), grid.distances(y)
    return Grid(first, second, float(np.quantile(np.minimum(beyond(here, there), beyond(there, here)), p.recall)) + 1e-9)


def _matrix(column: pd.Series | list, width: int | None = None) -> np.ndarray:
    """Rows of length 1; shorter ones are filled up with zeros, which changes no cosine."""
    rows = [np.asarray(v, np.float64) for v in column]
    width = width or max((len(v) for v in rows), default=0)
    x = np.zeros((len(rows), width))
    for k, v in enumerate(rows):
        x[k, : len(v)] = v
    # Very large and very small components would leave the range of doubles when squared.
    x /= np.abs(x).max(1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def balls(u: np.ndarray, p: DedupParams) -> np.ndarray:
    """A number of a ball for each row, -1 for rows in none. Rows of a ball are within half the least angle of its centre, so any two of them link."""
    out = np.full(len(u), -1)
    reach = np.cos(np.arccos(p.cosine) / 2 - 1e-6)
    c = u @ u.T >= reach
    free, k = np.ones(len(u), bool), 0
    while True:
        near = np.where(free, c @ free.astype(np.int32), 0)
        seed = int(near.argmax())
        if near[seed] < p.ball:
            return out
        mean = u[c[seed] & free].mean(0)
        mean /= np.sqrt(mean @ mean)
        wider, plain = free & (u @ mean >= reach), free & c[seed]
        mine = wider if wider.sum() > plain.sum() else plain
        out[mine], free[mine] = k, False
        k += 1


def forest(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (larger id, least id of the component) with the same components as the links a[i]-b[j]."""
    ids, at = np.unique(np.concatenate((a[i], b[j])), return_inverse=True)
    x, y = at[: len(i)], at[len(i) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], least)
        np.minimum.at(new, root[y], least)
        new = new[new]
        if (new == root).all():
            return [(int(ids[k]), int(ids[r])) for k, r in enumerate(root.tolist()) if k != r]
        root = new


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut anew so that no group is cut; a group must be small enough to be held."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = (b[key] == b[key].iloc[-1]).all(axis=1).to_numpy()
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut == 0 and held and (held[-1][key].iloc[-1] == b[key].iloc[0]).all():
            held.append(b)
            continue
        out = pd.concat([*held, b.iloc[:cut]])
        if len(out):
            yield out
        held = [b.iloc[cut:]]
    if held:
        yield pd.concat(held)


_FOUND = "kind int, a long, b long, n long"
COUNT, LINK, OPEN = 0, 1, 2


def meet(part: pd.DataFrame, p: DedupParams) -> list[tuple[int, int, int, int]]:
    """What visitors and residents of one block give: counts of linked vectors for units, links as a forest, pairs of units whose members must be compared."""
    v, r = part[part["visits"]], part[~part["visits"]]
    if not len(v) or not len(r):
        return []
    cosine = _matrix(v["center"]) @ _matrix(r["center"]).T
    here, there = v["unit"].to_numpy(), r["unit"].to_numpy()
    reach = v["radius"].to_numpy()[:, None] + r["radius"].to_numpy()
    theta, angle = np.arccos(p.cosine), np.arccos(np.clip(cosine, -1, 1))
    single = reach == 0
    other = here[:, None] != there
    sure = other & np.where(single, cosine >= p.cosine, angle + reach <= theta - 1e-7)
    unsure = other & ~single & ~sure & (angle - reach <= theta + 1e-7)
    i, j = np.nonzero(sure | unsure)
    if not len(i):
        return []
    cells, seen = v["own"].to_numpy(), [set(x) for x in r["cells"]]
    mutual = np.fromiter((int(cells[x]) in seen[y] for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
    linked = sure[i, j]
    out = []
    if linked.any():
        i2, j2 = i[linked], j[linked]
        mine, theirs = np.zeros(len(v), np.int64), np.zeros(len(r), np.int64)
        np.add.at(mine, i2, r["together"].to_numpy()[j2])
        one_sided = ~mutual[linked]
        np.add.at(theirs, j2[one_sided], v["together"].to_numpy()[i2[one_sided]])
        out += [(COUNT, x, 0, n) for x, n in zip(here.tolist(), mine.tolist()) if n]
        out += [(COUNT, x, 0, n) for x, n in zip(there.tolist(), theirs.tolist()) if n]
        out += [(LINK, a, b, 1) for a, b in forest(i2, j2, here, there)]
    # A pair that both sides see is compared once, from the unit of the smaller number.
    out += [(OPEN, int(here[x]), int(there[y]), 1) for x, y, m, k in zip(i.tolist(), j.tolist(), mutual.tolist(), linked.tolist()) if not k and (not m or here[x] < there[y])]
    return out


def _usable(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(c, lambda v: v != 0)


def _kind(vectors: DataFrame) -> str:
    """Components stay float where they are; others are double."""
    return "float" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "double"


def _nodes(vectors: DataFrame) -> DataFrame:
    """Rows with vectors that take part: ``node`` is a 64-bit hash of vector and group, which is label and number of components."""
    kind = _kind(vectors)
    rows = vectors.where(F.col("label").isNotNull() & F.coalesce(_usable("embedding"), F.lit(False)))
    # Minus zero is zero.
    plain = F.transform("embedding", lambda v: F.when(v == 0, F.lit(0.0).cast(kind)).otherwise(v.cast(kind)))
    return rows.select("vec_id", F.xxhash64("label", F.size("embedding")).alias("g"), plain.alias("embedding")).withColumn("node", F.xxhash64("g", "embedding"))


def links(vectors: DataFrame, scratch: Scratch, p: DedupParams = DedupParams()) -> DataFrame | None:
    """(node, n_links, component_id) of the different vectors that take part; None without any."""
    spark = vectors.sparkSession
    rows = _nodes(vectors)
    nodes = scratch.table(rows.groupBy("node").agg(F.first("g").alias("g"), F.first("embedding").alias("embedding"), F.count("*").alias("weight"), F.coalesce(F.min("vec_id").cast("long"), F.lit(NO_ID)).alias("least")), "nodes")
    n, width = nodes.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        return None
    chosen = nodes.where(F.pmod(F.xxhash64("node", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, p.sample / n)) + 1).select("embedding").limit(2 * p.sample).toPandas()["embedding"]
    if len(chosen) < 2:
        chosen = nodes.select("embedding").limit(2).toPandas()["embedding"]
    held = spark.sparkContext.broadcast(fit(_matrix(chosen, width), n, p))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = held.value
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                d1, d2 = grid.distances(_matrix(part["embedding"], width))
                yield part.assign(cell=d1.argmin(1) * len(grid.second) + d2.argmin(1), cells=[*visited(grid, d1, d2)])

    placed = nodes.mapInPandas(place, f"node long, g long, embedding array<{_kind(vectors)}>, weight long, least long, cell long, cells array<long>")
    # Cells are named by a hash of group and place from here on.
    placed = placed.withColumn("cell", F.xxhash64("g", "cell")).withColumn("cells", F.transform("cells", lambda c: F.xxhash64("g", c)))
    placed = scratch.table(placed, "placed")
    units = scratch.table(_units(placed, p), "units")
    found = scratch.table(_found(units, p), "found")
    opened = found.where(F.col("kind") == OPEN)
    more = None
    if not opened.isEmpty():
        more = scratch.table(_compared(opened, units, placed, p), "compared")
    edges = found.where(F.col("kind") == LINK).select("a", "b")
    counts = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("unit")).agg(F.sum("n").alias("n_unit"))
    of_node = spark.createDataFrame([], "node long, n_node long")
    if more is not None:
        edges = edges.unionByName(more.where(F.col("kind") == LINK).select("a", "b"))
        of_node = more.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_node"))
    roots = components(edges, scratch, "groups").withColumnRenamed("node", "unit")
    named = units.select("unit", "together", "least_id").join(roots, "unit", "left").join(counts, "unit", "left").withColumn("root", F.coalesce("root", "unit"))
    named = scratch.table(named, "named")
    firsts = named.groupBy("root").agg(F.nullif(F.min("least_id"), F.lit(NO_ID)).alias("component_id"))
    named = skew_join(named, firsts, "root")
    members = units.select("unit", F.explode("members").alias("m")).select("unit", F.col("m.node").alias("node"), F.col("m.weight").alias("weight"))
    out = members.join(named, "unit").join(of_node, "node", "left")
    total = F.col("together") - 1 + F.coalesce("n_unit", F.lit(0)) + F.coalesce("n_node", F.lit(0))
    return scratch.table(out.select("node", total.cast("long").alias("n_links"), "component_id"), "links")


_UNIT = "unit long, g long, cell long, cells array<long>, center array<{kind}>, radius double, together long, least_id long, members array<struct<node:long,weight:long>>"


def _units(placed: DataFrame, p: DedupParams) -> DataFrame:
    """Nodes, or balls of them where cells are crowded. ``together`` is the number of vectors in a unit."""
    crowded = placed.groupBy("cell").count().where(F.col("count") >= p.crowd).select("cell", F.ceil(F.col("count") / p.block).alias("parts"))
    single = placed.join(crowded.select("cell"), "cell", "left_anti")
    dense = skew_join(placed, crowded, "cell").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), "parts"))
    kind = _kind(placed)
    as_unit = ["node AS unit", "g", "cell", "cells", "embedding AS center", "0D AS radius", "weight AS together", "least AS least_id", "array(struct(node, weight)) AS members"]

    def gather(b: pd.DataFrame) -> pd.DataFrame:
        u = _matrix(b["embedding"])
        ball = balls(u, p)
        out = []
        for k in range(ball.max(initial=-1) + 1):
            at = np.flatnonzero(ball == k)
            own = b.iloc[at]
            center = u[at].mean(0)
            center = (center / np.sqrt(center @ center)).astype(np.float32 if kind == "float" else np.float64)
            radius = float(np.arccos(np.clip(u[at] @ _matrix([center])[0], -1, 1)).max()) + 1e-7
            cells = sorted({c for x in own["cells"] for c in x})
            out.append((int(own["node"].min()), int(own["g"].iloc[0]), int(own["cell"].iloc[0]), cells, center.tolist(), radius, int(own["weight"].sum()), int(own["least"].min()), [{"node": int(n), "weight": int(w)} for n, w in zip(own["node"], own["weight"])]))
        for r in b[ball < 0].itertuples():
            out.append((r.node, r.g, r.cell, list(r.cells), list(r.embedding), 0.0, r.weight, r.least, [{"node": int(r.node), "weight": int(r.weight)}]))
        return pd.DataFrame(out, columns="unit g cell cells center radius together least_id members".split())

    gathered = dense.groupBy("cell", "g", "part").applyInPandas(gather, _UNIT.format(kind=kind))
    return single.selectExpr(*as_unit).unionByName(gathered)


def _found(units: DataFrame, p: DedupParams) -> DataFrame:
    """Visitors and residents of each cell meet in blocks: each resident part with each visitor part, of about ``block`` units."""
    there = units.groupBy("cell").agg(F.count("*").alias("n"))
    asked = units.select("unit", F.col("cell").alias("own"), F.explode("cells").alias("cell"))
    # Nobody is met in an empty cell, nor in the own one by the only unit there.
    asked = asked.join(there, "cell").where("NOT (cell = own AND n = 1)")
    visits = asked.groupBy("cell").agg(F.first("n").alias("n"), F.count("*").alias("v")).select("cell", F.ceil(F.col("n") / p.block).alias("subs"), F.ceil(F.col("v") / p.block).alias("blocks"))
    part = lambda seed, many: F.pmod(F.xxhash64("unit", F.lit(seed)), F.col(many))
    every = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    left = asked.select("cell", "unit", "own").join(visits, "cell").withColumn("block", part(3, "blocks")).withColumn("sub", every("subs"))
    left = left.join(units.select("unit", "center", "radius", "together"), "unit").withColumn("visits", F.lit(True)).withColumn("cells", F.array().cast("array<long>"))
    right = units.join(visits, "cell").withColumn("sub", part(5, "subs")).withColumn("block", every("blocks")).withColumn("visits", F.lit(False)).withColumn("own", F.col("cell"))
    key = ["cell", "sub", "block"]
    cols = [*key, "visits", "unit", "own", "center", "radius", "together", "cells"]
    rows = left.select(*cols).unionByName(right.select(*cols)).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_groups(batches, key):
            # An own number for each group, as rows are sorted.
            k = b[key].to_numpy()
            border = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1), True])
            out = [x for lo, hi in zip(border[:-1].tolist(), border[1:].tolist()) for x in meet(b.iloc[lo:hi], p)]
            yield pd.DataFrame(out, columns=["kind", "a", "b", "n"])

    return rows.mapInPandas(run, _FOUND)


def _compared(opened: DataFrame, units: DataFrame, placed: DataFrame, p: DedupParams) -> DataFrame:
    """Members of two units against one another, where the angles of the centres leave it open: counts for nodes, links for units. A unit has at most a block of members."""
    pairs = opened.select("a", "b").distinct()
    wanted = pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct()
    members = units.join(wanted, "unit").select("unit", F.explode("members").alias("m")).select("unit", F.col("m.node").alias("node"))
    whole = members.join(placed.select("node", "weight", "embedding"), "node").groupBy("unit").agg(F.collect_list(F.struct("node", "weight", "embedding")).alias("m"))
    side = lambda name: whole.select(F.col("unit").alias(name), F.col("m").alias(f"m{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                x, y = _matrix([m["embedding"] for m in r.ma]), _matrix([m["embedding"] for m in r.mb])
                hit = x @ y.T >= p.cosine
                if hit.any():
                    wa, wb = np.array([m["weight"] for m in r.ma]), np.array([m["weight"] for m in r.mb])
                    out += [(COUNT, m["node"], 0, int(k)) for m, k in zip(r.ma, hit @ wb) if k]
                    out += [(COUNT, m["node"], 0, int(k)) for m, k in zip(r.mb, wa @ hit) if k]
                    out.append((LINK, r.a, r.b, 1))
            yield pd.DataFrame(out, columns=["kind", "a", "b", "n"])

    return rows.mapInPandas(run, _FOUND)


def near_duplicates(vectors: DataFrame, p: DedupParams = DedupParams()) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Vectors link if their labels are equal and not null, they have as many components, and their cosine is at least ``cosine``. Null, empty and zero vectors, those with
    null or non-finite components and rows without label link with nothing. Rows that repeat an id are vectors of their own, which link like others; a row without id has
    links, counts for its partners, and is in the component of those that have ids, but is not kept. Ties at exactly the least cosine link. An empty table gives no rows;
    other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "multiindex")
    found = links(vectors.select("vec_id", "embedding", "label"), scratch, p)
    rows = vectors.select("vec_id", "embedding", "label")
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    known = _nodes(rows).select("vec_id", "node")
    out = rows.where(~(F.col("label").isNotNull() & F.coalesce(_usable("embedding"), F.lit(False)))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(skew_join(known, found, "node", "inner", hot_values(known, "node")).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
