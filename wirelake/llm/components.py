"""Connected components of a table of edges, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, skew_join


def _to_least(edges: DataFrame, scratch: Scratch, name: str, small: bool) -> DataFrame:
    """One round. For each node v with the least m of itself and its neighbours: its larger neighbours (large-star), or itself and its smaller ones (small-star), are tied
    to m. A node's neighbours are never gathered: their least is a partial aggregate, and nodes with very many meet it by a broadcast of at most 2000 rows."""
    both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
    if not small:
        both = both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = scratch.table(both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n")), f"{name}-least")
    total = least.agg(F.sum("n")).first()[0] or 0
    hot = least.where(F.col("n") >= max(64, total // 2000)).select("v")
    m = least.select("v", F.least("m", "v").alias("m"))
    tied = skew_join(both, m, "v", "inner", hot)
    if small:
        out = tied.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(m.select(F.col("v").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.where("u > v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    done = scratch.table(out.where("a <> b").distinct(), name)
    scratch.drop(f"{name}-least")
    return done


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the least node of its component."""
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-0")
    state, k = None, 0
    while True:
        k += 1
        large = _to_least(now, scratch, f"{label}-{k}-large", False)
        new = _to_least(large, scratch, f"{label}-{k}", True)
        scratch.drop(f"{label}-{k - 1}", f"{label}-{k}-large")
        now = new
        # Edges no longer change when every node is tied to its root alone.
        fresh = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if fresh == state:
            break
        state = fresh
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
