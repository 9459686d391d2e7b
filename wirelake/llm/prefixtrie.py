"""The trie of conversation prefixes and what its subtrees hold, by parallel tree contraction.

A node is a distinct sequence of first turns. It is named by the sum, modulo 2**50 in two lanes, of hashes of (place, role and text) over its turns, which a running sum
gives for all prefixes of a conversation; a digest stands for role and text from the first scan on, so texts are not shuffled. Places of turns come from one sort of all
rows over ranges, so a conversation of any length may span tasks.

Subtree totals: a rake takes all leaves off and adds what they hold to their parents, a compress takes nodes with an only child out of chains and adds what they hold to
the parents above, a set of nodes no two of which are neighbours at a time, drawn by a hash. Each round is a few joins of what is left, and the rounds grow as the
logarithm of the number of nodes, however deep the trie. A raked node's total is final; for one taken out of a chain the child and what it held itself are written down. Then
the rounds are gone through backwards, and each such node gets its total from that of its child.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, crc_mod, skew_join

LANE = 1 << 50


@dataclass(frozen=True)
class TrieParams:
    """``shared`` turns at most come from the first conversation of each ``family``; running sums go over ``stretch`` turns at once, so that no lane leaves 63 bits; ids of
    conversations that end in a node are joined to strings of about ``chunk`` bytes before those meet."""

    family: int = 5
    shared: int = 9
    stretch: int = 4096
    chunk: int = 1 << 16


def _digest() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def ordered(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at, digest, bytes), ``at`` counting through all rows in the order of conversations and turns, and conversations (conv_id, first, n).

    Rows go to ranges of the order; rows that repeat may be parted, as a last key tells them apart. The driver sees one number for each range.
    """
    digest = F.unhex(F.substring(_digest(), 1, 32))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("row"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "row"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ranges = scratch.table(ranges.select("conv_id", "digest", "bytes", "id"), "ordered")
    part = F.shiftright("id", 33)
    sizes = ranges.groupBy(part.cast("int").alias("part")).agg((F.max("id") - F.min("id") + 1).alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    starts = F.broadcast(ranges.sparkSession.createDataFrame(before, "part int, start long"))  # one row for each range
    turns = ranges.withColumn("part", part.cast("int")).join(starts, "part").select("conv_id", (F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("at"), "digest", "bytes")
    convs = turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return turns, scratch.table(convs, "convs")


def rebuilt(turns: DataFrame, convs: DataFrame, scratch: Scratch, p: TrieParams) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, size, digest, bytes) of the rebuilt conversations with pos from 1 to size, and their lengths (conv_id, size)."""
    own = convs.select("conv_id", "first", "n", crc_mod("conv_id", p.shared).alias("h"), (F.col("conv_id") - F.col("conv_id") % p.family).alias("base"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    own = own.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    own = scratch.table(own, "own")
    placed = skew_join(turns, own.select("conv_id", "first", "h", "k", "size"), "conv_id").withColumn("i", F.col("at") - F.col("first") + 1)
    tails = placed.where("i > h").select("conv_id", (F.col("k") + F.col("i") - F.col("h")).alias("pos"), "size", "digest", "bytes")
    heads = placed.where((F.col("conv_id") % p.family == 0) & (F.col("i") < p.shared)).select(F.col("conv_id").alias("base"), "i", "digest", "bytes")
    heads = heads.join(own.select("conv_id", "base", "k", "size"), "base").where("i <= k").select("conv_id", F.col("i").alias("pos"), "size", "digest", "bytes")
    return tails.unionByName(heads), own.select("conv_id", "size")


def prefixes(rows: DataFrame, longest: int, p: TrieParams) -> DataFrame:
    """(conv_id, pos, size, id, parent, bytes): the node of each prefix, named by two lanes, and that of the prefix before. Stretches of long conversations are summed apart."""
    lane = lambda k: F.xxhash64("digest", "pos", F.lit(k)).bitwiseAND(LANE - 1)
    rows = rows.withColumns({"x": lane(1), "y": lane(2), "s": F.floor((F.col("pos") - 1) / p.stretch).cast("long")})
    run = Window.partitionBy("conv_id", "s").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({"sx": F.sum("x").over(run), "sy": F.sum("y").over(run)})
    if longest > p.stretch:
        totals = rows.where(F.col("size") > p.stretch).groupBy("conv_id", "s").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in "xy"))
        earlier = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("conv_id", "s", *(F.coalesce(F.pmod(F.sum(c).over(earlier), F.lit(LANE).cast("decimal(38,0)")), F.lit(0)).cast("long").alias(f"c{c}") for c in "xy"))
        summed = summed.join(carried, ["conv_id", "s"], "left")
    else:
        summed = summed.withColumns({"cx": F.lit(0).cast("long"), "cy": F.lit(0).cast("long")})
    now = {c: F.pmod(F.pmod(f"s{c}", F.lit(LANE)) + F.coalesce(f"c{c}", F.lit(0)), F.lit(LANE)) for c in "xy"}
    named = summed.withColumns({"nx": now["x"], "ny": now["y"]})
    back = lambda c: F.pmod(F.col(f"n{c}") - F.col(c), F.lit(LANE)).alias(c)
    return named.select("conv_id", "pos", "size", F.struct(F.col("nx").alias("x"), F.col("ny").alias("y")).alias("id"), F.struct(back("x"), back("y")).alias("parent"), "bytes")


def _root() -> Column:
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


def nodes_of(steps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, parent, depth, conv_id, n_convs, bytes) of all nodes; the root's parent is null."""
    inner = steps.groupBy("id").agg(F.first("parent").alias("parent"), F.first("pos").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("bytes").alias("bytes"))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nothing = F.lit(None).cast("struct<x:bigint,y:bigint>")
    return inner.unionByName(root.select(_root().alias("id"), nothing.alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes")))


def ends(steps: DataFrame, sizes: DataFrame, p: TrieParams) -> DataFrame:
    """(id, ends_sha256) of nodes in which conversations end: a hash of their ids in numeric order. Ids are joined to chunks where ranges of the order lie, and only chunks
    of one node meet; both are read on in order and not held."""
    last = steps.where("pos = size").select("id.x", "id.y", "conv_id").unionByName(sizes.where("size = 0").select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv_id"))
    order = ["x", "y", "conv_id"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, held, size = None, 0, [], 0
        for b in batches:
            out = []
            for x, y, c in zip(b["x"].tolist(), b["y"].tolist(), b["conv_id"].tolist()):
                if (x, y) != key or size >= p.chunk:
                    if held:
                        out.append((*key, start, ",".join(held)))
                    key, start, held, size = (x, y), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield pd.DataFrame(out, columns=["x", "y", "start", "ids"])
        if held:
            yield pd.DataFrame([(*key, start, ",".join(held))], columns=["x", "y", "start", "ids"])

    chunks = last.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(join, "x long, y long, start long, ids string")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, hashlib.sha256()
        for b in batches:
            out = []
            for x, y, ids in zip(b["x"].tolist(), b["y"].tolist(), b["ids"].tolist()):
                if (x, y) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (x, y), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["x", "y", "ends_sha256"])

    done = chunks.repartition("x", "y").sortWithinPartitions("x", "y", "start").mapInPandas(digest, "x long, y long, ends_sha256 string")
    return done.select(F.struct("x", "y").alias("id"), "ends_sha256")


def contract(tree: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """(id, values): for every node of ``tree`` (id, parent and the numbers in ``values``; one root, whose parent is null) the sums over its subtree."""
    nothing, zero = F.lit(None).cast("struct<x:bigint,y:bigint>"), [F.lit(0).cast("long").alias(v) for v in values]
    below = tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.lit(False).alias("leaf"))
    live = scratch.table(tree.select("id", "parent", *values).join(below, "id", "left").withColumn("leaf", F.coalesce("leaf", F.lit(True))), "live0")
    k = 0
    while live.count() > 1:
        k += 1
        # Rake: leaves are done, and what they hold goes up. A node keeps the number of its other children and, for the case that it is one, the least of them.
        child = F.when(~F.col("leaf"), F.col("id"))
        up = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count(child).alias("n"), F.min(child).alias("child"), *(F.sum(F.when(F.col("leaf"), F.col(v)).otherwise(0)).alias(f"up_{v}") for v in values))
        rest = live.where("NOT leaf OR parent IS NULL").join(up, "id", "left")
        # Compress: a node with an only child is taken out of its chain if its draw is above those of its neighbours, so no two neighbours are.
        draw = lambda c: F.xxhash64(c, F.lit(k))
        taken = (F.col("n") == 1) & F.col("parent").isNotNull() & (draw("id") > draw("child")) & (draw("id") > draw("parent"))
        rest = rest.select("id", "parent", "n", "child", F.coalesce(taken, F.lit(False)).alias("taken"), *((F.col(v) + F.coalesce(f"up_{v}", F.lit(0))).alias(v) for v in values))
        rest = scratch.table(rest, f"rest{k}")
        out = rest.where("taken")
        changes = out.select(F.col("child").alias("id"), F.col("parent").alias("over"), *zero).unionByName(out.select(F.col("parent").alias("id"), nothing.alias("over"), *values))
        changes = changes.groupBy("id").agg(F.max("over").alias("over"), *(F.sum(v).alias(f"up_{v}") for v in values))
        live = rest.where("NOT taken").join(changes, "id", "left")
        live = live.select("id", F.coalesce("over", "parent").alias("parent"), *((F.col(v) + F.coalesce(f"up_{v}", F.lit(0))).alias(v) for v in values), (F.coalesce("n", F.lit(0)) == 0).alias("leaf"))
        live = scratch.table(live, f"live{k}")
    read = lambda name: tree.sparkSession.read.parquet(f"{scratch.root}/{name}")
    done = [live.select("id", *values)]
    # Backwards: the child of a node that was taken out left later, so what is done so far holds its total.
    for k in range(k, 0, -1):
        chains = read(f"rest{k}").where("taken")
        if not chains.isEmpty():
            later = reduce(DataFrame.unionByName, done).select(F.col("id").alias("child"), *(F.col(v).alias(f"up_{v}") for v in values))
            full = chains.join(later, "child").select("id", *((F.col(v) + F.col(f"up_{v}")).alias(v) for v in values))
            done.append(scratch.table(full, f"chained{k}"))
        done.append(read(f"live{k - 1}").where("leaf AND parent IS NOT NULL").select("id", *values))
    return reduce(DataFrame.unionByName, done)


def trie(conversations: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node of the trie of rebuilt conversations.

    Rows without conv_id belong to no conversation. Turns go by number, null first; rows of one number (repeated ones too) by the SHA-256 of role and text. A null role
    or text is empty. A conversation may have any number of turns, or rebuilt none, and counts at the root in any case. An empty table has no root and gives no rows; other
    columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, convs = ordered(conversations.select("conv_id", "turn", "role", "text"), scratch)
    rows, sizes = rebuilt(turns, convs, scratch, p)
    steps = scratch.table(prefixes(rows, sizes.agg(F.max("size")).first()[0] or 0, p), "steps")
    nodes = nodes_of(steps, sizes)
    below = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(below, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = scratch.table(nodes, "nodes")
    scratch.drop("ordered")
    totals = contract(nodes, ["n_leaves", "saved_tokens"], scratch)
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, "id").join(ends(steps, sizes, p), "id", "left")
    many = nodes.count()
    hot = nodes.where(F.col("n_children") >= max(64, many // 2000)).select(F.col("id").alias("parent"))
    parents = nodes.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = skew_join(out, parents, "parent", "left", hot)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
