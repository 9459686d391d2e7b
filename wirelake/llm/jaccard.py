"""Exact Jaccard join of word-shingle sets, by prefixes and token combinations, and the groups that its links make.

Texts with the same set are one node. Tokens are ordered from rare to frequent; a set of n tokens that links with another lacks at most e = n - ceil(t n) of its own there.
So if prefixes are long enough that more than e of their tokens are covered, linked sets share a signature: a rare token is a signature by itself and covers one. Frequent
tokens are dealt into groups by a hash, and the pairs within a group are signatures: x tokens of a group cover x - 1, as without a pair in common at most one of them is in
common. How many groups there are depends on the octave of n alone; a set that may link with one of the next octave is signed for both. Hence the longer a set, the
more groups, and pairs stay about as many as the tokens that they stand for, whatever its size.

Candidates are compared by parity bitmaps before any set is fetched: each set has about as many bits as tokens, and the number of bits in which two differ is at most the
number of tokens that only one of them has. What passes is verified with the sets themselves.

That goes in two steps, so that a large group of near copies does not make all its pairs. First every set is compared with the leader of each of its
buckets, the set with the fewest rare tokens: an original comes before its edited copies, and is nearer to all of them than they are to one another. Then, within
buckets where sets are still in different components, the pairs of different components are compared, without those whose distances to the leader differ by more than
1 - t, which the triangle inequality rules out; large buckets are dealt into cells of bounded size. Both steps are exact; no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import Scratch, skew_join
from .textcodes import Lookup, mix, per_text_sets, shingles, slices, word_codes

#: Tokens counted together by a task before it hands on what it has.
COUNTED = 4_000_000
#: Times that a token must be seen among those to be handed on.
LEAST_SEEN = 2
#: Index rows that a task sorts, about.
SORTED = 1_000_000
#: Bits of an index row's number for the tokens in no class, the size and the place.
ODD_BITS, SIZE_BITS, PLACE_BITS = 15, 28, 20


@dataclass(frozen=True)
class JoinParams:
    """``percent`` is the similarity. Tokens counted ``often`` times or more are frequent. ``known`` bounds how many tokens with their frequencies are broadcast: those of
    the highest classes that together are no more. Tokens beyond it count as rare, in the order of their codes, which makes buckets larger but loses no link.
    ``cell`` is about the number of sets that are compared with one another at once in the second step."""

    width: int = 5
    percent: int = 80
    often: int = 256
    known: int = 1_500_000
    cell: int = 512


def sets_of(texts: list[str | None], p: JoinParams) -> Iterator[tuple[slice, list[np.ndarray]]]:
    for part in slices(texts):
        yield part, per_text_sets(*shingles(*word_codes([None if t is None else t.encode() for t in texts[part]]), p.width))


def set_code(tokens: np.ndarray) -> int:
    """A 64-bit code of a set."""
    return int(mix(np.array([mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(n * percent / 100)"""
    return -(-n * percent // 100)


def _covering(order: np.ndarray, rare: int, groups: np.ndarray, enough: int) -> int:
    """How many of the first tokens cover ``enough``: the ``rare`` first ones each cover one, later ones one unless they are the first of their group."""
    if rare >= enough:
        return enough
    first = np.ones(len(groups), bool)
    first[np.unique(groups, return_index=True)[1]] = False
    covered = rare + np.cumsum(first)
    return min(len(order), rare + int(np.searchsorted(covered, enough)) + 1)


def signatures(tokens: np.ndarray, frequency: np.ndarray, p: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set given as codes and classes of frequency in any order; for each the class of its token, and a place: what the set has in common with one that
    shares this signature first is at most what follows from there on. A single frequent token has none, as it links with its like alone, which is the same set. Of two tokens the smaller class and the first place count, less the groups before it, each of
    which may have hidden one token in common."""
    n = len(tokens)
    order = np.lexsort((tokens, frequency))
    enough = n - need(n, p.percent) + 1
    rare = int(np.count_nonzero(frequency < p.often.bit_length() - 1))
    one = order[: min(enough, rare)]
    sigs, seen, places = tokens[one], frequency[one], np.arange(len(one))
    if enough <= rare:
        return sigs, seen, places
    often = order[rare:]
    out, classes, at = [], [], []
    for octave in range(n.bit_length() - 1, (n * 100 // p.percent).bit_length()):
        # With that many groups all tokens together cover enough, in every set of this octave.
        many = max(1, min((1 << octave) // 8, need(1 << octave, p.percent) - 1))
        group = (tokens[often] >> np.uint64(8)) % np.uint64(many)
        size = _covering(order, rare, group, enough) - rare
        group, mine, kind = group[:size], tokens[often[:size]], frequency[often[:size]]
        before = np.zeros(size, bool)
        before[np.unique(group, return_index=True)[1]] = True
        place = np.maximum(rare + np.arange(size) - (np.cumsum(before) - 1), 0)
        by = np.argsort(group, kind="stable")
        border = np.flatnonzero(np.concatenate(([True], group[by][1:] != group[by][:-1], [True])))
        for lo, hi in zip(border[:-1].tolist(), border[1:].tolist()):
            if hi - lo > 1:
                i, j = np.triu_indices(hi - lo, 1)
                i, j = by[lo + i], by[lo + j]
                a, b = np.minimum(mine[i], mine[j]), np.maximum(mine[i], mine[j])
                out.append(mix(a * np.uint64(0xD6E8FEB86659FD93) + b))
                classes.append(np.minimum(kind[i], kind[j]))
                at.append(place[i])
    sigs, seen, places = np.concatenate([sigs, *out]), np.concatenate([seen, *classes]), np.concatenate([places, *at])
    by = np.lexsort((places, sigs))
    by = by[np.diff(sigs[by], prepend=~sigs[by][:1]) != 0]
    return sigs[by], seen[by], places[by]


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bitmap of at least as many bits as tokens, a power of two: bit k is odd if an odd number of tokens has k as its lowest bits."""
    size = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows) brought to a smaller size, a power of two."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def possible(na: np.ndarray, nb: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, p: JoinParams) -> np.ndarray:
    """Which pairs of a[i] and b[j] the bitmaps allow to link; na and nb are the sizes of the sets. Of two bitmaps the larger is folded on the smaller one's size."""
    out = np.zeros(len(i), bool)
    wide_a, wide_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    for wa, wb in np.unique(np.stack((wide_a[i], wide_b[j]), 1), axis=0).tolist() if len(i) else []:
        mine = np.flatnonzero((wide_a[i] == wa) & (wide_b[j] == wb))
        step = max(1, (1 << 20) // max(wa, wb))
        for at in range(0, len(mine), step):
            k = mine[at : at + step]
            u, v = np.stack([a[x] for x in i[k]]).view(np.uint64), np.stack([b[x] for x in j[k]]).view(np.uint64)
            differing = np.bitwise_count(_folded(u, min(wa, wb)) ^ _folded(v, min(wa, wb))).sum(1, dtype=np.int64)
            both = na[i[k]] + nb[j[k]]
            out[k] = (both - differing) * (100 + p.percent) >= both * (2 * p.percent)
    return out


def _inventory(docs: DataFrame, p: JoinParams) -> DataFrame:
    """Rows of kind 0: a document's id, set code, size and its set's bitmap (null if a row of the same task has it); of kind 1: a token and how often it was seen in the
    different sets of a portion, if more than once."""

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        codes = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        n = np.diff(np.append(first, len(codes)))
        often = n >= LEAST_SEEN
        return pd.DataFrame({"kind": 1, "doc_id": pd.array([None] * int(often.sum()), "Int64"), "code": codes[first[often]].view(np.int64), "n": n[often], "bits": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0
        for b in batches:
            rows = []
            for _, sets in sets_of(b["text"].tolist(), p):
                for s in sets:
                    code = set_code(s)
                    new = len(s) > 0 and code not in seen
                    rows.append((code, len(s), parities(s) if new else None))
                    if new:
                        seen.add(code)
                        held.append(s)
                        size += len(s)
                if size >= COUNTED:
                    yield counted(held)
                    held, size, seen = [], 0, set()
            yield pd.DataFrame({"kind": 0, "doc_id": b["doc_id"].astype("Int64"), "code": [r[0] for r in rows], "n": [r[1] for r in rows], "bits": [r[2] for r in rows]})
        if held:
            yield counted(held)

    return docs.mapInPandas(run, "kind int, doc_id long, code long, n long, bits array<long>")


def _frequent_tokens(inventory: DataFrame, scratch: Scratch, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and their classes of frequency, which are whole logarithms: of the classes from the highest on as many as hold no more than ``known`` tokens together."""
    counted = inventory.where("kind = 1").groupBy("code").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("c"))
    counted = scratch.table(counted.where("c >= 1"), "counted")
    least, total = 64, 0
    for r in counted.groupBy("c").count().orderBy(F.desc("c")).collect():
        total += r["count"]
        if total > p.known:
            break
        least = r["c"]
    got = counted.where(F.col("c") >= least).toArrow()
    return got["code"].to_numpy().view(np.uint64), got["c"].to_numpy().astype(np.int8)


def _index(docs: DataFrame, tokens: np.ndarray, counts: np.ndarray, p: JoinParams) -> DataFrame:
    """(sig, rid, meta, seen): the signatures of the different sets of each portion. meta has the number of the set's tokens that are in no class, its size and the
    signature's place, in bits of that order; the first and the last stop at the largest number that they have bits for. seen is the class."""
    held = docs.sparkSession.sparkContext.broadcast((tokens, counts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Lookup(*held.value, missing=0)
        done: set[int] = set()
        for b in batches:
            for _, sets in sets_of(b["text"].tolist(), p):
                every = table.get(np.concatenate(sets)) if sets else np.zeros(0, np.int64)
                at, sigs, rids, metas, classes = 0, [], [], [], []
                for s in sets:
                    frequency = every[at : at + len(s)]
                    at += len(s)
                    code = set_code(s)
                    if not len(s) or code in done:
                        continue
                    if len(done) < 200_000:
                        done.add(code)
                    own, seen, place = signatures(s, frequency, p)
                    sigs.append(own)
                    classes.append(seen)
                    rids.append(np.full(len(own), code, np.int64))
                    odd = min(int(np.count_nonzero(frequency == 0)), (1 << ODD_BITS) - 1)
                    metas.append((odd << SIZE_BITS + PLACE_BITS) + (len(s) << PLACE_BITS) + np.minimum(place, (1 << PLACE_BITS) - 1))
                if sigs:
                    yield pd.DataFrame({"sig": np.concatenate(sigs).view(np.int64), "rid": np.concatenate(rids), "meta": np.concatenate(metas), "seen": np.concatenate(classes)})

    return docs.mapInPandas(run, "sig long, rid long, meta long, seen byte")


def _size(meta: Column) -> Column:
    return F.shiftright(meta, PLACE_BITS).bitwiseAND((1 << SIZE_BITS) - 1).cast("int")


def _place(meta: Column) -> Column:
    return meta.bitwiseAND((1 << PLACE_BITS) - 1).cast("int")


def _led(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (sig, meta, rid) with the first of their signature, which leads them, each once and without the leaders' own."""
    carried = np.zeros((0, 3), np.int64)  # the open signature's leader, and the row that came last
    for b in batches:
        if not len(b):
            continue
        rows = np.concatenate((carried, b[["sig", "meta", "rid"]].to_numpy(np.int64)))
        first = np.concatenate(([True], rows[1:, 0] != rows[:-1, 0]))
        lead = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        keep = np.concatenate(([False], (rows[1:] != rows[:-1]).any(1))) & (rows[:, 2] != lead[:, 2])
        keep[: len(carried)] = False
        carried = rows[-1:] if first[-1] else np.concatenate((lead[-1:], rows[-1:]))
        if keep.any():
            yield pd.DataFrame({"sig": rows[keep, 0], "rid": rows[keep, 2], "meta": rows[keep, 1], "lead": lead[keep, 2], "lead_meta": lead[keep, 1]})


def _shared(index: DataFrame, scratch: Scratch) -> DataFrame:
    """(sig, rid, n, pos, lead, lead_n, lead_pos) of the signatures that several sets have; lead is their leader, whose own rows are left out.

    Signatures that more than 1/2000 of all rows have, 2000 at the most, come from an aggregate and meet their rows by a broadcast. Only tokens seen often can be among them. The
    rest is shuffled once and read on in order; no signature of it is large.
    """
    rows = index.count()
    least = max(64, rows // 2000)
    # A class is the logarithm of what the portions counted, and a portion hands on no token that it saw once.
    often = index.where(F.col("seen") >= int(np.log2(max(2, least // 4))))
    hot = often.groupBy("sig").agg(F.count("*").alias("members"), F.min(F.struct("meta", "rid")).alias("l")).where(F.col("members") >= least)
    hot = scratch.table(hot.select("sig", F.col("l.rid").alias("lead"), F.col("l.meta").alias("lead_meta")), "hot")
    entries = index.select("sig", "rid", "meta")
    cold = entries.join(F.broadcast(hot.select("sig")), "sig", "left_anti")
    cold = cold.repartition(max(12, rows // SORTED), "sig").sortWithinPartitions("sig", "meta", "rid")
    cold = cold.mapInPandas(_led, "sig long, rid long, meta long, lead long, lead_meta long")
    both = cold.unionByName(entries.join(F.broadcast(hot), "sig").where("rid <> lead").distinct())
    named = both.select("sig", "rid", _size(F.col("meta")).alias("n"), _place(F.col("meta")).alias("pos"), "lead", _size(F.col("lead_meta")).alias("lead_n"), _place(F.col("lead_meta")).alias("lead_pos"))
    return scratch.table(named, "shared")


def _wanted(keys: DataFrame) -> np.ndarray:
    """A bitmap with a bit for some bits of each key, about 16 bits for each, 128 MB at the most; made by aggregates."""
    bits = min(30, max(18, int(16 * keys.count()).bit_length()))
    place = F.shiftright("key", 7).bitwiseAND((1 << bits) - 1) + 1
    rows = keys.select(place.alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    got = rows.toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for k, part in zip(got["k"].to_pylist(), got["bits"]):
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def _sets(docs: DataFrame, nodes: DataFrame, p: JoinParams) -> DataFrame:
    """(rid, tokens) of the sets of ``nodes`` (and some others, which do no harm), read from the documents that stand for them."""
    held = docs.sparkSession.sparkContext.broadcast(_wanted(nodes.select(F.col("rid").bitwiseXOR(F.xxhash64("doc_id")).alias("key"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap = held.value
        mask = len(bitmap) * 8 - 1
        for b in batches:
            hashes = b["hash"].tolist()
            for part, sets in sets_of(b["text"].tolist(), p):
                rows = []
                for s, own in zip(sets, hashes[part]):
                    code = set_code(s)
                    if len(s) and bitmap[(at := (code ^ own) >> 7 & mask) >> 3] >> (at & 7) & 1:
                        rows.append((code, s.view(np.int64)))
                if rows:
                    yield pd.DataFrame({"rid": [r[0] for r in rows], "tokens": [r[1] for r in rows]})

    return docs.select("text", F.xxhash64("doc_id").alias("hash")).mapInPandas(run, "rid long, tokens array<long>")


def _close(na: Column, nb: Column, p: JoinParams) -> Column:
    """Whether sizes allow a link."""
    return F.least(na, nb) * 100 >= F.greatest(na, nb) * p.percent


def _fits(na: Column, nb: Column, pa: Column, pb: Column, p: JoinParams) -> Column:
    """Whether a link is possible where the first token in common has these places: what follows in each set is all that can be in common. A pair's first common token
    passes this if it links, whatever its other buckets say."""
    return F.least(na - pa, nb - pb) * (100 + p.percent) >= (na + nb) * p.percent


def _with_both(pairs: DataFrame, own: DataFrame, value: str, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b, na, nb) with ``value`` of both, as x and y, from (rid, value). Many pairs may have the same b, as a leader has."""
    left = pairs.join(own.select(F.col("rid").alias("a"), F.col(value).alias("x")), "a")
    hot = pairs.groupBy("b").count().where(F.col("count") >= max(256, pairs.count() // 1000)).select("b")
    return skew_join(left, own.select(F.col("rid").alias("b"), F.col(value).alias("y")), "b", "inner", scratch.table(hot, name))


def _tested(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, scratch: Scratch, name: str, p: JoinParams) -> DataFrame:
    """Pairs (a, b, na, nb) with the size of their intersection, each once."""
    named = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = scratch.table(_sets(docs, nodes.join(named, "rid", "left_semi"), p), f"{name}-sets")
    both = _with_both(pairs, sets, "tokens", scratch, f"{name}-hot")
    out = scratch.table(both.select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("common")).distinct(), name)
    scratch.drop(f"{name}-sets", f"{name}-hot")
    scratch.release()
    return out


def _linked(p: JoinParams) -> Column:
    return F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * p.percent


def groups(documents: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, the set code ``rid`` and the component's root, of every row of ``documents``.

    Null texts and texts without words have the empty set and are linked with nothing; texts of fewer words than a shingle are one shingle; repeated rows are linked like
    copies. A null doc_id never names a component: such a row's component_id is null unless a row with an id is reachable. An empty table gives no rows; columns
    besides doc_id and text are not read.
    """
    scratch = Scratch(documents.sparkSession, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    inventory = scratch.table(_inventory(docs, p), "inventory")
    rows = scratch.table(inventory.where("kind = 0").select("doc_id", F.col("code").alias("rid"), "n"), "rows")
    nodes = inventory.where("kind = 0 AND n > 0").groupBy("code").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n").cast("int").alias("n"), F.max("bits").alias("bits"))
    nodes = scratch.table(nodes.withColumnRenamed("code", "rid"), "nodes")
    tokens, classes = _frequent_tokens(inventory, scratch, p)
    index = scratch.table(_index(docs, tokens, classes, p), "index")
    scratch.drop("inventory", "counted")
    shared = _shared(index, scratch)
    scratch.drop("index", "hot")
    scratch.release()
    pairs = shared.where(_close(F.col("n"), F.col("lead_n"), p) & _fits(F.col("n"), F.col("lead_n"), F.col("pos"), F.col("lead_pos"), p))
    pairs = scratch.table(pairs.select(F.col("rid").alias("a"), F.col("lead").alias("b"), F.col("n").alias("na"), F.col("lead_n").alias("nb")).distinct(), "pairs")

    def allowed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = np.arange(len(b))
            yield b.loc[possible(b["na"].to_numpy(np.int64), b["nb"].to_numpy(np.int64), b["x"].tolist(), b["y"].tolist(), at, at, p), ["a", "b", "na", "nb"]]

    likely = scratch.table(_with_both(pairs, nodes, "bits", scratch, "pairs-hot").mapInPandas(allowed, "a long, b long, na int, nb int"), "likely")
    scratch.drop("pairs", "pairs-hot")
    tested = _tested(docs, likely, nodes, scratch, "tested", p)
    edges = tested.where(_linked(p)).select("a", "b")
    roots = scratch.table(components(edges, scratch, "first"), "roots")
    rest = scratch.table(_undecided(shared, tested, nodes, roots, scratch, p), "undecided")
    if not rest.isEmpty():
        more = _tested(docs, rest, nodes, scratch, "tested2", p)
        roots = scratch.table(components(edges.unionByName(more.where(_linked(p)).select("a", "b")), scratch, "second"), "roots2")
    out = _named(rows, nodes, roots, scratch)
    scratch.drop("shared", "likely", "undecided", "rooted-rows", "mixed", "tested", "tested2", "roots", "roots2", "nodes")
    return out


def _undecided(shared: DataFrame, tested: DataFrame, nodes: DataFrame, roots: DataFrame, scratch: Scratch, p: JoinParams) -> DataFrame:
    """Pairs of a bucket that are not yet in one component and may be linked, (a, b, na, nb), each once."""
    # The distance to the bucket's leader; null where sizes, places or bitmaps ruled a link out and it was not worked out: such rows take part whatever the other's distance.
    distance = tested.select(F.col("a").alias("rid"), F.col("b").alias("lead"), (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
    own = shared.select("sig", "rid", "n", "pos", "lead").join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    own = scratch.table(own, "rooted-rows")
    mixed = own.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("members")).where("x <> y")
    mixed = scratch.table(mixed.select("sig", "members", F.ceil(F.col("members") / p.cell).cast("int").alias("cells")), "mixed")
    hot = mixed.where(F.col("members") >= max(64, own.count() // 2000)).select("sig")
    own = skew_join(own, mixed.select("sig", "cells"), "sig", "inner", hot).join(distance, ["rid", "lead"], "left").drop("lead").join(nodes.select("rid", "bits"), "rid")
    # Each two cells meet once: the lesser one's rows have side 0 and the other's 1, those of a cell by itself 2.
    own = own.withColumn("c", F.pmod("rid", "cells").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    meeting = F.xxhash64("sig", F.least("c", "o"), F.greatest("c", "o")).alias("meeting")
    side = F.when(F.col("c") < F.col("o"), 0).when(F.col("c") > F.col("o"), 1).otherwise(2).cast("byte").alias("side")
    met = own.select(meeting, side, "rid", "n", "pos", "root", "d", "bits").repartition("meeting").sortWithinPartitions("meeting")
    return met.mapInPandas(lambda it: _compared(it, p), "a long, b long, na int, nb int").distinct()


def _compared(batches: Iterator[pd.DataFrame], p: JoinParams) -> Iterator[pd.DataFrame]:
    """Pairs that may link, of rows sorted by meeting. A meeting that a batch leaves open, which has few rows, waits for the next."""
    held = None
    for b in batches:
        if held is not None:
            b = pd.concat((held, b))
        if len(b):
            key = b["meeting"].to_numpy(np.int64)
            last = int(np.argmax(key == key[-1]))
            held = b.iloc[last:]
            yield _met(b.iloc[:last], p)
    if held is not None:
        yield _met(held, p)


def _met(rows: pd.DataFrame, p: JoinParams) -> pd.DataFrame:
    """The pairs within meetings: sizes, places, roots and distances are looked at first, then bitmaps."""
    key, rid, n, pos, root, side = (rows[c].to_numpy(np.int64) for c in ("meeting", "rid", "n", "pos", "root", "side"))
    d = rows["d"].to_numpy(np.float64)
    at, apart, left, right = np.arange(len(rows)), 0, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        apart += 1
        at = at[at + apart < len(rows)]
        at = at[key[at] == key[at + apart]]
        i, j = at, at + apart
        may = ((side[i] == 2) | (side[i] != side[j])) & (root[i] != root[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * p.percent)
        may &= np.minimum(n[i] - pos[i], n[j] - pos[j]) * (100 + p.percent) >= (n[i] + n[j]) * p.percent
        may &= ~(np.abs(d[i] - d[j]) > 1 - p.percent / 100 + 1e-9)
        left.append(i[may])
        right.append(j[may])
    i, j = np.concatenate(left), np.concatenate(right)
    bits = rows["bits"].tolist()
    good = possible(n, n, bits, bits, i, j, p)
    i, j = i[good], j[good]
    i, j = np.where(rid[i] < rid[j], i, j), np.where(rid[i] < rid[j], j, i)
    return pd.DataFrame({"a": rid[i], "b": rid[j], "na": n[i].astype(np.int32), "nb": n[j].astype(np.int32)})


def _named(rows: DataFrame, nodes: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Gives components the smallest doc_id in them and every row its component."""
    own = nodes.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    own = scratch.table(own.select("rid", "doc_id", "copies", "root"), "rooted")
    names = scratch.table(own.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")), "names")
    hot = names.where(F.col("k") >= max(64, own.count() // 2000)).select("root")
    table = scratch.table(skew_join(own.select("rid", "copies", "root"), names.select("root", "component_id"), "root", "inner", hot), "components")
    many = table.where(F.col("copies") >= max(64, rows.count() // 2000)).select("rid")
    full = skew_join(rows.where("n > 0"), table.select("rid", "root", "component_id"), "rid", "inner", many)
    none = rows.where("n = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("long")})
    return full.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "rid", "root")


def keep_one(documents: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """The documents with one row of each group: that with the smallest doc_id. Rows with the empty set are in no group and all stay."""
    scratch = Scratch(documents.sparkSession, "keep")
    rows = scratch.table(groups(documents, p), "groups")
    linked = rows.where("n_shingles > 0")
    best = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("rid").alias("_rid"), F.first("component_id").alias("_kept"))
    best = scratch.table(best.select("_rid", "_kept"), "best")
    counts = linked.groupBy(F.col("rid").alias("_rid")).count()
    hot = scratch.table(counts.where(F.col("count") >= max(64, rows.count() // 2000)).select("_rid"), "hot")
    names = [c for c in documents.columns if c not in ("_rid", "_kept")]
    docs = documents.select(*names)

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            codes = [set_code(s) if len(s) else None for _, sets in sets_of(b["text"].tolist(), p) for s in sets]
            yield b.assign(_rid=pd.array(codes, "Int64"))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    docs = docs.mapInPandas(coded, f"{schema}, _rid long")
    kept = skew_join(docs.where("_rid IS NOT NULL"), best, "_rid", "inner", hot).where(F.col("doc_id").eqNullSafe(F.col("_kept")))
    # Rows that repeat a kept document: only those are brought together.
    again = linked.groupBy(F.col("rid").alias("_rid"), "doc_id").count().where("count > 1").join(best, "_rid").where(F.col("doc_id").eqNullSafe(F.col("_kept"))).select("_rid")
    again = scratch.table(again, "again")
    if not again.isEmpty():
        kept = kept.join(again, "_rid", "left_anti").unionByName(kept.join(again, "_rid", "left_semi").dropDuplicates(["_rid"]))
    return kept.select(*names).unionByName(docs.where("_rid IS NULL").select(*names))
