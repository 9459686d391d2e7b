"""Ranked lexical search of whole texts, without an index of the documents.

The terms of all items make one Aho-Corasick automaton, each term guarded by a blank on both sides; texts are scanned with it after all that is no part of a term has become
a blank, so that only whole terms match. An output of the automaton is a term's number, and a list says which items hold the term. The texts are read twice: first for how
many documents hold each term and how long documents are, then for the scores, of which each task keeps the best of each item.

Items go to the tasks in blocks of bounded size, with the automaton built where it is used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .textcodes import pieces

#: Bytes of terms: all but \x00-\x2F, \x3A-\x40, \x5B-\x60, \x7B-\x7F, and A-Z in small letters; others become a blank.
TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True
_PLAIN = bytes(b if TERM[b] else 0x20 for b in range(256)).lower()
#: Bytes of the longest terms in the automaton, whose depth is theirs; longer ones, of which a text can hold few for its length, are looked up in a table.
LONGEST = 256
#: Stands for the id of documents without one, which come last among equals.
NO_ID = (1 << 63) - 1
#: Scores of documents and items that are worked out at once.
SCORED = 2_000_000


@dataclass(frozen=True)
class RankParams:
    """``top`` documents are kept of each item; ``block_bytes`` bounds the terms of a block of items (one larger item is a block by itself)."""

    top: int = 10
    block_bytes: int = 16 << 20


@dataclass
class Terms:
    """The different terms of a block of items; items[starts[t]:starts[t + 1]] hold term t. Workers build the automaton once, when they first need it."""

    names: list[bytes]
    starts: np.ndarray
    items: np.ndarray
    _built: tuple[ahocorasick.Automaton, dict[bytes, int]] | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_built": None}

    @property
    def built(self) -> tuple[ahocorasick.Automaton, dict[bytes, int]]:
        """The automaton of the terms up to ``LONGEST`` bytes and the table of the others."""
        if self._built is None:
            automaton, table = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}
            for k, name in enumerate(self.names):
                if len(name) > LONGEST:
                    table[name] = k
                else:
                    automaton.add_word(f" {name.decode('latin-1')} ", k)
            automaton.make_automaton()
            self._built = automaton, table
        return self._built

    def matches(self, plain: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """(place of the last byte, term) of each known term in a text whose terms are at plain[start:end]."""
        automaton, table = self.built
        out = np.zeros((0, 2), np.int64)
        if len(automaton):
            # A match ends with the blank behind its term.
            out = np.fromiter(chain.from_iterable(automaton.iter(plain.decode("latin-1"))), np.int64).reshape(-1, 2) - (1, 0)
        if table:
            long = [(b - 1, table.get(plain[a:b], -1)) for a, b in zip(start.tolist(), end.tolist()) if b - a > LONGEST]
            out = np.concatenate((out, np.array([x for x in long if x[1] >= 0], np.int64).reshape(-1, 2)))
        return out


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def counted(texts: list[bytes | None], terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of terms of each text, and (text, term, occurrences) of the known ones in the order of texts and terms."""
    n = np.zeros(len(texts), np.int64)
    many = np.int64(max(1, len(terms.names)))
    keys, times = [], []
    for data, own in pieces(texts, kind=TERM):
        plain = b" " + data.translate(_PLAIN) + b" "
        edge = np.flatnonzero(np.diff(TERM[np.frombuffer(plain, np.uint8)])) + 1
        start, end = edge[::2], edge[1::2]
        border = np.zeros(1, np.int64)
        if len(own) > 1:
            # The first part may be the rest of a long text; the others are whole.
            sizes = np.fromiter((len(texts[k] or b"") for k in own[1:]), np.int64, len(own) - 1)
            border = np.concatenate(([0], len(data) - int(sizes.sum()) - len(own) + 3 + np.cumsum(np.concatenate(([0], sizes[:-1] + 1)))))
        who = np.asarray(own, np.int64)
        n += np.bincount(who[np.searchsorted(border, start, side="right") - 1], minlength=len(texts))
        if terms.names:
            hits = terms.matches(plain, start, end)
            text = who[np.searchsorted(border, hits[:, 0], side="right") - 1]
            key, often = np.unique(text * many + hits[:, 1], return_counts=True)
            keys.append(key)
            times.append(often)
    if not keys:
        return n, *(np.zeros(0, np.int64) for _ in range(3))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.zeros(len(key), np.int64)
    np.add.at(tf, at, np.concatenate(times))
    return n, key // many, key % many, tf


def scores(text: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, weight: np.ndarray, terms: Terms) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, item, score) above 0, some millions at a time; no text's scores are parted."""
    part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[text]))
    many = (terms.starts[1:] - terms.starts[:-1])[term]
    reach = np.concatenate(([0], np.cumsum(many)))
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(first) - 1:
        to = max(at + 1, int(np.searchsorted(reach[first], reach[first[at]] + SCORED, side="right")) - 1)
        lo, hi = first[at], first[to]
        at = to
        own = np.repeat(np.arange(lo, hi), many[lo:hi])
        item = terms.items[terms.starts[term[own]] + np.arange(len(own)) - (reach[own] - reach[lo])]
        order = np.lexsort((item, text[own]))
        own, item = own[order], item[order]
        new = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (text[own][1:] != text[own][:-1])]) if len(own) else np.zeros(0, np.int64)
        total = np.add.reduceat(part[own], new) if len(new) else np.zeros(0, np.int64)
        keep = total > 0
        yield text[own][new][keep], item[new][keep], total[keep]


def _blocks(benchmark: DataFrame, scratch: Scratch, p: RankParams) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Different (item_id, term) with a number dealt to items, and the ranges of numbers that are blocks: one range holds at most ``block_bytes``, or one number."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [sorted(set(terms_of(t))) for t in b["text"]]
            yield b.assign(term=found)[["k", "term"]].explode("term").dropna(subset=["term"])

    ids = scratch.table(benchmark.select("item_id").distinct().withColumn("k", F.monotonically_increasing_id()), "items")
    texts = benchmark.select("item_id", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    found = texts.join(ids, texts["item_id"].eqNullSafe(ids["item_id"])).select("k", "text").mapInPandas(split, "k long, term binary").distinct()
    found = scratch.table(found, "terms")
    total = found.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    dealt = F.pmod(F.xxhash64("k"), F.lit(16 * (total // p.block_bytes) + 1))
    found = found.withColumn("bin", dealt)
    blocks: list[tuple[int, int]] = []
    size = 0
    for r in found.groupBy("bin").agg(F.sum(F.octet_length("term") + 16).alias("n")).orderBy("bin").collect():
        if not blocks or size + r["n"] > p.block_bytes:
            blocks.append((r["bin"], r["bin"]))
            size = 0
        blocks[-1] = (blocks[-1][0], r["bin"])
        size += r["n"]
    return found, blocks


def _prepare(rows: pd.DataFrame) -> tuple[Terms, np.ndarray]:
    """The terms of a block and the numbers of its items."""
    items, at = np.unique(rows["k"].to_numpy(), return_inverse=True)
    names = sorted(set(rows["term"]))
    place = {t: k for k, t in enumerate(names)}
    term = rows["term"].map(place).to_numpy()
    order = np.lexsort((at, term))
    return Terms(names, np.searchsorted(term[order], np.arange(len(names) + 1)), at[order].astype(np.int32)), items


def _statistics(docs: DataFrame, held) -> tuple[int, int, np.ndarray]:
    """N, L and for each term the number of documents that hold it. A task hands on one row for each term it has seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = held.value
        df, n_docs, length = np.zeros(len(terms.names), np.int64), 0, 0
        for b in batches:
            n, _, term, _ = counted(b["text"].tolist(), terms)
            df += np.bincount(term, minlength=len(df))
            n_docs, length = n_docs + int((n > 0).sum()), length + int(n.sum())
        seen = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.concatenate((seen, [-1, -2])), "n": np.concatenate((df[seen], [n_docs, length]))})

    rows = docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # one row for each term of a block
    df = np.zeros(len(held.value.names) + 2, np.int64)
    df[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(df[-1]), int(df[-2]), df[:-2]


def _best(docs: DataFrame, held, weight, n_docs: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each item in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, w = held.value, weight.value
        item, score, doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            ids = b["doc_id"].to_numpy(np.int64)
            n, text, term, tf = counted(b["text"].tolist(), terms)
            m = np.array([100 - 90 + 90 * x * n_docs // max(1, length) for x in n.tolist()], np.int64)
            for t, i, s in scores(text, term, tf, m, w, terms):
                item, score, doc = np.concatenate((item, i)), np.concatenate((score, s)), np.concatenate((doc, ids[t]))
                order = np.lexsort((doc, -score, item))
                item, score, doc = item[order], score[order], doc[order]
                first = np.searchsorted(item, item)
                keep = np.arange(len(item)) - first < top
                item, score, doc = item[keep], score[keep], doc[keep]
        yield pd.DataFrame({"item": item, "doc_id": doc, "score": score})

    return docs.mapInPandas(run, "item long, doc_id long, score long")


def search(documents: DataFrame, benchmark: DataFrame, p: RankParams = RankParams()) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of each item with a score above 0.

    Null and empty texts have no terms: such documents count for nothing and such items give no rows, nor do items none of whose terms is found. Rows of the benchmark with one
    item_id (null is one) are one item with the terms of all. Rows of documents with one doc_id are documents of their own; equal scores go by ascending doc_id, those without
    one last. Without documents or items there are no rows; other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "ranked")
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    found, blocks = _blocks(benchmark, scratch, p)
    out = spark.createDataFrame([], "k long, doc_id long, score long, rank int")
    for b, (lo, hi) in enumerate(blocks):
        terms, items = _prepare(found.where(F.col("bin").between(lo, hi)).select("k", "term").toPandas())
        held = spark.sparkContext.broadcast(terms)
        n_docs, length, df = _statistics(docs, held)
        weight = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64))
        by = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        best = _best(docs, held, weight, n_docs, length, p.top).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= p.top)
        names = F.broadcast(spark.createDataFrame([(k, int(x)) for k, x in enumerate(items)], "item long, k long"))  # the items of a block
        out = out.unionByName(scratch.table(best.join(names, "item").select("k", "doc_id", "score", "rank"), f"best{b}"))
        held.unpersist()
        weight.unpersist()
    ids = spark.read.parquet(f"{scratch.root}/items")
    return out.join(ids, "k").select("item_id", F.col("rank").cast("int").alias("rank"), F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score")
