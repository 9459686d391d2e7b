"""Benchmark decontamination with suffix arrays over the training texts.

Each shard of documents (some megabytes of text in one task) gets a suffix array over its words: runs of words that the benchmark has at all, numbered by the benchmark's
vocabulary, sorted by prefix doubling. Every window of the benchmark, that is the start of every suffix of an item, is looked up in it by binary search, all at once; the
range of suffixes found are its verbatim occurrences. Windows that follow one another on a diagonal of document and item make the longest matches.

The benchmark goes to the tasks in blocks of at most ``block_words`` words, which bounds what is broadcast; with several blocks a row passes through one after another, and no rows are brought together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcodes import ALNUM, word_codes

SHARD_BYTES = 4_000_000
#: Occurrences looked at together, each with one place in the benchmark.
PAIRS = 1_000_000


@dataclass(frozen=True)
class DecontamParams:
    window: int = 10
    block_words: int = 1_000_000


@dataclass(frozen=True)
class Benchmark:
    """Windows of a block of items: ``vocabulary`` sorted word codes; by window length the distinct windows as rows of word numbers and, for each, where it stands."""

    vocabulary: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: windows, item and offset of each occurrence sorted by window, with borders
    borders: dict[int, np.ndarray]
    items: list[str]


def prepare(ids: list[int], texts: list[bytes | None], window: int) -> Benchmark:
    codes, counts = word_codes(texts, ALNUM)
    vocabulary, number = np.unique(codes, return_inverse=True)
    number = number.astype(np.int64) + 1
    starts = np.cumsum(counts) - counts
    names = sorted({str(i) for i in ids})
    at = {n: k for k, n in enumerate(names)}
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, s, n in zip(ids, starts.tolist(), counts.tolist()):
        if n:
            width = min(n, window)
            rows = np.lib.stride_tricks.sliding_window_view(number[s : s + n], width)
            found.setdefault(width, []).append((rows, np.full(len(rows), at[str(i)]), np.arange(len(rows))))
    windows, borders = {}, {}
    for width, parts in found.items():
        rows, item, offset = (np.concatenate([p[k] for p in parts]) for k in range(3))
        distinct, which = np.unique(rows, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        windows[width] = (distinct, item[order], offset[order])
        borders[width] = np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1))
    return Benchmark(vocabulary, windows, borders, names)


def suffix_array(text: np.ndarray, longest: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, as far as ``longest`` words tell them apart."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < longest and len(text):
        after = np.zeros(len(text), np.int64)
        after[:-k] = rank[k:] + 1
        key = rank * (len(text) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.concatenate(([0], np.diff(key[order]) != 0)))
        rank[order] = new
        if new[-1] == len(text) - 1:
            break
        k *= 2
    return order


def _bounds(text: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query (a row of words) the first and the last place + 1 in the suffix array whose suffix starts with it, by binary search of all queries at once."""
    n, width = queries.shape
    padded = np.concatenate((text, np.zeros(width, text.dtype)))
    out = []
    for upper in (False, True):
        low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
        while (open_ := low < high).any():
            q = np.flatnonzero(open_)
            mid = (low[q] + high[q]) // 2
            diff = padded[order[mid][:, None] + np.arange(width)] - queries[q]
            first = (diff != 0).argmax(1)
            sign = diff[np.arange(len(q)), first]
            right = sign <= 0 if upper else sign < 0
            low[q[right]] = mid[right] + 1
            high[q[~right]] = mid[~right]
        out.append(low)
    return out[0], out[1]


def occurrences(codes: np.ndarray, counts: np.ndarray, b: Benchmark) -> Iterator[tuple[np.ndarray, ...]]:
    """(position among all words of the shard, item, offset in the item, length) of every occurrence of a window, about ``PAIRS`` at a time."""
    if not len(codes) or not len(b.vocabulary):
        return
    place = np.searchsorted(b.vocabulary, codes)
    place[place == len(b.vocabulary)] = 0
    number = np.where(b.vocabulary[place] == codes, place + 1, 0)
    # Runs of known words within a document; only those as long as some window are kept, each followed by a 0.
    least = min(b.windows, default=1)
    edge = number == 0
    first = np.zeros(len(codes) + 1, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    starts = np.flatnonzero(~edge & (first[:-1] | np.concatenate(([True], edge[:-1]))))
    stop = edge | first[:-1]
    stop[starts] = False
    ends_all = np.sort(np.concatenate((np.flatnonzero(stop), starts, [len(codes)])))
    ends = ends_all[np.searchsorted(ends_all, starts, side="right")]
    long = ends - starts >= least
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    sizes = ends - starts + 1
    begin = np.cumsum(sizes) - sizes
    position = np.repeat(starts - begin, sizes) + np.arange(sizes.sum())
    text = number[np.minimum(position, len(codes) - 1)]
    text[begin + sizes - 1] = 0
    order = suffix_array(text, int(sizes.max()))
    for width, (queries, item, offset) in b.windows.items():
        low, high = _bounds(text, order, queries)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            continue
        border = b.borders[width]
        # Each occurrence in the texts with each place in the benchmark that has this window.
        here, there = (high - low)[hit], (border[1:] - border[:-1])[hit]
        reach = np.cumsum(here * there)
        for at in range(0, int(reach[-1]), PAIRS):
            k = np.arange(at, min(at + PAIRS, int(reach[-1])))
            own = np.searchsorted(reach, k, side="right")
            k -= (reach - here * there)[own]
            pos = position[order[low[hit][own] + k // there[own]]]
            ref = border[:-1][hit][own] + k % there[own]
            yield pos, item[ref], offset[ref], np.full(len(pos), width)


def longest_matches(pos: np.ndarray, item: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unites windows on the same diagonal of document and item that overlap: (position, item, offset, length) of the longest verbatim matches."""
    if not len(pos):
        return pos, item, offset, length
    order = np.lexsort((pos, pos - offset, item))
    pos, item, offset, length = pos[order], item[order], offset[order], length[order]
    new = np.concatenate(([True], (item[1:] != item[:-1]) | (np.diff(pos - offset) != 0) | (np.diff(pos) > 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(pos) - 1]))
    return pos[first], item[first], offset[first], pos[last] + length[last] - pos[first]


def shards(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or b"")
        if size >= SHARD_BYTES:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _blocks(benchmark: DataFrame, p: DecontamParams) -> Iterator[Benchmark]:
    """Blocks of items, each of a bounded number of words (one longer item is a block by itself)."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id").toLocalIterator(prefetchPartitions=True)
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for r in rows:
        data = r["text"].encode()
        ids.append(r["item_id"])
        texts.append(data)
        size += len(data) // 2
        if size >= p.block_words:
            yield prepare(ids, texts, p.window)
            ids, texts, size = [], [], 0
    if ids:
        yield prepare(ids, texts, p.window)


def shard_hits(codes: np.ndarray, counts: np.ndarray, b: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the longest matches, united where they overlap, as (first word, one after the last), and the different pairs (document, item), both sorted. Of the
    occurrences no more than a bounded number is held."""
    spans, named = np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
    borders = np.cumsum(counts)
    for part in occurrences(codes, counts, b):
        pos, item, _, length = longest_matches(*part)
        own = np.stack((pos, pos + length), 1)
        own = np.concatenate((spans, own))[np.lexsort((np.r_[spans[:, 1], own[:, 1]], np.r_[spans[:, 0], own[:, 0]]))]
        reach = np.maximum.accumulate(own[:, 1])
        new = np.flatnonzero(np.r_[True, own[1:, 0] >= reach[:-1]])  # spans that only touch may be of two documents
        spans = np.stack((own[new, 0], reach[np.r_[new[1:] - 1, len(own) - 1]]), 1)
        named = np.unique(np.concatenate((named, np.stack((np.searchsorted(borders, pos, side="right"), item), 1))), axis=0)
    return spans[:, 0], spans[:, 1], named[:, 0], named[:, 1]


_RAW = "doc_id long, text binary, n_words long, spans array<long>, items array<string>"


def _hits(docs: DataFrame, b: Benchmark) -> DataFrame:
    """Rows of ``_RAW`` with what this block's items add: spans as first words and ends in turn, and names of items. No row meets another."""
    held = docs.sparkSession.sparkContext.broadcast(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bench = held.value
        for batch in batches:
            texts = batch["text"].tolist()
            for i, j in shards(texts):
                part = batch.iloc[i:j]
                codes, counts = word_codes(texts[i:j], ALNUM)
                first, end, doc, item = shard_hits(codes, counts, bench)
                ends = np.cumsum(counts)
                spans, items = part["spans"].tolist(), part["items"].tolist()
                own = np.searchsorted(ends, first, side="right")
                for k in np.unique(own).tolist():
                    lo, hi = np.searchsorted(own, [k, k + 1])
                    here = np.stack((first[lo:hi], end[lo:hi]), 1) - (ends[k] - counts[k])
                    names = item[np.searchsorted(doc, k) : np.searchsorted(doc, k + 1)]
                    spans[k] = [*spans[k], *here.ravel().tolist()]
                    items[k] = [*items[k], *(bench.items[x] for x in names.tolist())]
                yield part.assign(doc_id=part["doc_id"].astype("Int64"), n_words=counts, spans=spans, items=items)

    return docs.mapInPandas(run, _RAW)


def _covered(spans: list[int]) -> int:
    total, reach = 0, 0
    for s, e in sorted(zip(spans[::2], spans[1::2])):
        total += max(0, e - max(s, reach))
        reach = max(reach, e)
    return total


def _digest(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in rows:
        hit = [_covered(list(x)) for x in b["spans"]]
        items = [sorted(set(x)) for x in b["items"]]
        yield pd.DataFrame(
            {
                "doc_id": b["doc_id"].astype("Int64"),
                "n_words": b["n_words"],
                "n_hit": hit,
                "n_items": [len(x) for x in items],
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [h > 0 for h in hit],
            }
        )


def contamination(documents: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``documents``.

    Null texts have no words; items without id, text or words have no windows; rows of the benchmark with one id count as one item; repeated documents are each judged;
    without items nothing is contaminated (the digest is that of the empty text); other columns are not read.
    """
    none = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items")]
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *none)
    some = False
    for b in _blocks(benchmark, p):  # one after another, so the driver holds no more than one
        docs, some = _hits(docs, b), True
    if not some:
        docs = _hits(docs, prepare([], [], p.window))
    return docs.select("doc_id", "n_words", "spans", "items").mapInPandas(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(documents: DataFrame, benchmark: DataFrame, p: DecontamParams = DecontamParams()) -> DataFrame:
    """The documents without those that hold a window of the benchmark. A document goes only where an occurrence was found in its own text."""
    out = documents
    for b in _blocks(benchmark, p):
        held = documents.sparkSession.sparkContext.broadcast(b)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                texts = [None if t is None else t.encode() for t in batch["text"]]
                bad = np.zeros(len(texts), bool)
                for i, j in shards(texts):
                    codes, counts = word_codes(texts[i:j], ALNUM)
                    first = shard_hits(codes, counts, held.value)[0]
                    bad[i + np.searchsorted(np.cumsum(counts), first, side="right")] = True
                yield batch[~bad]

        out = out.mapInPandas(run, out.schema)
    return out
