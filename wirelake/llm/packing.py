"""Packing of token sequences: first-fit decreasing on a tournament tree of bin capacities, in randomised groups of documents.

A document is tokenised, closed with an end id and cut into pieces of at most ``capacity`` ids. Pieces of a group are placed longest first, each into the first bin that
has room for it; the tree holds the largest room below each node, so a bin is found in log(bins) steps. Groups are drawn by a hash of the row, so none holds more than
its share of a source; what is left open at the end of a group is one bin or two.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import Scratch

#: Pre-tokens that a worker keeps.
CACHE = 300_000


@dataclass(frozen=True)
class PackParams:
    """``group_docs`` is the expected number of documents of a group."""

    tokenizer: str
    capacity: int = 4096
    end_id: int = 2
    group_docs: int = 4000


class TournamentTree:
    """Bins of equal capacity; ``first_fit`` takes the leftmost one with room enough."""

    def __init__(self, capacity: int, bins: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def first_fit(self, size: int) -> tuple[int, int]:
        """(bin, what it held before)."""
        room, k = self.room, 1
        if room[1] < size:
            raise ValueError(f"no bin has room for {size}")
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        held = self.capacity - room[k]
        bin_ = k - self.leaves
        room[k] -= size
        k //= 2
        while k:
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
            k //= 2
        return bin_, held


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces of equal size keep their order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    full = int((sizes == capacity).sum())
    bins[order[:full]] = np.arange(full)
    tree = TournamentTree(capacity, max(len(sizes) - full, 1))
    for k in order[full:].tolist():
        b, offsets[k] = tree.first_fit(int(sizes[k]))
        bins[k] = full + b
    return bins, offsets


def _simple() -> tuple[str, str]:
    """Of the characters up to U+024F and common punctuation, those that are the same composed, in lower case and as a class everywhere: letters, and all of them."""
    ok = [chr(k) for k in [*range(0x80), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    ok = [c for c in ok if c.isascii() or unicodedata.category(c)[0] in "LPS" and len(c.lower()) == 1 and unicodedata.is_normalized("NFC", c) and c.lower() in ok]
    return "".join(c for c in ok if unicodedata.category(c)[0] == "L"), "".join(ok)


_LETTERS, _ALL = _simple()
SIMPLE = re.compile(f"[{re.escape(_ALL)}]*")
#: The pre-tokens of a text of simple characters in lower case.
PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \t\n\v\f\r{_LETTERS}0-9]+")


class WordTokenizer:
    """Ids of whole texts, by way of their pre-tokens: those seen before are looked up.

    Texts of characters beyond ``SIMPLE``, or that may hold special tokens, go to the tokenizer whole. The tests compare both ways.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.ends = np.array([self.tokenizer.id_to_token(k).endswith("</w>") for k in range(self.tokenizer.get_vocab_size())])

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each pre-token. The last id of one is the only one to end in the word-end mark, so many are encoded as one text and told apart by that mark; where
        the number of marks differs from that of the pre-tokens, each is encoded alone."""
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.zeros(0, int)
        if len(last) != len(words):
            return [self.whole(x) for x in words]
        data, cuts = ids.tobytes(), (4 * last).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], cuts)]

    def learn(self, words: set[str]) -> None:
        new = [x for x in words if x not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = list(words)
        for at in range(0, len(new), 2000):
            self.known.update(zip(new[at : at + 2000], self.encode_words(new[at : at + 2000])))

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each whole text, a few megabytes of text at a time."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size > 2_000_000:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[str]) -> Iterator[bytes]:
        split = [PRETOKEN.findall(x.lower()) if len(x) < 4_000_000 and "<|" not in x and (x.isascii() or SIMPLE.fullmatch(x)) else None for x in held]
        self.learn(set().union(*(x for x in split if x)))
        known = self.known
        for text, words in zip(held, split):
            yield self.whole(text) if words is None else b"".join([known[x] for x in words])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def cut(documents: DataFrame, p: PackParams) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, part_key for every piece of every row; part_key numbers the rows, repeated ones apart, and may differ when it is worked out
    again: ``pack`` commits it before anything depends on it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _TOKENIZERS.setdefault(p.tokenizer, WordTokenizer(p.tokenizer))
        end, width = np.array([p.end_id], "<u4").tobytes(), 4 * p.capacity
        for b in batches:
            out = []
            for doc_id, key, ids in zip(b["doc_id"], b["part_key"], tokenizer.ids(b["text"].tolist())):
                ids += end
                total = len(ids) // 4
                for at in range(0, len(ids), width):
                    own = ids[at : at + width]
                    out.append((doc_id, at // 4, len(own) // 4, zlib.crc32(own), total, key))
            got = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part_key"])
            yield got.assign(doc_id=got["doc_id"].astype("Int64"))

    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("part_key"))
    return keyed.mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part_key long")


def pack(documents: DataFrame, p: PackParams) -> DataFrame:
    """Pieces of all rows with sequence_id and offset.

    A null or blank text is its end id alone; repeated rows and rows without doc_id are packed like others; an empty table gives no rows; columns besides doc_id and
    text are not read. sequence_id is the group times 2**32 plus the bin. Sequences are filled from offset 0 without gaps.
    """
    rows = documents.count()
    groups = max(1, rows // p.group_docs)

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "part_key", "start"], ascending=[False, True, True])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), p.capacity)
        return group.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets).drop(columns=["grp", "part_key"])

    # A group is drawn anew for each piece of a full sequence, so that a very long document does not make its group large.
    grp = F.pmod(F.when(F.col("length") == p.capacity, F.xxhash64("part_key", "start")).otherwise(F.col("part_key")), F.lit(groups)).alias("grp")
    # Groups are drawn from committed keys: were a lost executor's pieces cut anew, their groups would stay the same.
    pieces = Scratch(documents.sparkSession, "packing").table(cut(documents, p), "pieces")
    return pieces.select("*", grp).groupBy("grp").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
