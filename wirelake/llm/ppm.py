"""Language-model scores: prediction by partial matching over bytes, beside a unigram word model.

The trie of byte contexts is a table: one row for each context of ``ORDER`` bytes and the symbol after it, with its count in the training texts; shorter contexts are sums
over longer ones. Escapes follow method D (each symbol of a context gives half a count to the escape), and symbols of the longer context are excluded from the shorter one.
As symbols seen after a context are also seen after each of its ends, what is excluded depends on the context escaped from alone; so the code length of a symbol is a
function of its ``ORDER`` preceding bytes, and is worked out once for each such gram that any text holds, by joins on the table.

Texts are dealt into blocks by a hash. A block asks for the grams and words that it holds, gets their values by a join, and is then scored with them: neither the trie
nor the vocabulary, which grow with the corpus, is ever in one place. What most blocks ask for, up to a bounded number, is broadcast and need not be sent to each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, crc_mod, hot_values
from .textcodes import LOWER, PIECE, Lookup, word_codes

ORDER = 4
#: Bytes that no UTF-8 text holds: before a text, and after it.
PAD, END = 0xFE, 0xFF
SYMBOLS = 256
#: The code of the token that ends a text.
END_TOKEN = np.uint64(0x5BD1E995)


@dataclass(frozen=True)
class PpmParams:
    """``block_bytes`` of text make a block; there are ``blocks`` at least. Of words and of grams ``common`` at the most are broadcast."""

    block_bytes: int = 8_000_000
    blocks: int = 24
    common: int = 250_000


def gram_pieces(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """Grams (``ORDER`` bytes and the symbol after them, as a number) of whole texts, A-Z lower-cased, with their end; the texts they belong to and how many of each."""
    held: list[bytes] = []
    own: list[int] = []
    size = 0

    def flush() -> tuple[np.ndarray, list[int], list[int]]:
        data = np.frombuffer(b"".join(held) + bytes(8), np.uint8)
        low = LOWER[data]
        lengths = np.array([len(x) for x in held])
        starts = np.cumsum(lengths) - lengths
        total = int(lengths.sum())
        eight = np.ndarray(total, ">u8", low.tobytes(), strides=(1,))
        grams = eight.astype(np.uint64) >> np.uint64(8 * (7 - ORDER))
        keep = np.ones(total, bool)
        keep[(starts[:, None] + (lengths[:, None] - ORDER) + np.arange(ORDER)).ravel()] = False
        return grams[keep], list(own), (lengths - ORDER).tolist()

    for k, text in enumerate(texts):
        data = bytes([PAD]) * ORDER + (text or b"") + bytes([END])
        for at in range(0, len(data) - ORDER, PIECE):
            part = data[at : at + PIECE + ORDER]
            held.append(part)
            own.append(k)
            size += len(part)
            if size >= PIECE:
                yield flush()
                held, own, size = [], [], 0
    if held:
        yield flush()


def _sum_by_key(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, int)
    return k[first], np.add.reduceat(n, first) if len(k) else n


def ask(texts: list[bytes | None], times: np.ndarray) -> pd.DataFrame:
    """What a block needs to know, (kind, key), with the times that its training texts hold it. kind 0: words, 1: grams. Each text counts ``times``, held-out ones 0."""
    out = []
    for kind in (0, 1):
        keys, counts = [], []
        for m in np.unique(times).tolist():
            own = [t for t, x in zip(texts, times.tolist()) if x == m]
            if kind == 0:
                for at in range(0, len(own), 500):
                    k, n = np.unique(word_codes(own[at : at + 500])[0], return_counts=True)
                    keys.append(k)
                    counts.append(n * m)
                keys.append(np.array([END_TOKEN]))
                counts.append(np.array([len(own) * m]))
            else:
                for grams, _, _ in gram_pieces(own):
                    k, n = np.unique(grams, return_counts=True)
                    keys.append(k)
                    counts.append(n * m)
        k, n = _sum_by_key(keys, counts)
        out.append(pd.DataFrame({"kind": np.full(len(k), kind, np.int32), "key": k.view(np.int64), "n": n.astype(np.int64)}))
    return pd.concat(out)


def answer(texts: list[bytes | None], words: Lookup, grams: Lookup, tokens: int, kinds: int) -> pd.DataFrame:
    """Scores of each text of a block."""
    n = len(texts)
    n_tokens, n_known, base, score = np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    bottom = np.log10(tokens + kinds + 1)
    end = words.get(np.array([END_TOKEN]))[0]
    n_known += int(end > 0)
    base += np.log10(end + 1) - bottom
    for at in range(0, n, 500):
        codes, counts = word_codes(texts[at : at + 500])
        c = words.get(codes)
        owner = np.repeat(np.arange(len(counts)), counts)
        own = slice(at, at + len(counts))
        n_tokens[own] += counts
        n_known[own] += np.bincount(owner, c > 0, len(counts)).astype(np.int64)
        base[own] += np.bincount(owner, np.log10(c + 1) - bottom, len(counts))
    for keys, own, counts in gram_pieces(texts):
        values = grams.get(keys)
        np.add.at(score, own, np.add.reduceat(values, np.concatenate(([0], np.cumsum(counts)[:-1]))))
    return pd.DataFrame({"n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score})


def code_lengths(grams: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, value, asks): log10 of the symbol's probability for each row (key, n, asks) of ``grams``; n is its training count, 0 for grams of held-out texts alone."""
    trained = grams.where("n > 0")
    # seen[j]: counts of (context of j bytes, symbol); its tables get small with j, those of up to two bytes having at most 65536 rows.
    low = lambda c, j: c.bitwiseAND((1 << (8 * (j + 1))) - 1)
    seen = {ORDER: trained.select(F.col("key").alias(f"g{ORDER}"), F.col("n").alias(f"n{ORDER}"))}
    for j in range(ORDER - 1, -1, -1):
        up = seen[j + 1]
        seen[j] = scratch.table(up.groupBy(low(F.col(f"g{j + 1}"), j).alias(f"g{j}")).agg(F.sum(f"n{j + 1}").alias(f"n{j}")), f"seen{j}")
    out = grams.select("key", "asks")
    for j in range(ORDER, -1, -1):
        small = j <= 1
        context = lambda c: F.shiftright(c, 8)
        stats = seen[j]
        if j:
            below = seen[j - 1]
            stats = stats.withColumn(f"g{j - 1}", low(F.col(f"g{j}"), j - 1)).join(F.broadcast(below) if j <= 2 else below, f"g{j - 1}")
            stats = stats.groupBy(context(F.col(f"g{j}")).alias(f"c{j}")).agg(F.sum(f"n{j}").alias(f"t{j}"), F.count("*").alias(f"q{j}"), F.sum(f"n{j - 1}").alias(f"X{j}"))
        else:
            stats = stats.groupBy(context(F.col("g0")).alias("c0")).agg(F.sum("n0").alias("t0"), F.count("*").alias("q0"))
        out = out.withColumn(f"g{j}", low(F.col("key"), j)).withColumn(f"c{j}", context(F.col(f"g{j}")))
        out = out.join(F.broadcast(seen[j]) if small else seen[j], f"g{j}", "left").join(F.broadcast(stats) if j <= 2 else stats, f"c{j}", "left").drop(f"g{j}", f"c{j}")
    value: Column = F.lit(0.0)
    done: Column = F.lit(False)
    before: tuple[Column, Column] = (F.lit(0), F.lit(0))  # what the longer context excludes: counts and symbols
    for j in range(ORDER, -1, -1):
        total, kinds, n = F.coalesce(F.col(f"t{j}"), F.lit(0)), F.coalesce(F.col(f"q{j}"), F.lit(0)), F.col(f"n{j}")
        new = kinds - before[1]
        space = total - before[0]
        step = F.when(done | (new <= 0), 0.0).when(n.isNotNull(), F.log10((n - 0.5) / space)).otherwise(F.log10(new / (2 * space)))
        value = value + step
        done = done | n.isNotNull()
        before = (F.coalesce(F.col(f"X{j}"), F.lit(0)) if j else F.lit(0), kinds)
    value = value + F.when(done, 0.0).otherwise(-F.log10(F.lit(float(SYMBOLS)) - before[1]))
    return out.select("key", value.alias("value"), "asks")


def _most_asked(values: DataFrame, most: int) -> Column:
    """Words and grams of the highest classes of asking blocks that together are no more than ``most`` of each kind."""
    out: Column = F.lit(False)
    counts = values.groupBy("kind", "asks").count().orderBy("kind", F.desc("asks")).collect()
    for kind in (0, 1):
        total, least = 0, None
        for r in counts:
            if r["kind"] == kind and r["asks"] > 0:
                total += r["count"]
                if total > most:
                    break
                least = r["asks"]
        if least is not None:
            out = out | ((F.col("kind") == kind) & (F.col("asks") >= least))
    return out


def scores(documents: DataFrame, p: PpmParams = PpmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``documents``.

    Learns from rows whose crc32(doc_id) modulo 7 is not 2; a null doc_id gives a null held_out and is not learned from. A null text is an empty one: its end alone.
    Repeated rows each count and are each scored; an empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "ppm")
    docs = documents.select("doc_id", F.col("text").cast("binary").alias("text"), (crc_mod("doc_id", 7) == 2).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(p.blocks, size // p.block_bytes + 1)
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    # A row that very many repeat is brought together, part by part, to one that counts as often; the rest is dealt by a hash of id and text.
    hot = hot_values(docs, "row")
    many = docs.join(F.broadcast(hot), "row", "left_semi").groupBy("row", "doc_id", "held_out").agg(F.max("text").alias("text"), F.count("*").alias("times"))
    docs = docs.join(F.broadcast(hot), "row", "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(many)
    docs = docs.withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")).drop("row")

    def requests(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # pd.isna: a null doc_id is in no training set.
        times = [0 if pd.isna(h) or h else n for h, n in zip(group["held_out"], group["times"])]
        return ask(group["text"].tolist(), np.array(times, np.int64)).assign(block=np.int32(key[0]))

    asked = scratch.table(docs.groupBy("block").applyInPandas(requests, "kind int, key long, n long, block int"), "asked")
    scratch.release()
    known = scratch.table(asked.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.floor(F.log2(F.count("*"))).cast("int").alias("asks")), "known")
    scratch.release()
    tokens, kinds = known.where("kind = 0 AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    values = known.where("kind = 0").select("kind", "key", F.col("n").cast("double").alias("value"), "asks")
    lengths = code_lengths(known.where("kind = 1").select("key", "n", "asks"), scratch)
    values = scratch.table(values.unionByName(lengths.select(F.lit(1).alias("kind"), "key", "value", "asks")), "values")
    scratch.drop("known", *(f"seen{j}" for j in range(ORDER)))
    scratch.release()
    common = values.where(_most_asked(values, p.common))
    own = [common.where(F.col("kind") == k).select("key", "value").toArrow() for k in (0, 1)]
    held = spark.sparkContext.broadcast([(t["key"].to_numpy().view(np.uint64), t["value"].to_numpy()) for t in own])
    few = F.broadcast(common.select("kind", "key"))
    rare = asked.select("block", "kind", "key").join(few, ["kind", "key"], "left_anti")
    answers = rare.join(values.select("kind", "key", "value"), ["kind", "key"])

    def score(texts: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "times"])
        tables = []
        for kind in (0, 1):
            mine = got[got["kind"] == kind]
            keys, numbers = held.value[kind]
            tables.append(Lookup(np.concatenate((keys, mine["key"].to_numpy(np.int64).view(np.uint64))), np.concatenate((numbers, mine["value"].to_numpy(np.float64)))))
        out = answer(texts["text"].tolist(), *tables, tokens, kinds)
        return out.assign(doc_id=texts["doc_id"].astype("Int64").to_numpy(), held_out=texts["held_out"].to_numpy(), times=texts["times"].to_numpy())

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, times long"
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, schema)
    # As many rows again as there were, in portions.
    out = out.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(times - 1) div 10000"))))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(10_000), F.col("times") - 10_000 * F.col("portion")))))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
