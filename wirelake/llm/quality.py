"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates.

Features of a text are its words, pairs of neighbouring words, and the shapes of words (runs of small letters, capitals, digits, each other byte) alone, in pairs, in
triples and with the mark "same word as before", hashed to ``2**bits`` buckets. A feature's value is its share of the text's features times ``SCALE``, so a score is
a sparse dot product and memory does not depend on the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import crc_mod
from .textcodes import mix, slices, word_codes

SCALE = 30.0


@dataclass(frozen=True)
class FtrlParams:
    """``sample`` bounds the labelled rows that are learned from (about so many, chosen by a hash of doc_id); each of ``shards`` learns a model from its part, and
    the weights are averaged."""

    bits: int = 18
    sample: int = 12_000
    shards: int = 6
    epochs: int = 3
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.05
    threshold: float = 0.3


def features(texts: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all texts in order, and how many each text has."""
    codes, counts, shapes = word_codes(texts, shapes=True)
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    first = np.zeros(n, bool)
    starts = np.cumsum(counts) - counts
    first[starts[counts > 0]] = True
    before = lambda x: np.where(first, np.uint64(1), np.concatenate((x[:1], x[:-1])))
    last, last_shape = before(codes), before(shapes)
    same = (codes == last).astype(np.uint64)
    k = [np.uint64(x) for x in (3, 5, 7, 11, 13)]
    parts = (codes, mix(last * k[0] + codes), shapes + k[1], mix(last_shape * k[2] + shapes), mix(before(last_shape) * k[3] + last_shape * k[2] + shapes), mix(shapes * k[4] + same))
    shift = np.uint64(64 - bits)
    return (np.stack([mix(p + np.uint64(i)) for i, p in enumerate(parts)], axis=1) >> shift).astype(np.int64).ravel(), counts * len(parts)


def margins(texts: list[bytes | None], weights: np.ndarray, bias: float) -> np.ndarray:
    bits = int(len(weights)).bit_length() - 1
    buckets, counts = features(texts, bits)
    sums = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
    ends = np.cumsum(counts)
    return bias + SCALE * (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


def train(texts: list[bytes | None], labels: np.ndarray, p: FtrlParams) -> np.ndarray:
    """Weights of all buckets and, last, of the bias."""
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for text in texts:
        b, _ = features([text], p.bits)
        idx, tf = np.unique(b, return_counts=True)
        rows.append((np.append(idx, size), np.append(SCALE * tf / max(len(b), 1), 1.0)))
    order = np.random.default_rng(5)
    weight = lambda i: np.where(np.abs(z[i]) <= p.l1, 0.0, -(z[i] - np.sign(z[i]) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            w = weight(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weight(np.arange(size + 1))


def fit(documents: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams()) -> np.ndarray | None:
    """Learns from the labelled documents given; None where no label is known.

    A document with several labels counts with their mean; one that occurs several times counts once, with the smallest of its texts; rows without doc_id or label
    are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    rows = known.count()
    if not rows:
        return None
    few = known.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, p.sample / rows)))
    chosen = documents.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    settings = p

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        w = train([None if t is None else t.encode() for t in group["text"]], group["label"].to_numpy(), settings)
        at = np.flatnonzero(w)
        return pd.DataFrame({"bucket": at, "weight": w[at], "share": float(len(group))})

    parts = chosen.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(p.shards))).groupBy("shard").applyInPandas(learn, "bucket long, weight double, share double")
    got = parts.groupBy("bucket").agg(F.sum(F.col("weight") * F.col("share")).alias("weight")).toArrow()
    out = np.zeros((1 << p.bits) + 1)
    total = chosen.count()
    if total:
        out[got["bucket"].to_numpy()] = got["weight"].to_numpy() / total
    return out


def score(documents: DataFrame, weights: np.ndarray | None, p: FtrlParams = FtrlParams()) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` to whole documents; a null text counts as empty, and an empty one gets the bias alone. Without a model: 0.5."""
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast(np.append(np.zeros(1 << p.bits, np.float32), np.float32(0)) if weights is None else weights.astype(np.float32))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = model.value
        for b in batches:
            texts = b["text"].tolist()
            m = np.concatenate([np.zeros(0), *(margins([None if t is None else t.encode() for t in texts[s]], w[:-1], float(w[-1])) for s in slices(texts))])
            yield b.assign(score=1 / (1 + np.exp(-np.clip(m, -35, 35))))

    kept = documents.drop("score", "predicted")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{schema}, score double").withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``.

    Learns from labelled rows whose crc32(doc_id) modulo 5 is not 0. A null doc_id is never held out (held_out is null) and never learned from; repeated rows each get
    their score; an empty table gives no rows; columns besides doc_id and text are not read.
    """
    docs = documents.select("doc_id", "text")
    weights = fit(docs, labels.where(crc_mod("doc_id", 5) != 0).select("doc_id", "quality"), p)
    return score(docs, weights, p).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
