"""Language identification with string kernels.

Two texts are compared by the n-grams of 1 to ``max_n`` characters that both hold (blended-spectrum presence kernel, n-grams hashed to ``2**bits`` buckets, divided by
the root of both sizes). Nyström landmarks span the feature space, and one kernel ridge regression for each language against the rest is solved on it. Because the
kernel is a product of presence vectors, K(x, landmarks) @ alpha is (x @ landmarks.T) @ alpha = x @ (landmarks.T @ alpha): a batch is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import crc_mod

PIECE = 1 << 19
BATCH = 64


@dataclass(frozen=True)
class KernelParams:
    """``sample`` bounds the labelled rows learned from (evenly over the languages, chosen by a hash of doc_id), ``landmarks`` the Nyström landmarks among them."""

    bits: int = 15
    max_n: int = 4
    sample: int = 2000
    landmarks: int = 300
    ridge: float = 1e-2
    sharpness: float = 6.0


@dataclass(frozen=True)
class KernelModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray


def presence(text: str, out: np.ndarray, p: KernelParams) -> None:
    """Marks in ``out`` the buckets of the n-grams of a whole text, in lower case with runs of what is no letter as one blank. Long texts go through in pieces."""
    shift = np.uint64(64 - p.bits)
    for at in range(0, max(len(text), 1), PIECE):
        part = text[max(0, at - p.max_n + 1) : at + PIECE].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        letter = _letters(points)
        points = np.where(letter, points, np.uint64(32))
        points = points[letter | np.concatenate((letter[:1], letter[:-1]))]
        acc = np.zeros(len(points), np.uint64)
        for n in range(1, p.max_n + 1):
            if len(points) < n:
                break
            acc = (acc[: len(points) - n + 1] + points[n - 1 :] + np.uint64(n << 21)) * np.uint64(0x9E3779B97F4A7C15)
            out[((acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift] = 1


_LETTER = np.zeros(0x3000, bool)
_LETTER[[k for k in range(0x3000) if chr(k).isalpha()]] = True


def _letters(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters; above U+3000 all but symbols and private use are taken as such."""
    low = points < 0x3000
    return np.where(low, _LETTER[np.where(low, points, 0)], (points >= 0x3040) & ((points < 0xE000) | (points >= 0xF900)) & ((points < 0x1F000) | (points >= 0x20000)))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _rows(texts: list[str], p: KernelParams) -> np.ndarray:
    out = np.zeros((len(texts), 1 << p.bits), np.float32)
    for k, t in enumerate(texts):
        presence(t, out[k], p)
    return out


def solve(packed: np.ndarray, langs: list[str], p: KernelParams) -> KernelModel:
    """Kernel ridge regressions from presence rows given as packed bits; only the landmarks are unpacked all at once."""

    def unit(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1)[:, : 1 << p.bits].astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return x

    names = sorted(set(langs))
    n = len(packed)
    y = np.where(np.array(langs)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    marks = unit(packed[np.linspace(0, n - 1, min(n, p.landmarks)).astype(int)])
    kmm = (marks @ marks.T).astype(np.float64)
    knm = np.concatenate([unit(packed[k : k + 200]) @ marks.T for k in range(0, n, 200)]).astype(np.float64)
    mean = y.mean(0)
    balance = (1 / np.array([langs.count(c) for c in langs]))[:, None] * n / len(names)
    left = knm.T @ (balance * knm) + p.ridge * n * kmm + 1e-6 * n * np.eye(len(marks))
    alpha = np.linalg.solve(left, knm.T @ (balance * (y - mean)))
    return KernelModel(names, (marks.T @ alpha).astype(np.float32), mean)


def fit(labelled: DataFrame, p: KernelParams = KernelParams()) -> KernelModel | None:
    """Learns from rows (doc_id, text, lang); those without text, letters, lang or doc_id are left out, repeated rows count once. None where nothing is left.

    ``sample`` bounds the labelled rows, and with them the languages: of more than a quarter of it, the commonest count (ties to the first by name). At most twice as many
    rows, those of the smallest ids, are learned from."""
    known = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(p.sample // 4).collect()
    if not counts:
        return None
    each = p.sample / len(counts)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(1_000_000 * min(1.0, each / max(r["n"], 1))))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.coalesce(share[F.col("lang")], F.lit(0)))
    settings = p

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = b[[has_letter(t) for t in b["text"]]]
            yield own[["doc_id", "lang"]].assign(bits=[np.packbits(_rows([t], settings)[0] > 0).tobytes() for t in own["text"]])

    got = chosen.mapInPandas(run, "doc_id long, lang string, bits binary").groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).toPandas().sort_values(["doc_id", "lang"])
    if not len(got):
        return None
    got = got.iloc[: 2 * p.sample]
    packed = np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1)
    return solve(packed, got["lang"].tolist(), p)


def judge(texts: list[str | None], model: KernelModel | None, p: KernelParams) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its score from 0 to 1; ``und`` and 0 for texts that are null or have no letter, and where there is no model."""
    langs, scores = ["und"] * len(texts), np.zeros(len(texts))
    use = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
    for at in range(0, len(use), BATCH):
        own = use[at : at + BATCH]
        x = _rows([texts[k] for k in own], p)
        m = (x @ model.weights) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + model.bias
        e = np.exp(p.sharpness * (m - m.max(1, keepdims=True)))
        best = m.argmax(1)
        for i, k in enumerate(own):
            langs[k], scores[k] = model.languages[best[i]], e[i, best[i]] / e[i].sum()
    return langs, scores


def identify(documents: DataFrame, model: KernelModel | None, p: KernelParams = KernelParams()) -> DataFrame:
    """Adds ``lang_pred`` and ``lang_score`` to whole documents; only the column text is looked at."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, scores = judge(b["text"].tolist(), held.value, p)
            yield b.assign(lang_pred=langs, lang_score=scores)

    kept = documents.drop("lang_pred", "lang_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(run, f"{schema}, lang_pred string, lang_score double")


def languages(documents: DataFrame, p: KernelParams = KernelParams()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``documents``.

    Learns from rows whose crc32(doc_id) modulo 4 is not 2. Null texts and texts without a letter are ``und`` with score 0, as is all where nothing could be learned;
    repeated rows are each judged; a null doc_id gives a null held_out; other columns are not read.
    """
    model = fit(documents.where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"), p)
    return identify(documents.select("doc_id", "text"), model, p).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
