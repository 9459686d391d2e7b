"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule judges.

All of it is DataFrame expressions and Spark's own tree learner; the features are computed inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlParams:
    """``sample`` bounds the labelled urls that the trees learn from (about so many, by a hash of the url, evenly for each label)."""

    sample: int = 20_000
    rounds: int = 12
    depth: int = 4
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of the rules (like ``net/es/``) that fits, else null. A rule fits its host and all subdomains, if the path starts with the rule's."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits a character, over letters, digits and the other characters as one class each."""
    n = F.greatest(F.length(text), F.lit(1))
    total = F.lit(0.0)
    for c in LOWER + "0123456789":
        share = (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))) / n
        total = total - F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    return total


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a url as numbers; 0 for a null url."""
    text = F.coalesce(url, F.lit(""))
    count = lambda x, of: F.length(x) - F.length(F.translate(x, of, ""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    return {
        "length": F.length(text),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "query_length": F.length(query),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "digit_ratio": count(text, "0123456789") / F.greatest(F.length(text), F.lit(1)),
        "host_digit_ratio": count(host, "0123456789") / F.greatest(F.length(host), F.lit(1)),
        "entropy": _entropy(host),
        "hyphens": count(host, "-"),
        "parameters": F.when(F.length(query) > 0, 1 + count(query, "&")).otherwise(0),
        "secure": F.lower(text).startswith("https").cast("int"),
        "fragment": text.contains("#").cast("int"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "vowel_ratio": count(host, "aeiou") / F.greatest(F.length(host), F.lit(1)),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def suffix_statistics(labelled: DataFrame) -> dict[str, float]:
    """Share of blocked urls of each host suffix, smoothed. A labelled host ends with the host of a rule, so there are no more suffixes than rules."""
    s = labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("label").alias("bad"), F.count("*").alias("n"))
    return {r["suffix"]: (r["bad"] + 1.0) / (r["n"] + 2.0) for r in s.collect()}


@dataclass(frozen=True)
class UrlModel:
    """Trees and suffix shares; ``constant`` where the labels are of one kind or missing."""

    trees: Transformer | None
    suffixes: dict[str, float]
    constant: float


def _free(columns: list[str], *names: str) -> list[str]:
    """Names that no column has."""
    taken = {c.lower() for c in columns}
    prefix = "_url_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


def _vector(df: DataFrame, suffixes: dict[str, float], name: str = "_features") -> DataFrame:
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    cols = lexical(url, host, path)
    share = F.lit(0.5)
    if suffixes:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv])[suffix_of(host)], share)
    cols["suffix_share"] = share
    own = dict(zip(cols, _free(df.columns, *cols)))
    wide = df.withColumns({own[k]: c.cast("double") for k, c in cols.items()})
    return VectorAssembler(inputCols=list(own.values()), outputCol=name).transform(wide).drop(*own.values())


def fit(labelled: DataFrame, p: UrlParams = UrlParams()) -> UrlModel:
    """Learns from rows (url, host, path, label), label 1 for blocked. Each url counts once."""
    rows = labelled.where("label IS NOT NULL").groupBy("url").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.max("label").cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    blocked = counts.get(1.0, 0) / max(sum(counts.values()), 1)
    if len(counts) < 2:
        return UrlModel(None, {}, blocked)
    # Half of the sample is for each label, and what one leaves is for the other; weights bring back their shares.
    room = {k: max(p.sample // 2, p.sample - (sum(counts.values()) - n)) for k, n in counts.items()}
    share = {k: min(1.0, max(room[k], 1) / n) for k, n in counts.items()}
    of_label = lambda d: F.when(F.col("label") == 1, F.lit(d[1.0])).otherwise(F.lit(d[0.0]))
    few = rows.where(F.pmod(F.xxhash64("url", F.lit(13)), F.lit(1 << 40)) < of_label({k: int(v * (1 << 40)) for k, v in share.items()}))
    suffixes = suffix_statistics(rows)
    data = _vector(few.withColumn("_weight", of_label({k: 1 / v for k, v in share.items()})), suffixes).select("_features", "label", "_weight")
    data = data.repartition(max(2, math.ceil(min(p.sample, sum(counts.values())) / 5000)))
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", maxIter=p.rounds, maxDepth=p.depth, stepSize=0.3, seed=3, cacheNodeIds=False).fit(data)
    return UrlModel(trees, suffixes, blocked)


def judge(urls: DataFrame, allow: Sequence[str], block: Sequence[str], p: UrlParams = UrlParams()) -> DataFrame:
    """Adds host, path, rule, verdict and block_score to rows with a column url.

    The rule's verdict where one fits, else the trees', which learn from the urls that rules judge. A null url, or one without ``://``, has empty host and path, fits no
    rule and is judged by its features, all 0 for null; repeated urls are judged alike; without labelled urls everything left is allowed. Input columns of these names
    are replaced.
    """
    both = [*allow, *block]
    base = urls.drop("host", "path", "rule", "verdict", "block_score")
    base = base.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), both))
    blocked = F.col("rule").isin(list(block))
    model = fit(base.where("rule IS NOT NULL").select("url", "host", "path", blocked.cast("int").alias("label")), p)
    if model.trees is None:
        scored = base.withColumn("block_score", F.lit(model.constant))
    else:
        names = _free(base.columns, "features", "raw", "probability", "prediction")
        trees = model.trees.copy().setFeaturesCol(names[0]).setRawPredictionCol(names[1]).setProbabilityCol(names[2]).setPredictionCol(names[3])
        out = trees.transform(_vector(base, model.suffixes, names[0]))
        scored = out.withColumn("block_score", vector_to_array(names[2])[1]).drop(*names)
    by_model = F.when(F.col("block_score") >= p.threshold, "block").otherwise("allow")
    return scored.withColumn("verdict", F.when(F.col("rule").isNull(), by_model).when(blocked, "block").otherwise("allow"))
