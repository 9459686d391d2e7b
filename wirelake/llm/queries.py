"""The queries of the corpus operators: each applies its operator, with the parameters used in production, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, html_text, jaccard, langid, multiindex, oracle, packing, ppm, prefixtrie, quality, ranked, url_filter, warc

ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = "/opt/tokenizers"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return str(public_tokenizers.path(name))
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(_read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(_read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, ALLOW, BLOCK).select("page_id", "host", "path", "rule", "verdict")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), packing.PackParams(tokenizer_path()))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(_read(spark, sf_dir, "conversations"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(_read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_warc,
        op2_language_id,
        op3_lm_scoring,
        op4_html_extraction,
        op5_jaccard_join,
        op6_url_filter,
        op7_quality_classifier,
        op8_packing,
        op9_ann,
        op10_decontamination,
        op11_ranked_search,
        op12_prefix_trie,
        op13_multi_index,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others rest on trained models, tokenizers or approximate search."""
    return {"op1_warc": oracle.WARC, "op5_jaccard_join": oracle.JACCARD, "op10_decontamination": oracle.DECONTAMINATION, "op11_ranked_search": oracle.RANKED, "op12_prefix_trie": oracle.TRIE, "op13_multi_index": oracle.LINKED_VECTORS}
