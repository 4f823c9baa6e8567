"""The operators as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.llm import codebooks, decontam, language, lines, mixing, phrases, quality, simhash, substrings, tokens, toxicity, vectors, warc
from railpulse.llm.oracle import ORACLES

QUERY_MODULUS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    """Path of the vocabulary file, as the installed package gives it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vectors.nearest(rows, rows.where(F.col("vec_id") % QUERY_MODULUS == 0))


def _substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def _with_labels(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_line_dedup": _on_documents(lines.report),
        "op2_warc_revisits": warc.round_trip,
        "op3_token_counts": _on_documents(lambda docs: tokens.count_tokens(docs, byte_bpe())),
        "op4_nearest_vectors": _nearest,
        "op5_decontamination": lambda s, d: decontam.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op6_source_mix": _on_documents(mixing.mix_sources),
        "op7_simhash": _on_documents(simhash.near_duplicates),
        "op8_toxicity": _with_labels(toxicity.toxicity),
        "op9_substring_dedup": _substrings,
        "op10_quality": _with_labels(quality.quality),
        "op11_language": _on_documents(language.report),
        "op12_codebooks": lambda s, d: codebooks.report(table(s, d, "embeddings")),
        "op13_collocations": _on_documents(phrases.collocations),
        "pipeline": corpus_pipeline.run,
    }


def llm_oracles() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
