"""Queries over the whole `documents` table, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import oracles


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.jaccard_join import link_components

    return link_components(documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.media import media_report

    return media_report(documents(spark, sf_dir))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed clip rows of every document's file."""
    from loomgraph.llm.media import clips, encode_files

    return clips(encode_files(documents(spark, sf_dir)))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.lm_scoring import lm_scores

    return lm_scores(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.mixing import mixed

    return mixed(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.line_dedup import line_report

    return line_report(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.substring_dedup import substring_report

    return substring_report(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.fingerprints import fingerprint_report

    return fingerprint_report(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.toxicity import toxicity_scores

    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.language_id import language_report

    return language_report(documents(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.lexical_search import search

    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.llm.periodic_runs import run_report

    return run_report(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard_join, op2_token_counts, op3_packing, op4_media_columns, op5_lm_scoring, op6_mixing, op7_line_dedup, op8_substring_dedup, op9_fingerprints, op10_toxicity, op11_language_id, op12_lexical_search, op13_periodic_runs, media_clips, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in queries()}
