"""The thin queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tollgate.llm.oracles import ORACLE_SQL  # noqa: F401  the driver reads it here

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.substring import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents"), width=50, digest=True)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.packfile import token_files

    return token_files(_table(spark, sf_dir, "documents"), end_id=0)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.pages import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.3)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tollgate.llm.ann import nearest_neighbours

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.binpack import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.suffixes import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents"), length=400, digest=True)


def op9_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.lm import lattice_scores

    return lattice_scores(_table(spark, sf_dir, "documents"), folds=7, fold=2)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tollgate.llm.neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), size=5, threshold=0.8)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_token_files, op3_html_extraction, op4_toxicity, op5_benchmark_decontamination, op6_nearest_neighbours, op7_best_fit_packing, op8_suffix_array_dedup, op9_lattice_likelihood, op10_minhash_near_dedup)}
