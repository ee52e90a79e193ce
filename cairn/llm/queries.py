"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, lm, minhash, mixing, personal_data, token_counts, token_files, toxicity, urls
from .common import crc_of_id, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.decisions(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks: doc_id, item_id, cosine, lcs_share, answer_found."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op10_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scores(docs, model)
    held = F.pmod(crc_of_id(), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), path or tokenizer("piece_bpe_32k.model"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"), lm.is_held_out(), order=lm.ORDER)


def op9_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), path or tokenizer("byte_bpe_50k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # beside the package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_url_filter": op3_url_filter,
    "op4_token_counts": op4_token_counts,
    "op5_fingerprints": op5_fingerprints,
    "op6_personal_data": op6_personal_data,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_ppm_scores": op8_ppm_scores,
    "op9_token_files": op9_token_files,
    "op10_toxicity_kernel": op10_toxicity_kernel,
    "pipeline": pipeline,
}
ORACLES = {"op1_source_mixing": mixing.ORACLE, "op3_url_filter": urls.ORACLE, "op7_minhash_dedup": minhash.ORACLE}
