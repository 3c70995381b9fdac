"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_codec import encode_bytes
from .common import table
from .piece_codec import encode_documents
from . import angular
from . import language_profiles as languages
from . import minhash, mixing, periodic
from . import quality_gam
from . import quality_rules as rules
from . import suffix_index, topk, toxicity, warc

#: Where the public tokenizers are; a parameter of the operator.
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def piece_model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def byte_tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_TOKENIZER)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.remove_repeats(table(spark, sf_dir, "documents"), match=400)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify_languages(table(spark, sf_dir, "documents"))


def op6_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), least_bytes=0)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), piece_model_file())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return angular.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, scale=256, n_positives=5, n_negatives=5, low_percent=80, high_percent=100)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic.run_digests(periodic.find_runs(docs, least_words=6, least_powers=4))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_bytes(table(spark, sf_dir, "documents"), byte_tokenizer_file())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_quality_gam": op6_quality_gam,
        "op7_warc_archives": op7_warc_archives,
        "op8_exact_topk": op8_exact_topk,
        "op9_source_mixing": op9_source_mixing,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": rules.oracle(),
        "op2_suffix_dedup": suffix_index.oracle(),
        "op3_minhash_dedup": minhash.oracle(),
        "op5_language_id": languages.oracle(),
        "op7_warc_archives": warc.oracle(),
        "op8_exact_topk": topk.oracle(),
        "op11_hard_negatives": angular.oracle(),
        "op12_periodic_runs": periodic.oracle(),
    }
