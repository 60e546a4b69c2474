"""The queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import byte_bpe, cube_mix, lang_unigram, license_dice, ngram_join, quality_llr, secret_scan, telephony, token_spans, toxic_ssk
from tracequarry.plans.shared import attach

#: File of the vocabulary that the tokenizing queries use, in the folder of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: File of the pieces that language identification uses.
PIECES = "piece_bpe_32k.model"


def vocabulary() -> tuple[str, str]:
    """Path and split pattern of the vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % by


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.store_telephony(table(spark, sf_dir, "documents"), keep_files=True).drop("media")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).drop("__same")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), *vocabulary(), scale=2.0)


def op5_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.attribute_tokens(table(spark, sf_dir, "documents"), *vocabulary(), scale=1.4)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents")))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = lang_unigram.identify(docs, docs.where(remainder(4) != 2), public_tokenizers.path(PIECES))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op9_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_dice.scan(table(spark, sf_dir, "documents"))


def op10_toxic_ssk(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(remainder(5) != 0)
    found = toxic_ssk.score(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_llr": op1_quality_llr,
    "op2_telephony": op2_telephony,
    "op3_ngram_join": op3_ngram_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_cube_mix": op5_cube_mix,
    "op6_token_spans": op6_token_spans,
    "op7_secret_scan": op7_secret_scan,
    "op8_language": op8_language,
    "op9_license_dice": op9_license_dice,
    "op10_toxic_ssk": op10_toxic_ssk,
}
SQL: dict[str, str] = {
    "op7_secret_scan": secret_scan.oracle(),
}
