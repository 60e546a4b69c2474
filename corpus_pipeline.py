"""Documents to training tokens: language, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the shared folder
and reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.llm import byte_bpe, cube_mix, lang_unigram, ngram_join, secret_scan
from tracequarry.llm._text import trim
from tracequarry.llm.queries import PIECES, remainder, vocabulary
from tracequarry.plans.shared import attach, made, materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose language has a posterior below this goes, as does one without a letter.
LEAST_SCORE = 0.5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_before: list[tuple[SparkSession, str]] = []  # tables that the stage before has left in the shared folder


def tidy(stage: Stage) -> Stage:
    """A stage's result is stored before the next one begins, so what it wrote on the way can then go."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_before)
        trim()
        known = made()
        out = stage(spark, docs, sf_dir)
        _before[:] = [x for x in made() if x not in known]
        return out

    return run_stage



@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; lang becomes the prediction. Learned from three quarters of the labels.

    Where there is no label to learn from, no language can be told from another: all documents stay as they are.
    """
    import public_tokenizers

    attach(spark)
    if docs.where((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).isEmpty():
        return docs.select(*COLUMNS)
    found = lang_unigram.identify(docs, docs.where(remainder(4) != 2), public_tokenizers.path(PIECES), others=("source", "n_chars"), keep_text=True)
    return found.where((F.col("lang_pred") != lang_unigram.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least id."""
    attach(spark)
    return ngram_join.one_of_each(docs).select(*COLUMNS)


@tidy
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values judged live are masked; n_chars follows."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@tidy
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from no time to three."""
    attach(spark)
    mixed = cube_mix.mix(docs, keep=COLUMNS)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


@tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, checked by decoding: doc_id, lang, source, n_tokens, ids (little-endian 32-bit), and digests."""
    attach(spark)
    return byte_bpe.encode_documents(docs, *vocabulary(), keep_ids=True, others=("lang", "source"), scale=0.4)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]
#: The stages are beyond SQL (forward sums, components, cube method, BPE): tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = attach(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    release(_before)
    return docs
