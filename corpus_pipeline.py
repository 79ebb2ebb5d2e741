"""The corpus pipeline: language, quality, exact and near duplicates, packing.

Each stage gets what its predecessor kept (with all columns of ``documents``) and returns what stays; the last returns
packed pieces. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import clearing, keep_rows, saved
from tessella.llm.entries import tokenizer_path
from tessella.llm.exact_dedup import exact_dedup, normalised
from tessella.llm.language_id import UNDETERMINED, identify_languages, learns, train_language_model
from tessella.llm.near_dedup import near_duplicates, norm_words
from tessella.llm.packing import pack
from tessella.llm.quality_rules import score_quality, train_quality_rules

#: A document stays if its quality score reaches this.
LEAST_QUALITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a determined language stay, whatever the number of languages they mix.

    Null texts and texts without letters go, and so does every text where no language was learned. Repeated rows and null
    ids stay as they are, and so do all columns, whatever their names; an empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "lang")
    found = identify_languages(packed, train_language_model(packed, condition=learns()), text_col="row.text", keep=["row"])
    return found.where(F.col("lang_pred") != UNDETERMINED).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not take for low quality stay.

    Null texts count as empty. Repeated rows are scored alike, null ids pass, other columns stay as they are; without
    labels every text has a score of one half and stays.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    model = train_quality_rules(packed, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(packed, model).where(F.col("_score") >= LEAST_QUALITY).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of equal texts stays; of repeats of one id and text, one.

    Null texts count as empty, a null id as the largest; other columns stay as they are.
    """
    return keep_rows(docs, exact_dedup(docs), "doc_id", F.sha2(normalised("text"), 256), "text_sha256")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates stays; nulls and repeats as before."""
    return keep_rows(docs, near_duplicates(docs), "doc_id", F.md5(norm_words("text")), "words_md5")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that stayed, as pieces of sequences; null and empty texts are their end id alone."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Trained models, sketches and tokenizers have no SQL twin; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with clearing(spark):  # a stage's own tables go once its rows are written
            docs = saved(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
