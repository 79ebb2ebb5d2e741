"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import bpe_digests
from tessella.llm.exact_dedup import exact_dedup
from tessella.llm.language_id import identify_languages, learns, train_language_model
from tessella.llm.license_scan import license_oracle, scan_licenses
from tessella.llm.line_dedup import dedup_lines
from tessella.llm.maxent_lm import holds_out, score_language
from tessella.llm.near_dedup import near_duplicates
from tessella.llm.packing import pack
from tessella.llm.quality_rules import score_quality, train_quality_rules
from tessella.llm.tiff import media_digests


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir))


def tokenizer_path(name: str) -> str:
    """Where the environment keeps the public vocabulary files: ``TESSELLA_TOKENIZERS`` or the installed package."""
    if folder := os.environ.get("TESSELLA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op4_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(_documents(spark, sf_dir))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(_documents(spark, sf_dir), holds_out())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = train_quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (~learns()).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    found = identify_languages(docs, train_language_model(docs, condition=learns()))
    return found.select("doc_id", (~learns()).alias("held_out"), "lang_pred", "score", "langs")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_dedup, op2_license_scan, op3_bpe, op4_media_tiff, op5_maxent_lm, op6_quality_rules, op7_line_dedup, op8_packing, op9_near_dedup, op10_language_id]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op2_license_scan": license_oracle(),
        "op7_line_dedup": r"""
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
            k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.last IS NOT NULL AND f.last <> doc_id) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.last IS NULL OR f.last = doc_id), '')) AS kept_sha256
            FROM k LEFT JOIN f USING (key) GROUP BY doc_id""",
    }
