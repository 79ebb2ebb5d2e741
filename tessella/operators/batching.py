"""Fixed-size batches over a numbered stream of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_batch(df: DataFrame, position: str, size: int) -> DataFrame:
    """Adds ``batch_id`` (from 0) and ``slot`` for a position that counts from 0."""
    if size < 1:
        raise ValueError("batch size must be positive")
    return df.withColumn("batch_id", F.floor(F.col(position) / size)).withColumn("slot", F.col(position) % size)


def collected(df: DataFrame, columns: list[str], drop_last: int | None = None) -> DataFrame:
    """One row per batch: its samples in slot order. ``drop_last``: only batches of exactly that many."""
    rows = df.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("slot", *columns))).alias("samples")).withColumn("n", F.size("samples"))
    return rows if drop_last is None else rows.where(F.col("n") == drop_last)


def resume_after(batches: DataFrame, step: int) -> DataFrame:
    """Batches after a step: exact, as a plan gives the same batches every time."""
    return batches.where(F.col("batch_id") > step)


def observed_select(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one row with n_kept and n_skipped)."""
    kept = F.coalesce(predicate, F.lit(False))
    return df.where(kept), df.agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_skipped"))
