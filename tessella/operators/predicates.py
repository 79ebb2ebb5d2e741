"""Sample filters over sidecar metadata, before any image column is touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality_keeps(score: Column, threshold: float | None) -> Column:
    """Samples stay unless a threshold is set and a score is there and below it."""
    return F.lit(True) if threshold is None else score.isNull() | (score >= threshold)


def quality_keeps_default_one(has_sidecar: Column, score: Column, threshold: float) -> Column:
    """The archive-stream rule: no sidecar stays; a sidecar without score counts as 1."""
    return ~has_sidecar | (F.coalesce(score, F.lit(1.0)) >= threshold)


def sidecar_score(meta: str = "meta", field: str = "quality_score") -> Column:
    """A number of the JSON sidecar, or null."""
    return F.get_json_object(meta, f"$.{field}").try_cast("double")


def where_sample(df: DataFrame, predicate: Column | Callable[[DataFrame], Column], fields: tuple[str, ...] = ("key", "shard_path", "meta")) -> DataFrame:
    """Filter by a predicate on the light columns alone; a callable gets only those."""
    if callable(predicate) and not isinstance(predicate, Column):
        predicate = predicate(df.select(*[f for f in fields if f in df.columns]))
    return df.where(predicate)
