"""Weighted mixing of datasets with exact provenance.

A plan of draws t = 0, 1, ... picks a dataset each by inverse distribution; the j-th draw of a dataset takes that
dataset's j-th sample, so that samples keep their order within a dataset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.hashrand import uniform
from tessella.operators.numbering import numbered
from tessella.plans.weights import MixingWeights


def dataset_of(u: str, weights: MixingWeights):
    """The dataset's index for a uniform column: a constant array of bounds, no join."""
    bounds = F.array(*[F.lit(float(hi)) for _, hi in weights.intervals()[:-1]]) if len(weights.names) > 1 else F.array().cast("array<double>")
    return F.size(F.filter(bounds, lambda hi: hi <= F.col(u)))


def draws(spark, n: int, weights: MixingWeights, seed: str, schedule: list[tuple[int, MixingWeights]] | None = None) -> DataFrame:
    """(t, ds_idx, j): the plan. ``schedule``: from draw t on, other weights (sorted by t)."""
    plan = spark.range(n).withColumnRenamed("id", "t").withColumn("_u", uniform(seed, "t"))
    picked = dataset_of("_u", weights)
    for at, later in sorted(schedule or [], key=lambda x: x[0]):
        picked = F.when(F.col("t") >= at, dataset_of("_u", later)).otherwise(picked)
    return numbered(plan.select("t", picked.alias("ds_idx")), "j", [F.col("t")], F.col("t"), ["ds_idx"])


def pool_sizes(pool: DataFrame) -> DataFrame:
    """One row per dataset of the configuration: small enough to broadcast."""
    return pool.groupBy("ds_idx").agg(F.count(F.lit(1)).alias("n"))


def mix_cyclic(plan: DataFrame, pool: DataFrame) -> DataFrame:
    """Every draw yields: a dataset starts over when used up. ``pool``: (ds_idx, k from 1, ...)."""
    sized = plan.join(F.broadcast(pool_sizes(pool)), "ds_idx").withColumn("k", (F.col("j") - 1) % F.col("n") + 1).withColumn("cycle", F.floor((F.col("j") - 1) / F.col("n")))
    return sized.drop("n").join(pool, ["ds_idx", "k"])


def mix_until_exhausted(plan: DataFrame, pool: DataFrame) -> DataFrame:
    """Stops before the first draw that meets a used-up (or empty) dataset."""
    sized = plan.join(F.broadcast(pool_sizes(pool)), "ds_idx", "left")
    cut = sized.where(F.col("j") > F.coalesce("n", F.lit(0))).agg(F.min("t").alias("_cut"))
    # One row: the first failing draw.
    kept = sized.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col("t") < F.col("_cut")))
    return kept.drop("n", "_cut").withColumn("k", F.col("j")).join(pool, ["ds_idx", "k"])


def require_pools(pool: DataFrame | dict[int, int], weights: MixingWeights) -> None:
    """Raise, before mixing, if a dataset that may be drawn has no sample. ``pool``: samples, or their number by dataset."""
    found = pool if isinstance(pool, dict) else {r["ds_idx"] for r in pool_sizes(pool).collect()}
    empty = [n for i, (n, w) in enumerate(zip(weights.names, weights.weights)) if w > 0 and i not in found]
    if empty:
        raise RuntimeError(f"no sample in {', '.join(empty)}")
