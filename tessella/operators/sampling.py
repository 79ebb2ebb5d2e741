"""Partitioning, permutation and resampling of shards and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.hashrand import uniform
from tessella.operators.numbering import numbered

MODES = ("sequential", "shuffle", "epoch", "resampled")


def shard_table(df: DataFrame, dataset: str, shard: str) -> DataFrame:
    """(dataset, shard, shard_idx, n): a dataset's shards in order of their names, from 0."""
    sizes = df.groupBy(dataset, shard).agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("shard_idx", F.row_number().over(Window.partitionBy(dataset).orderBy(shard)) - 1)


def assign_ranks(shards: DataFrame, world_size: int) -> DataFrame:
    """Adds ``rank``: shard i belongs to rank i mod world size."""
    return shards.withColumn("rank", F.pmod(F.col("shard_idx"), F.lit(world_size)))


def of_rank(shards: DataFrame, rank: int, world_size: int) -> DataFrame:
    """The shards of one rank; raises if there is none."""
    mine = shards.where(F.pmod(F.col("shard_idx"), F.lit(world_size)) == rank)
    if mine.isEmpty():
        raise RuntimeError(f"no shards assigned to rank {rank} of {world_size}")
    return mine


def coverage(shards: DataFrame, dataset: str, world_size: int, few: int = 4) -> DataFrame:
    """Per dataset: number of shards, whether each rank gets one, and whether some rank gets fewer than ``few``."""
    n = shards.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_shards"))
    return n.withColumn("covered", F.col("n_shards") >= world_size).withColumn("least_per_rank", F.floor(F.col("n_shards") / world_size)).withColumn("few", F.col("least_per_rank") < few)


def permuted(df: DataFrame, seed: str, key: str, by: list[str], name: str = "pos") -> DataFrame:
    """A full random permutation within ``by``: each row once."""
    return numbered(df.withColumn("_u", uniform(seed, key)), name, [F.col("_u"), F.col(key)], F.col("_u"), by).drop("_u")


def race_time(weight: Column, u: Column) -> Column:
    """Exponential race: sorting by it samples without replacement in proportion to the weights; weight 0 comes last."""
    return F.when(weight > 0, -F.log(1.0 - u) / weight).otherwise(F.lit(float("inf")))


def weighted_permutation(df: DataFrame, seed: str, key: str, weight: str, by: list[str], name: str = "pos") -> DataFrame:
    """A full permutation in which heavier rows tend to come first."""
    timed = df.withColumn("_t", race_time(F.col(weight), uniform(seed, key)))
    return numbered(timed, name, [F.col("_t"), F.col(key)], F.col("_t"), by).drop("_t")


def resampled(df: DataFrame, seed: str, key: str, by: str, draws: DataFrame) -> DataFrame:
    """Draws with replacement: ``draws`` (by, t) each take a row of their group, uniformly."""
    pool = numbered(df, "_k", [F.col(key)], F.col(key), [by])
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))  # one row per dataset of the configuration
    drawn = draws.join(F.broadcast(sizes), by).withColumn("_k", F.floor(uniform(seed, by, "t") * F.col("_n")) + 1)
    return drawn.join(pool, [by, "_k"]).drop("_n", "_k")


def block_shuffled(df: DataFrame, seed: str, key: str, buffer: int, by: list[str], name: str = "pos") -> DataFrame:
    """Shuffle within consecutive blocks of ``buffer`` rows in key order: what a shuffle buffer of that depth can reach."""
    placed = numbered(df, "_at", [F.col(key)], F.col(key), by).withColumn("_block", F.floor((F.col("_at") - 1) / buffer)).withColumn("_u", uniform(seed, key))
    inner = F.row_number().over(Window.partitionBy(*by, "_block").orderBy("_u", key))
    return placed.withColumn(name, F.col("_block") * buffer + inner).drop("_at", "_block", "_u")


def ordered_shards(shards: DataFrame, dataset: str, mode: str, seed: str, quality: str | None = None) -> DataFrame:
    """Adds ``pos`` to a shard table by sampling mode. ``shuffle`` and ``epoch`` permute, by quality if given."""
    if mode not in MODES:
        raise ValueError(f"shard sampling {mode!r} is none of {MODES}")
    if mode == "sequential":
        return shards.withColumn("pos", F.col("shard_idx") + 1)
    if mode == "resampled":
        return resampled(shards, seed, "shard_idx", dataset, shards.select(dataset, F.col("shard_idx").alias("t"))).withColumn("pos", F.col("t") + 1).drop("t")
    keyed = shards.withColumn("_key", F.concat_ws("/", dataset, F.col("shard_idx").cast("string")))
    out = weighted_permutation(keyed, seed, "_key", quality, [dataset]) if quality else permuted(keyed, seed, "_key", [dataset])
    return out.drop("_key")
