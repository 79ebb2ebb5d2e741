"""Per-dataset normalisation: tables, lookup, and its application to arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The channel means and standard deviations of ImageNet.
IMAGENET_MEAN = (0.485, 0.456, 0.406)
IMAGENET_STD = (0.229, 0.224, 0.225)


@dataclass(frozen=True)
class NormStats:
    mean: tuple[float, ...] = IMAGENET_MEAN
    std: tuple[float, ...] = IMAGENET_STD

    def __post_init__(self):
        if len(self.mean) != len(self.std) or any(s <= 0 for s in self.std):
            raise ValueError("as many positive deviations as means")

    @classmethod
    def or_else(cls, mean, std, fallback: NormStats) -> NormStats:
        """Mean and deviation are overridden independently."""
        return cls(tuple(mean or fallback.mean), tuple(std or fallback.std))

    def scaled(self) -> tuple[list[float], list[float]]:
        """For samples from 0 to 255."""
        return [m * 255 for m in self.mean], [s * 255 for s in self.std]


def norm_table(spark: SparkSession, specs, fallback: NormStats = NormStats()) -> DataFrame:
    """(ds_idx, mean, std) in the range of 8-bit samples; ``specs`` in dataset order."""
    rows = [(i, *NormStats.or_else(s.mean, s.std, fallback).scaled()) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, "ds_idx int, mean array<double>, std array<double>")


def norm_lookup(samples: DataFrame, table: DataFrame, fallback: NormStats = NormStats()) -> DataFrame:
    """``samples`` with the mean and deviation of their dataset; an index past the table takes its last row.

    A null index, and any where the table is empty, takes ``fallback``. The table has one row per dataset of the configuration.
    """
    n = table.count()
    at = F.when(F.col("ds_idx").isNotNull(), F.least(F.col("ds_idx"), F.lit(n - 1))) if n else F.lit(None).cast("int")
    rows = table.select(F.col("ds_idx").alias("_at"), F.col("mean").alias("_mean"), F.col("std").alias("_std"))
    found = samples.withColumn("_at", at).join(F.broadcast(rows), "_at", "left")
    mean, std = ([F.lit(float(x)) for x in values] for values in fallback.scaled())
    return found.withColumn("mean", F.coalesce("_mean", F.array(*mean))).withColumn("std", F.coalesce("_std", F.array(*std))).drop("_at", "_mean", "_std")


def normalised_vector(values: Column, mean: Column, std: Column) -> Column:
    return F.transform(values, lambda x: (x.cast("double") - mean) / std)
