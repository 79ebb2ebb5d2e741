"""A catalogue of shards from paths ``root/<confidentiality>/<modality>/<dataset>/outputs/<strategy>/<split>/shard-N.tar``."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = r"/([^/]+)/([^/]+)/([^/]+)/outputs/([^/]+)/([^/]+)/shard-(\d+)\.(tar|idx)$"
PARTS = ["confidentiality", "modality", "dataset", "strategy", "split"]


def parse_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds the parts of each path, ``shard_idx`` and ``kind``; other paths are left out."""
    out = df.where(F.col(path).rlike(LAYOUT))
    for i, p in enumerate(PARTS, 1):
        out = out.withColumn(p, F.regexp_extract(path, LAYOUT, i))
    return out.withColumn("shard_idx", F.regexp_extract(path, LAYOUT, 6).cast("int")).withColumn("kind", F.regexp_extract(path, LAYOUT, 7))


def list_catalog(spark: SparkSession, root: str) -> DataFrame:
    """All shards and index files below ``root``, by Spark's own recursive listing; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "shard-*").load(root)
    return parse_paths(files.select("path", "length"))


@dataclass
class CatalogFilter:
    """None: all are allowed."""

    confidentialities: list[str] | None = None
    modalities: list[str] | None = None
    splits: list[str] | None = None
    strategy: str | None = None

    def apply(self, catalog: DataFrame) -> DataFrame:
        for column, allowed in (("confidentiality", self.confidentialities), ("modality", self.modalities), ("split", self.splits), ("strategy", None if self.strategy is None else [self.strategy])):
            if allowed is not None:
                catalog = catalog.where(F.col(column).isin(allowed))
        return catalog


@dataclass
class Confidentialities:
    """Ordered levels, lowest first, each with its mounts."""

    levels: list[str] = field(default_factory=list)
    mounts: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, path: str) -> None:
        if name not in self.levels:
            self.levels.append(name)
        self.mounts[name] = path

    def get(self, name: str) -> str | None:
        return self.mounts.get(name)

    def names(self) -> list[str]:
        return list(self.levels)

    def all_up_to(self, level: str) -> list[str]:
        return self.levels[: self.levels.index(level) + 1]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, n, self.mounts.get(n)) for i, n in enumerate(self.levels)], "level_idx int, name string, path string")


def preview(catalog: DataFrame) -> DataFrame:
    """Shards per dataset and part of the catalogue."""
    return catalog.groupBy(*PARTS).agg(F.count_if(F.col("kind") == "tar").alias("n_shards"))
