"""``python -m tessella.sources.cli ROOT preview | count DATASET | add CONF MODALITY DATASET SPLIT``: the catalogue by hand."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources import catalog, tar

FOLDERS = ("raw", "pivot", "metadata", "subset_selection")


def preview(spark: SparkSession, root: str) -> DataFrame:
    return catalog.preview(catalog.list_catalog(spark, root)).orderBy(*catalog.PARTS)


def count(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """(dataset, strategy, split, n): samples by the sizes of the index files."""
    counted = catalog.parse_paths(tar.index_counts(spark, f"{root.rstrip('/')}/*/*/{dataset}/outputs/*/*/shard-*.idx"))
    return counted.groupBy("dataset", "strategy", "split").agg(F.sum("n").alias("n"))


def add(spark: SparkSession, root: str, confidentiality: str, modality: str, dataset: str, split: str, strategy: str = "default") -> str:
    """Make a new dataset's folders in any store; what is there stays."""
    base = f"{root.rstrip('/')}/{confidentiality}/{modality}/{dataset}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in (*FOLDERS, f"outputs/{strategy}/{split}"):
        store.mkdirs(path(f"{base}/{folder}"))
    return base


def main(args: list[str]) -> int:
    commands = {"preview": (preview, 0), "count": (count, 1), "add": (add, 4)}
    if len(args) < 2 or args[1] not in commands or len(args) - 2 != commands[args[1]][1]:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("catalogue").getOrCreate()
    found = commands[args[1]][0](spark, args[0], *args[2:])
    print(found) if isinstance(found, str) else found.show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
