"""Connected components by alternating star contraction over an edge table; nothing is collected on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import drop_path, scratch


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; ``edges`` has long columns u and v. Root: the component's least node.

    Each round is written to the shared folder, so lineage stays short and lost executors cost one round at most. A
    component of diameter d takes about log d rounds. Loops and repeated edges are harmless; no edge, no row.
    """
    spark = edges.sparkSession
    used: list[str] = []

    def written(df: DataFrame) -> DataFrame:
        used.append(scratch(spark, "components"))
        df.write.parquet(used[-1])
        return spark.read.schema(df.schema).parquet(used[-1])

    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    for _ in range(rounds):
        # Small star: each node's smaller neighbours and itself point to the least of them.
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        small = written(now.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Large star: each node's larger neighbours point to the least of all its neighbours, or to itself. Only nodes
        # that have both larger and smaller neighbours change anything; they are written first, so that the join is of
        # plain shuffles and a node with very many larger neighbours can be split.
        middle = written(small.groupBy("u").agg(F.min("v").alias("m")).join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select(F.col("u").alias("v"), "m"))
        now = written(small.join(middle, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        while len(used) > 1:
            drop_path(spark, used.pop(0))
        # Done when no node has two parents and no parent is a child: one scan and one join of two columns.
        parents = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if now.select(F.col("v").alias("u")).distinct().join(parents, "u", "left_semi").isEmpty() and parents.where("n > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
