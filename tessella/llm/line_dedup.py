"""Line deduplication over levelled sorted runs of line hashes, in DataFrame operations only.

A run holds, sorted by hash, how many documents had a line, the largest identifier among them, and whether the line was
new. Each batch merge-anti-joins the runs, which tells new lines from lines that were seen, and adds its own run. As soon
as a level has ``fanout`` runs they are compacted into one of the next. Only what was seen again must meet its first entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WS_CHARS, ascii_lower, drop_path, flagged, scratch, text_or_empty


def line_hash(line: Column, min_chars: int) -> Column:
    """16-byte hash of a line's key (stripped, A-Z lower-cased); null for keys of fewer code points than ``min_chars``."""
    key = F.btrim(line, F.lit(WS_CHARS))
    return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(ascii_lower(key))))


class LineRuns:
    """Levelled runs (hash, n_docs, last_id, new). Of the entries of one hash exactly one, in one run, is ``new``."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 4, id_type: str = "long"):
        self.spark, self.path, self.fanout, self.id_type = spark, path or scratch(spark, "line-runs"), max(2, fanout), id_type
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def add(self, pairs: DataFrame) -> None:
        """Anti-join a batch of distinct (hash, id) pairs to the runs and add it as a run; compact the levels that are full."""
        batch = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_id"))
        self._write(self.seen(batch).withColumn("new", ~F.col("_seen")).drop("_seen"), 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._write(self._merged(full), level + 1)
                for path in full:
                    drop_path(self.spark, path)
            level += 1

    def seen(self, batch: DataFrame) -> DataFrame:
        """``batch`` (with a hash column) with boolean ``_seen``: whether a run holds the hash. Merges sorted sides."""
        paths = self._paths()
        if not paths:
            return batch.withColumn("_seen", F.lit(False))
        held = self._read(paths).where("new").select("hash", F.lit(True).alias("_held"))
        return batch.join(held.hint("merge"), "hash", "left").withColumn("_seen", F.col("_held").isNotNull()).drop("_held")

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a new batch whose hash no run holds yet (call before :meth:`add`)."""
        return self.seen(batch).where(~F.col("_seen")).drop("_seen")

    def merged(self) -> DataFrame:
        """All runs as one: hash, n_docs, last_id, new."""
        paths = self._paths()
        return self._read(paths) if len(paths) == 1 else self._merged(paths)

    def _paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"hash binary, n_docs long, last_id {self.id_type}, new boolean").parquet(*paths)

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/run={self.written}"
        run.sortWithinPartitions("hash").write.parquet(path)
        self.written += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _merged(self, paths: list[str]) -> DataFrame:
        return self._read(paths).groupBy("hash").agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"), F.bool_or("new").alias("new"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, kept_text.

    Lines end at line feeds; a null or empty text is one empty line. A key is the line stripped of ASCII white space
    with A-Z lower-cased; keys of at least ``min_chars`` code points found in at least ``min_docs`` rows lose all their
    lines except in the rows with the largest id that holds them. Rows that repeat an id count as documents of their
    own and share its fate; a null id is never the largest unless all are null. An empty table gives an empty result;
    columns other than id and text are not read.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    held = F.array_distinct(F.filter(F.transform(F.split("text", "\n", -1), lambda x: line_hash(x, min_chars)), lambda h: h.isNotNull()))
    id_type = base.schema["id"].dataType.simpleString()
    path = scratch(spark, "line-pairs")
    base.select("id", F.explode(held).alias("hash")).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    pairs = spark.read.schema(f"id {id_type}, hash binary, batch int").parquet(path)
    runs = LineRuns(spark, fanout=fanout, id_type=id_type)
    for i in range(batches):
        runs.add(pairs.where(F.col("batch") == i).drop("batch"))
    frequent = runs.merged().where(F.col("n_docs") >= min_docs).select("hash", "last_id")
    dropping = spark.read.schema(f"id {id_type}, hashes array<binary>").parquet(_drops(pairs, frequent))
    drop_path(spark, path)
    drop_path(spark, runs.path)
    found = flagged(base, [F.col("id")], dropping)
    clear = found.where(~F.col("_maybe")).select("id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept_text"))
    # One way at every size: both joins merge sorted sides, whose large partitions Spark may split.
    joined = found.where("_maybe").join(dropping.withColumnRenamed("id", "_id").hint("merge"), F.col("id").eqNullSafe(F.col("_id")), "left")
    lines = F.split("text", "\n", -1)
    stays = F.when(F.col("hashes").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("hashes"), line_hash(x, min_chars)), F.lit(False))))
    cut = joined.select("id", F.size(lines).cast("long").alias("n_lines"), stays.alias("stays"))
    cut = cut.select("id", "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_dropped"), F.array_join("stays", "\n").alias("kept_text"))
    return clear.unionByName(cut).withColumnRenamed("id", id_col)


def _drops(pairs: DataFrame, frequent: DataFrame) -> str:
    """Merge the pairs against the frequent hashes: per id, the hashes that it loses. Returns the table's path."""
    path = scratch(pairs.sparkSession, "line-drops")
    lost = pairs.join(frequent.hint("merge"), "hash").where(~F.col("id").eqNullSafe(F.col("last_id")))
    lost.groupBy("id").agg(F.collect_set("hash").alias("hashes")).write.parquet(path)
    return path
