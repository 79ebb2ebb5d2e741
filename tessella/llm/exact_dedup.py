"""Exact deduplication with a log-structured merge index, in DataFrame operations only.

Rows go to memtables by a hash. Each memtable flushes one run of level 0, sorted by digest, that holds per digest the
smallest identifier and the number of rows, and a membership filter of its digests. As soon as a level has ``fanout`` runs
they are compacted into one of the next: entries that the other runs' filters rule out are copied, the rest is looked up in
them, and of equal digests the smallest identifier stays. Rows whose digest is shared (hits) are verified byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import WS_CLASS, drop_path, filter_bits, flagged, in_filter, key_filter, saved, scratch, text_or_empty


def normalised(text: str | Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(text_or_empty(text), WS_CLASS + "+", " ")


@dataclass
class Run:
    """A sorted run: its entries' path, that of its filter, and the filter's size (None: none)."""

    path: str
    filter_path: str
    bits: int | None


class DigestIndex:
    """Levels of runs with one entry per digest: (digest, keep_id, keep_row, n). Null ids count as largest."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = 2, id_type: str = "long"):
        self.spark, self.path, self.fanout, self.id_type = spark, path or scratch(spark, "digests"), max(2, fanout), id_type
        self.levels: list[list[Run]] = [[]]
        self.written = 0

    def flush(self, rows: DataFrame) -> None:
        """Add a memtable of rows (id, digest, row) as a run of level 0; compact the levels that are full."""
        first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
        entries = rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n")
        self._write(entries, 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self._compact(self.levels[level], level + 1)
            level += 1

    def _write(self, entries: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}/run={self.written}"
        entries.sortWithinPartitions("digest").write.parquet(f"{path}/entries")
        run = Run(f"{path}/entries", f"{path}/filter", None)
        kept = self.entries(run)
        run.bits = filter_bits(kept.count())
        if run.bits:
            key_filter(kept, [F.col("digest")], run.bits).write.parquet(run.filter_path)
        self.written += 1
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def entries(self, run: Run) -> DataFrame:
        return self.spark.read.schema(f"digest binary, keep_id {self.id_type}, keep_row long, n long").parquet(run.path)

    def maybe_in(self, df: DataFrame, run: Run, name: str) -> DataFrame:
        """``df`` with boolean ``name``: false only for digests that the run's filter rules out."""
        bitmap = self.spark.read.schema("_bucket long, _bits binary").parquet(run.filter_path) if run.bits else None
        return in_filter(df, [F.col("digest")], bitmap, name, run.bits)

    def _compact(self, runs: list[Run], level: int) -> None:
        """Merge runs into one of ``level``. Entries of one run alone are copied without a shuffle."""
        marked = []
        for run in runs:
            found = self.entries(run)
            others = [o for o in runs if o is not run]
            for k, other in enumerate(others):
                found = self.maybe_in(found, other, f"_in{k}")
            marked.append(found.withColumn("_maybe", reduce(lambda a, b: a | b, [F.col(f"_in{k}") for k in range(len(others))])).select("digest", "keep_id", "keep_row", "n", "_maybe"))
        every = reduce(DataFrame.unionByName, marked)
        first = F.min(F.struct(F.col("keep_id").isNull().alias("no_id"), "keep_id", "keep_row")).alias("first")
        merged = every.where("_maybe").groupBy("digest").agg(first, F.sum("n").alias("n")).select("digest", F.col("first.keep_id").alias("keep_id"), F.col("first.keep_row").alias("keep_row"), "n")
        gone = list(runs)
        self._write(every.where(~F.col("_maybe")).drop("_maybe").unionByName(merged), level)
        runs.clear()
        for run in gone:
            drop_path(self.spark, run.path.rsplit("/", 1)[0])

    def compact(self) -> DataFrame:
        """All runs as one: digest, keep_id, keep_row, n."""
        runs = [r for level in self.levels for r in level]
        if len(runs) > 1:
            top = len(self.levels)
            self._compact(runs, top)
            self.levels = [[] for _ in range(top)] + [self.levels[top]]
        return self.entries(self.levels[-1][0])

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of a batch (with a digest column) whose digest no run holds: filters first, then the runs themselves."""
        for run in [r for level in self.levels for r in level]:
            found = self.maybe_in(batch, run, "_maybe")
            clear = found.where(~F.col("_maybe")).drop("_maybe")
            batch = clear.unionByName(found.where("_maybe").drop("_maybe").join(self.entries(run).select("digest"), "digest", "left_anti"))
        return batch


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtables: int = 4) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after :func:`normalised`; the row with the smallest id of each group is kept. Null
    text counts as empty. Of repeated rows with one id and one text exactly one is kept; a null id counts as the
    largest. An empty table gives an empty result; further columns of ``docs`` are not read. Should two texts share a
    digest, byte verification finds it and the group is formed anew by whole texts.
    """
    spark = docs.sparkSession
    # The hash is of the text alone, so that no column of ``docs`` but these two is read.
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = base.schema["id"].dataType.simpleString()
    at = scratch(spark, "digest-rows")
    rows = base.select("id", F.unhex(F.sha2(normalised("text"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows.withColumn("memtable", F.pmod(F.xxhash64("row"), F.lit(memtables)).cast("int")).sortWithinPartitions("memtable").write.partitionBy("memtable").parquet(at)
    rows = spark.read.schema(f"id {id_type}, digest binary, row long, memtable int").parquet(at)
    index = DigestIndex(spark, id_type=id_type)
    for k in range(memtables):
        index.flush(rows.where(F.col("memtable") == k).drop("memtable"))
    hits = index.compact().where("n > 1")
    # A row that the filter of shared digests rules out is alone; the others look their digest up.
    found = flagged(rows.drop("memtable"), [F.col("digest")], hits)
    alone = found.where(~F.col("_maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    shared = found.where("_maybe").drop("_maybe").join(hits, "digest", "left")
    n = F.coalesce("n", F.lit(1).cast("long"))
    shared = shared.select("id", F.when(n > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), n.alias("group_size"), (F.col("row") == F.coalesce("keep_row", "row")).alias("kept"), "digest")
    shared = saved(shared, "digest-shared")
    out = alone.unionByName(shared)
    wrong = _unequal(base, shared.where("group_size > 1").select("id"))
    if wrong is not None:
        out = _by_whole_text(base, out, wrong)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def _unequal(base: DataFrame, hits: DataFrame) -> DataFrame | None:
    """Digests whose texts differ in any byte, or None. Smallest and largest text of a group are equal iff all are."""
    texts = flagged(base, [F.col("id")], hits).where("_maybe").select(normalised("text").alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    bad = texts.groupBy("digest").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where(F.col("lo") != F.col("hi")).select("digest")
    return None if bad.isEmpty() else bad


def _by_whole_text(base: DataFrame, out: DataFrame, wrong: DataFrame) -> DataFrame:
    """Replace the rows of colliding digests by groups of whole texts."""
    texts = base.select("id", normalised("text").alias("norm"), F.monotonically_increasing_id().alias("row")).withColumn("digest", F.unhex(F.sha2("norm", 256))).join(wrong, "digest", "left_semi")
    first = texts.groupBy("digest", "norm").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    again = texts.join(first, ["digest", "norm"]).select("id", F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest")
    return out.join(wrong, "digest", "left_anti").select(again.columns).unionByName(again)
