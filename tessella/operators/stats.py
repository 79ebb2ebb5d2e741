"""Metrics: rates, staleness, timing summaries, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.numbering import numbered


def rates(log_table: DataFrame, by: str, ts: str, value: str, *ties: str) -> DataFrame:
    """Adds ``rate``: change of ``value`` per second since the row before; null for the first and for no time passed."""
    w = Window.partitionBy(by).orderBy(ts, *ties)
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    return log_table.withColumn("rate", F.try_divide(F.col(value) - F.lag(value).over(w), seconds))


def stale(log_table: DataFrame, by: str, ts: str, after_s: float) -> DataFrame:
    """Per source: its last heartbeat, and whether that is older than ``after_s`` seconds before the newest of all."""
    last = log_table.groupBy(by).agg(F.max(ts).alias("last_ts"))
    newest = log_table.agg(F.max(ts).alias("newest"))  # one row
    age = (F.unix_micros(F.col("newest").cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6
    return last.crossJoin(F.broadcast(newest)).withColumn("age_s", age).withColumn("stale", F.col("age_s") > after_s).drop("newest")


def timing(df: DataFrame, by: str, ms: str, tie: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), median and p95 (the sorted value at index int(0.95 n), from 0).

    The two order statistics come from numbering in buckets by quantiles, so that no group is gathered in one task.
    """
    sums = df.groupBy(by).agg(F.avg(ms).alias("mean_ms"), F.coalesce(F.stddev_samp(ms), F.lit(0.0)).alias("sd_ms"), F.count(F.lit(1)).alias("n"))
    ranked = numbered(df.select(by, ms, tie), "_r", [F.col(ms), F.col(tie)], F.col(ms), [by]).join(sums.select(by, "n"), by)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    picked = ranked.groupBy(by).agg(((F.max(F.when(F.col("_r") == low, F.col(ms))) + F.max(F.when(F.col("_r") == high, F.col(ms)))) / 2).alias("median_ms"), F.max(F.when(F.col("_r") == F.floor(F.col("n") * 0.95) + 1, F.col(ms))).alias("p95_ms"))
    return sums.join(picked, by)


def throughput(mean_ms: Column, batch: int) -> Column:
    return F.try_divide(F.lit(float(batch)), mean_ms / 1000.0)


def winner(df: DataFrame, name: str, value: str) -> DataFrame:
    """One row: the best, the second, and by how many per cent the best leads. ``df`` has a row per contender."""
    best = df.agg(F.max(F.struct(value, name)).alias("b"))
    second = df.crossJoin(F.broadcast(best)).where(F.col(name) != F.col("b")[name]).groupBy("b").agg(F.max(F.struct(value, name)).alias("s"))
    return second.select(F.col("b")[name].alias("winner"), F.col("s")[name].alias("second"), (F.try_divide(F.col("b")[value], F.col("s")[value]) * 100 - 100).alias("margin_pct"))


def steps_per_epoch(n: Column, batch: int, world_size: int) -> Column:
    return F.floor(n / F.lit(batch * world_size))


def utilisation(used: Column, budget: Column, warn: float = 0.9) -> tuple[Column, Column]:
    """(share used, whether it warns); 0 for no budget."""
    share = F.when(budget > 0, F.try_divide(used, budget)).otherwise(F.lit(0.0))
    return share, share >= warn


def trace_events(df: DataFrame, name: Column, category: Column, start_us: Column, duration_us: Column, pid: Column, tid: Column, *keep: str) -> DataFrame:
    """Complete events of the Chrome trace format, as JSON lines."""
    return df.select(*keep, F.to_json(F.struct(name.alias("name"), category.alias("cat"), F.lit("X").alias("ph"), start_us.alias("ts"), duration_us.alias("dur"), pid.alias("pid"), tid.alias("tid"))).alias("event"))
