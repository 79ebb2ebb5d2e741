"""Row numbers over whole tables without a single-partition window.

Rows are dealt into ordered buckets of about equal size, whose bounds are quantiles of the sort key; each bucket is
numbered on its own, and the running sum of the buckets' sizes (a table of one row per group and bucket) is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: About so many rows are put in order by one task, as long as this takes at most MOST buckets.
ROWS, MOST = 1 << 18, 4096


def numbered(df: DataFrame, name: str, order: list[Column], key: Column, by: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """``df`` with ``name``: the 1-based number in ``order`` within ``by``. ``key``: a number that does not decrease along ``order``.

    Counts the rows, and beyond ``rows`` of them estimates quantiles of the key (a sketch of fixed size). Numbers are
    exact whatever the quantiles; only the balance of the buckets depends on them. Rows of one key share a bucket.
    """
    by = by or []
    n = df.count()
    if n <= rows:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    dealt = df.withColumn("_bucket", bucket_of(key.cast("double"), quantiles(df, key, min(MOST, math.ceil(n / rows)))))
    sizes = dealt.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return dealt.withColumn("_inner", inner).join(offsets, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inner")).drop("_bucket", "_inner", "_before")


def quantiles(df: DataFrame, key: Column, parts: int) -> list[float]:
    """The inner bounds of ``parts`` buckets of about equal size; fewer where many rows share a key."""
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key.cast("double"), shares, 10 * parts).alias("q")).first()["q"] if shares else []
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list[float]) -> Column:
    """How many bounds the key reaches, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    table = lambda values: F.array(*[F.lit(float(v)) for v in values])
    reached = lambda values: F.size(F.filter(values, lambda b: b <= key))
    rows = F.array(*[table(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    row = reached(table(bounds[::step]))  # 0: below the first bound
    return F.when(row == 0, F.lit(0)).otherwise((row - 1) * step + reached(F.get(rows, row - 1)))
