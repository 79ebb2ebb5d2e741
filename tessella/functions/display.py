"""Columns for people: byte counts and progress bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]


def format_bytes(n: Column) -> Column:
    """Two decimals and a unit, by powers of 1024; PB at most."""
    out = None
    for power, unit in reversed(list(enumerate(UNITS))):
        text = F.concat(F.format_string("%.2f", n.cast("double") / F.lit(1024.0**power)), F.lit(f" {unit}"))
        out = text if out is None else F.when(F.abs(n) < 1024.0 ** (power + 1), text).otherwise(out)
    return out


def progress_bar(value: Column, total: Column, width: int = 24) -> Column:
    """``width`` characters, filled in proportion; empty for no positive total."""
    share = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value, total)))).otherwise(F.lit(0.0))
    filled = F.floor(share * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled))
