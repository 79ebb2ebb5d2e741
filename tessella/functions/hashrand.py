"""Deterministic randomness: uniforms from a hash of a seed text and a row's identity.

Results depend neither on partitioning nor on retries, and :func:`uniform_sql` gives the same numbers in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 13 hexadecimal digits: 52 bits, which a double holds exactly.
DIGITS, SCALE = 13, 4503599627370496.0


def seed_text(stream: str, seed: int = 0, rank: int = 0, epoch: int = 0) -> str:
    """Name of one random stream; stands where a numeric seed per rank and epoch would."""
    return f"{stream}:{seed}:{rank}:{epoch}"


def uniform(seed: str, *ids: Column | str) -> Column:
    """A uniform double in [0, 1) of the seed and the ids' texts."""
    parts = [F.lit(seed)]
    for i in ids:
        parts += [F.lit(":"), (F.col(i) if isinstance(i, str) else i).cast("string")]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, DIGITS), 16, 10).cast("double") / F.lit(SCALE)


def uniform_sql(seed: str, *ids: str) -> str:
    """The same in DuckDB's SQL."""
    parts = ", ".join([f"'{seed}'", *(x for i in ids for x in ("':'", f"CAST({i} AS VARCHAR)"))])
    return f"(('0x' || substr(md5(concat({parts})), 1, {DIGITS}))::BIGINT::DOUBLE / {SCALE:.0f}::DOUBLE)"
