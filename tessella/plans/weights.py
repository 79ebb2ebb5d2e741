"""The mixing vector: immutable, normalised, with the draw interval of each dataset."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class MixingWeights:
    """Names in order with weights that sum to 1."""

    names: tuple[str, ...]
    weights: tuple[float, ...]

    @classmethod
    def of(cls, names, raw) -> MixingWeights:
        names, raw = tuple(names), [float(w) for w in raw]
        if len(names) != len(raw):
            raise ValueError(f"{len(names)} names but {len(raw)} weights")
        if len(set(names)) != len(names):
            raise ValueError("names must differ")
        if any(w < 0 for w in raw) or sum(raw) <= 0:
            raise ValueError("weights must not be negative and must have a positive sum")
        total = sum(raw)
        return cls(names, tuple(w / total for w in raw))

    def replaced(self, raw) -> MixingWeights:
        """Another whole vector."""
        return self.of(self.names, raw)

    def with_weight(self, name: str, weight: float) -> MixingWeights:
        """One entry of the normalised vector replaced; then all are normalised again."""
        if name not in self.names:
            raise KeyError(name)
        return self.of(self.names, [weight if n == name else w for n, w in zip(self.names, self.weights)])

    def intervals(self) -> list[tuple[float, float]]:
        """[lo, hi) per dataset; the last one that has weight ends at exactly 1."""
        ends = list(accumulate(self.weights))
        last = max(i for i, w in enumerate(self.weights) if w > 0)
        ends = [1.0 if i >= last else e for i, e in enumerate(ends)]
        return list(zip([0.0, *ends[:-1]], ends))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, n, w, lo, hi) for i, (n, w, (lo, hi)) in enumerate(zip(self.names, self.weights, self.intervals()))]
        return spark.createDataFrame(rows, "ds_idx int, name string, weight double, lo double, hi double")
