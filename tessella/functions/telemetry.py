"""Counters, gauges and stage times of one consumer: accumulators, so that tasks on executors may count too."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

COUNTERS = ("read_ms", "read_bytes", "wait_ms", "yield_ms", "queue_depth", "transfer_ms", "batches", "network_stall_ms", "consumer_stall_ms")
GAUGES = ("utilisation",)
#: The counter that each stage's time goes to.
STAGE_COUNTERS = {"read": "read_ms", "wait": "wait_ms", "pipeline": "yield_ms", "transfer": "transfer_ms", "quantise": "yield_ms", "network": "network_stall_ms", "consumers": "consumer_stall_ms"}


class MetricsSink:
    """``inc`` counts (anywhere), ``set_float`` sets a gauge and ``heartbeat`` stamps the time (on the driver)."""

    def __init__(self, spark: SparkSession, rank: int = 0, clock: Callable[[], float] = time.time):
        self.spark, self.rank, self._clock = spark, rank, clock
        self._counts = {c: spark.sparkContext.accumulator(0) for c in COUNTERS}
        self._gauges = dict.fromkeys(GAUGES, 0.0)
        self._beat = 0

    def inc(self, name: str, by: int = 1) -> None:
        if name not in self._counts:
            raise TypeError(f"{name} is no counter")
        self._counts[name].add(int(by))

    def set_float(self, name: str, value: float) -> None:
        if name not in self._gauges:
            raise TypeError(f"{name} is no gauge")
        self._gauges[name] = float(value)

    def heartbeat(self) -> None:
        self._beat = int(self._clock())

    def counting(self, name: str, df: DataFrame) -> DataFrame:
        """``df``, whose rows are counted when they are read (again if a task is repeated)."""
        if name not in self._counts:
            raise TypeError(f"{name} is no counter")
        counter = self._counts[name]

        def run(batches):
            for b in batches:
                counter.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    def row(self) -> dict:
        return {"rank": self.rank} | {c: a.value for c, a in self._counts.items()} | self._gauges | {"heartbeat": self._beat}

    def table(self) -> DataFrame:
        """One row: append it to a table of metrics, which the queries over such tables read."""
        row = self.row()
        kinds = ["rank int", *(f"{c} long" for c in COUNTERS), *(f"{g} double" for g in GAUGES), "heartbeat long"]
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(kinds))


@dataclass
class StageTimer:
    """Times one stage: as a context, or by ``start`` and ``stop``. Adds to the stage's counter and to ``spans``."""

    name: str
    sink: MetricsSink | None = None
    spans: list[tuple[str, int, int]] = field(default_factory=list)
    clock: Callable[[], int] = time.perf_counter_ns
    _began: int | None = None

    def start(self) -> StageTimer:
        self._began = self.clock()
        return self

    def stop(self) -> int:
        """Milliseconds since the start; 0 with a warning where none was."""
        if self._began is None:
            log.warning("stage %s was not started", self.name)
            return 0
        took = self.clock() - self._began
        self.spans.append((self.name, self._began // 1000, took // 1000))
        self._began = None
        if self.sink and self.name in STAGE_COUNTERS:
            self.sink.inc(STAGE_COUNTERS[self.name], took // 1_000_000)
        return took // 1_000_000

    def __enter__(self) -> StageTimer:
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()


def span_table(spark: SparkSession, spans: list[tuple[str, int, int]]) -> DataFrame:
    """(name, start_us, duration_us), for :func:`tessella.operators.stats.trace_events`."""
    return spark.createDataFrame(spans, "name string, start_us long, duration_us long")
