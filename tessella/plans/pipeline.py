"""Lazy, immutable composition of batch pipelines, and the loader that plans them.

A plan is a pure function of configuration, weights and epoch: results don't depend on partitioning, and resuming after
a step is exact.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashrand import seed_text, uniform
from tessella.operators.batching import resume_after, with_batch
from tessella.operators.dispatch import build_views, spec_stats
from tessella.operators.masking import BlockMasks, with_masks
from tessella.operators.mixing import draws, mix_cyclic, pool_sizes, require_pools
from tessella.operators.norm import norm_table
from tessella.operators.numbering import numbered
from tessella.operators.predicates import quality_keeps, sidecar_score
from tessella.operators.sampling import block_shuffled, race_time
from tessella.operators.views import split_views
from tessella.plans.environment import Consumer, allows_empty_epochs
from tessella.plans.specs import AugSpec, DatasetSpec, LoaderConfig, LoaderState, MultiCropSpec
from tessella.plans.weights import MixingWeights
from tessella.sources.checkpoint import Checkpointer, audit_keys

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Pipeline:
    """Batches with the steps applied to them. ``with_epoch`` acts last wherever it stands, and its last call wins."""

    base: DataFrame
    steps: tuple[tuple[str, str, object], ...] = ()
    max_steps: int | None = None
    length: int | None = None
    loader: SampleLoader | None = None

    def state(self) -> dict:
        """The loader's state and the number of steps: with the plan, all that a resumed run needs."""
        return {"loader": self.loader.state().to_dict() if self.loader else None, "max_steps": self.max_steps}

    def with_state(self, state: dict) -> Pipeline:
        """This pipeline's steps on the epoch that a state describes."""
        base = self
        if self.loader and state.get("loader"):
            self.loader.load_state(LoaderState.from_dict(state["loader"]))
            base = replace(self.loader.pipeline(), steps=self.steps)
        return replace(base, max_steps=state["max_steps"]) if "max_steps" in state else base

    def map(self, fn: Callable[[DataFrame], DataFrame], label: str = "map") -> Pipeline:
        return replace(self, steps=(*self.steps, ("map", label, fn)))

    def select(self, predicate: Column, label: str = "select") -> Pipeline:
        return replace(self, steps=(*self.steps, ("select", label, predicate)))

    def with_epoch(self, n: int) -> Pipeline:
        return replace(self, max_steps=n)

    def __len__(self) -> int:
        if self.max_steps is not None:
            return self.max_steps
        if self.length is None:
            raise TypeError("the pipeline has no known length")
        return self.length

    def dataframe(self) -> DataFrame:
        out = self.base
        for kind, _, step in self.steps:
            out = step(out) if kind == "map" else out.where(F.coalesce(step, F.lit(False)))
        if self.max_steps is not None:
            # The n-th batch that is left: batch ids are few beside samples, so their list is small.
            ids = numbered(out.select("batch_id").distinct(), "_nth", [F.col("batch_id")], F.col("batch_id"))
            out = out.join(ids.where(F.col("_nth") <= self.max_steps).select("batch_id"), "batch_id", "left_semi")
        return out

    def skipped(self) -> DataFrame:
        """(label, n_kept, n_skipped) of each select step."""
        out, found = self.base, None
        for kind, label, step in self.steps:
            if kind == "map":
                out = step(out)
                continue
            keep = F.coalesce(step, F.lit(False))
            row = out.agg(F.count_if(keep).alias("n_kept"), F.count_if(~keep).alias("n_skipped")).withColumn("label", F.lit(label))
            found = row if found is None else found.unionByName(row)
            out = out.where(keep)
        if found is None:
            raise ValueError("no select step")
        return found.select("label", "n_kept", "n_skipped")


class Batches:
    """One iteration over a loader's epoch; it frees the loader at its end, by :meth:`close`, or when it is dropped."""

    def __init__(self, loader: SampleLoader):
        self._loader, self._found = loader, None

    def __iter__(self) -> Batches:
        return self

    def __next__(self) -> list:
        if self._loader is None:
            raise StopIteration
        try:
            if self._found is None:
                rows = self._loader.pipeline().dataframe().orderBy("batch_id", "slot").toLocalIterator(prefetchPartitions=True)
                self._found = groupby(rows, key=lambda r: r["batch_id"])
            return list(next(self._found)[1])
        except BaseException:
            self.close()
            raise

    def close(self) -> None:
        if self._loader is not None:
            self._loader._iterating, self._loader = False, None

    def __del__(self) -> None:
        self.close()


@dataclass
class SampleLoader:
    """Plans epochs over ``samples``: columns ds_idx, key, meta and any payload, e.g. from a tar or Parquet source.

    ``shard_idx`` is needed for several consumers, and for datasets that are read in sequence or by shard scores; ``image``
    for :meth:`batches`. Rank and world size come from the environment where they are not given. ``drop_empty``: a
    dataset without samples is left out and the other weights are normalised, instead of an error.
    """

    spark: SparkSession
    samples: DataFrame
    specs: list[DatasetSpec]
    batch_size: int
    config: LoaderConfig = field(default_factory=LoaderConfig)
    aug: AugSpec = field(default_factory=MultiCropSpec)
    predicate: Column | None = None
    rank: int | None = None
    world_size: int | None = None
    steps_per_epoch: int | None = None
    drop_empty: bool = False

    def __post_init__(self):
        found = Consumer.inferred()
        self.rank = found.rank if self.rank is None else self.rank
        self.world_size = found.world_size if self.world_size is None else self.world_size
        if self.batch_size < 1 or not 0 <= self.rank < self.world_size:
            raise ValueError("a positive batch size and a rank below the world size")
        self.weights = MixingWeights.of([s.name for s in self.specs], [s.weight for s in self.specs])
        self.epoch, self.step = 0, None  # the last step that was done in this epoch
        self._iterating = False
        config = getattr(self.aug, "config", None)
        self.resolution = (config.global_crop_size, config.local_crop_size) if config else (0, 0)
        self.checkpointer = Checkpointer(self.spark, self.config.checkpoint_dir, self.config.checkpoint_every_steps, self.rank) if self.config.stateful else None

    def set_epoch(self, epoch: int) -> None:
        """Another epoch starts at its first batch, in the resolution that the schedule has for it."""
        if epoch != self.epoch:
            self.step = None
        self.epoch = epoch
        if isinstance(self.aug, MultiCropSpec):
            self.set_resolution(self.aug.config.crop_size_at_epoch(epoch), self.resolution[1])

    def set_weights(self, weights) -> None:
        self.weights = self.weights.replaced(weights)

    def set_weight_by_name(self, name: str, weight: float) -> None:
        self.weights = self.weights.with_weight(name, weight)

    def set_resolution(self, global_size: int, local_size: int) -> None:
        if not isinstance(self.aug, MultiCropSpec):
            log.warning("a resolution has no effect on %s", type(self.aug).__name__)
        elif global_size > self.aug.config.max_global_crop_size or local_size > self.aug.config.max_local_crop_size:
            raise ValueError("larger than the maximum of the configuration")
        self.resolution = (global_size, local_size)

    def pool(self) -> DataFrame:
        """This rank's samples that pass the filters, numbered in this epoch's order: ds_idx, k, key, meta, ...

        Each dataset's order is that of its ``shard_sampling``: ``sequential`` by shard and key; ``epoch`` and ``shuffle``
        permuted, heavier shards earlier where there are scores (``shuffle`` within blocks of ``shuffle_buffer_size``);
        ``resampled`` drawn with replacement, as many as there are.
        """
        kept = self.samples
        if self.world_size > 1:
            kept = kept.where(F.pmod(F.col("shard_idx"), F.lit(self.world_size)) == self.rank)
        bar = F.lit(None).cast("double")
        for i, s in enumerate(self.specs):
            if s.min_sample_quality is not None:
                bar = F.when(F.col("ds_idx") == i, F.lit(float(s.min_sample_quality))).otherwise(bar)
        kept = kept.where(bar.isNull() | quality_keeps(sidecar_score(), bar))
        if self.predicate is not None:
            kept = kept.where(self.predicate)
        u = uniform(self._seed("pool"), "ds_idx", "key")
        place = u
        for i, s in enumerate(self.specs):
            mine = F.col("ds_idx") == i
            if s.shard_sampling == "sequential":
                place = F.when(mine, F.col("shard_idx").cast("double")).otherwise(place)
            elif s.shard_quality_scores is not None:
                score = F.get(F.array(*[F.lit(float(x)) for x in s.shard_quality_scores]), F.col("shard_idx").cast("int"))
                place = F.when(mine, race_time(score, u)).otherwise(place)
        out = numbered(kept.withColumn("_u", place), "k", [F.col("_u"), F.col("key")], F.col("_u"), ["ds_idx"]).drop("_u")
        shuffled = [i for i, s in enumerate(self.specs) if s.shard_sampling == "shuffle" and self.config.shuffle_buffer_size > 1]
        if shuffled:
            rest = out.where(~F.col("ds_idx").isin(shuffled))
            mixed = block_shuffled(out.where(F.col("ds_idx").isin(shuffled)), self._seed("buffer"), "k", self.config.shuffle_buffer_size, ["ds_idx"], "_pos")
            out = rest.unionByName(mixed.withColumn("k", F.col("_pos")).drop("_pos"))
        drawn = [i for i, s in enumerate(self.specs) if s.shard_sampling == "resampled"]
        if drawn:
            taken = out.where(F.col("ds_idx").isin(drawn))
            sizes = taken.groupBy("ds_idx").agg(F.count(F.lit(1)).alias("_n"))  # one row per dataset
            turns = taken.select("ds_idx", F.col("k").alias("_t")).join(F.broadcast(sizes), "ds_idx")
            turns = turns.select("ds_idx", "_t", (F.floor(uniform(self._seed("resample"), "ds_idx", "_t") * F.col("_n")) + 1).alias("k"))
            out = out.where(~F.col("ds_idx").isin(drawn)).unionByName(turns.join(taken, ["ds_idx", "k"]).withColumn("k", F.col("_t")).select(out.columns))
        return out

    def _seed(self, stream: str) -> str:
        return seed_text(stream, self.config.seed, self.rank, self.epoch)

    def pipeline(self) -> Pipeline:
        """The epoch as a pipeline of rows with batch_id and slot; the last, incomplete batch is left out.

        An epoch without any batch raises, unless ``stall_timeout_s`` is 0 or the environment allows it.
        """
        pool = self.pool()
        sizes = {r["ds_idx"]: r["n"] for r in pool_sizes(pool).collect()}  # one row per dataset
        weights = self.weights
        if self.drop_empty and sizes:
            weights = weights.replaced([w if i in sizes else 0.0 for i, w in enumerate(weights.weights)])
        elif sizes:
            require_pools(sizes, weights)
        n = (self.steps_per_epoch or sum(sizes.values()) // self.batch_size) * self.batch_size if sizes else 0
        if not n and self.config.stall_timeout_s > 0 and not allows_empty_epochs():
            raise RuntimeError(f"rank {self.rank} has no batch: no sample passed the filters, or fewer than a batch did")
        plan = draws(self.spark, n, weights, self._seed("mix"))
        rows = with_batch(mix_cyclic(plan, pool), "t", self.batch_size)
        if self.step is not None:
            rows = resume_after(rows, self.step)
        if self.config.debug_log_keys:
            audit_keys(rows, "key", self.config.debug_log_keys)
        done = 0 if self.step is None else self.step + 1
        return Pipeline(rows, length=max(0, n // self.batch_size - done), loader=self)

    def batches(self, masks: BlockMasks | None = None) -> DataFrame:
        """The epoch's samples with their views: batch_id, slot, ds_idx, key, meta, first, rest, mask.

        Views are built by the type of ``aug`` and split into the first (global) and the rest (local). One mask per batch,
        attached to its samples, where the specification supports masks; else null.
        """
        rows = self.pipeline().dataframe()
        keep = ["batch_id", "slot", "ds_idx", "key", "meta"]
        made = build_views(rows.select(*keep, "image"), keep, self.aug, norm_table(self.spark, self.specs, spec_stats(self.aug)), self.resolution, self._seed("views"), self.config.output_dtype)
        first, rest = split_views(F.col("views"), self.aug.n_first)
        out = made.select(*keep, first.alias("first"), rest.alias("rest"))
        if masks is None or not self.aug.supports_masking:
            return out.withColumn("mask", F.lit(None).cast("array<boolean>"))
        if self.aug.n_first < 1:
            raise ValueError("masks need a first view")
        return out.join(with_masks(rows.select("batch_id"), "batch_id", masks, self._seed("masks")), "batch_id")

    def __iter__(self) -> Iterator[list]:
        """The epoch's batches in order, each a list of rows; at most one iteration at a time."""
        if self._iterating:
            raise RuntimeError("the loader is being iterated already")
        self._iterating = True
        return Batches(self)

    def state(self) -> LoaderState:
        return LoaderState(-1 if self.step is None else self.step, self.epoch, list(self.weights.names), list(self.weights.weights), *self.resolution)

    def checkpoint(self, step: int) -> str | None:
        self.step = step
        return self.checkpointer.save(self.state()) if self.checkpointer else None

    def load_state(self, state: LoaderState) -> None:
        """Epoch, step (-1: none) and resolution always; weights only if the datasets are the same, else with a warning."""
        self.epoch, self.step = state.epoch, state.step if state.step >= 0 else None
        self.resolution = (state.global_crop_size, state.local_crop_size)
        if state.dataset_names and list(self.weights.names) != list(state.dataset_names):
            log.warning("datasets %s of the state are not %s: weights are not restored", state.dataset_names, list(self.weights.names))
        elif state.mixing_weights:
            self.weights = self.weights.replaced(state.mixing_weights)

    def resume(self) -> bool:
        state = self.checkpointer.load() if self.checkpointer else None
        if state:
            self.load_state(state)
        return state is not None
