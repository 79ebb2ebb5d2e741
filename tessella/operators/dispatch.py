"""From an augmentation's specification to the views of each sample, by the specification's type."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import pixels, views
from tessella.operators.norm import norm_lookup
from tessella.plans.specs import AugSpec, ContextTargetsSpec, EvalSpec, MultiCropConfig, MultiCropSpec, UserSpec

#: For each type of specification: (samples with mean and std, columns to keep, spec, sizes, seed, dtype) to views.
Builder = Callable[[DataFrame, list[str], AugSpec, tuple[int, int], str, str], DataFrame]
_builders: dict[type, Builder] = {}


def register_builder(kind: type, builder: Builder) -> None:
    _builders[kind] = builder


def build_views(samples: DataFrame, keep: list[str], spec: AugSpec, norm_table: DataFrame, sizes: tuple[int, int] = (0, 0), seed: str = "views", dtype: str = "fp32") -> DataFrame:
    """(keep..., views): all views of each sample, in the order of ``spec.view_names()``; undecodable images become zeros.

    ``samples`` has the columns ``keep``, ds_idx and image; each is normalised by its own dataset's statistics.
    ``sizes`` (global, local) override those of a multi-crop. A type of specification that none is registered for raises
    ``TypeError``.
    """
    builder = next((_builders[t] for t in type(spec).__mro__ if t in _builders), None)
    if builder is None:
        raise TypeError(f"no builder for {type(spec).__name__}")
    return builder(norm_lookup(samples, norm_table, spec_stats(spec)), keep, spec, sizes, seed, dtype)


def spec_stats(spec: AugSpec):
    from tessella.operators.norm import NormStats

    config = getattr(spec, "config", spec)
    return NormStats(tuple(config.mean), tuple(config.std))


def _scaled(row) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(row.mean, float) / 255, np.asarray(row.std, float) / 255


def _drawn(samples: DataFrame, keep: list[str], table: list[tuple], config: MultiCropConfig, seed: str, dtype: str, plain_from: int | None = None) -> DataFrame:
    """Randomly cropped views; those from ``plain_from`` on are cropped and nothing else."""
    params = views.view_parameters(table, config, seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keep])

    def make(img, row):
        mean, std = _scaled(row)
        for k, p in enumerate(row.params):
            p = _Fields(p)
            if img is None:
                yield p.name, np.zeros((3, p.size, p.size), np.float32)
                continue
            p.top, p.left, p.crop_h, p.crop_w = pixels.crop_box(*img.shape[:2], p)
            if plain_from is not None and k >= plain_from:
                p.flip = p.jitter = p.gray = p.blur = p.solarize = False
            yield p.name, pixels.augmented(img, p, mean, std, dtype)

    return pixels.sample_views(samples.select(*keep, "image", "mean", "std", params.alias("params")), keep, make)


class _Fields:
    """A struct's fields as attributes, whether it came as a row or as a dictionary."""

    def __init__(self, row):
        self.__dict__.update(row if isinstance(row, dict) else row.asDict())


def _multi_crop(samples, keep, spec: MultiCropSpec, sizes, seed, dtype):
    return _drawn(samples, keep, views.view_rows(spec.config, sizes[0] or None, sizes[1] or None), spec.config, seed, dtype)


def _context_targets(samples, keep, spec: ContextTargetsSpec, sizes, seed, dtype):
    config = MultiCropConfig(flip_prob=0.5, color_jitter_prob=0.8, grayscale_prob=0.0)
    return _drawn(samples, keep, views.context_rows(spec), config, seed, dtype, plain_from=1)


def _eval(samples, keep, spec: EvalSpec, sizes, seed, dtype):
    def make(img, row):
        if img is None:
            return [("view_0", np.zeros((3, spec.crop_size, spec.crop_size), np.float32))]
        return [("view_0", pixels.centred(img, spec.resize_to, spec.crop_size, *_scaled(row), spec.interpolation, dtype))]

    return pixels.sample_views(samples.select(*keep, "image", "mean", "std"), keep, make)


def _user(samples, keep, spec: UserSpec, sizes, seed, dtype):
    """The user's function on batches of one sample each."""

    def make(img, row):
        img = np.zeros((spec.decode_size, spec.decode_size, 3), np.uint8) if img is None else img
        made = spec.fn(pixels.centred(img, spec.decode_size, spec.decode_size, *_scaled(row), dtype=dtype)[None])
        if missing := [v for v in spec.views if v not in made]:
            raise ValueError(f"views {missing} are missing")
        return [(v, np.asarray(made[v], np.float32)[0]) for v in spec.views]

    return pixels.sample_views(samples.select(*keep, "image", "mean", "std"), keep, make)


for _kind, _builder in ((MultiCropSpec, _multi_crop), (ContextTargetsSpec, _context_targets), (EvalSpec, _eval), (UserSpec, _user)):
    register_builder(_kind, _builder)
