"""View fan-out: each sample times the views of an augmentation, with hash-drawn parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.hashrand import uniform
from tessella.plans.specs import ContextTargetsSpec, MultiCropConfig

VIEW_SCHEMA = "view int, name string, kind string, size int, scale_lo double, scale_hi double, blur_p double, solarize_p double"


def view_rows(config: MultiCropConfig, global_size: int | None = None, local_size: int | None = None) -> list[tuple]:
    """One row of ``VIEW_SCHEMA`` per view. Solarisation belongs to the second global view, if there is one."""
    g, n = config.n_global_crops, config.n_views
    rows = []
    for i in range(n):
        is_global = i < g
        lo, hi = config.global_crops_scale if is_global else config.local_crops_scale
        blur = (config.blur_prob_global1 if i == 0 else config.blur_prob_global2) if is_global else config.blur_prob_local
        size = (global_size or config.global_crop_size) if is_global else (local_size or config.local_crop_size)
        rows.append((i, f"view_{i}", "global" if is_global else "local", size, float(lo), float(hi), float(blur), float(config.solarize_prob if is_global and i == 1 else 0.0)))
    return rows


def context_rows(spec: ContextTargetsSpec) -> list[tuple]:
    """The context first, then the targets; neither blurred nor solarised."""
    first = (0, "context", "global", spec.context_crop_size, *map(float, spec.context_scale), 0.0, 0.0)
    return [first, *((i, n, "local", spec.target_crop_size, *map(float, spec.target_scale), 0.0, 0.0) for i, n in enumerate(spec.view_names()[1:], 1))]


def view_table(spark: SparkSession, config: MultiCropConfig, global_size: int | None = None, local_size: int | None = None) -> DataFrame:
    return spark.createDataFrame(view_rows(config, global_size, local_size), VIEW_SCHEMA)


def fan_out(samples: DataFrame, views: DataFrame) -> DataFrame:
    """Samples times views. The views are a constant table of a configuration, some ten rows."""
    return samples.crossJoin(F.broadcast(views))


def split_views(views: Column, n_first: Column | int) -> tuple[Column, Column]:
    """(the first n, the rest) of an array of views."""
    n = F.lit(n_first) if isinstance(n_first, int) else n_first
    return F.slice(views, F.lit(1), n), F.slice(views, n + 1, F.greatest(F.size(views), F.lit(1)))


def size_at_epoch(epoch: Column, schedule: list[tuple[int, int]], base: int) -> Column:
    """As-of lookup in a resolution schedule: the last entry whose epoch is not later."""
    out = F.lit(base)
    for start, size in sorted(schedule):
        out = F.when(epoch >= start, F.lit(size)).otherwise(out)
    return out


def resized(width: Column, height: Column, shorter: int) -> tuple[Column, Column]:
    """Width and height after the shorter side is brought to ``shorter``."""
    least = F.least(width, height)
    return F.floor(width * F.lit(shorter) / least).cast("int"), F.floor(height * F.lit(shorter) / least).cast("int")


def view_parameters(table: list[tuple], config: MultiCropConfig, seed: str, *ids: Column | str) -> Column:
    """All views of a row as an array of structs: name, size, and what :func:`random_crop` and :func:`with_parameters` draw.

    ``table``: rows of ``VIEW_SCHEMA``. The crop is left as its four uniforms, as it depends on the decoded size.
    """
    found = []
    for view, name, _, size, lo, hi, blur_p, solarize_p in table:
        u = lambda x: uniform(f"{seed}:{x}", *ids, F.lit(view))  # noqa: E731, B023
        span = lambda x, amount: 1.0 - amount + u(x) * (2 * amount)  # noqa: E731, B023
        fields = {
            "name": F.lit(name), "size": F.lit(size), "scale_lo": F.lit(lo), "scale_hi": F.lit(hi), "area": u("area"), "aspect": u("aspect"), "x": u("x"), "y": u("y"),
            "flip": u("flip") < config.flip_prob, "jitter": u("jitter") < config.color_jitter_prob, "brightness": span("brightness", config.brightness),
            "contrast": span("contrast", config.contrast), "saturation": span("saturation", config.saturation), "hue": (u("hue") * 2 - 1) * config.hue,
            "gray": u("gray") < config.grayscale_prob, "blur": u("blur") < blur_p, "sigma": config.blur_sigma_min + u("sigma") * (config.blur_sigma_max - config.blur_sigma_min),
            "solarize": u("solarize") < solarize_p,
        }
        found.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    return F.array(*found)


def random_crop(df: DataFrame, width: str, height: str, seed: str, *ids: str, lo: str = "scale_lo", hi: str = "scale_hi", ratio: tuple[float, float] = (3 / 4, 4 / 3)) -> DataFrame:
    """Adds crop_w, crop_h, left, top: an area share and a log-uniform aspect, cut to the image."""
    log_lo, log_hi = math.log(ratio[0]), math.log(ratio[1])
    u = {x: uniform(f"{seed}:{x}", *ids) for x in ("area", "aspect", "x", "y")}
    area = F.col(width) * F.col(height) * (F.col(lo) + u["area"] * (F.col(hi) - F.col(lo)))
    aspect = F.exp(F.lit(log_lo) + u["aspect"] * F.lit(log_hi - log_lo))
    sized = df.withColumn("crop_w", F.greatest(F.lit(1), F.least(F.col(width), F.round(F.sqrt(area * aspect)).cast("int")))).withColumn("crop_h", F.greatest(F.lit(1), F.least(F.col(height), F.round(F.sqrt(area / aspect)).cast("int"))))
    return sized.withColumn("left", F.floor(u["x"] * (F.col(width) - F.col("crop_w") + 1)).cast("int")).withColumn("top", F.floor(u["y"] * (F.col(height) - F.col("crop_h") + 1)).cast("int"))


def with_parameters(fanned: DataFrame, config: MultiCropConfig, seed: str, *ids: str) -> DataFrame:
    """Adds the switches and strengths of each view: flip, jitter, grayscale, blur, solarisation."""
    u = lambda x: uniform(f"{seed}:{x}", *ids)
    span = lambda x, amount: 1.0 - amount + u(x) * (2 * amount)
    return (
        fanned.withColumn("flip", u("flip") < config.flip_prob)
        .withColumn("jitter", u("jitter") < config.color_jitter_prob)
        .withColumn("brightness", span("brightness", config.brightness))
        .withColumn("contrast", span("contrast", config.contrast))
        .withColumn("saturation", span("saturation", config.saturation))
        .withColumn("hue", (u("hue") * 2 - 1) * config.hue)
        .withColumn("gray", u("gray") < config.grayscale_prob)
        .withColumn("blur", u("blur") < F.col("blur_p"))
        .withColumn("sigma", config.blur_sigma_min + u("sigma") * (config.blur_sigma_max - config.blur_sigma_min))
        .withColumn("solarize", u("solarize") < F.col("solarize_p"))
    )
