"""Pixel operations in numpy, and their one pass over Arrow batches.

All random choices come as columns (see :mod:`tessella.operators.views`), so pixels are a function of their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessella.shipping import ship
from tessella.sources.images import decode_image

LUMA = np.array([0.299, 0.587, 0.114])
VIEW_SCHEMA = "c int, h int, w int, data array<float>"


def _kernel(x: np.ndarray, kind: str) -> np.ndarray:
    x = np.abs(x)
    if kind == "bilinear":
        return np.clip(1 - x, 0, None)
    a = -0.5
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0))


def resampling(size: int, start: float, length: float, out: int, kind: str = "bicubic") -> np.ndarray:
    """(out, size) weights that bring ``length`` samples from ``start`` to ``out``, smoothed when shrinking."""
    scale = length / out
    centre = start + (np.arange(out) + 0.5) * scale - 0.5
    weights = _kernel((np.arange(size)[None, :] - centre[:, None]) / max(1.0, scale), kind)
    inside = (np.arange(size) >= np.floor(start)) & (np.arange(size) < np.ceil(start + length))
    weights = weights * inside
    return weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-12)


def crop_resize(img: np.ndarray, top: float, left: float, h: float, w: float, out_h: int, out_w: int, kind: str = "bicubic") -> np.ndarray:
    rows = resampling(img.shape[0], top, h, out_h, kind)
    cols = resampling(img.shape[1], left, w, out_w, kind)
    tall = (rows @ img.reshape(img.shape[0], -1).astype(float)).reshape(out_h, img.shape[1], img.shape[2])
    return np.clip(cols @ tall, 0, 255)


def gray(img: np.ndarray) -> np.ndarray:
    return np.repeat((img @ LUMA)[:, :, None], 3, axis=2)


def jitter(img: np.ndarray, brightness: float, contrast: float, saturation: float, hue: float) -> np.ndarray:
    img = np.clip(img * brightness, 0, 255)
    mean = float((img @ LUMA).mean())
    img = np.clip(mean + (img - mean) * contrast, 0, 255)
    flat = gray(img)
    img = np.clip(flat + (img - flat) * saturation, 0, 255)
    if hue:
        turn = 2 * np.pi * hue
        to = np.array([[0.299, 0.587, 0.114], [0.596, -0.274, -0.322], [0.211, -0.523, 0.312]])
        spin = np.array([[1, 0, 0], [0, np.cos(turn), -np.sin(turn)], [0, np.sin(turn), np.cos(turn)]])
        img = np.clip(img @ (np.linalg.inv(to) @ spin @ to).T, 0, 255)
    return img


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    size = max(3, int(sigma * 4 + 1) | 1)
    x = np.arange(size) - size // 2
    k = np.exp(-(x**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(size // 2, size // 2) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(img, pad, mode="reflect" if img.shape[axis] > size // 2 else "edge")
        img = sum(k[i] * np.take(wide, np.arange(i, i + img.shape[axis]), axis=axis) for i in range(size))
    return img


def solarized(img: np.ndarray, threshold: float = 128) -> np.ndarray:
    return np.where(img >= threshold, 255 - img, img)


def to_tensor(img: np.ndarray, mean, std, dtype: str = "fp32") -> np.ndarray:
    """Channels first, (x / 255 - mean) / std; bf16 is rounded to that type's 8 bits of precision, kept as float."""
    out = ((img / 255.0 - np.asarray(mean)) / np.asarray(std)).transpose(2, 0, 1).astype(np.float32)
    if dtype == "bf16":
        bits = out.view(np.uint32)
        out = ((bits + 0x7FFF + (bits >> 16 & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    return out


def augmented(img: np.ndarray, p, mean, std, dtype: str = "fp32") -> np.ndarray:
    """One view by the parameters of row ``p``."""
    out = crop_resize(img, p.top, p.left, p.crop_h, p.crop_w, p.size, p.size)
    if p.flip:
        out = out[:, ::-1]
    if p.jitter:
        out = jitter(out, p.brightness, p.contrast, p.saturation, p.hue)
    if p.gray:
        out = gray(out)
    if p.blur:
        out = blurred(out, p.sigma)
    if p.solarize:
        out = solarized(out)
    return to_tensor(out, mean, std, dtype)


def centred(img: np.ndarray, resize_to: int, crop: int, mean, std, kind: str = "bicubic", dtype: str = "fp32") -> np.ndarray:
    """Shorter side to ``resize_to``, then the central square."""
    h, w = img.shape[:2]
    nh, nw = h * resize_to // min(h, w), w * resize_to // min(h, w)
    out = crop_resize(img, 0, 0, h, w, nh, nw, kind)
    top, left = max(0, (nh - crop) // 2), max(0, (nw - crop) // 2)
    out = out[top : top + crop, left : left + crop]
    return to_tensor(out, mean, std, dtype)


def _fields(t: np.ndarray) -> tuple:
    return (*t.shape, t.ravel())


def map_views(df: DataFrame, keep: list[str], image_col: str, one: Callable) -> DataFrame:
    """(keep..., c, h, w, data): ``one(image or None, row)`` gives each row's (C, H, W) array."""
    ship(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [_fields(one(decode_image(x), r)) for x, r in zip(f[image_col], f.drop(columns=image_col).itertuples(index=False))]
            out = f[keep].reset_index(drop=True)
            for k, name in enumerate(("c", "h", "w", "data")):
                out[name] = [x[k] for x in found]
            yield out

    return df.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), VIEW_SCHEMA]))


def augment_views(fanned: DataFrame, keep: list[str], mean, std, image_col: str = "image", dtype: str = "fp32") -> DataFrame:
    """Views of a fanned-out table with parameters; what can't be decoded becomes zeros."""

    def one(img, p):
        return augmented(img, p, mean, std, dtype) if img is not None else np.zeros((3, p.size, p.size), np.float32)

    return map_views(fanned, keep, image_col, one)


def crop_box(height: int, width: int, p, ratio: tuple[float, float] = (3 / 4, 4 / 3)) -> tuple[int, int, int, int]:
    """(top, left, height, width) of a crop from its uniforms: an area share and a log-uniform aspect, cut to the image."""
    area = width * height * (p.scale_lo + p.area * (p.scale_hi - p.scale_lo))
    aspect = np.exp(np.log(ratio[0]) + p.aspect * np.log(ratio[1] / ratio[0]))
    w, h = max(1, min(width, int(np.sqrt(area * aspect) + 0.5))), max(1, min(height, int(np.sqrt(area / aspect) + 0.5)))
    return int(p.y * (height - h + 1)), int(p.x * (width - w + 1)), h, w


VIEWS_SCHEMA = "array<struct<name:string,c:int,h:int,w:int,data:array<float>>>"


def sample_views(samples: DataFrame, keep: list[str], make: Callable, image_col: str = "image", most: int = 16) -> DataFrame:
    """(keep..., views): ``make(image or None, row)`` gives a sample's views as (name, (C, H, W) array) in order.

    An image is decoded once, whatever the number of views; ``most`` samples' views are held at a time.
    """
    ship(samples.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), most):
                part = f.iloc[at : at + most]
                found = [[{"name": n, "c": t.shape[0], "h": t.shape[1], "w": t.shape[2], "data": t.ravel()} for n, t in make(decode_image(x), r)] for x, r in zip(part[image_col], part.drop(columns=image_col).itertuples(index=False))]
                yield part[keep].assign(views=found)

    return samples.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"views {VIEWS_SCHEMA}"]))


def eval_views(samples: DataFrame, keep: list[str], spec, image_col: str = "image", dtype: str = "fp32") -> DataFrame:
    """The deterministic view of each sample."""

    def one(img, _):
        return centred(img, spec.resize_to, spec.crop_size, spec.mean, spec.std, spec.interpolation, dtype) if img is not None else np.zeros((3, spec.crop_size, spec.crop_size), np.float32)

    return map_views(samples, keep, image_col, one)


def user_views(samples: DataFrame, key: str, spec, image_col: str = "image") -> DataFrame:
    """(key, name, c, h, w, data): the user's function on normalised (B, C, H, W) arrays; every declared view must come."""
    ship(samples.sparkSession)
    kind = samples.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            black = np.zeros((spec.decode_size, spec.decode_size, 3), np.uint8)
            images = [img if (img := decode_image(x)) is not None else black for x in f[image_col]]
            batch = np.stack([centred(i, spec.decode_size, spec.decode_size, spec.mean, spec.std) for i in images])
            views = spec.fn(batch)
            if missing := [v for v in spec.views if v not in views]:
                raise ValueError(f"views {missing} are missing")
            for name in spec.views:
                found = [_fields(np.asarray(t, np.float32)) for t in views[name]]
                yield pd.DataFrame({key: f[key].to_numpy(), "name": name} | {n: [x[k] for x in found] for k, n in enumerate(("c", "h", "w", "data"))})

    return samples.select(key, image_col).mapInPandas(run, f"`{key}` {kind}, name string, {VIEW_SCHEMA}")
