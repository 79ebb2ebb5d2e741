"""Configuration records: datasets, loading, augmentation, state. All are checked when made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields

from tessella.operators.norm import IMAGENET_MEAN, IMAGENET_STD, NormStats
from tessella.operators.sampling import MODES


def _known(cls, raw: dict) -> dict:
    """Unknown keys are ignored: older and newer files can be read."""
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in raw.items() if k in names}


def _range(lo_hi, what: str) -> None:
    lo, hi = lo_hi
    if not 0 < lo <= hi <= 1:
        raise ValueError(f"{what} must be in (0, 1] and in order")


SPEC_VERSION = 2
_migrations: dict[int, Callable[[dict], dict]] = {}


def register_spec_migration(from_version: int, fn: Callable[[dict], dict]) -> None:
    """``fn`` turns a dictionary of ``from_version`` into one of the next version."""
    _migrations[from_version] = fn


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    shards: tuple[str, ...] = ()
    weight: float = 1.0
    shard_sampling: str = "epoch"
    shard_quality_scores: tuple[float, ...] | None = None
    min_sample_quality: float | None = None
    mean: tuple[float, ...] | None = None
    std: tuple[float, ...] | None = None
    confidentialities: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    splits: tuple[str, ...] = ()
    strategies: tuple[str, ...] = ()

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, list):
                object.__setattr__(self, f.name, tuple(value))
        if not self.name:
            raise ValueError("a dataset needs a name")
        if self.weight < 0:
            raise ValueError("weight must not be negative")
        if self.shard_sampling not in MODES:
            raise ValueError(f"shard_sampling must be one of {MODES}")
        if self.shard_quality_scores is not None and (len(self.shard_quality_scores) != len(self.shards) or min(self.shard_quality_scores, default=0) < 0):
            raise ValueError("one score of at least 0 per shard")

    def to_dict(self) -> dict:
        return asdict(self) | {"version": SPEC_VERSION}

    @classmethod
    def from_dict(cls, raw: dict) -> DatasetSpec:
        raw = dict(raw)
        version = int(raw.pop("version", 1))
        while version < SPEC_VERSION:
            raw = _migrations.get(version, lambda d: d)(raw)
            version += 1
        return cls(**_known(cls, raw))


@dataclass
class MultiCropConfig:
    """Global and local crops with photometric augmentation."""

    global_crop_size: int = 224
    local_crop_size: int = 96
    n_global_crops: int = 2
    n_local_crops: int = 8
    global_crops_scale: tuple[float, float] = (0.32, 1.0)
    local_crops_scale: tuple[float, float] = (0.05, 0.32)
    blur_prob_global1: float = 1.0
    blur_prob_global2: float = 0.1
    blur_prob_local: float = 0.5
    solarize_prob: float = 0.2
    color_jitter_prob: float = 0.8
    grayscale_prob: float = 0.2
    blur_sigma_min: float = 0.1
    blur_sigma_max: float = 2.0
    brightness: float = 0.8
    contrast: float = 0.8
    saturation: float = 0.8
    hue: float = 0.2
    flip_prob: float = 0.5
    resolution_schedule: list[tuple[int, int]] = field(default_factory=list)
    max_global_crop_size: int = 0
    max_local_crop_size: int = 0
    mean: tuple[float, ...] = IMAGENET_MEAN
    std: tuple[float, ...] = IMAGENET_STD

    def __post_init__(self):
        self.max_global_crop_size = self.max_global_crop_size or self.global_crop_size
        self.max_local_crop_size = self.max_local_crop_size or self.local_crop_size
        if any(e < 0 for e, _ in self.resolution_schedule):
            raise ValueError("epochs of a schedule must not be negative")
        self.resolution_schedule = sorted(tuple(x) for x in self.resolution_schedule)
        if self.n_global_crops < 1 or self.n_local_crops < 0:
            raise ValueError("one global crop at least")
        _range(self.global_crops_scale, "global_crops_scale")
        _range(self.local_crops_scale, "local_crops_scale")

    @property
    def n_views(self) -> int:
        return self.n_global_crops + self.n_local_crops

    @property
    def norm_stats(self) -> NormStats:
        return NormStats(tuple(self.mean), tuple(self.std))

    def crop_size_at_epoch(self, epoch: int) -> int:
        sizes = [s for e, s in self.resolution_schedule if e <= epoch]
        return sizes[-1] if sizes else self.global_crop_size


@dataclass
class AugSpec:
    """Base of the augmentation kinds."""

    supports_masking = False

    def view_names(self) -> list[str]:
        raise NotImplementedError

    @property
    def n_views(self) -> int:
        return len(self.view_names())

    @property
    def n_first(self) -> int:
        """How many views the first part of a split has."""
        return self.n_views


@dataclass
class MultiCropSpec(AugSpec):
    config: MultiCropConfig = field(default_factory=MultiCropConfig)
    supports_masking = True

    def view_names(self) -> list[str]:
        return [f"view_{i}" for i in range(self.config.n_views)]

    @property
    def n_first(self) -> int:
        return self.config.n_global_crops


@dataclass
class EvalSpec(AugSpec):
    """Resize the shorter side and cut the centre: nothing random."""

    crop_size: int = 224
    mean: tuple[float, ...] = IMAGENET_MEAN
    std: tuple[float, ...] = IMAGENET_STD
    interpolation: str = "bicubic"

    def __post_init__(self):
        if self.interpolation not in ("bicubic", "bilinear"):
            raise ValueError("interpolation must be bicubic or bilinear")

    def view_names(self) -> list[str]:
        return ["view_0"]

    @property
    def resize_to(self) -> int:
        return int(self.crop_size * 256 / 224)


@dataclass
class ContextTargetsSpec(AugSpec):
    """One context view and several small targets."""

    context_crop_size: int = 224
    target_crop_size: int = 96
    n_target_views: int = 4
    context_scale: tuple[float, float] = (0.85, 1.0)
    target_scale: tuple[float, float] = (0.15, 0.20)
    mean: tuple[float, ...] = IMAGENET_MEAN
    std: tuple[float, ...] = IMAGENET_STD

    def __post_init__(self):
        if self.n_target_views < 1:
            raise ValueError("one target view at least")
        _range(self.context_scale, "context_scale")
        _range(self.target_scale, "target_scale")

    def view_names(self) -> list[str]:
        return ["context", *(f"target_{i}" for i in range(self.n_target_views))]

    @property
    def n_first(self) -> int:
        return 1


@dataclass
class UserSpec(AugSpec):
    """A function from a (B, C, H, W) array to named views, with their declared names."""

    fn: Callable | None = None
    views: tuple[str, ...] = ()
    decode_size: int = 256
    mean: tuple[float, ...] = IMAGENET_MEAN
    std: tuple[float, ...] = IMAGENET_STD

    def __post_init__(self):
        if not callable(self.fn) or not self.views or self.decode_size < 1:
            raise ValueError("a function, some view and a positive decode size")

    def view_names(self) -> list[str]:
        return list(self.views)

    @property
    def n_first(self) -> int:
        return max(1, len(self.views) // 2)


@dataclass
class LoaderConfig:
    """What a loader needs besides datasets and augmentation."""

    seed: int = 0
    shuffle_buffer_size: int = 512
    output_dtype: str = "fp32"
    stateful: bool = False
    checkpoint_dir: str = ""
    checkpoint_every_steps: int = 500
    stall_timeout_s: float = 600.0
    heartbeat_stale_s: float = 300.0
    warn_utilisation: float = 0.9
    metrics_port: int | None = None
    debug_log_keys: str | None = None

    def __post_init__(self):
        checks = {
            "output_dtype is fp32 or bf16": self.output_dtype in ("fp32", "bf16"),
            "shuffle_buffer_size is not negative": self.shuffle_buffer_size >= 0,
            "stateful needs checkpoint_dir": not self.stateful or bool(self.checkpoint_dir),
            "checkpoint_every_steps is positive": self.checkpoint_every_steps >= 1,
            "stall_timeout_s is not negative": self.stall_timeout_s >= 0,
            "heartbeat_stale_s is positive": self.heartbeat_stale_s > 0,
            "warn_utilisation is in [0, 1]": 0 <= self.warn_utilisation <= 1,
            "metrics_port is in 1..65535": self.metrics_port is None or 1 <= self.metrics_port <= 65535,
        }
        wrong = [k for k, ok in checks.items() if not ok]
        if wrong:
            raise ValueError("; ".join(wrong))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: dict) -> LoaderConfig:
        return cls(**_known(cls, raw))


@dataclass
class LoaderState:
    """What a checkpoint holds."""

    step: int = 0
    epoch: int = 0
    dataset_names: list[str] = field(default_factory=list)
    mixing_weights: list[float] = field(default_factory=list)
    global_crop_size: int = 224
    local_crop_size: int = 96

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, raw: dict) -> LoaderState:
        return cls(**_known(cls, raw))
