"""Tar shards as DataFrames: consecutive members of one base name are one sample with an optional JSON sidecar."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.shipping import ship
from tessella.sources.images import decode_image

IMAGE_TYPES = ("jpg", "jpeg", "png")
SAMPLE_SCHEMA = "shard_path string, key string, pos long, image binary, meta string, error string"
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def samples_of(archive: bytes, types: tuple[str, ...] = IMAGE_TYPES, with_image: bool = True) -> Iterator[tuple]:
    """(key, image, meta) in archive order; members of other kinds are passed over."""
    key, image, meta = None, None, None
    with tarfile.open(fileobj=io.BytesIO(archive)) as tar:
        for member in tar:
            if not member.isfile():
                continue
            folder, _, name = member.name.rpartition("/")
            stem, _, kind = name.partition(".")
            here = f"{folder}/{stem}" if folder else stem
            if here != key:
                if image is not None:
                    yield key, image, meta
                key, image, meta = here, None, None
            if kind.lower() in types:
                image = tar.extractfile(member).read() if with_image else b""
            elif kind.lower() == "json":
                meta = tar.extractfile(member).read().decode("utf-8", "replace")
    if image is not None:
        yield key, image, meta


def sample_batches(batches: Iterable[pa.RecordBatch], types: tuple[str, ...] = IMAGE_TYPES, require_json: bool = False, with_image: bool = True, on_error: str = "skip", decodable: bool = False, measure: Callable[[np.ndarray], int] | None = None) -> Iterator[pa.RecordBatch]:
    """Samples of (path, archive) rows, in batches of at most BATCH_ROWS samples and one sample over BATCH_BYTES."""
    names = ["shard_path", "key", "pos", "image", "meta", "error"] + ["measure"] * (measure is not None)
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows, size, pos = [], 0, 0
            try:
                for key, image, meta in samples_of(content.as_py() or b"", types, with_image or decodable or measure is not None):
                    if require_json and meta is None:
                        continue
                    pixels = decode_image(image) if decodable or measure else None
                    if decodable and pixels is None:
                        continue
                    row = (path, key, pos, image if with_image else None, meta, None, None if pixels is None or measure is None else measure(pixels))
                    rows.append(row[: len(names)])
                    pos += 1
                    size += len(image) * with_image + len(meta or "")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(rows)
                        rows, size = [], 0
            except (tarfile.TarError, EOFError) as e:
                if on_error == "fail":
                    raise
                rows.append((path, None, pos, None, None, str(e), None)[: len(names)])
            if rows:
                yield batch(rows)


def extract(archives: DataFrame, path_col: str = "path", content_col: str = "content", types: tuple[str, ...] = IMAGE_TYPES, require_json: bool = False, with_image: bool = True, on_error: str = "skip", decodable: bool = False, measure: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """One row per sample. A broken archive gives the samples before the break, then a row with ``error`` (or fails).

    ``require_json``: samples without a sidecar are left out; ``decodable``: so are those whose image can't be decoded.
    ``measure``: a long of the decoded image, in a column of that name (null for what can't be decoded), by the same worker.
    Spark hands a worker at most ``spark.sql.execution.arrow.maxBytesPerBatch`` of archives, or one, at a time.
    """
    ship(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sample_batches(batches, types, require_json, with_image, on_error, decodable, measure)
        pa.default_memory_pool().release_unused()  # later tasks reuse this worker

    return archives.select(path_col, content_col).mapInArrow(run, SAMPLE_SCHEMA + (", measure long" if measure else ""))


def read_tar(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """Samples of shards in any store that Spark reads; one archive is one task's unit."""
    return extract(spark.read.format("binaryFile").load(paths), **options)


def pack_shards(samples: DataFrame, shard_col: str, key: str, image: str, meta: str | None = None, suffix: str = "png") -> DataFrame:
    """(shard, content): tar archives. Shards must be of bounded size: number them before."""
    ship(samples.sparkSession)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame, out = frame.sort_values("key"), io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as tar:
            for r in frame.itertuples():
                for kind, data in ((suffix, r.image), ("json", r.meta.encode() if isinstance(r.meta, str) else None)):
                    if data is not None:
                        info = tarfile.TarInfo(f"{r.key}.{kind}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"path": [frame["shard"].iloc[0]], "content": [out.getvalue()]})

    rows = samples.select(F.col(shard_col).cast("string").alias("shard"), F.col(key).cast("string").alias("key"), F.col(image).alias("image"), (F.col(meta) if meta else F.lit(None)).cast("string").alias("meta"))
    return rows.groupBy("shard").applyInPandas(build, "path string, content binary")


def write_index(spark: SparkSession, path: str, offsets: Iterable[int]) -> None:
    """An index file: one little-endian 8-byte offset per sample, through Hadoop's file system API."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(np.fromiter(offsets, "<i8").tobytes()))
    finally:
        out.close()


def index_counts(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, n): samples per index file of 8-byte offsets; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.floor(F.col("length") / 8).alias("n"))
