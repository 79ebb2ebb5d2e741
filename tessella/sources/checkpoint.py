"""Loader state as JSON with a digest, a LATEST pointer and pruning, through Hadoop's file system API."""

from __future__ import annotations

import hashlib
import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.specs import LoaderState

log = logging.getLogger(__name__)
LATEST = "LATEST"


def envelope(state: LoaderState) -> str:
    payload = state.to_dict()
    return json.dumps({"payload": payload, "sha256": payload_digest(payload)}, indent=2)


def payload_digest(payload: dict) -> str:
    return hashlib.sha256(json.dumps(payload, indent=2, sort_keys=True).encode()).hexdigest()


def parse(text: str) -> LoaderState:
    """A wrong digest raises; a flat file of older kind is read with a warning."""
    raw = json.loads(text)
    if "payload" not in raw:
        log.warning("checkpoint without digest")
        return LoaderState.from_dict(raw)
    if raw.get("sha256") != payload_digest(raw["payload"]):
        raise ValueError("checkpoint digest does not match")
    return LoaderState.from_dict(raw["payload"])


class Checkpointer:
    """Writes every ``every`` steps on rank 0; keeps the last ``keep`` by (epoch, step)."""

    def __init__(self, spark: SparkSession, folder: str, every: int = 1, rank: int = 0, keep: int = 3):
        self.spark, self.folder, self.every, self.rank, self.keep = spark, folder.rstrip("/"), every, rank, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, text: str) -> None:
        """First under another name, then renamed: readers never see half a file."""
        target, partial = self._path(f"{self.folder}/{name}"), self._path(f"{self.folder}/.{name}.partial")
        out = self._fs.create(partial, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self._fs.delete(target, False)
        if not self._fs.rename(partial, target):
            raise OSError(f"could not write {target}")

    def _read(self, name: str) -> str:
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        return sorted(n for f in self._fs.listStatus(self._path(self.folder)) if (n := f.getPath().getName()).startswith("state_") and n.endswith(".json"))

    def save(self, state: LoaderState) -> str | None:
        if self.rank or state.step % self.every:
            return None
        self._fs.mkdirs(self._path(self.folder))
        name = f"state_{state.epoch:08d}_{state.step:012d}.json"
        self._write(name, envelope(state))
        self._write(LATEST, name)
        for old in self.names()[: -self.keep]:
            self._fs.delete(self._path(f"{self.folder}/{old}"), False)
        return name

    def load(self) -> LoaderState | None:
        """The latest state; a missing or dangling pointer falls back to the last name; unreadable: a warning and None."""
        names = self.names()
        if not names:
            return None
        pointed = self._read(LATEST).strip() if self._fs.exists(self._path(f"{self.folder}/{LATEST}")) else ""
        try:
            return parse(self._read(pointed if pointed in names else names[-1]))
        except (ValueError, KeyError, TypeError) as e:
            log.warning("checkpoint not read: %s", e)
            return None


def verified(df: DataFrame, payload: str, digest: str) -> DataFrame:
    """Adds ``valid``: the payload's SHA-256 is the digest."""
    return df.withColumn("valid", F.sha2(F.col(payload), 256) == F.col(digest))


def latest_of(log_table: DataFrame, by: list[str], epoch: str, step: str, value: Column) -> DataFrame:
    return log_table.groupBy(*by).agg(F.max_by(value, F.struct(epoch, step)).alias("latest"))


def kept_of(log_table: DataFrame, by: list[str], epoch: str, step: str, keep: int = 3) -> DataFrame:
    """The last ``keep`` of each group: the pruning rule as a query."""
    w = Window.partitionBy(*by).orderBy(F.col(epoch).desc(), F.col(step).desc())
    return log_table.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)


def audit_keys(samples: DataFrame, key: str, path: str) -> None:
    """Append the keys of all samples, one a line."""
    samples.select(F.col(key).cast("string")).write.mode("append").text(path)
