"""Helpers that several corpus operators share: shared scratch tables, bounded filters, ASCII text rules."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of all contracts here: space, tab, line feed, vertical tab, form feed, carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
#: Bits of a membership filter: 16 for each key, within these bounds (128 KB and 128 MB). Beyond, none is made.
LEAST_BITS, MOST_BITS, KEY_BITS = 1 << 20, 1 << 30, 16
TOP = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session gets a temporary folder; a cluster session gets an error, since a local folder
    there would lose data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch(spark: SparkSession, tag: str) -> str:
    """A new, unused path below this application's folder of the shared folder."""
    path = f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    if (paths := _clearing.get()) is not None:
        paths.append(path)
    return path


#: The scratch paths made within the innermost :func:`clearing`.
_clearing: ContextVar[list[str] | None] = ContextVar("clearing", default=None)


@contextmanager
def clearing(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the scratch tables made within, but for those that :func:`saved` was told to keep."""
    paths: list[str] = []
    token = _clearing.set(paths)
    try:
        yield
    finally:
        _clearing.reset(token)
        for path in paths:
            drop_path(spark, path)


def sweep(spark: SparkSession) -> None:
    """Delete all scratch tables of this application: call it once its results are written elsewhere."""
    drop_path(spark, f"{shared_dir(spark)}/tessella-{spark.sparkContext.applicationId}")


def saved(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    if keep and (paths := _clearing.get()) is not None:
        paths.remove(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only. ``lower`` alone would fold other letters, so it serves pure ASCII values only."""
    pure = F.octet_length(col) == F.char_length(col)
    return F.when(pure, F.lower(col)).otherwise(F.translate(col, string.ascii_uppercase, string.ascii_lowercase))


def filter_bits(n_keys: int) -> int | None:
    """A power of two of about 16 bits a key; None for so many keys that their filter must not be broadcast."""
    bits = max(LEAST_BITS, 1 << (KEY_BITS * max(1, n_keys) - 1).bit_length())
    return bits if bits <= MOST_BITS else None


def bucket_of(cols: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits))


def key_filter(keys: DataFrame, cols: list[Column], bits: int) -> DataFrame:
    """A one-hash membership filter as ``bits / 32768`` rows of 4 KB each: bounded, so that it may be broadcast."""
    b = bucket_of(cols, bits)
    return keys.select(F.bitmap_bucket_number(b).alias("_bucket"), F.bitmap_bit_position(b).alias("_pos")).groupBy("_bucket").agg(F.bitmap_construct_agg("_pos").alias("_bits"))


def in_filter(df: DataFrame, cols: list[Column], bitmap: DataFrame | None, name: str, bits: int | None) -> DataFrame:
    """Add boolean ``name``: false only for rows whose key is certainly not among the filter's keys. No filter: all true."""
    if bitmap is None or bits is None:
        return df.withColumn(name, F.lit(True))
    b = bucket_of(cols, bits)
    pos = F.bitmap_bit_position(b)
    joined = df.withColumn("_b", F.bitmap_bucket_number(b)).join(F.broadcast(bitmap.withColumnRenamed("_bucket", "_b")), "_b", "left")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(pos / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (pos % 8 + 1).cast("int"))) != 0, F.lit(False))
    return joined.withColumn(name, hit).drop("_b", "_bits")


def flagged(df: DataFrame, cols: list[Column], keys: DataFrame, name: str = "_maybe", key_cols: list[Column] | None = None) -> DataFrame:
    """``df`` with boolean ``name``: false only for rows whose key is not among ``keys``.

    The filter is sized by the number of keys, which is counted; where it would be too large to broadcast, every row is
    true and the join that follows sorts both sides whole.
    """
    bits = filter_bits(keys.count())
    return in_filter(df, cols, key_filter(keys, key_cols or cols, bits) if bits else None, name, bits)


def crc_of_id(id_col: str = "doc_id") -> Column:
    """CRC-32 of an id's decimal text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def drawn(df: DataFrame, k: int, *keys: str, by: str | None = None, tag: str = "draw") -> DataFrame:
    """Exactly the ``k`` rows (fewer if there are fewer) of each value of ``by`` whose hash of ``tag`` and ``keys`` is least.

    Rows are counted, those below a hash that somewhat more than ``k`` rows of each value are expected below are ranked;
    if that leaves too few (as many rows that repeat each other may), the bar is raised and they are ranked again. ``k``
    rows of each value reach the rank's task, and ties by hash are cut there, whatever the number of rows.
    """
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(F.lit(tag), *keys), F.lit(TOP)))
    value = F.lit(0) if by is None else F.col(by)
    hashed = hashed.withColumn("_by", value)
    sizes = {r["_by"]: r["n"] for r in hashed.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = {v: min(1.0, (k + 6 * k**0.5 + 10) / n) for v, n in sizes.items()}
    while True:
        bar = F.lit(0).cast("long")
        for v, share in shares.items():
            bar = F.when(F.col("_by").eqNullSafe(F.lit(v)), F.lit(min(TOP, int(share * TOP)))).otherwise(bar)
        ranked = hashed.where(F.col("_hash") <= bar).withColumn("_rank", F.row_number().over(Window.partitionBy("_by").orderBy("_hash"))).where(F.col("_rank") <= k)
        found = {r["_by"]: r["n"] for r in ranked.groupBy("_by").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [v for v, n in sizes.items() if found.get(v, 0) < min(k, n)]
        if not short:
            return ranked.drop("_hash", "_by", "_rank")
        shares |= {v: min(1.0, shares[v] * 8) for v in short}


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, digest: Column, digest_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, digest) ``decided`` marks as kept; of repeats of one id and text, one row.

    Only rows that a bounded filter of the dropped ids finds are shuffled; all columns of ``docs``, whatever their names,
    come back as they were. ``digest`` is made from the columns ``id_col`` and those it names in ``docs``.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), digest.alias("_digest"))
    dropped = decided.where(~F.col("kept")).select(F.col(id_col).alias("_id"))
    kept = decided.where("kept").select(F.col(id_col).alias("_kept_id"), F.col(digest_col).alias("_kept_digest")).distinct()
    found = flagged(packed, [F.col("_id")], dropped)
    sure = found.where(~F.col("_maybe")).select("_row.*")
    stay = found.where("_maybe").join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi")
    return sure.unionByName(stay.dropDuplicates(["_id", "_digest"]).select("_row.*"))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; afterwards its worker, which later tasks reuse, gives freed memory back."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return whole
