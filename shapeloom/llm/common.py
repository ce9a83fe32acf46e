"""Shared plumbing: checkpoints in the cluster's shared folder, exact distributed ranks, hashing."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session one of our own where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="shapeloom-checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by a write to the shared folder; it survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Let Spark drop shuffle and checkpoint files that nothing refers to any more."""
    for _ in range(2):  # the driver's objects go first; what they held is found by the next collection
        gc.collect()
        time.sleep(0.1)
        df.sparkSession.sparkContext._jvm.System.gc()


BATCH_BYTES = 4 << 20  # bytes of rows that a task hands to Python at a time


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands Python ``BATCH_BYTES`` of rows at a time, unless it has a setting of its own.

    10,000 rows at a time, as by default, are 34 MB of texts, which the executor
    and its Python worker both hold, and more where texts are longer.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name (as a URI) under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shielded(docs: DataFrame, reserved: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of reserved names renamed, and the way back for ``withColumnsRenamed``."""
    taken = {c.lower() for c in docs.columns}
    away = {}
    for c in docs.columns:
        if c.lower() in reserved:
            new = f"_own_{c}"
            while new.lower() in taken:
                new = "_" + new
            taken.add(new.lower())
            away[c] = new
    return docs.withColumnsRenamed(away), {v: k for k, v in away.items()}


def words_of(text: Column) -> Column:
    """Array of words ``[^\\x20\\x09-\\x0D]+``; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Add ``out``: the exclusive prefix sum of ``value`` (a long) in a total order over all rows.

    Rows are range-partitioned and sorted once and written to the shared
    folder; one sum per partition reaches the driver, and each partition then
    adds its own running sum to its offset.
    """
    spark = df.sparkSession
    wide = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096))
    placed = checkpoint(df.withColumn(out, value.cast("long")).repartitionByRange(wide, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r["s"] for r in placed.groupBy("_part").agg(F.sum(out).alias("s")).collect()}
    starts, total = {}, 0
    for part in sorted(sums):
        starts[part], total = total, total + (sums[part] or 0)
    schema = placed.drop("_part").schema

    def run(batches):
        carry = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            x = batch.column(out).to_numpy(zero_copy_only=False)
            before = np.cumsum(x) - x + carry + starts[part]
            carry += int(x.sum())
            t = pa.Table.from_batches([batch]).drop_columns(["_part"])
            t = t.set_column(t.schema.get_field_index(out), out, pa.array(before, pa.int64()))
            yield from t.to_batches()

    return placed.mapInArrow(run, schema)


FILTER_BITS = 1 << 30  # the most bits of a filter: 128 MB


def bit_filter(hashes: DataFrame) -> tuple[np.ndarray, int]:
    """A set of bits for a table of one long column, sixteen or more a row up to ``FILTER_BITS``, and how far to shift a hash to its bit.

    Words of the filter are put together by Spark; the driver gets those that
    are not 0.  A fuller filter lets more through, and never loses a row.
    """
    (name,) = hashes.columns
    n = hashes.count()
    width = min(max(20, (16 * n).bit_length()), FILTER_BITS.bit_length() - 1)
    bit = F.shiftrightunsigned(name, 64 - width)
    words = hashes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(31).cast("int"))).alias("v")).toArrow()
    bits = np.zeros(1 << (width - 5), np.uint32)
    bits[words["w"].to_numpy()] = words["v"].to_numpy().astype(np.uint64).astype(np.uint32)
    return bits, 64 - width


def in_filter(bits: np.ndarray, shift: int, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(shift)).astype(np.int64)
    return ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)


def total_of(df: DataFrame, value: Column) -> int:
    return df.agg(F.sum(value)).first()[0] or 0
