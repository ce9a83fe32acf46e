"""Token counts of flat unindexed token files by a separator scan.

A file is nothing but token ids, each document followed by one end-of-document
id.  Blocks of fixed length are read and searched apart: the places of the
separator in a block come from one vectorised comparison.  A block gives the
counts between its separators, and as a summary how many tokens lie before its
first and after its last separator.  A prefix scan over the summaries of a file
(one row a block) stitches documents that cross blocks and numbers them; it is
done in two levels, over groups of blocks and within them, so no task sees more
than about the square root of a file's blocks.

Defined results: an empty document has count 0; tokens after the last
separator, or a file without one, are an unfinished document, reported with
``ended`` false; an empty file gives no rows; a file whose length is no
multiple of the id width raises.  A text that spells the separator does not
make one, for it is encoded as ordinary text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, scratch
from .tokens import DTYPE, EOD, TOKENIZER, Writer, attempt_mark, encode, filesystem, string_list

BLOCK = 1 << 20  # ids
GROUP = 1024  # blocks


def write_flat(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, eod: int = EOD, dtype: np.dtype = DTYPE) -> DataFrame:
    """Write one flat token file per partition; returns (file, place, doc_id), the order in which documents went out."""

    def run(batches):
        from pyspark import TaskContext

        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        writer, place = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                writer = writer or Writer(folder, name, attempt_mark())
                for ids in encode(string_list(part.column("text")), tokenizer, dtype):
                    writer.write(ids.tobytes() + np.array([eod], dtype).tobytes())
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(place, place + n)), part.column("doc_id").cast(pa.int64())], names=["file", "place", "doc_id"])
                place += n
        if writer:
            writer.close()

    return checkpoint(docs.select("doc_id", "text").mapInArrow(run, "file string, place long, doc_id long"))


def files_of(spark, folder: str, block: int = BLOCK, dtype: np.dtype = DTYPE) -> DataFrame:
    """(file, block, ids): what there is to read, from the folder's listing."""
    fs, root = filesystem(folder)
    from pyarrow.fs import FileSelector

    found = [(i.base_name, i.size) for i in fs.get_file_info(FileSelector(root, allow_not_found=True)) if i.is_file and not i.base_name.startswith(".")]
    for name, size in found:
        if size % dtype.itemsize:
            raise ValueError(f"{name}: {size} bytes are no whole number of {dtype.itemsize}-byte ids")
    sizes = spark.createDataFrame(sorted(found), "file string, bytes long").where("bytes > 0")
    ids = (F.col("bytes") / dtype.itemsize).cast("long")
    return sizes.select("file", ids.alias("ids"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((ids - 1) / block))).alias("block"))


def count(spark, folder: str, eod: int = EOD, block: int = BLOCK, group: int = GROUP, dtype: np.dtype = DTYPE) -> DataFrame:
    """(file, place, n_tokens, ended) of every document of every token file in a folder."""
    tasks = files_of(spark, folder, block, dtype)
    wide = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = dtype.itemsize

    def scan(batches):
        for batch in batches:
            for name, ids, number in zip(*(batch.column(c).to_pylist() for c in ("file", "ids", "block")), strict=True):
                fs, root = filesystem(folder)
                with fs.open_input_file(f"{root}/{name}") as f:
                    n = min(block, ids - number * block)
                    x = np.frombuffer(f.read_at(n * width, number * block * width), dtype)
                ends = np.flatnonzero(x == eod)
                inner = np.diff(ends) - 1
                head = int(ends[0]) if len(ends) else n
                tail = n - 1 - int(ends[-1]) if len(ends) else n
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([number]), pa.array([len(ends)]), pa.array([head]), pa.array([tail]), pa.array([inner], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "head", "tail", "inner"],
                )

    blocks = checkpoint(tasks.repartition(wide, "file", "block").mapInArrow(scan, "file string, block long, ends long, head long, tail long, inner array<long>"))
    short = blocks.select("file", "block", (F.col("block") / group).cast("long").alias("g"), "ends", "tail")
    local = _before(short, ["file", "g"], "block")
    tail = F.sum("tail") - F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("through") - F.col("tail"))), F.lit(0))
    sums = local.groupBy("file", "g").agg(F.sum("ends").alias("ends"), tail.alias("tail"))
    carry = _before(sums, ["file"], "g").select("file", "g", F.col("open").alias("g_open"), F.col("done").alias("g_done"))
    opened = F.col("open") + F.when(F.col("done") > 0, 0).otherwise(F.col("g_open"))
    placed = local.join(carry, ["file", "g"]).select("file", "block", opened.alias("open"), (F.col("done") + F.col("g_done")).alias("done"))
    full = blocks.join(placed, ["file", "block"])
    first = full.where("ends > 0").select("file", F.col("done").alias("place"), (F.col("open") + F.col("head")).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = full.where("ends > 1").select("file", "done", F.posexplode("inner").alias("i", "n_tokens")).select("file", (F.col("done") + F.col("i") + 1).alias("place"), "n_tokens", F.lit(True).alias("ended"))
    last = tasks.groupBy("file").agg(F.max("block").alias("block"))
    torn = full.join(last, ["file", "block"]).select("file", (F.col("done") + F.col("ends")).alias("place"), (F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("tail"))).alias("n_tokens"), F.lit(False).alias("ended")).where("n_tokens > 0")
    return first.unionByName(rest).unionByName(torn)


def _before(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add what a row's predecessors leave: ``open`` ids since the last separator, ``done`` documents ended.

    ``through`` is the running sum of tails; where a separator came, the sum
    before that row is a base, and the last base is the greatest.
    """
    now = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("through", F.sum("tail").over(now))
    base = F.max(F.when(F.col("ends") > 0, F.col("through") - F.col("tail"))).over(earlier)
    return rows.withColumn("open", F.col("through") - F.col("tail") - F.coalesce(base, F.lit(0))).withColumn("done", F.coalesce(F.sum("ends").over(earlier), F.lit(0)))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, found by scanning the flat files that the documents were written to."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch(spark, "flat")
    order = write_flat(docs, folder)
    found = count(spark, folder)
    return order.join(found, ["file", "place"]).select("doc_id", "n_tokens")


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict[str, str] = {}
