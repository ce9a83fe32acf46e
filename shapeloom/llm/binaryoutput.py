"""Token-ID output in training order.

Texts are encoded whole, each ends with the end-of-document id, and the texts
of an input partition are packed one after the other into sequences of
``LENGTH`` ids; only a partition's last sequence is padded (by that id).
Sequences are numbered densely in the order of the packed table, and a keyed
Feistel permutation with cycle-walking gives each number its slot in training:
a bijection of 0..N-1, computed per sequence, with nothing to sort or shuffle at
random.  Slots are dealt out in ranges: shard s holds the slots from
``s * per_shard``, one task writes it, in order.

A shard is nothing but sequences of one stride: slot k is at byte
``(k % per_shard) * stride`` of shard ``k // per_shard``, so a reader resumes
anywhere by arithmetic.  Shards are moved to their names when complete.

The packed table is written once to the shared folder, compressed in blocks.
Shards are written in ``waves``, each over its range of slots, so that only a
part of the sequences is in shuffle files at a time.

Defined results: null and empty texts give the end-of-document id alone;
repeated rows are packed each; an empty table writes no shard and returns no
row.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release, scratch, small_batches
from .tokens import DTYPE, EOD, TOKENIZER, Writer, attempt_mark, encode, filesystem, string_list

LENGTH = 2048
PER_SHARD = 2048
BLOCK = 256  # sequences
WAVES = 4
KEY = 20240229
ROUNDS = 4


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Permute 0..n-1: a balanced Feistel network on the next even number of bits, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, rounds, dtype=np.uint64)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(32)
            left, right = right, left ^ (f & mask)
        return left << np.uint64(half) | right

    out = once(np.asarray(x).astype(np.uint64))
    while len(walk := np.flatnonzero(out >= n)):
        out[walk] = once(out[walk])
    return out.astype(np.int64)


def packed(docs: DataFrame, length: int = LENGTH, tokenizer: str = TOKENIZER, eod: int = EOD, dtype: np.dtype = DTYPE) -> DataFrame:
    """Blocks of packed sequences (part, first, n, blob), each with the documents that begin in it (doc_id, start, size).

    part: the input partition; first: the block's first sequence there; start:
    a document's first id, counted in the partition.
    """

    def run(batches):
        from pyspark import TaskContext

        part, zip_ = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        held, have, at, first = [], 0, 0, 0
        begun: list[list] = [[], [], []]

        def block(ids: np.ndarray):
            n = len(ids) // length
            kinds = (pa.int64(), pa.int64(), pa.int64())
            row = [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int32()), pa.array([zip_.compress(ids.tobytes())], pa.binary())]
            row += [pa.array([x], pa.list_(k)) for x, k in zip(begun, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(row, names=["part", "first", "n", "blob", "doc_id", "start", "size"])

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256)
                for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encode(string_list(rows.column("text")), tokenizer, dtype), strict=True):
                    ids = np.append(ids, dtype.type(eod))
                    for values, x in zip(begun, (doc_id, at, len(ids)), strict=True):
                        values.append(x)
                    held.append(ids)
                    at, have = at + len(ids), have + len(ids)
                    while have >= BLOCK * length:
                        flat = np.concatenate(held)
                        yield block(flat[: BLOCK * length])
                        first += BLOCK
                        held, have, begun = [flat[BLOCK * length :]], have - BLOCK * length, [[], [], []]
        if have:
            flat = np.concatenate(held)
            yield block(np.append(flat, np.full(-len(flat) % length, eod, dtype)))

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "part int, first long, n int, blob binary, doc_id array<long>, start array<long>, size array<long>")


def _write_wave(blocks: DataFrame, folder: str, begins: dict, total: int, low: int, high: int, length: int, per_shard: int, key: int, dtype: np.dtype) -> int:
    """Write the shards low..high-1; returns how many sequences they hold."""
    width = length * dtype.itemsize

    def cut(batches):
        pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for part, first, n, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "n", "blob")), strict=True):
                slot = feistel(begins[part] + first + np.arange(n), total, key)
                mine = np.flatnonzero((slot // per_shard >= low) & (slot // per_shard < high))
                if len(mine):
                    raw = unpack.decompress(blob, max_output_size=n * width)
                    ids = [pack.compress(raw[i * width : (i + 1) * width]) for i in mine]
                    yield pa.RecordBatch.from_arrays([pa.array(slot[mine]), pa.array(ids, pa.binary())], names=["slot", "ids"])

    def write(batches):
        unpack, writer, current, n = zstandard.ZstdDecompressor(), None, None, 0
        for batch in batches:
            for slot, ids in zip(batch.column("slot").to_pylist(), batch.column("ids"), strict=True):
                if slot // per_shard != current:
                    if writer:
                        writer.close()
                    current = slot // per_shard
                    writer = Writer(folder, f"shard-{current:08d}.bin", attempt_mark())
                writer.write(unpack.decompress(ids.as_buffer(), max_output_size=width))
                n += 1
        if writer:
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    wide = min(high - low, 20_000)
    per_task = -(-(high - low) // wide)
    target = F.floor((F.floor(F.col("slot") / per_shard) - low) / per_task).cast("int")
    dealt = blocks.select("part", "first", "n", "blob").mapInArrow(cut, "slot long, ids binary").repartitionById(wide, target).sortWithinPartitions("slot")
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def materialise(docs: DataFrame, folder: str, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, waves: int = WAVES, tokenizer: str = TOKENIZER, eod: int = EOD, dtype: np.dtype = DTYPE) -> DataFrame:
    """Write the shards; returns where each piece of a document is: (doc_id, piece, slot, shard, record, begin, n_tokens).

    A document's pieces in order are its ids and the end-of-document id.
    """
    blocks = checkpoint(packed(docs, length, tokenizer, eod, dtype))
    counts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    begins, total = {}, 0
    for part in sorted(counts):
        begins[part], total = total, total + counts[part]
    shards = -(-total // per_shard)
    written = 0
    for w in range(waves):
        low, high = shards * w // waves, shards * (w + 1) // waves
        if high > low:
            written += _write_wave(blocks, folder, begins, total, low, high, length, per_shard, key, dtype)
            release(docs)
    if written != total:
        raise RuntimeError(f"{written} of {total} sequences were written")

    def pieces(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                part, start, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("part", "start", "size"))
                low, high = start // length, (start + size - 1) // length
                times = high - low + 1
                row = np.repeat(np.arange(len(start)), times)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                seq = low[row] + piece
                begin = np.maximum(start[row] - seq * length, 0)
                end = np.minimum(start[row] + size[row] - seq * length, length)
                base = np.array([begins[p] for p in part], np.int64)
                slot = feistel(base[row] + seq, total, key)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard), pa.array(begin.astype(np.int32)), pa.array((end - begin).astype(np.int32))],
                    names=["doc_id", "piece", "slot", "shard", "record", "begin", "n_tokens"],
                )

    each = blocks.select("part", F.explode(F.arrays_zip("doc_id", "start", "size")).alias("d")).select("part", "d.doc_id", "d.start", "d.size")
    return each.mapInArrow(pieces, "doc_id long, piece int, slot long, shard long, record long, begin int, n_tokens int")


def read_sequences(folder: str, first: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD, dtype: np.dtype = DTYPE) -> np.ndarray:
    """Slots first..first+n-1 in order, by arithmetic alone; fewer where the data end."""
    fs, root = filesystem(folder)
    stride, out = length * dtype.itemsize, []
    while n > 0:
        shard, record = divmod(first, per_shard)
        take = min(n, per_shard - record)
        try:
            with fs.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                data = f.read_at(take * stride, record * stride)
        except FileNotFoundError:
            break
        out.append(np.frombuffer(data, dtype).reshape(-1, length))
        if len(data) < take * stride:
            break
        first, n = first + take, n - take
    return np.concatenate(out) if out else np.zeros((0, length), dtype)


def op4_binary_output(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its slot in training order and its place in the shards written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return materialise(docs, scratch(spark, "shards"))


QUERIES = {"op4_binary_output": op4_binary_output}
ORACLE: dict[str, str] = {}
