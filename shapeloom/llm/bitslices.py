"""Exact top-k inner products over a bit-sliced index of quantised vectors.

The index holds blocks of rows.  A block keeps its integer components whole
and, beside them, quantised: the upper ``BITS`` bits of every component as
that many bitmaps over the block's rows (slices).  A query is quantised too and
written in signed binary digits; its score for all rows of a block at once is
then a sum of shifted slices (of complemented ones for negative digits, as
-h = ~h - (2**bits - 1)), added by bitmap arithmetic: carry-save adders on whole
attributes, then a ripple of bitmaps per weight.  The sum is itself a
list of slices.  Walking it from the most significant slice downward finds the
k-th largest quantised score without looking at rows.

What quantising drops is bounded by Cauchy-Schwarz from norms that the block
and the query know, so a row can be among the k best only if its quantised
score plus that bound reaches the k-th best found so far.  A comparison by slices
marks these boundary rows, and their exact integer scores decide, ties by
the smaller id.  The answer is exact (recall 1); large components in a block
widen its bound and mark more rows, which costs time only.

Blocks and packs of queries meet in cells of a grid, by an equi-join on the
cell: a task holds one cell, a bounded number of blocks and packs, whatever the
size of the tables, and gives k rows a query; the best k of a query's cells are
chosen by a window with partial limits.  Nothing is broadcast and no vector
reaches the driver.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors count as filled up with zeros; a query's own row
is told by its place in the index, so another row of the same id is a
candidate, and repeated query rows answer each; a null id is last among ties
and, where ids select queries, asks nothing; fewer candidates than k give fewer
rows; an empty table gives an empty result.  Components of 2**28 or more after
scaling raise an error, as scores would not fit a long.  Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch
from .vectors import fixed, sound

SCALE, TOP, EVERY = 256, 5, 50
WIDE = 28
BITS = 6  # slices of a component
DIGITS = 6  # bits of a quantised query component's magnitude
BLOCK, PACK = 16_384, 128
CELL_BLOCKS, CELL_PACKS = 8, 32  # the most that meet in a task

_INDEX = "block long, dims int, width int, shift int, residual double, height double, ids array<long>, whole binary, slices binary, asks array<int>"
_PACK = "pack long, dims int, ids array<long>, blocks array<long>, places array<int>, whole binary"
_BEST = "query_id long, block long, place int, vec_id long, score long"


def _dense(column, dims: int) -> np.ndarray:
    from .vectors import rows_of

    return rows_of(column, dims).astype(np.int64)


def quantise(x: np.ndarray, bits: int) -> tuple[int, np.ndarray]:
    """(shift, h): the least shift by which all components fit ``bits`` bits, and h = (x >> shift) + 2**(bits-1)."""
    shift, half = 0, 1 << (bits - 1)
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    while (high >> shift) >= half or (low >> shift) < -half:
        shift += 1
    return shift, (x >> shift) + half


def slices_of(h: np.ndarray, bits: int) -> np.ndarray:
    """Bitmaps (dims, bits, words) over the rows of h (rows, dims)."""
    n, dims = h.shape
    words = -(-n // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        packed = np.packbits((h.T >> b) & 1 == 1, axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return out.view(np.uint64)


def build(vectors: DataFrame, asks: Column | None = None, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """The index of vectors (vec_id, x) in the shared folder: every row, in blocks of its input partition.

    asks: a condition on vec_id; places of its rows are kept, so that they can be queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "x", F.coalesce(asks if asks is not None else F.lit(False), F.lit(False)).alias("asks"))

    def run(batches):
        from pyspark import TaskContext

        at, held, have = TaskContext.get().partitionId() << 32, [], 0

        def made(table):
            dims = int(pc.max(pc.list_value_length(table["x"])).as_py() or 0)
            x = _dense(table["x"], dims)
            shift, h = quantise(x, bits)
            middle = ((h - (1 << (bits - 1))) << shift) + ((1 << shift) - 1) / 2
            norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0)))
            width = 2 if np.abs(x).max(initial=0) < 1 << 15 else 4
            marks = np.flatnonzero(table["asks"].to_numpy())
            row = {"block": at, "dims": dims, "width": width, "shift": shift, "residual": norm(x - middle), "height": norm(h - (1 << (bits - 1))), "ids": table["vec_id"].to_pylist(), "whole": x.astype(f"<i{width}").tobytes(), "slices": slices_of(h, bits).tobytes(), "asks": marks.tolist()}
            return pa.RecordBatch.from_pylist([row], schema=_arrow(_INDEX))

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            while have >= block:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, block).combine_chunks())
                at, have = at + 1, have - block
                held = table.slice(block).to_batches() if have else []
        if have:
            yield made(pa.Table.from_batches(held).combine_chunks())

    path = scratch(spark, "bitslices")
    rows.mapInArrow(run, _INDEX).write.parquet(path)
    return spark.read.parquet(path)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _whole(row: dict) -> np.ndarray:
    return np.frombuffer(row["whole"], f"<i{row.get('width', 4)}").reshape(-1, row["dims"]) if row["dims"] else np.zeros((len(row["ids"]), 0), np.int32)


def packs(index: DataFrame, pack: int = PACK) -> DataFrame:
    """The rows of an index that ask, in packs: each with its place, so that it does not find itself."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = _whole(row)
                for k in range(0, len(row["asks"]), pack):
                    some = row["asks"][k : k + pack]
                    yield pa.RecordBatch.from_pylist(
                        [{"pack": (row["block"] << 12) + k // pack, "dims": row["dims"], "ids": [row["ids"][i] for i in some], "blocks": [row["block"]] * len(some), "places": some, "whole": x[some].astype("<i4").tobytes()}], schema=_arrow(_PACK)
                    )

    return index.where(F.size("asks") > 0).select("block", "dims", "width", "ids", "whole", "asks").mapInArrow(run, _PACK)


# bitmap arithmetic ------------------------------------------------------------


def _full(a, b, c):
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def digits(g: int) -> list[tuple[int, int]]:
    """Signed binary digits (power, sign) of a whole number, no two of them side by side."""
    out, k = [], 0
    while g:
        if g & 1:
            d = 2 - (g & 3)
            out.append((k, d))
            g -= d
        g >>= 1
        k += 1
    return out


def scores(slabs: np.ndarray, flipped: np.ndarray, g: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices, least significant first, of T with sum(g * h) = T - (the second result), for the rows of a block."""
    bits, taken = slabs.shape[1], 0
    at: dict[int, list] = {}
    for d, value in enumerate(g.tolist()):
        for k, sign in digits(value):
            at.setdefault(k, []).append(slabs[d] if sign > 0 else flipped[d])
            taken += ((1 << bits) - 1) << k if sign < 0 else 0
    single: dict[int, list] = {}
    k = min(at, default=0)
    while at:
        some = at.pop(k, [])
        while len(some) > 2:
            total, carry = _full(some.pop(), some.pop(), some.pop())
            some.insert(0, total)
            at.setdefault(k + 1, []).append(carry)
        for slab in some:
            for b in range(bits):
                single.setdefault(k + b, []).append(slab[b])
        k += 1
    out, k, none = [], 0, np.zeros(slabs.shape[2], np.uint64)
    while single:
        some = single.pop(k, [])
        while len(some) > 1:
            if len(some) > 2:
                total, carry = _full(some.pop(), some.pop(), some.pop())
            else:
                a, b = some.pop(), some.pop()
                total, carry = a ^ b, a & b
            some.append(total)
            single.setdefault(k + 1, []).append(carry)
        out.append(some[0] if some else none)
        k += 1
    return out, taken


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def kth(slices: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest value among the marked rows (at least k of them), from the most significant slice downward."""
    value = 0
    for i in range(len(slices) - 1, -1, -1):
        hit = rows & slices[i]
        n = _ones(hit)
        if n >= k:
            rows, value = hit, value | 1 << i
        else:
            k, rows = k - n, rows & ~slices[i]
    return value


def at_least(slices: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The marked rows whose value is ``value`` or more."""
    if value <= 0:
        return rows
    if value >> len(slices):
        return np.zeros_like(rows)
    above, same = np.zeros_like(rows), rows
    for i in range(len(slices) - 1, -1, -1):
        if value >> i & 1:
            same = same & slices[i]
        else:
            above, same = above | (same & slices[i]), same & ~slices[i]
    return above | same


class Block:
    """A block of the index, opened in a task."""

    def __init__(self, row: dict, bits: int = BITS):
        self.x, self.ids, self.block = _whole(row), row["ids"], row["block"]
        self.shift, self.residual, self.height, self.bits = row["shift"], row["residual"], row["height"], bits
        n, dims = self.x.shape
        words = -(-n // 64)
        self.slabs = np.frombuffer(row["slices"], np.uint64).reshape(dims, bits, words)
        self.flipped = ~self.slabs
        self.rows = np.zeros(words * 8, np.uint8)
        marks = np.packbits(np.ones(n, bool), bitorder="little")
        self.rows[: len(marks)] = marks
        self.rows = self.rows.view(np.uint64)
        self.exact = np.abs(self.x).max(initial=0)

    def best(self, q: np.ndarray, k: int, own: int | None, reached: int | None) -> list[tuple[int, int]]:
        """(row, score) of rows that may be among the k best: all of those that are, given that ``reached`` is met by k rows elsewhere."""
        rows = self.rows
        if own is not None:
            rows = rows.copy()
            rows[own >> 6] &= ~np.uint64(1 << (own & 63))
        n = _ones(rows)
        if not n:
            return []
        q = q[: self.x.shape[1]] if len(q) > self.x.shape[1] else np.pad(q, (0, self.x.shape[1] - len(q)))
        fine = max(int(np.abs(q).max(initial=0)).bit_length() - DIGITS, 0)
        g = (q + (1 << fine >> 1)) >> fine
        left = (q - (g << fine)).astype(np.float64)
        slices, taken = scores(self.slabs, self.flipped, g)
        unit = 1 << (self.shift + fine)
        base = ((1 << self.shift) - 1) / 2 * float(q.sum()) - float(unit) * (taken + (1 << (self.bits - 1)) * int(g.sum()))
        bound = (np.sqrt((left**2).sum()) * self.height * (1 << self.shift) + np.sqrt((q.astype(np.float64) ** 2).sum()) * self.residual) * (1 + 1e-9) + 1
        need = reached if reached is not None else -(1 << 63)
        if n >= k:
            need = max(need, unit * kth(slices, rows, k) + base - bound)
        edge = (need - bound - base) / unit
        some = np.flatnonzero(np.unpackbits(at_least(slices, rows, int(np.ceil(edge - 1e-6))).view(np.uint8), bitorder="little"))
        x = self.x[some]
        if float(self.exact) * float(np.abs(q).sum()) < 2**52:
            made = (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        else:
            made = x.astype(np.int64) @ q
        if len(made) > k:  # of equal scores at the end all stay: ids decide
            edge = np.partition(made, len(made) - k)[len(made) - k]
            some, made = some[made >= edge], made[made >= edge]
        return list(zip(some.tolist(), made.tolist(), strict=True))


def _order(row: tuple) -> tuple:
    """Sorts (score, id): the higher score, then the smaller id, null last."""
    return (-row[0], row[1] is None, row[1] or 0)


def _cell(k: int, bits: int):
    def run(blocks, asked):
        found: dict[tuple, list] = {}
        opened = asked.to_pylist()
        for batch in blocks.to_batches(max_chunksize=1):
            b = Block(batch.to_pylist()[0], bits)
            for p in opened:
                x = np.frombuffer(p["whole"], "<i4").reshape(len(p["ids"]), p["dims"]).astype(np.int64)
                for i, (qid, home, place) in enumerate(zip(p["ids"], p["blocks"], p["places"], strict=True)):
                    best = found.setdefault((qid, home, place), [])
                    reached = best[k - 1][0] if len(best) >= k else None
                    best += [(score, b.ids[row]) for row, score in b.best(x[i], k, place if home == b.block else None, reached)]
                    best.sort(key=_order)
                    del best[k:]
        rows = [(*key, vec_id, score) for key, best in found.items() for score, vec_id in best]
        return pa.table([list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5, schema=_arrow(_BEST))

    return run


def search(index: DataFrame, asked: DataFrame, k: int = TOP, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of an index for every query of the packs."""
    spark = index.sparkSession
    path = scratch(spark, "packs")
    asked.write.parquet(path)
    asked = spark.read.parquet(path)
    nb, np_ = index.count(), asked.count()
    shards, groups = (-(-n // max(1, min(most, n // 32))) for n, most in ((max(nb, 1), CELL_BLOCKS), (max(np_, 1), CELL_PACKS)))
    cell = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.drop("asks").withColumn("shard", cell("block", shards)).withColumn("group", every(groups))
    right = asked.withColumn("group", cell("pack", groups)).withColumn("shard", every(shards))
    best = left.groupBy("shard", "group").cogroup(right.groupBy("shard", "group")).applyInArrow(_cell(k, bits), _BEST)
    rank = F.row_number().over(Window.partitionBy("query_id", "block", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    return df.where(sound(v)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), fixed(v, scale, WIDE).alias("x"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    index = build(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), F.col("vec_id") % EVERY == 0)
    return search(index, packs(index))


QUERIES = {"op13_exact_topk": op13_exact_topk}
ORACLE = {
    "op13_exact_topk": f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum([coalesce(z[1], 0) * coalesce(z[2], 0) for z in list_zip(q.x, c.x)]), 0) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.r <> c.r WHERE q.vec_id % {EVERY} = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= {TOP}
"""
}
