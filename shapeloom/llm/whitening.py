"""Embedding whitening from one aggregation over the upper triangle of the covariance.

A first aggregate takes the number of vectors and exact integer sums S per
dimension.  A second one holds one Spark SQL expression for every pair of
dimensions i <= j, ``sum(c_i * c_j)`` of components centred beforehand
(c = x - S/n), so that a large common offset cancels before anything is
multiplied.  All pairs are summed in one pass with partial sums per task (64
dimensions: 2,080 sums, 17 KB a task); the driver puts the symmetric matrix
together and LAPACK decomposes it.  The driver never holds vectors.  Vectors
are projected where they lie, and ``identity_error`` is measured on the very
values that are returned, by a last aggregate of their covariances.

Expressions grow with the square of the dimensions; above ``PAIRS`` of them
(90 dimensions) the triangle is summed in several aggregations.

Defined results: vectors that are null or hold null or non-finite components
get no row and are not fitted; shorter vectors count as filled up with zeros; a
component without variance (fewer vectors than dimensions, equal vectors) has
``whitened`` null and no part in the identity error, which is null if no
component has any; one vector or only equal ones: all are null; repeated rows
and null ids are rows like any other; an empty table gives an empty result.
``deviation`` is null where the exact number does not fit a long, and
``deviation_exact`` then holds it as a decimal (else null).  Components of
2**40 or more after scaling raise an error.  Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vectors import fixed, rows_of, sound

SCALE, OFFSET, TOP = 1024, 100_000, 8
BITS = 40
PAIRS = 4096
FLAT = 1e-12  # a share of the trace: eigenvalues below it are rounding


@dataclass(frozen=True)
class Whitening:
    """n, exact sums, eigenvalues (falling) and unit eigenvectors (columns) of the first components, and the trace."""

    n: int
    sums: tuple
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def live(self) -> np.ndarray:
        return self.values > FLAT * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of integer rows; NaN for components without variance."""
        mean = np.array([s / self.n for s in self.sums])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.live, ((x - mean) @ self.vectors) / np.sqrt(np.where(self.live, self.values, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> list:
        """Exact sums over dimensions of (n x - S)**2, as Python numbers."""
        s = np.array(self.sums, object)
        most = max(self.n * int(np.abs(x).max(initial=0)), *(abs(v) for v in self.sums)) * 2 if len(x) else 0
        if most < 1 << 62:
            gap = self.n * x - s.astype(np.int64)
            if self.dims * float(np.abs(gap).max(initial=0)) ** 2 < 2**62:
                return (gap * gap).sum(1).tolist()
        gap = self.n * x.astype(object) - s
        return [int(v) for v in (gap * gap).sum(1)]


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    return df.where(sound(v)).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), fixed(v, scale, BITS, offset).alias("x"))


def _components(dims: int, filler: int) -> list:
    return [F.coalesce(F.get("x", F.lit(i)), F.lit(filler).cast("long")).alias(f"x{i}") for i in range(dims)]


def fit(vectors: DataFrame, top: int = TOP, filler: int = OFFSET) -> Whitening | None:
    """The first ``top`` components of vectors (vec_id, x); None if there are no vectors or no dimensions."""
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return None
    wide = vectors.select(*_components(dims, filler))
    first = wide.agg(F.count("*").alias("n"), *(F.sum(F.col(f"x{i}").cast("decimal(19,0)")).cast("string").alias(f"x{i}") for i in range(dims))).first()
    n, sums = first["n"], tuple(int(first[f"x{i}"]) for i in range(dims))
    centred = wide.selectExpr(*(f"CAST(x{i} AS DOUBLE) - {sums[i] / n!r}D AS c{i}" for i in range(dims)))
    pairs = [(i, j) for i in range(dims) for j in range(i, dims)]
    cov = np.zeros((dims, dims))
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        row = centred.agg(*(F.expr(f"sum(c{i} * c{j}) AS v_{i}_{j}") for i, j in some)).first()
        for (i, j), v in zip(some, row, strict=True):
            cov[i, j] = cov[j, i] = v / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    turned = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Whitening(n, sums, values, axes * turned, float(np.trace(cov)))


def identity_error(vectors: DataFrame, w: Whitening, filler: int = OFFSET) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    live = [int(k) for k in np.flatnonzero(w.live)]
    if not live:
        return None
    names = [f"w{k}" for k in live]

    def run(batches):
        for batch in batches:
            made = w.project(_filled(batch.column("x"), w.dims, filler))
            yield pa.RecordBatch.from_arrays([pa.array(made[:, k]) for k in live], names=names)

    made = vectors.select("x").mapInArrow(run, ", ".join(f"{x} double" for x in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = made.agg(*(F.covar_pop(a, b) for a, b in pairs)).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(row, pairs, strict=True))


def _filled(column, dims: int, filler: int) -> np.ndarray:
    x = rows_of(column, dims)
    lengths = np.diff(column.offsets.to_numpy())
    return x if (lengths == dims).all() else np.where(np.arange(dims) < lengths[:, None], x, filler)


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whiten(vectors: DataFrame, top: int = TOP, filler: int = OFFSET) -> DataFrame:
    """One row per vector (vec_id, x) and component."""
    w = fit(vectors, top, filler)
    if w is None:
        return vectors.sparkSession.createDataFrame([], _OUT)
    error, m = identity_error(vectors, w, filler), len(w.values)
    share = w.values / w.trace if w.trace > 0 else np.zeros(m)

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            x = _filled(batch.column("x"), w.dims, filler)
            exact, made = w.deviations(x), w.project(x)
            rows = pa.array(np.repeat(np.arange(k), m))
            fits = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            large = pa.array([None if v < 1 << 63 else v for v in exact], pa.decimal128(38, 0))
            flat = made.ravel()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(rows), pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()), pa.array(np.full(k * m, w.n)), fits.take(rows), pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(share, k)),
                 pa.array([error] * (k * m), pa.float64()), large.take(rows)],
                names=[c.split()[0] for c in _OUT.replace("(38,0)", "").split(", ")],
            )

    return vectors.mapInArrow(run, _OUT)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector."""
    return whiten(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def whitening_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op12 that SQL can express."""
    return op12_embedding_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


QUERIES = {"op12_embedding_whitening": op12_embedding_whitening, "whitening_deviations": whitening_deviations}
ORACLE = {
    "whitening_deviations": f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)
), x AS (SELECT r, vec_id, j, CAST(floor({SCALE} * CAST(embedding[j] AS DOUBLE)) AS HUGEINT) + {OFFSET} AS x FROM v, generate_series(1, (SELECT max(len(embedding)) FROM v)) AS g(j)
), s AS (SELECT j, sum(x) AS s, count(*) AS n FROM x GROUP BY j
), d AS (SELECT r, vec_id, any_value(n) AS n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM x JOIN s USING (j) GROUP BY r, vec_id)
SELECT vec_id, CAST(k AS INTEGER) AS component, n, deviation FROM d, generate_series(1, {TOP}) AS g(k)
"""
}
