"""k-means over fixed-point vectors with Drake's adaptive distance bounds.

A vector's state is its cluster, an upper bound of the distance to it, lower
bounds to its ``b`` next-nearest centroids (each by number) and one lower bound
for all the remaining ones.  When centroids move, bounds move with them: the
upper one up by what its own centroid moved, a lower one down by what its
centroid moved, the remainder down by the largest move.  From the right, the
least of the bounds up to each position covers all centroids from there on.
If the upper bound is below the first of these, nothing is computed; else the
upper bound is made exact and, if that does not do, only the centroids before
the first position that certifies the rest are measured and ordered anew.  If
no position certifies, all centroids are scanned.  Certificates are strict and
leave room for rounding, so ties always come to exact integer distances, and
the smaller number wins.  ``b`` starts at a quarter of k and falls to the
number of positions that a round needed (an eighth of k at least).

Vectors stay in their partitions: a round is one scan that writes the states
to the shared folder and one partial aggregate of k rows of sums.  Only
centroids and counts (k rows) reach the driver.  The states of the round before
are deleted once the next ones are written.

Defined results: vectors that are null, of another length than ``dims``, or
with null or non-finite components get no row; repeated ids are vectors of
their own; a null id is an id, last in the order of starting centroids; fewer
vectors than k give fewer clusters; an empty table gives an empty result.
Equal hashes start in the order of their components.  Components of 2**27 or
more after scaling raise an error, as distances would not fit a long.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch
from .vectors import fixed, lists_of, rows_of, sound

DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
BITS = 27
_STATE = "vec_id long, q array<int>, cluster int, upper double, near array<int>, lows array<double>, rest double, used int, measured int, distance long"


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q) of the vectors that take part."""
    v = F.col(f"`{vec_col}`")
    whole = df.where((F.size(v) == dims) & sound(v))
    return whole.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(fixed(v, scale, BITS), lambda x: x.cast("int")).alias("q"))


def start(vectors: DataFrame, k: int = K, seed: str = "1:") -> np.ndarray:
    """Starting centroids: the vectors of the k smallest hashes of ``seed`` and id."""
    mark = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = vectors.select(mark.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return np.array([r["q"] for r in first], np.int64) if first else np.zeros((0, 0), np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x (n, d) to centroids c: (k, d) for all of them, or (n, m, d) for some of each row."""
    large = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) >= 1 << 22
    x, c = (x, c) if large else (x.astype(np.float64), c.astype(np.float64))  # whole numbers below 2**53
    if c.ndim == 2:
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    gap = x[:, None, :] - c
    return (gap * gap).sum(2).astype(np.int64)


def scan(x: np.ndarray, c: np.ndarray, b: int) -> dict:
    """The state of rows from distances to all centroids."""
    d = _squared(x, c)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    n = len(x)
    rest = far[:, b + 1] if len(c) > b + 1 else np.full(n, np.inf)
    return {"cluster": order[:, 0].copy(), "upper": far[:, 0].copy(), "near": order[:, 1 : b + 1].copy(), "lows": far[:, 1 : b + 1].copy(), "rest": rest.copy(), "used": np.full(n, b), "measured": np.full(n, len(c))}


def _certain(upper: np.ndarray, low: np.ndarray) -> np.ndarray:
    return upper * (1 + 1e-9) + 1e-9 < low


def settle(x: np.ndarray, c: np.ndarray, moved: np.ndarray, s: dict, b: int) -> dict:
    """The states of rows after their centroids moved to ``c`` by ``moved``; ``b``: how many single bounds to keep."""
    cluster, upper = s["cluster"].copy(), s["upper"] + moved[s["cluster"]]
    near, lows = s["near"].copy(), np.maximum(s["lows"] - moved[s["near"]], 0)
    rest = np.maximum(s["rest"] - moved.max(initial=0), 0)
    if near.shape[1] > b:
        rest = np.minimum(rest, lows[:, b:].min(1))
        near, lows = near[:, :b].copy(), lows[:, :b].copy()
    covers = np.minimum.accumulate(np.column_stack([lows, rest])[:, ::-1], axis=1)[:, ::-1]
    used, measured = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(~_certain(upper, covers[:, 0]))
    if len(open_):
        upper[open_] = np.sqrt(_squared(x[open_], c[cluster[open_]][:, None])[:, 0])
        measured[open_] = 1
        open_ = open_[~_certain(upper[open_], covers[open_, 0])]
    fits = _certain(upper[open_, None], covers[open_])
    place = np.where(fits.any(1), fits.argmax(1), b + 1)
    for p in np.unique(place):
        rows = open_[place == p]
        if p > b:
            full = scan(x[rows], c, b)
            for name, column in (("cluster", cluster), ("upper", upper), ("near", near), ("lows", lows), ("rest", rest)):
                column[rows] = full[name]
            used[rows], measured[rows] = b, measured[rows] + len(c)
            continue
        some = np.sort(np.column_stack([cluster[rows], near[rows, :p]]), axis=1)
        d = _squared(x[rows], c[some])
        order = np.argsort(d, axis=1, kind="stable")
        some, far = np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        cluster[rows], upper[rows], near[rows, :p], lows[rows, :p] = some[:, 0], far[:, 0], some[:, 1:], far[:, 1:]
        used[rows], measured[rows] = p, measured[rows] + p
    return {"cluster": cluster, "upper": upper, "near": near, "lows": lows, "rest": rest, "used": used, "measured": measured}


def _pass(source: DataFrame, c: np.ndarray, moved: np.ndarray | None, b: int) -> DataFrame:
    """States of all vectors: from scratch where ``moved`` is None, else from the states before."""
    dims = c.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = rows_of(batch.column("q"), dims).astype(np.int64)
            if moved is None:
                s = scan(x, c, b)
            else:
                wide = len(batch.column("near")[0])
                before = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("cluster", "upper", "rest")}
                s = settle(x, c, moved, before | {name: rows_of(batch.column(name), wide) for name in ("near", "lows")}, b)
            own = _squared(x, c[s["cluster"]][:, None])[:, 0]
            s["upper"] = np.sqrt(own.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("q"), pa.array(s["cluster"], pa.int32()), pa.array(s["upper"]), lists_of(s["near"], pa.int32()), lists_of(s["lows"], pa.float64()), pa.array(s["rest"]),
                 pa.array(s["used"], pa.int32()), pa.array(s["measured"], pa.int32()), pa.array(own)],
                names=["vec_id", "q", "cluster", "upper", "near", "lows", "rest", "used", "measured", "distance"],
            )

    return source.mapInArrow(run, _STATE)


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """States (vec_id, cluster, distance, measured and the bounds) of vectors (vec_id, q) after ``rounds`` rounds, and the centroids.

    measured: how many distances the last assignment computed for the vector.
    """
    spark = vectors.sparkSession
    c = start(vectors, k, seed)
    if not len(c):
        return spark.createDataFrame([], _STATE), c
    b, moved, path = min(max(1, k // 4), len(c) - 1), None, None
    source = vectors
    for i in range(rounds + 1):
        new = scratch(spark, f"centroids{i}")
        _pass(source, c, moved, b).write.parquet(new)
        if path:
            discard(spark, path)
        path, source = new, spark.read.parquet(new)
        if i == rounds:
            return source, c
        sums = source.groupBy("cluster").agg(F.count("*").alias("n"), F.max("used").alias("used"), *(F.sum(F.col("q")[j].cast("long")).alias(f"s{j}") for j in range(c.shape[1]))).collect()
        after = c.copy()
        for r in sums:
            after[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(c.shape[1])]
        gap = (after - c).astype(np.float64)
        moved, c = np.sqrt((gap * gap).sum(1)) * (1 + 1e-12), after
        b = min(b, max(1, k // 8, *(r["used"] for r in sums)))


def digest(centroid) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, squared distance and inertias of every vector."""
    states, c = cluster(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    per = states.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows
    total = sum(r["cluster_inertia"] for r in per)
    known = spark.createDataFrame([(r["cluster"], r["cluster_inertia"], total, digest(c[r["cluster"]])) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return states.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of the same rounds, each against all centroids."""
    parts = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS q FROM embeddings WHERE len(embedding) = {DIMS} AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = {DIMS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS c, q FROM v QUALIFY c < {k})",
    ]
    for i in range(rounds + 1):
        distance = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)])"
        parts.append(f"d{i} AS (SELECT r, vec_id, v.q, c, CAST({distance} AS BIGINT) AS d FROM v, c{i} AS c)")
        parts.append(f"a{i} AS (SELECT r, vec_id, q, c, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, j, CAST(sum(q[j]) AS BIGINT) AS s, count(*) AS n FROM a{i}, generate_series(1, {DIMS}) AS g(j) GROUP BY c, j)")
            parts.append(f"m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS q FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS (SELECT o.c, coalesce(m.q, o.q) AS q FROM c{i} AS o LEFT JOIN m{i} AS m ON m.c = o.c)")
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,"
        f" sha256(array_to_string(k.q, ',')) AS centroid_sha256 FROM {last} AS a JOIN c{rounds} AS k ON k.c = a.c"
    )


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLE = {"op11_centroid_clustering": _sql()}
