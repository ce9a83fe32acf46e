"""Clustering, whitening and search over vectors: brute force, bounds and odd input."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shapeloom.llm import bitslices, centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, cluster string, x int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "own", 1, 0.5) for i, v in rows], SCHEMA)


def vectors(n, dims=64, seed=1, spread=0.15, groups=0):
    r = np.random.default_rng(seed)
    x = r.normal(0, spread, (n, dims))
    if groups:
        x += r.normal(0, 1, (groups, dims))[r.integers(0, groups, n)]
    return [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]


def odd(dims=64):
    v = [0.25] * dims
    return [(900, None), (901, v[:-1] + [None]), (902, v[:-1] + [float("nan")]), (903, v[:-1] + [float("inf")])]


# 11 centroid clustering ---------------------------------------------------------


def lloyd(rows, k=16, rounds=3):
    x = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) for c in v)) for i, v in rows]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [r[1] for r in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in x]

    for _ in range(rounds):
        at = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, g) in zip(x, at, strict=True) if g == j]
            if mine:
                c[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    return sorted((i, g, d) for (i, _), (d, g) in zip(x, assign(), strict=True)), c


@pytest.mark.parametrize("rows", [vectors(300), vectors(200, groups=9), vectors(40, spread=0.01), [(i, [0.5 * (i % 3)] * 64) for i in range(30)], vectors(5)], ids=["spread", "groups", "ties", "equal", "few"])
def test_clusters_agree_with_plain_rounds(spark, rows):
    states, c = centroids.cluster(centroids.integers(table(spark, rows)))
    want, middle = lloyd(rows)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in states.collect()) == want
    assert [tuple(m) for m in c.tolist()] == middle


def test_more_rounds_measure_few_distances(spark):
    rows = vectors(600, groups=16, seed=3)
    states, c = centroids.cluster(centroids.integers(table(spark, rows)), rounds=8)
    want, middle = lloyd(rows, rounds=8)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in states.collect()) == want and [tuple(m) for m in c.tolist()] == middle
    assert states.agg(F.avg("measured")).first()[0] < 8


def test_bounds_hold():
    r = np.random.default_rng(5)
    for trial in range(20):
        k, b = int(r.integers(2, 12)), int(r.integers(1, 4))
        b = min(b, k - 1)
        x, c = r.integers(-6, 6, (80, 3)), r.integers(-6, 6, (k, 3))
        s = centroids.scan(x, c, b)
        for _ in range(4):
            after = c + r.integers(-1, 2, c.shape) * int(r.integers(0, 2))
            moved, c = np.sqrt(((after - c) ** 2.0).sum(1)), after
            s = centroids.settle(x, c, moved, s, b)
            d = ((x[:, None] - c) ** 2).sum(2)
            assert (s["cluster"] == d.argmin(1)).all()  # argmin takes the smaller number of equals
            far = np.sqrt(d)
            at = np.arange(len(x))
            assert (s["upper"] >= far[at, s["cluster"]] - 1e-6).all()
            named = np.zeros(d.shape, bool)
            named[at, s["cluster"]] = True
            for j in range(s["near"].shape[1]):
                assert (s["lows"][:, j] <= far[at, s["near"][:, j]] + 1e-6).all() and not named[at, s["near"][:, j]].any()
                named[at, s["near"][:, j]] = True
            others = np.where(named, np.inf, far).min(1)
            assert (s["rest"] <= others + 1e-6).all()


def test_clustering_of_odd_rows(spark):
    rows = [*vectors(20), *odd(), (904, [0.1] * 63), (905, []), (3, vectors(20)[3][1]), (None, [0.0] * 64)]
    good = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(c is not None and np.isfinite(c) for c in r[1])]
    states, _ = centroids.cluster(centroids.integers(table(spark, rows)))
    key = lambda r: (r[0] is None, r)
    want = sorted(((i, g, d) for i, g, d in _plain(good)), key=key)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in states.collect()), key=key) == want and len(want) == 22
    assert centroids.cluster(centroids.integers(table(spark, [])))[0].count() == 0
    large = centroids.integers(table(spark, [(1, [3e30] * 64)]))
    with pytest.raises(Exception, match="too large"):
        large.collect()


def _plain(rows):
    """``lloyd`` where ids may be null."""
    order = {id(v): k for k, (_, v) in enumerate(rows)}
    hashed = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    x = [(i, tuple(int(np.floor(64 * float(np.float32(c)))) for c in v)) for i, v in rows]
    assert len(order) == len(rows)
    c = [v for _, v in sorted(x, key=lambda r: (hashed(r[0]), r[1]))[:16]]
    for turn in range(4):
        at = [min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in x]
        if turn < 3:
            for j in range(len(c)):
                mine = [v for (_, v), (_, g) in zip(x, at, strict=True) if g == j]
                if mine:
                    c[j] = tuple(sum(col) // len(mine) for col in zip(*mine, strict=True))
    return [(i, g, d) for (i, _), (d, g) in zip(x, at, strict=True)]


# 12 whitening ------------------------------------------------------------------


def test_whitening_against_numpy(spark):
    rows = vectors(400, dims=20, groups=5)
    out = whitening.whiten(whitening.integers(table(spark, [*rows, *odd(20)]))).collect()
    x = np.array([[np.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows])
    v = np.cov(x.T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    assert len(out) == 400 * 8 and {r["n"] for r in out} == {400}
    made = np.full((400, 8), np.nan)
    for r in out:
        made[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert abs(r["explained"] / (e[r["component"] - 1] / np.trace(v)) - 1) < 1e-9
    s = [int(c) for c in x.sum(0)]
    for r in out[::97]:
        assert r["deviation"] == sum((400 * int(a) - b) ** 2 for a, b in zip(x[r["vec_id"]], s, strict=True)) and r["deviation_exact"] is None
    assert np.abs(np.cov(made.T, bias=True) - np.eye(8)).max() < 1e-9 and np.abs(made.mean(0)).max() < 1e-9
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-6
    # each component is the direction of its eigenvalue, whatever its sign
    d = (x - x.mean(0)).T @ made / 400
    assert np.abs(v @ d - d * e[:8]).max() < 1e-6 * e[0] ** 1.5


def test_triangle_in_several_aggregations(spark, monkeypatch):
    rows = whitening.integers(table(spark, vectors(60, dims=9)))
    whole = whitening.fit(rows)
    monkeypatch.setattr(whitening, "PAIRS", 7)
    parted = whitening.fit(rows)
    assert np.allclose(whole.values, parted.values) and np.allclose(whole.vectors, parted.vectors)


def test_whitening_of_odd_rows(spark):
    assert whitening.whiten(whitening.integers(table(spark, []))).count() == 0
    assert whitening.whiten(whitening.integers(table(spark, [(1, []), (2, None)]))).count() == 0
    one = whitening.whiten(whitening.integers(table(spark, [(1, [0.5, 0.25])] * 3))).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(3, 0, None, 0.0, None)}
    flat = whitening.whiten(whitening.integers(table(spark, [(i, [0.1 * i, 0.2 * i, 1.0]) for i in range(6)]))).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: False, 3: True} or {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    assert flat[0]["identity_error"] < 1e-6
    short = whitening.whiten(whitening.integers(table(spark, [(1, [1.0, 2.0]), (2, [0.5]), (None, [0.25, -1.0])]))).collect()
    assert len(short) == 6 and sum(r["vec_id"] is None for r in short) == 2
    wide = whitening.integers(table(spark, [(i, [float(i) * 1e6, 1.0]) for i in range(40)]))
    big = [r for r in whitening.whiten(wide).collect() if r["vec_id"] == 0]
    x = [int(np.floor(1024 * float(np.float32(i * 1e6)))) + 100_000 for i in range(40)]
    exact = (40 * x[0] - sum(x)) ** 2
    assert exact >= 1 << 63 and all(r["deviation"] is None and int(r["deviation_exact"]) == exact for r in big)


# 13 exact top-k search -----------------------------------------------------------


def brute_top(rows, every=50, k=5):
    x = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows]
    out = []
    for a, (i, q) in enumerate(x):
        if i is None or i % every:
            continue
        found = [(sum(s * t for s, t in zip(q, v, strict=False)), j) for b, (j, v) in enumerate(x) if a != b]
        found.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def found(spark, rows, every=50, **build):
    index = bitslices.build(bitslices.integers(table(spark, rows)).repartition(3), F.col("vec_id") % every == 0, **build)
    return sorted((tuple(r) for r in bitslices.search(index, bitslices.packs(index, 4)).collect()), key=str)


@pytest.mark.parametrize("block", [16_384, 70, 64])
@pytest.mark.parametrize("rows", [vectors(500), vectors(260, dims=7, groups=3), [(i, [0.5, -0.25, 0.125 * (i % 2)]) for i in range(240)], [*vectors(150), (1000, [90.0] * 64), (1050, [-250.0] * 64)]], ids=["spread", "short", "ties", "outliers"])
def test_search_agrees_with_brute_force(spark, rows, block):
    assert found(spark, rows, block=block) == brute_top(rows)


def test_search_prunes():
    r = np.random.default_rng(7)
    x = np.floor(256 * r.normal(0, 0.125, (8000, 64))).astype(np.int64)
    shift, h = bitslices.quantise(x, bitslices.BITS)
    middle = ((h - 32) << shift) + ((1 << shift) - 1) / 2
    norm = lambda m: float(np.sqrt((m.astype(float) ** 2).sum(1).max()))
    b = bitslices.Block({"whole": x.astype("<i2").tobytes(), "width": 2, "dims": 64, "ids": list(range(8000)), "block": 0, "shift": shift, "residual": norm(x - middle), "height": norm(h - 32), "slices": bitslices.slices_of(h, 6).tobytes()})
    seen = []
    b.x = _Counting(b.x, seen)
    for i in range(20):
        best = sorted(b.best(x[i], 5, i, None), key=lambda t: -t[1])[:5]
        s = x @ x[i]
        s[i] = np.iinfo(np.int64).min
        assert [t[1] for t in best] == sorted(s.tolist(), reverse=True)[:5]
    assert np.mean(seen) < 0.15 * 8000


class _Counting:
    def __init__(self, x, seen):
        self.x, self.seen, self.shape = x, seen, x.shape

    def __getitem__(self, rows):
        self.seen.append(len(rows))
        return self.x[rows]


def test_bitmap_arithmetic():
    r = random.Random(3)
    for _ in range(50):
        v = r.randrange(-500, 500)
        assert sum(s << k for k, s in bitslices.digits(v)) == v
    g = np.random.default_rng(2)
    h = g.integers(0, 64, (130, 5))
    slabs, q = bitslices.slices_of(h, 6), g.integers(-60, 60, 5)
    slices, taken = bitslices.scores(slabs, ~slabs, q)
    bits = lambda m: np.unpackbits(m.view(np.uint8), bitorder="little")[:130].astype(np.int64)
    total = sum(bits(s) << i for i, s in enumerate(slices))
    assert (total - taken == h @ q).all()
    rows = np.zeros(3 * 8, np.uint8)
    rows[:17] = np.packbits(np.ones(130, bool), bitorder="little")
    rows = rows.view(np.uint64)
    ordered = sorted(total.tolist(), reverse=True)
    for k in (1, 2, 7, 130):
        value = bitslices.kth(slices, rows, k)
        assert value == ordered[k - 1]
        for v in (value, value + 1, 0, -5, 1 << 40):
            assert (bits(bitslices.at_least(slices, rows, v)) == (total >= v)).all()


def test_search_of_odd_rows(spark):
    rows = [*vectors(60, dims=8), (50, vectors(60, dims=8)[50][1]), *odd(8), (None, [1.0] * 8), (None, [1.0] * 8), (100, []), (150, [2.0, 1.0])]
    good = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    assert found(spark, rows) == brute_top(good)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == []
    assert found(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 512)]
    with pytest.raises(Exception, match="too large"):
        found(spark, [(0, [3e30])])
