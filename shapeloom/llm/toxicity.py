"""Toxicity: a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the 4-, 5- and
6-byte beginnings of longer words (inflected forms share them), hashed into
2**18 buckets.  The score is the logistic of a linear part plus all pairwise
products of term factors, so two terms can say together (an insult and a
mention of a group) what neither says alone.

Terms are kept where they go with the label on their own (chi-square; of more than
``keep``, 2,048, those that do most), or, of the ``frequent`` (512) commonest others, in a pair with another such term: where the
label's rate with both differs from what the rates with each alone add up to.

The model is fitted on a bounded sample of labelled rows: at most
``per_class`` documents of each label, the first in a hash order of doc_id, so
that reruns agree.  Counts of the sample's terms are taken by Spark; the driver
gets one row a bucket, and of each document only the terms that may be kept, so
what it holds does not follow the lengths of texts.  Both labels weigh alike in it; the intercept then moves a
quarter of the way to the labels' true base rate, which spares clean documents
where few labels are known and costs little where many are.
Scoring reads every whole text once, in Arrow batches, with the model (about
1.3 MB whatever the corpus) in a broadcast.

Defined results: null and empty texts have no terms and get the intercept's
score; repeated rows are scored alike; a null doc_id is not held out and takes
no label; conflicting labels of an id count as toxic; with labels of one class
only, every score is that class's rate.  Columns beside the text are kept as
they are and may have any name but ``score`` and ``predicted``, which are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts
from .common import checkpoint, small_batches

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
PER_CLASS = 3000
KEEP = 2048
FREQUENT = 512


@dataclass
class Model:
    feature: np.ndarray  # bucket -> position of a kept term, or -1
    weight: np.ndarray
    factor: np.ndarray  # terms x rank
    bias: float

    def scores(self, rows: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Of n documents, given (row, kept term) pairs without repeats."""
        z = np.full(n, self.bias)
        if len(rows):
            z += np.bincount(rows, self.weight[terms], n)
            for v in self.factor.T:
                x = v[terms]
                z += 0.5 * (np.bincount(rows, x, n) ** 2 - np.bincount(rows, x * x, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def term_pairs(raw, offsets, a, b) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of rows a..b-1."""
    rows, _, _, *hashes = ts.words(raw, offsets, a, b, ts.PUNCT, True, PREFIXES)
    key = np.concatenate([(rows[h != 0] << 18) | (h[h != 0] >> np.uint64(46)).astype(np.int64) for h in hashes])
    key = np.unique(key)
    return key >> 18, key & (BUCKETS - 1)


def candidates(df: np.ndarray, pos: np.ndarray, n: int, share: float, keep: int = KEEP, frequent: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Terms that go with the label, by the documents they are in and those of them that are positive; and the commonest others."""
    chi = np.where(df >= 4, (pos - df * share) ** 2 / np.maximum(df * share * (1 - share) * (1 - df / n), 1e-9), 0)
    alone = np.argsort(-chi, kind="stable")[:keep]
    alone = np.sort(alone[chi[alone] > 6.63])  # one in a hundred by chance
    both_ways = np.where((df >= 20) & (df <= n - 20), np.minimum(df, n - df), 0)
    both_ways[alone] = 0
    common = np.argsort(-both_ways, kind="stable")[:frequent]
    return alone, np.sort(common[both_ways[common] > 0])


def interacting(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Those of the common terms that go with the label in a pair: rates of both, one and neither that do not add up, by six deviations."""
    if len(common) < 2:
        return common[:0]
    place = np.full(BUCKETS, -1, np.int16)
    place[common] = np.arange(len(common))
    at = place[terms]
    mine = at >= 0
    x = np.zeros((len(y), len(common)), np.float32)
    x[rows[mine], at[mine]] = 1
    positive = x[y == 1]
    # documents with both of a pair, and positive ones of them; those with one and with neither follow
    size, hits = (x.T @ x).astype(float), (positive.T @ positive).astype(float)
    df, pos, n, p = np.diag(size).copy(), np.diag(hits).copy(), len(y), len(positive)
    cells = (
        (1, size, hits),
        (-1, df[:, None] - size, pos[:, None] - hits),
        (-1, df[None] - size, pos[None] - hits),
        (1, n - df[:, None] - df[None] + size, p - pos[:, None] - pos[None] + hits),
    )
    contrast, variance, enough = np.zeros_like(size), np.zeros_like(size), ~np.eye(len(common), dtype=bool)
    for sign, total, good in cells:
        rate = (good + 0.5) / (total + 1)
        contrast += sign * rate
        variance += rate * (1 - rate) / np.maximum(total, 1)
        enough &= total >= 10
    return common[(enough & (np.abs(contrast) > 6 * np.sqrt(variance))).any(axis=1)]


def fit(rows: np.ndarray, terms: np.ndarray, y: np.ndarray, rate: float = 0.5, rank: int = 4, keep: int = KEEP, epochs: int = 12, seed: int = 7, frequent: int = FREQUENT) -> Model:
    """Adagrad on the logistic loss, classes weighed alike.

    rate is the share of label 1 among all labels.
    """
    n, feature = len(y), np.full(BUCKETS, -1, np.int32)
    base = np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))
    if n == 0 or y.min() == y.max():
        return Model(feature, np.zeros(1), np.zeros((1, rank)), float(base))
    share = y.mean()
    alone, common = candidates(np.bincount(terms, minlength=BUCKETS), np.bincount(terms, y[rows], BUCKETS), n, share, keep, frequent)
    kept = np.union1d(alone, interacting(rows, terms, y, common))
    feature[kept] = np.arange(len(kept))
    f = feature[terms]
    rows, f = rows[f >= 0], f[f >= 0]
    order = np.argsort(rows, kind="stable")
    rows, f = rows[order], f[order]
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    at = np.searchsorted(rows, np.arange(n + 1))
    rng, m = np.random.default_rng(seed), max(len(kept), 1)
    w, v, b = np.zeros(m), rng.normal(0, 0.01, (m, rank)), 0.0
    gw, gv, gb = np.full(m, 1e-6), np.full((m, rank), 1e-6), 1e-6
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
            spans = [np.arange(at[i], at[i + 1]) for i in batch]
            r = np.repeat(np.arange(len(batch)), [len(s) for s in spans])
            t = f[np.concatenate(spans)] if spans else np.zeros(0, int)
            model = Model(feature, w, v, b)
            err = (model.scores(r, t, len(batch)) - y[batch]) * cost[batch] / len(batch)
            seen = np.unique(t)
            e = err[r]
            g = np.bincount(t, e, m)[seen] + 1e-5 * w[seen]
            gw[seen] += g * g
            w[seen] -= 0.1 * g / np.sqrt(gw[seen])
            for k in range(rank):
                x = v[t, k]
                total = np.bincount(r, x, len(batch))
                g = np.bincount(t, e * (total[r] - x), m)[seen] + 1e-3 * v[seen, k]
                gv[seen, k] += g * g
                v[seen, k] -= 0.02 * g / np.sqrt(gv[seen, k])
            gb += err.sum() ** 2
            b -= 0.05 * err.sum() / np.sqrt(gb)
    return Model(feature, w, v, float(b + 0.25 * base))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, held: int = 0, folds: int = 5, keep: int = KEEP, frequent: int = FREQUENT) -> Model:
    """Fit on labelled rows outside the held-out fold; the sample holds ``2 * per_class`` ids at most.

    keep and frequent bound the model: terms kept on their own, and others
    looked at in pairs (a matrix of frequent**2 counts on the driver).
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.where("toxic in (0, 1)").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = totals.get(1, 0) / max(sum(totals.values()), 1)
    picked = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("terms", T.BinaryType())])

    def run(batches):
        for batch in batches:
            raw, offsets, _ = ts.text_buffers(batch.column("text"))
            out = []
            for a, b in ts.groups(offsets):
                rows, terms = term_pairs(raw, offsets, a, b)
                cut = np.searchsorted(rows, np.arange(b - a + 1))
                out += [terms[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("toxic").cast(pa.int32()), pa.array(out, pa.binary())], names=["doc_id", "toxic", "terms"])

    sample = checkpoint(small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(run, schema))

    def each(batches):
        for batch in batches:
            arrays = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("terms")]
            toxic = np.repeat(np.asarray(batch.column("toxic")), [len(x) for x in arrays])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["term", "toxic"])

    counted = sample.mapInArrow(each, "term long, toxic long").groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("pos")).toArrow()  # one row a bucket
    df, pos = np.zeros(BUCKETS), np.zeros(BUCKETS)
    df[counted["term"].to_numpy()], pos[counted["term"].to_numpy()] = counted["df"].to_numpy(), counted["pos"].to_numpy()
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    wanted = np.zeros(BUCKETS, bool)
    if 0 < positive < n:
        wanted[np.concatenate(candidates(df, pos, n, positive / n, keep, frequent))] = True

    def chosen(batches):
        for batch in batches:
            few = [x[wanted[x]].tobytes() for x in (np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column("terms"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(few, pa.binary())], names=["doc_id", "toxic", "terms"])

    known = sample.mapInArrow(chosen, schema).toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    arrays = [np.frombuffer(x.as_buffer(), np.uint32) for x in known["terms"]]
    rows = np.repeat(np.arange(len(arrays), dtype=np.int32), [len(x) for x in arrays])
    terms = np.concatenate(arrays).view(np.int32) if arrays else np.zeros(0, np.int32)
    return fit(rows, terms, np.array(known["toxic"].to_pylist(), float), rate, keep=keep, frequent=frequent)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; every whole text is read once."""
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, offsets, _ = ts.text_buffers(batch.column("text"))
            out = np.zeros(batch.num_rows)
            for a, b in ts.groups(offsets):
                rows, terms = term_pairs(raw, offsets, a, b)
                kept = m.feature[terms]
                out[a:b] = m.scores(rows[kept >= 0], kept[kept >= 0], b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return small_batches(docs).mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity; documents whose crc32(doc_id) mod 5 is 0 are held out from training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
