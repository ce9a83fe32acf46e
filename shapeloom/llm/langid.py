"""Language identification by rank-order n-gram profiles.

Every language gets a profile: its most frequent 1- to 4-byte n-grams (words
lower-cased in ASCII and padded by a blank on both sides), in rank order.  A
document's own most frequent n-grams are compared with each profile by
out-of-place distance: the sum of rank differences, with a fixed penalty for an
n-gram that the profile lacks.  The nearest profile wins, ties by code point.
``score`` is 1 - nearest / second nearest, or 1 - nearest / worst possible with
one language, so 0 (undecided) to 1.

Profiles are fitted on a bounded sample: per language the first ``per_lang``
documents in a hash order of doc_id, each with its whole text.  Prediction
reads every whole text once in Arrow batches; profiles are a few thousand
numbers per language.

Defined results: null texts and texts without a letter are ``und`` with score
0, as is everything when no row has a language; repeated rows are judged alike;
rows with a null doc_id train nothing and are not held out.  Extra columns are
kept; ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as ts

PER_LANG = 400
PROFILE = 400
GRAMS = (1, 2, 3, 4)

_LETTER = ts.PUNCT.copy()
_LETTER[ord("0") : ord("9") + 1] = True  # digits separate words too


def gram_counts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of one text, ascending, and their counts.

    A code is the n-gram's bytes as a number; a gram never spans two words and
    the blank alone is no gram.
    """
    codes, counts = [], []
    for lo in range(0, max(len(raw), 1), ts.CHUNK):
        # three bytes of context after the chunk complete its last grams; those starting there belong to the next
        piece = raw[lo : lo + ts.CHUNK + 3]
        b = np.where(_LETTER[piece], np.uint8(32), ts.LOWER[piece]).astype(np.uint32)
        if lo == 0:
            b = np.concatenate([np.array([32], np.uint32), b])
        if lo + ts.CHUNK + 3 >= len(raw):
            b = np.concatenate([b, np.array([32], np.uint32)])
            last = len(b)
        else:
            last = len(b) - 3
        code, ok = b.copy(), b != 32
        found = [code[:last][ok[:last]]]
        blank = b == 32
        for n in GRAMS[1:]:
            m = len(b) - n + 1
            if m <= 0:
                break
            code = code[:m] << np.uint32(8) | b[n - 1 : n - 1 + m]
            inner = np.zeros(m, bool)  # a blank is allowed at either end only
            for k in range(1, n - 1):
                inner |= blank[k : k + m]
            good = ~inner if n > 2 else ~(blank[:m] & blank[1 : 1 + m])
            good[last:] = False
            found.append(code[good])
        u, c = np.unique(np.concatenate(found), return_counts=True)
        codes.append(u)
        counts.append(c)
    if len(codes) == 1:
        return codes[0], counts[0]
    u, at = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def ranking(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes first, ties by code."""
    if len(codes) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


def _fold(folds: int = 4):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def train(docs: DataFrame, held: int = 2, per_lang: int = PER_LANG, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles from rows outside the held-out fold that have a language and a text."""
    from pyspark.sql import Window

    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (_fold() != held))
    # the k-th smallest hash of each language, by a partial aggregate that keeps no more than a bounded summary
    first = rows.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id")
    total = F.broadcast(first.groupBy("lang").agg(F.count("*").alias("n")))  # one row a language, as the profiles have
    # about twice the bound passes; the window then sees only those
    few = first.join(total, "lang").where((F.col("h").cast("double") / 2.0**64 + 0.5) <= F.lit(2.0 * per_lang + 50) / F.col("n"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("doc_id").distinct()
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        total: dict[str, list] = {}
        for batch in batches:
            raw, offsets, _ = ts.text_buffers(batch.column("text"))
            for i, lang in enumerate(batch.column("lang").to_pylist()):
                total.setdefault(lang, []).append(gram_counts(raw[offsets[i] : offsets[i + 1]]))
        for lang, parts in total.items():
            u, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    sample = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), "doc_id").drop("doc_id")
    counts = sample.mapInArrow(run, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    out: dict[str, list[int]] = {}
    for r in counts.withColumn("k", F.row_number().over(best)).where(F.col("k") <= size).orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in sorted(out.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    docs = docs.drop("lang_pred", "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    langs = sorted(profiles)
    known = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.int64)
    place = np.full((len(langs), len(known) + 1), size, np.int64)  # last column: grams in no profile
    for i, lang in enumerate(langs):
        place[i, np.searchsorted(known, profiles[lang])] = np.arange(len(profiles[lang]))
    shared = docs.sparkSession.sparkContext.broadcast((langs, known, place))

    def judge(raw: np.ndarray, langs, known, place) -> tuple[str, float]:
        codes, counts = gram_counts(raw)
        if not len(codes) or not langs:
            return "und", 0.0
        top = ranking(codes, counts, size).astype(np.int64)
        at = np.searchsorted(known, top)
        at[at == len(known)] = 0
        at = np.where(known[at] == top, at, len(known))
        cost = place[:, at]
        cost = np.where(cost == size, size, np.abs(cost - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(cost, kind="stable")
        second = cost[order[1]] if len(order) > 1 else size * len(top)
        return langs[order[0]], float(1 - cost[order[0]] / second) if second else 0.0

    def run(batches):
        langs, known, place = shared.value
        for batch in batches:
            raw, offsets, _ = ts.text_buffers(batch.column("text"))
            out = [judge(raw[offsets[i] : offsets[i + 1]], langs, known, place) if has_letter(raw[offsets[i] : offsets[i + 1]]) else ("und", 0.0) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(raw: np.ndarray) -> bool:
    """Whether a text has a letter of any script."""
    if _ASCII_LETTER[raw].any():
        return True
    return bool((raw >= 0x80).any()) and any(c.isalpha() for c in raw.tobytes().decode("utf-8", "ignore"))


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language; documents whose crc32(doc_id) mod 4 is 2 are held out from training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = train(docs.select("doc_id", "text", "lang"))
    held = F.coalesce(_fold() == 2, F.lit(False))
    return predict(docs.select("doc_id", "text"), profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
