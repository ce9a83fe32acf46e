"""Benchmark decontamination by template canonicalisation.

A text becomes a template: numbers, names (capitalised words inside a
sentence) and units after a number are replaced by typed placeholders, other
words are lower-cased, punctuation goes.  Windows of ``WIDTH`` template tokens
of all benchmark items form a table, those of all documents another; the two
are joined by the windows' hashes.  Every window carries the words and types of
``REACH`` tokens on either side, so each joined pair is verified on its own:
aligned at the window, stretches where the templates agree form runs, which
equal words carry on whatever their types; in a run the slot values must agree:
one value of the item stands for one value of the document throughout, per
type.  A document leaks an item when such a run covers ``RUN`` tokens, or the
whole item if that is shorter, so copies and re-parameterised questions are
found and chance windows are not.

A word's type depends on where it stands, and windows of slots alone say
little, so templates miss some copies.  Word-for-word copies are therefore
also joined as such: windows of ``RUN`` lower-cased words, or of the whole item
if that is shorter, are leaks wherever they stand and whatever they hold.

Before they leave their task, windows of documents pass a filter of the items'
hashes, whose size follows the number of items and ends at 128 MB; what passes
by chance meets nothing in the join.  The item table is broadcast while it has
no more than ``BROADCAST_ROWS`` rows (below 1 KB each); a larger one is joined
by a shuffle, salted, so that a window that many documents share is met in
``SALT`` tasks.  Documents are read once, whatever the benchmark's size.

Defined results: null and empty texts leak nothing; items with fewer than
``SHORTEST`` tokens, or null, cannot be told from chance and match nothing; a
window of a template needs ``LITERAL`` plain words, a word-for-word copy none;
repeated rows are judged alike; a document is listed once per item, and
repeated item_ids count as one; null ids are ids.  ``clean`` keeps all columns,
whatever their names, and all rows whose own texts leak nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .common import bit_filter, checkpoint, in_filter, small_batches

WIDTH = 8
RUN = 13
LITERAL = 4
SHORTEST = 5
REACH = RUN + WIDTH  # tokens on either side of a window that can matter to its run
BROADCAST_ROWS = 100_000
SALT = 32

#: Units that count as such after a number.
UNITS = "km m cm mm kg g mg lb lbs oz l ml mi ft in yd mph kmh s sec seconds min minutes h hours days weeks months years kb mb gb tb hz khz mhz ghz w kw v a c f usd eur gbp dollars euros pounds percent pct meters metres kilometers kilometres miles feet inches grams kilograms liters litres degrees".split()

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?:\n"]] = True
_MARK = ts.mix(np.array([0, 101, 102, 103], np.uint64))  # literal (unused), number, name, unit


def _hash_of(words: list[str]) -> np.ndarray:
    raw, offsets, _ = ts.text_buffers(pa.array(words))
    return ts.words(raw, offsets, 0, len(words), ts.PUNCT)[3]


_UNITS = np.sort(_hash_of(UNITS))


def _any_case(raw, offsets, a, b, h: np.ndarray) -> np.ndarray:
    """Word hashes of rows a..b-1 with letters of every script lower-cased; ``h`` has the ASCII ones so already."""
    if not (raw[int(offsets[a]) : int(offsets[b])] >= 0x80).any():
        return h
    rows = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(offsets[a : b + 1])), pa.py_buffer(raw))
    low, bounds, _ = ts.text_buffers(pc.utf8_lower(rows))
    return ts.words(low, bounds, 0, b - a, ts.PUNCT)[3]


def templates(raw, offsets, a, b) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word hash, type (0 word, 1 number, 2 name, 3 unit) and template hash of every token of rows a..b-1."""
    rows, starts, ends, h = ts.words(raw, offsets, a, b, ts.PUNCT)
    kind = np.zeros(len(rows), np.int8)
    if not len(rows):
        return rows, h, kind, h
    h = _any_case(raw, offsets, a, b, h)
    base = int(offsets[a])
    stops = np.concatenate([[0], np.cumsum(_ENDS[raw[base : int(offsets[b])]], dtype=np.int64)])
    opens = np.ones(len(rows), bool)
    opens[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:] - base] > stops[ends[:-1] - base])
    c = raw[starts]
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    upper = ((c >= 65) & (c <= 90)) | ((c == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    last = raw[ends - 1]
    lower_end = ((last >= 97) & (last <= 122)) | (last >= 0x80)
    kind[upper & ~opens & lower_end & (ends - starts > 1)] = 2
    number = (c >= 48) & (c <= 57)
    kind[number] = 1
    at = np.searchsorted(_UNITS, h)
    at[at == len(_UNITS)] = 0
    unit = _UNITS[at] == h
    unit[0] = False
    unit[1:] &= number[:-1] & (rows[1:] == rows[:-1])
    kind[unit & ~number] = 3
    return rows, h, kind, np.where(kind == 0, h, _MARK[kind])


_COPY, _HEAD = np.uint64(0x5DEECE66D), np.uint64(0xB5026F5AA96619E9)


def _keyed(value: np.ndarray, kind: np.uint64, width: int) -> np.ndarray:
    """Hashes of windows, apart by kind and width."""
    return ts.mix(value ^ kind ^ np.uint64(width * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _literals(kind, start, w: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(kind == 0)])
    return total[start + w] - total[start]


def _around(rows, word, kind, start: np.ndarray, width: int) -> tuple[list, list, np.ndarray]:
    """Words and types (bytes) of the tokens around windows, and where in them the windows begin."""
    first, last = np.searchsorted(rows, rows[start]), np.searchsorted(rows, rows[start], "right")
    lo, hi = np.maximum(first, start - REACH), np.minimum(last, start + width + REACH)
    return [word[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], [kind[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], start - lo


_ITEM = "item_id long, hash long, width int, need int, words binary, types binary, at int, head boolean"


def index(benchmark: DataFrame) -> DataFrame:
    """Windows of all items.  ``words`` is null for those of word-for-word copies; rows with ``head`` only serve the filter."""

    def run(batches):
        for batch in batches:
            raw, offsets, _ = ts.text_buffers(batch.column("text"))
            ids = batch.column("item_id").cast(pa.int64())
            for a, b in ts.groups(offsets):
                rows, word, kind, template = templates(raw, offsets, a, b)
                size = np.bincount(rows, minlength=b - a)
                for w in sorted({int(min(WIDTH, n)) for n in size if n >= SHORTEST}):
                    value, start = ts.windows(template, rows, w)
                    keep = (np.minimum(size[rows[start]], WIDTH) == w) & (_literals(kind, start, w) >= min(LITERAL, w - 1))
                    value, start = value[keep], start[keep]
                    words, types, at = _around(rows, word, kind, start, w)
                    yield _items(ids, a + rows[start], _keyed(value, np.uint64(0), w), w, np.minimum(size[rows[start]], RUN), words, types, at, False)
                need = np.minimum(size, RUN)
                for w in sorted({int(n) for n in need if n >= SHORTEST}):
                    _, start = ts.windows(word, rows, w)
                    start = start[need[rows[start]] == w]
                    none = [None] * len(start)
                    yield _items(ids, a + rows[start], _keyed(ts.windows_at(word, start, w), _COPY, w), w, need[rows[start]], none, none, np.zeros(len(start), int), False)
                    yield _items(ids, a + rows[start], _keyed(ts.windows_at(word, start, SHORTEST), _HEAD, SHORTEST), SHORTEST, need[rows[start]], none, none, np.zeros(len(start), int), True)

    return benchmark.where("text is not null").select("item_id", "text").distinct().mapInArrow(run, _ITEM).distinct()


def _items(ids, row, hashes, width, need, words, types, at, head) -> pa.RecordBatch:
    n = len(row)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(hashes.view(np.int64)), pa.array(np.full(n, width, np.int32)), pa.array(need.astype(np.int32)), pa.array(words, pa.binary()), pa.array(types, pa.binary()), pa.array(at.astype(np.int32)), pa.array(np.full(n, head))],
        names=[c.split()[0] for c in _ITEM.split(", ")],
    )


_DOC = "doc_id long, text_key long, hash long, d_words binary, d_types binary, d_at int"


def windows_of(docs: DataFrame, widths: list[int], copies: list[int], bits: np.ndarray, shift: int) -> DataFrame:
    """Windows of (doc_id, text_key, text) that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        known = shared.value
        for batch in batches:
            raw, offsets, _ = ts.text_buffers(batch.column("text"))
            ids, keys = batch.column("doc_id"), batch.column("text_key")

            def emit(row, hashes, words, types, at, ids=ids, keys=keys):
                of = pa.array(row)
                return pa.RecordBatch.from_arrays([ids.take(of), keys.take(of), pa.array(hashes.view(np.int64)), pa.array(words, pa.binary()), pa.array(types, pa.binary()), pa.array(np.asarray(at, np.int32))], names=[c.split()[0] for c in _DOC.split(", ")])

            for a, b in ts.groups(offsets):
                rows, word, kind, template = templates(raw, offsets, a, b)
                for w in widths:
                    value, start = ts.windows(template, rows, w)
                    value = _keyed(value, np.uint64(0), w)
                    hit = np.flatnonzero(in_filter(known, shift, value))
                    for i in range(0, len(hit), 4096):
                        some = hit[i : i + 4096]
                        yield emit(a + rows[start[some]], value[some], *_around(rows, word, kind, start[some], w))
                if not copies:
                    continue
                value, start = ts.windows(word, rows, SHORTEST)
                start = start[in_filter(known, shift, _keyed(value, _HEAD, SHORTEST))]
                for w in copies:
                    inside = start[start + w <= len(rows)]
                    inside = inside[rows[inside + w - 1] == rows[inside]]
                    value = _keyed(ts.windows_at(word, inside, w), _COPY, w)
                    hit = in_filter(known, shift, value)
                    # one of a kind is enough: copies need no look at what is around them
                    pairs = np.unique(np.stack([a + rows[inside[hit]], value[hit].view(np.int64)]), axis=1)
                    if pairs.shape[1]:
                        none = [None] * pairs.shape[1]
                        yield emit(pairs[0], pairs[1].view(np.uint64), none, none, np.zeros(pairs.shape[1]))

    return small_batches(docs).mapInArrow(run, _DOC)


def long_run(ours, our_kind, theirs, their_kind, width: int, need: int) -> bool:
    """Whether aligned tokens of an item and a document hold a run of consistent slots that is long enough."""
    n = len(ours)
    same = np.where(our_kind == 0, ours, _MARK[our_kind]) == np.where(their_kind == 0, theirs, _MARK[their_kind])
    hit = np.zeros(n, bool)
    if n >= width:
        agree, plain = (np.lib.stride_tricks.sliding_window_view(x, width).sum(axis=1) for x in (same.astype(int), (our_kind == 0).astype(int)))
        for s in np.flatnonzero((agree == width) & (plain >= min(LITERAL, width - 1))):
            hit[s : s + width] = True
    slots = (our_kind > 0) | (their_kind > 0)
    # with equal words a run may begin earlier and break elsewhere, so either will do
    for joined in (hit, hit | (ours == theirs)):
        stands: dict[tuple[int, int], int] = {}
        begin = 0
        for p in range(n):
            if not joined[p]:
                begin, stands = p + 1, {}
            elif slots[p]:
                value = int(theirs[p])
                if stands.setdefault((int(our_kind[p]), int(ours[p])), value) != value:
                    begin, stands = p + 1, {}
            if p + 1 - begin >= need:
                return True
    return False


def _verified(met: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id) of joined windows that belong to long enough runs."""

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("words", "types", "at", "d_words", "d_types", "d_at", "width", "need")}
            keep = []
            for words, types, at, d_words, d_types, d_at, width, need in zip(*cols.values(), strict=True):
                if words is None or d_words is None:
                    keep.append(words is None and d_words is None)
                    continue
                x, k, y, m = np.frombuffer(words, np.uint64), np.frombuffer(types, np.int8), np.frombuffer(d_words, np.uint64), np.frombuffer(d_types, np.int8)
                before = min(at, d_at)
                size = before + min(len(x) - at, len(y) - d_at)
                i, j = at - before, d_at - before
                keep.append(long_run(x[i : i + size], k[i : i + size], y[j : j + size], m[j : j + size], width, need))
            yield batch.select(["doc_id", "text_key", "item_id"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "doc_id long, text_key long, item_id long")


def found(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id) of every leak, once; ``text_key`` is a hash of the text."""
    items = checkpoint(index(benchmark))
    of = {(r["copy"], r["width"]) for r in items.where("not head").select(F.col("words").isNull().alias("copy"), "width").distinct().collect()}  # at most one row a width
    bits, shift = bit_filter(items.select("hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    hits = windows_of(texts, sorted(w for c, w in of if not c), sorted(w for c, w in of if c), bits, shift)
    table = items.where("not head").drop("head")
    if table.count() <= BROADCAST_ROWS:
        met = hits.join(F.broadcast(table), "hash")
    else:
        spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        met = hits.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALT)).cast("int")).join(spread, ["hash", "_salt"])
    # written before it is verified, so that no task holds two Python workers at once
    return _verified(checkpoint(met)).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every leak, once."""
    return found(docs, benchmark).select("doc_id", "item_id").distinct()


def clean(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 500_000) -> DataFrame:
    """``docs`` without the rows whose texts leak an item."""
    gone = checkpoint(found(docs, benchmark).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t")).distinct())
    small = gone.count() <= max_broadcast
    d, g = docs.alias("d"), (F.broadcast(gone) if small else gone).alias("g")
    return d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g._d")) & (F.xxhash64("d.text") == F.col("g._t")), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE: dict[str, str] = {}
