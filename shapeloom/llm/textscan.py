"""Vectorised byte scans over Arrow string columns.

Words are maximal runs of bytes that a 256-entry table does not mark as
separators.  A word's hash is a polynomial over its bytes modulo 2**64, taken
from one running sum per chunk, so no Python loop runs over words.  Chunks are
about half a megabyte and are cut between documents or at separators: peak memory
follows the chunk, not the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

#: Separators of the word rule ``[^\\x20\\x09-\\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Everything but ASCII letters, digits and bytes of multi-byte characters.
PUNCT = np.ones(256, bool)
PUNCT[ord("a") : ord("z") + 1] = PUNCT[ord("A") : ord("Z") + 1] = False
PUNCT[ord("0") : ord("9") + 1] = PUNCT[0x80:] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_B = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        size = max(n, CHUNK + 4096)
        for name, base in (("p", _B), ("i", pow(_B, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POW[name] = np.cumprod(steps, dtype=np.uint64)
    return _POW["p"], _POW["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and a null mask of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    nulls = np.asarray(column.is_null())
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets, nulls


def groups(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows whose texts together hold about ``size`` bytes; a longer text is alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def _pieces(raw: np.ndarray, lo: int, hi: int, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    while hi - lo > CHUNK:
        cut = lo + CHUNK
        while cut < hi:
            found = np.flatnonzero(separator[raw[cut : min(hi, cut + 4096)]])
            if len(found):
                cut += int(found[0])
                break
            cut = min(hi, cut + 4096)
        yield lo, cut
        lo = cut
    if hi > lo:
        yield lo, hi


def _running(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return total, inverse


def words(
    raw: np.ndarray,
    offsets: np.ndarray,
    a: int,
    b: int,
    separator: np.ndarray = SPACE,
    lower: bool = True,
    prefixes: tuple[int, ...] = (),
) -> tuple[np.ndarray, ...]:
    """Words of rows a..b-1: row (from 0), start, end (bytes in ``raw``), hash, then a hash per prefix length.

    A prefix hash is 0 where the word is not longer than the prefix.
    """
    out: list[list[np.ndarray]] = [[] for _ in range(4 + len(prefixes))]
    bounds = offsets[a : b + 1]
    for lo, hi in _pieces(raw, int(bounds[0]), int(bounds[-1]), separator):
        piece = raw[lo:hi]
        inside = np.zeros(len(piece) + 2, np.int8)
        inside[1:-1] = ~separator[piece]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = bounds[(bounds > lo) & (bounds < hi)] - lo
        if len(cuts):  # a document boundary inside a run ends one word and begins another
            cuts = np.unique(cuts)
            cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        if not len(starts):
            continue
        total, inverse = _running(LOWER[piece] if lower else piece)
        out[0].append(np.searchsorted(bounds, starts + lo, "right") - 1)
        out[1].append(starts + lo)
        out[2].append(ends + lo)
        out[3].append(mix((total[ends] - total[starts]) * inverse[starts]))
        for k, length in enumerate(prefixes):
            stop = np.minimum(starts + length, len(piece))
            value = mix((total[stop] - total[starts]) * inverse[starts] + np.uint64(length))
            value[ends - starts <= length] = 0
            out[4 + k].append(value)
    kinds = (np.int64, np.int64, np.int64, np.uint64) + (np.uint64,) * len(prefixes)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(out, kinds, strict=True))


_C = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def windows(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``width``-word window that stays in one row, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value += hashes[k : k + n] * _C[k]
    first = np.flatnonzero(rows[:n] == rows[width - 1 : width - 1 + n])
    return mix(value[first]), first


def windows_at(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word windows that begin at the given words."""
    value = np.zeros(len(first), np.uint64)
    for k in range(width):
        value += hashes[first + k] * _C[k]
    return mix(value)


def whole(hashes: np.ndarray) -> np.uint64:
    """Hash of a sequence shorter than a window, apart from every window's hash."""
    value = np.uint64(len(hashes) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
    for k, x in enumerate(hashes):
        value = np.uint64((int(value) + int(x) * int(_C[k + 8])) & (1 << 64) - 1)
    return mix(np.array([value], np.uint64))[0]
