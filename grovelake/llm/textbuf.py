"""Whole texts as numpy buffers: words, their hashes and byte n-grams, without a Python step per row."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
#: A text without such a character is blank: it has nothing but ASCII white space. Java and Python read it alike.
SOLID = re.compile(r"[^\x09-\x0d\x1c-\x20]")

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _FOLDED[_c] = 0
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for k, base in ((0, _R), (1, _RINV)):
            a = np.full(1 << (n - 1).bit_length() if n > 1 else 1, U64(base), U64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(29))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(32))


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes, a longer text alone; null is as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offs = np.frombuffer(buffers[1], kind, n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
        yield row, data[offs[row] : offs[last]], offs[row : last + 1] - offs[row]
        row = last


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end) of the runs without white space."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; folded: without ASCII case and closing ASCII punctuation."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if folded else _BYTE)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Every run of n <= 8 bytes as an integer, by its first byte."""
    width, kind = (4, "<u4") if n <= 4 else (8, "<u8")
    if len(data) < n:
        return np.zeros(0, kind)
    padded = np.concatenate([data, np.zeros(width - 1, np.uint8)])
    grams = np.ndarray((len(data) - n + 1,), kind, padded, 0, (1,))
    return grams & np.dtype(kind).type((1 << 8 * n) - 1) if n != width else grams.copy()


def segment_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of values[lo:hi] for each pair; 0 where hi <= lo."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:], dtype=np.float64)
    hi = np.clip(np.maximum(hi, lo), 0, len(values))
    return total[hi] - total[np.clip(lo, 0, len(values))]
