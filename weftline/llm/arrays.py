"""NumPy kernels on whole Arrow batches: texts as one byte buffer with offsets, words and hashes without Python objects.

Two kinds of hashes:

  - of content: word_hashes() adds up one pseudo-random 64-bit value for each (place, byte), so that any two words collide
    with chance 2**-64; Lanes hashes any stretch by polynomials modulo the prime 2**31 - 1 with two bases, 62 bits;
  - of choice only: running() and stretch() are polynomials modulo 2**64, which take the fewest steps but hold some unlike
    strings (Thue-Morse words) for equal. They choose anchors and break ties, and nothing rests on their being different.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def _return_memory() -> None:
    """Python workers live on from task to task: have large arrays go back to the system when they are freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, else it grows to 32 MB
        libc.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


_return_memory()
#: Text bytes that a kernel handles at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values (the finaliser of SplitMix64)."""
    x = np.asarray(x, dtype=U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, U64), np.ones(1, U64)]
BYTE_VALUES = mix64(np.arange(256, dtype=U64) + U64(0x5851F42D4C957F2D))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            x = np.full(size, b, U64)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[k] = x
    return _powers[0][:n], _powers[1][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Running sums for stretch(): values are mixed symbols."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def stretch(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the stretches [start, end)."""
    return mix64((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in order, about limit text bytes at a time: (rows, bytes, offsets). A text is never cut."""
    for batch in batches:
        data, off = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(off, off[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+, and the index of each text's first word (n + 1 values)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~_SPACE[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


#: Places of a word whose values come from a table; those beyond are mixed one by one.
_TABLED = 32
_PLACE = U64(0x9E3779B97F4A7C15)
_TABLE = mix64((np.arange(_TABLED, dtype=U64) * _PLACE)[:, None] + BYTE_VALUES[None, :]).reshape(-1)


def place_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hashes of the stretches [start, end), which do not overlap and are not empty: the sum of a pseudo-random value
    for each place and symbol (a byte, or a number below 2**32)."""
    size = ends - starts
    begin = np.cumsum(size) - size
    if int(size.sum()) != len(symbols):
        symbols = symbols[ragged(starts, size)]
    place = np.arange(len(symbols)) - np.repeat(begin, size)
    if symbols.dtype == np.uint8:
        values = _TABLE[(np.minimum(place, _TABLED - 1) << 8) | symbols]
        far = np.flatnonzero(place >= _TABLED)
        values[far] = mix64(place[far].astype(U64) * _PLACE + BYTE_VALUES[symbols[far]])
    else:
        values = mix64(mix64(place.astype(U64) * _PLACE + U64(0x5851F42D4C957F2D)) + symbols.astype(U64) * U64(0xD6E8FEB86659FD93))
    return mix64(np.add.reduceat(values, begin) + size.astype(U64)) if len(size) else np.zeros(0, U64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hashes of words: stretches of bytes that do not overlap."""
    return place_hashes(data, starts, ends)


_PRIME = U64((1 << 31) - 1)
_LANE_BASES = (0x2F6B3A91, 0x5D1E27C7)
_lane_powers = [np.ones(1, np.uint32) for _ in _LANE_BASES]
#: Inverse powers are products of two: of what is below this, and of its multiples.
_STRIDE = 4096


def _modulo(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for any 64-bit x."""
    x = (x & _PRIME) + (x >> U64(31))
    x = (x & _PRIME) + (x >> U64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _some_powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**31 - 1 for i below n, by doubling: x, then x times base**len(x)."""
    x = np.ones(1, np.uint32)
    while len(x) < n:
        more = _modulo(x[: n - len(x)] * U64(pow(base, len(x), int(_PRIME))))
        x = np.concatenate((x, more.astype(np.uint32)))
    return x


def _lane_table(lane: int, n: int) -> np.ndarray:
    if len(_lane_powers[lane]) < n:
        _lane_powers[lane] = _some_powers(_LANE_BASES[lane], max(n, 1 << 16))
    return _lane_powers[lane][:n]


def _inverse_powers(lane: int, at: np.ndarray) -> np.ndarray:
    """base**-at modulo 2**31 - 1."""
    base = pow(_LANE_BASES[lane], -1, int(_PRIME))
    most = int(at.max()) if len(at) else 0
    far = _some_powers(pow(base, _STRIDE, int(_PRIME)), most // _STRIDE + 1)
    return _modulo(_some_powers(base, _STRIDE)[at % _STRIDE].astype(U64) * far[at // _STRIDE])


class Lanes:
    """Content hashes of any stretches of a sequence: bytes, or 64-bit symbols that are hashes themselves."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.sums = []
        for lane in range(len(_LANE_BASES)):
            if symbols.dtype == np.uint8:
                x = symbols.astype(U64) + U64(1)
            else:
                x = _modulo(mix64(symbols.astype(U64) + U64(lane)))
            x *= _lane_table(lane, len(symbols))
            if symbols.dtype != np.uint8 or len(symbols) > 1 << 23:  # else the sum stays below 2**64 as it is
                x = (x & _PRIME) + (x >> U64(31))
            sums = np.zeros(len(symbols) + 1, U64)
            np.cumsum(x, out=sums[1:])
            self.sums.append(sums)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        one, two = (_modulo(_modulo(s[ends] - s[starts]) * _inverse_powers(lane, starts)) for lane, s in enumerate(self.sums))
        return mix64(((one << U64(31)) | two) + mix64((ends - starts).astype(U64)))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every stretch, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    return np.repeat(starts - shift, lengths) + np.arange(total)
