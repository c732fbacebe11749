"""Whole texts of an Arrow column as flat numpy arrays: bytes, words and their hashes.

Everything works on bytes, so a text of any length and any UTF-8 content is read as a
whole. A null text has no bytes. Word hashes are 64-bit polynomial hashes of the bytes,
mixed, the same on every machine and in every run.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are read in slices of about so many bytes, so that arrays stay in the cache.
CHUNK = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA0761D6478BD642F)
    x ^= x >> U64(32)
    return x


#: A value for each byte, so that texts of one repeated byte don't hash alike.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))

_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        step = np.full(max(n, CHUNK + 1), _BASE if which == "up" else _INVERSE, U64)
        step[0] = 1
        _powers[which] = np.cumprod(step, dtype=U64)
    return _powers[which][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any stretch follows by one subtraction."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _power("up", len(values)), out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the stretches [start, end), wherever they stand."""
    down = _power("down", len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(_BASE))


def gram_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of the stretch of ``size`` that starts at each place."""
    n = max(len(prefix) - size, 0)
    if not n:
        return np.zeros(0, U64)
    out = (prefix[size:] - prefix[:n]) * _power("down", len(prefix))[:n]
    out += U64((size * _BASE) % (1 << 64))
    return mix(out)


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and the first place of each distinct key in it."""
    order = np.argsort(keys)
    ordered = keys[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, first


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], ... start[0]+size[0]-1, start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each text starts (one more than texts)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Rows [first, last) of about ``size`` bytes; a longer text makes one of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def _classes(inside) -> np.ndarray:
    return np.array([inside(b) for b in range(256)], bool)


def _alnum(b: int) -> bool:
    return b >= 0x80 or chr(b).isalnum()


#: Bytes of words: all but white space; or digits, letters and whatever isn't ASCII.
SPACED = _classes(lambda b: b not in (0x20, *range(0x09, 0x0E)))
ALNUM = _classes(_alnum)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of some texts: their bytes lie in ``data`` at [start, end), and a byte that
    belongs to no word follows each. ``offsets`` are the texts' first words."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray
    text_start: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self) -> np.ndarray:
        return stretch_hashes(prefix_hashes(BYTE_VALUES[self.data]), self.start, self.end)


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = False) -> Words:
    """Cut texts into words of the bytes in ``inside``; no word crosses texts."""
    spaced = np.insert(data, offsets[1:], 0x0A) if len(offsets) > 1 else data
    if lower:
        spaced = LOWER[spaced]
    text_start = offsets + np.arange(len(offsets))
    member = np.zeros(len(spaced) + 1, np.int8)
    member[1:] = inside[spaced]
    edge = np.diff(member)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Words(spaced, start, end, np.searchsorted(start, text_start), text_start)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other, as an Arrow column."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(
        np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def pack(array: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(array), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind) -> np.ndarray:
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, size, codec="zstd") if size else b"", kind)
