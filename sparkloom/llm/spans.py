"""Numpy over the raw bytes of many texts at once: blocks of an Arrow batch, words, and hashes of any span.

A span's hash holds two polynomials in its units, at two random points of the field of P = 2**31 - 1 elements, each from
running sums, so the hash of any span costs O(1): (S[end] - S[start]) * BASE**-start. A field has no words like those
that collide at every point modulo a power of two: of two different spans of n units, at most n of the P points, for
each polynomial, give one value. Units count by 62 bits of a 64-bit value, 31 for each polynomial; results are mixed after.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
P = (1 << 31) - 1
_P, _31 = _U(P), _U(31)
_RANDOM = np.random.default_rng(20240229)
#: The two points, drawn once: copies on different machines must agree.
BASES = tuple(_RANDOM.integers(1 << 20, P - 1, 2).tolist())
#: Random values of the 256 bytes.
BYTES = _RANDOM.integers(1, 1 << 62, 256, dtype=_U)

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, np.ndarray] = {}


#: A worker keeps so many powers, and makes more anew for a longer block.
KEPT_POWERS = (1 << 20) + (1 << 16)


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo P, for any 64-bit x (in place, where x is an array of the caller's own)."""
    for _ in range(2):
        high = x >> _31
        x &= _P
        x += high
    np.subtract(x, _P, out=x, where=x >= _P)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**j modulo P for j < n."""
    found = _powers.get(base)
    if found is not None and len(found) >= n:
        return found[:n]
    size = 1 << max(16, (n - 1).bit_length())
    out = np.ones(size, _U)
    done = 1
    while done < size:
        out[done : 2 * done] = fold(out[:done] * _U(pow(base, done, P)))
        done *= 2
    if size <= 1 << (KEPT_POWERS - 1).bit_length():
        _powers[base] = out
    return out[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits over all bits."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def sums(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums S of length n + 1 over 64-bit units, for each of the two polynomials."""
    out = []
    for k, base in enumerate(BASES):
        s = np.zeros(len(units) + 1, _U)
        u = (units >> _U(31 * k)) & _P
        u *= powers(base, len(units))
        np.cumsum(fold(u), out=s[1:])  # exact: the values of up to 2**33 units stay below 2**64
        out.append(s)
    return out[0], out[1]


def hashes(s: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of the units summed in `s`."""
    found = []
    for base, x in zip(BASES, s, strict=True):
        d = fold(x[end] - x[start])
        d *= powers(pow(base, -1, P), len(x))[start]
        found.append(fold(d))
    return mix((found[0] << _31) | found[1])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, which bounds what a step over them holds and sends at once; a batch's memory goes back."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def give_back() -> None:
    """Hand what the allocators keep back to the system: workers stay between tasks, and several share an executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    n = len(column)
    if not n:
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8" if wide else "i4")[column.offset : column.offset + n + 1].astype("i8")
    return (np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")), at


def blocks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [first, last) of a column at a time, about `size` bytes each: first, last, bytes, offsets from 0."""
    data, at = texts(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        last = min(last, n)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross a text: start, end, and each text's first run (n + 1 numbers)."""
    n = len(inside)
    if not n:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(len(offsets), "i8")
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Word characters of the contract's pattern: all but space and \x09 to \x0D.
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: Letters, taking every byte beyond ASCII as part of one.
LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
