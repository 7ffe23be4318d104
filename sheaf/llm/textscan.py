"""Vectorised scans over the UTF-8 buffer of an Arrow string column.

Everything here works on one contiguous byte buffer that holds many texts, so that numpy touches each byte a fixed
number of times whatever the number or length of the texts. All hashes are fixed functions of the bytes: executors and
reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Multiplier of the polynomial hash (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
#: Texts are handed on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: One random word per byte value.
BYTE_TABLE = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        step = BASE if kind == "up" else BASE_INV
        size = max(n, SLICE_BYTES + 1)
        have = np.ones(size, dtype=U64)
        done = 1
        while done < size:
            take = min(done, size - done)
            have[done : done + take] = have[:take] * U64(pow(step, done, 1 << 64))
            done += take
        if n <= SLICE_BYTES + 1:
            _powers[kind] = have
    return have[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of bytes i..j-1, shifted by BASE**i."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_TABLE[data] * _power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal bytes give equal hashes wherever they stand."""
    inverse = _power("down", len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def rolling_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that begin at each position."""
    n = len(prefix) - k
    if n <= 0:
        return np.zeros(0, dtype=U64)
    return mix64((prefix[k:] - prefix[:-k]) * _power("down", n))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def buffers(column: pa.Array, kind: pa.DataType = pa.large_string()) -> tuple[np.ndarray, np.ndarray]:  # noqa: B008
    """(bytes, offsets) of a string or, by kind, binary column, offsets of length n + 1 from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(pa.scalar(b"" if pa.types.is_large_binary(kind) else "", column.type))
    column = column.cast(kind)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about limit bytes; every row is in one range."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
