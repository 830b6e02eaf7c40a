"""Vectorised text kernels over Arrow string columns: words, their 64-bit hashes, shingles.

Everything works on the UTF-8 bytes of a whole column at once, in blocks cut at white space, so memory stays bounded
however long a text is. A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.

Runs of up to LONG bytes are hashed by a polynomial modulo 2^64, all of a block at once. Such a polynomial has pairs of
long runs that collide whatever its base (a Thue-Morse word and its complement, from about a thousand bytes on), so
longer runs are hashed one by one with BLAKE2b. Two different words then share a hash with a chance of about 2^-64.

Defined results: null counts as empty text and has no words; a word longer than a block is one word; equal texts give
equal hashes wherever they lie in a column.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once, and of the longest run that the polynomial hashes.
BLOCK = 1 << 18
LONG = 64
_P = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class _Tables:
    """Powers of an odd base and their inverses, by offset in a block: a run's polynomial hash is a difference of prefix sums."""

    pow: np.ndarray | None = None
    inv: np.ndarray

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if cls.pow is None or len(cls.pow) < n:
            size = max(n, BLOCK + 1)
            cls.pow = _powers(int(_P), size)
            cls.inv = _powers(pow(int(_P), -1, 1 << 64), size)
        return cls.pow, cls.inv


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES_LOWER = _BYTES[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Byte ranges that cover ``data``, cut between documents or at white space, of about ``block`` bytes each."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + block)
        if end < n:
            k = int(np.searchsorted(offsets, end, "right")) - 1
            if offsets[k] > at:
                end = int(offsets[k])
            else:  # inside one long text: back to its last white space, or on to the next
                seen = np.flatnonzero(SPACE[data[at:end]])
                if len(seen):
                    end = at + int(seen[-1]) + 1
                else:
                    stop = int(offsets[k + 1]) if k + 1 < len(offsets) else n
                    while end < stop and not SPACE[data[end]]:
                        end += 1
        yield at, end
        at = end


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTES) -> np.ndarray:
    """The 64-bit hash of each byte run of one block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _Tables.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * power[: len(data)], out=sums[1:])
    out = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        body = data[starts[i] : ends[i]].tobytes()
        body = body.lower() if table is _BYTES_LOWER else body  # bytes.lower() is A-Z only
        out[i] = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")
    return out


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block; ``cuts`` are the offsets at which documents begin in it."""
    ink = ~SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = ink[inner]
    last[inner - 1] = ink[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(column: pa.Array, lower: bool = False, bounds: bool = False) -> tuple[np.ndarray, ...]:
    """(hash of every word, index of each document's first word (n+1)[, start, end of every word in the column's bytes])."""
    data, offsets = raw(column)
    hashes, begins, stops = [], [], []
    for a, b in blocks(data, offsets):
        lo, hi = np.searchsorted(offsets, a, "left"), np.searchsorted(offsets, b, "right")
        s, e = word_bounds(data[a:b], offsets[lo:hi] - a)
        hashes.append(run_hashes(data[a:b], s, e, _BYTES_LOWER if lower else _BYTES))
        begins.append(s + a)
        stops.append(e + a)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    start = join(begins, np.int64)
    out = (join(hashes, np.uint64), np.searchsorted(start, offsets, "left"))
    return (*out, start, join(stops, np.int64)) if bounds else out


_C = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words that lies in one document, and the document's number for each run."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _C[j]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[k - 1 : k - 1 + n]
    return mix(out[whole]), doc[:n][whole]


def pieces(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of text (one row at least), to bound what the kernels hold."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()  # workers are kept for later stages, and what they hold with them
