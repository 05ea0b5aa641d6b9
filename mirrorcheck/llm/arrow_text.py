"""Texts of an Arrow column as bytes: words, their places and hashes, all in array operations.

Separators and capitals of the operators are ASCII, so bytes of UTF-8 give the same words as characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and bytes beyond ASCII; words of whatever is not white space.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
NOT_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])

#: Key of the digests of long words, and a number that short ones are moved by.
_KEY, _SHORT = b"words", np.uint64(0x9E3779B97F4A7C15)
#: Which bits of eight bytes the first n hold.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over their whole range, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], text_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``text_bytes`` of the column ``text``, never within a row."""
    return sliced(batches, "text", text_bytes)


def sliced(batches: Iterator[pa.RecordBatch], column: str, text_bytes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + text_bytes, "right")))
            yield batch.slice(start, end - start)
            start = end


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and where each row starts (one more entry at the end); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that ``inside`` holds; no run goes from one row to the next."""
    here = inside[data]
    edge = np.flatnonzero(here[1:] != here[:-1]) + 1
    if len(here) and here[0]:
        edge = np.concatenate(([0], edge))
    if len(here) and here[-1]:
        edge = np.concatenate((edge, [len(here)]))
    starts, ends = edge[0::2], edge[1::2]
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(here))]
    cuts = cuts[here[cuts] & here[cuts - 1]]
    if len(cuts):
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans stand in order and don't overlap.

    Spans of up to 16 bytes are read as two numbers, which are scattered one after the other (up to 8 bytes: one to one);
    longer ones, and those that end in a zero byte, get a keyed BLAKE2b digest.
    """
    sizes = ends - starts
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    first = eight[starts] & _BYTES[np.minimum(sizes, 8)]
    second = eight[starts + 8 * (sizes > 8)] & _BYTES[np.clip(sizes - 8, 0, 8)]
    out = mix(mix(first + _SHORT) + second)
    long = np.flatnonzero((sizes > 16) | (sizes > 0) & (padded[ends - 1] == 0))
    if len(long):
        out[long] = _digests(data, starts[long], ends[long])
    return out


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A keyed BLAKE2b digest of each span, made once for all spans of the same bytes."""
    sizes = ends - starts
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    flat = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    digests = b"".join([hashlib.blake2b(x, digest_size=8, key=_KEY).digest() for x in spans.dictionary.to_pylist()])
    return np.frombuffer(digests, "<u8")[spans.indices.to_numpy(zero_copy_only=False)]
