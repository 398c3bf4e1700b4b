"""Vectorised tokenising of Arrow string columns: word bounds and 64-bit word hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def _splitmix_table(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers (splitmix64 from seed)."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
LONG_WORD = 512
_SEED = np.uint64(0xD6E8FEB86659FD93)


def span_hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, the same wherever the span stands: eight bytes at a time are added and mixed."""
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _SEED + np.uint64(seed))
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buffer) + 1,), "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        at = np.flatnonzero(size <= LONG_WORD)
        k = 0
        while len(at):
            left = size[at] - k
            block = eight[starts[at] + k]
            short = left < 8
            block[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            out[at] = mix(out[at] + block)
            k += 8
            at = at[left > 8]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]].tobytes(), seed)
    return out


def byte_class(separators: str | bytes | list[int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, translation) tables of 256 entries."""
    word = np.ones(256, bool)
    word[list(separators)] = False
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    return word, table


#: Words are runs of anything but ASCII white space.
SPACED = byte_class([0x20, *range(0x09, 0x0E)])
#: Words are runs of ASCII letters, digits and all non-ASCII characters.
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
# lower-casing comes first, so A-Z are word bytes
ALNUM[0][65:91] = True


@dataclass
class Slice:
    """Rows [first, last) of a batch; texts stand one after another in buffer."""

    first: int
    last: int
    buffer: np.ndarray
    offsets: np.ndarray


def binary(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of about limit bytes, whole texts each."""
    data, offsets = binary(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Bounds and row of each word of a slice; rows count from the slice's first."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    per_row: np.ndarray


def words(part: Slice, classes: tuple[np.ndarray, np.ndarray]) -> Words:
    inside = classes[0][part.buffer]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begins = part.offsets[:-1][part.offsets[:-1] < part.offsets[1:]]
    first[begins] = inside[begins]
    stops = part.offsets[1:][part.offsets[:-1] < part.offsets[1:]] - 1
    last[stops] = inside[stops]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(part.offsets, starts, "right") - 1
    return Words(starts, ends, rows, np.bincount(rows, minlength=part.last - part.first).astype(np.int64))


def word_hashes(part: Slice, found: Words, classes: tuple[np.ndarray, np.ndarray], seed: int = 0) -> np.ndarray:
    """64-bit hash of each word after translation (A-Z lower-cased)."""
    return span_hash(classes[1][part.buffer], found.starts, found.ends, seed)


_ORDER = _splitmix_table(99, 64)


def shingles(hashes: np.ndarray, per_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, row of each): runs of size words; a shorter row's words are one shingle, a row without words has none.

    Not distinct, in text order. Shingles never cross rows.
    """
    n = len(hashes)
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    ends = np.cumsum(per_row)
    left = ends[row_of] - np.arange(n) if n else np.zeros(0, np.int64)
    take = np.minimum(left, size)
    whole = (take == size) | (left == per_row[row_of]) if n else np.zeros(0, bool)
    value = np.zeros(n, np.uint64)
    for k in range(size):
        ok = take > k
        at = np.flatnonzero(ok)
        value[at] += hashes[at + k] * (_ORDER[k] | np.uint64(1))
    value = mix(value + take.astype(np.uint64))
    return value[whole], row_of[whole]
