"""Words and hashes of whole Arrow text columns, computed in numpy on the UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text and rows of a slice: numpy's working arrays take tens of bytes a byte.
CHUNK, CHUNK_ROWS = 1 << 20, 1 << 14
_MASKS = np.array([0] + [(1 << 8 * k) - 1 for k in range(1, 9)], dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string array; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text and at most ``rows`` rows; a longer text is a slice of its own."""
    for batch in batches:
        _, at = utf8(column(batch, text))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
            stop = min(stop, start + rows)
            yield batch.slice(start, stop - start)
            start = stop
        del batch, at
        relieve()


def relieve() -> None:
    """Give freed memory back, so that a reused Python worker does not keep its peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def words(data: np.ndarray, at: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of no ``space`` byte), and where each text's words begin."""
    solid = ~space[data]
    before = np.empty_like(solid)
    after = np.empty_like(solid)
    if len(solid):
        before[0], before[1:] = False, solid[:-1]
        after[-1], after[:-1] = False, solid[1:]
        before[at[:-1][at[:-1] < len(data)]] = False
        after[at[1:][at[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def padded(data: np.ndarray) -> np.ndarray:
    """Every 8-byte window of ``data`` as a little-endian number, zeros after the end."""
    buffer = np.zeros(len(data) + 8, np.uint8)
    buffer[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer, strides=(1,))


def span_hash(windows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + seed))
    out = mix(out ^ (windows[starts] & _MASKS[np.minimum(lengths, 8)]))
    rest, k = np.flatnonzero(lengths > 8), 8
    while len(rest):
        lane = windows[starts[rest] + k] & _MASKS[np.minimum(lengths[rest] - k, 8)]
        out[rest] = mix(out[rest] * np.uint64(0x9E3779B97F4A7C15) ^ lane)
        k += 8
        rest = rest[lengths[rest] > k]
    return out


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin."""
    starts, ends, first = words(data, at)
    return (span_hash(padded(data), starts, ends - starts) if len(starts) else np.zeros(0, np.uint64)), first
