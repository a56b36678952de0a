"""Vectorised words and word shingles of text batches, as 64-bit hashes.

Words are maximal runs of bytes outside space and 0x09-0x0D of the UTF-8 text, with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 65536)
        for i, base in enumerate((_BASE, _BACK)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as UTF-8 (null: empty) of about `most` bytes in all, each with its first row's number."""
    first, size, held = 0, 0, []
    for at in range(0, len(texts), 256):
        for raw in texts.slice(at, 256).cast(pa.binary()).to_pylist():
            raw = raw or b""
            if held and size + len(raw) > most:
                yield first, held
                first, size, held = first + len(held), 0, []
            held.append(raw)
            size += len(raw) + 1
    if held:
        yield first, held


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of a few rows, so that a worker holds little beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run raw[start:end] of bytes."""
    up, back = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, byte after) of each word; bytes count from the start of all texts, each followed by one byte."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = np.empty(len(raw) + 1, bool)
    gap[0] = True
    gap[1:] = _SPACE[raw]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[0::2], edges[1::2]
    code = codes(raw, start, end)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return code, np.searchsorted(begin, start, "right") - 1, start, end


def shingles(code: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of k words of one text."""
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[k - 1 :])
    out = np.zeros(len(first), np.uint64)
    for i in range(k):
        out = (out + code[first + i]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out), first


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles in ascending order; with fewer words the whole sequence as one; without words none."""
    code, owner, _, _ = words(texts)
    hashed, first = shingles(code, owner, k)
    bounds = np.searchsorted(owner[first], np.arange(len(texts) + 1))
    limits = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        if bounds[i] < bounds[i + 1]:
            out.append(np.unique(hashed[bounds[i] : bounds[i + 1]]))
        elif (n := limits[i + 1] - limits[i]) > 0:
            few = code[limits[i] : limits[i + 1]]
            out.append(mix(shingles(few, np.zeros(n, np.int64), int(n))[0] + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
