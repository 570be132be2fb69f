"""Words and word shingles of many texts at once, as 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
CHUNK_BYTES = 2_000_000


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of items of about `limit` bytes each; a longer item is alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(split: list[list[bytes]]) -> np.ndarray:
    """A hash of each word of all the texts, in order."""
    d = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in d.dictionary.to_pylist()), np.uint64, len(d.dictionary))
    return known[d.indices.to_numpy()] if len(known) else np.zeros(0, np.uint64)


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words; the last ones reach into what follows."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - length + 1, np.uint64)
    for j in range(length):
        out = out * _BASE + hashes[j : len(hashes) - length + 1 + j]
    return mixed(out)


def shingle_sets(split: list[list[bytes]], length: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words has none."""
    hashes, at, out = word_hashes(split), 0, []
    for words in split:
        n = len(words)
        if n == 0:
            out.append(np.zeros(0, np.uint64))
        elif n < length:
            out.append(runs_of(hashes[at : at + n], n) ^ np.uint64(n))
        else:
            out.append(np.unique(runs_of(hashes[at : at + n], length)))
        at += n
    return out
