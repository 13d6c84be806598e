"""Hashes of words and of runs of words, as arrays, and packed sorted hashes with columns for shuffles."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

#: Words whose hashes are kept; bytes of a text that are split into words at once.
KNOWN_WORDS, PIECE = 200_000, 1 << 20
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bounded number."""

    def __init__(self, seed: int = 0) -> None:
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))

    def of_text(self, text: bytes) -> np.ndarray:
        """The hashes of a text's words, however long it is."""
        if len(text) <= PIECE:
            return self.array(text.split())
        found, start = [], 0
        while start < len(text):
            space = _SPACE.search(text, start + PIECE)
            end = space.start() if space else len(text)
            found.append(self.array(text[start:end].split()))
            start = end
        return np.concatenate(found)


_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        with np.errstate(over="ignore"):
            _POWERS = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _BACK))
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, by differences of one sum of powers modulo 2^64."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(n)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up)))
        h = (sums[width:] - sums[:-width]) * down[: n - width + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


def _deltas(sorted_values: np.ndarray) -> bytes:
    """Sorted whole numbers as differences, by byte planes, which compress well."""
    d = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    return d.view(np.uint8).reshape(-1, 8).T.tobytes()


def _undeltas(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack(hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted hashes with columns of numbers."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in map(np.ascontiguousarray, columns)]
    return struct.pack("<I", len(hashes)) + zstandard.ZstdCompressor(level=1).compress(_deltas(hashes) + b"".join(planes))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The hashes and columns of these kinds."""
    (n,) = struct.unpack_from("<I", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[4:])
    found, at = [_undeltas(body[: 8 * n], n)], 8 * n
    for kind in kinds:
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        found.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += n * size
    return found


def by_range(hashes: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The slices of sorted hashes that belong to each of `parts` equal ranges."""
    width = (1 << 64) // parts + 1
    edges = np.searchsorted(hashes, np.array([width * k for k in range(1, parts)], np.uint64))
    start = 0
    for k, end in enumerate([*edges.tolist(), len(hashes)]):
        if end > start:
            yield k, slice(start, end)
        start = end
