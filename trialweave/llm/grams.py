"""Hashed n-gram features of whole texts, the same for training and scoring.

A slice of texts becomes one byte buffer; every position gives one bucket per n-gram
size, and a text's feature vector is the mean over its n-grams.  Linear models score a
text as the mean of its buckets' weights.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from trialweave.llm.text import SLICE_BYTES

_MUL = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D)]


def buckets(data: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Bucket of the ``size`` bytes from each position on (the last ones have none)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, (size * 0x9E3779B1) & 0xFFFFFFFF, np.uint32)
    for j in range(size):
        h ^= (data[j : j + n].astype(np.uint32) + np.uint32(1)) * _MUL[j]
        h = (h << np.uint32(13)) | (h >> np.uint32(19))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int64)


class Grams:
    """``views``: (function from texts' bytes to bytes, sizes, first bucket) of each part of the vector."""

    def __init__(self, views: list[tuple[Callable[[bytes], bytes], tuple[int, ...]]], bits: int) -> None:
        self.views, self.bits = views, bits
        self.width = sum(len(sizes) for _, sizes in views) << bits

    def _parts(self, texts: list[bytes]):
        """(buckets of all positions, text starts, n-grams of each text), cut at text ends; a single long
        text comes in several parts."""
        base = 0
        for view, sizes in self.views:
            seen = [view(t) for t in texts]
            lengths = np.fromiter(map(len, seen), np.int64, len(seen))
            data = np.frombuffer(b"".join(seen), np.uint8)
            ends = np.cumsum(lengths)
            step = SLICE_BYTES if len(texts) == 1 else max(1, len(data))
            for size in sizes:
                if len(data) <= step:
                    yield buckets(data, size, self.bits) + base, ends - lengths, np.maximum(0, lengths - size + 1)
                else:
                    for at in range(0, len(data) - size + 1, step):
                        ids = buckets(data[at : at + step + size - 1], size, self.bits) + base
                        yield ids, np.zeros(1, np.int64), np.array([len(ids)])
                base += 1 << self.bits

    def mean_weights(self, texts: list[bytes], table: np.ndarray) -> np.ndarray:
        """Mean over all n-grams of rows of ``table`` (width x k): one row per text, zeros without n-grams."""
        out = np.zeros((len(texts), table.shape[1]))
        total = np.zeros(len(texts), np.int64)
        for ids, starts, counts in self._parts(texts):
            has = np.flatnonzero(counts)
            total += counts
            if not len(has):
                continue
            edges = np.empty(2 * len(has), np.int64)
            edges[0::2], edges[1::2] = starts[has], starts[has] + counts[has]
            for k in range(table.shape[1]):
                values = np.append(table[ids, k], 0.0)  # the last edge may be the end
                out[has, k] += np.add.reduceat(values, np.minimum(edges, len(values) - 1))[0::2]
        return out / np.maximum(total, 1)[:, None]

    def vectors(self, texts: list[bytes], at_once: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sparse mean vectors: (buckets, shares) of each text, in short types."""
        out = []
        for begin in range(0, len(texts), at_once):
            some = texts[begin : begin + at_once]
            found: list[list[np.ndarray]] = [[] for _ in some]
            for ids, starts, counts in self._parts(some):
                for i, (a, n) in enumerate(zip(starts.tolist(), counts.tolist(), strict=True)):
                    found[i].append(ids[a : a + n])
            for parts in found:
                ids, count = np.unique(np.concatenate(parts), return_counts=True)
                out.append((ids.astype(np.int32), (count / max(1, count.sum())).astype(np.float32)))
        return out
