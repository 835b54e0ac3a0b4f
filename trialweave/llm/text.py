"""Shared text machinery of the training-data operators.

Everything works on whole texts that arrive as Arrow batches.  ``slices`` bounds
the bytes handled at once, so memory does not depend on how long texts are or on
how many of them share a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bound on text bytes handled by one vectorised step (a longer text is its own step).
SLICE_BYTES = 2 << 20

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int, name: str) -> np.ndarray:
    """base ** 0 .. n-1 modulo 2**64; as many as a step needs are kept between calls."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + (1 << 16)), base, U64)
        out[0] = 1
        have = np.cumprod(out, dtype=U64)
        if n <= SLICE_BYTES + (1 << 16):
            _powers[name] = have
    return have[:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes together (one row at least)."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at, n = 0, len(size)
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null gives empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _hashed(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``, which stands at ``at`` of the buffer.

    A word's hash does not depend on where it stands."""
    inside = np.empty(len(data) + 1, np.int8)
    inside[0] = 0
    np.not_equal(data, 32, out=inside[1:].view(bool))
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * powers(_P, len(data), "up"), out=total[1:])
    span = (total[end] - total[start]) * powers(_P_INV, len(data) + 1, "down")[start]
    return start + at, end + at, mix(span + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of the texts of one slice, as 64-bit hashes.

    ``table`` maps bytes; a word is a maximal run of bytes other than a space.
    ``first[d] .. first[d + 1]`` are the words of text ``d``.
    """

    def __init__(self, texts: list[bytes], table: bytes) -> None:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_at = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.buffer = (b" ".join(texts) + b" ").translate(table)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = 0
        while at < len(self.buffer):  # a very long text is hashed in steps that end at a space
            stop = len(self.buffer) if len(self.buffer) - at <= SLICE_BYTES else self.buffer.find(b" ", at + SLICE_BYTES - 1) + 1
            found.append(_hashed(np.frombuffer(self.buffer, np.uint8, stop - at, at), at))
            at = stop
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*found, strict=True))
        self.first = np.searchsorted(self.start, self.text_at)

    def grams(self, n: int) -> np.ndarray:
        """Order-keeping hash of the n words from each word on (runs over text ends too)."""
        count = max(0, len(self.hash) - n + 1)
        out = np.zeros(count, U64)
        for j in range(n):
            out += self.hash[j : j + count] * U64(pow(0xA24BAED4963EE407 | 1, j + 1, 1 << 64))
        return mix(out)


def byte_table(keep: str, lower: bool = True) -> bytes:
    """Translation table: ``keep`` is "space" (all but the six ASCII white-space
    characters are word bytes) or "alnum" (ASCII letters and digits and all bytes
    above 127 are)."""
    out = bytearray(range(256))
    for b in range(128):
        if keep == "space":
            out[b] = 32 if b == 32 or 9 <= b <= 13 else b
        else:
            out[b] = b if chr(b).isalnum() else 32
        if lower and 65 <= b <= 90:
            out[b] = b + 32
    return bytes(out)


def crc_mod(column: str | Column, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``."""
    return F.pmod(F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")), F.lit(divisor))


def hidden(docs: DataFrame, *needed: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but the ``needed`` ones under names that clash with nothing,
    and the column names in the order of ``docs``."""
    inner = [c if c in needed else f"__c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*inner), inner


def shown(df: DataFrame, inner: list[str], names: list[str]) -> DataFrame:
    """Undoes ``hidden``: only the columns of the original, under their names."""
    return df.select(*(df[i].alias(n) for i, n in zip(inner, names, strict=True)))
