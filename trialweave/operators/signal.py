"""Linear filters and resampling of trials, by numpy within Arrow batches of whole trials."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.schema import TRIAL


def fir_taps(sfreq: float, low: float | None, high: float | None, seconds: float | None = None) -> np.ndarray:
    """Odd windowed-sinc (Hamming) taps; ``low``, ``high``: edges of the pass band, either may be missing.

    Beyond an edge the transition is a quarter of its frequency wide, 2 Hz at least, but not past 0 or
    half the rate; half power is in its middle, and 3.3 periods of its width make the taps of that edge."""
    if not low and not high:
        raise ValueError("a filter needs an edge")
    if high and high >= sfreq / 2:
        raise ValueError("the upper edge must lie under half the sampling rate")
    below = min(max(0.25 * low, 2.0), low) if low else 0.0
    above = min(max(0.25 * high, 2.0), sfreq / 2 - high) if high else 0.0
    size = {width: int(np.ceil((seconds or 3.3 / width) * sfreq)) | 1 for width in (below, above) if width}
    n = max(size.values())

    def lowpass(cut: float, width: float) -> np.ndarray:
        m = size[width]
        k = np.arange(m) - m // 2
        h = 2 * cut / sfreq * np.sinc(2 * cut / sfreq * k) * np.hamming(m)
        return np.pad(h / h.sum(), (n - m) // 2)

    out = lowpass(high + above / 2, above) if high else (np.arange(n) == n // 2).astype(float)
    return out - lowpass(low - below / 2, below) if low else out


def filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Zero-phase: reflected edges of up to twice the signal's length, centred taps."""
    pad = min(len(taps) // 2 + 1, 2 * len(x))
    wide = np.pad(x, pad, mode="reflect", reflect_type="odd") if len(x) > 1 else np.pad(x, pad, mode="edge")
    n = len(wide) + len(taps) - 1
    full = np.fft.irfft(np.fft.rfft(wide, n) * np.fft.rfft(taps, n), n)
    start = len(taps) // 2 + pad
    return full[start : start + len(x)]


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """To ``n`` samples by the discrete Fourier transform."""
    if n == len(x):
        return x
    f = np.fft.rfft(x)
    g = np.zeros(n // 2 + 1, complex)
    m = min(len(f), len(g))
    g[:m] = f[:m]
    return np.fft.irfft(g, n) * n / len(x)


def _per_channel(samples: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``change`` of every trial's channel, in order of the samples; many trials to a batch."""
    kinds = dict(samples.dtypes)
    rows = samples.groupBy(*TRIAL, "channel").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            ends = x.offsets.to_numpy()
            sample, value = (x.values.field(c).to_numpy(zero_copy_only=False) for c in ("sample", "value"))
            new = [change(value[a:b].astype(float)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            if not new:
                continue
            lengths = [len(y) for y in new]
            at = pa.array(np.repeat(np.arange(len(new)), lengths))
            numbers = np.concatenate([np.arange(n) + int(sample[a]) for n, a in zip(lengths, ends[:-1], strict=True)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in TRIAL), pa.array(numbers), batch.column("channel").take(at), pa.array(np.concatenate(new))], [*TRIAL, "sample", "channel", "value"])

    return rows.mapInArrow(run, f"participant {kinds['participant']}, epoch {kinds['epoch']}, sample int, channel {kinds['channel']}, value double")


def filter_raw(raw: DataFrame, sfreq: float, low: float | None, high: float | None, *, block: int = 1 << 15) -> DataFrame:
    """Band filter of continuous ``raw(participant, sample, channel, value)``, samples 0 .. n - 1.

    A recording is cut into blocks that carry half the filter's length of their neighbours' samples,
    so the result is that of the whole recording and no task holds more than a block.  The ends are
    reflected as in ``filtered``."""
    taps = fir_taps(sfreq, low, high)
    half = len(taps) // 2
    kinds = dict(raw.dtypes)
    block = max(block, 5 * half + 8)
    number = F.floor(F.col("sample") / block)
    inside = F.col("sample") - number * block
    near = F.array_compact(F.array(number, F.when((inside < 2 * half + 1) & (number > 0), number - 1), F.when(inside >= block - 2 * half - 1, number + 1)))
    spread = raw.select("participant", "channel", "sample", "value", F.explode(near).alias("_block"))
    rows = spread.groupBy("participant", "channel", "_block").agg(F.array_sort(F.collect_list(F.struct("sample", "value"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            edges = x.offsets.to_numpy()
            sample, value = (x.values.field(c).to_numpy(zero_copy_only=False) for c in ("sample", "value"))
            parts, kept, rows_ = [], [], []
            for i, (a, b, k) in enumerate(zip(edges[:-1], edges[1:], batch.column("_block").to_pylist(), strict=True)):
                at, y = sample[a:b].astype(np.int64), value[a:b].astype(float)
                own = (at >= k * block) & (at < (k + 1) * block)
                if not own.any():
                    continue
                # At an end of the recording ``filtered`` reflects; inside, its reflection only touches what is not kept.
                out = filtered(y, taps)
                parts.append(out[own])
                kept.append(at[own])
                rows_.append(np.full(int(own.sum()), i))
            if parts:
                where = pa.array(np.concatenate(rows_))
                yield pa.RecordBatch.from_arrays([batch.column("participant").take(where), pa.array(np.concatenate(kept)), batch.column("channel").take(where), pa.array(np.concatenate(parts))], ["participant", "sample", "channel", "value"])

    return rows.mapInArrow(run, f"participant {kinds['participant']}, sample long, channel {kinds['channel']}, value double")


def filter_trials(samples: DataFrame, sfreq: float, low: float | None, high: float | None) -> DataFrame:
    """Band filter of every trial and channel of every participant."""
    taps = fir_taps(sfreq, low, high)
    return _per_channel(samples, lambda x: filtered(x, taps))


def resample_trials(samples: DataFrame, sfreq: float, new_sfreq: float) -> DataFrame:
    return _per_channel(samples, lambda x: resampled(x, max(1, round(len(x) * new_sfreq / sfreq))))


def poly_resampled(x: np.ndarray, n: int, pad: int = 1) -> np.ndarray:
    """To ``n`` samples by a polyphase filter (windowed sinc, Kaiser 5); ``pad`` samples at either end
    repeat the outer values, and beyond them stands the median."""
    x = np.pad(np.asarray(x, float), pad, mode="edge")
    common = math.gcd(n, len(x))
    up, down = n // common, len(x) // common
    if up == down:
        return x
    most = max(up, down)
    k = np.arange(-10 * most, 10 * most + 1)
    h = np.sinc(k / most) * np.kaiser(len(k), 5.0)
    h *= up / h.sum()
    middle = np.median(x)
    at = np.arange(n)[:, None] * down - np.arange(len(x))[None, :] * up + 10 * most
    return np.where((at >= 0) & (at < len(h)), h[np.clip(at, 0, len(h) - 1)], 0.0) @ (x - middle) + middle


def resample_to(samples: DataFrame, n: int, *, pad: int = 1) -> DataFrame:
    """Every trial and channel to ``n`` samples by ``poly_resampled``."""
    return _per_channel(samples, lambda x: poly_resampled(x, n, pad))
