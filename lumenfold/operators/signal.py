"""Signal processing on rows of frames: framing, spectra, cepstra, pitch, denoising, speech checks.

An utterance is cut into rows (key, frame, x); what works on one frame is a Column expression, what needs neighbours is a
window or a fold over one utterance.  Only the Fourier transforms of a batch of frames are NumPy, and spectral subtraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions import arrays as V
from . import scans
from . import windows as W
from .cleaning import normalise_signal
from .models import constant


@dataclass(frozen=True)
class Config:
    """Front-end constants; two presets below."""

    rate: int = 16000
    frame: int = 512
    stride: int = 256
    mel: int = 30
    order: int = 28
    root: float | None = None
    deltas: bool = False


MAIN = Config()
VOICE_LOCK = Config(mel=26, order=24, deltas=True)
BANDS = ((300, 627), (628, 1060), (1061, 1633), (1634, 2393), (2394, 3400))  # Hz
# Upper edges of the critical bands in Hz.
CRITICAL = (100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500)
VECTOR, MATRIX = "array<double>", "array<array<double>>"


def _saturate(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(32767.0)), F.lit(-32768.0))


def preemphasis(x: Column, a: float = 0.97) -> Column:
    """Samples less a share of the one before, towards 0 and saturated; the first stands before itself."""
    y = F.transform(x, lambda v, i: _saturate(v - a * F.when(i == 0, v).otherwise(F.element_at(x, F.greatest(i, F.lit(1))))))
    return F.transform(y, lambda v: F.signum(v) * F.floor(F.abs(v)))


def preemphasis_column(x: Column, percent: int = 97) -> Column:
    """Integer samples less `percent` per cent of the one before, towards 0 and saturated to 16 bits; in integers, so exact."""
    last = lambda v, i: F.when(i == 0, v).otherwise(F.element_at(x, F.greatest(i, F.lit(1))))
    y = F.transform(x, lambda v, i: 100 * v - percent * last(v, i))
    return F.transform(y, lambda v: F.greatest(F.least((F.signum(v) * F.floor(F.abs(v) / 100)).cast("long"), F.lit(32767)), F.lit(-32768)))


def deemphasis(x: Column, a: float = 0.97) -> Column:
    """Each sample plus a share of the last result, saturated at the end: a fold in pieces of 64 samples that hand on their last value."""
    piece = F.lit(64)
    starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), piece)).otherwise(F.array().cast("array<int>"))
    run = lambda part, first: F.aggregate(part, F.array().cast(VECTOR), lambda acc, v: F.array_append(acc, v + a * F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), first)))
    last = lambda parts: F.coalesce(F.element_at(F.element_at(F.when(F.size(parts) > 0, parts), -1), -1), F.lit(0.0))
    pieces = F.aggregate(starts, F.array().cast(MATRIX), lambda parts, s: F.array_append(parts, run(F.slice(x.cast(VECTOR), s, piece), last(parts))))
    return F.when(x.isNotNull(), F.transform(F.flatten(pieces), _saturate))


def window(n: int, kind: str = "hamming") -> Column:
    a = 0.54 if kind == "hamming" else 0.5
    return constant((a - (1 - a) * np.cos(2 * np.pi * np.arange(n) / (n - 1))).tolist(), VECTOR)


def frame_rows(df: DataFrame, key: str, samples: str, c: Config = MAIN) -> DataFrame:
    """Rows (key, frame, x) of overlapping frames; utterances shorter than a frame, and null ones, have none."""
    return df.select(key, F.posexplode(W.frames(F.col(samples).cast(VECTOR), c.frame, c.stride)).alias("frame", "x"))


def _batches(frames: DataFrame, name: str, f) -> DataFrame:
    """Add what `f` makes of a batch of rows, one vector a row.

    An operator of its own, as Catalyst neither takes a UDF into a lambda nor lambdas into a UDF's arguments.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield p.assign(**{name: list(f(p))})

    return frames.mapInPandas(run, StructType([*frames.schema.fields, StructField(name, ArrayType(DoubleType()))]))


def magnitudes(frames: DataFrame, x: str, name: str) -> DataFrame:
    """Add the absolute values of the spectrum of frames of one length."""
    return _batches(frames, name, lambda p: np.abs(np.fft.rfft(np.stack(list(p[x])), axis=1)))


def _reshaped(frames: DataFrame, c: Config) -> DataFrame:
    """Add `y`: frames whose spectrum is multiplied by a gain for each bin."""
    return _batches(frames, "y", lambda p: np.fft.irfft(np.fft.rfft(np.stack(list(p["x"])), axis=1) * np.stack(list(p["gain"])), n=c.frame, axis=1))


def spectrogram(df: DataFrame, key: str, samples: str, c: Config = MAIN, compress: str = "none") -> DataFrame:
    """Rows (key, frame, s): magnitudes of normalised, windowed frames; plain, as logarithms or as roots."""
    shaped = F.zip_with(normalise_signal(F.col("x")), window(c.frame), lambda v, w: v * w)
    s = magnitudes(frame_rows(df, key, samples, c).select(key, "frame", shaped.alias("x")), "x", "s").drop("x")
    if compress == "none":
        return s
    squeeze = (lambda v: F.ln(F.greatest(v, F.lit(1.0)))) if compress == "log" else (lambda v: F.pow(v, F.lit(0.34)))
    return s.withColumn("s", F.transform("s", squeeze))


def mel(f):
    return 1127 * np.log1p(np.asarray(f, float) / 700)


def mel_filters(c: Config = MAIN, low: float = 0.0, high: float = 8000.0) -> np.ndarray:
    """filters x bins: triangles that are linear in mel, with centres on whole bins."""
    centre = np.linspace(mel(low), mel(high), c.mel + 2)
    at = mel(np.round(c.frame * 700 * np.expm1(centre / 1127) / c.rate) * c.rate / c.frame)
    m = mel(np.arange(c.frame // 2 + 1) * c.rate / c.frame)
    up = (m - at[:-2, None]) / np.maximum(at[1:-1] - at[:-2], 1e-9)[:, None]
    down = (at[2:, None] - m) / np.maximum(at[2:] - at[1:-1], 1e-9)[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def mel_energies(s: Column, c: Config = MAIN) -> Column:
    """Filter-bank energies of a spectrum; each filter reads only the bins that it covers."""
    table = []
    for f in mel_filters(c):
        used = np.flatnonzero(f) if f.any() else np.array([0])
        table.append({"first": int(used[0]) + 1, "w": f[used[0] : used[-1] + 1].tolist()})
    filters = constant(table, "array<struct<first: int, w: array<double>>>")
    return V.bound(s, lambda bins: F.transform(filters, lambda t: V.dot(F.slice(bins, t["first"], F.size(t["w"])), t["w"])))


def _levelled(x: np.ndarray, low_power: float = 1024.0, gain: float = 256.0) -> np.ndarray:
    """`normalise_signal` for a batch of frames."""
    x = x - x.mean(axis=1, keepdims=True)
    x = x * np.where((x * x).mean(axis=1, keepdims=True) < low_power, gain, 1.0)
    return np.clip(x, -32768.0, 32767.0)


def mfcc(df: DataFrame, key: str, samples: str, c: Config = MAIN) -> DataFrame:
    """Rows (key, frame, mfcc): mel energies, logarithm or root, cosine transform, with RASTA and deltas if configured.

    All that is linear in a frame is a matrix product of the batch that its Fourier transform takes anyway.
    """
    shape = np.hamming(c.frame)
    filters = mel_filters(c).T
    waves = np.cos(np.pi * np.arange(1, c.order + 1)[:, None] * (np.arange(1, c.mel + 1) - 0.5) / c.mel).T

    def cepstra(p: pd.DataFrame) -> np.ndarray:
        e = np.abs(np.fft.rfft(_levelled(np.stack(list(p["x"]))) * shape, axis=1)) @ filters
        return (np.log(np.maximum(e, 1.0)) if c.root is None else np.power(e, c.root)) @ waves

    out = _batches(frame_rows(df, key, samples, c), "mfcc", cepstra).drop("x")
    if not c.deltas:
        return out
    # Below five frames nothing is added, so that such an utterance keeps plain coefficients.
    long = out.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    smooth = rasta(long.filter("_n >= 5"), key, "mfcc", "smooth")
    both = deltas(smooth, key, "smooth", "d").filter("frame >= 4").select(key, (F.col("frame") - 4).alias("frame"), F.concat("smooth", "d").alias("mfcc"))
    return both.unionByName(long.filter("_n < 5").select(key, "frame", "mfcc"))


def deltas(frames: DataFrame, key: str, x: str, name: str) -> DataFrame:
    """Add the weighted sum of the last five frames' vectors; zeros for the first four frames."""
    w = Window.partitionBy(key).orderBy("frame")
    times = lambda x, a: F.transform(x, lambda v: v * a)
    parts = [times(F.lag(x, 4 - i).over(w), a) for i, a in enumerate(W.DELTA)]
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda u, v: u + v)
    return frames.withColumn(name, F.coalesce(out, F.transform(x, lambda v: F.lit(0.0))))


def rasta(frames: DataFrame, key: str, x: str, name: str, pole: float = 0.98) -> DataFrame:
    """Deltas through a recursive filter, in blocks of frames; frames of a key count from 0 without gaps."""
    d = deltas(frames, key, x, "_d").select(key, "frame", "_d")
    return scans.affine_scan(d, [key], "frame", F.lit(pole), F.col("_d"), name).drop("_d")


def second_differences(spectra: DataFrame, key: str) -> DataFrame:
    """Of spectra (key, frame, s): in time and in frequency, side by side, without the borders; frames count from 0 again."""
    w = Window.partitionBy(key).orderBy("frame")
    inner = lambda x: F.slice(x, 2, F.size(x) - 2)
    both = spectra.withColumns({"_a": F.lag("s").over(w), "_b": F.lead("s").over(w)}).filter("_a is not null and _b is not null")
    time = inner(F.zip_with(F.zip_with("_a", "_b", lambda u, v: u + v), "s", lambda u, v: u - 2 * v))
    return both.select(key, (F.col("frame") - 1).alias("frame"), F.concat(time, V.second_difference(F.col("s"))).alias("d"))


def deemphasised(samples: DataFrame, by: list[str], order: list[str], value: str, name: str, a: float = 0.97) -> DataFrame:
    """Rows of samples with each one plus a share of the last result, saturated at the end; the rows of a key are many tasks."""
    rows = scans.placed(samples, by, order, "_place")
    out = scans.affine_scan(rows, by, "_place", F.lit(a), F.col(value), name)
    return out.withColumn(name, _saturate(F.col(name))).drop("_place")


def _bins(c: Config, low: float, high: float) -> tuple[np.ndarray, int]:
    hz = np.arange(c.frame // 2 + 1) * c.rate / c.frame
    inside = np.flatnonzero((hz >= low) & (hz <= high))
    return hz[inside], int(inside[0]) + 1


def sub_band(df: DataFrame, key: str, samples: str, c: Config = MAIN, alpha: float = 3.0) -> DataFrame:
    """Rows (key, frame, bands): centroid and Renyi entropy of each of five bands."""

    def measures(low: float, high: float) -> Column:
        hz, first = _bins(c, low, high)
        power = F.transform(F.slice("s", first, len(hz)), lambda v: v * v)
        share = V.bound(power, lambda p: V.bound(F.greatest(V.total(p), F.lit(1e-12)), lambda t: F.transform(p, lambda v: v / t)))
        entropy = lambda q: F.log2(F.greatest(V.total(F.transform(q, lambda v: F.pow(v, F.lit(alpha)))), F.lit(1e-12))) / (1 - alpha)
        return V.bound(share, lambda q: F.array(V.dot(q, constant(hz.tolist(), VECTOR)), entropy(q)))

    out = [measures(low, high) for low, high in BANDS]
    return spectrogram(df, key, samples, c).select(key, "frame", F.concat(*out).alias("bands"))


def pitch(x: Column, rate: int = 16000, low: int = 50, high: int = 205, kind: str = "acf") -> Column:
    """Hertz of the lag with the largest autocorrelation (or least mean difference); 0 for silence and short frames."""
    n = F.size(x)
    late, early = lambda k: F.slice(x, k + 1, n), lambda k: F.slice(x, F.lit(1), n - k)
    measure = (lambda k: V.dot(late(k), early(k))) if kind == "acf" else (lambda k: -V.total(F.zip_with(late(k), early(k), lambda u, v: F.abs(u - v))) / (n - k))
    values = F.transform(F.sequence(F.lit(low), F.lit(high)), measure)
    return F.when((n > high) & F.exists(x, lambda v: v != 0), rate / (low + V.bound(values, V.argmax))).otherwise(0.0)


def _spectra(df: DataFrame, key: str, samples: str, c: Config, quiet_frames: int) -> DataFrame:
    """Windowed frames with their power and the mean power of the first frames: key, frame, x, p, noise."""
    if c.frame != 2 * c.stride:
        raise ValueError("frames must overlap by half")
    f = frame_rows(df, key, samples, c).select(key, "frame", F.zip_with("x", window(c.frame, "hann"), lambda v, w: v * w).alias("x"))
    f = magnitudes(f, "x", "p").withColumn("p", F.transform("p", lambda v: v * v))
    bins = f.filter(F.col("frame") < quiet_frames).select(key, F.posexplode("p").alias("i", "v")).groupBy(key, "i").agg(F.avg("v").alias("v"))
    noise = bins.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("noise"))
    return f.join(noise, key)


def _overlap_add(df: DataFrame, key: str, samples: str, frames: DataFrame, c: Config) -> DataFrame:
    """Frames with a `gain` back to samples of the utterance's length: rows (key, y); a short utterance stays."""
    b = _reshaped(frames.select(key, "frame", "x", "gain"), c).drop("x", "gain")
    w = Window.partitionBy(key).orderBy("frame")
    half = F.slice("y", 1, c.stride)
    before = F.lag(F.slice("y", c.stride + 1, c.stride)).over(w)
    tail = F.when(F.lead("frame").over(w).isNull(), F.slice("y", c.stride + 1, c.stride)).otherwise(F.array().cast(VECTOR))
    parts = b.select(key, "frame", F.concat(F.coalesce(F.zip_with(half, before, lambda u, v: u + v), half), tail).alias("y"))
    whole = parts.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "y"))), lambda s: s["y"])).alias("_y"))
    n = F.size(F.col(samples))
    padded = F.concat("_y", F.array_repeat(F.lit(0.0), n - F.size("_y")))
    return df.join(whole, key, "left").select(key, F.when(F.col("_y").isNull(), F.col(samples).cast(VECTOR)).otherwise(F.transform(padded, _saturate)).alias("y"))


def spectral_subtraction(df: DataFrame, key: str, samples: str, c: Config = MAIN, quiet_frames: int = 6, floor: float = 0.03) -> DataFrame:
    """Subtract more of the noise where the signal is weak; the first frames are taken as noise.  Rows (key, y); a short utterance stays.

    An utterance is a row before and after, so its frames are not rows between: they are taken from it and added to its
    result in batches, and nothing is shuffled.
    """
    if c.frame != 2 * c.stride:
        raise ValueError("frames must overlap by half")
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(c.frame) / (c.frame - 1))

    def spectra(frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.fft.rfft(frames * shape, axis=1)
        return z, z.real**2 + z.imag**2

    def clean(x: np.ndarray) -> np.ndarray:
        frames = np.lib.stride_tricks.sliding_window_view(x, c.frame)[:: c.stride]
        noise = spectra(frames[:quiet_frames])[1].mean(axis=0)
        out, all_noise = np.zeros(len(x)), max(noise.sum(), 1e-9)
        for s in range(0, len(frames), 128):
            z, p = spectra(frames[s : s + 128])
            over = np.clip(4 - 1.5 * np.log10(np.maximum(p.sum(axis=1), 1e-9) / all_noise), 1, 5)[:, None]
            z *= np.sqrt(np.maximum(p - over * noise, floor * noise) / np.maximum(p, 1e-9))
            y = np.fft.irfft(z, n=c.frame, axis=1)
            at = out[s * c.stride : (s + len(y) + 1) * c.stride].reshape(len(y) + 1, c.stride)
            at[:-1] += y[:, : c.stride]
            at[1:] += y[:, c.stride :]
        return np.fmax(np.fmin(out, 32767.0), -32768.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, values = b.column("x").offsets.to_numpy(), b.column("x").values.to_numpy(zero_copy_only=False)
            cuts = {0, *np.searchsorted(ends, np.arange(ends[0], ends[-1], 1 << 20)).tolist(), len(b)}  # about a million samples at a time
            for first, last in pairwise(sorted(cuts)):
                part = b.slice(first, last - first)
                said, own = part.column("x"), ends[first : last + 1]
                found = [x if len(x) < c.frame else clean(x) for x in (values[i:j] for i, j in zip(own[:-1], own[1:]))]
                y = pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), pa.array(np.concatenate([*found, np.empty(0)])), mask=said.is_null())
                yield pa.RecordBatch.from_arrays([part.column("key"), y], ["key", "y"])

    rows = df.select(F.col(key).alias("key"), F.col(samples).cast(VECTOR).alias("x"))
    return rows.mapInArrow(run, StructType([rows.schema["key"], StructField("y", ArrayType(DoubleType()))])).withColumnRenamed("key", key)


def wiener(df: DataFrame, key: str, samples: str, c: Config = MAIN, quiet_frames: int = 6, alpha: float = 0.98, hang_over: int = 15) -> DataFrame:
    """Decision-directed gain: a fold over one utterance's frames.  Rows (key, y).

    The noise follows frames without speech, once the hang-over after speech has passed.
    """
    s = _spectra(df, key, samples, c, quiet_frames)
    one = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame", "p"))).alias("s"), F.first("noise").alias("noise"))
    state = F.struct(F.col("noise").alias("noise"), F.transform("noise", lambda v: F.lit(1.0)).alias("before"), F.lit(0).alias("hold"), F.array().cast(MATRIX).alias("gains"))

    def step(a: Column, row: Column) -> Column:
        post = F.array(F.zip_with(row["p"], a["noise"], lambda p, m: p / F.greatest(m, F.lit(1e-9))))

        def decide(q: Column) -> Column:
            speech = V.total(F.transform(q, lambda v: F.ln(F.greatest(v, F.lit(1e-9))))) / F.size(q) > 0.6
            hold = F.when(speech, hang_over).otherwise(F.greatest(a["hold"] - 1, F.lit(0)))
            noise = F.when(hold == 0, F.zip_with(a["noise"], row["p"], lambda m, p: 0.95 * m + 0.05 * p)).otherwise(a["noise"])
            prior = F.zip_with(a["before"], q, lambda b, v: alpha * b + (1 - alpha) * F.greatest(v - 1, F.lit(0.0)))
            return V.bound(F.transform(prior, lambda v: v / (1 + v)), lambda g: F.struct(noise.alias("noise"), F.zip_with(g, q, lambda u, v: u * u * v).alias("before"), hold.cast("int").alias("hold"), F.array_append(a["gains"], g).alias("gains")))

        return F.transform(post, decide)[0]

    gains = F.aggregate("s", state, step, lambda a: a["gains"])
    lines = one.select(key, F.posexplode(gains).alias("frame", "gain"))
    return _overlap_add(df, key, samples, s.join(lines, [key, "frame"]), c)


def masking_threshold(power: Column, c: Config = MAIN) -> Column:
    """Threshold of each bin of one frame: band energies spread to their neighbours, lowered by how tonal the frame is."""
    hz = np.arange(c.frame // 2 + 1) * c.rate / c.frame
    n = len(CRITICAL)
    band = np.minimum(np.searchsorted(CRITICAL, hz), n - 1)
    width = np.bincount(band, minlength=n)
    first = np.concatenate([[0], np.cumsum(width)[:-1]]) + 1
    dz = np.arange(n)[:, None] - np.arange(n)[None, :] + 0.474
    spread = 10 ** ((15.81 + 7.5 * dz - 17.5 * np.sqrt(1 + dz**2)) / 10)
    rows = [{"first": int(f), "n": int(m), "spread": r.tolist()} for f, m, r in zip(first, width, spread)]
    bands = constant(rows, "array<struct<first: int, n: int, spread: array<double>>>")
    def measures(p: Column) -> Column:
        energy = F.transform(bands, lambda b: V.total(F.slice(p, b["first"], b["n"])))
        mean = V.total(p) / F.size(p)
        flat = F.exp(V.total(F.transform(p, lambda v: F.ln(F.greatest(v, F.lit(1e-9))))) / F.size(p)) / F.greatest(mean, F.lit(1e-9))
        tonal = F.least(F.greatest(10 * F.log10(F.greatest(flat, F.lit(1e-9))) / -60, F.lit(0.0)), F.lit(1.0))
        return F.struct(energy.alias("energy"), tonal.alias("tonal"))

    def levels(both: Column) -> Column:
        offset = lambda i: both["tonal"] * (15.5 + i) + (1 - both["tonal"]) * 5.5
        level = F.transform(bands, lambda b, i: V.dot(b["spread"], both["energy"]) * F.pow(F.lit(10.0), -offset(i) / 10) / F.greatest(b["n"], F.lit(1)))
        return V.bound(level, lambda t: F.transform(constant((band + 1).tolist(), "array<int>"), lambda i: F.element_at(t, i)))

    return V.bound(V.bound(power, measures), levels)


def perceptual_denoise(df: DataFrame, key: str, samples: str, c: Config = MAIN, quiet_frames: int = 6) -> DataFrame:
    """Subtract only the noise that the masking threshold of the signal does not hide.  Rows (key, y)."""
    s = _spectra(df, key, samples, c, quiet_frames)
    s = s.withColumn("clean", F.zip_with("p", "noise", lambda p, m: F.greatest(p - m, 0.01 * m)))
    s = s.withColumn("heard", F.zip_with("noise", masking_threshold(F.col("clean"), c), lambda m, t: F.greatest(m - t, F.lit(0.0))))
    gain = F.zip_with("p", "heard", lambda p, h: F.sqrt(F.greatest(p - 2 * h, 0.05 * p) / F.greatest(p, F.lit(1e-9))))
    return _overlap_add(df, key, samples, s.withColumn("gain", gain), c)


def speech_by_energy(frames: DataFrame, key: str, mean: float = 0.004, dev: float = 0.0, keep: float = 0.998) -> DataFrame:
    """Rows (key, frame, speech): the noise level follows frames without speech, a fold over one utterance's energies."""
    y = V.total(F.transform(preemphasis(F.col("x")), lambda v: v * v / 32768.0**2))
    e = frames.select(key, "frame", (16 * F.log2(1 + y / 64)).alias("e"))
    one = e.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("frame", "e"))).alias("s"))
    state = F.struct(F.lit(mean).alias("mean"), F.lit(dev).alias("dev"), F.array().cast("array<struct<frame: int, speech: boolean>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        sigma = F.greatest(F.sqrt(a["dev"]), F.log10(F.greatest(a["mean"] * 1e4, F.lit(1.0))) / 900)
        speech = r["e"] > a["mean"] + 3 * sigma
        found = F.array_append(a["out"], F.struct(r["frame"].alias("frame"), speech.alias("speech")))
        level, spread = keep * a["mean"] + (1 - keep) * r["e"], keep * a["dev"] + (1 - keep) * F.pow(r["e"] - a["mean"], F.lit(2))
        return F.struct(F.when(speech, a["mean"]).otherwise(level).alias("mean"), F.when(speech, a["dev"]).otherwise(spread).alias("dev"), found.alias("out"))

    return one.select(key, F.inline(F.aggregate("s", state, step, lambda a: a["out"])))


def admit(frames: DataFrame, key: str, share: float = 0.001) -> DataFrame:
    """Frames whose energy is at least a share of their utterance's largest."""
    e = frames.withColumn("_e", V.dot(F.col("x"), F.col("x")))
    return e.withColumn("_m", F.max("_e").over(Window.partitionBy(key))).filter(F.col("_e") >= share * F.col("_m")).drop("_e", "_m")


def cmvn(frames: DataFrame, key: str, x: str, dims: int) -> DataFrame:
    """Mean 0 and population deviation 1 of each coefficient over an utterance; a constant one becomes 0."""
    stats = frames.groupBy(key).agg(*[F.array(*[f(F.col(x)[i]) for i in range(dims)]).alias(n) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    centred = F.zip_with(x, "_m", lambda v, m: v - m)
    return frames.join(stats, key).withColumn(x, F.zip_with(centred, "_s", lambda v, s: F.when(s > 0, v / s).otherwise(0.0))).drop("_m", "_s")


def add_noise(signal: Column, noise: Column, snr_db: float) -> Column:
    """Noise scaled to the wanted ratio of powers, repeated to the signal's length."""
    power = lambda x: V.dot(x, x) / F.size(x)
    repeated = F.transform(signal, lambda v, i: F.element_at(noise, F.pmod(i, F.size(noise)).cast("int") + 1))

    def mixed(m: Column) -> Column:
        gain = F.sqrt(power(signal) / F.greatest(power(m), F.lit(1e-12)) / 10 ** (snr_db / 10))
        return V.bound(gain, lambda g: F.zip_with(signal, m, lambda u, v: u + g * v))

    return V.bound(repeated, mixed)


