"""Plain signal processing of one utterance, to compare with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


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


def preemphasis(x: np.ndarray, a: float = 0.97) -> np.ndarray:
    x = np.asarray(x, float)
    before = np.concatenate([x[:1], x[:-1]])
    return np.trunc(np.clip(x - a * before, -32768, 32767))


def deemphasis(x: np.ndarray, a: float = 0.97) -> np.ndarray:
    out = np.zeros(len(x))
    last = 0.0
    for i, v in enumerate(x):
        last = v + a * last
        out[i] = last
    return np.clip(out, -32768, 32767)


def window(n: int, kind: str = "hamming") -> np.ndarray:
    a = 0.54 if kind == "hamming" else 0.5
    return a - (1 - a) * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def frames(x: np.ndarray, size: int = 512, stride: int = 256) -> np.ndarray:
    n = max(0, (len(x) - size) // stride + 1) if len(x) >= size else 0
    return np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), size)[::stride][:n] if n else np.zeros((0, size))


def normalise(f: np.ndarray, low: float = 1024.0, gain: float = 256.0) -> np.ndarray:
    f = f - f.mean(axis=1, keepdims=True)
    quiet = (f * f).mean(axis=1, keepdims=True) < low
    return np.clip(np.where(quiet, f * gain, f), -32768, 32767)


def spectrogram(x: np.ndarray, c: Config = MAIN, compress: str = "none") -> np.ndarray:
    s = np.abs(np.fft.rfft(normalise(frames(x, c.frame, c.stride)) * window(c.frame), axis=1))
    return s if compress == "none" else np.log(np.maximum(s, 1.0)) if compress == "log" else s**0.34


def mel(f):
    return 1127 * np.log1p(np.asarray(f, float) / 700)


def mel_filters(c: Config = MAIN, low: float = 0.0, high: float = 8000.0) -> np.ndarray:
    """filters x bins: triangles that are linear in mel, with centres on whole bins."""
    centre = np.linspace(mel(low), mel(high), c.mel + 2)
    bins = np.round(c.frame * 700 * np.expm1(centre / 1127) / c.rate)
    at = mel(bins * c.rate / c.frame)
    m = mel(np.arange(c.frame // 2 + 1) * c.rate / c.frame)
    up = (m - at[:-2, None]) / np.maximum(at[1:-1] - at[:-2], 1e-9)[:, None]
    down = (at[2:, None] - m) / np.maximum(at[2:] - at[1:-1], 1e-9)[:, None]
    return np.clip(np.minimum(up, down), 0, None)


def dct_matrix(n: int, order: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(1, order + 1)[:, None] * (np.arange(1, n + 1) - 0.5) / n)


def mfcc(x: np.ndarray, c: Config = MAIN) -> np.ndarray:
    """frames x coefficients: mel energies, logarithm or root, cosine transform, with RASTA and deltas if configured."""
    energy = spectrogram(x, c) @ mel_filters(c).T
    squeezed = np.log(np.maximum(energy, 1.0)) if c.root is None else energy**c.root
    out = squeezed @ dct_matrix(c.mel, c.order).T
    if c.deltas and len(out) >= 5:
        smooth = rasta(out)
        out = np.concatenate([smooth, deltas(smooth)], axis=1)[4:]
    return out


def deltas(m: np.ndarray) -> np.ndarray:
    w = np.array([-0.2, -0.1, 0.0, 0.1, 0.2])
    out = np.zeros_like(m)
    for i, a in enumerate(w):
        out[4:] += a * m[i : len(m) - 4 + i]
    return out


def rasta(m: np.ndarray, pole: float = 0.98) -> np.ndarray:
    out = deltas(m)
    for t in range(1, len(out)):
        out[t] += pole * out[t - 1]
    return out


def second_differences(s: np.ndarray) -> np.ndarray:
    """Of a spectrogram: in time and in frequency, side by side, without the borders."""
    time = s[2:, 1:-1] - 2 * s[1:-1, 1:-1] + s[:-2, 1:-1]
    pitch = s[1:-1, 2:] - 2 * s[1:-1, 1:-1] + s[1:-1, :-2]
    return np.concatenate([time, pitch], axis=1)


def zero_crossing_rate(x: np.ndarray) -> float:
    return float(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)) / len(x)) if len(x) else 0.0


def sub_band(x: np.ndarray, c: Config = MAIN, alpha: float = 3.0) -> np.ndarray:
    """frames x (centroid, Renyi entropy) of five bands."""
    power = spectrogram(x, c) ** 2
    hz = np.arange(power.shape[1]) * c.rate / c.frame
    out = []
    for a, b in BANDS:
        inside = (hz >= a) & (hz <= b)
        p = power[:, inside]
        share = p / np.maximum(p.sum(axis=1, keepdims=True), 1e-12)
        out += [share @ hz[inside], np.log2(np.maximum((share**alpha).sum(axis=1), 1e-12)) / (1 - alpha)]
    return np.stack(out, axis=1)


def pitch(x: np.ndarray, rate: int = 16000, low: int = 50, high: int = 205, kind: str = "acf") -> float:
    """Hertz of the lag with the largest autocorrelation (or least mean difference); 0 for silence."""
    x = np.asarray(x, float)
    if len(x) <= high or not np.any(x):
        return 0.0
    lags = range(low, high + 1)
    if kind == "acf":
        v = [float(x[k:] @ x[:-k]) for k in lags]
        return rate / (low + int(np.argmax(v)))
    v = [float(np.abs(x[k:] - x[:-k]).mean()) for k in lags]
    return rate / (low + int(np.argmin(v)))


def _overlap_add(x: np.ndarray, c: Config, gain: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    f = frames(x, c.frame, c.stride)
    if not len(f):
        return np.asarray(x, float)
    spectrum = np.fft.rfft(f * window(c.frame, "hann"), axis=1)
    back = np.fft.irfft(spectrum * gain(np.abs(spectrum) ** 2), n=c.frame, axis=1)
    out = np.zeros(len(x))
    for i, b in enumerate(back):
        out[i * c.stride : i * c.stride + c.frame] += b
    return np.clip(out, -32768, 32767)


def spectral_subtraction(x: np.ndarray, c: Config = MAIN, quiet_frames: int = 6, floor: float = 0.03) -> np.ndarray:
    """Subtract more of the noise where the signal is weak; the first frames are taken as noise."""

    def gain(power: np.ndarray) -> np.ndarray:
        noise = power[:quiet_frames].mean(axis=0)
        snr = 10 * np.log10(np.maximum(power.sum(axis=1), 1e-9) / max(noise.sum(), 1e-9))
        over = np.clip(4 - 0.15 * snr, 1, 5)[:, None]
        return np.sqrt(np.maximum(power - over * noise, floor * noise) / np.maximum(power, 1e-9))

    return _overlap_add(x, c, gain)


def wiener(x: np.ndarray, c: Config = MAIN, quiet_frames: int = 6, alpha: float = 0.98, hang_over: int = 15) -> np.ndarray:
    """Decision-directed gain; the noise follows frames without speech, which must last longer than the hang-over."""

    def gain(power: np.ndarray) -> np.ndarray:
        noise = power[:quiet_frames].mean(axis=0)
        before, out, hold = np.ones(power.shape[1]), np.empty_like(power), 0
        for t, p in enumerate(power):
            post = p / np.maximum(noise, 1e-9)
            speech = np.log(np.maximum(post, 1e-9)).mean() > 0.6
            hold = hang_over if speech else max(0, hold - 1)
            if not hold:
                noise = 0.95 * noise + 0.05 * p
            prior = alpha * before + (1 - alpha) * np.maximum(post - 1, 0)
            out[t] = prior / (1 + prior)
            before = out[t] ** 2 * post
        return out

    return _overlap_add(x, c, gain)


# Upper edges of the critical bands in Hz.
CRITICAL = (100, 200, 300, 400, 510, 630, 770, 920, 1080, 1270, 1480, 1720, 2000, 2320, 2700, 3150, 3700, 4400, 5300, 6400, 7700, 9500)


def masking_threshold(power: np.ndarray, c: Config = MAIN) -> np.ndarray:
    """Threshold of each bin of one frame: band energies spread to their neighbours, lowered by how tonal the frame is."""
    hz = np.arange(len(power)) * c.rate / c.frame
    band = np.minimum(np.searchsorted(CRITICAL, hz), len(CRITICAL) - 1)
    n = len(CRITICAL)
    energy = np.bincount(band, power, n)
    dz = np.arange(n)[:, None] - np.arange(n)[None, :]
    spread = 10 ** ((15.81 + 7.5 * (dz + 0.474) - 17.5 * np.sqrt(1 + (dz + 0.474) ** 2)) / 10)
    flat = np.exp(np.log(np.maximum(power, 1e-9)).mean()) / max(power.mean(), 1e-9)
    tonal = min(max(10 * np.log10(max(flat, 1e-9)) / -60, 0), 1)
    offset = tonal * (14.5 + np.arange(1, n + 1)) + (1 - tonal) * 5.5
    width = np.maximum(np.bincount(band, minlength=n), 1)
    return ((spread @ energy) * 10 ** (-offset / 10) / width)[band]


def perceptual_denoise(x: np.ndarray, c: Config = MAIN, quiet_frames: int = 6) -> np.ndarray:
    """Subtract only the noise that the masking threshold of the signal does not hide."""

    def gain(power: np.ndarray) -> np.ndarray:
        noise = power[:quiet_frames].mean(axis=0)
        out = np.empty_like(power)
        for t, p in enumerate(power):
            clean = np.maximum(p - noise, 0.01 * noise)
            heard = np.maximum(noise - masking_threshold(clean, c), 0)
            out[t] = np.sqrt(np.maximum(p - 2 * heard, 0.05 * p) / np.maximum(p, 1e-9))
        return out

    return _overlap_add(x, c, gain)


class EnergyCheck:
    """Speech decision of one frame after the other; the noise level follows frames without speech."""

    def __init__(self, mean: float = 0.004, dev: float = 0.0, keep: float = 0.998):
        self.mean, self.dev, self.keep = mean, dev, keep

    def speech(self, frame: np.ndarray) -> bool:
        y = preemphasis(frame) / 32768
        e = 16 * np.log2(1 + float(y @ y) / 64)
        sigma = max(np.sqrt(self.dev), np.log10(max(self.mean * 1e4, 1.0)) / 900)
        if e > self.mean + 3 * sigma:
            return True
        self.dev = self.keep * self.dev + (1 - self.keep) * (e - self.mean) ** 2
        self.mean = self.keep * self.mean + (1 - self.keep) * e
        return False


def admit(x: np.ndarray, c: Config = MAIN, share: float = 0.001) -> np.ndarray:
    """Frames whose energy is at least a share of the largest."""
    f = frames(x, c.frame, c.stride)
    e = (f * f).sum(axis=1)
    return f[e >= share * e.max()] if len(f) else f


def cmvn(m: np.ndarray) -> np.ndarray:
    """Mean 0 and population deviation 1 a column; a constant column becomes 0."""
    dev = m.std(axis=0)
    return np.divide(m - m.mean(axis=0), dev, out=np.zeros_like(m), where=dev > 0)


def add_noise(signal: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """Noise scaled to the wanted ratio of powers, repeated to the signal's length."""
    noise = np.resize(noise, len(signal))
    gain = np.sqrt((signal**2).mean() / max((noise**2).mean(), 1e-12) / 10 ** (snr_db / 10))
    return signal + gain * noise
