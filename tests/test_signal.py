"""Signal operators against plain NumPy, utterance by utterance."""

import numpy as np
import pytest
from plain import signal_plain as plain
from pyspark.sql import functions as F

from lumenfold.operators import signal

RNG = np.random.default_rng(1)
T = np.arange(7000) / 16000
TONE = np.round(8000 * np.sin(2 * np.pi * 200 * T) * (T > 0.2) + RNG.normal(0, 200, 7000))
SAID = {"tone": TONE, "noise": np.round(RNG.normal(0, 900, 3000)), "few": np.round(RNG.normal(0, 50, 1100)), "short": TONE[:100]}


@pytest.fixture(scope="module")
def said(spark):
    return spark.createDataFrame([(k, x.tolist()) for k, x in SAID.items()] + [("null", None)], "k string, x array<double>").cache()


def matrices(df, column):
    out = {}
    for r in df.orderBy("k", "frame").collect():
        out.setdefault(r["k"], []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def same(got, want, **limits):
    assert set(got) == {k for k, v in want.items() if len(v)}
    for k in got:
        assert np.allclose(got[k], want[k], **({"rtol": 1e-6, "atol": 1e-6} | limits)), k


@pytest.mark.parametrize("compress", ["none", "log", "root"])
def test_spectrogram(said, compress):
    same(matrices(signal.spectrogram(said, "k", "x", compress=compress), "s"), {k: plain.spectrogram(x, compress=compress) for k, x in SAID.items()})


@pytest.mark.parametrize("config", ["MAIN", "VOICE_LOCK"])
def test_mfcc(said, config):
    same(matrices(signal.mfcc(said, "k", "x", getattr(signal, config)), "mfcc"), {k: plain.mfcc(x, getattr(plain, config)) for k, x in SAID.items()})


def test_differences_and_bands(said):
    spectra = {k: plain.spectrogram(x) for k, x in SAID.items()}
    same(matrices(signal.second_differences(signal.spectrogram(said, "k", "x"), "k"), "d"), {k: plain.second_differences(s) if len(s) > 2 else [] for k, s in spectra.items()})
    same(matrices(signal.sub_band(said, "k", "x"), "bands"), {k: plain.sub_band(x) for k, x in SAID.items()})


def test_samples(said):
    got = {r["k"]: r for r in said.select("k", signal.preemphasis(F.col("x")).alias("pre"), signal.deemphasis(F.col("x")).alias("de"), signal.add_noise(F.col("x"), F.slice("x", 1, 90), 10.0).alias("noisy")).collect()}
    for k, x in SAID.items():
        assert np.allclose(got[k]["pre"], plain.preemphasis(x)) and np.allclose(got[k]["de"], plain.deemphasis(x))
        assert np.allclose(got[k]["noisy"], plain.add_noise(x, x[:90], 10))
    assert got["null"]["pre"] is None and got["null"]["de"] is None


@pytest.mark.parametrize("kind", ["acf", "amdf"])
def test_pitch(said, kind):
    got = {r["k"]: r["p"] for r in said.select("k", signal.pitch(F.slice("x", 3000, 1200), kind=kind).alias("p")).collect()}
    for k, x in SAID.items():
        assert got[k] == pytest.approx(plain.pitch(x[2999:4199], kind=kind))
    assert got["null"] == 0


@pytest.mark.parametrize("name", ["spectral_subtraction", "wiener", "perceptual_denoise"])
def test_denoising(said, name):
    got = {r["k"]: r["y"] for r in getattr(signal, name)(said, "k", "x").collect()}
    for k, x in SAID.items():
        assert np.allclose(got[k], getattr(plain, name)(x), rtol=1e-6, atol=1e-4), k
    assert got["null"] is None
    assert np.abs(np.array(got["tone"])[1000:3000]).mean() < np.abs(TONE[1000:3000]).mean()


def test_subtraction_of_many_utterances(spark):
    """Utterances of all lengths, of which batches hold some, null and empty ones and rows of equal or null keys; frames are no rows, so nothing is shuffled."""
    rng = np.random.default_rng(4)
    lengths = [0, 1, 511, 512, 513, 767, 768, 5000, 128 * 256 + 511, 70_000, None, 400_000, 300_000, 350_000, 400_000, 0, None]
    rows = [(None if i == 7 else i // 2, i, None if n is None else (rng.normal(size=n) * 3000).round(3).tolist()) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "k int, i int, x array<double>").coalesce(1)
    out = signal.spectral_subtraction(df.withColumn("key", F.struct("k", "i")), "key", "x")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["key"]["i"]: r["y"] for r in out.collect()}
    assert set(got) == set(range(len(rows)))
    for _, i, x in rows:
        assert got[i] is None if x is None else len(got[i]) == len(x) and np.allclose(got[i], plain.spectral_subtraction(np.array(x)) if len(x) >= 512 else x, rtol=1e-6, atol=1e-4), i
    assert signal.spectral_subtraction(df.filter("x is null"), "k", "x").count() == 2 and signal.spectral_subtraction(df.limit(0), "k", "x").count() == 0


def test_frames_of_speech(said):
    rows = signal.frame_rows(said, "k", "x")
    want = {}
    for k, x in SAID.items():
        check = plain.EnergyCheck()
        want[k] = [check.speech(f) for f in plain.frames(x)]
    same(matrices(signal.speech_by_energy(rows, "k"), "speech"), want)
    same(matrices(signal.admit(rows, "k", 0.1), "x"), {k: plain.admit(x, share=0.1) for k, x in SAID.items()})
    same(matrices(signal.cmvn(signal.mfcc(said, "k", "x"), "k", "mfcc", 28), "mfcc"), {k: plain.cmvn(m) if len(m := plain.mfcc(x)) else m for k, x in SAID.items()})
