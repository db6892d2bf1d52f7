"""Golden values of time and parameter arithmetic, and properties of the signal kernels."""

from fractions import Fraction

import numpy as np
import pytest

from tellura.errors import ParameterError
from tellura.functions import channels, kernels, solvers, timing
from tellura.operators import params


@pytest.mark.parametrize(
    ("fs", "span", "method", "expected"),
    [(64, 100 / 64, "round", 101), (16384, Fraction(354, 16384), "round", 355), (16384, Fraction(3542, 163840), "round", 355), (16384, Fraction(3542, 163840), "floor", 355),
     (16384, Fraction(3542, 163840), "ceil", 356), (16384, Fraction(3548, 163840), "round", 356), (16384, Fraction(3548, 163840), "floor", 355)],
)
def test_n_samples(fs, span, method, expected):
    assert timing.to_n_samples(span, fs, method) == expected


def test_samples_and_times():
    assert timing.to_text(timing.sample_to_instant(512, "2021-01-02", 512)).startswith("2021-01-02 00:00:01.000000")
    assert timing.to_text(timing.sample_to_instant(16384, "2021-01-01", 20000)) == "2021-01-01 00:00:01.220703_125000_000000_000000"
    assert timing.from_time_to_sample(128, 10**6, "2021-01-02", "2021-01-02 01:01:02") == 468_736
    assert timing.from_time_to_sample(0.5, 10**6, "2021-01-02", "2021-01-02 01:01:01") == 1831
    assert timing.to_time_to_sample(512, 10**8, "2021-01-02", "2021-01-02 23:00:00") == 42_393_600
    assert timing.to_time_to_sample(128, 10**8, "2021-01-02", "2021-01-03 01:00:00") == 11_520_000
    assert timing.to_time_to_sample(128, 10**8, "2021-01-02", "2021-01-02 02:22:31") == 1_094_528
    assert timing.to_time_to_sample(0.5, 10**8, "2021-01-02", "2021-01-02 02:22:31") == 4275
    text = "2021-01-01 00:00:01.123456_789012_345678_901234"
    assert timing.to_text(timing.to_instant(text)) == text


def test_times_outside_a_recording():
    assert timing.from_time_to_sample(10, 100, "2021-01-02", "2021-01-01") == 0
    assert timing.to_time_to_sample(10, 100, "2021-01-02", "2022-01-01") == 99
    with pytest.raises(ParameterError):
        timing.from_time_to_sample(10, 100, "2021-01-02", "2021-01-03")
    with pytest.raises(ParameterError):
        timing.to_time_to_sample(10, 100, "2021-01-02", "2021-01-01")
    with pytest.raises(ParameterError):
        timing.sample_to_instant(10, "2021-01-02", 100, 100)


def test_names():
    assert channels.fs_to_string(0.0005) == "0_000500"
    assert channels.fs_to_string(128) == "128_000000"
    assert channels.chan_type("Bz") == "magnetic"
    with pytest.raises(ParameterError):
        channels.chan_type("T1")


def test_frequencies_and_factors():
    assert params.eval_freqs(256, 30) == pytest.approx([64, 45.254834, 32])
    assert params.downsample_steps(24) == [2, 2, 2, 3]
    assert params.downsample_steps(96, 13) == [8, 12]
    got = params.DecimationSetup(3, 2).run(128)
    assert got.factors == (1, 2, 4) and got.increments == (1, 2, 2)
    assert got.freqs[2] == pytest.approx((8, 5.656854))
    assert params.DecimationSetup(3, 3).run(0.05).factors == (1, 2, 8)
    assert params.DecimationSetup().run(0.2).factors == (1, 4, 32, 128, 1024, 4096, 32768, 131072)
    assert params.DecimationSetup().run(0.2).levels_for(361_512) == [361_512, 90_378, 11_298, 2_825, 354]
    with pytest.raises(ParameterError):
        params.DecimationSetup(2, 2, eval_freqs=(100.0, 10.0, 5.0, 1.0)).run(128)


def test_windows():
    assert params.win_duration(8, 10) == Fraction(7, 10) and params.inc_duration(8, 2, 10) == Fraction(6, 10)
    step = params.inc_duration(256, 64, 128)
    assert params.instant_to_win("2021-03-15", "2021-04-17 18:00:00", step) == 1_944_000
    late = timing.to_instant("2021-04-17 18:00:00") + Fraction(1, 2)
    assert [params.instant_to_win("2021-03-15", late, step, m) for m in ("floor", "ceil", "round")] == [1_944_000, 1_944_001, 1_944_000]
    first = timing.to_instant("2021-01-01 00:05:10")
    assert params.first_and_last_win("2021-01-01", first, first + Fraction(9999, 10), 10, 100, 25) == (42, 173)
    grid = params.window_grid("2021-01-01", "2021-01-01 01:00:00", 1000, 10, 100, 25)
    assert (grid.first_win, grid.n_wins, grid.first_sample) == (480, 13, 0)
    sized = params.WindowSetup().run(3, [0.05, 0.025, 0.00625])
    assert sized.win_sizes == (128,) * 3 and sized.olap_sizes == (32,) * 3
    assert params.WindowSetup(win_sizes=(1000, 578, 104)).run(3, [1, 1, 1]).olap_sizes == (250, 144, 32)
    with pytest.raises(ParameterError):
        params.WindowSetup(win_sizes=(10,), olap_sizes=(10,)).run(1, [1])
    with pytest.raises(ParameterError):
        params.instant_to_win("2021-03-15", "2021-03-14", step)


def test_window_count_of_a_long_recording():
    lengths = params.DecimationSetup().run(0.2).levels_for(361_512)
    fs = params.DecimationSetup().run(0.2).dec_fs
    grids = params.WindowSetup().run(len(lengths), fs).grids("2021-01-01", "2021-01-01", lengths, fs)
    assert [g.n_wins for g in grids] == [3765, 941, 117, 29]


def test_filters():
    at = np.array([0.0, 2.0, 5.0, 10.0, 20.0, 40.0])
    low = abs(kernels.response(kernels.butterworth(10, "lowpass", [10], 100), at, 100))
    assert low[3] == pytest.approx(2**-0.5) and low[0] == pytest.approx(1) and low[4] < 1e-3
    high = abs(kernels.response(kernels.butterworth(10, "highpass", [10], 100), at, 100))
    assert high[3] == pytest.approx(2**-0.5) and high[5] == pytest.approx(1) and high[1] < 1e-6
    x = np.sin(2 * np.pi * 3 * np.arange(1000) / 100) + np.sin(2 * np.pi * 30 * np.arange(1000) / 100)
    y = kernels.zero_phase(kernels.butterworth(10, "lowpass", [10], 100), x)
    assert np.abs(y - np.sin(2 * np.pi * 3 * np.arange(1000) / 100))[100:-100].max() < 1e-4
    rng, sections = np.random.default_rng(1), kernels.butterworth(5, "bandpass", [5, 20], 100)
    x = rng.normal(size=301)
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sections:  # the recursion itself
        s1 = s2 = 0.0
        out = []
        for v in y:
            w = b0 * v + s1
            s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
            out.append(w)
        y = np.array(out)
    assert np.abs(kernels.sections_filter(sections, x) - y).max() < 1e-10


def test_resampling():
    t = np.arange(2000) / 100
    y = kernels.resample(np.cos(2 * np.pi * 0.5 * t), 3, 2)
    assert len(y) == 3000
    assert np.abs(y - np.cos(2 * np.pi * 0.5 * np.arange(3000) / 150))[60:-60].max() < 3e-3
    assert np.allclose(kernels.resample(np.full(101, 7.0), 1, 4), 7.0)


def test_transforms_and_tapers():
    assert [kernels.next_fast_len(n) for n in (1, 7, 97, 128, 257, 1021)] == [1, 8, 100, 128, 270, 1024]
    assert np.allclose(kernels.taper(("kaiser", 14), 16), np.kaiser(17, 14)[:-1])
    assert np.allclose(kernels.taper("hann", 8), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8))
    w = kernels.taper("dpss", 65)
    assert w.max() == pytest.approx(1) and np.allclose(w, w[::-1])
    for name in kernels.TAPERS:
        assert np.isfinite(kernels.taper(name, 33)).all()
    with pytest.raises(ParameterError):
        kernels.taper("nothing", 8)


def test_lttb():
    y = np.array([0, 1, 3, 4, 2, 3, 4, 3, 4, 5, 5, 5.0])
    assert kernels.lttb(np.arange(12.0), y, 5).tolist() == [0, 3, 4, 9, 11]
    assert len(kernels.lttb(np.arange(12.0), y, 40)) == 12


@pytest.mark.parametrize("name", ["OLS", "Huber", "TheilSen", "RANSAC", "WLS"])
def test_solvers_recover(name):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    truth = np.array([1.0, -2.0, 0.5, 3.0])
    y = x @ truth + rng.normal(0, 0.01, 400)
    if name != "OLS":
        y[:20] += 50  # outliers
    got = solvers.SOLVERS[name]().solve(x, y, seed=5)
    assert np.abs(got - truth).max() < (0.01 if name in ("OLS", "WLS", "Huber") else 0.5)
    assert np.array_equal(got, solvers.SOLVERS[name]().solve(x, y, seed=5))
