"""Operators on small recordings against golden values and NumPy."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellura.errors import ChannelNotFoundError, ParameterError, ProcessRunError
from tellura.functions import kernels
from tellura.functions.frames import SAMPLES
from tellura.operators import gather, params, regression, spectra, timeops, transfer
from tellura.operators.calibration import CalibrationData, SensorCalibrator
from tellura.operators.decimation import Decimator
from tellura.operators.params import Recording
from tellura.operators.windows import Windower
from tellura.plans import pipeline
from tellura.plans.config import Configuration
from tellura.streaming import windows as streaming

HX = [1, 2, 3, 5, 1, 2, 3, 4, 2, 6, 7, 6, 5, 4, 3, 2]
NAN = float("nan")


def data(spark, chans, fs=10.0, first="2020-01-01 00:00:00", site="s", meas="m"):
    rows = [(site, meas, 0, c, i, float(v)) for c, x in chans.items() for i, v in enumerate(x)]
    n = len(next(iter(chans.values())))
    return timeops.TimeData(spark.createDataFrame(rows, SAMPLES), (Recording(site, meas, fs, n, first, tuple(chans)),))


def values(d, chan):
    return [r["value"] for r in d.df.where(F.col("chan") == chan).orderBy("sample").collect()]


def test_interpolate_nans(spark):
    x = {"Hx": [NAN, 2, 3, 5, 1, 2, 3, 4, 2, 6, 7, NAN, NAN, 4, 3, 2], "Ey": [1, 2, NAN, NAN, 5, 6, NAN, 8, 9, 1, 2, 3, 4, 5, NAN, NAN]}
    for block in (3, 5, 1000):
        done = timeops.InterpolateNans(block=block).run(data(spark, x))
        assert values(done, "Hx") == [2, 2, 3, 5, 1, 2, 3, 4, 2, 6, 7, 6, 5, 4, 3, 2]
        assert values(done, "Ey") == [1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5, 5, 5]
    with pytest.raises(Exception, match="no value in channel"):
        timeops.InterpolateNans().run(data(spark, {"Hx": [NAN, NAN]})).df.collect()


def test_arithmetic(spark):
    d = data(spark, {"Hx": HX, "Ex": [0] * 16})
    assert values(timeops.RemoveMean().run(d), "Hx") == [v - 3.5 for v in HX]
    assert values(timeops.Add({"Hx": 2}).run(d), "Ex") == [0] * 16
    assert values(timeops.Multiply(2).run(d), "Hx") == [2 * v for v in HX]
    with pytest.raises(ChannelNotFoundError):
        d.get_chan("Hz")
    shifted = timeops.ShiftTimestamps(0.05).run(d)
    assert values(shifted, "Hx") == pytest.approx([(a + b) / 2 for a, b in zip(HX, HX[1:])])
    assert shifted.recordings[0].n_samples == 15
    with pytest.raises(ProcessRunError):
        timeops.ShiftTimestamps(0.1).run(d)


def test_subsection(spark):
    d = data(spark, {"Hx": list(range(1000))})
    part = d.subsection("2020-01-01 00:00:25", "2020-01-01 00:00:50.9")
    assert part.recordings[0].n_samples == 260 and values(part, "Hx") == list(range(250, 510))
    assert part.recordings[0].first_time.startswith("2020-01-01 00:00:25.0")


def test_filters_and_resampling(spark):
    t = np.arange(800) / 50
    x = np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 20 * t)
    d = data(spark, {"Hx": x}, fs=50.0)
    low = np.array(values(timeops.LowPass(cutoff=8.0).run(d), "Hx"))
    assert np.abs(low - np.sin(2 * np.pi * 2 * t))[100:-100].max() < 1e-3
    blocks = timeops.LowPass(cutoff=8.0, whole=100, halo_periods=30).run(d)
    assert np.abs(np.array(values(blocks, "Hx")) - low).max() < 1e-6
    for block in (64, 10_000):
        done = timeops.Resample(12.5, block=block).run(d)
        assert np.allclose(values(done, "Hx"), kernels.resample(x, 1, 4))
        assert done.recordings[0].n_samples == 200
    assert np.allclose(values(timeops.Resample(75.0, block=100).run(d), "Hx"), kernels.resample(x, 3, 2))
    down = timeops.Decimate(6).run(d)
    assert down.fs == pytest.approx(50 / 6) and len(values(down, "Hx")) == 134
    for bad in (timeops.LowPass(cutoff=30.0), timeops.HighPass(cutoff=30.0), timeops.BandPass(cutoff_low=5, cutoff_high=3), timeops.Notch(notch=26.0)):
        with pytest.raises(ProcessRunError):
            bad.run(d)


def test_decimator(spark):
    d = data(spark, {"Ex": np.arange(20_000.0)}, fs=128.0)
    done = Decimator().run(d, params.DecimationSetup(3, 4).run(128))
    assert [x.fs for x in done.levels] == [128, 32, 8]
    assert [x.recordings[0].n_samples for x in done.levels] == [20_000, 5000, 1250]


def _windowed(spark, x, size=16, olap=4, fs=10.0, first="2020-01-01 00:00:03", ref="2020-01-01 00:00:00"):
    d = data(spark, x, fs, first)
    setup = params.DecimationSetup(1, 2, 8)
    dec = Decimator().run(d, setup.run(fs))
    return Windower().run(ref, dec, params.WindowParameters(1, 1, (size,), (olap,))), setup.run(fs)


def test_windows_and_spectra(spark):
    rng = np.random.default_rng(0)
    x = {"Ex": rng.normal(size=200) + np.arange(200), "Hx": rng.normal(size=200)}
    windowed, parameters = _windowed(spark, x)
    rows = windowed.df.where("chan = 'Ex'").orderBy("global_win", "pos").collect()
    grid = windowed.grids["s", "m", 0]
    assert (grid.first_win, grid.first_sample, grid.n_wins) == (3, 6, 15)  # 3 s after the reference time, 1.2 s a window
    wins = np.array([r["value"] for r in rows]).reshape(-1, 16)
    for k, w in enumerate(wins):
        assert np.array_equal(w, x["Ex"][6 + k * 12 : 6 + k * 12 + 16])
    z = kernels.spectrum(wins, kernels.taper(("kaiser", 14), 16), "linear", 16)
    full = spectra.FourierTransform().run(windowed)
    got = full.df.where("chan = 'Ex'").orderBy("global_win").collect()
    assert np.allclose([np.array(r["re"]) + 1j * np.array(r["im"]) for r in got], z)
    one = spectra.FourierTransform().evals(windowed, parameters).df.orderBy("chan", "global_win").collect()
    two = spectra.EvaluationFreqs().run(full, parameters).df.orderBy("chan", "global_win").collect()
    for a, b in zip(one, two):
        assert np.allclose(a["re"], b["re"]) and np.allclose(a["im"], b["im"])
    assert windowed.get_global(0, 4).count() == 32 and windowed.get_local(0, 1).count() == 32
    for detrend in (None, "constant"):
        ft = spectra.FourierTransform("hann", detrend)
        a = ft.evals(windowed, parameters).df.orderBy("chan", "global_win").collect()
        b = spectra.EvaluationFreqs().run(ft.run(windowed), parameters).df.orderBy("chan", "global_win").collect()
        assert all(np.allclose(p["re"], q["re"]) and np.allclose(p["im"], q["im"]) for p, q in zip(a, b))


def test_evaluation_frequencies_golden(spark):
    """Two windows, ten frequencies 0 to 90: on the line between bins."""
    rows = [("s", "m", 0, "c", w, [float(k - w) for k in range(10)], [float(k + w) for k in range(10)]) for w in (0, 1)]
    sd = spectra.SpectraData(spark.createDataFrame(rows, "site string, meas string, level int, chan string, global_win long, re array<double>, im array<double>"), {0: tuple(10.0 * k for k in range(10))})
    freqs = tuple(float(f) for f in range(1, 90, 11))
    parameters = params.DecimationParameters(180, 1, len(freqs), 1, (freqs,), (1,))
    got = spectra.EvaluationFreqs().run(sd, parameters).df.orderBy("global_win").collect()
    assert got[0]["re"] == pytest.approx([f / 10 for f in freqs]) and got[1]["re"] == pytest.approx([f / 10 - 1 for f in freqs])
    assert got[1]["im"] == pytest.approx([f / 10 + 1 for f in freqs])


def test_smoothers_and_calibration(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(3, 40)) + 1j * rng.normal(size=(3, 40))
    rows = [("s", "m", 0, "Hx", i, z[i].real.tolist(), z[i].imag.tolist()) for i in range(3)]
    freqs = tuple(float(i) for i in range(40))
    sd = spectra.SpectraData(spark.createDataFrame(rows, "site string, meas string, level int, chan string, global_win long, re array<double>, im array<double>"), {0: freqs})
    got = spectra.SpectraSmootherUniform(0.1).run(sd).df.orderBy("global_win").first()
    wide = np.concatenate([z[0][1::-1], z[0], z[0][:-3:-1]])
    assert np.allclose(np.array(got["re"]) + 1j * np.array(got["im"]), np.convolve(wide, np.ones(5) / 5, "valid"))
    assert np.allclose(spectra.SpectraSmootherGaussian(2.0).run(sd).df.orderBy("global_win").first()["re"], kernels.smooth_gaussian(z.real, 2.0)[0])
    cal = CalibrationData("testsens", "20", (1, 2, 3, 4, 5), (10, 11, 12, 13, 14), (0.1, 0.2, 0.3, 0.4, 0.5), 5)
    done = SensorCalibrator().run(sd, {"Hx": cal}).df.orderBy("global_win").first()
    m, p = np.interp(freqs, range(1, 6), range(10, 15)), np.interp(freqs, range(1, 6), [0.1, 0.2, 0.3, 0.4, 0.5])
    assert np.allclose(np.array(done["re"]) + 1j * np.array(done["im"]), z[0] / (m * np.exp(1j * p)))
    assert SensorCalibrator(chans=("Hy",)).run(sd, {"Hx": cal}).df.orderBy("global_win").first()["re"] == rows[0][5]


META = [
    ("site1", "meas1", [(5, 4), (4, 2), (3, 1)]), ("site1", "meas2", [(12, 15), (9, 10), (7, 8)]), ("site1", "meas3", [(7, 41), (4, 38), (2, 35)]),
    ("site2", "run1", [(6, 3), (3, 1)]), ("site2", "run2", [(10, 16), (5, 9)]), ("site3", "data1", [(25, 4), (17, 3)]),
]


def test_selection_golden(spark):
    rows = [(s, m, lev, n, off) for s, m, x in META for lev, (n, off) in enumerate(x)]
    meta = spark.createDataFrame(rows, gather.META)
    wins = {lev: sorted(r["global_win"] for r in gather.site_windows(meta).where(f"site = 'site1' and level = {lev}").collect()) for lev in range(3)}
    assert wins[0] == [*range(4, 9), *range(15, 27), *range(41, 48)] and wins[2] == [1, 2, 3, *range(8, 15), 35, 36]
    parameters = params.DecimationSetup(4, 2).run(128)
    selection = gather.Selector().run(meta, ["site1", "site2", "site3"], parameters)
    got = {lev: sorted({r["global_win"] for r in selection.df.where(f"level = {lev}").collect()}) for lev in (0, 1, 2)}
    assert got == {0: [*range(4, 9), *range(16, 26)], 1: [3, 10, 11, 12, 13], 2: []}
    assert {(r["site"], r["meas"]) for r in selection.measurements().collect()} == {("site1", "meas1"), ("site1", "meas2"), ("site2", "run1"), ("site2", "run2"), ("site3", "data1")}
    assert {r["eval_idx"]: r["n_wins"] for r in selection.n_wins().collect()} == {0: 15, 1: 15, 2: 5, 3: 5}
    mask = spark.createDataFrame([(0, 4)], "level int, global_win long")
    assert gather.Selector().run(meta, ["site1", "site2"], parameters, mask).df.where("level = 0 and global_win = 4").count() == 0


def _gathered(spark, rows, tf):
    """rows: (global_win, {role: {chan: complex}})"""
    flat = []
    for w, roles in rows:
        flat.append((0, w, *[[float(p) for c in chans for p in (roles[r][c].real, roles[r][c].imag)] for r, chans in (("out", tf.out_chans), ("in", tf.in_chans), ("cross", tf.cross_chans))]))
    df = spark.createDataFrame(flat, "eval_idx int, global_win long, o array<double>, i array<double>, c array<double>")
    pick = lambda col, chans, role: F.struct(*[F.col(col)[2 * k + j].alias(f"{ch}_{p}") for k, ch in enumerate(chans) for j, p in enumerate(("re", "im"))]).alias(role)
    return df.select("eval_idx", "global_win", pick("o", tf.out_chans, "out"), pick("i", tf.in_chans, "in"), pick("c", tf.cross_chans, "cross"))


def test_regression_rows_golden(spark):
    tf = transfer.TransferFunction(("Ex", "Ey"), ("Hx", "Hy"))
    out, inp, cross = [[3 - 1j, 4 + 3j], [1 + 2j, 2 + 1j]], [[-1 - 1j, 3j], [-2 - 3j, 4 - 1j]], [[5 + 3j, 2 + 0j], [-2j, 1 - 1j]]
    named = lambda x, chans: dict(zip(chans, x))
    rows = [(w, {"out": named(out[w], tf.out_chans), "in": named(inp[w], tf.in_chans), "cross": named(cross[w], tf.cross_chans)}) for w in (0, 1)]
    got = regression.regression_rows(_gathered(spark, rows, tf), tf).collect()
    key = lambda r: (r["global_win"], r["cross_chan"], r["part"] != "re")
    ex = sorted((r for r in got if r["out_chan"] == "Ex"), key=key)
    ey = sorted((r for r in got if r["out_chan"] == "Ey"), key=key)
    assert [r["y"] for r in ex] == [12, -14, 6, -2, -4, 2, -1, 3] and [r["y"] for r in ey] == [29, 3, 8, 6, -2, 4, 1, 3]
    assert [r["x"] for r in ex] == [[-8, 2, 9, -15], [-2, -8, 15, 9], [-2, 2, 0, -6], [-2, -2, 6, 0], [6, 4, 2, -8], [-4, 6, 8, 2], [1, 5, 5, -3], [-5, 1, 3, 5]]


@pytest.mark.parametrize("solver", [regression.SolverOLS(), regression.SolverKernel("OLS"), regression.SolverHuber(), regression.SolverWLS(), regression.SolverTheilSen(max_subpopulation=300), regression.SolverRANSAC()])
def test_solvers_recover_the_impedance(spark, solver):
    tf, rng = transfer.ImpedanceTensor(), np.random.default_rng(4)
    z = np.array([[1 + 2j, -3 + 0.5j], [2 - 1j, 0.5 + 4j]])
    rows = []
    for w in range(60):
        h = rng.normal(size=2) + 1j * rng.normal(size=2)
        rows.append((w, {"out": dict(zip(("Ex", "Ey"), z @ h)), "in": dict(zip(("Hx", "Hy"), h)), "cross": dict(zip(("Hx", "Hy"), h + 0.1 * rng.normal(size=2)))}))
    solution = solver.run(_gathered(spark, rows, tf), tf, params.DecimationSetup(1, 1).run(128))
    assert np.allclose(solution.tensor(0), z, atol=1e-3)
    rho = {(r["out_chan"], r["in_chan"]): r["resistivity"] for r in tf.resistivity(solution.df).collect()}
    assert rho["Ex", "Hx"] == pytest.approx(0.2 / 32 * 5, rel=1e-2)


def test_phase_and_tipper(spark):
    rows = [(i, 10.0 * (i + 1), 1 / (10 * (i + 1)), "Ex", "Hy", re, im) for i, (re, im) in enumerate([(1, -5), (2, -4), (3, -3), (4, -2), (5, -1)])]
    df = spark.createDataFrame([(a, b, c, d, e, float(f), float(g)) for a, b, c, d, e, f, g in rows], "eval_idx int, freq double, period double, out_chan string, in_chan string, re double, im double")
    got = [r["phase"] for r in transfer.ImpedanceTensor.phase(df).orderBy("eval_idx").collect()]
    want = [math.degrees(math.atan2(r[6], r[5])) % 360 - 180 for r in rows]
    assert got == pytest.approx(want)
    tip = spark.createDataFrame([(0, 1.0, 1.0, "Hz", "Hx", 3.0, 0.0), (0, 1.0, 1.0, "Hz", "Hy", 4.0, 2.0)], df.schema)
    r = transfer.Tipper.arrows(tip).first()
    assert r["length"] == 5 and r["real_angle"] == pytest.approx(math.degrees(math.atan(4 / 3))) and r["imag_angle"] == 90
    with pytest.raises(ParameterError):
        transfer.ImpedanceTensor(variation="a name that is too long")


def test_known_impedance_from_samples(spark):
    """E = 2 Hy, -3 Hx sample by sample: the whole chain gives these numbers at all levels."""
    rng = np.random.default_rng(6)
    hx, hy = rng.normal(size=3000).cumsum(), rng.normal(size=3000).cumsum()
    d = data(spark, {"Ex": 2 * hy, "Ey": -3 * hx, "Hx": hx, "Hy": hy}, fs=16.0)
    config = Configuration(solver=regression.SolverOLS())
    got = pipeline.tf_of(config, d).df.collect()
    assert {r["eval_idx"] // 5 for r in got} == {0, 1}
    want = {("Ex", "Hx"): 0, ("Ex", "Hy"): 2, ("Ey", "Hx"): -3, ("Ey", "Hy"): 0}
    for r in got:
        assert r["re"] == pytest.approx(want[r["out_chan"], r["in_chan"]], abs=1e-6) and r["im"] == pytest.approx(0, abs=1e-6)


def test_streaming_windows(spark, tmp_path):
    rng = np.random.default_rng(8)
    windowed, parameters = _windowed(spark, {"Ex": rng.normal(size=100)}, first="2020-01-01 00:00:00")
    batch = {r["global_win"]: r["re"] for r in spectra.FourierTransform().evals(windowed, parameters).df.collect()}
    source = data(spark, {"Ex": [0.0] * 100}).df
    rows = windowed.df  # the samples themselves, from the windows' first copies
    samples = spark.createDataFrame([("s", "m", 0, "Ex", r["sample"], r["value"]) for r in rows.withColumn("sample", F.col("local_win") * 12 + F.col("pos")).select("sample", "value").distinct().collect()], source.schema)
    samples.withColumn("time", F.timestamp_micros((F.col("sample") * 100_000 + 1577836800_000_000).cast("long"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("site string, meas string, level int, chan string, sample long, value double, time timestamp").parquet(str(tmp_path / "in"))
    grid = windowed.grids["s", "m", 0]
    evals = streaming.stream_evals(stream, grid, 10.0, parameters.level_freqs(0), "2020-01-01", delay_seconds=0.0)
    for mode in ("complete", "append"):
        query = evals.writeStream.format("memory").queryName(f"evals_{mode}").outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
        got = {r["global_win"]: r["re"] for r in spark.table(f"evals_{mode}").collect()}
        # in append mode only windows that the watermark has passed: those that end a window's length before the last
        want = batch if mode == "complete" else {k: v for k, v in batch.items() if k in got}
        assert len(got) >= (len(batch) if mode == "complete" else len(batch) - 4) > 0
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)
