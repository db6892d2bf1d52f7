"""Readers, writers, calibration files, projects and the configuration."""

import bz2
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tellura.errors import CalibrationFileNotFound, ParameterError, ProjectCreateError, TimeDataReadError, WriteError
from tellura.operators import regression
from tellura.operators.params import DecimationSetup, WindowSetup
from tellura.operators.spectra import SpectraSmootherUniform
from tellura.operators.timeops import BandPass, InterpolateNans, Multiply, TimeData
from tellura.operators.transfer import Solution, TransferFunction
from tellura.plans import pipeline, project
from tellura.plans.config import Configuration
from tellura.sources import stages, store
from tellura.sources.calibration import SensorCalibrationJSON, SensorCalibrationTXT, calibration_table
from tellura.sources.store import ChanMetadata, TimeMetadata, TimeReaderAscii, TimeReaderNumpy, TimeWriterAscii, TimeWriterNumpy


def _numpy_folder(folder, array, chans, fs=16.0, first="2020-01-01 00:00:00"):
    folder.mkdir(parents=True, exist_ok=True)
    np.save(folder / "data.npy", array)
    meta = TimeMetadata(fs, tuple(chans), array.shape[1], first, chans_metadata={c: ChanMetadata(c, ("data.npy",), sensor="coil", serial="1") for c in chans})
    (folder / "metadata.json").write_text(meta.to_json())
    return meta


def test_numpy_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(2, 250))
    meta = _numpy_folder(tmp_path / "a", x, ("Ex", "Hx"))
    whole = TimeReaderNumpy().run(spark, tmp_path / "a")
    assert np.array_equal([r["value"] for r in whole.get_chan("Hx").orderBy("sample").collect()], x[1])
    part = TimeReaderNumpy().run(spark, tmp_path / "a", from_time="2020-01-01 00:00:01", to_sample=99)
    assert part.recordings[0].n_samples == 84 and part.get_chan("Ex").orderBy("sample").first()["value"] == x[0][16]
    TimeWriterNumpy().run(tmp_path / "b", meta, part)
    again = TimeReaderNumpy().run(spark, tmp_path / "b")
    assert np.array_equal([r["value"] for r in again.get_chan("Ex").orderBy("sample").collect()], x[0][16:100])
    with pytest.raises(WriteError):
        TimeWriterNumpy(overwrite=False).run(tmp_path / "b", meta, part)
    with pytest.raises(ParameterError):
        TimeReaderNumpy().run(spark, tmp_path / "a", from_sample=50, to_sample=50)
    with pytest.raises(TimeDataReadError):
        TimeReaderAscii().run(spark, tmp_path / "a")


@pytest.mark.parametrize("packed", [False, True])
def test_ascii(spark, tmp_path, packed):
    name = "data.txt.bz2" if packed else "data.txt"
    text = "a header\n" + "".join(f"  {i}\t{i * 0.5:.2f} \n" for i in range(120))
    (tmp_path / name).write_bytes(bz2.compress(text.encode()) if packed else text.encode())
    meta = TimeMetadata(10.0, ("Ex", "Ey"), 120, "2020-01-01", chans_metadata={c: ChanMetadata(c, (name,)) for c in ("Ex", "Ey")})
    (tmp_path / "metadata.json").write_text(meta.to_json())
    d = TimeReaderAscii(extension=".bz2" if packed else ".txt", n_header=1).run(spark, tmp_path, from_sample=10, to_sample=20)
    assert [(r["sample"], r["value"]) for r in d.get_chan("Ey").orderBy("sample").collect()] == [(i, (i + 10) * 0.5) for i in range(11)]
    TimeWriterAscii().run(tmp_path / "out", meta, d)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out" / "Ey.ascii")).collect()] == [f"{(i + 10) * 0.5:.6f}" for i in range(11)]


def test_calibration_files(spark, tmp_path):
    chan = ChanMetadata("Hx", sensor="testsens", serial="20")
    rows = [(1, 10, 0.1), (2, 11, 0.2), (3, 12, 0.3)]
    raw = {"sensor": "testsens", "serial": "20", "static_gain": 5, "magnitude_unit": "mV/nT", "frequency": [1, 2, 3], "magnitude": [10, 11, 12], "phase": [0.1, 0.2, 0.3]}
    (tmp_path / "IC_testsens.json").write_text(json.dumps(raw, indent=1))
    text = "Serial = 20\nSensor = testsens\nStatic gain = 5\nMagnitude unit = mV/nT\nPhase unit = degrees\nChopper = False\n\nCALIBRATION DATA\n"
    (tmp_path / "IC_testsens.TXT").write_text(text + "".join(f"{f} {m} {math.degrees(p)!r}\n" for f, m, p in reversed(rows)) + "\nmore\n")
    a, b = SensorCalibrationJSON().run(tmp_path, chan), SensorCalibrationTXT().run(tmp_path, chan)
    assert (a.sensor, a.serial, a.static_gain, a.frequency, a.magnitude) == (b.sensor, b.serial, b.static_gain, b.frequency, b.magnitude)
    assert a.phase == pytest.approx(b.phase)
    with pytest.raises(CalibrationFileNotFound):
        SensorCalibrationJSON().run(tmp_path, ChanMetadata("Hy", sensor="none"))
    assert calibration_table(spark, str(tmp_path / "*.json")).count() == 3


def test_configuration_round_trip():
    config = Configuration(
        "mine", (TimeReaderAscii(n_header=2),), (InterpolateNans(), Multiply({"Ex": 2.0}), BandPass(cutoff_low=1.0, cutoff_high=2.0)), DecimationSetup(3, 2, eval_freqs=(6.0, 5.0, 4.0, 3.0, 2.0, 1.0)),
        win_setup=WindowSetup(win_sizes=(64, 64, 64)), spectra_processors=(SpectraSmootherUniform(0.2),), solver=regression.SolverHuber(epsilon=1.2),
    )
    assert Configuration.from_json(config.to_json()) == config
    assert Configuration.from_json(Configuration().to_json()) == Configuration()


def test_names(tmp_path):
    assert project.solution_name(0.0004, "Tipper", "i am different", "with_mask") == "0_000400_tipper_i_am_different_with_mask.json"
    assert project.mask_name(128, "m") == "128_000000_m.json"
    assert str(project.meas_path("/p", "evals", "s", "m", "c")) == "/p/evals/s/c/m"
    assert [p.name for p in store.dir_subdirs(tmp_path)] == []


def test_project_with_remote_reference(spark, tmp_path):
    """Three sites; noise in the local magnetic field is absent at the remote one."""
    rng, n = np.random.default_rng(9), 2500
    hx, hy = rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()
    root = tmp_path / "p"
    project.new(root, "2020-01-01 00:00:00", observer="nobody")
    with pytest.raises(ProjectCreateError):
        project.new(root, "2020-01-01")
    _numpy_folder(root / "time/local/m1", np.array([2 * hy, -3 * hx, hx, hy]), ("Ex", "Ey", "Hx", "Hy"))
    _numpy_folder(root / "time/remote/m1", np.array([hx, hy])[:, 300:], ("Hx", "Hy"), first="2020-01-01 00:00:18.75")
    (root / "time/local/broken").mkdir()
    proj = project.load(root)
    assert proj.n_sites == 2 and proj.fs() == [16.0] and len(proj.problems) == 1
    assert [r["site"] for r in proj.get_concurrent(spark, "local").collect()] == ["remote"]
    assert {r["site"]: r["begin"][:19] for r in proj.spans(spark).collect()} == {"local": "2020-01-01 00:00:00", "remote": "2020-01-01 00:00:18"}
    config = Configuration(solver=regression.SolverOLS(), dec_setup=DecimationSetup(n_levels=1, per_level=3))
    for site in ("local", "remote"):
        pipeline.process_time_to_evals(spark, proj, config, site, "m1")
    for cross in (None, "remote"):
        pipeline.process_evals_to_tf(spark, proj, config, 16.0, "local", cross_site=cross, postfix=cross)
        solved = pipeline.get_solution(spark, proj, config, 16.0, "local", cross)
        for z in (solved.tensor(i) for i in range(3)):
            assert np.allclose(z, [[0, 2], [-3, 0]], atol=1e-6)
    quick = pipeline.quick_tf(spark, root / "time/local/m1", config)
    assert np.allclose(quick.tensor(0), [[0, 2], [-3, 0]], atol=1e-6)
    assert quick.component("ExHy").where(F.abs(F.col("re") - 2) < 1e-6).count() == 3


def test_channels_in_files_of_their_own(spark, tmp_path):
    """Files of one channel, plain or with one row, beside a file of two."""
    x = np.random.default_rng(1).normal(size=(4, 60))
    np.save(tmp_path / "both.npy", x[:2])
    np.save(tmp_path / "row.npy", x[2:3])
    np.save(tmp_path / "plain.npy", x[3])
    files = {"Ex": "both.npy", "Hx": "row.npy", "Ey": "both.npy", "Hy": "plain.npy"}
    meta = TimeMetadata(16.0, tuple(files), 60, "2020-01-01", chans_metadata={c: ChanMetadata(c, (f,)) for c, f in files.items()})
    (tmp_path / "metadata.json").write_text(meta.to_json())
    d = TimeReaderNumpy().run(spark, tmp_path, from_sample=10)
    for chan, row in {"Ex": x[0], "Ey": x[1], "Hx": x[2], "Hy": x[3]}.items():
        assert np.array_equal([r["value"] for r in d.get_chan(chan).orderBy("sample").collect()], row[10:])


def test_numpy_writer_leaves_gaps(spark, tmp_path):
    """Blocks are written apart; samples without a row are NaN."""
    meta = TimeMetadata(16.0, ("Ex", "Hx"), 50, "2020-01-01")
    rows = [("s", "m", 0, c, i, float(i)) for c in ("Ex", "Hx") for i in range(50) if not (c == "Hx" and 10 <= i < 30)]
    df = spark.createDataFrame(rows, "site string, meas string, level int, chan string, sample long, value double")
    TimeWriterNumpy(block=8).run(tmp_path / "n", meta, TimeData(df, (meta.recording("s", "m"),)))
    x = np.load(tmp_path / "n/data.npy")
    assert np.array_equal(x[0], np.arange(50.0)) and np.isnan(x[1, 10:30]).all() and np.array_equal(x[1, 30:], np.arange(30.0, 50.0))


def test_stages_come_back_with_their_histories(spark, tmp_path):
    rng = np.random.default_rng(4)
    _numpy_folder(tmp_path / "a", rng.normal(size=(2, 3000)), ("Ex", "Hx"))
    data = pipeline.run_time_processors(Configuration(), TimeReaderNumpy().run(spark, tmp_path / "a", "s", "m"))
    config = Configuration(dec_setup=DecimationSetup(n_levels=2, per_level=3))
    decimated = pipeline.run_decimation(config, data)
    windowed = pipeline.run_windowing(config, decimated, "2020-01-01")
    evals = pipeline.run_evals(config, windowed, config.dec_setup.run(16.0))
    for name, stage in (("d", decimated), ("w", windowed), ("e", evals)):
        stages.write_stage(stage, tmp_path / name)
        told = stages.read_metadata(tmp_path / name)
        again = stages.read_stage(spark, tmp_path / name)
        assert told["stage"] == type(stage).__name__ and type(again) is type(stage) and again.history == stage.history
        assert [json.loads(r.creator)["name"] for r in again.history][:3] == ["TimeReaderNumpy", "InterpolateNans", "RemoveMean"]
        names = stage.df.columns
        plain = lambda df: sorted(map(str, df.select(*names).collect()))
        assert plain(again.df) == plain(stage.df)
    assert stages.read_stage(spark, tmp_path / "d").parameters == decimated.parameters
    assert stages.read_stage(spark, tmp_path / "w").grids == windowed.grids
    assert stages.read_stage(spark, tmp_path / "e").freqs == evals.freqs
    solved = pipeline.tf_of(Configuration(dec_setup=DecimationSetup(n_levels=1, per_level=3), solver=regression.SolverOLS(), tf=TransferFunction(("Ex",), ("Hx",))), data)
    solved.write(str(tmp_path / "s.json"))
    assert [json.loads(r.creator)["name"] for r in Solution.read(spark, str(tmp_path / "s.json")).history][-1] == "SolverOLS" and len(solved.history) > 5
    with pytest.raises(WriteError):
        stages.write_stage(windowed, tmp_path / "w", overwrite=False)
