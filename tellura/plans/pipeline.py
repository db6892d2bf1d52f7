"""From recordings to transfer functions: the quick way for one recording, and the stages of a project."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tellura.errors import CalibrationFileNotFound, CalibrationFileReadError, SiteNotFoundError, TelluraError, TimeDataReadError
from tellura.operators.decimation import DecimatedData
from tellura.operators.gather import ProjectGather, QuickGather, Roles, Selector
from tellura.operators.params import DecimationParameters, WindowTarget
from tellura.operators.spectra import SpectraData
from tellura.operators.timeops import TimeData
from tellura.operators.transfer import Solution
from tellura.operators.windows import WindowedData, Windower
from tellura.plans import project as projects
from tellura.plans.config import Configuration, default_configuration
from tellura.plans.project import Project
from tellura.sources.store import TimeMetadata, write_table


def quick_read(spark: SparkSession, path: str | Path, config: Configuration | None = None, **bounds: object) -> TimeData:
    errors = []
    for reader in (config or default_configuration()).time_readers:
        try:
            return reader.run(spark, path, **bounds)
        except TelluraError as error:
            errors.append(f"{type(reader).__name__}: {error}")
    raise TimeDataReadError(f"{path}: {'; '.join(errors)}")


def run_time_processors(config: Configuration, data: TimeData) -> TimeData:
    return reduce(lambda d, process: process.run(d), config.time_processors, data)


def run_decimation(config: Configuration, data: TimeData, parameters: DecimationParameters | None = None) -> DecimatedData:
    return config.decimator.run(data, parameters or config.dec_setup.run(data.fs))


def run_windowing(config: Configuration, data: DecimatedData, ref_time: str) -> WindowedData:
    fs = [d.fs for d in data.levels]
    setup = config.win_setup
    return Windower().run(ref_time, data, setup if isinstance(setup, WindowTarget) else setup.run(len(fs), fs))


def run_evals(config: Configuration, data: WindowedData, parameters: DecimationParameters) -> SpectraData:
    """Evaluation values: by one grouped sum, or through whole spectra where there are spectra processors."""
    if not config.spectra_processors:
        return config.fourier.evals(data, parameters)
    return config.evals.run(run_spectra_processors(config, config.fourier.run(data)), parameters)


def run_spectra_processors(config: Configuration, data: SpectraData) -> SpectraData:
    return reduce(lambda d, process: process.run(d), config.spectra_processors, data)


def run_sensor_calibration(config: Configuration, folder: str | Path, meta: TimeMetadata, data: SpectraData) -> tuple[SpectraData, list[str]]:
    """Calibrated data, and why channels have no calibration."""
    found, notes = {}, []
    for chan in config.sensor_calibrator.select_chans(list(meta.chans)):
        for reader in config.calibration_readers:
            try:
                found[chan] = reader.run(folder, meta.chans_metadata[chan])
                break
            except (CalibrationFileNotFound, CalibrationFileReadError) as error:
                notes.append(f"{chan}: {error}")
    return config.sensor_calibrator.run(data, found), notes


def evals_of(config: Configuration, data: TimeData, ref_time: str) -> tuple[SpectraData, DecimationParameters]:
    parameters = config.dec_setup.run(data.fs)
    windowed = run_windowing(config, run_decimation(config, run_time_processors(config, data), parameters), ref_time)
    return run_evals(config, windowed, parameters), parameters


def tf_of(config: Configuration, data: TimeData, ref_time: str | None = None) -> Solution:
    """Transfer function of one recording."""
    evals, parameters = evals_of(config, data, ref_time or data.recordings[0].first_time)
    return _solved(config, QuickGather().run(evals, parameters, config.tf), evals, parameters)


def _solved(config: Configuration, gathered: DataFrame, evals: SpectraData, parameters: DecimationParameters) -> Solution:
    """The solution, with the history of the evaluation values before its own."""
    solution = config.solver.run(gathered, config.tf, parameters)
    return replace(solution, history=(*evals.history, *solution.history))


def quick_view(spark: SparkSession, path: str | Path, config: Configuration | None = None, decimate: bool = False) -> TimeData | DecimatedData:
    config = config or default_configuration()
    data = run_time_processors(config, quick_read(spark, path, config))
    return run_decimation(config, data) if decimate else data


def quick_spectra(spark: SparkSession, path: str | Path, config: Configuration | None = None) -> SpectraData:
    config = config or default_configuration()
    data = run_time_processors(config, quick_read(spark, path, config))
    return config.fourier.run(run_windowing(config, run_decimation(config, data), data.recordings[0].first_time))


def quick_tf(spark: SparkSession, path: str | Path, config: Configuration | None = None, calibration_path: str | Path | None = None) -> Solution:
    config = config or default_configuration()
    data = quick_read(spark, path, config)
    evals, parameters = evals_of(config, data, data.recordings[0].first_time)
    if calibration_path is not None:
        meta = TimeMetadata.from_json((Path(path) / "metadata.json").read_text())
        evals, _ = run_sensor_calibration(config, calibration_path, meta, evals)
    return _solved(config, QuickGather().run(evals, parameters, config.tf), evals, parameters)


def process_time(spark: SparkSession, proj: Project, config: Configuration, site: str, meas: str, **bounds: object) -> TimeData:
    """A measurement after the time processors."""
    m = proj.get_site(site).get_measurement(meas)
    return run_time_processors(config, m.reader.run(spark, projects.meas_time_path(proj.root, site, meas), site, meas, **bounds))


def process_time_to_evals(spark: SparkSession, proj: Project, config: Configuration, site: str, meas: str) -> None:
    """Write a measurement's evaluation values, and the windows they stand for, to the project."""
    m = proj.get_site(site).get_measurement(meas)
    data = m.reader.run(spark, projects.meas_time_path(proj.root, site, meas), site, meas)
    evals, _ = evals_of(config, data, proj.ref_time)
    evals, _ = run_sensor_calibration(config, projects.calibration_path(proj.root), m.metadata, evals)
    folder = projects.meas_path(proj.root, "evals", site, meas, config.name)
    write_table(evals.df, f"{folder}/evals", by=())
    evals.windows.metadata().write.mode("overwrite").parquet(f"{folder}/windows")


def stored_evals(spark: SparkSession, proj: Project, config: Configuration, fs: float, sites: Iterable[str]) -> tuple[SpectraData, DataFrame]:
    """Stored evaluation values of measurements at ``fs``, and their windows; measurements without any are left out."""
    folders = [projects.meas_path(proj.root, "evals", name, meas, config.name) for name in sorted(set(sites)) for meas in proj.get_site(name).get_measurements(fs)]
    stored = [f for f in folders if (f / "windows").exists()]
    if not stored:
        raise SiteNotFoundError(f"no evaluations at {fs} Hz for {sorted(set(sites))}")
    # one scan of all measurements' files each
    evals = spark.read.parquet(*[str(f / "evals") for f in stored])
    windows = spark.read.parquet(*[str(f / "windows") for f in stored])
    parameters = config.dec_setup.run(fs)
    freqs = {level: tuple(parameters.level_freqs(level)) for level in range(parameters.n_levels)}
    return SpectraData(evals, freqs), windows


def process_evals_to_tf(
    spark: SparkSession, proj: Project, config: Configuration, fs: float, out_site: str, in_site: str | None = None, cross_site: str | None = None, masks: DataFrame | None = None, postfix: str | None = None
) -> Solution:
    """Transfer function from stored evaluations: single site, intersite, or with a remote reference. Written to the project's results."""
    roles = Roles(out_site, in_site, cross_site)
    evals, windows = stored_evals(spark, proj, config, fs, roles.sites())
    parameters = config.dec_setup.run(fs)
    selection = Selector().run(windows, list(roles.sites()), parameters, masks)
    gathered = ProjectGather().run(selection, evals, config.tf, roles)
    solution = _solved(config, gathered, evals, parameters)
    solution.write(str(solution_path(proj, config, fs, out_site, postfix)))
    return solution


def solution_path(proj: Project, config: Configuration, fs: float, site: str, postfix: str | None = None) -> Path:
    return projects.results_path(proj.root, site, config.name) / projects.solution_name(fs, config.tf.name, config.tf.variation, postfix)


def get_solution(spark: SparkSession, proj: Project, config: Configuration, fs: float, site: str, postfix: str | None = None) -> Solution:
    return Solution.read(spark, str(solution_path(proj, config, fs, site, postfix)))
