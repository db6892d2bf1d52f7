"""Projects: folders of sites and measurements, and the paths of what is made from them."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tellura.errors import MeasurementNotFoundError, ProjectCreateError, ProjectLoadError, SiteNotFoundError, TelluraError
from tellura.functions import timing
from tellura.functions.channels import fs_to_string
from tellura.operators.gather import concurrent, site_spans
from tellura.operators.params import Recording
from tellura.plans.config import Configuration, default_configuration
from tellura.sources.store import TimeMetadata, TimeReader, dir_subdirs

# fixed values: the folders of a project, and its file
FOLDERS = {"time": "time", "spectra": "spectra", "evals": "evals", "features": "features", "masks": "masks", "calibration": "calibrate", "results": "results", "images": "images"}
PROJECT_FILE = "project.json"


def calibration_path(root: str | Path) -> Path:
    return Path(root) / FOLDERS["calibration"]


def meas_time_path(root: str | Path, site: str, meas: str) -> Path:
    return Path(root) / FOLDERS["time"] / site / meas


def meas_path(root: str | Path, stage: str, site: str, meas: str, config: str) -> Path:
    """Of spectra, evals and features: by site, configuration and measurement."""
    return Path(root) / FOLDERS[stage] / site / config / meas


def mask_path(root: str | Path, site: str, config: str) -> Path:
    return Path(root) / FOLDERS["masks"] / site / config


def mask_name(fs: float, name: str) -> str:
    return f"{fs_to_string(fs)}_{name}.json"


def results_path(root: str | Path, site: str, config: str) -> Path:
    return Path(root) / FOLDERS["results"] / site / config


def solution_name(fs: float, tf_name: str, variation: str, postfix: str | None = None) -> str:
    parts = [fs_to_string(fs), tf_name.lower(), variation.replace(" ", "_"), *([postfix] if postfix else [])]
    return "_".join(parts) + ".json"


@dataclass(frozen=True)
class Measurement:
    site: str
    name: str
    metadata: TimeMetadata
    reader: TimeReader

    @property
    def recording(self) -> Recording:
        return self.metadata.recording(self.site, self.name)


@dataclass(frozen=True)
class Site:
    name: str
    measurements: dict[str, Measurement]

    @property
    def n_meas(self) -> int:
        return len(self.measurements)

    def fs(self) -> list[float]:
        return sorted({m.metadata.fs for m in self.measurements.values()})

    def get_measurement(self, name: str) -> Measurement:
        if name not in self.measurements:
            raise MeasurementNotFoundError(f"{self.name} has no measurement {name}")
        return self.measurements[name]

    def get_measurements(self, fs: float | None = None) -> dict[str, Measurement]:
        return {k: m for k, m in self.measurements.items() if fs is None or m.metadata.fs == fs}


@dataclass(frozen=True)
class Project:
    root: str
    ref_time: str
    sites: dict[str, Site]
    problems: tuple[str, ...] = ()  # folders that no reader could read, and why
    info: dict = field(default_factory=dict, hash=False)

    @property
    def n_sites(self) -> int:
        return len(self.sites)

    def fs(self) -> list[float]:
        return sorted({f for s in self.sites.values() for f in s.fs()})

    def get_site(self, name: str) -> Site:
        if name not in self.sites:
            raise SiteNotFoundError(name)
        return self.sites[name]

    def get_sites(self, fs: float | None = None) -> list[Site]:
        return [s for s in self.sites.values() if fs is None or fs in s.fs()]

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """site, meas, fs, n_samples, first_time, last_time of each measurement."""
        rows = [(s.name, m.name, float(m.metadata.fs), m.metadata.n_samples, timing.to_text(timing.to_instant(m.metadata.first_time)), m.metadata.last_time) for s in self.sites.values() for m in s.measurements.values()]
        return spark.createDataFrame(rows, "site string, meas string, fs double, n_samples long, first_time string, last_time string")

    def spans(self, spark: SparkSession) -> DataFrame:
        """Begin, end and number of measurements of each site; a site without data has none."""
        return site_spans(self.to_dataframe(spark))

    def timeline(self, spark: SparkSession) -> DataFrame:
        """Measurements in order of sampling frequency, site and begin: the table behind a plot of the project's times."""
        return self.to_dataframe(spark).orderBy("fs", "site", "first_time", "meas")

    def get_concurrent(self, spark: SparkSession, site: str) -> DataFrame:
        return concurrent(self.to_dataframe(spark), site)


def new(root: str | Path, ref_time: str, **info: object) -> None:
    """Folders and file of a new project."""
    if (Path(root) / PROJECT_FILE).exists():
        raise ProjectCreateError(f"{root} holds a project")
    for folder in FOLDERS.values():
        (Path(root) / folder).mkdir(parents=True, exist_ok=True)
    (Path(root) / PROJECT_FILE).write_text(json.dumps({"ref_time": timing.to_text(timing.to_instant(ref_time)), **info}))


def load(root: str | Path, config: Configuration | None = None) -> Project:
    """Scan a project: of the configuration's readers the first that can read a measurement's folder has it."""
    path = Path(root) / PROJECT_FILE
    if not path.exists():
        raise ProjectLoadError(f"{root} holds no project")
    missing = [f for f in FOLDERS.values() if not (Path(root) / f).is_dir()]
    if missing:
        raise ProjectLoadError(f"{root} lacks {', '.join(missing)}")
    info = json.loads(path.read_text())
    sites, problems = {}, []
    for site in dir_subdirs(Path(root) / FOLDERS["time"]):
        found = {}
        for folder in dir_subdirs(site):
            errors = []
            for reader in (config or default_configuration()).time_readers:
                try:
                    found[folder.name] = Measurement(site.name, folder.name, reader.metadata(folder), reader)
                    break
                except TelluraError as error:
                    errors.append(f"{type(reader).__name__}: {error}")
            else:
                problems.append(f"{folder}: {'; '.join(errors)}")
        sites[site.name] = Site(site.name, found)
    return Project(str(root), info.pop("ref_time"), sites, tuple(problems), info)
