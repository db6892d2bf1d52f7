"""Recordings on disk: a folder with metadata.json and data files, and Parquet tables of the stages."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.errors import MetadataReadError, NotDirectoryError, NotFileError, ParameterError, PathNotFoundError, TimeDataReadError, WriteError
from tellura.functions import channels, timing
from tellura.functions.history import Process, record
from tellura.operators.params import Recording
from tellura.operators.timeops import TimeData
from tellura.sources.ascii import read_ascii, write_parts
from tellura.sources.npy import NpySource

UNKNOWN = -999.0  # the fixed value of a location that is not known


# --- files -----------------------------------------------------------------


def is_file(path: str | Path) -> bool:
    return Path(path).is_file()


def assert_file(path: str | Path) -> Path:
    if not Path(path).exists():
        raise PathNotFoundError(str(path))
    if not Path(path).is_file():
        raise NotFileError(str(path))
    return Path(path)


def is_dir(path: str | Path) -> bool:
    return Path(path).is_dir()


def assert_dir(path: str | Path) -> Path:
    if not Path(path).exists():
        raise PathNotFoundError(str(path))
    if not Path(path).is_dir():
        raise NotDirectoryError(str(path))
    return Path(path)


def dir_contents(path: str | Path) -> tuple[list[Path], list[Path]]:
    """Folders and files in ``path``, by name."""
    every = sorted(assert_dir(path).iterdir())
    return [p for p in every if p.is_dir()], [p for p in every if p.is_file()]


def dir_files(path: str | Path) -> list[Path]:
    return dir_contents(path)[1]


def dir_subdirs(path: str | Path) -> list[Path]:
    return dir_contents(path)[0]


def target(path: str | Path, overwrite: bool = True) -> Path:
    """A folder to write to; with ``overwrite`` false one that doesn't exist."""
    if Path(path).exists() and not overwrite:
        raise WriteError(f"{path} exists")
    os.makedirs(path, exist_ok=True)
    return Path(path)


# --- metadata --------------------------------------------------------------


@dataclass(frozen=True)
class ChanMetadata:
    name: str
    data_files: tuple[str, ...] | None = None
    chan_type: str | None = None
    chan_source: str | None = None
    sensor: str = ""
    serial: str = ""
    gain1: float = 1.0
    gain2: float = 1.0
    scaling: float = 1.0
    chopper: bool = False
    dipole_dist: float = 1.0
    sensor_calibration_file: str = ""
    instrument_calibration_file: str = ""

    def __post_init__(self) -> None:
        if self.chan_type is None:
            object.__setattr__(self, "chan_type", channels.chan_type(self.name))

    def electric(self) -> bool:
        return self.chan_type == channels.ELECTRIC_TYPE

    def magnetic(self) -> bool:
        return self.chan_type == channels.MAGNETIC_TYPE


@dataclass(frozen=True)
class TimeMetadata:
    fs: float
    chans: tuple[str, ...]
    n_samples: int
    first_time: str
    last_time: str | None = None
    chans_metadata: dict[str, ChanMetadata] = field(default_factory=dict)
    system: str = ""
    serial: str = ""
    wgs84_latitude: float = UNKNOWN
    wgs84_longitude: float = UNKNOWN
    easting: float = UNKNOWN
    northing: float = UNKNOWN
    elevation: float = UNKNOWN
    history: tuple = ()

    def __post_init__(self) -> None:
        missing = {c: ChanMetadata(c) for c in self.chans if c not in self.chans_metadata}
        object.__setattr__(self, "chans_metadata", {**self.chans_metadata, **missing})
        last = timing.to_instant(self.first_time) + (self.n_samples - 1) / timing.exact(self.fs)
        object.__setattr__(self, "last_time", timing.to_text(last))

    @property
    def n_chans(self) -> int:
        return len(self.chans)

    def chans_with_type(self, kind: str) -> list[str]:
        return [c for c in self.chans if self.chans_metadata[c].chan_type == kind]

    def electric_chans(self) -> list[str]:
        return self.chans_with_type(channels.ELECTRIC_TYPE)

    def magnetic_chans(self) -> list[str]:
        return self.chans_with_type(channels.MAGNETIC_TYPE)

    def any_electric(self) -> bool:
        return bool(self.electric_chans())

    def any_magnetic(self) -> bool:
        return bool(self.magnetic_chans())

    def chan_types(self) -> list[str]:
        return sorted({self.chans_metadata[c].chan_type for c in self.chans})

    def recording(self, site: str = "", meas: str = "") -> Recording:
        return Recording(site, meas, self.fs, self.n_samples, self.first_time, tuple(self.chans))

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1, default=str)

    @staticmethod
    def from_json(text: str) -> "TimeMetadata":
        try:
            raw = json.loads(text)
            known = ChanMetadata.__dataclass_fields__
            chans = {k: ChanMetadata(**{n: tuple(x) if isinstance(x, list) else x for n, x in v.items() if n in known}) for k, v in raw.get("chans_metadata", {}).items()}
            own = {k: v for k, v in raw.items() if k in TimeMetadata.__dataclass_fields__ and k != "chans_metadata"}
            return TimeMetadata(**{**own, "chans": tuple(raw["chans"]), "chans_metadata": chans, "history": tuple(raw.get("history", ()))})
        except (ValueError, KeyError, TypeError) as error:
            raise MetadataReadError(str(error)) from error


# --- readers ---------------------------------------------------------------


@dataclass(frozen=True)
class TimeReader(Process):
    """Reads a measurement's folder. A time range comes before a sample range; without either all is read."""

    extension: str = ""

    def metadata(self, path: str | Path) -> TimeMetadata:
        meta = TimeMetadata.from_json(assert_file(Path(path) / "metadata.json").read_text())
        for name in sorted({f for c in meta.chans_metadata.values() for f in c.data_files or ()}):
            if not name.endswith(self.extension):
                raise TimeDataReadError(f"{name} doesn't end in {self.extension}")
            assert_file(Path(path) / name)
        return meta

    def sample_range(self, meta: TimeMetadata, from_time: object = None, to_time: object = None, from_sample: int | None = None, to_sample: int | None = None) -> tuple[int, int]:
        a = 0 if from_sample is None else from_sample
        b = meta.n_samples - 1 if to_sample is None else to_sample
        if from_time is not None:
            a = timing.from_time_to_sample(meta.fs, meta.n_samples, meta.first_time, from_time)
        if to_time is not None:
            b = timing.to_time_to_sample(meta.fs, meta.n_samples, meta.first_time, to_time)
        timing.check_sample(meta.n_samples, a)
        timing.check_sample(meta.n_samples, b)
        if a >= b:
            raise ParameterError(f"from sample {a} is not before {b}")
        return a, b

    def run(self, spark: SparkSession, path: str | Path, site: str = "", meas: str = "", **bounds: object) -> TimeData:
        meta = self.metadata(path)
        a, b = self.sample_range(meta, **bounds)
        rows = self.scale(self.rows(spark, Path(path), meta, a, b), meta)
        df = rows.select(F.lit(site).alias("site"), F.lit(meas).alias("meas"), F.lit(0).alias("level"), "chan", F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"))
        first = timing.to_text(timing.sample_to_instant(meta.fs, meta.first_time, a))
        return TimeData(df, (replace(meta.recording(site, meas), n_samples=b - a + 1, first_time=first),), (self.record(f"samples {a} to {b} of {path}"),))

    def rows(self, spark: SparkSession, path: Path, meta: TimeMetadata, a: int, b: int) -> DataFrame:
        raise NotImplementedError

    def scale(self, rows: DataFrame, meta: TimeMetadata) -> DataFrame:
        """For readers whose files hold counts; nothing here."""
        return rows


@dataclass(frozen=True)
class TimeReaderNumpy(TimeReader):
    extension: str = ".npy"

    def rows(self, spark: SparkSession, path: Path, meta: TimeMetadata, a: int, b: int) -> DataFrame:
        """Channels that name the same file are its rows, in order; a file of one channel may be one row or a plain array."""
        spark.dataSource.register(NpySource)
        files: dict[str, list[str]] = {}
        for c in meta.chans:
            files.setdefault((meta.chans_metadata[c].data_files or ("data.npy",))[0], []).append(c)
        parts = [spark.read.format("tellura_npy").options(path=str(path / name), chans=",".join(chans), from_sample=a, to_sample=b).load() for name, chans in files.items()]
        return reduce(DataFrame.unionByName, parts).withColumn("sample", F.col("sample") - a)


@dataclass(frozen=True)
class TimeReaderAscii(TimeReader):
    extension: str = ".txt"
    delimiter: str | None = None
    n_header: int = 0

    def rows(self, spark: SparkSession, path: Path, meta: TimeMetadata, a: int, b: int) -> DataFrame:
        name = next(f for c in meta.chans_metadata.values() for f in c.data_files or ())
        return read_ascii(spark, str(path / name), list(meta.chans), self.delimiter, self.n_header, a, b)


# --- writers ---------------------------------------------------------------


@dataclass(frozen=True)
class TimeWriterNumpy(Process):
    """data.npy and metadata.json, one folder for each measurement; ``data`` has one recording.

    The file is laid out first and tasks write their ranges of samples into
    it, so the folder is one that all executors share; what no row covers is NaN.
    """

    overwrite: bool = True
    block: int = 1 << 20

    def run(self, path: str | Path, meta: TimeMetadata, data: TimeData) -> None:
        folder = target(path, self.overwrite)
        n, file, block = data.recordings[0].n_samples, str(Path(folder).absolute() / "data.npy"), self.block
        array = np.lib.format.open_memmap(file, mode="w+", dtype=np.float64, shape=(meta.n_chans, n))
        for a in range(0, n, block):
            array[:, a : a + block] = np.nan
        array.flush()
        row = {c: i for i, c in enumerate(meta.chans)}

        def write(key: tuple, group: pa.Table) -> pa.Table:
            held = np.load(file, mmap_mode="r+")
            held[row[key[0].as_py()], np.asarray(group.column("sample").combine_chunks())] = np.asarray(group.column("value").combine_chunks(), np.float64)
            held.flush()
            return pa.table({"n": [group.num_rows]})

        dealt = data.df.select("chan", F.floor(F.col("sample") / block).alias("block"), "sample", "value")
        dealt.groupBy("chan", "block").applyInArrow(write, "n long").agg(F.sum("n")).collect()
        named = {c: replace(m, data_files=("data.npy",)) for c, m in meta.chans_metadata.items()}
        done = replace(meta, chans_metadata=named, n_samples=n, first_time=data.recordings[0].first_time, history=(*meta.history, asdict(record(self.to_dict(), "written"))))
        (folder / "metadata.json").write_text(done.to_json())


@dataclass(frozen=True)
class TimeWriterAscii(Process):
    """A folder ``<chan>.ascii`` of text parts for each channel, a value with six decimals a line, in order; one pass for all channels, on a folder that all executors share."""

    overwrite: bool = True

    def run(self, path: str | Path, meta: TimeMetadata, data: TimeData) -> None:
        folder = target(path, self.overwrite)
        parts = {str(Path(folder / f"{c}.ascii").absolute()): (c,) for c in meta.chans}
        for part in parts:
            shutil.rmtree(part, ignore_errors=True)
            os.makedirs(part)
        write_parts(data.df, parts, sum(r.n_samples * len(r.chans) for r in data.recordings))
        (folder / "metadata.json").write_text(meta.to_json())


#: Samples, or windows, of a part of a stage's table.
PART = {"sample": 1 << 22, "global_win": 1 << 14}


def write_table(df: DataFrame, path: str, overwrite: bool = True, by: tuple[str, ...] = ("site", "meas", "level")) -> None:
    """A stage's table as Parquet, a folder for each of ``by``, so that a read of some prunes the others; ranges of samples or windows are files of their own."""
    keys = [c for c in by if c in df.columns]
    ranges = [F.floor(F.col(c) / n) for c, n in PART.items() if c in df.columns][:1]
    dealt = df.repartition(*keys, *ranges) if keys or ranges else df
    writer = dealt.write.mode("overwrite" if overwrite else "error")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def read_table(spark: SparkSession, path: str, level: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if level is None else df.where(F.col("level") == level)
