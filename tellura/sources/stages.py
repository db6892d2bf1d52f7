"""Decimated, windowed and spectra data on disk: a Parquet table and metadata.json with what is known beside the rows, history included."""

from __future__ import annotations

import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tellura.errors import MetadataReadError
from tellura.functions.history import Record
from tellura.operators.decimation import DecimatedData
from tellura.operators.params import DecimationParameters, Recording, WindowGrid
from tellura.operators.spectra import SpectraData
from tellura.operators.timeops import TimeData
from tellura.operators.windows import WindowedData
from tellura.sources.store import assert_file, read_table, target, write_table

Stage = DecimatedData | WindowedData | SpectraData


def _recording(r: Recording) -> dict:
    return {"site": r.site, "meas": r.meas, "fs": r.fs, "n_samples": r.n_samples, "first_time": r.first_time, "chans": list(r.chans)}


def describe(data: Stage) -> dict:
    """What is known of a stage beside its rows, as JSON holds it."""
    told: dict = {"stage": type(data).__name__, "history": [asdict(r) for r in data.history]}
    if isinstance(data, DecimatedData):
        told |= {"parameters": asdict(data.parameters), "levels": [[_recording(r) for r in d.recordings] for d in data.levels]}
    elif isinstance(data, WindowedData):
        told |= {"grids": [[*k, asdict(g)] for k, g in sorted(data.grids.items())], "ref_time": data.ref_time, "fs": list(data.fs)}
    else:
        told |= {"freqs": {str(level): list(f) for level, f in data.freqs.items()}, "windows": None if data.windows is None else describe(data.windows)}
    return told


def write_stage(data: Stage, path: str | Path, overwrite: bool = True) -> None:
    folder = target(path, overwrite)
    write_table(data.df, str(folder / "data"), True, by=("level",))
    (folder / "metadata.json").write_text(json.dumps(describe(data), indent=1))


def read_metadata(path: str | Path) -> dict:
    """The metadata alone, without a look at the table."""
    try:
        return json.loads(assert_file(Path(path) / "metadata.json").read_text())
    except ValueError as error:
        raise MetadataReadError(str(error)) from error


def _grids(told: dict) -> dict[tuple[str, str, int], WindowGrid]:
    return {(site, meas, level): WindowGrid(**g) for site, meas, level, g in told["grids"]}


def read_stage(spark: SparkSession, path: str | Path) -> Stage:
    """The data that write_stage() wrote; windows that spectra were made of come back without their rows."""
    told, df = read_metadata(path), read_table(spark, str(Path(path) / "data"))
    df = df.withColumn("level", F.col("level").cast("int"))
    history = tuple(Record(**{**r, "messages": tuple(r["messages"])}) for r in told["history"])
    if told["stage"] == "DecimatedData":
        names = ("site", "meas", "level", "chan", "sample", "value")
        raw = told["parameters"]
        parameters = DecimationParameters(**{**raw, "freqs": tuple(map(tuple, raw["freqs"])), "factors": tuple(raw["factors"])})
        levels = [tuple(Recording(**{**r, "chans": tuple(r["chans"])}) for r in held) for held in told["levels"]]
        return DecimatedData(tuple(TimeData(df.where(F.col("level") == i).select(*names), held, history) for i, held in enumerate(levels)), parameters)
    if told["stage"] == "WindowedData":
        names = ("site", "meas", "level", "chan", "global_win", "local_win", "pos", "value")
        return WindowedData(df.select(*names), _grids(told), told["ref_time"], tuple(told["fs"]), history)
    if told["stage"] == "SpectraData":
        w = told["windows"]
        windows = None if w is None else WindowedData(df.limit(0), _grids(w), w["ref_time"], tuple(w["fs"]))
        freqs = {int(level): tuple(f) for level, f in told["freqs"].items()}
        return SpectraData(df.select("site", "meas", "level", "chan", "global_win", "re", "im"), freqs, windows, history)
    raise MetadataReadError(f"{path} holds no stage but {told['stage']!r}")
