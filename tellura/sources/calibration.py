"""Readers of sensor calibrations."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.errors import CalibrationFileNotFound, CalibrationFileReadError
from tellura.functions.history import Process
from tellura.operators.calibration import CalibrationData
from tellura.sources.store import ChanMetadata


@dataclass(frozen=True)
class CalibrationReader(Process):
    extension: str = ""


@dataclass(frozen=True)
class InstrumentCalibrationReader(CalibrationReader):
    def run(self, metadata: object) -> CalibrationData:
        raise NotImplementedError("instrument calibration")


@dataclass(frozen=True)
class SensorCalibrationReader(CalibrationReader):
    """Finds a channel's file by a template with $sensor, $serial and $extension."""

    file_str: str = "IC_$sensor$extension"

    def path(self, folder: str | Path, chan: ChanMetadata) -> Path:
        name = self.file_str.replace("$sensor", chan.sensor).replace("$serial", chan.serial).replace("$extension", self.extension)
        return Path(folder) / name

    def run(self, folder: str | Path, chan: ChanMetadata) -> CalibrationData:
        path = self.path(folder, chan)
        if not path.exists():
            raise CalibrationFileNotFound(str(path))
        return self.read(path.read_text(), chan, str(path))

    def read(self, text: str, chan: ChanMetadata, path: str) -> CalibrationData:
        raise NotImplementedError


@dataclass(frozen=True)
class SensorCalibrationJSON(SensorCalibrationReader):
    extension: str = ".json"

    def read(self, text: str, chan: ChanMetadata, path: str) -> CalibrationData:
        try:
            raw = json.loads(text)
            return CalibrationData(
                str(raw.get("sensor", chan.sensor)), str(raw.get("serial", chan.serial)), *[tuple(map(float, raw[k])) for k in ("frequency", "magnitude", "phase")],
                float(raw.get("static_gain", 1)), raw.get("magnitude_unit", "mV/nT"), bool(raw.get("chopper", False)), path,
            )
        except (ValueError, KeyError, TypeError) as error:
            raise CalibrationFileReadError(f"{path}: {error}") from error


_HEADER = {"serial": r"^serial\s*=\s*(.*)$", "sensor": r"^sensor\s*=\s*(.*)$", "static_gain": r"^static gain\s*=\s*(.*)$", "chopper": r"^chopper\s*=\s*(.*)$", "magnitude_unit": r"^magnitude unit\s*=\s*(.*)$", "phase_unit": r"^phase unit\s*=\s*(.*)$"}


@dataclass(frozen=True)
class SensorCalibrationTXT(SensorCalibrationReader):
    """``key = value`` lines (read in lower case), then rows of frequency, magnitude and phase from the line after CALIBRATION DATA to a blank one."""

    extension: str = ".TXT"

    def read(self, text: str, chan: ChanMetadata, path: str) -> CalibrationData:
        lines = text.splitlines()
        start = next((i for i, x in enumerate(lines) if "CALIBRATION DATA" in x), None)
        if start is None:
            raise CalibrationFileReadError(f"{path}: no line CALIBRATION DATA")
        head = "\n".join(x.strip().lower() for x in lines[:start])
        found = {k: m[1].strip() for k, p in _HEADER.items() if (m := re.search(p, head, re.M))}
        rows = []
        for line in lines[start + 1 :]:
            if not line.strip():
                break
            rows.append(tuple(map(float, line.split())))
        turn = math.pi / 180 if found.get("phase_unit", "radians") == "degrees" else 1.0
        rows.sort()
        unit = {"mv/nt": "mV/nT"}.get(found.get("magnitude_unit", "mv/nt"), found.get("magnitude_unit"))
        return CalibrationData(
            found.get("sensor", ""), found.get("serial", "1"), tuple(r[0] for r in rows), tuple(r[1] for r in rows), tuple(r[2] * turn for r in rows),
            float(found.get("static_gain", 1)), unit, found.get("chopper", "false") == "true", path,
        )


def calibration_table(spark: SparkSession, path: str) -> DataFrame:
    """(sensor, serial, static_gain, magnitude_unit, frequency, magnitude, phase) of all JSON files under ``path``."""
    schema = "sensor string, serial string, static_gain double, magnitude_unit string, frequency array<double>, magnitude array<double>, phase array<double>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    points = raw.select("sensor", "serial", "static_gain", "magnitude_unit", F.explode(F.arrays_zip("frequency", "magnitude", "phase")).alias("p"))
    return points.select("sensor", "serial", "static_gain", "magnitude_unit", "p.frequency", "p.magnitude", "p.phase")
