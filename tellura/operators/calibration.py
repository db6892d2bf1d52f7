"""Sensor calibration: spectra divided by the sensor's response, interpolated at their frequencies."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.functions.history import Process
from tellura.operators.spectra import WIN, SpectraData


@dataclass(frozen=True)
class CalibrationData:
    sensor: str
    serial: str
    frequency: tuple[float, ...]
    magnitude: tuple[float, ...]
    phase: tuple[float, ...]  # radians
    static_gain: float = 1.0
    magnitude_unit: str = "mV/nT"
    chopper: bool = False
    file_path: str | None = None

    def at(self, freqs: object, unwrap: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Magnitude and phase on the line between neighbours, clamped at the ends."""
        order = np.argsort(self.frequency, kind="stable")
        f, m, p = (np.asarray(x, float)[order] for x in (self.frequency, self.magnitude, self.phase))
        return np.interp(freqs, f, m), np.interp(freqs, f, np.unwrap(p) if unwrap else p)

    def plot_data(self, spark) -> DataFrame:
        rows = [(float(f), float(m), float(p), float(np.degrees(p))) for f, m, p in sorted(zip(self.frequency, self.magnitude, self.phase))]
        return spark.createDataFrame(rows, "frequency double, magnitude double, phase double, phase_degrees double")


@dataclass(frozen=True)
class Calibrator(Process):
    chans: tuple[str, ...] | None = None

    def select_chans(self, chans: list[str]) -> list[str]:
        """The configured channels that exist, in the configured order; all if none are configured."""
        return list(chans) if self.chans is None else [c for c in self.chans if c in chans]


@dataclass(frozen=True)
class SensorCalibrator(Calibrator):
    """Channels without calibration pass. ``unwrap`` interpolates the phase without its jumps of a turn."""

    unwrap: bool = False

    def run(self, data: SpectraData, calibrations: dict[str, CalibrationData]) -> SpectraData:
        """``calibrations`` by channel."""
        wanted = {c: calibrations[c] for c in self.select_chans(list(calibrations))}
        rows = []
        for level, freqs in data.freqs.items():
            for chan, cal in wanted.items():
                m, p = cal.at(np.asarray(freqs), self.unwrap)
                z = m * np.exp(1j * p)
                rows.append((level, chan, z.real.tolist(), z.imag.tolist()))
        if not rows:
            return data
        table = F.broadcast(data.df.sparkSession.createDataFrame(rows, "level int, chan string, _cr array<double>, _ci array<double>"))  # a row for each level and channel
        z = F.arrays_zip("re", "im", "_cr", "_ci")
        power = lambda x: x["_cr"] * x["_cr"] + x["_ci"] * x["_ci"]
        re = F.transform(z, lambda x: (x["re"] * x["_cr"] + x["im"] * x["_ci"]) / power(x))
        im = F.transform(z, lambda x: (x["im"] * x["_cr"] - x["re"] * x["_ci"]) / power(x))
        joined = data.df.join(table, ["level", "chan"], "left")
        known = F.col("_cr").isNotNull()
        return replace(data, df=joined.select(*WIN, F.when(known, re).otherwise(F.col("re")).alias("re"), F.when(known, im).otherwise(F.col("im")).alias("im")))


@dataclass(frozen=True)
class InstrumentCalibrator(Calibrator):
    """Declared only: instruments have no calibration format yet."""

    def run(self, data: SpectraData, calibrations: dict[str, CalibrationData]) -> SpectraData:
        raise NotImplementedError("instrument calibration")
