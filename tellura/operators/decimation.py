"""The decimation pyramid: each level is made from the one above it, as far as the recordings are long enough."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.errors import ParameterError
from tellura.functions.frames import written
from tellura.functions.history import Process
from tellura.operators.params import DecimationParameters
from tellura.operators.timeops import Decimate, Resample, TimeData


@dataclass(frozen=True)
class DecimatedData:
    """Time data by level; ``df`` joins the levels in one table."""

    levels: tuple[TimeData, ...]
    parameters: DecimationParameters

    @property
    def n_levels(self) -> int:
        return len(self.levels)

    def get_level(self, level: int) -> TimeData:
        if not 0 <= level < self.n_levels:
            raise ParameterError(f"level {level} is not within 0 to {self.n_levels - 1}")
        return self.levels[level]

    @property
    def history(self) -> tuple:
        return self.levels[-1].history if self.levels else ()

    @property
    def df(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (d.df for d in self.levels))


@dataclass(frozen=True)
class Decimator(Process):
    """``resample``: by FIR resampling, else by the zero-phase IIR filter. Levels end before the first that is short in all recordings."""

    resample: bool = True
    max_single_factor: int = 3

    def run(self, data: TimeData, parameters: DecimationParameters) -> DecimatedData:
        levels: list[TimeData] = []
        now = data
        for level, step in enumerate(parameters.increments):
            if step > 1:
                process = Resample(now.fs / step) if self.resample else Decimate(step, self.max_single_factor)
                now = process.run(now)
            long = tuple(r for r in now.recordings if r.n_samples >= parameters.min_samples)
            if not long:
                break
            if len(long) < len(now.recordings):
                some = now.df.sparkSession.createDataFrame([(r.site, r.meas) for r in long], "site string, meas string")
                now = replace(now, df=now.df.join(F.broadcast(some), ["site", "meas"]).select(*now.df.columns), recordings=long)
            df = now.df.withColumn("level", F.lit(level))
            history = (*now.history, self.record(f"level {level}, factor {parameters.factors[level]}"))
            now = replace(now, df=written(df, f"level{level}") if step > 1 else df, history=history)
            levels.append(now)
        return DecimatedData(tuple(levels), parameters)
