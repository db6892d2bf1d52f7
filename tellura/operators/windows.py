"""Overlapping windows on the global grid, by numbers of samples."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.errors import ParameterError
from tellura.functions.frames import small
from tellura.functions.history import record
from tellura.operators.decimation import DecimatedData
from tellura.operators.params import WindowGrid, WindowParameters, WindowTarget

GRID = "site string, meas string, level int, _first long, _size int, _step int, _n long, _global long"


@dataclass(frozen=True)
class WindowedData:
    """``df``: (site, meas, level, chan, global_win, local_win, pos, value), a row for each sample of each window."""

    df: DataFrame
    grids: dict[tuple[str, str, int], WindowGrid]
    ref_time: str
    fs: tuple[float, ...]
    history: tuple = ()

    @property
    def n_levels(self) -> int:
        return 1 + max((k[2] for k in self.grids), default=-1)

    def get_level(self, level: int) -> DataFrame:
        if not 0 <= level < self.n_levels:
            raise ParameterError(f"level {level} is not within 0 to {self.n_levels - 1}")
        return self.df.where(F.col("level") == level)

    def get_local(self, level: int, local_win: int) -> DataFrame:
        return self.get_level(level).where(F.col("local_win") == local_win)

    def get_global(self, level: int, global_win: int) -> DataFrame:
        return self.get_level(level).where(F.col("global_win") == global_win)

    def get_chan(self, level: int, chan: str) -> DataFrame:
        return self.get_level(level).where(F.col("chan") == chan)

    def metadata(self) -> DataFrame:
        """site, meas, level, fs, n_wins, win_size, olap_size, index_offset."""
        rows = [(s, m, lev, float(self.fs[lev]), g.n_wins, g.win_size, g.olap_size, g.index_offset) for (s, m, lev), g in sorted(self.grids.items())]
        return self.df.sparkSession.createDataFrame(rows, "site string, meas string, level int, fs double, n_wins long, win_size int, olap_size int, index_offset long")


def assign_windows(samples: DataFrame, grids: dict[tuple[str, str, int], WindowGrid]) -> DataFrame:
    """Each sample once for each window that holds it; windows are complete, as the grid says."""
    rows = [(s, m, lev, g.first_sample, g.win_size, g.step, g.n_wins, g.first_win) for (s, m, lev), g in grids.items()]
    table = small(samples.sparkSession.createDataFrame(rows, GRID), len(rows))
    at = F.col("sample") - F.col("_first")
    low = F.greatest(F.lit(0), F.ceil((at - F.col("_size") + 1) / F.col("_step")))
    high = F.least(F.col("_n") - 1, F.floor(at / F.col("_step")))
    dealt = samples.join(table, ["site", "meas", "level"]).where((at >= 0) & (low <= high)).withColumn("local_win", F.explode(F.sequence(low, high)))
    return dealt.select(
        "site", "meas", "level", "chan", (F.col("local_win") + F.col("_global")).alias("global_win"), "local_win",
        (at - F.col("local_win") * F.col("_step")).cast("int").alias("pos"), "value",
    )


@dataclass(frozen=True)
class Windower:
    """Windows of each level; of a recording, levels end before the first with too few windows."""

    def run(self, ref_time: str, data: DecimatedData, parameters: WindowParameters | WindowTarget) -> WindowedData:
        grids = self.grids(ref_time, data, parameters)
        parts = [assign_windows(d.df, {k: g for k, g in grids.items() if k[2] == lev}) for lev, d in enumerate(data.levels) if any(k[2] == lev for k in grids)]
        if not parts:
            raise ParameterError("no level has enough windows")
        told = record({"name": "Windower", "ref_time": ref_time}, f"{len(parts)} levels in windows")
        return WindowedData(reduce(DataFrame.unionByName, parts), grids, ref_time, tuple(d.fs for d in data.levels), (*data.history, told))

    def grids(self, ref_time: str, data: DecimatedData, parameters: WindowParameters | WindowTarget) -> dict[tuple[str, str, int], WindowGrid]:
        out = {}
        names = [(r.site, r.meas) for r in data.levels[0].recordings]
        for site, meas in names:
            recordings = [next((r for r in d.recordings if (r.site, r.meas) == (site, meas)), None) for d in data.levels]
            recordings = [r for r in recordings if r is not None]
            lengths = [r.n_samples for r in recordings]
            sized = parameters.parameters(lengths) if isinstance(parameters, WindowTarget) else parameters
            found = sized.grids(ref_time, recordings[0].first_time, lengths, [r.fs for r in recordings])
            out |= {(site, meas, level): g for level, g in enumerate(found)}
        return out


WindowerTarget = WindowTarget
