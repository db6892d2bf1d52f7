"""Windows and their evaluation values over a stream of samples.

The stream has the columns site, meas, level, chan, sample and value. Windows
are those of the batch grid: a window's values are sums over its samples, so the
state is a row of sums for each window that the watermark has not passed.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.functions.timing import to_instant
from tellura.operators.params import WindowGrid
from tellura.operators.spectra import WIN, eval_weights, one_pass
from tellura.operators.windows import assign_windows


def _dealt(samples: DataFrame, grid: WindowGrid) -> DataFrame:
    at = F.col("sample") - grid.first_sample
    low, high = F.greatest(F.lit(0), F.ceil((at - grid.win_size + 1) / grid.step)), F.floor(at / grid.step)
    dealt = samples.where((at >= 0) & (low <= high)).withColumn("local_win", F.explode(F.sequence(low, high)))
    return dealt.withColumn("global_win", F.col("local_win") + grid.first_win).withColumn("pos", (at - F.col("local_win") * grid.step).cast("int"))


def stream_windows(samples: DataFrame, grid: WindowGrid, time_col: str, delay: str = "1 minute") -> DataFrame:
    """Samples by window, with a watermark on ``time_col``; the grid runs on without an end."""
    return _dealt(samples.withWatermark(time_col, delay), grid)


def stream_evals(
    samples: DataFrame, grid: WindowGrid, fs: float, freqs: tuple[float, ...], first_time: object, delay_seconds: float = 60.0, win_fnc: object = ("kaiser", 14), detrend: str | None = "linear"
) -> DataFrame:
    """(WIN, win_end, re, im) of windows; ``first_time`` is the time of sample 0.

    ``win_end``, the time just after a window's last sample, is its event time:
    in append mode a window's row comes, and its sums leave the state, when the
    watermark passes it. Samples of a window end no later than a window's length
    after their own time, so the watermark stays that and ``delay_seconds`` behind.
    """
    end = (F.lit(grid.first_sample) + F.col("local_win") * grid.step + grid.win_size).cast("double") * (1e6 / fs)
    micros = F.floor(end + 0.5).cast("long") + math.floor(to_instant(first_time) * 10**6)
    rows = _dealt(samples, grid).withColumn("win_end", F.timestamp_micros(micros))
    late = math.ceil((grid.win_size / fs + delay_seconds) * 1000)
    weights = eval_weights(grid.win_size, fs, freqs, win_fnc)
    return one_pass(rows.withWatermark("win_end", f"{late} milliseconds"), weights, detrend, (*WIN, "win_end"))


def stream_hourly_stack(samples: DataFrame, time_col: str, size: str, slide: str, delay: str) -> DataFrame:
    """Sliding means of each channel by event time, complete when the watermark passes."""
    w = F.window(time_col, size, slide)
    return samples.withWatermark(time_col, delay).groupBy(w.alias("w"), "site", "chan").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "site", "chan", "n", "mean")


__all__ = ["WIN", "assign_windows", "stream_windows", "stream_evals", "stream_hourly_stack"]
