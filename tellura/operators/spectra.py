"""Spectra of windows, evaluation frequencies, smoothing and stacks.

Two physical ways lead to evaluation frequencies. Without spectra processors
one grouped sum does it: the transform at a frequency is linear in the samples,
and so are the trend's removal, the taper, and the interpolation between two
bins, so each value is a sum of samples times constants. Otherwise windows are
packed into arrays and transformed whole by a NumPy kernel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellura.errors import ChannelNotFoundError, ParameterError
from tellura.functions import kernels
from tellura.functions.frames import double_array
from tellura.functions.history import Process
from tellura.operators.params import DecimationParameters, inc_duration, win_start
from tellura.operators.windows import WindowedData

WIN = ("site", "meas", "level", "chan", "global_win")
PACKED = "site string, meas string, level int, chan string, global_win long, re array<double>, im array<double>"


@dataclass(frozen=True)
class SpectraData:
    """``df``: (site, meas, level, chan, global_win, re, im), arrays over the frequencies of the level."""

    df: DataFrame
    freqs: dict[int, tuple[float, ...]]
    windows: WindowedData | None = None
    history: tuple = ()

    @property
    def n_levels(self) -> int:
        return len(self.freqs)

    def get_level(self, level: int) -> "SpectraData":
        if level not in self.freqs:
            raise ParameterError(f"level {level} is not within 0 to {self.n_levels - 1}")
        return replace(self, df=self.df.where(F.col("level") == level), freqs={level: self.freqs[level]})

    def get_chan(self, *chans: str) -> "SpectraData":
        if not chans:
            raise ChannelNotFoundError("none")
        return replace(self, df=self.df.where(F.col("chan").isin(*chans)))

    def get_freq(self, level: int, index: int) -> DataFrame:
        if not 0 <= index < len(self.freqs[level]):
            raise ParameterError(f"frequency {index} is not within 0 to {len(self.freqs[level]) - 1}")
        return self.df.where(F.col("level") == level).select(*WIN, F.col("re")[index].alias("re"), F.col("im")[index].alias("im"))

    def long(self) -> DataFrame:
        """A row (site, meas, level, chan, global_win, freq_idx, freq, re, im) for each value."""
        names = self.df.select(*WIN, F.posexplode(F.arrays_zip("re", "im")).alias("freq_idx", "v"))
        freq = F.lit(None).cast("double")
        for level, f in self.freqs.items():
            freq = F.when(F.col("level") == level, F.element_at(double_array(f), F.col("freq_idx") + 1)).otherwise(freq)
        return names.select(*WIN, "freq_idx", freq.alias("freq"), "v.re", "v.im")

    def mag_phs(self, unwrap: bool = False) -> DataFrame:
        """long() with mag and phs (radians); ``unwrap`` takes out jumps of more than half a turn over frequency."""
        rows = self.long().withColumn("mag", F.hypot("re", "im")).withColumn("phs", F.atan2("im", "re"))
        return rows.withColumn("phs", unwrapped("phs", Window.partitionBy(*WIN).orderBy("freq_idx"))) if unwrap else rows


def unwrapped(name: str, order: Window) -> Column:
    """Phases (radians) less the whole turns by which neighbours jump."""
    step = F.col(name) - F.lag(name).over(order)
    turns = F.when(F.abs(step) > math.pi, -F.ceil((step - math.pi) / (2 * math.pi))).otherwise(0)
    return F.col(name) + F.sum(F.coalesce(turns, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)) * 2 * math.pi


def bin_freqs(win_size: int, fs: float) -> np.ndarray:
    n = kernels.next_fast_len(win_size)
    return np.arange(n // 2 + 1) * fs / n


def eval_weights(win_size: int, fs: float, freqs: tuple[float, ...], win_fnc: object = ("kaiser", 14)) -> np.ndarray:
    """Rows of constants, one for each frequency: value = sum over the detrended window of sample times constant."""
    n = kernels.next_fast_len(win_size)
    p = np.arange(win_size)
    window = kernels.taper(win_fnc, win_size)
    last = n // 2
    rows = []
    for f in freqs:
        at = min(max(f * n / fs, 0.0), float(last))
        low = min(int(at), max(last - 1, 0))
        part = at - low
        bins = [np.exp(-2j * np.pi * k * p / n) for k in (low, low + 1)]
        rows.append(window * ((1 - part) * bins[0] + part * bins[1]) / math.sqrt(n))
    return np.array(rows)


@dataclass(frozen=True)
class FourierTransform(Process):
    win_fnc: object = ("kaiser", 14)
    detrend: str | None = "linear"

    def run(self, data: WindowedData) -> SpectraData:
        """Spectra of all windows at all bins, by the array kernel."""
        parts, freqs = [], {}
        for level in range(data.n_levels):
            size = next(g.win_size for k, g in data.grids.items() if k[2] == level)
            sizes = {k[:2]: g.win_size for k, g in data.grids.items() if k[2] == level}
            if set(sizes.values()) != {size}:
                raise ParameterError(f"recordings have different window sizes on level {level}: {sizes}")
            packed = data.get_level(level).groupBy(*WIN).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("v"))
            window, n = kernels.taper(self.win_fnc, size), kernels.next_fast_len(size)
            parts.append(packed.mapInArrow(_transform_kernel(window, self.detrend, n), PACKED))
            freqs[level] = tuple(bin_freqs(size, data.fs[level]).tolist())
        return SpectraData(reduce(DataFrame.unionByName, parts), freqs, data, (*data.history, self.record("spectra of whole windows")))

    def evals(self, data: WindowedData, parameters: DecimationParameters) -> SpectraData:
        """Values at the evaluation frequencies in one grouped sum; equal to run() and EvaluationFreqs."""
        parts, freqs = [], {}
        for level in range(data.n_levels):
            size = next(g.win_size for k, g in data.grids.items() if k[2] == level)
            freqs[level] = tuple(parameters.level_freqs(level))
            parts.append(one_pass(data.get_level(level), eval_weights(size, data.fs[level], freqs[level], self.win_fnc), self.detrend))
        return SpectraData(reduce(DataFrame.unionByName, parts), freqs, data, (*data.history, self.record("values at the evaluation frequencies")))


def one_pass(rows: DataFrame, weights: np.ndarray, detrend: str | None, keys: tuple[str, ...] = WIN) -> DataFrame:
    """(re, im) arrays of each window (by ``keys``) of ``rows`` (keys, pos, value): sums of value times constant, less the trend's share."""
    n_freqs, size = weights.shape
    pos, v = F.col("pos"), F.col("value").cast("double")
    pick = lambda w: F.element_at(double_array(w), pos + 1)
    sums = [F.sum(v * pick(x)).alias(f"{part}{k}") for k in range(n_freqs) for part, x in (("re", weights[k].real), ("im", weights[k].imag))]
    centre = (size - 1) / 2
    grouped = rows.groupBy(*keys).agg(*sums, F.avg(v).alias("_mean"), F.sum(v * (pos - centre)).alias("_slope"))
    spread = float(((np.arange(size) - centre) ** 2).sum()) or 1.0

    def value(k: int, part: str) -> Column:
        w = weights[k].real if part == "re" else weights[k].imag
        out = F.col(f"{part}{k}")
        if detrend is not None:
            out = out - F.col("_mean") * float(w.sum())
        if detrend == "linear":
            out = out - F.col("_slope") * float((w * (np.arange(size) - centre)).sum() / spread)
        return out

    return grouped.select(*keys, *[F.array(*[value(k, part) for k in range(n_freqs)]).alias(part) for part in ("re", "im")])


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _transform_kernel(window: np.ndarray, detrend: str | None, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = kernels.spectrum(_rows(batch.column("v")), window, detrend, n)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in WIN], _lists(z.real), _lists(z.imag)], [*WIN, "re", "im"])

    return run


@dataclass(frozen=True)
class EvaluationFreqs(Process):
    def run(self, data: SpectraData, parameters: DecimationParameters) -> SpectraData:
        """Complex values on the line between the two bins around each evaluation frequency."""
        re = im = F.array().cast("array<double>")
        freqs = {}
        for level, bins in data.freqs.items():
            wanted = parameters.level_freqs(level)
            freqs[level] = tuple(wanted)
            spots = [_bracket(np.asarray(bins), f) for f in wanted]
            line = lambda name, spots=spots: F.array(*[F.col(name)[a] * (1 - w) + F.col(name)[min(a + 1, len(bins) - 1)] * w for a, w in spots])  # noqa: B023, E731
            here = F.col("level") == level
            re, im = F.when(here, line("re")).otherwise(re), F.when(here, line("im")).otherwise(im)
        return replace(data, df=data.df.select(*WIN, re.alias("re"), im.alias("im")), freqs=freqs)


def _bracket(bins: np.ndarray, f: float) -> tuple[int, float]:
    """Index of the bin below ``f`` and the weight of the one above; clamped at the ends."""
    if f <= bins[0] or len(bins) == 1:
        return 0, 0.0
    if f >= bins[-1]:
        return len(bins) - 1, 0.0
    a = int(np.searchsorted(bins, f, side="right")) - 1
    return a, float((f - bins[a]) / (bins[a + 1] - bins[a]))


@dataclass(frozen=True)
class SpectraProcess(Process):
    def run(self, data: SpectraData) -> SpectraData:
        raise NotImplementedError


def _smooth_kernel(weights_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.asarray(batch.column("level"))
            for level in np.unique(levels):
                part = batch.take(pa.array(np.flatnonzero(levels == level)))
                re, im = _rows(part.column("re")), _rows(part.column("im"))
                out = [_lists(kernels._smooth(x, weights_of(x.shape[1]))) for x in (re, im)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in WIN], *out], [*WIN, "re", "im"])

    return run


@dataclass(frozen=True)
class SpectraSmootherUniform(SpectraProcess):
    length_proportion: float = 0.1

    def run(self, data: SpectraData) -> SpectraData:
        def weights(n: int) -> np.ndarray:
            width = kernels.uniform_width(self.length_proportion, n)
            return np.full(width, 1 / width)

        return replace(data, df=data.df.mapInArrow(_smooth_kernel(weights), PACKED))


@dataclass(frozen=True)
class SpectraSmootherGaussian(SpectraProcess):
    sigma: float = 3.0

    def run(self, data: SpectraData) -> SpectraData:
        return replace(data, df=data.df.mapInArrow(_smooth_kernel(lambda n: kernels.gaussian_weights(self.sigma)), PACKED))


# --- stacks: what the plots show -------------------------------------------


def stack(data: SpectraData) -> DataFrame:
    """Mean amplitude over windows: (level, chan, freq_idx, freq, amplitude)."""
    return data.long().groupBy("level", "chan", "freq_idx", "freq").agg(F.avg(F.hypot("re", "im")).alias("amplitude"))


def with_start(data: SpectraData) -> DataFrame:
    """long() with win_start, the time at which the window begins."""
    w = data.windows
    start = F.lit(None).cast("timestamp_ntz")
    for level in data.freqs:
        g = next(g for k, g in w.grids.items() if k[2] == level)
        at = win_start(F.col("global_win"), w.ref_time, inc_duration(g.win_size, g.olap_size, w.fs[level]))
        start = F.when(F.col("level") == level, at).otherwise(start)
    return data.long().withColumn("win_start", start)


def stack_by_time(data: SpectraData, group: str | None = None, offset: str = "0 seconds") -> DataFrame:
    """Mean amplitude of tumbling groups of windows; a group lasts the whole days of the data if not given."""
    rows = with_start(data)
    if group is None:
        w = data.windows
        spans = [(g.n_wins - 1) * g.step / w.fs[k[2]] for k, g in w.grids.items()]
        group = f"{max(1, math.ceil(max(spans) / 86400))} days"
    return rows.groupBy(F.window("win_start", group, group, offset).alias("w"), "level", "chan", "freq_idx", "freq").agg(F.avg(F.hypot("re", "im")).alias("amplitude")).select(F.col("w.start").alias("group_start"), "level", "chan", "freq_idx", "freq", "amplitude")


def section(data: SpectraData, level: int, group: str = "30 minutes") -> DataFrame:
    """Spectrogram: log10 of the mean amplitude of each group of windows."""
    rows = stack_by_time(data.get_level(level), group)
    return rows.withColumn("log_amplitude", F.when(F.col("amplitude") > 0, F.log10("amplitude")))


def section_range(rows: DataFrame) -> DataFrame:
    """Whole limits of a section's colours by channel."""
    return rows.groupBy("chan").agg(F.ceil(F.min("log_amplitude")).alias("low"), F.floor(F.max("log_amplitude")).alias("high"))
