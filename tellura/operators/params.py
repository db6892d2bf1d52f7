"""Evaluation frequencies, decimation and window parameters: exact arithmetic on the driver, no data needed."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import timedelta
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.errors import ParameterError
from tellura.functions import timing
from tellura.functions.timing import exact, to_instant

# --- frequencies -----------------------------------------------------------


def eval_freq(fs: float, i: int) -> float:
    """The i-th evaluation frequency from 0: fs / 4, then half an octave lower each."""
    return fs / 4 / 2 ** (i / 2)


def eval_freqs(fs: float, f_min: float | None = None, n_freqs: int | None = None) -> list[float]:
    """Falling frequencies, down to ``f_min`` or ``n_freqs`` of them."""
    if f_min is not None:
        if not 0 < f_min <= fs / 4:
            raise ParameterError(f"minimum frequency {f_min} is not within 0 to {fs / 4}")
        last = math.floor(2 * math.log2(fs / 4 / f_min) + 1e-9)
        return [eval_freq(fs, i) for i in range(last + 1)]
    if n_freqs is None:
        raise ParameterError("give a minimum frequency or a number of frequencies")
    return [eval_freq(fs, i) for i in range(n_freqs)]


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        while n % p == 0:
            out.append(p)
            n //= p
        p += 1
    return out + [n] * (n > 1)


def downsample_steps(factor: int, largest: int = 3) -> list[int]:
    """Factors of single steps, none above ``largest`` unless a prime is: primes are multiplied up in order while they fit.

    A prime above ``largest`` stands after a step of 1, as it can't be split.
    """
    if factor <= largest:
        return [factor]
    steps, now = [], 1
    for p in prime_factors(factor):
        if now * p > largest:
            steps.append(now)
            now = p
        else:
            now *= p
    return [*steps, now]


# --- decimation ------------------------------------------------------------


@dataclass(frozen=True)
class DecimationParameters:
    fs: float
    n_levels: int
    per_level: int
    min_samples: int
    freqs: tuple[tuple[float, ...], ...]
    factors: tuple[int, ...]

    @property
    def increments(self) -> tuple[int, ...]:
        """Factor of each level to the one above it."""
        return tuple(f // g for f, g in zip(self.factors, (1, *self.factors)))

    @property
    def dec_fs(self) -> tuple[float, ...]:
        return tuple(self.fs / f for f in self.factors)

    def check_level(self, level: int) -> None:
        if not 0 <= level < self.n_levels:
            raise ParameterError(f"level {level} is not within 0 to {self.n_levels - 1}")

    def level_freqs(self, level: int) -> tuple[float, ...]:
        self.check_level(level)
        return self.freqs[level]

    def eval_idx(self, level: int, i: int) -> int:
        return self.per_level * level + i

    def split_idx(self, eval_idx: int) -> tuple[int, int]:
        return divmod(eval_idx, self.per_level)

    def levels_for(self, n_samples: int, lengths: str = "resample") -> list[int]:
        """Samples of each level of the pyramid, to the last with ``min_samples``: what exists without a look at the data."""
        out = []
        for step in self.increments:
            n_samples = n_samples if step == 1 else -(-n_samples // step)
            if n_samples < self.min_samples:
                break
            out.append(n_samples)
        return out

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """A row for each evaluation frequency."""
        rows = [(lev, i, self.eval_idx(lev, i), f, self.factors[lev], self.increments[lev], self.dec_fs[lev]) for lev in range(self.n_levels) for i, f in enumerate(self.freqs[lev])]
        return spark.createDataFrame(rows, "level int, freq_idx int, eval_idx int, freq double, factor int, increment int, fs double")


@dataclass(frozen=True)
class DecimationSetup:
    n_levels: int = 8
    per_level: int = 5
    min_samples: int = 256
    div_factor: int = 2
    eval_freqs: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        if min(self.n_levels, self.per_level, self.min_samples) < 1 or self.div_factor < 2:
            raise ParameterError("levels, frequencies and samples are positive, the factor is 2 or more")

    def run(self, fs: float) -> DecimationParameters:
        n = self.n_levels * self.per_level
        every = eval_freqs(fs, n_freqs=n) if self.eval_freqs is None else list(self.eval_freqs)
        if len(every) != n:
            raise ParameterError(f"{self.n_levels} levels of {self.per_level} take {n} frequencies, not {len(every)}")
        if any(f > fs / 2 for f in every):
            raise ParameterError(f"a frequency is above the nyquist frequency {fs / 2}")
        levels = [tuple(every[i : i + self.per_level]) for i in range(0, n, self.per_level)]
        return DecimationParameters(fs, self.n_levels, self.per_level, self.min_samples, tuple(levels), tuple(self._factor(fs, max(x)) for x in levels))

    def _factor(self, fs: float, highest: float) -> int:
        """Largest power of ``div_factor`` that leaves four samples in a period of ``highest``."""
        k = 0
        while fs / self.div_factor ** (k + 1) >= 4 * highest:
            k += 1
        return self.div_factor**k


# --- windows ---------------------------------------------------------------


def win_duration(win_size: int, fs: float) -> Fraction:
    """Between the first and the last sample of a window."""
    return (win_size - 1) / exact(fs)


def inc_duration(win_size: int, olap_size: int, fs: float) -> Fraction:
    """Between the starts of neighbouring windows."""
    if not 0 <= olap_size < win_size:
        raise ParameterError(f"an overlap of {olap_size} leaves no step for windows of {win_size}")
    return (win_size - olap_size) / exact(fs)


def win_to_instant(ref_time: object, global_win: int, increment: Fraction) -> Fraction:
    return to_instant(ref_time) + global_win * increment


def instant_to_win(ref_time: object, time: object, increment: Fraction | timedelta, method: str = "round") -> int:
    """Global window whose start is nearest, or next before or after; halves go to the even window."""
    ref, at = to_instant(ref_time), to_instant(time)
    if at < ref:
        raise ParameterError("a time before the reference time has no window")
    return timing.rounded((at - ref) / timing.to_span(increment), method)


def first_and_last_win(ref_time: object, first_time: object, last_time: object, fs: float, win_size: int, olap_size: int) -> tuple[int, int]:
    """Global windows that lie in a recording: the first that starts in it to the last that ends in it."""
    increment, duration = inc_duration(win_size, olap_size, fs), win_duration(win_size, fs)
    ref, first, last = (to_instant(t) for t in (ref_time, first_time, last_time))
    begin = instant_to_win(ref, first, increment, "ceil")
    end = math.floor((last - duration - ref) / increment)
    if last < first or end < begin:
        raise ParameterError(f"no window of {win_size} samples lies in the recording")
    return begin, end


@dataclass(frozen=True)
class WindowGrid:
    """Windows of one level of one recording on the global grid.

    ``first_win`` is the global number of the local window 0, which begins at
    ``first_sample``; window k begins ``k * step`` samples later.
    """

    win_size: int
    olap_size: int
    first_win: int
    n_wins: int
    first_sample: int

    @property
    def step(self) -> int:
        return self.win_size - self.olap_size

    @property
    def index_offset(self) -> int:
        """Global less local window number."""
        return self.first_win


def window_grid(ref_time: object, first_time: object, n_samples: int, fs: float, win_size: int, olap_size: int) -> WindowGrid:
    first = to_instant(first_time)
    last = first + (n_samples - 1) / exact(fs)
    increment = inc_duration(win_size, olap_size, fs)
    begin, end = first_and_last_win(ref_time, first, last, fs, win_size, olap_size)
    at = math.floor((win_to_instant(ref_time, begin, increment) - first) * exact(fs))
    n_wins = min(end - begin + 1, (n_samples - at - win_size) // (win_size - olap_size) + 1)
    return WindowGrid(win_size, olap_size, begin, n_wins, at)


def window_table(spark: SparkSession, grid: WindowGrid, ref_time: object, fs: float) -> DataFrame:
    """Columns global_win, local_win, from_sample, to_sample, win_start, win_end of each window."""
    increment, duration = inc_duration(grid.win_size, grid.olap_size, fs), win_duration(grid.win_size, fs)
    local = F.col("id")
    start = win_start(local + grid.first_win, ref_time, increment)
    return spark.range(grid.n_wins).select(
        (local + grid.first_win).alias("global_win"), local.alias("local_win"),
        (local * grid.step + grid.first_sample).alias("from_sample"), (local * grid.step + grid.first_sample + grid.win_size - 1).alias("to_sample"),
        start.alias("win_start"), win_start(local + grid.first_win, to_instant(ref_time) + duration, increment).alias("win_end"),
    )


def win_start(global_win, ref_time: object, increment: Fraction):
    """TIMESTAMP_NTZ of a window number column, to the microsecond."""
    return timing.sample_time(global_win, 1 / increment, ref_time)


@dataclass(frozen=True)
class WindowParameters:
    n_levels: int
    min_n_wins: int
    win_sizes: tuple[int, ...]
    olap_sizes: tuple[int, ...]

    def check_level(self, level: int) -> None:
        if not 0 <= level < self.n_levels:
            raise ParameterError(f"level {level} is not within 0 to {self.n_levels - 1}")

    def win_size(self, level: int) -> int:
        self.check_level(level)
        return self.win_sizes[level]

    def olap_size(self, level: int) -> int:
        self.check_level(level)
        return self.olap_sizes[level]

    def grids(self, ref_time: object, first_time: object, n_samples: list[int], fs: list[float] | tuple[float, ...]) -> list[WindowGrid]:
        """Grids of the levels, to the last before one with fewer than ``min_n_wins`` windows."""
        out = []
        for level, (n, f) in enumerate(zip(n_samples[: self.n_levels], fs)):
            try:
                grid = window_grid(ref_time, first_time, n, f, self.win_sizes[level], self.olap_sizes[level])
            except ParameterError:
                break
            if grid.n_wins < self.min_n_wins:
                break
            out.append(grid)
        return out


@dataclass(frozen=True)
class WindowSetup:
    min_size: int = 128
    min_olap: int = 32
    win_factor: int = 4
    olap_proportion: float = 0.25
    min_n_wins: int = 5
    win_sizes: tuple[int, ...] | None = None
    olap_sizes: tuple[int, ...] | None = None

    def run(self, n_levels: int, dec_fs: list[float] | tuple[float, ...]) -> WindowParameters:
        sizes = self._given(self.win_sizes, n_levels, "window") or tuple(max(self.min_size, int(fs // self.win_factor)) for fs in dec_fs[:n_levels])
        olaps = self._given(self.olap_sizes, n_levels, "overlap") or tuple(max(self.min_olap, int(s * self.olap_proportion)) for s in sizes)
        if any(o >= s for o, s in zip(olaps, sizes)):
            raise ParameterError("an overlap is as long as its window")
        return WindowParameters(n_levels, self.min_n_wins, sizes, olaps)

    @staticmethod
    def _given(sizes: tuple[int, ...] | None, n_levels: int, what: str) -> tuple[int, ...] | None:
        if sizes is None:
            return None
        if len(sizes) < n_levels:
            raise ParameterError(f"{n_levels} levels need as many {what} sizes")
        return tuple(sizes[:n_levels])


@dataclass(frozen=True)
class WindowTarget:
    """Window sizes that give about ``target`` windows on each level."""

    target: int = 1000
    min_size: int = 64
    olap_proportion: float = 0.25
    min_n_wins: int = 5

    def sizes(self, n_samples: int) -> tuple[int, int]:
        size = max(self.min_size, int(n_samples / ((1 - self.olap_proportion) * self.target)))
        return size, int(self.olap_proportion * size)

    def parameters(self, n_samples: list[int]) -> WindowParameters:
        sizes = [self.sizes(n) for n in n_samples]
        return WindowParameters(len(sizes), self.min_n_wins, tuple(s for s, _ in sizes), tuple(o for _, o in sizes))


@dataclass(frozen=True)
class Recording:
    """Driver-side description of the recordings of one measurement."""

    site: str
    meas: str
    fs: float
    n_samples: int
    first_time: str
    chans: tuple[str, ...] = ()
    extra: dict = field(default_factory=dict, hash=False)

    @property
    def start(self) -> Fraction:
        return to_instant(self.first_time)

    @property
    def end(self) -> Fraction:
        return self.start + (self.n_samples - 1) / exact(self.fs)

    @property
    def dt(self) -> Fraction:
        return 1 / exact(self.fs)

    @property
    def duration(self) -> Fraction:
        return self.end - self.start

    @property
    def nyquist(self) -> float:
        return self.fs / 2
