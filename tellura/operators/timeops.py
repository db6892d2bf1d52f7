"""Operators on time data: a long table (site, meas, level, chan, sample, value) and what is known of its recordings.

Gaps are NaN values. Operators that look at neighbours work by blocks of
samples, so a long recording is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tellura.errors import ChannelNotFoundError, ParameterError, ProcessRunError
from tellura.functions import channels, kernels, timing
from tellura.functions.frames import SAMPLES, small, written
from tellura.functions.history import Process, Record
from tellura.functions.timing import exact
from tellura.operators.params import Recording, downsample_steps

#: Samples of a block, and samples of a channel that one task filters as a whole.
BLOCK, WHOLE = 1 << 17, 1 << 20
#: Rows that a task which works by blocks gets on average.
TASK_ROWS = 1 << 18


@dataclass(frozen=True)
class TimeData:
    df: DataFrame
    recordings: tuple[Recording, ...]
    history: tuple[Record, ...] = ()

    @property
    def fs(self) -> float:
        rates = {r.fs for r in self.recordings}
        if len(rates) != 1:
            raise ParameterError(f"recordings of one sampling frequency are needed, not of {sorted(rates)}")
        return rates.pop()

    @property
    def chans(self) -> list[str]:
        return list(dict.fromkeys(c for r in self.recordings for c in r.chans))

    def catalog(self) -> DataFrame:
        """site, meas, fs, n_samples, first_time, last_time, a row for each measurement."""
        rows = [(r.site, r.meas, float(r.fs), r.n_samples, timing.to_text(r.start), timing.to_text(r.end)) for r in self.recordings]
        return self.df.sparkSession.createDataFrame(rows, "site string, meas string, fs double, n_samples long, first_time string, last_time string")

    def get_chan(self, chan: str) -> DataFrame:
        if chan not in self.chans:
            raise ChannelNotFoundError(chan, self.chans)
        return self.df.where(F.col("chan") == chan)

    def set_chan(self, chan: str, values: DataFrame) -> "TimeData":
        """Replace a channel by ``values``, which has the columns of ``df``."""
        if chan not in self.chans:
            raise ChannelNotFoundError(chan, self.chans)
        names = self.df.columns
        return replace(self, df=self.df.where(F.col("chan") != chan).unionByName(values.select(*names)))

    def subsection(self, from_time: object, to_time: object) -> "TimeData":
        return Subsection(str(from_time), str(to_time)).run(self)

    def timestamps(self) -> DataFrame:
        """``df`` with ``time``, to the microsecond: the first time and period of each recording are joined as whole and broken microseconds."""
        def parts(r: Recording) -> tuple[int, float, int, float]:
            first, step = r.start * 10**6, 10**6 / exact(r.fs)
            return math.floor(first), float(first - math.floor(first)), math.floor(step), float(step - math.floor(step))

        table = _by_recording(self, "_first long, _first_part double, _step long, _step_part double", parts)
        rest = F.floor(F.col("sample").cast("double") * F.col("_step_part") + F.col("_first_part") + 0.5).cast("long")
        micros = F.col("sample").cast("long") * F.col("_step") + F.col("_first") + rest
        return self.df.join(table, ["site", "meas"]).withColumn("time", timing.ntz(micros)).select(*self.df.columns, "time")

    def chans_of_type(self, kind: str) -> list[str]:
        return [c for c in self.chans if channels.chan_type(c) == kind]


@dataclass(frozen=True)
class TimeProcess(Process):
    def run(self, data: TimeData) -> TimeData:
        raise NotImplementedError

    def _done(self, data: TimeData, df: DataFrame, recordings: Iterable[Recording] | None = None, message: str = "") -> TimeData:
        return TimeData(df, tuple(recordings) if recordings is not None else data.recordings, (*data.history, self.record(message or "applied")))


def _by_recording(data: TimeData, columns: str, value: Callable[[Recording], tuple]) -> DataFrame:
    rows = [(r.site, r.meas, *value(r)) for r in data.recordings]
    return small(data.df.sparkSession.createDataFrame(rows, f"site string, meas string, {columns}"), len(rows))


@dataclass(frozen=True)
class Subsection(TimeProcess):
    """Samples from ``from_time`` to ``to_time``, both included, numbered anew from 0."""

    from_time: str
    to_time: str

    def run(self, data: TimeData) -> TimeData:
        bounds = {(r.site, r.meas): timing.times_to_samples(r.fs, r.n_samples, r.first_time, self.from_time, self.to_time) for r in data.recordings}
        for a, b in bounds.values():
            if a > b:
                raise ProcessRunError("no sample lies in the subsection")
        table = _by_recording(data, "_a long, _b long", lambda r: bounds[r.site, r.meas])
        low, high = min(a for a, _ in bounds.values()), max(b for _, b in bounds.values())
        cut = data.df.where(F.col("sample").between(low, high))  # reaches the scan
        df = cut.join(table, ["site", "meas"]).where("sample between _a and _b").withColumn("sample", F.col("sample") - F.col("_a")).select(*data.df.columns)
        recordings = [replace(r, n_samples=b - a + 1, first_time=timing.to_text(timing.sample_to_instant(r.fs, r.first_time, a))) for r, (a, b) in zip(data.recordings, bounds.values())]
        return self._done(data, df, recordings)


def _lookup(values: Mapping[str, float] | float, default: float) -> Column:
    if not isinstance(values, Mapping):
        return F.lit(float(values))
    out = F.lit(default)
    for chan, v in values.items():
        out = F.when(F.col("chan") == chan, float(v)).otherwise(out)
    return out


@dataclass(frozen=True)
class Add(TimeProcess):
    add: float | Mapping[str, float] = 0.0

    def run(self, data: TimeData) -> TimeData:
        return self._done(data, data.df.withColumn("value", F.col("value") + _lookup(self.add, 0.0)))


@dataclass(frozen=True)
class Multiply(TimeProcess):
    multiplier: float | Mapping[str, float] = 1.0

    def run(self, data: TimeData) -> TimeData:
        return self._done(data, data.df.withColumn("value", F.col("value") * _lookup(self.multiplier, 1.0)))


@dataclass(frozen=True)
class RemoveMean(TimeProcess):
    """Each channel of each recording less the mean of its known samples: partial sums, then a join with a row for each channel. Gaps stay gaps."""

    def run(self, data: TimeData) -> TimeData:
        keys = ["site", "meas", "level", "chan"]
        means = small(data.df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(float("nan"))).alias("_mean")), len(data.recordings) * max(1, len(data.chans)))
        return self._done(data, data.df.join(means, keys).withColumn("value", F.col("value") - F.col("_mean")).select(*data.df.columns))


@dataclass(frozen=True)
class InterpolateNans(TimeProcess):
    """Gaps on the line between their neighbours; before the first and after the last value that value stands.

    The last known value before each block of samples and the first after it
    come from a window over blocks. They go to the block as two more rows, and
    each block is filled by itself, after one shuffle.
    A channel without any value is an error when the result is read.
    """

    block: int = BLOCK

    def run(self, data: TimeData) -> TimeData:
        keys, block = ["site", "meas", "level", "chan"], self.block
        rows = data.df.select(*keys, "sample", "value", F.floor(F.col("sample") / block).alias("_block"))
        known = F.when(F.col("value").isNotNull() & ~F.isnan("value"), F.col("sample"))
        # max_by and min_by of plain columns keep to hash tables; the greatest struct would sort all rows
        ends = rows.groupBy(*keys, "_block").agg(F.max(known).alias("_s1"), F.max_by("value", known).alias("_v1"), F.min(known).alias("_s0"), F.min_by("value", known).alias("_v0"))
        last, first = (F.when(F.col(f"_s{i}").isNotNull(), F.struct(F.col(f"_s{i}").alias("sample"), F.col(f"_v{i}").alias("value"))) for i in (1, 0))
        # both directions run from the start of an order: a frame to the end would be scanned anew for each row
        before, after = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_block"), F.desc("_block")))
        around = ends.select(*keys, "_block", F.last(last, True).over(before).alias("_before"), F.last(first, True).over(after).alias("_after"))
        around = around.select(*keys, "_block", F.explode(F.array("_before", "_after")).alias("_k")).where("_k is not null")

        def fill(sample: np.ndarray, value: np.ndarray, start: int, end: int, chan: str) -> tuple[np.ndarray, np.ndarray]:
            own = slice(*np.searchsorted(sample, [start, end]))
            return sample[own], kernels.fill_gaps(sample, value, f"no value in channel {chan}")[own]

        return self._done(data, _each_block(rows.unionByName(around.select(*keys, "_k.sample", "_k.value", "_block")), data, block, fill).select(*data.df.columns))


@dataclass(frozen=True)
class ShiftTimestamps(TimeProcess):
    """Values at samples moved by ``shift`` seconds, on the line between neighbours; one sample less.

    Blocks of samples with the first sample of the next block.
    """

    shift: float

    def run(self, data: TimeData) -> TimeData:
        if self.shift <= 0:
            raise ProcessRunError("the shift is positive")
        if exact(self.shift) >= 1 / exact(data.fs):
            raise ProcessRunError("the shift is as long as the sampling period")
        part = float(exact(self.shift) * exact(data.fs))
        keys = ["site", "meas", "level", "chan"]
        block = BLOCK
        own = F.floor(F.col("sample") / block)
        blocks = F.when(F.col("sample") % block == 0, F.array(own - 1, own)).otherwise(F.array(own))
        dealt = data.df.select(*keys, "sample", "value", F.explode(blocks).alias("_block"))

        def line(sample: np.ndarray, value: np.ndarray, start: int, end: int, chan: str) -> tuple[np.ndarray, np.ndarray]:
            first = np.flatnonzero((np.diff(sample) == 1) & (sample[:-1] >= start))
            return sample[first], value[first] * (1 - part) + value[first + 1] * part

        recordings = [replace(r, n_samples=r.n_samples - 1, first_time=timing.to_text(r.start + exact(self.shift))) for r in data.recordings]
        return self._done(data, _each_block(dealt, data, block, line).select(*data.df.columns), recordings)


@dataclass(frozen=True)
class ApplyFunction(TimeProcess):
    """A function of the whole channel's array for some channels; others pass."""

    fncs: Mapping[str, Callable[[np.ndarray], np.ndarray]] = field(default_factory=dict)

    def parameters(self) -> dict:
        return {"fncs": {c: getattr(f, "__name__", "function") for c, f in self.fncs.items()}}

    def run(self, data: TimeData) -> TimeData:
        fncs = dict(self.fncs)

        def apply(x: np.ndarray, chan: str) -> np.ndarray:
            return np.asarray(fncs[chan](x), np.float64)

        listed = data.df.where(F.col("chan").isin(list(fncs)))
        done = _whole_channels(listed, lambda x, chan: apply(x, chan))
        return self._done(data, data.df.where(~F.col("chan").isin(list(fncs))).unionByName(done.select(*data.df.columns)))


def _whole_channels(df: DataFrame, fn: Callable[[np.ndarray, str], np.ndarray], step: int = 1) -> DataFrame:
    """``fn`` of each channel as one array, in one task for each."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(group.column("sample").combine_chunks()), kind="stable")
        y = fn(np.asarray(group.column("value").combine_chunks(), np.float64)[order], key[3].as_py())
        same = {n: pa.array([k.as_py()] * len(y), t) for n, k, t in zip(("site", "meas", "level", "chan"), key, (pa.string(), pa.string(), pa.int32(), pa.string()))}
        return pa.table({**same, "sample": pa.array(np.arange(len(y))), "value": pa.array(y)})

    return df.groupBy("site", "meas", "level", "chan").applyInArrow(run, SAMPLES)


def _each_block(dealt: DataFrame, data: TimeData, block: int, fn: Callable[[np.ndarray, np.ndarray, int, int, str], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``fn(samples, values, block start, block end, chan)`` of each block of ``dealt`` (with ``_block``); gives samples and values.

    Partitions are as many as the rows of ``data`` need, so that a task's share doesn't grow with the recording.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sample = np.asarray(group.column("sample").combine_chunks())
        order = np.argsort(sample, kind="stable")
        start = key[4].as_py() * block
        s, y = fn(sample[order], np.asarray(group.column("value").combine_chunks(), np.float64)[order], start, start + block, key[3].as_py())
        same = {n: pa.repeat(pa.scalar(k.as_py(), t), len(y)) for n, k, t in zip(("site", "meas", "level", "chan"), key, (pa.string(), pa.string(), pa.int32(), pa.string()))}
        return pa.table({**same, "sample": pa.array(s, pa.int64()), "value": pa.array(y, pa.float64())})

    keys = ["site", "meas", "level", "chan", "_block"]
    n_rows = sum(r.n_samples * len(r.chans) for r in data.recordings)
    n_parts = max(dealt.sparkSession.sparkContext.defaultParallelism, -(-n_rows // TASK_ROWS))
    return dealt.repartition(n_parts, *keys).groupBy(*keys).applyInArrow(run, SAMPLES)


def _blocks(df: DataFrame, data: TimeData, halo: int, block: int, fn: Callable[[np.ndarray, int, int, int], tuple[int, np.ndarray]]) -> DataFrame:
    """``fn(values, first sample, block start, block end)`` of each block with ``halo`` samples on both sides; gives first sample and values."""
    low, high = F.floor((F.col("sample") - halo) / block), F.floor((F.col("sample") + halo) / block)
    dealt = df.withColumn("_block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))

    def run(sample: np.ndarray, value: np.ndarray, start: int, end: int, chan: str) -> tuple[np.ndarray, np.ndarray]:
        own = ((sample >= start) & (sample < end)).any()
        first, y = fn(value, int(sample[0]), start, end) if own else (0, np.empty(0))
        return np.arange(first, first + len(y)), y

    return _each_block(dealt, data, block, run)


@dataclass(frozen=True)
class _Filter(TimeProcess):
    """Zero-phase Butterworth filter. A channel of up to ``whole`` samples is one task's; a longer one goes by blocks
    with a halo on each side of ``halo_periods`` periods of the lowest edge, and at least as long as the slowest pole rings."""

    order: int = 10
    whole: int = WHOLE
    halo_periods: int = 200

    def _edges(self, fs: float) -> tuple[str, list[float]]:
        raise NotImplementedError

    def run(self, data: TimeData) -> TimeData:
        fs = data.fs
        kind, edges = self._edges(fs)
        sections = kernels.butterworth(self.order, kind, edges, fs)
        if max(r.n_samples for r in data.recordings) <= self.whole:
            df = _whole_channels(data.df, lambda x, _: kernels.zero_phase(sections, x))
        else:
            halo = max(math.ceil(self.halo_periods * fs / min(edges)), kernels.ring(sections))

            def part(x: np.ndarray, first: int, start: int, end: int) -> tuple[int, np.ndarray]:
                return start, kernels.zero_phase(sections, x)[start - first : end - first]

            df = _blocks(data.df, data, halo, max(BLOCK, 2 * halo), part)
        return self._done(data, df.select(*data.df.columns), message=f"{kind} at {edges} Hz")


def _below_nyquist(fs: float, *freqs: float) -> None:
    for f in freqs:
        if f > fs / 2:
            raise ProcessRunError(f"{f} Hz is above the nyquist frequency {fs / 2}")


def _inside(fs: float, f: float) -> float:
    """Edges on or beyond 0 and nyquist are moved just inside, where the design is defined."""
    return min(max(f, 1e-6 * fs), fs / 2 * (1 - 1e-6))


@dataclass(frozen=True)
class LowPass(_Filter):
    cutoff: float = 0.0

    def _edges(self, fs: float) -> tuple[str, list[float]]:
        _below_nyquist(fs, self.cutoff)
        return "lowpass", [_inside(fs, self.cutoff)]


@dataclass(frozen=True)
class HighPass(_Filter):
    cutoff: float = 0.0

    def _edges(self, fs: float) -> tuple[str, list[float]]:
        _below_nyquist(fs, self.cutoff)
        return "highpass", [_inside(fs, self.cutoff)]


@dataclass(frozen=True)
class BandPass(_Filter):
    cutoff_low: float = 0.0
    cutoff_high: float = 0.0

    def _edges(self, fs: float) -> tuple[str, list[float]]:
        if self.cutoff_low > self.cutoff_high:
            raise ProcessRunError("the low edge is above the high one")
        _below_nyquist(fs, self.cutoff_high)
        return "bandpass", [_inside(fs, self.cutoff_low), _inside(fs, self.cutoff_high)]


@dataclass(frozen=True)
class Notch(_Filter):
    """Band stop of width ``band`` (a tenth of the sampling frequency if not given) around ``notch``."""

    notch: float = 0.0
    band: float | None = None

    def _edges(self, fs: float) -> tuple[str, list[float]]:
        _below_nyquist(fs, self.notch)
        half = (0.1 * fs if self.band is None else self.band) / 2
        return "bandstop", [_inside(fs, self.notch - half), _inside(fs, self.notch + half)]


@dataclass(frozen=True)
class Resample(TimeProcess):
    """Polyphase FIR resampling to ``new_fs``, by blocks of inputs; ends are padded with the channel's mean."""

    new_fs: float
    block: int = BLOCK

    def run(self, data: TimeData) -> TimeData:
        up, down = kernels.resample_ratio(data.fs, self.new_fs)
        recordings = [replace(r, fs=self.new_fs, n_samples=-(-r.n_samples * up // down)) for r in data.recordings]
        if up == down:
            return self._done(data, data.df, recordings)
        keys = ["site", "meas", "level", "chan"]
        means = small(data.df.groupBy(*keys).agg(F.coalesce(F.avg(F.when(~F.isnan("value"), F.col("value"))), F.lit(float("nan"))).alias("_mean")), len(data.recordings) * max(1, len(data.chans)))
        centred = data.df.join(means, keys).select(*keys, "sample", (F.col("value") - F.col("_mean")).alias("value"))
        lengths = {(r.site, r.meas): r.n_samples for r in recordings}
        taps = kernels.resample_taps(up, down)
        half, block = len(taps) // 2, max(self.block, 64 * down // max(1, math.gcd(64, down)))
        block -= block % down  # blocks of inputs begin on an output
        halo = -(-half // up) + 1

        def part(x: np.ndarray, first: int, start: int, end: int) -> tuple[int, np.ndarray]:
            m = np.arange(start * up // down, end * up // down)
            return int(m[0]), _fir(x, first, m, taps, up, down)

        df = _blocks(centred, data, halo, block, part).join(means, keys)
        n_out = _by_recording(data, "_n long", lambda r: (lengths[r.site, r.meas],))
        df = df.join(n_out, ["site", "meas"]).where(F.col("sample") < F.col("_n")).withColumn("value", F.col("value") + F.col("_mean"))
        return self._done(data, df.select(*data.df.columns), recordings)


def _fir(x: np.ndarray, first: int, m: np.ndarray, taps: np.ndarray, up: int, down: int) -> np.ndarray:
    """Outputs ``m`` from the samples ``x``, the first of which is number ``first``; zeros beside them."""
    half, y = len(taps) // 2, np.zeros(len(m))
    for phase in range(min(up, len(m))):
        out = m[phase::up]
        newest = (out * down + half) // up
        h = taps[int(out[0] * down + half - newest[0] * up) :: up]
        spots = newest[:, None] - np.arange(len(h)) - first
        ok = (spots >= 0) & (spots < len(x))
        y[phase::up] = np.where(ok, x[np.clip(spots, 0, len(x) - 1)], 0.0) @ h
    return y


@dataclass(frozen=True)
class Decimate(TimeProcess):
    """Zero-phase low-pass and every factor-th sample, in steps of ``max_single_factor`` at most."""

    factor: int = 1
    max_single_factor: int = 3
    whole: int = WHOLE
    halo_periods: int = 200

    def run(self, data: TimeData) -> TimeData:
        if self.factor < 1 or self.max_single_factor < 2:
            raise ParameterError("the factor is 1 or more, of a step 2 or more")
        if self.factor == 1:
            return data
        df, lengths = data.df, [r.n_samples for r in data.recordings]
        for q in [s for s in downsample_steps(self.factor, self.max_single_factor) if s > 1]:
            if max(lengths) <= self.whole:
                df = _whole_channels(df, lambda x, _, q=q: kernels.decimate_step(x, q))
            else:
                sections = kernels.chebyshev1(8, 0.05, 0.8 / q, 2.0)
                halo = max(self.halo_periods * q, kernels.ring(sections))
                block = max(BLOCK, 2 * halo)
                block -= block % q

                def part(x: np.ndarray, first: int, start: int, end: int, q: int = q, sections: np.ndarray = sections) -> tuple[int, np.ndarray]:
                    return start // q, kernels.zero_phase(sections, x)[start - first : end - first : q]

                df = _blocks(df, data, halo, block, part)
            lengths = [-(-n // q) for n in lengths]
        recordings = [replace(r, fs=float(exact(r.fs) / self.factor), n_samples=n) for r, n in zip(data.recordings, lengths)]
        return self._done(data, df.select(*data.df.columns), recordings)


CORNERS = "place long, bucket long, x array<double>, y array<double>, sum_x double, sum_y double, n long"


def lttb(df: DataFrame, max_pts: int | None, keys: tuple[str, ...] = ("site", "meas", "level", "chan"), part: int = 1 << 20) -> DataFrame:
    """Largest-triangle-three-buckets of each channel, for plots; all rows where ``max_pts`` is none or enough.

    Parts of a channel give their buckets' corners and sums; the walk from bucket to
    bucket, one task a channel, sees these only, which is exact. Samples are
    numbered without holes, as in time data; values of a plot are known.
    """
    if max_pts is None:
        return df
    if max_pts < 3:
        raise ParameterError("down-sampling keeps three points at least")
    spans = df.groupBy(*keys).agg(F.min("sample").alias("_low"), F.max("sample").alias("_high"))
    spans = written(spans, "spans")  # a row for each channel: its size is known when it is joined
    if spans.where(f"_high - _low >= {max_pts}").limit(1).count() == 0:
        return df
    n = F.col("_high") - F.col("_low") + 1
    at = F.col("sample") - F.col("_low")
    # the bucket whose edge floor(1 + i * step) is the last at or before a position; the first and the last point stand alone
    step = (n - 2) / F.lit(float(max_pts - 2))
    guess = F.floor((at - 1) / step)
    edge = lambda i: F.floor(i * step + 1)
    inner = F.when(edge(guess + 1) <= at, guess + 1).when(edge(guess) > at, guess - 1).otherwise(guess)
    bucket = F.when(at == 0, -1).when(at == n - 1, max_pts - 2).otherwise(F.least(inner, F.lit(max_pts - 3)))
    rows = df.join(spans, list(keys)).where(n > max_pts).select(*keys, bucket.cast("long").alias("bucket"), F.floor(at / part).alias("place"), "sample", "value")

    def corners(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("sample")
        x, y = (np.asarray(group.column(c).combine_chunks(), np.float64) for c in ("sample", "value"))
        numbers, starts = np.unique(np.asarray(group.column("bucket").combine_chunks()), return_index=True)
        cuts = [slice(p, q) for p, q in zip(starts, [*starts[1:], len(x)])]
        kept = [kernels.hull(x[c], y[c]) + c.start for c in cuts]
        same = {c: pa.array([v.as_py()] * len(cuts), group.schema.field(c).type) for c, v in zip((*keys, "place"), key)}
        sums = {f"sum_{name}": [float(v[c].sum()) for c in cuts] for name, v in (("x", x), ("y", y))}
        return pa.table({**same, "bucket": pa.array(numbers), "x": [x[k].tolist() for k in kept], "y": [y[k].tolist() for k in kept], **sums, "n": [c.stop - c.start for c in cuts]})

    def walk(key: tuple, group: pa.Table) -> pa.Table:
        held: dict[int, list[dict]] = {}
        for r in group.sort_by([("bucket", "ascending"), ("place", "ascending")]).to_pylist():
            held.setdefault(r["bucket"], []).append(r)
        ends = [(held[i][0]["x"][0], held[i][0]["y"][0]) for i in (-1, max_pts - 2)]
        # the walk's last mean is that of the last point alone, as its bucket holds no other
        parts = [held[i] for i in range(max_pts - 2)]
        points = [(np.concatenate([p["x"] for p in b]), np.concatenate([p["y"] for p in b]), *(sum(p[s] for p in b) / sum(p["n"] for p in b) for s in ("sum_x", "sum_y"))) for b in parts]
        kept = kernels.lttb_of_hulls(ends[0], points, ends[1])
        same = {c: pa.array([v.as_py()] * len(kept), group.schema.field(c).type) for c, v in zip(keys, key)}
        return pa.table({**same, "sample": pa.array(np.array(kept).astype(np.int64))})

    shape = [df.schema[c] for c in keys]
    found = rows.groupBy(*keys, "place").applyInArrow(corners, StructType([*shape, *StructType.fromDDL(CORNERS).fields]))
    kept = written(found.groupBy(*keys).applyInArrow(walk, StructType([*shape, *StructType.fromDDL("sample long").fields])), "kept")
    whole = df.join(spans.where(n <= max_pts).select(*keys), list(keys), "left_semi")
    return df.join(kept, [*keys, "sample"], "left_semi").unionByName(whole).select(*df.columns)


PROCESSES = (Subsection, Add, Multiply, RemoveMean, InterpolateNans, ShiftTimestamps, ApplyFunction, LowPass, HighPass, BandPass, Notch, Resample, Decimate)
