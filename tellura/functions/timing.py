"""Exact time arithmetic: instants as rational seconds, samples and windows as integers.

Rows carry integer sample and window numbers. An instant is a rational number
of seconds since 1970-01-01, so neither the 24 decimal digits of the text form
nor periods such as 1/3 s lose anything; Spark timestamps (microseconds) are
derived for display and range filters only.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellura.errors import ParameterError

Time = "str | datetime | Fraction"
_EPOCH = datetime(1970, 1, 1)
_TEXT = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:[ T](\d\d):(\d\d)(?::(\d\d)(?:\.([\d_]+))?)?)?$")


def exact(number: float | int | Fraction | str) -> Fraction:
    """The rational that a number stands for: a simple fraction if there is one of the same double (1 / 3600), else its decimal."""
    if isinstance(number, Fraction):
        return number
    if isinstance(number, float):
        simple = Fraction(number).limit_denominator(10**6)
        if simple and float(simple) == number:
            return simple
    return Fraction(str(number))


def to_instant(time: str | datetime | Fraction) -> Fraction:
    """Seconds since 1970-01-01 of a text, a datetime (naive is UTC) or an instant."""
    if isinstance(time, Fraction):
        return time
    if isinstance(time, datetime):
        naive = time.astimezone(timezone.utc).replace(tzinfo=None) if time.tzinfo else time
        delta = naive - _EPOCH
        whole = Fraction(delta.days * 86400 + delta.seconds) + Fraction(delta.microseconds, 10**6)
        return whole + Fraction(getattr(time, "nanosecond", 0), 10**9)
    found = _TEXT.match(time.strip())
    if not found:
        raise ParameterError(f"not a time: {time!r}")
    y, m, d, hh, mm, ss, part = found.groups()
    delta = datetime(int(y), int(m), int(d), int(hh or 0), int(mm or 0), int(ss or 0)) - _EPOCH
    digits = (part or "0").replace("_", "")
    return Fraction(delta.days * 86400 + delta.seconds) + Fraction(int(digits), 10 ** len(digits))


def to_text(instant: Fraction) -> str:
    """24 fractional digits in groups of six: ``2021-01-01 00:00:00.000000_000000_000000_000000``."""
    whole = math.floor(instant)
    digits = f"{round((instant - whole) * 10**24):024d}"
    if len(digits) > 24:
        whole, digits = whole + 1, "0" * 24
    stamp = _EPOCH + timedelta(seconds=whole)
    return f"{stamp:%Y-%m-%d %H:%M:%S}." + "_".join(digits[i : i + 6] for i in (0, 6, 12, 18))


def to_datetime(instant: Fraction) -> datetime:
    """Nearest microsecond, for display."""
    return _EPOCH + timedelta(microseconds=round(instant * 10**6))


def to_span(delta: float | int | timedelta | Fraction) -> Fraction:
    """A duration in seconds; floats are split at nanoseconds, and what is below 1e-4 ns is dropped."""
    if isinstance(delta, Fraction):
        return delta
    if isinstance(delta, timedelta):
        return Fraction(delta.days * 86400 + delta.seconds) + Fraction(delta.microseconds, 10**6)
    nanos = Fraction(delta) * 10**9
    near = round(nanos)
    return Fraction(near, 10**9) if abs(nanos - near) < Fraction(1, 10**4) else nanos / 10**9


def to_seconds(span: Fraction) -> tuple[float, float]:
    """(whole days in seconds, the rest in seconds)."""
    days = math.floor(span / 86400)
    return float(days * 86400), float(span - days * 86400)


def rounded(value: Fraction, method: str) -> int:
    """``round`` (halves to even), ``floor`` or ``ceil``."""
    try:
        return {"round": round, "floor": math.floor, "ceil": math.ceil}[method](value)
    except KeyError:
        raise ParameterError(f"method {method!r}") from None


def to_n_samples(span: float | timedelta | Fraction, fs: float, method: str = "round") -> int:
    """Samples that a duration covers, both ends included."""
    return rounded(to_span(span) * exact(fs), method) + 1


def check_sample(n_samples: int, sample: int) -> None:
    if not 0 <= sample < n_samples:
        raise ParameterError(f"sample {sample} is not within 0 to {n_samples - 1}")


def sample_to_instant(fs: float, first: str | datetime | Fraction, sample: int, n_samples: int | None = None) -> Fraction:
    if n_samples is not None:
        check_sample(n_samples, sample)
    return to_instant(first) + sample / exact(fs)


def samples_to_instants(fs: float, first: str | datetime | Fraction, from_sample: int, to_sample: int, n_samples: int | None = None) -> tuple[Fraction, Fraction]:
    if from_sample > to_sample:
        raise ParameterError(f"from sample {from_sample} is after {to_sample}")
    return sample_to_instant(fs, first, from_sample, n_samples), sample_to_instant(fs, first, to_sample, n_samples)


def check_from_time(first: Fraction, last: Fraction, time: Fraction) -> Fraction:
    """``time``, or the recording's first time where it is before it; an error after its end."""
    if time > last:
        raise ParameterError(f"from time {to_text(time)} is after the end {to_text(last)}")
    return max(first, time)


def check_to_time(first: Fraction, last: Fraction, time: Fraction) -> Fraction:
    if time < first:
        raise ParameterError(f"to time {to_text(time)} is before the start {to_text(first)}")
    return min(last, time)


def from_time_to_sample(fs: float, n_samples: int, first: str | datetime | Fraction, time: str | datetime | Fraction) -> int:
    """First sample at or after ``time``, clipped to the recording."""
    start = to_instant(first)
    clipped = check_from_time(start, start + (n_samples - 1) / exact(fs), to_instant(time))
    return math.ceil((clipped - start) * exact(fs))


def to_time_to_sample(fs: float, n_samples: int, first: str | datetime | Fraction, time: str | datetime | Fraction) -> int:
    """Last sample at or before ``time``, clipped to the recording."""
    start = to_instant(first)
    clipped = check_to_time(start, start + (n_samples - 1) / exact(fs), to_instant(time))
    return math.floor((clipped - start) * exact(fs))


def times_to_samples(fs: float, n_samples: int, first: object, from_time: object, to_time: object) -> tuple[int, int]:
    """Inclusive sample range of a time range."""
    return from_time_to_sample(fs, n_samples, first, from_time), to_time_to_sample(fs, n_samples, first, to_time)


def instants(fs: float, first: str | datetime | Fraction, n_samples: int) -> list[Fraction]:
    """Exact times of all samples, on the driver: for short recordings."""
    start, step = to_instant(first), 1 / exact(fs)
    return [start + i * step for i in range(n_samples)]


def sample_time(sample: Column, fs: float, first: str | datetime | Fraction) -> Column:
    """TIMESTAMP_NTZ of a sample number to the microsecond, by integer arithmetic where the period allows it."""
    micros = to_instant(first) * 10**6
    step = 10**6 / exact(fs)
    if step.denominator == 1 and micros.denominator == 1:
        us = sample.cast("long") * int(step) + int(micros)
    else:
        us = F.floor(sample.cast("double") * float(step) + float(micros - math.floor(micros)) + 0.5).cast("long") + math.floor(micros)
    return ntz(us)


def ntz(micros: Column) -> Column:
    """TIMESTAMP_NTZ of microseconds since 1970-01-01."""
    seconds = F.floor(micros / 1_000_000)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return zero + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros - seconds * 1_000_000).cast("decimal(18,6)") / 1_000_000 + seconds.cast("decimal(18,6)"))
