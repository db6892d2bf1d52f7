"""Queries over the driver tables, by name, with DuckDB SQL where it can express them."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.functions import channels, kernels, solvers
from tellura.operators import gather, params, regression, spectra, timeops, transfer
from tellura.operators.calibration import CalibrationData, SensorCalibrator
from tellura.operators.decimation import Decimator
from tellura.operators.windows import Windower, WindowedData
from tellura.plans import pipeline, tables
from tellura.plans.config import Configuration
from tellura.plans.registry import ORACLES, QUERIES, query, r6, rounded

IMPEDANCE, TIPPER = transfer.ImpedanceTensor(), transfer.Tipper()
TO_TIPPER = transfer.TransferFunction(("Ex", "Ey", "Hz"), ("Hx", "Hy"))


# --- SQL of the recordings -------------------------------------------------

_LINE = """li AS (
  SELECT l_orderkey AS k, avg(l_quantity) AS ex, avg(l_extendedprice) / 977 AS ey, avg(l_discount) * 100 AS hx, avg(l_tax) * 100 AS hy FROM lineitem GROUP BY 1),
s AS (
  SELECT c.chan, o_orderkey AS sample, c.value FROM orders LEFT JOIN li ON k = o_orderkey,
    unnest([{'chan': 'Ex', 'value': ex}, {'chan': 'Ey', 'value': ey}, {'chan': 'Hx', 'value': hx}, {'chan': 'Hy', 'value': hy}, {'chan': 'Hz', 'value': o_totalprice / 9973}]) t(c))"""


def _filled(src: str = "s", keys: str = "chan") -> str:
    return f"""f0 AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN sample END IGNORE NULLS) OVER a AS ls, last_value(value IGNORE NULLS) OVER a AS lv,
    first_value(CASE WHEN value IS NOT NULL THEN sample END IGNORE NULLS) OVER b AS rs, first_value(value IGNORE NULLS) OVER b AS rv
  FROM {src} WINDOW a AS (PARTITION BY {keys} ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY {keys} ORDER BY sample ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT {keys}, sample, CASE WHEN value IS NOT NULL THEN value WHEN ls IS NULL THEN rv WHEN rs IS NULL THEN lv ELSE lv + (rv - lv) * (sample - ls) / (rs - ls) END AS value FROM f0)"""


_CLEAN = f"""{_LINE},
{_filled()},
clean AS (SELECT chan, sample, value - avg(value) OVER (PARTITION BY chan) AS value FROM filled)"""

# windows of 128 samples, 96 apart; the recording begins 10 s after the reference time, so window 2 is its first, from sample 32 on
_WINDOWS = f"""{_CLEAN},
n AS (SELECT count(*) AS n FROM orders),
win AS (
  SELECT chan, k + 2 AS global_win, (sample - 32 - 96 * k)::INTEGER AS pos, value
  FROM (SELECT *, unnest(range(greatest(0, ceil((sample - 159) / 96)::BIGINT), least((SELECT (n - 160) // 96 FROM n), (sample - 32) // 96) + 1)) AS k FROM clean WHERE sample >= 32))"""


def _values(x: object) -> str:
    return ", ".join(f"({i}, {float(v)!r}::DOUBLE)" for i, v in enumerate(x))


def _transform(bins: str, src: str = "win", keys: str = "chan, global_win", size: int = 128, name: str = "z") -> str:
    """SQL of detrended, tapered, unitary transforms at the numbers (bin) in ``bins``."""
    return f"""taper(pos, w) AS (VALUES {_values(kernels.taper(("kaiser", 14), size))}),
line AS (SELECT {keys}, regr_slope(value, pos) AS b, regr_intercept(value, pos) AS a FROM {src} GROUP BY ALL),
flat AS (SELECT {keys}, pos, (value - a - b * pos) * w AS v FROM {src} JOIN line USING ({keys}) JOIN taper USING (pos)),
{name} AS (
  SELECT {keys}, bin, sum(v * cos(2 * pi() * bin * pos / {size})) / sqrt({size}) AS re, -sum(v * sin(2 * pi() * bin * pos / {size})) / sqrt({size}) AS im
  FROM flat, {bins} GROUP BY ALL)"""


def _freqs(fs: float = tables.FS, n: int = 5) -> list[float]:
    return params.eval_freqs(fs, n_freqs=n)


def _evals(src: str = "win", keys: str = "chan, global_win", fs: float = tables.FS, size: int = 128) -> str:
    spots = [(i, f, int(f * size / fs)) for i, f in enumerate(_freqs(fs))]
    freqs = ", ".join(f"({i}, {f!r}::DOUBLE, {b}, {f * size / fs - b!r}::DOUBLE)" for i, f, b in spots)
    return f"""freqs(freq_idx, freq, low, part) AS (VALUES {freqs}),
bins AS (SELECT DISTINCT unnest([low, low + 1]) AS bin FROM freqs),
{_transform("bins", src, keys, size)},
evals AS (
  SELECT {", ".join("x." + k.strip() for k in keys.split(","))}, freq_idx, freq, x.re * (1 - part) + y.re * part AS re, x.im * (1 - part) + y.im * part AS im
  FROM freqs JOIN z x ON x.bin = low JOIN z y ON y.bin = low + 1 AND {" AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in keys.split(","))})"""


_EVALS = f"{_WINDOWS},\n{_evals()}"

# --- projections and time operators ----------------------------------------


@query(f"WITH {_LINE} SELECT sample, round(value, 6) AS value FROM s WHERE chan = 'Hx' AND value IS NOT NULL")
def proj_get_chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(tables.line(spark, sf_dir).get_chan("Hx").where(~F.isnan("value")).select("sample", "value"), "value")


@query(f"WITH {_LINE} SELECT chan, sample, round(CASE WHEN chan = 'Hz' THEN sample / 8.0 ELSE value END, 6) AS value FROM s WHERE chan IN ('Hz', 'Ex') AND (value IS NOT NULL OR chan = 'Hz')")
def proj_set_chan(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.line(spark, sf_dir)
    done = data.set_chan("Hz", data.get_chan("Hz").withColumn("value", F.col("sample") / 8.0))
    return rounded(done.df.where(F.col("chan").isin("Hz", "Ex") & ~F.isnan("value")).select("chan", "sample", "value"), "value")


@query("""WITH c(chan) AS (VALUES ('Ex'), ('Ey'), ('Hx'), ('Hy'), ('Hz'), ('Bz'), ('E4'), ('T1'))
SELECT chan, CASE WHEN chan IN ('Ex', 'Ey', 'E1', 'E2', 'E3', 'E4') THEN 'electric' WHEN chan IN ('Hx', 'Hy', 'Hz', 'Bx', 'By', 'Bz') THEN 'magnetic' END AS chan_type,
  count(DISTINCT event_type) AS n FROM c, events GROUP BY chan""")
def proj_chan_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(c,) for c in ("Ex", "Ey", "Hx", "Hy", "Hz", "Bz", "E4", "T1")], "chan string")
    kinds = tables.table(spark, sf_dir, "events").select("event_type").where("event_type is not null").distinct().count()
    return names.select("chan", channels.chan_type_column(F.col("chan")).alias("chan_type"), F.lit(kinds).cast("long").alias("n"))


@query(f"""WITH {_LINE} SELECT chan, sample - 104 AS sample, round(value, 6) AS value FROM s WHERE sample BETWEEN 104 AND 992 AND value IS NOT NULL""")
def proj_subsection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 16.45 s to 72.03 s, samples 103.2 to 992.48."""
    done = timeops.Subsection("2024-01-01 00:00:16.45", "2024-01-01 00:01:12.03").run(tables.line(spark, sf_dir))
    return rounded(done.df.where(~F.isnan("value")).select("chan", "sample", "value"), "value")


@query(f"WITH {_LINE} SELECT chan, sample, round(value + CASE chan WHEN 'Ex' THEN 3 WHEN 'Hy' THEN -2.5 ELSE 0 END, 6) AS value FROM s WHERE value IS NOT NULL")
def proj_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(timeops.Add({"Ex": 3, "Hy": -2.5}).run(tables.line(spark, sf_dir)))


@query(f"WITH {_LINE} SELECT chan, sample, round(value * CASE chan WHEN 'Ex' THEN 3 WHEN 'Hy' THEN -2.5 ELSE 1 END, 6) AS value FROM s WHERE value IS NOT NULL")
def proj_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(timeops.Multiply({"Ex": 3, "Hy": -2.5}).run(tables.line(spark, sf_dir)))


def _rows(data: timeops.TimeData) -> DataFrame:
    return rounded(data.df.where(~F.isnan("value")).select("chan", "sample", "value"), "value")


@query(f"WITH {_LINE} SELECT sample, '2024-01-01 00:00:10'::TIMESTAMP + to_microseconds(sample * 62500) AS time FROM s WHERE chan = 'Hx'")
def proj_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = tables.line(spark, sf_dir)
    return data.timestamps().where(F.col("chan") == "Hx").select("sample", "time")


@query("""SELECT 's' || user_id % 3 AS site, count(DISTINCT CASE WHEN day(ts) <= 15 THEN 'm0' ELSE 'm1' END) AS n_meas, min(ts) AS begin_time, max(ts) AS end_time, count(*) AS n FROM events GROUP BY 1""")
def agg_site_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    meas = F.when(F.dayofmonth("ts") <= 15, "m0").otherwise("m1").alias("meas")
    site = F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))).alias("site")
    rows = tables.table(spark, sf_dir, "events").where("ts is not null").groupBy(site, meas).agg(F.min("ts").alias("first_time"), F.max("ts").alias("last_time"), F.count("*").alias("n"))
    spans = gather.site_spans(rows).join(rows.groupBy("site").agg(F.sum("n").alias("n")), "site")
    return spans.select("site", "n_meas", F.col("begin").alias("begin_time"), F.col("end").alias("end_time"), "n")


@query("""WITH spans AS (SELECT o_custkey AS c, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1), own AS (SELECT a, b FROM spans WHERE c = 7)
SELECT 'c' || c AS site, spans.a AS begin_time, spans.b AS end_time FROM spans, own WHERE c <> 7 AND spans.a <= own.b AND spans.b >= own.a""")
def concurrent_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders' span meets that of customer 7."""
    orders = tables.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey")).alias("site"), F.col("o_orderdate").alias("first_time"), F.col("o_orderdate").alias("last_time"))
    return gather.concurrent(orders, "c7").withColumnsRenamed({"begin": "begin_time", "end": "end_time"})


@query(f"WITH {_LINE} SELECT chan, sample, round(value - avg(value) OVER (PARTITION BY chan), 6) AS value FROM s WHERE value IS NOT NULL")
def agg_remove_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(timeops.RemoveMean().run(tables.line(spark, sf_dir)))


@query(f"WITH {_LINE}, {_filled()} SELECT chan, sample, round(value, 6) AS value FROM filled")
def interp_nans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(timeops.InterpolateNans(block=4096).run(tables.line(spark, sf_dir)))


@query(f"""WITH {_CLEAN} SELECT chan, sample, round(value * 0.68 + next * 0.32, 6) AS value
FROM (SELECT *, lead(value) OVER (PARTITION BY chan ORDER BY sample) AS next FROM clean) WHERE next IS NOT NULL""")
def shift_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(timeops.ShiftTimestamps(0.02).run(tables.line_clean(spark, sf_dir)))


@query(f"""WITH {_CLEAN} SELECT chan, sample, round(CASE WHEN chan = 'Ex' THEN value * value / 7 ELSE value END, 5) AS value FROM clean""")
def apply_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.ApplyFunction({"Ex": lambda x: x * x / 7}).run(tables.line_clean(spark, sf_dir)).df.select("chan", "sample", "value"), "value", digits=5)


def _resample_sql() -> str:
    taps = kernels.resample_taps(1, 4)
    half = len(taps) // 2
    return f"""WITH {_CLEAN}, taps(i, h) AS (VALUES {_values(taps)}), m AS (SELECT chan, avg(value) AS mean FROM clean GROUP BY chan), n AS (SELECT ceil(count(*) / 4)::BIGINT AS n FROM orders)
SELECT chan, o AS sample, round(mean + coalesce(sum((value - mean) * h), 0), 6) AS value
FROM (SELECT chan, value, sample, unnest(range(greatest(0, ceil((sample - {half}) / 4)::BIGINT), (sample + {half}) // 4 + 1)) AS o FROM clean) JOIN m USING (chan)
  JOIN taps ON i = o * 4 - sample + {half}, n WHERE o < n.n GROUP BY chan, o, mean"""


@query(_resample_sql())
def resample_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.Resample(4.0, block=8192).run(tables.line_clean(spark, sf_dir)).df.select("chan", "sample", "value"), "value")


def _impulse(sections: np.ndarray, rest: float = 1e-13) -> list[float]:
    """Response of the sections to a one, by their difference equations, until it has died away."""
    x = [1.0] + [0.0] * kernels.ring(sections, rest)
    for b0, b1, b2, _, a1, a2 in sections.tolist():
        y: list[float] = []
        for i in range(len(x)):
            y.append(b0 * x[i] + (b1 * x[i - 1] - a1 * y[i - 1] if i > 0 else 0.0) + (b2 * x[i - 2] - a2 * y[i - 2] if i > 1 else 0.0))
        x = y
    return x


def _zero_phase_sql(name: str, src: str, sections: np.ndarray) -> str:
    """SQL of the rows ``name`` (chan, sample, value) of ``src`` filtered there and back over odd extensions of the ends, each pass as if its first value had come before for ever."""
    taps = 2 * len(sections) + 1 - min((sections[:, 2] == 0).sum(), (sections[:, 5] == 0).sum())
    h = _impulse(sections)
    rest = np.concatenate([np.cumsum(h[::-1])[::-1][1:], [0.0]])

    def one_way(out: str, of: str) -> str:
        return f"""{out} AS MATERIALIZED (
  SELECT chan, i, sum(v) + coalesce(any_value(t * v0), 0) AS v FROM (
    SELECT e.chan, e.i + k AS i, v * h AS v FROM {of} e JOIN {name}_ends b ON b.chan = e.chan, {name}_h WHERE e.i + k < b.n + 2 * b.edge)
  LEFT JOIN (SELECT k AS i, t FROM {name}_h) USING (i) JOIN (SELECT chan, v AS v0 FROM {of} WHERE i = 0) USING (chan) GROUP BY chan, i)"""

    return f"""{name}_h(k, h, t) AS (VALUES {", ".join(f"({i}, {float(x)!r}::DOUBLE, {float(t)!r}::DOUBLE)" for i, (x, t) in enumerate(zip(h, rest)))}),
{name}_ends AS MATERIALIZED (SELECT chan, count(*) AS n, least({3 * taps}, count(*) - 1) AS edge, arg_min(value, sample) AS x0, arg_max(value, sample) AS x1 FROM {src} GROUP BY chan),
{name}_e AS MATERIALIZED (
  SELECT chan, sample + edge AS i, value AS v FROM {src} JOIN {name}_ends USING (chan)
  UNION ALL SELECT chan, edge - sample, 2 * x0 - value FROM {src} JOIN {name}_ends USING (chan) WHERE sample BETWEEN 1 AND edge
  UNION ALL SELECT chan, edge + 2 * (n - 1) - sample, 2 * x1 - value FROM {src} JOIN {name}_ends USING (chan) WHERE sample BETWEEN n - 1 - edge AND n - 2),
{one_way(f"{name}_f", f"{name}_e")},
{name}_r AS MATERIALIZED (SELECT chan, n + 2 * edge - 1 - i AS i, v FROM {name}_f JOIN {name}_ends USING (chan)),
{one_way(f"{name}_g", f"{name}_r")},
{name} AS (SELECT chan, n + edge - 1 - i AS sample, v AS value FROM {name}_g JOIN {name}_ends USING (chan) WHERE i BETWEEN edge AND n + edge - 1)"""


def _filter_query(name: str, process: timeops.TimeProcess, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(process.run(tables.line_clean(spark, sf_dir)).df.select("chan", "sample", "value"), "value", digits=4)

    run.__name__ = name
    query(sql)(run)


# channels by number while their rows are filtered
_NUMBERED = "x AS MATERIALIZED (SELECT list_position(['Ex', 'Ey', 'Hx', 'Hy', 'Hz'], chan) AS chan, sample, value FROM clean)"
_NAMED = "SELECT ['Ex', 'Ey', 'Hx', 'Hy', 'Hz'][chan] AS chan, sample::BIGINT AS sample, round(value, 4) + 0.0 AS value FROM {}"


def _butterworth_sql(kind: str, *edges: float) -> str:
    return f"WITH {_CLEAN}, {_NUMBERED}, {_zero_phase_sql('y', 'x', kernels.butterworth(10, kind, list(edges), tables.FS))} {_NAMED.format('y')}"


def _decimate_sql(*steps: int) -> str:
    parts, src = [], "x"
    for i, q in enumerate(steps):
        parts += [_zero_phase_sql(f"y{i}", src, kernels.chebyshev1(8, 0.05, 0.8 / q, 2.0)), f"d{i} AS MATERIALIZED (SELECT chan, sample // {q} AS sample, value FROM y{i} WHERE sample % {q} = 0)"]
        src = f"d{i}"
    return f"WITH {_CLEAN}, {_NUMBERED}, {', '.join(parts)} {_NAMED.format(src)}"


for _name, _process, _sql in (
    ("lowpass", timeops.LowPass(cutoff=2.0), _butterworth_sql("lowpass", 2.0)), ("highpass", timeops.HighPass(cutoff=2.0), _butterworth_sql("highpass", 2.0)),
    ("bandpass", timeops.BandPass(cutoff_low=1.0, cutoff_high=3.0), _butterworth_sql("bandpass", 1.0, 3.0)),
    ("notch", timeops.Notch(notch=4.0, band=1.0), _butterworth_sql("bandstop", 3.5, 4.5)), ("decimate_iir", timeops.Decimate(6), _decimate_sql(*[q for q in params.downsample_steps(6, 3) if q > 1])),
):
    _filter_query(_name, _process, _sql)


_LTTB = f"""WITH RECURSIVE {_CLEAN},
size AS (SELECT count(*) AS n FROM orders),
cut AS (SELECT unnest(range(999)) AS b, n, least(n - 1, floor(unnest(range(999)) * ((n - 2) / 998.0) + 1)::BIGINT) AS a FROM size),
bucket AS (SELECT b, a, coalesce(lead(a) OVER (ORDER BY b), n) AS z FROM cut),
pts AS (SELECT chan, b, list({{'x': sample::DOUBLE, 'y': value}} ORDER BY sample) AS p, avg(sample) AS cx, avg(value) AS cy FROM clean JOIN bucket ON sample >= a AND sample < z GROUP BY chan, b),
step AS (SELECT p.chan, p.b, p.p, q.cx, q.cy FROM pts p JOIN pts q ON q.chan = p.chan AND q.b = p.b + 1),
kept(chan, b, x, y) AS (
  SELECT chan, -1, sample::DOUBLE, value FROM clean WHERE sample = 0
  UNION ALL
  SELECT chan, b, best.x, best.y FROM (
    SELECT chan, b, p[list_position(areas, list_max(areas))] AS best FROM (
      SELECT k.chan, s.b, s.p, list_transform(s.p, lambda o: abs((k.x - s.cx) * (o.y - k.y) - (k.x - o.x) * (s.cy - k.y))) AS areas FROM kept k JOIN step s ON s.chan = k.chan AND s.b = k.b + 1)))
SELECT chan, x::BIGINT AS sample, round(y, 6) + 0.0 AS value FROM kept
UNION ALL SELECT chan, sample, round(value, 6) + 0.0 FROM clean, size WHERE sample = n - 1"""


@query(_LTTB)
def lttb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(timeops.lttb(tables.line_clean(spark, sf_dir).df, 1000).select("chan", "sample", "value"), "value")


# --- parameters and windows ------------------------------------------------


@query("""WITH f AS (SELECT n_nationkey AS fs_idx, 2.0 ** (n_nationkey - 4) AS fs FROM nation), e AS (SELECT *, unnest(range(40)) AS i FROM f),
q AS (SELECT *, fs / 4 / 2 ** (i / 2) AS freq, i // 5 AS level FROM e),
d AS (SELECT fs_idx, level, floor(log2(fs / (4 * max(freq))) + 1e-9)::INTEGER AS k FROM q GROUP BY fs_idx, level, fs)
SELECT fs_idx::BIGINT AS fs_idx, level::INTEGER AS level, i::INTEGER AS eval_idx, round(freq, 9) AS freq, (2 ** k)::INTEGER AS factor FROM q JOIN d USING (fs_idx, level)""")
def eval_freqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies and factors for the sampling frequency of each nation: 2 to the power of its key less 4."""
    out = None
    for n in tables.table(spark, sf_dir, "nation").select("n_nationkey").collect():  # 25 rows
        k = n["n_nationkey"]
        rows = params.DecimationSetup().run(2.0 ** (k - 4)).to_dataframe(spark).select(F.lit(k).cast("long").alias("fs_idx"), "level", "eval_idx", F.round("freq", 9).alias("freq"), "factor")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT unnest(range((n - 160) // 96 + 1)) AS k FROM n)
SELECT k + 2 AS global_win, k AS local_win, 32 + 96 * k AS from_sample, 159 + 96 * k AS to_sample, '2024-01-01'::TIMESTAMP + to_microseconds((k + 2) * 6000000) AS win_start,
  '2024-01-01'::TIMESTAMP + to_microseconds((k + 2) * 6000000 + 7937500) AS win_end FROM k""")
def win_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.table(spark, sf_dir, "orders").count()
    return params.window_table(spark, params.window_grid(tables.REF, tables.FIRST, n, tables.FS, *tables.window_sizes()), tables.REF, tables.FS)


def _windowed(spark: SparkSession, sf_dir: str) -> WindowedData:
    data = tables.line_clean(spark, sf_dir)
    parameters = tables.SETUP.run(data.fs)
    return Windower().run(tables.REF, Decimator().run(data, parameters), params.WindowSetup().run(1, [data.fs]))


@query(f"WITH {_WINDOWS} SELECT chan, global_win, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, round(sum(value * pos), 4) AS moment FROM win GROUP BY ALL")
def win_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windowed(spark, sf_dir).df.groupBy("chan", "global_win").agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), r6(F.sum(F.col("value") * F.col("pos")), 4).alias("moment")
    )


@query("""WITH n AS (SELECT count(*) AS n FROM orders), g AS (SELECT n, greatest(64, floor(n / 750)::BIGINT) AS size FROM n), h AS (SELECT n, size, floor(size * 0.25)::BIGINT AS olap FROM g),
i AS (SELECT *, ceil(10 * 16.0 / (size - olap))::BIGINT AS first_win FROM h), j AS (SELECT *, first_win * (size - olap) - 160 AS first_sample FROM i)
SELECT size AS win_size, olap AS olap_size, first_win, first_sample, (n - first_sample - size) // (size - olap) + 1 AS n_wins FROM j""")
def win_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.table(spark, sf_dir, "orders").count()
    target = params.WindowTarget()
    grid = target.parameters([n]).grids(tables.REF, tables.FIRST, [n], [tables.FS])[0]
    return spark.createDataFrame([(grid.win_size, grid.olap_size, grid.first_win, grid.first_sample, grid.n_wins)], "win_size long, olap_size long, first_win long, first_sample long, n_wins long")


# --- spectra ---------------------------------------------------------------


@query(f"""WITH {_WINDOWS}, bins AS (SELECT unnest(range(65)) AS bin), {_transform("bins")} SELECT chan, global_win, bin::INTEGER AS freq_idx, round(bin / 8, 6) AS freq, round(re, 5) AS re, round(im, 5) AS im FROM z""")
def fft_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = spectra.FourierTransform().run(_windowed(spark, sf_dir))
    return rounded(data.long().select("chan", "global_win", "freq_idx", "freq", r6("re", 5).alias("re"), r6("im", 5).alias("im")), "freq")


def _line_evals(spark: SparkSession, sf_dir: str) -> tuple[spectra.SpectraData, params.DecimationParameters]:
    parameters = tables.SETUP.run(tables.FS)
    return spectra.FourierTransform().evals(_windowed(spark, sf_dir), parameters), parameters


@query(f"WITH {_EVALS} SELECT chan, global_win, freq_idx, round(freq, 6) AS freq, round(re, 5) AS re, round(im, 5) AS im FROM evals")
def fft_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_evals(spark, sf_dir)[0].long()
    return rounded(rows.select("chan", "global_win", "freq_idx", "freq", r6("re", 5).alias("re"), r6("im", 5).alias("im")), "freq")


@query(f"WITH {_EVALS} SELECT chan, global_win, freq_idx, round(re, 5) AS re, round(im, 5) AS im FROM evals")
def fft_evals_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same values through whole spectra and interpolation."""
    data = spectra.FourierTransform().run(_windowed(spark, sf_dir))
    rows = spectra.EvaluationFreqs().run(data, tables.SETUP.run(tables.FS)).long()
    return rows.select("chan", "global_win", "freq_idx", r6("re", 5).alias("re"), r6("im", 5).alias("im"))


@query(f"WITH {_EVALS} SELECT chan, freq_idx, round(avg(sqrt(re * re + im * im)), 6) AS amplitude FROM evals GROUP BY ALL")
def fft_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.stack(_line_evals(spark, sf_dir)[0]).select("chan", "freq_idx", "amplitude"), "amplitude")


_STARTED = f"""WITH {_EVALS}, started AS (SELECT *, time_bucket(INTERVAL '5 minutes', '2024-01-01'::TIMESTAMP + to_microseconds(global_win * 6000000)) AS group_start FROM evals),
groups AS (SELECT group_start, chan, freq_idx, avg(sqrt(re * re + im * im)) AS amplitude FROM started GROUP BY ALL)"""


@query(f"{_STARTED} SELECT group_start, chan, freq_idx, round(amplitude, 6) AS amplitude FROM groups")
def fft_time_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.stack_by_time(_line_evals(spark, sf_dir)[0], "5 minutes").select("group_start", "chan", "freq_idx", "amplitude"), "amplitude")


@query(f"{_STARTED} SELECT group_start, chan, freq_idx, round(log10(amplitude), 6) AS log_amplitude FROM groups")
def fft_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.section(_line_evals(spark, sf_dir)[0], 0, "5 minutes").select("group_start", "chan", "freq_idx", "log_amplitude"), "log_amplitude")


@query(f"{_STARTED} SELECT chan, ceil(min(log10(amplitude)))::BIGINT AS low, floor(max(log10(amplitude)))::BIGINT AS high FROM groups GROUP BY chan")
def fft_section_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectra.section_range(spectra.section(_line_evals(spark, sf_dir)[0], 0, "5 minutes"))


_UNWRAPPED = """lagged AS (SELECT *, phs - lag(phs) OVER (PARTITION BY {k} ORDER BY freq_idx) AS d FROM polar),
turned AS (SELECT *, phs + 2 * pi() * sum(CASE WHEN abs(d) > pi() THEN -ceil((d - pi()) / (2 * pi())) ELSE 0 END) OVER (PARTITION BY {k} ORDER BY freq_idx) AS u FROM lagged)"""


@query(f"""WITH {_EVALS}, polar AS (SELECT *, atan2(im, re) AS phs FROM evals), {_UNWRAPPED.format(k="chan, global_win")}
SELECT chan, global_win, freq_idx, round(sqrt(re * re + im * im), 5) AS mag, round(u, 5) AS phs FROM turned""")
def mag_phs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_evals(spark, sf_dir)[0].mag_phs(True).select("chan", "global_win", "freq_idx", r6("mag", 5).alias("mag"), r6("phs", 5).alias("phs"))


def _embedded(spark: SparkSession, sf_dir: str) -> spectra.SpectraData:
    """Embeddings as spectra of 64 frequencies: each vector's numbers times 100, and in reverse order."""
    v = F.transform("embedding", lambda x: x.cast("double") * 100)
    rows = tables.table(spark, sf_dir, "embeddings").select(F.lit("e").alias("site"), F.lit("m").alias("meas"), F.lit(0).alias("level"), F.lit("Ex").alias("chan"), F.col("vec_id").alias("global_win"), v.alias("re"), F.reverse(v).alias("im"))
    return spectra.SpectraData(rows, {0: tuple(float(i) for i in range(64))})


def _smooth_sql(weights: np.ndarray) -> str:
    h = len(weights) // 2
    at = "CASE WHEN i + o - {h} < 0 THEN -1 - (i + o - {h}) WHEN i + o - {h} > 63 THEN 127 - (i + o - {h}) ELSE i + o - {h} END".format(h=h)
    return f"""WITH w(o, w) AS (VALUES {_values(weights)}), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 100) AS re FROM embeddings), f AS (SELECT vec_id, re, list_reverse(re) AS im, unnest(range(64)) AS i FROM e)
SELECT vec_id AS global_win, i::INTEGER AS freq_idx, round(sum(w * re[{at} + 1]), 6) AS re, round(sum(w * im[{at} + 1]), 6) AS im FROM f, w GROUP BY ALL"""


@query(_smooth_sql(np.full(kernels.uniform_width(0.1, 64), 1 / kernels.uniform_width(0.1, 64))))
def smooth_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.SpectraSmootherUniform(0.1).run(_embedded(spark, sf_dir)).long().select("global_win", "freq_idx", "re", "im"), "re", "im")


@query(_smooth_sql(kernels.gaussian_weights(1.0)))
def smooth_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spectra.SpectraSmootherGaussian(1.0).run(_embedded(spark, sf_dir)).long().select("global_win", "freq_idx", "re", "im"), "re", "im")


_CALIBRATION = CalibrationData("coil", "20", (0.5, 1.0, 2.0, 4.0), (10.0, 11.0, 12.0, 13.0), (0.1, 0.2, 0.4, 0.3))


def _calibrate_sql() -> str:
    cal = ", ".join(f"({f}, {m}, {p})" for f, m, p in zip(_CALIBRATION.frequency, _CALIBRATION.magnitude, _CALIBRATION.phase))
    return f"""WITH {_EVALS}, cal(f, m, p) AS (VALUES {cal}), seg AS (SELECT f, m, p, lead(f) OVER o AS f2, lead(m) OVER o AS m2, lead(p) OVER o AS p2 FROM cal WINDOW o AS (ORDER BY f)),
resp AS (
  SELECT freq_idx, CASE WHEN freq <= 0.5 THEN 10 WHEN freq >= 4 THEN 13 ELSE m + (m2 - m) * (freq - f) / (f2 - f) END AS m, CASE WHEN freq <= 0.5 THEN 0.1 WHEN freq >= 4 THEN 0.3 ELSE p + (p2 - p) * (freq - f) / (f2 - f) END AS p
  FROM freqs LEFT JOIN seg ON freq >= f AND freq < f2)
SELECT chan, global_win, freq_idx, round(CASE WHEN chan[1] = 'H' THEN (re * cos(p) + im * sin(p)) / m ELSE re END, 5) AS re, round(CASE WHEN chan[1] = 'H' THEN (im * cos(p) - re * sin(p)) / m ELSE im END, 5) AS im FROM evals JOIN resp USING (freq_idx)"""


@query(_calibrate_sql())
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnetic channels by one coil's calibration; electric ones have none and pass."""
    done = SensorCalibrator().run(_line_evals(spark, sf_dir)[0], {c: _CALIBRATION for c in ("Hx", "Hy", "Hz")})
    return done.long().select("chan", "global_win", "freq_idx", r6("re", 5).alias("re"), r6("im", 5).alias("im"))


# --- sites -----------------------------------------------------------------

_EVENTS = """h AS (
  SELECT 's' || user_id % 3 AS site, floor((epoch_us(ts) - 1704067200000000) / 3600000000)::BIGINT AS hour, value,
    CASE event_type WHEN 'click' THEN 'Hx' WHEN 'error' THEN 'Hy' WHEN 'purchase' THEN 'Hz' WHEN 'signup' THEN 'Ex' WHEN 'view' THEN 'Ey' END AS chan FROM events),
hm AS (SELECT site, least(hour // 360, 1) AS half, chan, hour, avg(value) AS value FROM h GROUP BY ALL),
spine AS (SELECT 's' || s AS site, half, chan, half * 360 + i AS hour FROM range(3) a(s), range(2) b(half), (VALUES ('Ex'), ('Ey'), ('Hx'), ('Hy'), ('Hz')) c(chan), range(360) d(i)),
ev AS (SELECT site, 'm' || half AS meas, chan, hour - half * 360 AS sample, value FROM spine LEFT JOIN hm USING (site, half, chan, hour))"""
EVENT_WINDOWS = params.WindowParameters(1, 1, (30,), (10,))


def _event_windows(spark: SparkSession, sf_dir: str) -> WindowedData:
    """Windows of 30 hours, 20 apart; the second measurement of site s2 is left out."""
    data = timeops.InterpolateNans().run(tables.events(spark, sf_dir))
    keep = tuple(r for r in data.recordings if (r.site, r.meas) != ("s2", "m1"))
    data = replace(data, df=data.df.where("not (site = 's2' and meas = 'm1')"), recordings=keep)
    parameters = params.DecimationSetup(n_levels=1, per_level=5, min_samples=30).run(data.fs)
    return Windower().run("2024-01-01 00:00:00", Decimator().run(data, parameters), EVENT_WINDOWS)


_META = """meta(site, meas, first_win, n_wins) AS (VALUES ('s0', 'm0', 0, 17), ('s0', 'm1', 18, 17), ('s1', 'm0', 0, 17), ('s1', 'm1', 18, 17), ('s2', 'm0', 0, 17)),
sw AS (SELECT site, min(meas) AS meas, global_win FROM (SELECT site, meas, unnest(range(first_win, first_win + n_wins)) AS global_win FROM meta) GROUP BY site, global_win),
sel AS (SELECT site, meas, global_win FROM sw JOIN (SELECT global_win FROM sw GROUP BY global_win HAVING count(*) = 3) USING (global_win))"""


@query(f"WITH {_META} SELECT site, meas, global_win::BIGINT AS global_win FROM sel")
def select_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    parameters = params.DecimationSetup(n_levels=1, per_level=5, min_samples=30).run(tables.EVENT_FS)
    selection = gather.Selector().run(_event_windows(spark, sf_dir).metadata(), ["s0", "s1", "s2"], parameters)
    return selection.df.select("site", "meas", "global_win")


@query(f"WITH {_META} SELECT site, global_win::BIGINT AS global_win, meas FROM sw")
def site_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gather.site_windows(_event_windows(spark, sf_dir).metadata()).select("site", "global_win", "meas")


_EVENT_EVALS = f"""WITH {_EVENTS}, {_filled("ev", "site, meas, chan")},
win AS (
  SELECT site, meas, chan, k + CASE meas WHEN 'm0' THEN 0 ELSE 18 END AS global_win, (sample - 20 * k)::INTEGER AS pos, value
  FROM (SELECT *, unnest(range(greatest(0, ceil((sample - 29) / 20)::BIGINT), least(16, sample // 20) + 1)) AS k FROM filled WHERE NOT (site = 's2' AND meas = 'm1'))),
{_META}, {_evals("win", "site, meas, chan, global_win", tables.EVENT_FS, 30)},
g AS (SELECT e.* FROM evals e JOIN sel USING (site, meas, global_win))"""


def _gathered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, params.DecimationParameters]:
    """Electric channels of site s0, magnetic ones of s1, cross channels of the remote site s2."""
    windowed = _event_windows(spark, sf_dir)
    parameters = params.DecimationSetup(n_levels=1, per_level=5, min_samples=30).run(tables.EVENT_FS)
    evals = spectra.FourierTransform().evals(windowed, parameters)
    selection = gather.Selector().run(windowed.metadata(), ["s0", "s1", "s2"], parameters)
    return gather.ProjectGather().run(selection, evals, IMPEDANCE, gather.Roles("s0", "s1", "s2")), parameters


@query(f"""{_EVENT_EVALS}
SELECT o.freq_idx AS eval_idx, o.global_win::BIGINT AS global_win, round(o.re, 5) AS out_re, round(o.im, 5) AS out_im, round(i.re, 5) AS in_re, round(i.im, 5) AS in_im, round(c.re, 5) AS cross_re, round(c.im, 5) AS cross_im
FROM g o JOIN g i USING (freq_idx, global_win) JOIN g c USING (freq_idx, global_win) WHERE o.site = 's0' AND o.chan = 'Ey' AND i.site = 's1' AND i.chan = 'Hx' AND c.site = 's2' AND c.chan = 'Hy'""")
def gather_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gathered(spark, sf_dir)[0]
    named = {"out": "Ey", "in": "Hx", "cross": "Hy"}
    return rows.select("eval_idx", "global_win", *[r6(F.col(f"{role}.{c}_{p}"), 5).alias(f"{role}_{p}") for role, c in named.items() for p in ("re", "im")])


# --- regression ------------------------------------------------------------

_CROSS = """p AS (
  SELECT a.freq_idx AS eval_idx, a.global_win, a.chan, c.chan AS cross_chan, a.re * c.re + a.im * c.im AS re, a.im * c.re - a.re * c.im AS im
  FROM evals a JOIN evals c USING (freq_idx, global_win) WHERE c.chan IN ('Hx', 'Hy'))"""


def _quick(spark: SparkSession, sf_dir: str, tf: transfer.TransferFunction) -> tuple[DataFrame, params.DecimationParameters]:
    evals, parameters = _line_evals(spark, sf_dir)
    return gather.QuickGather().run(evals, parameters, tf), parameters


@query(f"WITH {_EVALS}, {_CROSS} SELECT eval_idx, global_win, chan, cross_chan, round(re, 4) AS re, round(im, 4) AS im FROM p WHERE chan IN ('Ex', 'Ey')")
def cross_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regression.cross_powers(_quick(spark, sf_dir, IMPEDANCE)[0], IMPEDANCE).select("eval_idx", "global_win", "cross_chan", F.explode("out").alias("o"))
    return rows.select("eval_idx", "global_win", "o.chan", "cross_chan", r6("o.re", 4).alias("re"), r6("o.im", 4).alias("im"))


@query(f"""WITH {_EVALS}, {_CROSS}, j AS (
  SELECT o.eval_idx, o.chan AS out_chan, o.global_win, o.cross_chan, o.re, o.im, x.re AS xr, x.im AS xi, y.re AS yr, y.im AS yi
  FROM p o JOIN p x USING (eval_idx, global_win, cross_chan) JOIN p y USING (eval_idx, global_win, cross_chan) WHERE o.chan IN ('Ex', 'Ey') AND x.chan = 'Hx' AND y.chan = 'Hy')
SELECT eval_idx, out_chan, global_win, cross_chan, 're' AS part, round(re, 4) AS y, round(xr, 4) AS x0, round(-xi, 4) AS x1, round(yr, 4) AS x2, round(-yi, 4) AS x3 FROM j
UNION ALL SELECT eval_idx, out_chan, global_win, cross_chan, 'im', round(im, 4), round(xi, 4), round(xr, 4), round(yi, 4), round(yr, 4) FROM j""")
def regression_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regression.regression_rows(_quick(spark, sf_dir, IMPEDANCE)[0], IMPEDANCE)
    return rows.select("eval_idx", "out_chan", "global_win", "cross_chan", "part", r6("y", 4).alias("y"), *[r6(F.col("x")[i], 4).alias(f"x{i}") for i in range(4)])


_OLS = f"""WITH {_EVALS}, {_CROSS}, j AS (
  SELECT o.eval_idx, o.chan AS out_chan, o.re, o.im, x.re AS xr, x.im AS xi, y.re AS yr, y.im AS yi
  FROM p o JOIN p x USING (eval_idx, global_win, cross_chan) JOIN p y USING (eval_idx, global_win, cross_chan) WHERE o.chan IN ('Ex', 'Ey', 'Hz') AND x.chan = 'Hx' AND y.chan = 'Hy'),
q AS (
  SELECT eval_idx, out_chan, sum(xr * xr + xi * xi) AS a, sum(yr * yr + yi * yi) AS d, sum(xr * yr + xi * yi) AS br, sum(xr * yi - xi * yr) AS bi,
    sum(xr * re + xi * im) AS ur, sum(xr * im - xi * re) AS ui, sum(yr * re + yi * im) AS vr, sum(yr * im - yi * re) AS vi FROM j GROUP BY ALL),
ols AS (
  SELECT eval_idx, out_chan, 'Hx' AS in_chan, (d * ur - (br * vr - bi * vi)) / (a * d - br * br - bi * bi) AS re, (d * ui - (br * vi + bi * vr)) / (a * d - br * br - bi * bi) AS im FROM q
  UNION ALL SELECT eval_idx, out_chan, 'Hy', (a * vr - (br * ur + bi * ui)) / (a * d - br * br - bi * bi), (a * vi - (br * ui - bi * ur)) / (a * d - br * br - bi * bi) FROM q),
sol AS (SELECT eval_idx, freq, 1 / freq AS period, out_chan, in_chan, re, im FROM ols JOIN freqs ON freq_idx = eval_idx)"""


def _solution(spark: SparkSession, sf_dir: str, solver: regression.Solver | None = None, tf: transfer.TransferFunction = TO_TIPPER) -> transfer.Solution:
    gathered, parameters = _quick(spark, sf_dir, tf)
    return (solver or regression.SolverOLS()).run(gathered, tf, parameters)


@query(f"{_OLS} SELECT eval_idx, round(period, 6) AS period, out_chan, in_chan, round(re, 6) AS re, round(im, 6) AS im FROM sol")
def solve_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_solution(spark, sf_dir).df.select("eval_idx", "period", "out_chan", "in_chan", "re", "im"), "period", "re", "im")


@query(f"""{_OLS}, polar AS (SELECT *, eval_idx AS freq_idx, atan2(im, re) AS phs FROM sol WHERE out_chan <> 'Hz'), {_UNWRAPPED.format(k="out_chan, in_chan")}
SELECT eval_idx, out_chan, in_chan, round(re, 6) AS re, round(im, 6) AS im, round(0.2 * period * (re * re + im * im), 6) AS resistivity,
  round(CASE WHEN out_chan = 'Ex' THEN degrees(u) - 360 * floor(degrees(u) / 360) - 180 ELSE degrees(u) END, 4) AS phase FROM turned""")
def impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to impedance: gaps filled, mean removed, windows, evaluation frequencies, least squares, resistivity and phase."""
    solved = _solution(spark, sf_dir, tf=IMPEDANCE).df
    rows = IMPEDANCE.phase(IMPEDANCE.resistivity(solved))
    return rounded(rows.select("eval_idx", "out_chan", "in_chan", "re", "im", "resistivity", r6("phase", 4).alias("phase")), "re", "im", "resistivity")


@query(f"""{_OLS} SELECT x.eval_idx, round(sqrt(x.re * x.re + y.re * y.re), 6) AS length, round(degrees(atan(y.re / x.re)), 4) AS real_angle, round(degrees(atan(y.im / x.im)), 4) AS imag_angle
FROM sol x JOIN sol y USING (eval_idx, out_chan) WHERE out_chan = 'Hz' AND x.in_chan = 'Hx' AND y.in_chan = 'Hy'""")
def tipper(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = TIPPER.arrows(_solution(spark, sf_dir, tf=TIPPER).df)
    return rows.select("eval_idx", r6("length").alias("length"), r6("real_angle", 4).alias("real_angle"), r6("imag_angle", 4).alias("imag_angle"))


# rows (eval_idx, out_chan, y, x0 to x3) of the impedance, a row for the real and one for the imaginary part
_ROWS = f"""{_EVALS}, {_CROSS}, j AS (
  SELECT o.eval_idx, o.chan AS out_chan, o.re, o.im, x.re AS xr, x.im AS xi, y.re AS yr, y.im AS yi
  FROM p o JOIN p x USING (eval_idx, global_win, cross_chan) JOIN p y USING (eval_idx, global_win, cross_chan) WHERE o.chan IN ('Ex', 'Ey') AND x.chan = 'Hx' AND y.chan = 'Hy'),
rows AS MATERIALIZED (
  SELECT eval_idx, out_chan, re AS y, xr AS x0, -xi AS x1, yr AS x2, -yi AS x3 FROM j
  UNION ALL SELECT eval_idx, out_chan, im, xi, xr, yi, yr FROM j)"""
_FIT = "(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3)"


def _normal(weight: str = "1.0") -> str:
    """Sums of the weighted normal equations of four unknowns."""
    return ", ".join([f"sum({weight} * x{i} * x{k}) AS a{i}{k}" for i in range(4) for k in range(i, 4)] + [f"sum({weight} * x{i} * y) AS c{i}" for i in range(4)])


def _eliminate(ridge: str = "0.0") -> str:
    """Columns that solve those equations: elimination, then the unknowns from the last to the first."""
    a = {(i, k): f"a{i}{k}" + (f" + {ridge}" if i == k else "") for i in range(4) for k in range(i, 4)}
    c, columns = [f"c{i}" for i in range(4)], []
    for k in range(4):
        columns += [f"({a[k, m]}) AS u{k}{m}" for m in range(k, 4)] + [f"({c[k]}) AS v{k}"]
        for i in range(k + 1, 4):
            a |= {(i, m): f"{a[i, m]} - u{k}{i} / u{k}{k} * u{k}{m}" for m in range(i, 4)}
            c[i] = f"{c[i]} - u{k}{i} / u{k}{k} * v{k}"
    for k in (3, 2, 1, 0):
        columns.append(f"(v{k}{''.join(f' - u{k}{m} * b{m}' for m in range(k + 1, 4))}) / u{k}{k} AS b{k}")
    return ", ".join(columns)


_GROUP = "eval_idx, out_chan"
_START = f"SELECT {_GROUP}, {_eliminate()} FROM (SELECT {_GROUP}, {_normal()} FROM rows GROUP BY ALL)"
_SOLVED = """, parts AS (SELECT *, unnest([{'in_chan': 'Hx', 're': b0, 'im': b1}, {'in_chan': 'Hy', 're': b2, 'im': b3}]) AS s FROM done)
SELECT eval_idx, round(freq, 6) AS freq, round(1 / freq, 6) AS period, out_chan, s.in_chan AS in_chan, round(s.re, 6) AS re, round(s.im, 6) AS im FROM parts JOIN freqs ON freq_idx = eval_idx"""

# weights of 1 up to two scaled residuals, 0 beyond, 50 times
_WLS = f"""WITH RECURSIVE {_ROWS},
it(i, eval_idx, out_chan, b0, b1, b2, b3) AS (
  SELECT 0, {_GROUP}, b0, b1, b2, b3 FROM ({_START})
  UNION ALL
  SELECT i + 1, {_GROUP}, b0, b1, b2, b3 FROM (SELECT i, {_GROUP}, {_eliminate()} FROM (
    SELECT i, {_GROUP}, {_normal("w")} FROM (
      SELECT *, CASE WHEN abs(e - q2) <= 2 * CASE WHEN q3 > q1 THEN q3 - q1 ELSE 1 END THEN 1.0 ELSE 0.0 END AS w FROM (
        SELECT *, quantile_cont(e, 0.25) OVER g AS q1, quantile_cont(e, 0.5) OVER g AS q2, quantile_cont(e, 0.75) OVER g AS q3
        FROM (SELECT it.i, rows.*, y - {_FIT} AS e FROM it JOIN rows USING (eval_idx, out_chan)) WINDOW g AS (PARTITION BY {_GROUP}))) GROUP BY ALL)) WHERE i < 50),
done AS (SELECT * FROM it WHERE i = 50){_SOLVED}"""

# quadratic loss up to one scale, linear beyond; the scale is estimated with the coefficients
_HUBER = f"""WITH RECURSIVE {_ROWS},
it(i, eval_idx, out_chan, b0, b1, b2, b3, scale, floor) AS (
  SELECT 0, {_GROUP}, any_value(b0), any_value(b1), any_value(b2), any_value(b3), greatest(median(abs(y - {_FIT})), 1e-12), {solvers.FLOOR} * greatest(median(abs(y - {_FIT})), 1e-12)
  FROM ({_START}) JOIN rows USING (eval_idx, out_chan) GROUP BY {_GROUP}
  UNION ALL
  SELECT i + 1, {_GROUP}, b0, b1, b2, b3, greatest(CASE WHEN free > 0 AND part > 0 THEN sqrt(part / free) ELSE scale * 0.9 END, floor), floor FROM (
    SELECT i, {_GROUP}, b0, b1, b2, b3, scale, floor, count(*) FILTER (abs(y - {_FIT}) <= scale) AS free, coalesce(sum((y - {_FIT}) ** 2) FILTER (abs(y - {_FIT}) <= scale), 0) AS part FROM (
      SELECT i, {_GROUP}, scale, floor, {_eliminate("1e-4 * scale")} FROM (
        SELECT i, {_GROUP}, scale, floor, {_normal("w")} FROM (
          SELECT it.i, it.scale, it.floor, rows.*, least(1.0, scale / greatest(abs(y - {_FIT}), 1e-300)) AS w FROM it JOIN rows USING (eval_idx, out_chan)) GROUP BY ALL)) JOIN rows USING (eval_idx, out_chan) GROUP BY ALL) WHERE i < 200),
done AS (SELECT * FROM it WHERE i = 200){_SOLVED}"""


def _solver_query(name: str, solver: regression.Solver, sql: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(_solution(spark, sf_dir, solver, IMPEDANCE).df, "freq", "period", "re", "im")

    run.__name__ = name
    query(sql)(run)


for _name, _solver, _sql in (
    ("solve_huber", regression.SolverHuber(), _HUBER), ("solve_theilsen", regression.SolverTheilSen(), None),
    ("solve_ransac", regression.SolverRANSAC(), None), ("solve_wls", regression.SolverWLS(), _WLS),
):
    _solver_query(_name, _solver, _sql)


def _pyramid_sql() -> str:
    """The chain over as many levels as 128 samples a window leave to 500,000 samples: FIR resampling from level to level, windows of 128, 96 apart, and least squares."""
    setup = params.DecimationSetup().run(tables.FS)
    levels = range(5)
    parts, wins, freqs = ["l0 AS MATERIALIZED (SELECT chan, sample, value, count(*) OVER (PARTITION BY chan) AS n FROM clean)"], [], []
    for level in levels:
        factor, q = setup.factors[level], setup.increments[level]
        if level:
            taps, up = kernels.resample_taps(1, q), f"l{level - 1}"
            half = len(taps) // 2
            parts.append(f"""h{level}(i, h) AS (VALUES {_values(taps)}), m{level} AS (SELECT chan, avg(value) AS mean, ceil(any_value(n) / {q})::BIGINT AS n FROM {up} GROUP BY chan),
l{level} AS MATERIALIZED (
  SELECT chan, o AS sample, mean + coalesce(sum((value - mean) * h), 0) AS value, m.n FROM (
    SELECT chan, value, sample, unnest(range(greatest(0, ceil((sample - {half}) / {q})::BIGINT), (sample + {half}) // {q} + 1)) AS o FROM {up})
  JOIN m{level} m USING (chan) JOIN h{level} ON i = o * {q} - sample + {half} WHERE o < m.n GROUP BY chan, o, mean, m.n)""")
        fs, ahead = tables.FS / factor, 10 * tables.FS / factor  # the recording begins 10 s after the reference time
        first_win = math.ceil(ahead / 96)
        first = math.floor(first_win * 96 - ahead)
        last = f"(n - {first + 128}) // 96"
        wins.append(f"""SELECT chan, {level} AS level, k + {first_win} AS global_win, (sample - {first} - 96 * k)::INTEGER AS pos, value FROM (
  SELECT *, unnest(range(greatest(0, ceil((sample - {first + 127}) / 96)::BIGINT), least({last}, (sample - {first}) // 96) + 1)) AS k FROM l{level} WHERE n >= 256 AND sample >= {first} AND {last} >= 4)""")
        freqs += [f"({setup.eval_idx(level, i)}, {level}, {f!r}::DOUBLE, {int(f * 128 / fs)}, {f * 128 / fs - int(f * 128 / fs)!r}::DOUBLE)" for i, f in enumerate(setup.freqs[level])]
    return f"""WITH {_CLEAN}, {", ".join(parts)},
win AS ({" UNION ALL ".join(wins)}),
freqs(freq_idx, level, freq, low, part) AS (VALUES {", ".join(freqs)}),
bins AS (SELECT DISTINCT unnest([low, low + 1]) AS bin FROM freqs),
{_transform("bins", "win", "chan, level, global_win")},
evals AS (
  SELECT x.chan, x.global_win, freq_idx, freq, x.re * (1 - part) + y.re * part AS re, x.im * (1 - part) + y.im * part AS im
  FROM freqs f JOIN z x ON x.bin = low AND x.level = f.level JOIN z y ON y.bin = low + 1 AND y.level = f.level AND y.chan = x.chan AND y.global_win = x.global_win),
{_CROSS}, {_OLS[_OLS.index("j AS ("):]}
SELECT eval_idx, round(freq, 6) AS freq, round(period, 6) AS period, out_chan, in_chan, round(re, 6) AS re, round(im, 6) AS im FROM sol WHERE out_chan <> 'Hz'"""


@query(_pyramid_sql())
def impedance_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole default chain, all levels of the pyramid, least squares."""
    config = Configuration(solver=regression.SolverOLS())
    solved = pipeline.tf_of(config, tables.line(spark, sf_dir), tables.REF).df
    return rounded(solved, "freq", "period", "re", "im")


_REMOTE = f"""{_EVENT_EVALS},
p AS (
  SELECT a.freq_idx AS eval_idx, a.global_win, a.chan, c.chan AS cross_chan, a.re * c.re + a.im * c.im AS re, a.im * c.re - a.re * c.im AS im
  FROM g a JOIN g c USING (freq_idx, global_win)
  WHERE c.site = 's2' AND c.chan IN ('Hx', 'Hy') AND ((a.site = 's0' AND a.chan IN ('Ex', 'Ey')) OR (a.site = 's1' AND a.chan IN ('Hx', 'Hy')))),
{_OLS[_OLS.index("j AS ("):]}"""


@query(f"{_REMOTE} SELECT eval_idx, round(freq * 3600, 6) AS freq, round(period / 3600, 6) AS period, out_chan, in_chan, round(re, 6) AS re, round(im, 6) AS im FROM sol")
def impedance_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sites: electric channels, magnetic channels, and a remote reference."""
    gathered, parameters = _gathered(spark, sf_dir)
    return rounded(regression.SolverOLS().run(gathered, IMPEDANCE, parameters).df.withColumn("freq", F.col("freq") * 3600).withColumn("period", F.col("period") / 3600), "freq", "period", "re", "im")


# --- look-ups and counts ---------------------------------------------------


@query("SELECT DISTINCT o_totalprice AS fs, replace(printf('%.6f', o_totalprice), '.', '_') AS name FROM orders")
def fs_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_totalprice").alias("fs"), channels.fs_to_string_column(F.col("o_totalprice")).alias("name")).distinct()


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda x: printf('%.4f', x::DOUBLE)), ', ') AS text FROM embeddings""")
def array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", channels.array_to_string_column(F.col("embedding"), precision=4).alias("text"))


@query(f"WITH {_WINDOWS} SELECT chan, pos, round(value, 6) AS value FROM win WHERE global_win = 9")
def win_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_windowed(spark, sf_dir).get_global(0, 9).select("chan", "pos", "value"), "value")


@query(f"WITH {_EVALS} SELECT chan, global_win, round(re, 5) AS re, round(im, 5) AS im FROM evals WHERE freq_idx = 3 AND chan IN ('Ex', 'Hy')")
def spectra_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _line_evals(spark, sf_dir)[0].get_chan("Ex", "Hy").get_freq(0, 3)
    return rows.select("chan", "global_win", r6("re", 5).alias("re"), r6("im", 5).alias("im"))


@query(f"""WITH {_EVALS} SELECT a.freq_idx AS eval_idx, a.global_win, round(a.re, 5) AS out_re, round(b.re, 5) AS in_re, round(b.im, 5) AS cross_im
FROM evals a JOIN evals b USING (freq_idx, global_win) WHERE a.chan = 'Ex' AND b.chan = 'Hy'""")
def gather_quick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _quick(spark, sf_dir, IMPEDANCE)[0]
    return rows.select("eval_idx", "global_win", r6("out.Ex_re", 5).alias("out_re"), r6("in.Hy_re", 5).alias("in_re"), r6("cross.Hy_im", 5).alias("cross_im"))


def _selection(spark: SparkSession, sf_dir: str, masks: DataFrame | None = None) -> gather.Selection:
    parameters = params.DecimationSetup(n_levels=1, per_level=5, min_samples=30).run(tables.EVENT_FS)
    return gather.Selector().run(_event_windows(spark, sf_dir).metadata(), ["s0", "s1", "s2"], parameters, masks)


@query(f"WITH {_META} SELECT 0 AS level, i::INTEGER AS eval_idx, count(*) AS n_wins FROM sel, range(5) r(i) WHERE site = 's0' GROUP BY ALL")
def selection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).n_wins()


@query(f"WITH {_META} SELECT DISTINCT site, meas FROM sel")
def selection_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).measurements()


@query(f"WITH {_META} SELECT site, meas, global_win::BIGINT AS global_win FROM sel WHERE global_win NOT IN (SELECT hour % 17 FROM (SELECT DISTINCT hour(ts) AS hour FROM events WHERE event_type = 'error' AND value > 5) WHERE hour < 6)")
def selection_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows left out by a mask made of the hours with large errors."""
    hours = tables.table(spark, sf_dir, "events").where("event_type = 'error' and value > 5").select(F.hour("ts").alias("h")).distinct().where("h < 6")
    masks = hours.select(F.lit(0).alias("level"), F.pmod("h", F.lit(17)).cast("long").alias("global_win"))
    return _selection(spark, sf_dir, masks).df.select("site", "meas", "global_win")


@query(f"WITH {_LINE} SELECT chan, count(*) AS n_samples, count(value) AS n_known, round(min(value), 6) AS low, round(max(value), 6) AS high FROM s GROUP BY chan")
def agg_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(~F.isnan("value"), F.col("value"))
    return tables.line(spark, sf_dir).df.groupBy("chan").agg(F.count("*").alias("n_samples"), F.count(known).alias("n_known"), r6(F.min(known)).alias("low"), r6(F.max(known)).alias("high"))


__all__ = ["ORACLES", "QUERIES"]
