"""Queries that go through files, projects, time arithmetic and more than one level; their SQL never reads the files."""

from __future__ import annotations

import json
import math
import os
import shutil
import uuid
from dataclasses import replace
from datetime import timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.functions import channels, timing
from tellura.functions.frames import shared_dir, written
from tellura.operators import gather, params, regression, timeops
from tellura.operators.calibration import SensorCalibrator
from tellura.operators.params import Recording
from tellura.operators.transfer import Solution
from tellura.plans import catalog, pipeline, project, tables
from tellura.plans.config import Configuration
from tellura.plans.registry import query, r6, rounded
from tellura.sources.ascii import numbered_lines, write_parts
from tellura.sources.calibration import SensorCalibrationJSON, SensorCalibrationTXT
from tellura.sources.stages import read_metadata, read_stage, write_stage
from tellura.sources.store import ChanMetadata, TimeMetadata, TimeReaderAscii, TimeReaderNumpy, TimeWriterAscii, TimeWriterNumpy, dir_files, read_table, write_table


def _folder(spark: SparkSession, name: str) -> Path:
    """A new folder beside the session's other shared files, removed when the driver's JVM ends."""
    path = Path(shared_dir(spark).removeprefix("file:")) / f"{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"file:{path.absolute()}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _metadata(r: Recording) -> TimeMetadata:
    return TimeMetadata(r.fs, r.chans, r.n_samples, r.first_time)


# --- time arithmetic -------------------------------------------------------


@query("""SELECT n_nationkey::BIGINT AS k, round_even(n_nationkey * 1.25 * 2.0 ** (n_nationkey - 4), 0)::BIGINT + 1 AS n_samples,
  floor(n_nationkey * 1.25 * 2.0 ** (n_nationkey - 4))::BIGINT + 1 AS n_floor, ceil(n_nationkey * 1.25 * 2.0 ** (n_nationkey - 4))::BIGINT + 1 AS n_ceil,
  strftime('2024-02-28 23:59:58.5'::TIMESTAMP + to_microseconds(n_nationkey * 125000), '%Y-%m-%d %H:%M:%S.%f') || '_000000_000000_000000' AS text,
  '2024-02-28 23:59:58.5'::TIMESTAMP + to_microseconds(n_nationkey * 125000) AS time,
  ((n_nationkey * 40000) // 86400 * 86400)::DOUBLE AS day_seconds, ((n_nationkey * 40000) % 86400)::DOUBLE + n_nationkey / 4 AS rest_seconds,
  n_nationkey * 3600 + n_nationkey / 8 AS span, 2.0 ** (4 - n_nationkey) AS dt, (99 + n_nationkey) * 2.0 ** (4 - n_nationkey) AS duration, 2.0 ** (n_nationkey - 5) AS nyquist,
  round_even(n_nationkey * 7 / 6.0, 0)::BIGINT AS win, floor(n_nationkey * 7 / 6.0)::BIGINT AS win_floor, ceil(n_nationkey * 7 / 6.0)::BIGINT AS win_ceil,
  (n_nationkey + 1)::BIGINT AS product, n_nationkey % 10 = 0 AS outside,
  ['Ex', 'Ey', 'Hz'][n_nationkey % 3 + 1] || ['Hx', 'Hy'][n_nationkey % 2 + 1] AS component, n_nationkey % 3 < 2 AS out_electric FROM nation""")
def time_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, texts, window numbers and checks for a number of each nation; exact, on the driver: 25 rows."""
    rows = []
    for r in tables.table(spark, sf_dir, "nation").select("n_nationkey").collect():
        k = r["n_nationkey"]
        fs, instant = 2.0 ** (k - 4), timing.to_instant("2024-02-28 23:59:58.5") + timing.exact(k * 0.125)
        counts = [timing.to_n_samples(k * 1.25, fs, how) for how in ("round", "floor", "ceil")]
        days, rest = timing.to_seconds(timing.to_span(timedelta(seconds=k * 40000, milliseconds=250 * k)))
        recording = Recording("s", "m", fs, 100 + k, "2024-01-01")
        wins = [params.instant_to_win("2024-01-01", timing.to_instant("2024-01-01") + 7 * k, timedelta(seconds=6), how) for how in ("round", "floor", "ceil")]
        try:
            timing.check_sample(100, 99 if k % 10 else 100)
            outside = False
        except timing.ParameterError:
            outside = True
        out_chan, in_chan = ("Ex", "Ey", "Hz")[k % 3], ("Hx", "Hy")[k % 2]
        rows.append((
            k, *counts, timing.to_text(instant), timing.to_datetime(instant), days, rest, float(timing.to_span(timedelta(hours=k, milliseconds=125 * k))), float(recording.dt), float(recording.duration),
            recording.nyquist, *wins, math.prod(params.downsample_steps(k + 1)), outside, channels.component_key(out_chan, in_chan), channels.is_electric(out_chan),
        ))
    return spark.createDataFrame(rows, "k long, n_samples long, n_floor long, n_ceil long, text string, time timestamp_ntz, day_seconds double, rest_seconds double, span double, dt double, duration double, nyquist double, win long, win_floor long, win_ceil long, product long, outside boolean, component string, out_electric boolean")


@query("""WITH q AS (SELECT o_custkey AS k, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q FROM orders GROUP BY 1)
SELECT o_orderkey, round((o_totalprice - q[2]) / CASE WHEN q[3] > q[1] THEN q[3] - q[1] ELSE 1 END, 6) AS scaled FROM orders JOIN q ON o_custkey = k""")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each customer's orders less their median, over their interquartile range."""
    orders = tables.table(spark, sf_dir, "orders").where("o_custkey is not null").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("value"))
    return rounded(orders.select("o_orderkey", regression.robust_scaled("value", "o_custkey").alias("scaled")), "scaled")


# --- more than one level ---------------------------------------------------

_LEVELS = """meta AS (SELECT 's' || n_regionkey AS site, 'm' || n_nationkey AS meas, unnest(range(2 + n_regionkey)) AS level, n_nationkey * 3 AS index_offset FROM nation),
sw AS (SELECT site, level, win, min(meas) AS meas FROM (SELECT *, unnest(range(index_offset, index_offset + 60 - 20 * level)) AS win FROM meta WHERE site IN ('s1', 's2', 's3') AND level < 3) GROUP BY ALL),
sel AS (SELECT * FROM sw WHERE (level, win) IN (SELECT (level, win) FROM sw WHERE level < 3 GROUP BY level, win HAVING count(*) = 3))"""


def _levels(spark: SparkSession, sf_dir: str, masks: DataFrame | None = None) -> gather.Selection:
    """Measurements by nation, sites by region; site s<k> has k + 2 levels of 60, 40 and 20 windows and none beyond."""
    level = F.explode(F.sequence(F.lit(0), (F.col("n_regionkey") + 1).cast("int"))).alias("level")
    meta = tables.table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_regionkey").alias("site"), F.concat(F.lit("m"), "n_nationkey").alias("meas"), level, (F.col("n_nationkey") * 3).cast("long").alias("index_offset"))
    meta = meta.withColumn("n_wins", F.greatest(F.lit(0), 60 - 20 * F.col("level")).cast("long"))
    parameters = params.DecimationSetup(n_levels=6, per_level=2, min_samples=30).run(16.0)
    return gather.Selector().run(meta, ["s1", "s2", "s3"], parameters, masks)


@query(f"WITH {_LEVELS} SELECT level::INTEGER AS level, win::BIGINT AS global_win, site, meas FROM sel")
def select_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that all sites reach, windows that all hold."""
    return _levels(spark, sf_dir).df.select("level", "global_win", "site", "meas")


@query(f"""WITH {_LEVELS} SELECT level::INTEGER AS level, (level * 2 + f)::INTEGER AS eval_idx, count(*) AS n_wins FROM sel, range(2) r(f)
WHERE site = 's1' AND NOT (level * 2 + f < 5 AND win % (level * 2 + f + 2) = 0) GROUP BY ALL""")
def selection_masked_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of evaluation frequencies: frequency i lacks every (i + 2)th window, up to the fifth."""
    every = spark.range(5).select(F.col("id").cast("int").alias("eval_idx")).withColumn("global_win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(200).cast("long"))))
    return _levels(spark, sf_dir, every.where("global_win % (eval_idx + 2) = 0")).n_wins()


# --- recordings on disk ----------------------------------------------------


@query(f"WITH {catalog._CLEAN} SELECT chan, sample - 40 AS sample, round(value, 6) AS value FROM clean WHERE sample >= 40")
def store_numpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as npy with metadata, and read again from sample 40 on."""
    data, folder = tables.line_clean(spark, sf_dir), _folder(spark, "numpy")
    TimeWriterNumpy().run(folder, _metadata(data.recordings[0]), data)
    again = TimeReaderNumpy().run(spark, folder, "line", "all", from_time="2024-01-01 00:00:12.5")
    return rounded(again.df.select("chan", "sample", "value"), "value")


@query(f"WITH {catalog._CLEAN} SELECT chan, sample - 7 AS sample, round(round(value, 6)::FLOAT::DOUBLE, 4) + 0.0 AS value FROM clean WHERE sample >= 7")
def store_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels written as text, put side by side in one file with two lines of header, and read again in single precision from sample 7 on."""
    data, folder = tables.line_clean(spark, sf_dir), _folder(spark, "text")
    data = replace(data, df=written(data.df, "clean"))  # two passes over it
    meta = _metadata(data.recordings[0])
    TimeWriterAscii().run(folder / "out", meta, data)
    lines, name = folder / "lines", "all.txt"
    for path in (lines, folder / "parts"):
        os.makedirs(path)
    write_parts(data.df, {str(lines.absolute()): meta.chans}, meta.n_samples * len(meta.chans))
    with open(folder / "parts" / name, "wb") as file:
        file.write(f"a header\n{' '.join(meta.chans)}\n".encode())
        for part in dir_files(lines):
            with open(part, "rb") as text:
                shutil.copyfileobj(text, file, 1 << 20)
    told = replace(meta, chans_metadata={c: ChanMetadata(c, (name,)) for c in meta.chans})
    (folder / "parts/metadata.json").write_text(told.to_json())
    again = TimeReaderAscii(n_header=2).run(spark, folder / "parts", "line", "all", from_sample=7)
    return rounded(again.df.select("chan", "sample", "value"), "value", digits=4)


@query(f"WITH {catalog._CLEAN} SELECT chan, count(*) AS n, sum(sample)::BIGINT AS samples, round(sum(round(value, 6) * (sample % 100)), 3) AS moment FROM clean GROUP BY chan")
def store_ascii_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text files of the channels: a value a line, in the samples' order."""
    data, folder = tables.line_clean(spark, sf_dir), _folder(spark, "ascii")
    TimeWriterAscii().run(folder, _metadata(data.recordings[0]), data)
    out = None
    for chan in data.chans:
        lines = numbered_lines(spark, str(folder / f"{chan}.ascii")).select(F.lit(chan).alias("chan"), F.col("line").alias("sample"), F.col("text").cast("double").alias("value"))
        out = lines if out is None else out.unionByName(lines)
    return out.groupBy("chan").agg(F.count("*").alias("n"), F.sum("sample").alias("samples"), r6(F.sum(F.col("value") * (F.col("sample") % 100)), 3).alias("moment"))


# --- stages on disk --------------------------------------------------------


@query(f"WITH {catalog._CLEAN} SELECT chan, sample, round(value, 6) AS value FROM clean")
def store_decimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decimated recording written, read again, its first level looked up."""
    data, folder = tables.line_clean(spark, sf_dir), _folder(spark, "decimated")
    write_stage(catalog.Decimator().run(data, tables.SETUP.run(data.fs)), folder)
    return rounded(read_stage(spark, folder).get_level(0).df.select("chan", "sample", "value"), "value")


@query(f"WITH {catalog._WINDOWS} SELECT chan, global_win, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, round(sum(value * pos), 4) AS moment FROM win GROUP BY ALL")
def store_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "windowed")
    write_stage(catalog._windowed(spark, sf_dir), folder)
    rows = read_stage(spark, folder).get_level(0)
    return rows.groupBy("chan", "global_win").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), r6(F.sum(F.col("value") * F.col("pos")), 4).alias("moment"))


@query(f"WITH {catalog._EVALS} SELECT chan, global_win, freq_idx, round(freq, 6) AS freq, round(re, 5) AS re, round(im, 5) AS im, 5 AS n_freqs FROM evals")
def store_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "spectra")
    write_stage(catalog._line_evals(spark, sf_dir)[0], folder)
    n = len(read_metadata(folder)["freqs"]["0"])
    rows = read_stage(spark, folder).long().withColumn("n_freqs", F.lit(n))
    return rounded(rows.select("chan", "global_win", "freq_idx", "freq", r6("re", 5).alias("re"), r6("im", 5).alias("im"), "n_freqs"), "freq")


@query(f"WITH {catalog._CLEAN} SELECT chan, sample, round(value, 6) AS value FROM clean")
def store_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's table in folders by recording and level, one level read."""
    folder = _folder(spark, "table")
    write_table(tables.line_clean(spark, sf_dir).df, str(folder / "t"))
    return rounded(read_table(spark, str(folder / "t"), 0).select("chan", "sample", "value"), "value")


# --- calibration files -----------------------------------------------------

_POINTS = [(0.5, 10.0, 0.1), (1.0, 11.0, 0.2), (2.0, 12.0, 0.4)]
_POINTS_SQL = ", ".join(f"({f}, {m}, {p})" for f, m, p in _POINTS)


@query(f"""WITH p(f, m, p) AS (VALUES {_POINTS_SQL}) SELECT kind, 'coil' || n_nationkey AS sensor, '20' AS serial, 5.0::DOUBLE AS static_gain, f::DOUBLE AS frequency, (m + n_nationkey)::DOUBLE AS magnitude, round(p, 6)::DOUBLE AS phase
FROM nation, p, (VALUES ('json'), ('txt')) k(kind)""")
def calibration_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of each form for a coil of each nation, read by the readers that the channel's sensor leads to: 25 coils."""
    folder, rows = _folder(spark, "coils"), []
    for r in tables.table(spark, sf_dir, "nation").select("n_nationkey").collect():
        k, chan = r["n_nationkey"], ChanMetadata("Hx", sensor=f"coil{r['n_nationkey']}", serial="20")
        raw = {"sensor": chan.sensor, "serial": "20", "static_gain": 5, "frequency": [p[0] for p in _POINTS], "magnitude": [p[1] + k for p in _POINTS], "phase": [p[2] for p in _POINTS]}
        (folder / f"IC_{chan.sensor}.json").write_text(json.dumps(raw))
        head = f"Serial = 20\nSensor = {chan.sensor}\nStatic gain = 5\nPhase unit = degrees\nChopper = False\n\nCALIBRATION DATA\n"
        (folder / f"IC_{chan.sensor}.TXT").write_text(head + "".join(f"{f} {m + k} {math.degrees(p)!r}\n" for f, m, p in reversed(_POINTS)) + "\nmore\n")
        for kind, reader in (("json", SensorCalibrationJSON()), ("txt", SensorCalibrationTXT())):
            c = reader.run(folder, chan)
            rows += [(kind, c.sensor, c.serial, c.static_gain, f, m, round(p, 6)) for f, m, p in zip(c.frequency, c.magnitude, c.phase)]
    return spark.createDataFrame(rows, "kind string, sensor string, serial string, static_gain double, frequency double, magnitude double, phase double")


# --- projects --------------------------------------------------------------


def _event_project(spark: SparkSession, sf_dir: str) -> project.Project:
    """A project of the recordings made of the events; the second measurement of site s2 is left out."""
    root = _folder(spark, "project") / "p"
    project.new(root, "2024-01-01 00:00:00")
    data = tables.events(spark, sf_dir)
    for r in data.recordings:
        if (r.site, r.meas) != ("s2", "m1"):
            own = timeops.TimeData(data.df.where((F.col("site") == r.site) & (F.col("meas") == r.meas)), (r,))
            TimeWriterNumpy().run(project.meas_time_path(root, r.site, r.meas), _metadata(r), own)
    return project.load(root)


_MEASUREMENTS = "m(site, meas, first) AS (VALUES ('s0', 'm0', '01'), ('s0', 'm1', '16'), ('s1', 'm0', '01'), ('s1', 'm1', '16'), ('s2', 'm0', '01'))"


@query(f"""WITH {_MEASUREMENTS} SELECT site, meas, round(1 / 3600.0, 9) AS fs, 360::BIGINT AS n_samples, '2024-01-' || first || ' 00:00:00.000000_000000_000000_000000' AS first_time,
  CASE first WHEN '01' THEN '2024-01-15' ELSE '2024-01-30' END || ' 23:00:00.000000_000000_000000_000000' AS last_time, 'Ex,Ey' AS electric, 'Hx,Hy,Hz' AS magnetic, 'electric,magnetic' AS kinds,
  'Hz,Hx' AS calibrated, '/p/evals/' || site || '/c/' || meas AS evals, '0_000278_impedancetensor_a_b_x.json' AS solution FROM m""")
def project_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A project's measurements as its metadata has them, in the timeline's order."""
    proj = _event_project(spark, sf_dir)
    held = [(s.name, m.name, m.metadata) for f in proj.fs() for s in proj.get_sites(f) for m in s.get_measurements(f).values()]
    coils = SensorCalibrator(chans=("Hz", "Hx", "B1"))
    told = [
        (
            s, m, *[",".join(x) for x in (d.electric_chans(), d.magnetic_chans(), d.chan_types(), coils.select_chans(list(d.chans)))],
            str(project.meas_path("/p", "evals", s, m, "c")), project.solution_name(d.fs, "ImpedanceTensor", "a b", "x"),
        )
        for s, m, d in held
    ]
    kinds = spark.createDataFrame(told, "site string, meas string, electric string, magnetic string, kinds string, calibrated string, evals string, solution string")
    return rounded(proj.timeline(spark).join(kinds, ["site", "meas"]), "fs", digits=9)


@query(f"WITH {_MEASUREMENTS} SELECT site, count(*) AS n_meas, '2024-01-' || min(first) || ' 00:00:00' AS begin_time, CASE max(first) WHEN '01' THEN '2024-01-15' ELSE '2024-01-30' END || ' 23:00:00' AS end_time, site <> 's0' AS concurrent FROM m GROUP BY site")
def project_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the sites, and which of them meet the span of s0."""
    proj = _event_project(spark, sf_dir)
    met = proj.get_concurrent(spark, "s0").select("site", F.lit(True).alias("met"))
    rows = proj.spans(spark).join(met, "site", "left")
    return rows.select("site", "n_meas", F.substring("begin", 1, 19).alias("begin_time"), F.substring("end", 1, 19).alias("end_time"), F.coalesce("met", F.lit(False)).alias("concurrent"))


@query(f"{catalog._REMOTE} SELECT eval_idx, round(freq * 3600, 6) AS freq, round(period / 3600, 6) AS period, out_chan, in_chan, round(re, 6) AS re, round(im, 6) AS im FROM sol")
def project_impedance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project's stages: recordings to stored evaluations, these to a solution with a remote reference, and that read again."""
    proj = _event_project(spark, sf_dir)
    config = Configuration(
        time_readers=(TimeReaderNumpy(),), time_processors=(timeops.InterpolateNans(),), dec_setup=params.DecimationSetup(n_levels=1, per_level=5, min_samples=30),
        win_setup=params.WindowSetup(min_n_wins=1, win_sizes=(30,), olap_sizes=(10,)), solver=regression.SolverOLS(),
    )
    for site in proj.sites.values():
        for meas in site.measurements:
            pipeline.process_time_to_evals(spark, proj, config, site.name, meas)
    pipeline.process_evals_to_tf(spark, proj, config, tables.EVENT_FS, "s0", "s1", "s2")
    solved = pipeline.get_solution(spark, proj, config, tables.EVENT_FS, "s0")
    rows = solved.df.withColumn("freq", F.col("freq") * 3600).withColumn("period", F.col("period") / 3600)
    return rounded(rows, "freq", "period", "re", "im")


@query(f"{catalog._OLS} SELECT eval_idx, out_chan || in_chan AS component, round(re, 6) AS re, round(im, 6) AS im FROM sol")
def solution_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solution written and read, by component."""
    solved, path = catalog._solution(spark, sf_dir), _folder(spark, "solution") / "s.json"
    solved.write(str(path))
    again, out = Solution.read(spark, str(path)), None
    for key in again.tf.components():
        rows = again.component(key).select("eval_idx", F.lit(key).alias("component"), "re", "im")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, "re", "im")

