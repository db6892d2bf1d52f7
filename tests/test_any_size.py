"""What is done differently with large inputs gives the same results."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tellura.functions import kernels, solvers
from tellura.operators import regression, timeops
from tellura.operators.timeops import Recording
from tellura.plans import catalog, catalog_files, tables
from tellura.sources.ascii import numbered_lines, write_parts


def test_narrow_notch_by_blocks(spark, monkeypatch):
    n, fs = 100_000, 500.0
    x = np.random.default_rng(1).normal(size=n)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "sample long, value double")
    df = rows.select(F.lit("s").alias("site"), F.lit("m").alias("meas"), F.lit(0).alias("level"), F.lit("Hx").alias("chan"), "sample", "value")
    data = timeops.TimeData(df, (Recording("s", "m", fs, n, "2020-01-01 00:00:00", ("Hx",)),))
    monkeypatch.setattr(timeops, "BLOCK", 4096)
    got = timeops.Notch(notch=50.0, band=2.0, whole=1000).run(data).df.orderBy("sample").toPandas()["value"].to_numpy()
    want = kernels.zero_phase(kernels.butterworth(10, "bandstop", [49.0, 51.0], fs), x)
    assert len(got) == n and np.abs(got - want).max() < 1e-6


def test_theil_sen_draws_without_repeats():
    rng = np.random.default_rng(2)
    x, n = rng.normal(size=(30_000, 2)), 30_000
    y = x @ [2.0, -1.0] + rng.normal(size=n)
    solver = solvers.TheilSen(max_subpopulation=20, n_subsamples=(n - 0.5) / n)
    assert np.allclose(solver._solve(x, y, np.random.default_rng(0)), solvers.least_squares(x, y), atol=1e-4)


def test_theil_sen_withstands_outliers():
    """A fifth of 15,000 rows is off: least squares goes astray, minimal subsets and their median do not."""
    rng = np.random.default_rng(3)
    x, want = rng.normal(size=(15_000, 4)), np.array([2.0, -1.0, 0.5, 3.0])
    y = x @ want + 0.1 * rng.normal(size=15_000)
    y[:3000] += 40 * x[:3000, 0]
    assert np.abs(solvers.least_squares(x, y) - want).max() > 5
    assert np.abs(solvers.TheilSen().solve(x, y) - want).max() < 0.3


def test_theil_sen_takes_all_subsets_of_few_rows():
    x = np.arange(1.0, 6.0)[:, None]
    y = 2 * x[:, 0] + np.array([0.0, 0.0, 0.0, 0.0, 30.0])
    assert np.allclose(solvers.TheilSen().solve(x, y), 2.0)


def test_lttb_by_parts(spark):
    """Corners of the buckets' parts lead to the points that the whole channel does, whatever the number of samples."""
    rng = np.random.default_rng(5)
    schema = "site string, meas string, level int, chan string, sample long, value double"
    for n, points in ((1000, 50), (997, 100), (5003, 333), (40, 39), (30, 30), (20, 40)):
        x = {"Ex": rng.normal(size=n).cumsum(), "Hx": rng.normal(size=n), "Hy": np.round(rng.normal(size=n), 1)}
        df = spark.createDataFrame([("s", "m", 0, c, i + 7, float(v)) for c, y in x.items() for i, v in enumerate(y)], schema)
        got = timeops.lttb(df, points, part=64).collect()
        for c in ("Ex", "Hx"):
            want = kernels.lttb(np.arange(n, dtype=float) + 7, x[c], points)
            assert sorted(r["sample"] - 7 for r in got if r["chan"] == c) == want.tolist(), (n, points, c)
        assert sum(r["chan"] == "Hy" for r in got) == min(n, points)


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    """Spark reads large files first, and small parts of files together; the numbers follow the names and places."""
    bounds = [0, 10, 5_000, 5_003, 9_000, 9_001]
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        (tmp_path / f"part-{i:05d}.txt").write_text("".join(f"{n}\n" for n in range(a, b)))
    (tmp_path / "one.txt").write_text("".join(f"{n}\n" for n in range(9_000)))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for name, n in (("part-*", 9_001), ("one.txt", 9_000)):
            for size in kept["spark.sql.files.maxPartitionBytes"], "4k":
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "1k")
                got = numbered_lines(spark, str(tmp_path / name)).collect()
                assert len(got) == n and all(str(r["line"]) == r["text"] for r in got), (name, size)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_rows_of_a_task_stay_bounded_when_gaps_are_filled(spark, monkeypatch):
    """Twice the rows are twice the tasks after the shuffle; gaps longer than blocks and at the ends are filled from other blocks."""
    n, rng = 3000, np.random.default_rng(6)
    x = rng.normal(size=n)
    x[rng.random(n) < 0.2] = np.nan
    x[:70], x[500:900], x[-200:] = np.nan, np.nan, np.nan
    rows = [("s", "m", 0, "Hx", i, float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "site string, meas string, level int, chan string, sample long, value double")
    monkeypatch.setattr(timeops, "TASK_ROWS", 100, raising=False)
    known = np.flatnonzero(~np.isnan(x))
    want = np.interp(np.arange(n), known, x[known])
    for share in (1, 2):
        m = n // share
        data = timeops.TimeData(df.where(f"sample < {m}"), (Recording("s", "m", 1.0, m, "2020-01-01 00:00:00", ("Hx",)),))
        done = timeops.InterpolateNans(block=50).run(data)
        plan = done.df._jdf.queryExecution().executedPlan().toString()
        assert f", {m // 100}), REPARTITION_BY_NUM" in plan
        assert "Window" not in plan.split("REPARTITION_BY_NUM")[0]
        if share == 1:
            got = done.df.orderBy("sample").toPandas()["value"].to_numpy()
            assert len(got) == n and np.abs(got - want).max() < 1e-12


def test_shift_by_blocks(spark, monkeypatch):
    """No sample is summed in a table of all samples; pairs over the blocks' edges count, those over a hole do not."""
    n = 1000
    x = np.random.default_rng(7).normal(size=n)
    held = [i for i in range(n) if i != 450]
    df = spark.createDataFrame([("s", "m", 0, "Hx", i, float(x[i])) for i in held], "site string, meas string, level int, chan string, sample long, value double")
    monkeypatch.setattr(timeops, "BLOCK", 64)
    done = timeops.ShiftTimestamps(0.25).run(timeops.TimeData(df, (Recording("s", "m", 1.0, n, "2020-01-01 00:00:00", ("Hx",)),)))
    got = {r["sample"]: r["value"] for r in done.df.collect()}
    assert sorted(got) == [i for i in range(n - 1) if i not in (449, 450)]
    assert all(abs(v - (0.75 * x[i] + 0.25 * x[i + 1])) < 1e-12 for i, v in got.items())
    assert "Aggregate" not in done.df._jdf.queryExecution().executedPlan().toString()


def test_decimation_by_blocks(spark, monkeypatch):
    """Recordings of millions of samples are not one task's; blocks give what the whole channel does."""
    n = 20_000
    x = np.random.default_rng(8).normal(size=n)
    df = spark.createDataFrame([("s", "m", 0, "Hx", i, float(v)) for i, v in enumerate(x)], "site string, meas string, level int, chan string, sample long, value double")
    plan = timeops.Decimate(3).run(timeops.TimeData(df, (Recording("s", "m", 1.0, 9_000_000, "2020-01-01 00:00:00", ("Hx",)),))).df._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan
    monkeypatch.setattr(timeops, "BLOCK", 1024)
    got = timeops.Decimate(6, whole=1000).run(timeops.TimeData(df, (Recording("s", "m", 1.0, n, "2020-01-01 00:00:00", ("Hx",)),))).df.orderBy("sample").toPandas()["value"].to_numpy()
    want = kernels.decimate_step(kernels.decimate_step(x, 2), 3)
    assert len(got) == len(want) and min(np.abs(got - w).max() for w in (want, kernels.decimate_step(kernels.decimate_step(x, 3), 2))) < 1e-9


def test_robust_scale_of_many_groups(spark):
    """As the solvers scale residuals, without a call of Python for each group."""
    rng = np.random.default_rng(9)
    held = {k: rng.normal(size=k % 9 + 1).round(1) for k in range(60)} | {60: np.ones(5)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in held.items() for i, v in enumerate(x)], "k long, i long, value double")
    got = {(r["k"], r["i"]): r["scaled"] for r in df.select("k", "i", regression.robust_scaled("value", "k").alias("scaled")).collect()}
    for k, x in held.items():
        assert np.allclose([got[k, i] for i in range(len(x))], solvers.robust_scale(x), rtol=1e-12, atol=1e-12), k
    plan = catalog_files.robust_scale(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "InArrow" not in plan


def test_text_parts_of_all_channels_in_one_pass(spark, tmp_path):
    """A part of each folder for each range of samples; holes and gaps keep to their lines; each row is computed once."""
    n, seen = 1000, spark.sparkContext.accumulator(0)
    rows = [("s", "m", 0, c, i, float("nan") if i == 7 else i + k / 8) for k, c in enumerate(("Ex", "Hx")) for i in range(n) if (c, i) != ("Hx", 500)]

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "site string, meas string, level int, chan string, sample long, value double")
    df = df.mapInArrow(count, df.schema)
    folders = {str(tmp_path / name): chans for name, chans in (("Ex", ("Ex",)), ("Hx", ("Hx",)), ("both", ("Ex", "Hx")))}
    for f in folders:
        (tmp_path / f).mkdir()
    write_parts(df, folders, len(rows), block=64)
    assert seen.value == len(rows)
    text = {name: [r["text"] for r in numbered_lines(spark, str(tmp_path / name)).orderBy("line").collect()] for name in ("Ex", "Hx", "both")}
    assert text["Ex"] == ["NaN" if i == 7 else f"{i:.6f}" for i in range(n)]
    assert text["Hx"] == ["NaN" if i == 7 else f"{i + 0.125:.6f}" for i in range(n) if i != 500]
    assert text["both"][7:9] == ["NaN NaN", "8.000000 8.125000"] and text["both"][500] == "500.000000 NaN" and len(text["both"]) == n


def test_lines_are_dealt_by_order_before_their_means(spark, monkeypatch):
    """No task holds an entry for each order of a split of lineitem: twice the rows are twice the tasks, with the orders' in the same ones."""
    sf = "/root/testdata/sf0.001"
    counts = [duckdb.sql(f"SELECT count(*) FROM '{sf}/{t}.parquet'").fetchall()[0][0] for t in ("orders", "lineitem")]
    for rows in (1000, 500):
        monkeypatch.setattr(tables, "TASK_ROWS", rows, raising=False)
        data = tables.line(spark, sf)
        plan = data.df._jdf.queryExecution().executedPlan().toString()
        n_parts = -(-sum(counts) // rows)
        dealt = [next((x for x in plan.split("Exchange ") if x.startswith(f"hashpartitioning({key}")), "") for key in ("o_orderkey", "l_orderkey")]
        assert all(f", {n_parts}), REPARTITION_BY_NUM" in x for x in dealt)
        assert "FileScan" in dealt[1] and "Aggregate" not in dealt[1]
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.sql(f"WITH {catalog._LINE} SELECT chan, sample, value FROM s").fetchall()
    got = {(r["chan"], r["sample"]): r["value"] for r in data.df.collect()}
    assert len(got) == len(want) == 5 * counts[0]
    assert all(np.isnan(got[c, i]) if v is None else abs(got[c, i] - v) < 1e-9 for c, i, v in want)
