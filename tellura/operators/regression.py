"""Cross-powers, regression rows and solvers.

Ordinary least squares is solved from sums: the normal equations of a frequency
and an output are additive over windows, so tasks sum their rows and one small
system for each is solved. Robust solvers need all rows of a frequency and an
output together; those are one task's each.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellura.functions import solvers
from tellura.functions.frames import small
from tellura.functions.history import Process
from tellura.operators.params import DecimationParameters
from tellura.operators.transfer import Solution, TransferFunction

SOLVED = "eval_idx int, out_chan string, in_chan string, re double, im double"


def _power(a: str, b: str) -> tuple[Column, Column]:
    """Real and imaginary part of a times the conjugate of b."""
    ar, ai, br, bi = (F.col(f"{x}_{p}") for x in (a, b) for p in ("re", "im"))
    return ar * br + ai * bi, ai * br - ar * bi


def robust_scaled(value: str, *keys: str) -> Column:
    """``solvers.robust_scale`` of the rows of each group by ``keys``, as a column: many small groups need no task's call each."""
    q = F.percentile(value, [0.25, 0.5, 0.75]).over(Window.partitionBy(*keys))
    return (F.col(value) - q[1]) / F.when(q[2] > q[0], q[2] - q[0]).otherwise(1.0)


def cross_powers(gathered: DataFrame, tf: TransferFunction) -> DataFrame:
    """(eval_idx, global_win, cross_chan, out ARRAY<(chan, re, im)>, in ARRAY<(chan, re, im)>): powers with the conjugate cross channel."""
    def powers(role: str, chans: tuple[str, ...], cross: str) -> Column:
        parts = [F.struct(F.lit(c).alias("chan"), *[v.alias(p) for v, p in zip(_power(f"{role}.{c}", f"cross.{cross}"), ("re", "im"))]) for c in chans]
        return F.array(*parts)

    rows = [F.struct(F.lit(c).alias("cross_chan"), powers("out", tf.out_chans, c).alias("out"), powers("in", tf.in_chans, c).alias("in")) for c in tf.cross_chans]
    return gathered.select("eval_idx", "global_win", F.explode(F.array(*rows)).alias("r")).select("eval_idx", "global_win", "r.cross_chan", "r.out", "r.in")


def regression_rows(gathered: DataFrame, tf: TransferFunction) -> DataFrame:
    """(eval_idx, out_chan, global_win, cross_chan, part, y, x): a row for the real and one for the imaginary part.

    ``x`` holds (re, -im) of each input for the real part and (im, re) for the imaginary one.
    """
    powers = cross_powers(gathered, tf)
    re_x = F.flatten(F.transform("in", lambda i: F.array(i["re"], -i["im"])))
    im_x = F.flatten(F.transform("in", lambda i: F.array(i["im"], i["re"])))
    out = powers.select("eval_idx", "global_win", "cross_chan", F.explode("out").alias("o"), re_x.alias("re_x"), im_x.alias("im_x"))
    parts = F.array(F.struct(F.lit("re").alias("part"), F.col("o.re").alias("y"), F.col("re_x").alias("x")), F.struct(F.lit("im").alias("part"), F.col("o.im").alias("y"), F.col("im_x").alias("x")))
    return out.select("eval_idx", F.col("o.chan").alias("out_chan"), "global_win", "cross_chan", F.explode(parts).alias("p")).select("eval_idx", "out_chan", "global_win", "cross_chan", "p.part", "p.y", "p.x")


def _with_freqs(solved: DataFrame, parameters: DecimationParameters) -> DataFrame:
    freqs = parameters.to_dataframe(solved.sparkSession).select("eval_idx", "freq")
    joined = solved.join(small(freqs, parameters.n_levels * parameters.per_level), "eval_idx")
    return joined.select("eval_idx", "freq", (1 / F.col("freq")).alias("period"), "out_chan", "in_chan", "re", "im")


@dataclass(frozen=True)
class Solver(Process):
    def run(self, gathered: DataFrame, tf: TransferFunction, parameters: DecimationParameters) -> Solution:
        raise NotImplementedError


@dataclass(frozen=True)
class SolverOLS(Solver):
    """Complex least squares from sums over windows; fewer windows than inputs give NaN."""

    fit_intercept: bool = False

    def run(self, gathered: DataFrame, tf: TransferFunction, parameters: DecimationParameters) -> Solution:
        if self.fit_intercept:
            return SolverKernel("OLS", (("fit_intercept", True),)).run(gathered, tf, parameters)
        n = tf.n_in
        sums, names = [], []
        powers = cross_powers(gathered, tf)
        x = [(F.col("in")[i]["re"], F.col("in")[i]["im"]) for i in range(n)]
        for i in range(n):
            for j in range(i, n):  # conj(x_i) x_j
                names += [f"a{i}{j}re", f"a{i}{j}im"]
                sums += [F.sum(x[i][0] * x[j][0] + x[i][1] * x[j][1]), F.sum(x[i][0] * x[j][1] - x[i][1] * x[j][0])]
        for k in range(tf.n_out):
            y = F.col("out")[k]["re"], F.col("out")[k]["im"]
            for i in range(n):  # conj(x_i) y
                names += [f"b{k}{i}re", f"b{k}{i}im"]
                sums += [F.sum(x[i][0] * y[0] + x[i][1] * y[1]), F.sum(x[i][0] * y[1] - x[i][1] * y[0])]
        grouped = powers.groupBy("eval_idx").agg(F.count("*").alias("n"), *[s.alias(c) for s, c in zip(sums, names)])
        solved = grouped.mapInArrow(_normal_kernel(tf), SOLVED)
        return Solution(_with_freqs(solved, parameters), tf, (self.record(),))


def _normal_kernel(tf: TransferFunction):
    n = tf.n_in

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                a = np.zeros((n, n), complex)
                for i in range(n):
                    for j in range(i, n):
                        a[i, j] = complex(r[f"a{i}{j}re"], r[f"a{i}{j}im"])
                        a[j, i] = np.conj(a[i, j])
                scale = np.sqrt(np.abs(np.diag(a)).clip(1e-300))  # inputs of unit power keep the digits of near-collinear ones
                for k, out in enumerate(tf.out_chans):
                    b = np.array([complex(r[f"b{k}{i}re"], r[f"b{k}{i}im"]) for i in range(n)])
                    try:
                        z = np.linalg.solve(a / scale / scale[:, None], b / scale) / scale if r["n"] >= n else np.full(n, np.nan)
                    except np.linalg.LinAlgError:
                        z = np.full(n, np.nan)
                    rows += [(r["eval_idx"], out, c, float(np.real(v)), float(np.imag(v))) for c, v in zip(tf.in_chans, z)]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["eval_idx", "out_chan", "in_chan", "re", "im"])

    return run


@dataclass(frozen=True)
class SolverKernel(Solver):
    """A solver of functions.solvers by name, seeded by frequency and output; rows are sorted, so results don't depend on partitions."""

    kind: str = "OLS"
    options: tuple[tuple[str, object], ...] = ()
    seed: int = 0

    def run(self, gathered: DataFrame, tf: TransferFunction, parameters: DecimationParameters) -> Solution:
        solver, in_chans, seed = solvers.SOLVERS[self.kind](**dict(self.options)), tf.in_chans, self.seed

        def solve(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by([(c, "ascending") for c in ("global_win", "cross_chan", "part")])
            x = np.asarray(group.column("x").combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)
            own = zlib.crc32(f"{key[0].as_py()}/{key[1].as_py()}/{seed}".encode())
            c = solver.solve(x, np.asarray(group.column("y").combine_chunks(), np.float64), own)
            n = len(in_chans)
            return pa.table({
                "eval_idx": pa.array([key[0].as_py()] * n, pa.int32()), "out_chan": pa.array([key[1].as_py()] * n), "in_chan": pa.array(list(in_chans)),
                "re": pa.array(c[0::2]), "im": pa.array(c[1::2]),
            })

        rows = regression_rows(gathered, tf).withColumn("eval_idx", F.col("eval_idx").cast("int"))
        return Solution(_with_freqs(rows.groupBy("eval_idx", "out_chan").applyInArrow(solve, SOLVED), parameters), tf, (self.record(),))


def _kernel(kind: str):
    def make(seed: int = 0, **options: object) -> SolverKernel:
        return SolverKernel(kind, tuple(sorted(options.items())), seed)

    return make


SolverHuber, SolverTheilSen, SolverRANSAC, SolverWLS = (_kernel(k) for k in ("Huber", "TheilSen", "RANSAC", "WLS"))
