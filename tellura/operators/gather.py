"""Windows that sites share, and their values gathered by role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.errors import SiteNotFoundError
from tellura.operators.params import DecimationParameters
from tellura.operators.spectra import SpectraData

META = "site string, meas string, level int, n_wins long, index_offset long"


def site_windows(metadata: DataFrame) -> DataFrame:
    """(site, level, global_win, meas) from ``metadata`` (META): all windows of a site, the first measurement by name where two hold one."""
    rows = metadata.where("n_wins > 0").withColumn("global_win", F.explode(F.sequence(F.col("index_offset"), F.col("index_offset") + F.col("n_wins") - 1)))
    return rows.groupBy("site", "level", "global_win").agg(F.min("meas").alias("meas"))


@dataclass(frozen=True)
class Selection:
    """``df``: (level, global_win, site, meas) of the windows that all ``sites`` hold; ``masks`` (eval_idx, global_win) leaves out some of a frequency."""

    df: DataFrame
    sites: tuple[str, ...]
    parameters: DecimationParameters
    masks: DataFrame | None = None

    def unmasked(self, rows: DataFrame) -> DataFrame:
        """``rows`` (eval_idx, global_win, ...) without the masked ones."""
        if self.masks is None:
            return rows
        return rows.join(self.masks.select("eval_idx", "global_win").distinct(), ["eval_idx", "global_win"], "left_anti")

    def n_wins(self) -> DataFrame:
        """(level, eval_idx, n_wins)"""
        n = self.df.where(F.col("site") == self.sites[0])
        return self.evals(n).groupBy("level", "eval_idx").agg(F.count("*").alias("n_wins"))

    def evals(self, rows: DataFrame | None = None) -> DataFrame:
        """Rows for each evaluation frequency of the level."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(self.parameters.per_level - 1)))
        every = (self.df if rows is None else rows).withColumn("freq_idx", spread).withColumn("eval_idx", F.col("level") * self.parameters.per_level + F.col("freq_idx"))
        return self.unmasked(every)

    def measurements(self) -> DataFrame:
        return self.df.select("site", "meas").distinct()

    def eval_freqs(self) -> list[float]:
        return [f for level in self.parameters.freqs for f in level]


@dataclass(frozen=True)
class Selector:
    """Windows of levels that all sites reach, held by all of them: one count over (level, window), not a join for each site."""

    def run(self, metadata: DataFrame, sites: list[str], parameters: DecimationParameters, masks: DataFrame | None = None) -> Selection:
        """``masks`` (level, global_win), or (eval_idx, global_win): windows to leave out, of a level or of one evaluation frequency."""
        names = sorted(set(sites))
        here = site_windows(metadata.where(F.col("site").isin(names)))
        n_levels = metadata.where(F.col("site").isin(names)).groupBy("site").agg((F.max("level") + 1).alias("n")).agg(F.min("n").alias("n"), F.count("*").alias("s")).first()
        if n_levels["s"] != len(names):
            raise SiteNotFoundError(f"not all of {names} have evaluations")
        held = here.where(F.col("level") < n_levels["n"])
        common = held.groupBy("level", "global_win").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("site", "meas"))).alias("by_site")).where(F.col("n") == len(names))
        if masks is not None and "eval_idx" not in masks.columns:
            common, masks = common.join(masks.select("level", "global_win").distinct(), ["level", "global_win"], "left_anti"), None
        return Selection(common.select("level", "global_win", F.explode("by_site").alias("site", "meas")), tuple(names), parameters, masks)


@dataclass(frozen=True)
class Roles:
    """Sites of the output, input and cross channels; the input's is the output's, the cross one the input's, if not given."""

    out_site: str
    in_site: str | None = None
    cross_site: str | None = None

    def sites(self) -> tuple[str, str, str]:
        in_site = self.in_site or self.out_site
        return self.out_site, in_site, self.cross_site or in_site


def _values(rows: DataFrame, roles: dict[str, tuple[str | None, tuple[str, ...]]]) -> DataFrame:
    """One row for each (eval_idx, global_win): struct columns out, in and cross with fields <chan>_re and <chan>_im."""
    sums, names = [], {}
    for role, (site, chans) in roles.items():
        for chan in chans:
            at = F.col("chan") == chan
            at = at & (F.col("site") == site) if site is not None else at
            for part in ("re", "im"):
                name = f"{role}_{chan}_{part}"
                sums.append(F.max(F.when(at, F.col(part))).alias(name))
                names.setdefault(role, []).append((name, f"{chan}_{part}"))
    wide = rows.groupBy("eval_idx", "global_win").agg(*sums)
    out = wide.select("eval_idx", "global_win", *[F.struct(*[F.col(n).alias(f) for n, f in fields]).alias(role) for role, fields in names.items()])
    return out.where(" and ".join(f"`{role}`.`{f}` is not null" for role, fields in names.items() for _, f in fields))


@dataclass(frozen=True)
class ProjectGather:
    """Values of the selected windows by role: one join with the selection, one grouped pass for all roles."""

    def run(self, selection: Selection, evals: SpectraData, tf, roles: Roles) -> DataFrame:
        out_site, in_site, cross_site = roles.sites()
        used = selection.df.select("site", "meas", "level", "global_win")
        rows = evals.long().join(used, ["site", "meas", "level", "global_win"])
        rows = rows.withColumn("eval_idx", F.col("level") * selection.parameters.per_level + F.col("freq_idx"))
        return _values(selection.unmasked(rows), {"out": (out_site, tf.out_chans), "in": (in_site, tf.in_chans), "cross": (cross_site, tf.cross_chans)})


@dataclass(frozen=True)
class QuickGather:
    """A single recording: no alignment, roles by channel."""

    def run(self, evals: SpectraData, parameters: DecimationParameters, tf) -> DataFrame:
        rows = evals.long().withColumn("eval_idx", F.col("level") * parameters.per_level + F.col("freq_idx"))
        return _values(rows, {"out": (None, tf.out_chans), "in": (None, tf.in_chans), "cross": (None, tf.cross_chans)})


def site_spans(recordings: DataFrame) -> DataFrame:
    """(site, begin, end, n_meas) from ``recordings`` (site, first_time, last_time, ...), a row for each measurement; a site without any has none."""
    return recordings.groupBy("site").agg(F.min("first_time").alias("begin"), F.max("last_time").alias("end"), F.count("*").alias("n_meas"))


def concurrent(recordings: DataFrame, site: str) -> DataFrame:
    """Other sites (site, begin, end) whose recordings meet those of ``site``, ends included."""
    spans = site_spans(recordings).drop("n_meas")
    own = spans.where(F.col("site") == site).select(F.col("begin").alias("_a"), F.col("end").alias("_b"))
    return spans.where(F.col("site") != site).join(F.broadcast(own), (F.col("begin") <= F.col("_b")) & (F.col("end") >= F.col("_a"))).select("site", "begin", "end")
