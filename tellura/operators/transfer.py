"""Transfer functions: which channels are explained by which, and what is derived from the solved components."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tellura.errors import ParameterError
from tellura.functions.channels import component_key
from tellura.functions.history import Record
from tellura.operators.spectra import unwrapped

_types: dict[str, type["TransferFunction"]] = {}


@dataclass(frozen=True)
class TransferFunction:
    out_chans: tuple[str, ...]
    in_chans: tuple[str, ...]
    cross_chans: tuple[str, ...] | None = None
    variation: str = "default"

    def __init_subclass__(cls, **kwargs: object) -> None:
        super().__init_subclass__(**kwargs)
        _types[cls.__name__] = cls

    def __post_init__(self) -> None:
        if self.cross_chans is None:
            object.__setattr__(self, "cross_chans", self.in_chans)
        if len(self.variation) > 16:
            raise ParameterError("a variation's name has 16 characters at most")

    @property
    def name(self) -> str:
        return type(self).__name__

    @property
    def n_out(self) -> int:
        return len(self.out_chans)

    @property
    def n_in(self) -> int:
        return len(self.in_chans)

    @property
    def n_cross(self) -> int:
        return len(self.cross_chans)

    @property
    def n_regressors(self) -> int:
        return self.n_in

    @property
    def n_eqns_per_output(self) -> int:
        return self.n_cross

    def components(self) -> list[str]:
        return [component_key(o, i) for o in self.out_chans for i in self.in_chans]

    def to_string(self) -> str:
        rows = (f"| {o} | = | " + " ".join(f"{component_key(o, i)}(f)" for i in self.in_chans) + " |" for o in self.out_chans)
        return "\n".join(rows) + f" with inputs {', '.join(self.in_chans)}"

    def to_dict(self) -> dict:
        return {"name": self.name, "variation": self.variation, "out_chans": list(self.out_chans), "in_chans": list(self.in_chans), "cross_chans": list(self.cross_chans)}


_types["TransferFunction"] = TransferFunction


def from_dict(values: dict) -> TransferFunction:
    rest = dict(values)
    cls = _types[rest.pop("name", "TransferFunction")]
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in rest.items()})


@dataclass(frozen=True)
class ImpedanceTensor(TransferFunction):
    out_chans: tuple[str, ...] = ("Ex", "Ey")
    in_chans: tuple[str, ...] = ("Hx", "Hy")

    @staticmethod
    def resistivity(solution: DataFrame) -> DataFrame:
        """Apparent resistivity 0.2 T |Z|^2 of each component."""
        return solution.withColumn("resistivity", 0.2 * F.col("period") * (F.col("re") ** 2 + F.col("im") ** 2))

    @staticmethod
    def phase(solution: DataFrame) -> DataFrame:
        """Phase in degrees, unwrapped over frequency; those of ExHx and ExHy modulo 360, less 180."""
        keys = [c for c in ("site", "out_chan", "in_chan") if c in solution.columns]
        rows = solution.withColumn("_phs", F.atan2("im", "re"))
        rows = rows.withColumn("_deg", F.degrees(unwrapped("_phs", Window.partitionBy(*keys).orderBy("eval_idx"))))
        turned = (F.col("out_chan") == "Ex") & F.col("in_chan").isin("Hx", "Hy")
        return rows.withColumn("phase", F.when(turned, F.pmod("_deg", F.lit(360.0)) - 180).otherwise(F.col("_deg"))).drop("_phs", "_deg")


def _arctan_ratio(y: Column, x: Column) -> Column:
    """Degrees of arctan(y / x): 90 with the sign of y over zero, NaN for 0 / 0."""
    return F.when(x != 0, F.degrees(F.atan(y / F.when(x != 0, x)))).when(y > 0, 90.0).when(y < 0, -90.0).otherwise(float("nan"))


@dataclass(frozen=True)
class Tipper(TransferFunction):
    out_chans: tuple[str, ...] = ("Hz",)
    in_chans: tuple[str, ...] = ("Hx", "Hy")

    @staticmethod
    def arrows(solution: DataFrame) -> DataFrame:
        """length (of the real parts), real_angle and imag_angle in degrees, by frequency."""
        pick = lambda chan, part: F.max(F.when(F.col("in_chan") == chan, F.col(part)))
        wide = solution.where(F.col("out_chan") == "Hz").groupBy("eval_idx", "freq", "period").agg(*[pick(c, p).alias(f"{c}_{p}") for c in ("Hx", "Hy") for p in ("re", "im")])
        return wide.select("eval_idx", "freq", "period", F.hypot("Hx_re", "Hy_re").alias("length"), _arctan_ratio(F.col("Hy_re"), F.col("Hx_re")).alias("real_angle"), _arctan_ratio(F.col("Hy_im"), F.col("Hx_im")).alias("imag_angle"))


@dataclass(frozen=True)
class Solution:
    """``df``: (eval_idx, freq, period, out_chan, in_chan, re, im)."""

    df: DataFrame
    tf: TransferFunction
    history: tuple = field(default_factory=tuple)

    def component(self, key: str) -> DataFrame:
        if key not in self.tf.components():
            raise ParameterError(f"{key} is not among {self.tf.components()}")
        return self.df.where(F.concat("out_chan", "in_chan") == key).select("eval_idx", "freq", "period", "re", "im")

    def tensor(self, eval_idx: int) -> list[list[complex]]:
        rows = {(r["out_chan"], r["in_chan"]): complex(r["re"], r["im"]) for r in self.df.where(F.col("eval_idx") == eval_idx).collect()}
        return [[rows.get((o, i), complex(math.nan, math.nan)) for i in self.tf.in_chans] for o in self.tf.out_chans]

    def write(self, path: str) -> None:
        """One JSON line for each component, with the transfer function and the history beside them."""
        told = json.dumps([asdict(r) for r in self.history])
        described = self.df.withColumn("tf", F.lit(json.dumps(self.tf.to_dict()))).withColumn("history", F.lit(told))
        described.coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "Solution":
        rows = spark.read.schema("eval_idx int, freq double, period double, out_chan string, in_chan string, re double, im double, tf string, history string").json(path)
        first = rows.select("tf", "history").first()
        history = tuple(Record(**{**r, "messages": tuple(r["messages"])}) for r in json.loads(first["history"] or "[]"))
        return Solution(rows.drop("tf", "history"), from_dict(json.loads(first["tf"])), history)
