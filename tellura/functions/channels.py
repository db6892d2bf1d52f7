"""Channel names and types, and the text forms of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tellura.errors import ChannelNotFoundError, ParameterError

# fixed values: names by which the type of a channel is known
ELECTRIC = ("Ex", "Ey", "E1", "E2", "E3", "E4")
MAGNETIC = ("Hx", "Hy", "Hz", "Bx", "By", "Bz")
ELECTRIC_TYPE, MAGNETIC_TYPE = "electric", "magnetic"


def is_electric(chan: str) -> bool:
    return chan in ELECTRIC


def is_magnetic(chan: str) -> bool:
    return chan in MAGNETIC


def chan_type(chan: str) -> str:
    """Type of a channel by its name; other names need a type of their own."""
    if is_electric(chan):
        return ELECTRIC_TYPE
    if is_magnetic(chan):
        return MAGNETIC_TYPE
    raise ParameterError(f"the type of channel {chan!r} can't be told from its name")


def chan_type_column(chan: Column, given: Column | None = None) -> Column:
    """chan_type() of a column, ``given`` types first; null where neither tells."""
    by_name = F.when(chan.isin(*ELECTRIC), ELECTRIC_TYPE).when(chan.isin(*MAGNETIC), MAGNETIC_TYPE)
    return by_name if given is None else F.coalesce(given, by_name)


def check_chan(chan: str, chans: list[str] | tuple[str, ...]) -> None:
    if chan not in chans:
        raise ChannelNotFoundError(chan, chans)


def fs_to_string(fs: float) -> str:
    return f"{fs:.6f}".replace(".", "_")


def fs_to_string_column(fs: Column) -> Column:
    return F.replace(F.format_string("%.6f", fs), F.lit("."), F.lit("_"))


def array_to_string(values: list[float], sep: str = ", ", precision: int = 8, scientific: bool = False) -> str:
    return sep.join(f"{v:.{precision}{'e' if scientific else 'f'}}" for v in values)


def array_to_string_column(values: Column, sep: str = ", ", precision: int = 8) -> Column:
    return F.array_join(F.transform(values, lambda v: F.format_string(f"%.{precision}f", v.cast("double"))), sep)


def component_key(out_chan: str | Column, in_chan: str | Column) -> str | Column:
    return out_chan + in_chan if isinstance(out_chan, str) and isinstance(in_chan, str) else F.concat(out_chan, in_chan)
