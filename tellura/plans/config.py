"""Configuration of a processing run, with JSON round trip."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from tellura.functions.history import Process, from_dict
from tellura.operators import transfer
from tellura.operators.calibration import SensorCalibrator
from tellura.operators.decimation import Decimator
from tellura.operators.params import DecimationSetup, WindowSetup, WindowTarget
from tellura.operators.regression import SolverKernel
from tellura.operators.spectra import EvaluationFreqs, FourierTransform
from tellura.operators.timeops import InterpolateNans, RemoveMean
from tellura.sources.calibration import SensorCalibrationJSON
from tellura.sources.store import TimeReaderAscii, TimeReaderNumpy


@dataclass(frozen=True)
class Configuration:
    name: str = "default"
    time_readers: tuple[Process, ...] = (TimeReaderAscii(), TimeReaderNumpy())
    time_processors: tuple[Process, ...] = (InterpolateNans(), RemoveMean())
    dec_setup: DecimationSetup = field(default_factory=DecimationSetup)
    decimator: Decimator = field(default_factory=Decimator)
    win_setup: WindowSetup | WindowTarget = field(default_factory=WindowSetup)
    fourier: FourierTransform = field(default_factory=FourierTransform)
    spectra_processors: tuple[Process, ...] = ()
    evals: EvaluationFreqs = field(default_factory=EvaluationFreqs)
    calibration_readers: tuple[Process, ...] = (SensorCalibrationJSON(),)
    sensor_calibrator: SensorCalibrator = field(default_factory=SensorCalibrator)
    tf: transfer.TransferFunction = field(default_factory=transfer.ImpedanceTensor)
    solver: Process = field(default_factory=lambda: SolverKernel("TheilSen"))

    def to_json(self) -> str:
        return json.dumps({f.name: _pack(getattr(self, f.name)) for f in dataclasses.fields(self)}, indent=1)

    @staticmethod
    def from_json(text: str) -> "Configuration":
        return Configuration(**{k: _unpack(v) for k, v in json.loads(text).items()})


_SETUPS = {c.__name__: c for c in (DecimationSetup, WindowSetup, WindowTarget)}


def _pack(value: object) -> object:
    if isinstance(value, (list, tuple)):
        return [_pack(v) for v in value]
    if isinstance(value, (Process, transfer.TransferFunction)):
        return {"kind": "process" if isinstance(value, Process) else "tf", "value": value.to_dict()}
    if type(value).__name__ in _SETUPS:
        return {"kind": "setup", "value": {"name": type(value).__name__, **dataclasses.asdict(value)}}
    return value


def _unpack(value: object) -> object:
    if isinstance(value, list):
        return tuple(_unpack(v) for v in value)
    if not isinstance(value, dict):
        return value
    inner = dict(value["value"])
    if value["kind"] == "process":
        return from_dict(inner)
    if value["kind"] == "tf":
        return transfer.from_dict(inner)
    return _SETUPS[inner.pop("name")](**{k: tuple(v) if isinstance(v, list) else v for k, v in inner.items()})


def default_configuration() -> Configuration:
    return Configuration()
