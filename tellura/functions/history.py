"""Processes by name with JSON round trip, and records of what was done."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from datetime import datetime, timezone

_types: dict[str, type] = {}


@dataclass(frozen=True)
class Record:
    time_utc: str
    creator: str  # JSON
    messages: tuple[str, ...]
    record_type: str = "process"

    def as_row(self) -> tuple:
        return self.time_utc, self.creator, list(self.messages), self.record_type


def record(creator: dict, *messages: str, record_type: str = "process") -> Record:
    return Record(datetime.now(timezone.utc).isoformat(timespec="microseconds"), json.dumps(creator, default=str), tuple(messages), record_type)


@dataclass(frozen=True)
class Process:
    """A dataclass of parameters; subclasses are known by name."""

    def __init_subclass__(cls, **kwargs: object) -> None:
        super().__init_subclass__(**kwargs)
        _types[cls.__name__] = cls

    def parameters(self) -> dict:
        return {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}

    def to_dict(self) -> dict:
        return {"name": type(self).__name__} | {k: _plain(v) for k, v in self.parameters().items()}

    def record(self, *messages: str) -> Record:
        return record(self.to_dict(), *messages)


def _plain(value: object) -> object:
    if isinstance(value, Process):
        return value.to_dict()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return value


def _frozen(value: object) -> object:
    if isinstance(value, list):
        return tuple(_frozen(v) for v in value)
    return from_dict(value) if isinstance(value, dict) and value.get("name") in _types else value


def from_dict(values: dict) -> Process:
    """The process that ``to_dict()`` described."""
    rest = dict(values)
    cls = _types[rest.pop("name")]
    return cls(**{k: _frozen(v) for k, v in rest.items()})
