"""Spark data source ``tellura_npy``: arrays of (channels, samples) in npy files, a partition for each channel and range of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    def __init__(self, path: str, chan: str, row: int, first: int, last: int):
        self.path, self.chan, self.row, self.first, self.last = path, chan, row, first, last


class NpySource(DataSource):
    """Options: path, chans (comma separated), from_sample, to_sample (inclusive), rows (samples of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "tellura_npy"

    def schema(self) -> str:
        return "chan string, sample long, value double"

    def reader(self, schema: object) -> "NpyReader":
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.chans = options["chans"].split(",")
        self.first = int(options.get("from_sample", 0))
        self.last = int(options.get("to_sample", -1))
        self.rows = int(options.get("rows", 1 << 20))

    def partitions(self) -> list[Range]:
        shape = np.load(self.path, mmap_mode="r").shape
        n = shape[-1]
        last = n - 1 if self.last < 0 else min(self.last, n - 1)
        return [Range(self.path, c, i, a, min(a + self.rows - 1, last)) for i, c in enumerate(self.chans) for a in range(self.first, last + 1, self.rows)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        data = np.load(part.path, mmap_mode="r")
        row = data[part.row] if data.ndim == 2 else data
        for a in range(part.first, part.last + 1, 100_000):
            b = min(a + 100_000, part.last + 1)
            value = np.asarray(row[a:b], np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([part.chan] * len(value)), pa.array(np.arange(a, b)), pa.array(value)], ["chan", "sample", "value"])
