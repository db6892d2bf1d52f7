"""Time data in text files, one column for each channel; compressed files as Spark reads them.

Line numbers: lines are counted for each part of a file that the read splits off,
so each line's number is its place in its part plus the lines of the parts
before, by file name and start; the read itself deals large parts first.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.functions.frames import small


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) with the line numbers of the file, from 0."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    parts = rows.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("at")).collect()  # a row for each part of a file
    firsts, total = [], 0
    for r in sorted(parts, key=lambda r: (r["_file"], r["_start"])):
        firsts.append((r["_file"], r["_start"], total - r["at"]))
        total += r["n"]
    table = small(spark.createDataFrame(firsts, "_file string, _start long, _first long"), len(firsts))
    return rows.join(table, ["_file", "_start"]).select((F.col("_first") + F.col("_at")).alias("line"), F.col("value").alias("text"))


def read_ascii(spark: SparkSession, path: str, chans: list[str], delimiter: str | None = None, n_header: int = 0, from_sample: int = 0, to_sample: int | None = None) -> DataFrame:
    """(chan, sample, value): single precision as the files hold it."""
    lines = numbered_lines(spark, path).withColumn("sample", F.col("line") - n_header - from_sample).where(F.col("sample") >= 0)
    if to_sample is not None:
        lines = lines.where(F.col("sample") <= to_sample - from_sample)
    pattern = r"\s+" if delimiter is None else "\\Q" + delimiter + "\\E"
    fields = F.split(F.trim(F.translate("text", "\t", " ")) if delimiter is None else F.col("text"), pattern)
    rows = lines.where(F.trim("text") != "").select("sample", F.posexplode(fields).alias("i", "v"))
    name = F.element_at(F.lit(list(chans)), F.col("i") + 1)
    return rows.where(F.col("i") < len(chans)).select(name.alias("chan"), "sample", F.trim("v").cast("float").cast("double").alias("value"))


def write_parts(df: DataFrame, folders: dict[str, tuple[str, ...]], n_rows: int, block: int = 1 << 17) -> None:
    """Text parts, in the samples' order by name, in each folder: its channels side by side, six decimals, a line for each sample.

    One pass: tasks write the parts of their ranges of samples, so the folders are ones that all executors share.
    """

    def write(key: tuple, group: pa.Table) -> pa.Table:
        number = key[0].as_py()
        for folder, chans in folders.items():
            held = []
            for c in chans:
                own = group.filter(pc.equal(group.column("chan"), c))
                held.append((np.asarray(own.column("sample").combine_chunks()), np.asarray(own.column("value").combine_chunks(), np.float64)))
            samples = np.unique(np.concatenate([s for s, _ in held]))
            if not len(samples):
                continue
            values = np.full((len(samples), len(chans)), np.nan)
            for i, (s, v) in enumerate(held):
                values[np.searchsorted(samples, s), i] = v
            line = " ".join(["%.6f"] * len(chans)) + "\n"
            text = "".join([line % tuple(row) for row in values.tolist()])
            if not np.isfinite(values).all():
                text = text.replace("nan", "NaN").replace("inf", "Infinity")
            new = f"{folder}/.{uuid.uuid4().hex}"  # a task that is run again replaces its part
            with open(new, "w") as out:
                out.write(text)
            os.replace(new, f"{folder}/part-{number:08d}.txt")
        return pa.table({"n": [group.num_rows]})

    n_parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-n_rows // (1 << 20)))
    dealt = df.select("chan", F.floor(F.col("sample") / block).alias("block"), "sample", "value").repartition(n_parts, "block")
    dealt.groupBy("block").applyInArrow(write, "n long").agg(F.sum("n")).collect()
