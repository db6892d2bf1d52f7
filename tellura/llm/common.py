"""What the operators share: tables in the shared folder, word hashes, batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one step of a Python kernel takes at a time (a longer text is taken alone).
CHUNK_BYTES = 2_000_000
#: Distinct words whose hashes a Python worker remembers before it starts anew.
CACHE_WORDS = 250_000

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves, but only in local mode.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir.setdefault("dir", tempfile.mkdtemp(prefix="tellura-"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python kernels get no more than ``rows`` rows at once: texts and sets can be long."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def spare(taken: list[str], name: str) -> str:
    """``name`` with underscores before it until no column of ``taken`` has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


def schema_of(df: DataFrame, names: list[str], more: str) -> StructType:
    """The named columns of ``df``, and those that the DDL ``more`` gives."""
    return StructType([*[df.schema[c] for c in names], *StructType.fromDDL(more).fields])


def labelled(docs: DataFrame, labels: DataFrame, rows_of_label: int, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows of ``docs`` (_id, ...) with a label y of 0 or 1, ``rows_of_label`` of each at most, and the numbers of ids by label.

    The sample is drawn by a hash of the id. An id that is labelled 0 and 1
    counts as 1; of rows that share an id the least one serves; null ids and
    other labels are left out.
    """
    known = labels.where(quoted(label_col).isin(0, 1) & quoted(id_col).isNotNull())
    named = known.groupBy(quoted(id_col).alias("_id")).agg(F.max(quoted(label_col)).cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in named.groupBy("y").count().collect()}
    parts = [named.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(rows_of_label) for y in (0, 1)]
    drawn = F.broadcast(parts[0].unionByName(parts[1]))
    rest = [c for c in docs.columns if c != "_id"]
    rows = docs.join(drawn, "_id").groupBy("_id").agg(F.first("y").alias("y"), F.min(F.struct(*rest)).alias("_row"))
    return rows.select("y", *[F.col(f"_row.{c}").alias(c) for c in rest]), totals


def join_hot(rows: DataFrame, known: DataFrame, key: str, count: str, id_col: str) -> DataFrame:
    """``rows`` left-joined with ``known`` (a row for each ``key``, with the number of rows that have it in ``count``).

    Keys of more than a thousandth of the rows, fewer than 1,000, are
    broadcast; their rows and those of null keys are dealt by ``id_col``.
    """
    known = known.where(F.col(key).isNotNull())
    total = known.agg(F.sum(count)).first()[0] or 0
    known, hot = known.drop(count), known.where(F.col(count) > max(1000, total // 1000)).drop(count)
    names = [c for c in known.columns if c != key]
    hot = hot.select(F.col(key).alias("_hot"), F.struct(*names).alias("_of_hot"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    cold = F.when(F.col("_hot").isNull(), F.col(key))
    dealt = marked.withColumn("_cold", cold).withColumn("_salt", F.when(F.col("_cold").isNull(), F.xxhash64(id_col)).otherwise(F.lit(0).cast("long")))
    table = known.select(F.col(key).alias("_known"), F.lit(0).cast("long").alias("_at"), F.struct(*names).alias("_of"))
    joined = dealt.join(table, (F.col("_cold") == F.col("_known")) & (F.col("_salt") == F.col("_at")), "left")
    out = joined.withColumn("_of", F.coalesce("_of", "_of_hot"))
    return out.select(*rows.columns, *[F.col(f"_of.{c}").alias(c) for c in names])


def uniform(*parts: Column | str | int) -> Column:
    """A number strictly between 0 and 1 that the parts alone decide, the same in any engine.

    52 bits of the MD5 of the parts joined by ``/``; null parts read ``~``.
    """
    words = [F.coalesce(p.cast("string"), F.lit("~")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *words)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


class WordHashes(dict):
    """64-bit hashes of words as bytes, each computed once while it is remembered."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word, self.seed).to_bytes(8, "little")
        return value


def byte_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def chunks(texts: list, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` bytes each; no text is split."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def hash_words(words: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all documents in a row, and the number of words of each document."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer(b"".join(map(cache.__getitem__, chain.from_iterable(words))), np.uint64), counts


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def rolling(hashes: np.ndarray, size: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of each ``size`` consecutive values, order included; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Horner's rule by doubling: an array of hashes of 2^k values, joined as the bits of ``size`` say
    power, done, out = base | 1, 0, None
    block, width = hashes, 1
    while True:
        if size & width:
            part = block[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += width
        if width * 2 > size:
            return mix(out)
        block = block[: len(block) - width] * np.uint64(power) + block[width:]
        power = power * power % 2**64
        width *= 2


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
