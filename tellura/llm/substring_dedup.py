"""Substring dedup over a log-structured fingerprint index.

Every window of ``size`` words has one fingerprint: the least hash of the
n-grams inside it, so that equal windows have equal fingerprints and
neighbouring windows mostly share theirs. The fingerprints of a batch of
documents are written as a sorted run that never changes, in buckets of one
file each. A new batch is merge-joined with the runs before it, bucket by
bucket, without a shuffle; runs are compacted when there are many.
Fingerprints that occur in two texts, or twice in one, point to windows, and
these are verified by 128-bit hashes of all their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellura.llm.common import WordHashes, as_long, byte_texts, chunks, fresh_path, hash_words, join_hot, materialise, mix, quoted, remove, rolling, schema_of, small_batches

#: Runs that are kept side by side before they are merged into one.
FAN_IN = 2
#: Batches in which a table is added to a new index; with FAN_IN runs side by side, the third is compacted with those before it.
BATCHES = 4


def gram_words(size: int) -> int:
    """Words of the n-grams among which a window's fingerprint is chosen."""
    return max(1, size // 4)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value of each ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        left, right = at[: len(at) - span], at[span:]
        at = np.where(values[left] <= values[right], left, right)
        span *= 2
    left, right = at[:n], at[width - span : width - span + n]
    return np.where(values[left] <= values[right], left, right)


def windows(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one document, and positions and hashes of their fingerprints."""
    doc = np.repeat(np.arange(len(counts)), counts)
    gram = gram_words(size)
    grams = rolling(hashes, gram)
    at = _least(grams, size - gram + 1)
    start = np.flatnonzero(doc[: len(at)] == doc[size - 1 :]) if len(at) else np.empty(0, np.int64)
    return start, at[start], grams[at[start]]


def _text_hash(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"")


def _longs(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _twice(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, owner) pairs as rows (key, owner tag): a pair that occurs again also has the tag's complement."""
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    again = np.zeros(len(keys), bool)
    again[1:] = (keys[1:] == keys[:-1]) & (owners[1:] == owners[:-1])
    first_again = again.copy()
    first_again[1:] &= ~again[:-1]
    return np.concatenate([keys[~again], keys[first_again]]), np.concatenate([owners[~again], ~owners[first_again]])


def _fingerprint_kernel(size: int, batches: int):
    """Rows (batch, print, text): the fingerprints of each text; one that a text holds twice also has the complement of its hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for part in parts:
            texts = list(dict.fromkeys(t for t in byte_texts(part.column("_text")) if t))
            hashed = [_text_hash(t) for t in texts]
            for a, b in chunks(texts):
                hashes, counts = hash_words([t.split() for t in texts[a:b]], cache)
                _, at, prints = windows(hashes, counts, size)
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]  # positions never go back
                doc = np.repeat(np.arange(len(counts)), counts)[at[new]]
                keys, owners = _twice(prints[new], _longs(hashed[a:b])[doc])
                unsigned = owners.view(np.uint64)
                number = np.minimum(unsigned, ~unsigned) % np.uint64(batches)  # the same for a hash and its complement
                yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), pa.array(as_long(keys)), pa.array(owners)], ["batch", "print", "text"])

    return run


def fingerprints(docs: DataFrame, size: int, text_col: str = "text", batches: int = 1) -> DataFrame:
    """Rows (batch, print, text); a text and its copies are in one batch."""
    return docs.select(quoted(text_col).alias("_text")).mapInArrow(_fingerprint_kernel(size, batches), "batch int, print long, text long")


class FingerprintIndex:
    """Sorted immutable runs (print, text, many) in the shared folder.

    ``text`` is one text that holds the fingerprint, ``many`` whether there is
    another place that does. A run is a table in ``buckets`` buckets by
    fingerprint, each one sorted file, so that runs are joined and compacted
    bucket by bucket.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in, self.runs, self.compactions = spark, fan_in, [], 0
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, run: DataFrame) -> str:
        """The name of the run's table; ``run`` is hash-partitioned by fingerprint into ``buckets`` parts."""
        name, path = f"tellura_run_{uuid.uuid4().hex}", fresh_path(self.spark, "run")
        run.write.bucketBy(self.buckets, "print").sortBy("print").option("path", path).format("parquet").saveAsTable(name)
        self.runs.append((name, path))
        return name

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def joined(self, new: str, old: str) -> DataFrame:
        """The merge join of two runs: (print) of the new one that the old one, or both together, hold in two places."""
        run = self.spark.table(new).hint("merge")
        known = self.spark.table(old).select("print", F.col("text").alias("old_text"), F.col("many").alias("old_many"))
        return run.join(known, "print").where("old_many or old_text <> text").select("print")

    def add(self, prints: DataFrame) -> DataFrame:
        """Add a batch of fingerprints() as a run; returns (print) of the batch that occur elsewhere, in it or before it."""
        placed = prints.repartition(self.buckets, "print").groupBy("print").agg(F.min("text").alias("text"), F.max("text").alias("other"))
        earlier = list(self.runs)
        new = self._write(placed.select("print", "text", (F.col("text") != F.col("other")).alias("many")))
        hits = self.spark.table(new).where("many").select("print")
        for old, _ in earlier:
            hits = hits.unionByName(self.joined(new, old))
        hits = materialise(hits.distinct(), "hits")
        if len(self.runs) > self.fan_in:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one, two at a time, bucket by bucket."""
        while len(self.runs) > 1:
            (one, _), (two, _) = old = self.runs[:2]
            a = self.spark.table(one).hint("merge")
            b = self.spark.table(two).select("print", F.col("text").alias("text_b"), F.col("many").alias("many_b"))
            both = a.join(b, "print", "full").select(
                "print", F.coalesce(F.least("text", "text_b"), "text", "text_b").alias("text"),
                (F.coalesce("many", F.lit(False)) | F.coalesce("many_b", F.lit(False)) | F.coalesce(F.col("text") != F.col("text_b"), F.lit(False))).alias("many"),
            )
            self._write(both)
            self.runs = [*self.runs[2:-1], self.runs[-1]]
            self._drop(old)
            self.compactions += 1

    def drop(self) -> None:
        self._drop(self.runs)
        self.runs = []


def _pack_kernel(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for part in parts:
        texts = byte_texts(part.column("_text"))
        packed = [press.compress(t or b"") for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(_longs([_text_hash(t) for t in texts])), pa.array(packed, pa.binary())], ["text", "packed"])


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan_kernel(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and digest of the whole text; the packed text goes on only where it holds repeated fingerprints."""
    press = zstandard.ZstdDecompressor()
    for part in parts:
        packed, hits = part.column("packed").to_pylist(), part.column("hits")
        words = [press.decompress(p).split() for p in packed]
        maybe = np.asarray(hits.is_valid())
        arrays = [
            part.column("text"), part.column("copies"), pa.array([len(w) for w in words], pa.int64()), pa.array([_digest(w) for w in words]),
            pa.array([p if m else None for p, m in zip(packed, maybe)], pa.binary()), hits,
        ]
        yield pa.RecordBatch.from_arrays(arrays, ["text", "copies", "n_words", "digest", "packed", "hits"])


_SALT = np.uint64(0x2545F4914F6CDD1D)


def _tagged(one: np.ndarray, two: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Distinct rows (one, two, text), with the complement of ``text`` where a text repeats a window."""
    order = np.lexsort((two, one, text))
    one, two, text = one[order], two[order], text[order]
    again = np.zeros(len(one), bool)
    again[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (text[1:] == text[:-1])
    second = again.copy()
    second[1:] &= ~again[:-1]
    return [np.concatenate([x[~again], x[second]]) for x in (one, two)] + [np.concatenate([text[~again], ~text[second]])]


def _window_kernel(size: int, tagged: bool):
    """Rows (one, two, text, start) of the windows whose fingerprint is among the text's hits, or _tagged() ones."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, press = WordHashes(), zstandard.ZstdDecompressor()
        for part in parts:
            texts = [press.decompress(p) for p in part.column("packed").to_pylist()]
            owner = np.asarray(part.column("text"))
            hits = part.column("hits")
            for a, b in chunks(texts):
                hashes, counts = hash_words([t.split() for t in texts[a:b]], cache)
                start, _, prints = windows(hashes, counts, size)
                begins = np.cumsum(counts) - counts
                doc = np.repeat(np.arange(len(counts)), counts)[start]
                keep = np.isin(prints.view(np.int64), np.asarray(hits.slice(a, b - a).flatten()))
                start, doc = start[keep], doc[keep]
                one, two = rolling(hashes, size), rolling(mix(hashes ^ _SALT), size, base=0xD1342543DE82EF95)
                keys = as_long(one[start]), as_long(two[start]), owner[a:b][doc]
                arrays = _tagged(*keys) if tagged else [*keys, (start - begins[doc]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["one", "two", "text", "start"][: len(arrays)])

    return run


def covered(n_words: int, starts: np.ndarray, size: int) -> np.ndarray:
    edges = np.zeros(n_words + 1, np.int64)
    edges[starts] += 1
    edges[starts + size] -= 1
    return np.cumsum(edges[:-1]) > 0


def _cut_kernel(size: int):
    """n_removed, digest and the text left, for texts with the starts of their repeated windows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for part in parts:
            gone, digest, left = [], [], []
            for packed, starts in zip(part.column("packed").to_pylist(), part.column("starts")):
                words = press.decompress(packed).split()
                at = np.unique(np.asarray(starts.values)) if starts.is_valid else np.empty(0, np.int64)
                out = covered(len(words), at, size)
                kept = [w for w, o in zip(words, out.tolist()) if not o]
                gone.append(len(words) - len(kept))
                digest.append(_digest(kept))
                left.append(b" ".join(kept))
            arrays = [part.column("text"), part.column("n_words"), pa.array(gone, pa.int64()), pa.array(digest), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["text", "n_words", "n_removed", "digest", "left"])

    return run


def judge_texts(docs: DataFrame, size: int, text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """A row (text, copies, n_words, n_removed, digest, left) for each different text.

    ``text`` is the 64-bit hash of the text, which ``copies`` rows have, ``left`` its words without those
    in repeated windows, joined by spaces (null where nothing is removed, as
    the text stands then), ``digest`` their SHA-256.
    """
    spark = docs.sparkSession
    small_batches(spark, 1000)
    index = FingerprintIndex(spark)
    path = fresh_path(spark, "prints")
    fingerprints(docs, size, text_col, batches).write.partitionBy("batch").parquet(path)
    prints = spark.read.schema("print long, text long, batch int").parquet(path)
    hits = None
    for b in range(batches):
        found = index.add(prints.where(F.col("batch") == b).select("print", "text"))
        hits = found if hits is None else hits.unionByName(found)
    hits = materialise(hits.distinct(), "hits")
    index.drop()
    of_text = prints.join(hits, "print").groupBy("text").agg(F.collect_set("print").alias("hits"))
    packed = docs.select(quoted(text_col).alias("_text")).mapInArrow(_pack_kernel, "text long, packed binary")
    texts = packed.groupBy("text").agg(F.count("*").alias("copies"), F.first("packed").alias("packed"))
    scanned = texts.join(of_text, "text", "left").mapInArrow(_scan_kernel, "text long, copies long, n_words long, digest string, packed binary, hits array<bigint>")
    scanned = materialise(scanned, "texts")
    maybe = scanned.where("hits is not null").select("text", "copies", "n_words", "packed", "hits")
    keys = "one long, two long, text long"
    tagged = maybe.select("text", "packed", "hits").mapInArrow(_window_kernel(size, True), keys)
    repeated = tagged.groupBy("one", "two").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("one", "two")
    repeated = materialise(repeated, "repeated")
    single = maybe.where("copies = 1")
    rows = single.select("text", "packed", "hits").mapInArrow(_window_kernel(size, False), f"{keys}, start int")
    starts = rows.join(repeated, ["one", "two"]).groupBy("text").agg(F.collect_list("start").alias("starts"))
    cut = single.select("text", "n_words", "packed").join(starts, "text", "left").mapInArrow(_cut_kernel(size), "text long, n_words long, n_removed long, digest string, left string").withColumn("copies", F.lit(1).cast("long"))
    all_gone = (F.col("copies") > 1) & (F.col("n_words") >= size)
    plain = scanned.where("copies > 1 or hits is null").select(
        "text", "copies", "n_words", F.when(all_gone, F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(all_gone, hashlib.sha256(b"").hexdigest()).otherwise(F.col("digest")).alias("digest"), F.when(all_gone, "").alias("left"),
    )
    return plain.unionByName(cut.withColumn("left", F.when(F.col("n_removed") > 0, F.col("left"))))


def _keyed_kernel(name: str):
    """``batches``, the last column of which is a text, with the text's hash, as ``name``, in its place."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            hashed = pa.array(_longs([_text_hash(t) for t in byte_texts(part.column(part.num_columns - 1))]))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], hashed], [*part.schema.names[:-1], name])

    return run


def removed_words(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, n_removed and kept_sha256 of each row.

    A word goes if a window of ``size`` words that covers it also starts
    anywhere else, in the same text or in another row; windows are judged on
    the input. Null and empty texts have no words. Of rows with equal texts of
    at least ``size`` words nothing is left. Rows that repeat an id stay.
    Texts are told apart by a 64-bit hash. Other columns play no part; an
    empty table gives an empty one.
    """
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    keyed = rows.mapInArrow(_keyed_kernel("_key"), schema_of(rows, ["_id"], "_key long"))
    judged = materialise(judge_texts(docs, size, text_col).drop("left"), "judged").withColumnRenamed("text", "_key")
    found = join_hot(keyed, judged, "_key", "copies", "_id")
    return found.select(F.col("_id").alias(id_col), "n_words", "n_removed", F.col("digest").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, size: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` without the words of repeated windows.

    A changed text has its words joined by spaces, and rows left without any of
    their words go, as rows with equal texts of at least ``size`` words do; null,
    empty and short texts stay as they are. Rows that repeat stay where their
    text does. Columns keep their values, whatever their names; an empty table
    gives an empty one.
    """
    judged = materialise(judge_texts(docs, size, text_col).where("n_removed > 0").select("text", "copies", "n_words", "n_removed", "left"), "judged")
    names = docs.columns
    row = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(text_col).alias("words"))
    keyed = row.mapInArrow(_keyed_kernel("key"), schema_of(row, ["row"], "key long")).withColumn("spread", F.xxhash64("key", *[F.col("row")[c] for c in names if "map<" not in docs.schema[c].dataType.simpleString()]))
    cut = join_hot(keyed, judged.withColumnRenamed("text", "key"), "key", "copies", "spread").where("n_removed is null or n_removed < n_words")
    return cut.select(*[F.coalesce("left", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
