"""Quality rules: counts of a text, and lines that too many documents of a host share.

Lines are normalised (A-Z in lower case, runs of white space one space) and
hashed; the distinct documents of each host that hold a line are counted, and
a document is an id with a text. Lines above the limit are removed; a document
of which too few words remain is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import WordHashes, byte_texts, chunks, hash_words, materialise, quoted, rolling, schema_of

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class LineLimits:
    """A line goes if more than ``min_docs`` documents of its host hold it, and more than ``share`` of them."""

    min_docs: int = 20
    share: float = 0.002
    #: Per cent of its words that a document must keep.
    keep_percent: int = 30


def _base_counts(texts: list[bytes], cache: WordHashes) -> dict[str, list[int]]:
    words = [t.split() for t in texts]
    hashes, counts = hash_words(words, cache)
    return {
        "n_words": counts.tolist(),
        "word_chars": [len(t.decode("utf-8", "replace")) - (len(t) - len(t.translate(None, SPACES))) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(held) - len(set(held)) for held in ([x for x in t.split(b"\n") if x.strip(SPACES)] for t in texts)],
        "n_repeat_words": repeated_words(hashes, counts, 5).tolist(),
    }


def repeated_words(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """For each document the words in windows of ``size`` words that it holds more than once."""
    doc = np.repeat(np.arange(len(counts)), counts)
    windows = rolling(hashes, size)
    at = np.flatnonzero(doc[: len(windows)] == doc[size - 1 :]) if len(windows) else np.empty(0, np.int64)
    # a window's hash is told apart by document: in a chunk no two documents share one
    salted = windows[at] ^ (doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(salted, kind="stable")
    same = salted[order[1:]] == salted[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[at[twice]] += 1
    edges[at[twice] + size] -= 1
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(counts))


def line_key(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def _line_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_host, text, line, n): the lines of a text by hash, with their words."""
    for batch in batches:
        texts, hosts = byte_texts(batch.column("_text")), batch.column("_host").to_pylist()
        for a, b in chunks(texts):
            out_host, out_text, out_line, out_n = [], [], [], []
            for t, host in zip(texts[a:b], hosts[a:b]):
                if not t:
                    continue
                text_hash, held = xxhash.xxh3_64_intdigest(t), {}
                for line in t.split(b"\n"):
                    words = line.lower().split()
                    if words:
                        key = xxhash.xxh3_64_intdigest(b" ".join(words))
                        held[key] = held.get(key, 0) + len(words)
                out_host += [host] * len(held)
                out_text += [text_hash] * len(held)
                out_line += held
                out_n += held.values()
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out_text, out_line)]
            yield pa.RecordBatch.from_arrays([pa.array(out_host, pa.string()), *longs, pa.array(out_n, pa.int64())], ["_host", "text", "line", "n"])


def _cut_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` with columns _text and _gone (hashes of lines): the text without those lines."""
    for batch in batches:
        gone = batch.column("_gone").to_pylist()
        out = []
        for t, lines in zip(byte_texts(batch.column("_text")), gone):
            if t and lines:
                drop = {x & 0xFFFFFFFFFFFFFFFF for x in lines}
                t = b"\n".join(x for x in t.split(b"\n") if not x.strip(SPACES) or xxhash.xxh3_64_intdigest(line_key(x)) not in drop)
            out.append(t)
        arrays = [pa.array(out, pa.binary()).cast(pa.string()) if name == "_text" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), quoted(host_col).cast("string")), F.lit("~"))


def _copies(keyed: DataFrame) -> DataFrame:
    """Rows (_host, text, copies) from rows (_id, _host, text): how many documents, told apart by id, have a text."""
    return keyed.select("_id", "_host", "text").distinct().groupBy("_host", "text").agg(F.count("*").alias("copies"))


def frequent_lines(docs: DataFrame, keyed: DataFrame, limits: LineLimits, host_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_host, text, line, n) of distinct texts by host that hold lines above the limit, and all lines above it.

    A text's lines are found once and count for each of the documents of
    ``keyed`` (_id, _host, text) that have it.
    """
    lines = docs.select(_host(host_col).alias("_host"), quoted(text_col).alias("_text")).mapInArrow(_line_kernel, "_host string, text long, line long, n long")
    lines = lines.groupBy("_host", "text", "line").agg(F.first("n").alias("n"))
    lines = materialise(lines.join(_copies(keyed), ["_host", "text"]), "lines")
    held = lines.groupBy("_host", "text").agg(F.first("copies").alias("copies")).groupBy("_host").agg(F.sum("copies").alias("of_host"))
    counts = lines.groupBy("_host", "line").agg(F.sum("copies").alias("n_docs")).where(F.col("n_docs") > limits.min_docs)
    above = counts.join(held, "_host").where(F.col("n_docs") > limits.share * F.col("of_host")).select("_host", "line", "n_docs")
    above = materialise(above, "frequent-lines")
    return lines.join(above.select("_host", "line"), ["_host", "line"]), above


def line_verdicts(docs: DataFrame, keyed: DataFrame, limits: LineLimits = LineLimits(), host_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (_host, text, n_removed, gone): a row for each text of a host that loses lines, ``gone`` their hashes."""
    held, _ = frequent_lines(docs, keyed, limits, host_col, text_col)
    return held.groupBy("_host", "text").agg(F.sum("n").alias("n_removed"), F.collect_list("line").alias("gone"))


def judge_documents(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``id_col``, the base counts, base_failed, n_removed_words and kept for each row.

    ``kept`` is false where the base rules fail, and where less than
    ``keep_percent`` of the words are left once lines above the limits are
    removed. Null and empty texts have no words and fail. A null host is a
    host of its own, a null id an id. Copies with ids of their own are
    documents of their own; rows that repeat an id and a text are one document
    and get the same verdict. Other columns play no part; an empty table gives
    an empty one.
    """
    rows = docs.select(quoted(id_col).alias("_id"), _host(host_col).alias("_host"), quoted(text_col).alias("_text"))
    hashed = rows.mapInArrow(_verdict_kernel, f"_id {rows.schema['_id'].dataType.simpleString()}, _host string, text long, {BASE}")
    hashed = materialise(hashed, "counts")
    removed = line_verdicts(docs, hashed, limits, host_col, text_col).select("_host", "text", "n_removed")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    gone = F.coalesce("n_removed", F.lit(0)).cast("long")
    enough = 100 * (F.col("n_words") - gone) >= limits.keep_percent * F.col("n_words")
    return hashed.join(removed, ["_host", "text"], "left").select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), gone.alias("n_removed_words"), (~failed & enough).alias("kept"),
    )


def _verdict_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        texts = [t or b"" for t in byte_texts(batch.column("_text"))]
        for a, b in chunks(texts):
            found = _base_counts(texts[a:b], cache)
            part = batch.slice(a, b - a)
            hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in texts[a:b]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), part.column("_host"), pa.array(hashes), *[pa.array(v, pa.int64()) for v in found.values()]], ["_id", "_host", "text", *found]
            )


def cut_lines(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines above the limits removed from ``text_col``; rows and other columns stay."""
    every = F.struct(*[quoted(c) for c in docs.columns]).alias("_row")
    wide = docs.select(every, quoted(id_col).alias("_id"), _host(host_col).alias("_host"), quoted(text_col).alias("_text"))
    keyed = wide.mapInArrow(_keyed_kernel, schema_of(wide, ["_row", "_id", "_host", "_text"], "text long"))
    gone = line_verdicts(docs, keyed, limits, host_col, text_col).select("_host", "text", F.col("gone").alias("_gone"))
    cut = keyed.join(gone, ["_host", "text"], "left").select("_row", "_text", "_gone").mapInArrow(_cut_kernel, schema_of(wide, ["_row", "_text"], "_gone array<bigint>"))
    return cut.select(*[F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])


def _keyed_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in byte_texts(batch.column("_text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hashes)], [*batch.schema.names, "text"])
