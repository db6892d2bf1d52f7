"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents longer than a sequence are cut; what is shorter is packed. Pieces are
dealt to cells of bounded size. Each cell is solved on several islands, each
with a population of its own: a crossover injects whole well-filled bins of one
parent into another, drops the bins that hold their pieces twice, and best-fits
the displaced pieces. Between epochs an island's elite moves to the next island
of the cell. Bins that stay badly filled are pooled over all cells and packed
again.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import byte_texts, chunks, materialise, small_batches


@dataclass(frozen=True)
class Evolution:
    cell: int = 1024  # pieces of a cell, on average
    islands: int = 2
    epochs: int = 2
    population: int = 5
    generations: int = 6  # of an epoch
    elite: int = 2  # solutions that move on
    good: float = 0.985  # fill of a bin that needs no second level
    levels: int = 3


#: Words, and pieces of words, whose ids a Python worker remembers before it starts anew.
CACHE = 600_000
#: Words of which the pieces can be told without the tokenizer's own pre-tokenisation: ASCII and composed Latin letters.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
# fixed values: the tokenizer file's split pattern, for those letters, and its mark of a word's end
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00c0-\u024f]+|[0-9]|[^\\sa-z0-9\u00c0-\u024f]+")
SIGNS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, its ids as bytes, and the signs by which its model knows the bytes of a text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # printable bytes stand for themselves, others for 256 on
    rest = iter(range(256, 512))
    signs = [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]
    return whole, [i.to_bytes(4, "little") for i in range(whole.get_vocab_size())], signs


class WordIds(dict):
    """Token ids of words (bytes) as little-endian 32-bit integers, found once while they are remembered.

    Pieces never span white space, so a text's ids are those of its words in a
    row, and a word's ids those of its pieces, which the tokenizer's model
    gives. Words of other letters, and those that may hold a special token, go
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.whole, self.ids, self.signs = _tokenizer(path)
        self.model = self.whole.model
        self.pieces: dict[str, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        core = word.rstrip(SIGNS)
        if core.isalpha():  # ASCII letters
            out = self.piece(core.decode().lower())
        else:
            text = core.decode("utf-8", "replace")
            if text.isalpha() and PLAIN.fullmatch(text):
                out = self.piece(text.lower())
            else:
                text, core = word.decode("utf-8", "replace"), word
                if PLAIN.fullmatch(text) and "<|" not in text:
                    out = b"".join(map(self.piece, PIECES.findall(text.lower())))
                else:
                    out = b"".join([self.ids[i] for i in self.whole.encode(text, add_special_tokens=False).ids])
        if len(core) < len(word):  # signs in a row are one piece
            out += self.piece(word[len(core) :].decode())
        self[word] = out
        return out

    def piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) >= CACHE:
                self.pieces.clear()
            spelt = piece if piece.isascii() else "".join([self.signs[b] for b in piece.encode()])
            found = self.pieces[piece] = b"".join([self.ids[t.id] for t in self.model.tokenize(spelt)])
        return found

    def text(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


def _token_kernel(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(path)
        for batch in batches:
            texts = byte_texts(batch.column("_text"))
            for a, b in chunks(texts):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(texts[a:b]):
                    tokens = ids.text(text or b"") + bytes(4)
                    for s in range(0, len(tokens), 4 * limit):
                        part = tokens[s : s + 4 * limit]
                        row.append(i)
                        piece.append(s // (4 * limit))
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                own = batch.column("_id").slice(a, b - a).take(pa.array(row, pa.int64()))
                arrays = [own, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (_id, piece, start, length, ids_crc32): each document's ids with a 0 after them, cut only where they exceed ``limit``."""
    small_batches(docs.sparkSession, 1000)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_token_kernel(tokenizer_path, limit), f"_id {kind}, piece int, start long, length long, ids_crc32 long")


class Cell:
    """Pieces of given lengths to be packed; a solution is an array of the bin of each piece."""

    def __init__(self, lengths: np.ndarray, limit: int, rng: np.random.Generator):
        self.lengths, self.limit, self.rng = lengths, limit, rng
        self.sizes = lengths.tolist()
        self.least = math.ceil(lengths.sum() / limit)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, weights=self.lengths).astype(np.int64)

    def score(self, bins: np.ndarray) -> float:
        """Fewer bins first, then fuller ones."""
        fill = self.fills(bins)
        return float(((fill / self.limit) ** 2).mean() - len(fill))

    def insert(self, bins: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """``bins`` (-1 for ``pieces``) with each of ``pieces``, in the order given, where it fits best."""
        placed = bins >= 0
        names, own = np.unique(bins[placed], return_inverse=True)
        out = np.full(len(bins), -1)
        out[placed] = own
        free = self.limit - np.bincount(own, weights=self.lengths[placed], minlength=len(names)).astype(np.int64)
        room = sorted(zip(free.tolist(), range(len(names))))
        room = room[bisect_left(room, (1, -1)) :]
        n = len(names)
        for p in pieces.tolist():
            size = self.sizes[p]
            at = bisect_left(room, (size, -1))
            if at < len(room):
                left, b = room.pop(at)
            else:
                left, b = self.limit, n
                n += 1
            out[p] = b
            if left > size:
                insort(room, (left - size, b))
        return out

    def start(self, noise: float) -> np.ndarray:
        """Best fit of the pieces by falling length, which ``noise`` blurs."""
        key = self.lengths * (1 + noise * self.rng.standard_normal(len(self.lengths)))
        return self.insert(np.full(len(self.lengths), -1), np.argsort(-key, kind="stable"))

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``a`` with well-filled bins of ``b``."""
        fill = self.fills(b)
        order = np.argsort(-(fill + self.rng.random(len(fill))), kind="stable")
        best = order[: max(1, len(order) // 2)]
        chosen = best[self.rng.random(len(best)) < 0.3]
        if not len(chosen):
            chosen = best[:1]
        inject = np.isin(b, chosen)
        out = a.copy()
        out[np.isin(a, a[inject])] = -1  # bins that hold one of the injected pieces
        lost = (out < 0) & ~inject
        out[inject] = b[inject] + len(a)
        return self.insert(out, self._falling(lost))

    def shake(self, a: np.ndarray) -> np.ndarray:
        """``a`` with its worst bins and a few others emptied."""
        fill = self.fills(a)
        order = np.argsort(fill, kind="stable")
        drop = np.concatenate([order[:2], self.rng.choice(len(fill), min(len(fill), 3), replace=False)])
        lost = np.isin(a, drop)
        out = np.where(lost, -1, a)
        return self.insert(out, self._falling(lost))

    def _falling(self, lost: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(lost)
        key = self.lengths[at] * (1 + 0.03 * self.rng.standard_normal(len(at)))
        return at[np.argsort(-key, kind="stable")]

    def evolve(self, elites: list[np.ndarray], how: Evolution) -> list[np.ndarray]:
        pool = list(elites) or [self.start(0.0)]
        while len(pool) < how.population and self._open(pool):
            pool.append(self.start(0.02 * len(pool)))
        ranked = sorted(((self.score(p), i) for i, p in enumerate(pool)), reverse=True)
        pool = [(s, pool[i]) for s, i in ranked][: how.population]
        for _ in range(how.generations):
            if -pool[0][0] <= self.least or len(pool) < 2:  # as few bins as the sum allows
                break
            for _ in range(how.population):
                i, j = self.rng.choice(len(pool), 2, replace=False)
                child = self.cross(pool[min(i, j)][1], pool[max(i, j)][1])
                if self.rng.random() < 0.5:
                    child = self.shake(child)
                value = self.score(child)
                if value > pool[-1][0] and all(value != v for v, _ in pool):
                    pool[-1] = (value, child)
                    pool.sort(key=lambda x: -x[0])
        return [p for _, p in pool[: how.elite]]

    def _open(self, pool: list[np.ndarray]) -> bool:
        return min(int(p.max()) + 1 for p in pool) > self.least


def _epoch_kernel(limit: int, epoch: int, how: Evolution):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, islands = batch.column("cell").to_pylist(), batch.column("island").to_pylist()
            lengths, given = batch.column("lengths"), batch.column("elites").to_pylist()
            elites, scores = [], []
            for i, (c, k) in enumerate(zip(cells, islands)):
                cell = Cell(np.asarray(lengths[i].values, np.int64), limit, np.random.default_rng([c, k, epoch]))
                best = cell.evolve([np.array(e, np.int64) for e in given[i]], how)
                elites.append([e.tolist() for e in best])
                scores.append(cell.score(best[0]))
            arrays = [batch.column("cell"), batch.column("island"), lengths, pa.array(elites, pa.list_(pa.list_(pa.int32()))), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["cell", "island", "lengths", "elites", "score"])

    return run


def _place_kernel(limit: int):
    """Offset and fill for each piece of a solved cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, fills = [], []
            for lengths, bins in zip(batch.column("lengths"), batch.column("bins")):
                size, b = np.asarray(lengths.values, np.int64), np.asarray(bins.values, np.int64)
                order = np.argsort(b, kind="stable")
                run_up = np.cumsum(size[order]) - size[order]
                first = np.searchsorted(b[order], b[order], side="left")
                at = np.empty(len(b), np.int64)
                at[order] = run_up - run_up[first]
                offsets.append(at.tolist())
                fills.append(np.bincount(b, weights=size).astype(np.int64)[b].tolist())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("bins"), pa.array(offsets, kind), pa.array(fills, kind)], ["cell", "bins", "offsets", "fills"])

    return run


def _solve(pieces: DataFrame, limit: int, how: Evolution, level: int) -> DataFrame:
    """Rows (uid, length, sequence_id, offset, fill) for ``pieces`` (uid, length)."""
    count = pieces.count()
    n_cells = max(1, math.ceil(count / how.cell))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(n_cells)))
    cells = dealt.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("items"))  # of how.cell pieces or so
    cells = materialise(cells.withColumn("lengths", F.transform("items", lambda x: x["length"].cast("int"))), "cells")
    state = cells.select("cell", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"), "lengths", F.array().cast("array<array<int>>").alias("elites"))
    state = state.repartition(max(1, min(n_cells * how.islands, 4 * pieces.sparkSession.sparkContext.defaultParallelism)), "cell", "island")
    shape = "cell long, island int, lengths array<int>, elites array<array<int>>, score double"
    for epoch in range(how.epochs):
        evolved = state.mapInArrow(_epoch_kernel(limit, epoch, how), shape)
        gathered = evolved.groupBy("cell").agg(F.first("lengths").alias("lengths"), F.sort_array(F.collect_list(F.struct("island", "score", "elites"))).alias("all"))
        if epoch + 1 < how.epochs:
            own = lambda x: F.struct(x["island"].alias("island"), F.concat(x["elites"], F.element_at("all", F.pmod(x["island"] - 1, F.lit(how.islands)) + 1)["elites"]).alias("elites"))
            state = gathered.select("cell", "lengths", F.explode(F.transform("all", own)).alias("s")).select("cell", "s.island", "lengths", "s.elites")
    best = F.array_max(F.transform("all", lambda x: F.struct(x["score"], -x["island"], x["elites"][0].alias("bins"))))["bins"]
    solved = gathered.select("cell", "lengths", best.alias("bins")).mapInArrow(_place_kernel(limit), "cell long, bins array<int>, offsets array<long>, fills array<long>")
    rows = cells.select("cell", "items").join(solved, "cell").select("cell", F.explode(F.arrays_zip("items", "bins", "offsets", "fills")).alias("r"))
    sequence = F.lit(level << 56).cast("long") + F.col("cell") * 65536 + F.col("r.bins")
    return materialise(rows.select("r.items.uid", "r.items.length", sequence.alias("sequence_id"), F.col("r.offsets").alias("offset"), F.col("r.fills").alias("fill")), "packed")


def pack_lengths(pieces: DataFrame, limit: int, how: Evolution = Evolution()) -> DataFrame:
    """(uid, sequence_id, offset) for ``pieces`` (uid, length): whole sequences alone, others by evolution, the worst bins again."""
    full = pieces.where(F.col("length") == limit).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out, rest = full, pieces.where(F.col("length") < limit).select("uid", "length")
    for level in range(1, how.levels + 1):
        solved = _solve(rest, limit, how, level)
        last = level == how.levels
        done = solved if last else solved.where(F.col("fill") >= how.good * limit)
        out = out.unionByName(done.select("uid", "sequence_id", "offset"))
        if last:
            break
        rest = solved.where(F.col("fill") < how.good * limit).select("uid", "length")
    return out


def pack_documents(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", how: Evolution = Evolution()
) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32, sequence_id and offset of each piece.

    Null and empty texts are one piece of the id 0. Every row of ``docs`` is
    packed, those that repeat an id too; ties in length go by the pieces'
    order. Other columns play no part; an empty table gives an empty one.
    """
    pieces = materialise(token_pieces(docs, tokenizer_path, limit, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack_lengths(pieces.select("uid", "length"), limit, how)
    return pieces.join(placed, "uid").select(F.col("_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
