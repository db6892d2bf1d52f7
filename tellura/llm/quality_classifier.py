"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

``score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``, where the
second sum is half of ``|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2``: linear in the
number of features. Features are the different words of a text, hashed, each
``1 / sqrt(their number)``, and steps of figures of its structure and of the
metadata, each 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import CACHE_WORDS, byte_texts, chunks, hash_words, labelled, quoted, schema_of, small_batches
from tellura.llm.common import WordHashes
from tellura.llm.quality_rules import SPACES, repeated_words


@dataclass(frozen=True)
class Fit:
    """``rows_of_label`` bounds the labelled rows of each label that are learnt from."""

    bits: int = 15  # hashed words: 2 to this power
    rank: int = 4
    rows_of_label: int = 3000
    passes: int = 8
    batch: int = 32
    least_steps: int = 800  # small samples are passed more often
    rate: float = 0.08
    shrink: float = 2e-5
    seed: int = 7


#: Steps of each figure; a figure's feature is the number of steps it reaches.
STEPS = {
    "n_words": (1, 5, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 5120),
    "letters": (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98),
    "symbols": (1e-9, 0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.16, 0.2, 0.3),
    "capitals": (0.01, 0.02, 0.04, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "digits": (1e-9, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "different": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeated": (1e-9, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9),
    "same_lines": (1e-9, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
    "word_length": (2, 3, 4, 5, 6, 7, 8, 10, 14, 20),
    "line_words": (1, 2, 4, 8, 12, 16, 24, 40, 80, 200),
    "stops": (1e-9, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5),
    "exclaims": (1e-9, 0.005, 0.01, 0.02, 0.05, 0.1),
    "metadata": (1, 10, 30, 100, 300, 1000, 3000, 10000, 30000, 100000),
}
OFFSETS = dict(zip(STEPS, np.cumsum([0, *[len(s) + 1 for s in STEPS.values()]])))
N_FIGURES = sum(len(s) + 1 for s in STEPS.values())
_DIGITS, _SYMBOLS = b"0123456789", b"#*$%&|<>=+{}[]\\^~_@/"
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))


class _Slots(dict):
    """Slot of each word, as four bytes."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        slot = self[word] = (xxhash.xxh3_64_intdigest(word, 5) & self.mask).to_bytes(4, "little")
        return slot


def _figures(texts: list[bytes], words: list[list[bytes]], different: list[int], repeated: np.ndarray, n_chars: list[int | None]) -> np.ndarray:
    """Slots of the structure features, a row for each text."""
    out = np.zeros((len(texts), len(STEPS)), np.int64)
    count = lambda t, which: len(t) - len(t.translate(None, which))
    for i, (t, w) in enumerate(zip(texts, words)):
        size = max(1, len(t) - count(t, SPACES))
        n = max(1, len(w))
        big, small = count(t, _CAPITALS), count(t, _SMALL)
        high = len(t) - len(t.decode("utf-8", "replace").encode("ascii", "ignore"))
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)]
        values = {
            "n_words": len(w), "letters": (big + small + high) / size, "symbols": count(t, _SYMBOLS) / size, "capitals": big / max(1, big + small), "digits": count(t, _DIGITS) / size,
            "different": different[i] / n, "repeated": repeated[i] / n, "same_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
            "word_length": size / n, "line_words": len(w) / max(1, len(lines)), "stops": count(t, b".?!") / n, "exclaims": count(t, b"!") / size,
            "metadata": n_chars[i] if n_chars[i] is not None else -1,
        }
        for k, (name, value) in enumerate(values.items()):
            out[i, k] = OFFSETS[name] + sum(value >= s for s in STEPS[name])
    return out


def feature_rows(texts: list[bytes], n_chars: list[int | None], slots: _Slots, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all features of the texts in a row, their values, and the number of features of each text."""
    lower = [t.lower().split() for t in texts]
    sets = [set(w) for w in lower]
    hashes, counts = hash_words([t.split() for t in texts], cache)
    figures = _figures(texts, lower, [len(s) for s in sets], repeated_words(hashes, counts, 5), n_chars)
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.frombuffer(b"".join(map(slots.__getitem__, chain.from_iterable(sets))), np.uint32).astype(np.int64) + N_FIGURES
    width = figures.shape[1]
    total = n + width
    at = np.concatenate([[0], np.cumsum(total)])
    index, value = np.empty(at[-1], np.int64), np.empty(at[-1], np.float32)
    is_word = np.ones(at[-1], bool)
    for k in range(width):
        is_word[at[:-1] + k] = False
    index[~is_word] = figures.ravel()
    value[~is_word] = 1.0
    index[is_word] = flat
    value[is_word] = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
    return index, value, total


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log odds by the sum-of-squares identity."""
        starts = np.cumsum(sizes) - sizes
        vx = self.factors[index] * value[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * ((s * s).sum(axis=1) - squares)


def train(index: np.ndarray, value: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, how: Fit) -> Machine:
    """AdaGrad on the weighted logistic loss, features of every row nonempty."""
    rng = np.random.default_rng(how.seed)
    slots = N_FIGURES + (1 << how.bits)
    share = float((weight * y).sum() / weight.sum())
    m = Machine(float(np.log((share + 0.01) / (1.01 - share))), np.zeros(slots, np.float32), rng.normal(0, 0.02, (slots, how.rank)).astype(np.float32))
    gw, gv, gb = np.full(slots, 1e-2), np.full((slots, how.rank), 1e-2), 1e-2
    weight = weight / weight.mean()
    at = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(max(how.passes, how.least_steps * how.batch // len(y))):
        order = rng.permutation(len(y))
        for a in range(0, len(order), how.batch):
            rows = order[a : a + how.batch]
            n = sizes[rows]
            spots = np.repeat(at[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            i, x = index[spots], value[spots]
            starts = np.cumsum(n) - n
            vx = m.factors[i] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            raw = m.bias + np.add.reduceat(m.linear[i] * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            error = weight[rows] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            e = np.repeat(error, n)
            u, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, weights=e * x, minlength=len(u)) + how.shrink * m.linear[u]
            gw[u] += dw * dw
            m.linear[u] -= (how.rate * dw / np.sqrt(gw[u])).astype(np.float32)
            part = (e * x)[:, None] * (np.repeat(s, n, axis=0) - vx)
            for k in range(how.rank):
                dv = np.bincount(back, weights=part[:, k], minlength=len(u)) + how.shrink * m.factors[u, k]
                gv[u, k] += dv * dv
                m.factors[u, k] -= (how.rate * dv / np.sqrt(gv[u, k])).astype(np.float32)
            db = float(error.sum())
            gb += db * db
            m.bias -= how.rate * db / gb**0.5
    return m


def _feature_kernel(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, cache = _Slots(bits), WordHashes()
        for batch in batches:
            texts, meta = [t or b"" for t in byte_texts(batch.column("_text"))], batch.column("_n").to_pylist()
            for a, b in chunks(texts):
                index, value, sizes = feature_rows(texts[a:b], meta[a:b], slots, cache)
                cut = np.cumsum(sizes)[:-1]
                arrays = [batch.column("y").slice(a, b - a)] + [pa.array([p.tobytes() for p in np.split(x, cut)], pa.binary()) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays(arrays, ["y", "slots", "amounts"])

    return run


def _rows(docs: DataFrame, text_col: str, meta_col: str | None, *keep: str) -> DataFrame:
    meta = quoted(meta_col).cast("long") if meta_col else F.lit(None).cast("long")
    return docs.select(*keep, quoted(text_col).alias("_text"), meta.alias("_n"))


def fit(
    docs: DataFrame, labels: DataFrame, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_col: str | None = "n_chars"
) -> Machine:
    """Learn from the rows of ``labels`` with label 0 or 1, ``rows_of_label`` of each at most (see labelled())."""
    small_batches(docs.sparkSession, 500)
    texts, totals = labelled(_rows(docs, text_col, meta_col, quoted(id_col).alias("_id")), labels, how.rows_of_label, id_col, label_col)
    rows = texts.select("y", "_text", "_n").mapInArrow(_feature_kernel(how.bits), "y int, slots binary, amounts binary").collect()
    if not rows:
        return Machine(0.0, np.zeros(N_FIGURES + (1 << how.bits), np.float32), np.zeros((N_FIGURES + (1 << how.bits), how.rank), np.float32))
    y = np.array([r["y"] for r in rows])
    index = [np.frombuffer(r["slots"], np.int32) for r in rows]
    value = np.concatenate([np.frombuffer(r["amounts"], np.float32) for r in rows])
    weight = np.array([totals[v] / max(1, (y == v).sum()) for v in y])
    return train(np.concatenate(index).astype(np.int64), value, np.array([len(i) for i in index]), y, weight, how)


def _score_kernel(machine: Machine, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, cache = _Slots(bits), WordHashes()
        for batch in batches:
            texts, meta = [t or b"" for t in byte_texts(batch.column("text"))], batch.column("n").to_pylist()
            for a, b in chunks(texts):
                raw = machine.raw(*feature_rows(texts[a:b], meta[a:b], slots, cache))
                score = 1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), pa.array(score)], ["row", "score"])

    return run


def score(
    docs: DataFrame, machine: Machine, how: Fit = Fit(), text_col: str = "text", meta_col: str | None = "n_chars", keep: Sequence[str] | None = None, score_col: str = "_score"
) -> DataFrame:
    """All columns of ``docs``, or those of ``keep``, and ``score_col``: higher where label 1 is likelier.

    Null and empty texts are scored by their structure. Equal rows have equal
    scores. A column of that name is replaced; others stay, whatever their names.
    """
    small_batches(docs.sparkSession, 500)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]
    figure = (quoted(meta_col) if meta_col else F.lit(None)).cast("long")
    rows = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(text_col).alias("text"), figure.alias("n"))
    scored = rows.mapInArrow(_score_kernel(machine, how.bits), schema_of(rows, ["row"], "score double"))
    return scored.select(*[F.col("row")[c].alias(c) for c in names], F.col("score").alias(score_col))
