"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Tokens with digits or symbols among letters, repeated letters, and letters
with spaces between them are read as a lattice: a sign may stand for a letter,
for nothing, or repeat the letter before it. Viterbi decoding finds the
likeliest letters under a character trigram model of the whole corpus. A token
that may be plain keeps its plain reading beside the decoded one. The restored
words' weights, learnt from labelled documents, make the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import CACHE_WORDS, WordHashes, byte_texts, chunks, hash_words, labelled, mix, quoted, rolling, schema_of, small_batches

#: Letters that the character model tells apart; 0 is a word's edge, the last class any other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœ"
CLASS = {c: i + 1 for i, c in enumerate(LETTERS)}
OTHER = len(LETTERS) + 1
CLASSES = OTHER + 1

#: Letters that a sign may stand for (fixed values).
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Log costs of the channel: a sign for a letter, a sign dropped, a separator dropped, a letter repeated.
SUBSTITUTE, DROP, GAP, REPEAT = 1.0, 3.0, 0.6, 1.2
SEPARATORS = "-._*~·'’ "
#: Gain of a restored letter, so that longer readings aren't worse for their length.
LETTER = math.log(len(LETTERS))


@dataclass(frozen=True)
class Fit:
    """``rows_of_label``: labelled rows of each label that are learnt from, at most; all units that two families of them share are kept."""

    rows_of_label: int = 3000
    smooth: float = 3.0
    prefix: int = 4


# --- the character model -------------------------------------------------


def _class_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for code in range(0x250):
        c = chr(code)
        if c.isalpha():
            table[code] = CLASS.get(c, OTHER)
    return table


def _trigram_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, total = _class_table(), np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        texts = [t for t in batch.column("_text").to_pylist() if t]
        for a, b in chunks(texts, 1_000_000):
            codes = np.frombuffer(" \0 ".join([" ", *texts[a:b], " "]).lower().encode("utf-32-le", "replace"), np.uint32)
            c = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], OTHER)
            index = (c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:]
            total += np.bincount(index, minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["trigram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(letter | two before) from the counts of all texts; CLASSES cubed numbers whatever the corpus."""
    counts = docs.select(quoted(text_col).alias("_text")).mapInArrow(_trigram_kernel, "trigram long, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CLASSES**3)
    n[np.asarray(counts.column("trigram"))] = np.asarray(counts.column("n"))
    n = n.reshape(CLASSES, CLASSES, CLASSES)
    pairs = n.sum(axis=0)  # (one before, letter)
    low = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * CLASSES)
    p = (n + 2.0 * low[None]) / (n.sum(axis=2, keepdims=True) + 2.0)
    return np.log(p).astype(np.float32)


# --- the decoder ---------------------------------------------------------


def bare(token: str) -> str:
    """A token without signs at its ends, but for those that often stand for a first or last letter."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] in "@$"):
        a += 1
    while b > a and not (token[b - 1].isalnum() or token[b - 1] in "@$"):
        b -= 1
    core = token[a:b]
    if core.endswith(("$$", "@@")) or core.startswith(("$$", "@@")):
        core = core.strip("@$")
    return core


def suspicious(core: str) -> bool:
    """Whether a token may hide a word: it has letters, and signs among them or a letter repeated."""
    if core.isalpha():
        return any(c == p for p, c in zip(core, core[1:]))
    return any(c.isalpha() for c in core)


def decode(core: str, model: np.ndarray) -> str:
    """The likeliest word behind ``core``: the best path through its lattice."""
    paths: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for c in core:
        steps: list[tuple[str, float]] = []
        if c.isalpha():
            steps.append((c, 0.0))
            if c == before:
                steps.append(("", REPEAT))
        else:
            steps += [(letter, SUBSTITUTE) for letter in SIGNS.get(c, "")]
            steps.append(("", REPEAT if c == before else GAP if c in SEPARATORS else DROP))
        found: dict[tuple[int, int], tuple[float, str]] = {}
        for (p2, p1), (score, word) in paths.items():
            for letter, cost in steps:
                if letter:
                    k = CLASS.get(letter, OTHER)
                    state, value = (p1, k), score - cost + LETTER + float(model[p2, p1, k])
                else:
                    state, value = (p2, p1), score - cost
                if state not in found or value > found[state][0]:
                    found[state] = (value, word + letter)
        paths, before = found, c
    return max(((score + float(model[p2, p1, 0]), word) for (p2, p1), (score, word) in paths.items()), key=lambda x: x[0])[1]


def readings(core: str, model: np.ndarray) -> tuple[str, ...]:
    """The likeliest word behind ``core``, then the same without repeated letters and, of letters only, ``core`` as it stands."""
    if not core or not suspicious(core):
        return (core,)
    word = decode(core, model)
    single = "".join(c for p, c in zip(" " + word, word) if c != p)
    return tuple(dict.fromkeys((word, single, core) if core.isalpha() else (word, single)))


class Restorer:
    """Restored forms of tokens (bytes, lower case), each decoded once while it is remembered."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.known: dict[bytes, tuple[str, ...]] = {}

    def readings(self, token: bytes) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            found = self.known[token] = readings(bare(token.decode("utf-8", "replace").lower()), self.model)
        return found

    def __getitem__(self, token: bytes) -> str:
        """The likeliest."""
        return self.readings(token)[0]


def spaced(tokens: list[bytes]) -> list[str]:
    """Runs of three and more single characters, without the spaces between them."""
    out = []
    if len(tokens) < 3:
        return out
    short = np.fromiter(map(len, tokens), np.int64, len(tokens)) <= 2
    run = short[:-2] & short[1:-1] & short[2:]
    if not run.any():
        return out
    held: list[str] = []
    for i in range(len(tokens) + 1):
        c = tokens[i].decode("utf-8", "replace").lower() if i < len(tokens) and short[i] else ""
        if len(c) == 1:
            held.append(c)
        else:
            if len(held) > 2:
                out.append("".join(held))
            held = []
    return out


def run_readings(tokens: list[bytes], model: np.ndarray) -> list[str]:
    """Readings of letters that were spaced out, whole runs; runs without letters need three different signs."""
    out: dict[str, None] = {}
    for run in spaced(tokens):
        if len(set(run)) > 2 or any(c.isalpha() for c in run):
            out.update(dict.fromkeys(readings(run, model) if any(c.isalpha() for c in run) else (decode(run, model),)))
    out.pop("", None)
    return list(out)


def stretches(word: str, lengths: Iterable[int]) -> set[str]:
    """The word and its parts of the given lengths."""
    return {word, *(word[j : j + k] for k in lengths for j in range(len(word) - k + 1))}


def restored_words(tokens: list[bytes], restorer: Restorer) -> set[str]:
    """Different readings of a text's tokens."""
    words = {w for token in set(tokens) for w in restorer.readings(token)}
    words.discard("")
    return words


# --- weights and score ---------------------------------------------------


def unit_hashes(word: str, prefix: int) -> tuple[int, int]:
    """Of the word, and of its beginning (0 if it is no longer)."""
    return xxhash.xxh3_64_intdigest(word.encode(), 1), xxhash.xxh3_64_intdigest(word[:prefix].encode(), 2) if len(word) > prefix else 0


@dataclass
class Model:
    characters: np.ndarray
    units: np.ndarray
    weights: np.ndarray
    coefficients: np.ndarray
    prefix: int
    #: Of the words among ``units``.
    lengths: tuple[int, ...] = ()


#: Part of a word beginning's weight that a word has at least.
OF_START = 0.7


def _weigh(word: float | None, start: float | None) -> float:
    """A word's own weight, or part of its beginning's, whichever says more for a toxic label."""
    if word is None:
        return OF_START * start if start is not None else 0.0
    return max(word, OF_START * start) if start is not None and start > 0 else word


def features(weights: np.ndarray, n_words: int) -> np.ndarray:
    top = np.sort(weights)[::-1][:3]
    top = np.maximum(np.pad(top, (0, 3 - len(top))), 0.0)
    strong = int((weights > 1.2).sum())
    return np.array([1.0, top[0], top[1], top[2], math.sqrt(min(strong, 25)), strong / math.log(n_words + 3)])


N_FEATURES = 6


def _unit_kernel(characters: np.ndarray, prefix: int):
    """Rows (y, family, words, starts, sizes, runs) of labelled texts; near copies mostly share ``family``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache = Restorer(characters), WordHashes()
        for batch in batches:
            family, words, starts, sizes, runs = [], [], [], [], []
            for text in byte_texts(batch.column("_text")):
                split = (text or b"").lower().split()
                tokens, _ = hash_words([split], cache)
                grams = rolling(tokens, 4) if len(tokens) > 3 else mix(tokens)
                family.append(int(grams.min()) if len(grams) else 0)
                whole = run_readings(split, characters)
                found = list(restored_words(split, restorer).union(whole))
                pairs = [unit_hashes(w, prefix) for w in found]
                words.append(np.array([p[0] for p in pairs], np.uint64).tobytes())
                starts.append(np.array([p[1] for p in pairs], np.uint64).tobytes())
                sizes.append(np.array([len(w) for w in found], np.int32).tobytes())
                runs.append(whole)
            arrays = [batch.column("y"), pa.array(np.array(family, np.uint64).view(np.int64)), *[pa.array(v, pa.binary()) for v in (words, starts, sizes)], pa.array(runs, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["y", "family", "words", "starts", "sizes", "runs"])

    return run


def fit(docs: DataFrame, labels: DataFrame, how: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from ``labels`` (``id_col``, ``label_col`` 0 or 1): all rows given may be used, ``rows_of_label`` of each label at most (see labelled())."""
    small_batches(docs.sparkSession, 500)
    characters = character_model(docs, text_col)
    rows, totals = labelled(docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text")), labels, how.rows_of_label, id_col, label_col)
    units = rows.select("y", "_text").mapInArrow(_unit_kernel(characters, how.prefix), UNITS)
    # the sample is bounded: one task learns from it, and the driver gets the weights alone
    found = units.repartition(1).mapInArrow(_learn_kernel(characters, totals, how), "units binary, weights binary, coefficients binary, lengths array<int>").first()
    if found is None:
        return _learn(characters, pa.table({"y": pa.array([], pa.int32())}), totals, how)
    units, weights, coefficients = (np.frombuffer(found[c], t) for c, t in (("units", np.uint64), ("weights", np.float32), ("coefficients", np.float64)))
    return Model(characters, units, weights, coefficients, how.prefix, tuple(found["lengths"]))


UNITS = "y int, family long, words binary, starts binary, sizes binary, runs array<string>"


def _learn_kernel(characters: np.ndarray, totals: dict[int, int], how: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        model = _learn(characters, pa.Table.from_batches(held) if held else pa.table({"y": pa.array([], pa.int32())}), totals, how)
        packed = [pa.array([v.tobytes()], pa.binary()) for v in (model.units, model.weights, np.asarray(model.coefficients, np.float64))]
        yield pa.RecordBatch.from_arrays([*packed, pa.array([list(model.lengths)], pa.list_(pa.int32()))], ["units", "weights", "coefficients", "lengths"])

    return run


def _learn(characters: np.ndarray, rows: pa.Table, totals: dict[int, int], how: Fit) -> Model:
    none = Model(characters, np.empty(0, np.uint64), np.empty(0, np.float32), np.array([-6.0, *[0.0] * (N_FEATURES - 1)]), how.prefix)
    y = np.asarray(rows.column("y"), np.int64)
    if len(set(y.tolist())) < 2:
        if len(y) and y[0] == 1:
            none.coefficients[0] = 6.0
        return none
    words, starts, sizes = ([np.frombuffer(v.as_buffer(), t) for v in rows.column(c)] for c, t in (("words", np.uint64), ("starts", np.uint64), ("sizes", np.int32)))
    _add_stretches(words, starts, sizes, rows.column("runs"), how.prefix)
    family, n = np.asarray(rows.column("family")), np.array([len(w) for w in words])
    weight = np.array([totals[1] / max(1, (y == 1).sum()) if v else totals[0] / max(1, (y == 0).sum()) for v in y])
    units, inverse = np.unique(np.concatenate([*words, *starts]), return_inverse=True)
    inverse = inverse.astype(np.int32)
    owner = np.tile(np.repeat(np.arange(len(y), dtype=np.int32), n), 2)
    # a family counts once for each label: copies of a document teach no more than one
    _, kin = np.unique(np.stack([family, y]), axis=1, return_inverse=True)
    pair = np.unique(inverse.astype(np.int64) * (kin.max() + 1) + kin[owner])
    at, of = pair // (kin.max() + 1), pair % (kin.max() + 1)
    label_of = np.zeros(kin.max() + 1, np.int64)
    label_of[kin] = y
    mean = {v: weight[y == v].mean() for v in (0, 1)}
    up = np.bincount(at, weights=(label_of[of] == 1) * mean[1], minlength=len(units))
    down = np.bincount(at, weights=(label_of[of] == 0) * mean[0], minlength=len(units))
    seen = np.bincount(at, minlength=len(units))
    prior = totals[1] / (totals[0] + totals[1])

    def odds(u: np.ndarray, d: np.ndarray) -> np.ndarray:
        s = how.smooth * max(mean[0], mean[1]) if len(y) else how.smooth
        return np.log((np.maximum(u, 0) + s * prior) / (np.maximum(d, 0) + s * (1 - prior))) - math.log(prior / (1 - prior))

    # features of a labelled document leave out what its own family taught
    rows_x = np.zeros((len(y), N_FEATURES))
    cut = np.concatenate([[0], np.cumsum(n)])
    half = len(inverse) // 2
    for i in range(len(y)):
        w, s = inverse[:half][cut[i] : cut[i + 1]], inverse[half:][cut[i] : cut[i + 1]]
        du, dd = (mean[1], 0.0) if y[i] else (0.0, mean[0])
        ww, ws = odds(up[w] - du, down[w] - dd), odds(up[s] - du, down[s] - dd)
        known, start = seen[w] - 1 >= 2, (seen[s] - 1 >= 2) & (units[s] != 0)
        part = np.where(start, OF_START * ws, 0.0)
        rows_x[i] = features(np.where(known, np.where(part > 0, np.maximum(ww, part), ww), part), int(n[i]))
    coefficients = _logistic(rows_x, y, weight)
    w = odds(up, down)
    keep = np.flatnonzero((seen >= 2) & (units != 0))
    size = np.zeros(len(units), np.int32)
    size[inverse[:half]] = np.concatenate(sizes)
    return Model(characters, units[keep], w[keep].astype(np.float32), coefficients, how.prefix, tuple(np.setdiff1d(size[keep], [0]).tolist()))


def _add_stretches(words: list[np.ndarray], starts: list[np.ndarray], sizes: list[np.ndarray], runs: pa.ChunkedArray, prefix: int) -> None:
    """To the words of each text the parts of its runs, of every length that a word of any of the texts has."""
    lengths = np.unique(np.concatenate(sizes)).tolist()
    for i, of_text in enumerate(runs.to_pylist()):
        found = {s for run in of_text for s in stretches(run, lengths)}
        pairs = {unit_hashes(s, prefix): len(s) for s in found}
        known = set(words[i].tolist()) if pairs else ()
        new = [(one, two, size) for (one, two), size in pairs.items() if one not in known]
        if new:
            words[i], starts[i], sizes[i] = (np.concatenate([old[i], np.array(v, old[i].dtype)]) for old, v in zip((words, starts, sizes), zip(*new)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, with slight shrinkage."""
    weight = weight / weight.mean()
    b = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1.0] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h + 1e-9 * np.eye(len(b)), g)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return b


class _Weights(dict):
    """Weight of each token (bytes, lower case): restored, looked up, remembered."""

    def __init__(self, model: Model):
        super().__init__()
        self.characters, self.prefix = model.characters, model.prefix
        self.lexicon = dict(zip(model.units.tolist(), model.weights.tolist()))

    def of(self, word: str) -> float:
        one, two = unit_hashes(word, self.prefix)
        return _weigh(self.lexicon.get(one), self.lexicon.get(two))

    def __missing__(self, token: bytes) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[token] = max(self.of(w) if w else 0.0 for w in readings(bare(token.decode("utf-8", "replace").lower()), self.characters))
        return value


def _score_kernel(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(model)
        for batch in batches:
            x = np.zeros((batch.num_rows, N_FEATURES))
            for i, text in enumerate(byte_texts(batch.column("text"))):
                tokens = (text or b"").lower().split()
                found = list(map(weights.__getitem__, set(tokens)))
                n = len(found)
                parts = {s for whole in run_readings(tokens, model.characters) for s in stretches(whole, model.lengths)}
                found += map(weights.of, parts)
                x[i] = features(np.array(found), n)
            score = 1 / (1 + np.exp(-np.clip(x @ model.coefficients, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] | None = None, score_col: str = "_score") -> DataFrame:
    """All columns of ``docs``, or those of ``keep``, and ``score_col`` between 0 and 1, higher where a toxic label is likelier.

    Null and empty texts have a score too, that of no evidence; equal texts
    have equal scores. A column of that name is replaced; others stay, whatever
    their names.
    """
    small_batches(docs.sparkSession, 500)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]
    rows = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(text_col).alias("text"))
    scored = rows.mapInArrow(_score_kernel(model), schema_of(rows, ["row"], "score double"))
    return scored.select(*[F.col("row")[c].alias(c) for c in names], F.col("score").alias(score_col))


def split_of(key: Column, parts: int) -> Column:
    """Remainder of the checksum of a key's text, for learning and holding out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(parts))
