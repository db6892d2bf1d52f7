"""N-gram Jaccard join: universe partition by size band, pigeonhole, exact verification.

A document is the set of its word n-grams. Two sets with Jaccard similarity t
differ in at most H = (a + b) (1 - t) / (1 + t) elements. For each band of
sizes the universe of n-grams is dealt to m segments by hash, and the segments
are given tolerances 0 or 1 whose sum of (tolerance + 1) exceeds H, so in some
segment two similar sets differ by no more than its tolerance. A tolerance of 0
indexes the segment's subset, a tolerance of 1 also its one-deletion
neighbourhood. The allocation of tolerances, and how many empty subsets need no
entry, minimise a cost that counts index entries and expected verifications.

Of the sets that share an entry the one that shares most leads. Each set
follows the leader it shares most entries with, and the trees of followers are
dealt into blocks, so that a set is shipped once; a large tree's root goes to
each of its blocks. A block is compared exactly: elements that only one member
holds drop out, members that share too few with all others drop out, and
products of the incidence matrix count the intersections of the rest.

Entries that join sets of different blocks which no path of links connects yet
are left. Their sets meet again as parity sketches: bit h(x) of a set's sketch
is the parity of its elements there, so two sketches differ in no more bits
than their sets in elements. Only sets with a partner that this bound lets
through are compared exactly. No pairs are emitted, only the component of each
member, and no similar pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import WordHashes, as_long, byte_texts, chunks, hash_words, join_hot, materialise, mix, quoted, rolling, small_batches
from tellura.llm.components import connected_components, forest

#: Sizes of a band lie within this ratio.
BAND_RATIO = 1.45
#: Cost of verifying one element, in index entries.
VERIFY_COST = 1.0
#: Share of n-grams that many documents hold: a segment of one such n-gram says next to nothing.
COMMON = 0.001
#: Bits of an entry's key. Keys that fall together by chance cost a verification.
KEY_BITS = 48
#: Sets that are compared, up to which the table that deals them to blocks is broadcast (50 bytes each); beyond, texts are shuffled.
BROADCAST_IDS = 500_000
#: Sets and elements of a block, about.
STAR_ROWS, STAR_ELEMENTS = 1500, 2_000_000
#: Share of its entries that a set shares with the leader it follows, at least.
FOLLOW_SHARE = 0.1
#: Bits of a sketch for each element, at least (at most twice as many).
SKETCH_BITS = 2
#: Elements in a step of a product.
COLUMNS = 2048


@dataclass(frozen=True)
class Likeness:
    """n-grams of ``words`` words; sets match if ``den * intersection >= num * union``."""

    words: int = 5
    num: int = 80
    den: int = 100

    def differ(self, a: int, b: int) -> int:
        """Most elements in which matching sets of these sizes differ."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def largest(self, a: int) -> int:
        """Size of the largest set that can match one of size ``a``."""
        return a * self.den // self.num


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high`` - 1; the first ``loose`` of ``segments`` segments have tolerance 1."""

    low: int
    high: int
    segments: int
    loose: int
    spare: int  # a set with at most so many empty segments of tolerance 0 needs no entries for them


def allocate(low: int, high: int, n_sets: int, like: Likeness, verify: float = VERIFY_COST) -> Band | None:
    """The cheapest band for sizes from ``low`` to ``high`` - 1, or None where only equal sets match."""
    top = high - 1
    differ = like.differ(top, like.largest(top))
    if differ == 0:
        return None
    best, middle = None, math.sqrt(low * top)
    for loose in sorted({0, 1, 2, (differ + 1) // 4, (differ + 1) // 2}):
        for spare in sorted({0, 1, 2, *(int((differ + 1) * x) for x in (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3))}):
            segments = differ + 1 + spare - loose
            if segments < max(1, loose):
                continue
            per = middle / segments
            empty = math.exp(-per)
            mean = empty * (segments - loose)
            # share of sets with more empty segments than are spared, by the normal law of occupancy
            spread = math.sqrt(max(mean * (1 - (1 + per) * empty), 0.05))
            above = 0.5 * math.erfc((spare + 0.5 - mean) / spread / math.sqrt(2))
            entries = segments - loose + loose * (2 + per)
            # entries that say next to nothing
            groups = above * max(mean, spare + 1) + (segments - loose) * per * empty * COMMON + loose * (1 + per) * empty
            cost = entries + (verify * middle * groups if n_sets > 1 else 0)
            if best is None or cost < best[0]:
                best = cost, Band(low, high, segments, loose, spare)
    return best[1]


def band_edges(largest: int, like: Likeness, ratio: float = BAND_RATIO) -> list[int]:
    """First sizes of the bands; what matches a set lies in its band or a neighbour."""
    edges = [1]
    while edges[-1] <= largest:
        e = edges[-1]
        edges.append(max(e + 1, int(e * ratio), like.largest(e - 1) + 1))
    return edges


def shingle_sets(texts: list[bytes | None], like: Likeness, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one text after the other, and their numbers."""
    words = [t.lower().split() if t else [] for t in texts]
    hashes, counts = hash_words(words, cache)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = rolling(hashes, like.words)
    inside = doc[: len(grams)] == doc[like.words - 1 :] if len(grams) else np.empty(0, bool)
    values, owners = [grams[inside]], [doc[: len(grams)][inside]]
    starts = np.cumsum(counts) - counts
    for i in np.flatnonzero((counts > 0) & (counts < like.words)):
        values.append(mix(rolling(hashes[starts[i] : starts[i] + counts[i]], int(counts[i])) ^ np.uint64(counts[i])))
        owners.append(np.array([i]))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value, owner = value[order], owner[order]
    order = np.argsort(owner.astype(np.uint16) if len(counts) < 65536 else owner, kind="stable")
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(counts))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each stretch of ``values``; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


_A, _B, _C, _D = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def fingerprints(values: np.ndarray, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    salt = mix(np.array([seed], np.uint64) + _D)
    one, two = _sums(mix(values ^ salt ^ _A), counts), _sums(mix(values + salt + _B), counts)
    n = counts.astype(np.uint64)
    return mix(one + n * _C), mix(two ^ n * _B)


def _set_kernel(like: Likeness, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            texts = byte_texts(batch.column("_text"))
            for a, b in chunks(texts):
                values, counts = shingle_sets(texts[a:b], like, cache)
                one, two = fingerprints(values, counts, seed)
                arrays = [*[batch.column(c).slice(a, b - a) for c in ("_id", "_key")], pa.array(counts, pa.int64()), pa.array(as_long(one)), pa.array(as_long(two))]
                yield pa.RecordBatch.from_arrays(arrays, ["_id", "_key", "n", "sid", "check"])

    return run


def entries(values: np.ndarray, counts: np.ndarray, bands: list[Band | None], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index entries (keys, and the rows of ``counts`` they belong to) of sets, in the bands that ``which`` gives."""
    keys, rows = [], []
    ends = np.cumsum(counts)
    for number in np.unique(which):
        band = bands[number] if number >= 0 else None
        if band is None:
            continue
        own = np.flatnonzero(which == number)
        n = counts[own]
        at = np.repeat(ends[own] - n - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        value, row = values[at], np.repeat(np.arange(len(own)), n)
        salt = mix(np.array([number + 1], np.uint64) * _A)
        h = mix(value ^ salt)
        m = np.uint64(band.segments)
        cell = (row * band.segments + (((h >> np.uint64(32)) * m) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        part = mix(h + _C)
        size = np.bincount(cell, minlength=len(own) * band.segments)
        order = np.argsort(cell, kind="stable")
        total = _sums(part[order], size)
        segment = np.tile(np.arange(band.segments, dtype=np.uint64), len(own))
        label = mix((segment + np.uint64(1)) * _B ^ salt)
        key = mix(total + label)
        strict = segment >= np.uint64(band.loose)
        empty = (size == 0) & strict
        many = empty.reshape(len(own), -1).sum(axis=1) > band.spare
        use = ~empty | np.repeat(many, band.segments)
        keys.append(key[use])
        rows.append(np.repeat(own, band.segments)[use])
        if band.loose:  # the subsets without one element each
            out = cell[order]
            near = out % band.segments < band.loose
            keys.append(mix(total[out[near]] - part[order][near] + label[out[near]]))
            rows.append(own[out[near] // band.segments])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def probes(counts: np.ndarray, bands: list[Band | None], edges: list[int], like: Likeness) -> list[np.ndarray]:
    """For each set its own band, then the lower one if a set of that band can match it (else -1)."""
    own = np.searchsorted(np.array(edges), counts, side="right") - 1
    most = np.array([like.largest(edges[i] - 1) for i in range(len(edges))])
    below = np.where((own > 0) & (counts <= most[np.clip(own, 0, len(most) - 1)]), own - 1, -1)
    return [np.where(counts > 0, own, -1), np.where(counts > 0, below, -1)]


#: Texts that a task remembers, so that it gives the entries of copies once.
SEEN_TEXTS = 500_000


def _entry_kernel(like: Likeness, bands: list[Band | None], edges: list[int], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = WordHashes(), set()
        for batch in batches:
            texts = []
            for t in byte_texts(batch.column("_text")):
                digest = xxhash.xxh3_128_digest(t) if t else None
                if t and digest not in seen:
                    texts.append(t)
                    seen.add(digest)
            if len(seen) > SEEN_TEXTS:
                seen.clear()
            for a, b in chunks(texts):
                values, counts = shingle_sets(texts[a:b], like, cache)
                sid, _ = fingerprints(values, counts, seed)
                for which in probes(counts, bands, edges, like):
                    keys, rows = entries(values, counts, bands, which)
                    if len(keys):
                        keys >>= np.uint64(64 - KEY_BITS)
                        yield pa.RecordBatch.from_arrays([pa.array(as_long(keys)), pa.array(as_long(sid[rows]))], ["gid", "sid"])

    return run


def _pack_kernel(like: Likeness, seed: int):
    """``batches`` with the text replaced by its packed set, where that is the set ``sid`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            texts, wanted = byte_texts(batch.column("_text")), np.asarray(batch.column("sid"))
            names = [c for c in batch.schema.names if c != "_text"]
            for a, b in chunks(texts):
                values, counts = shingle_sets(texts[a:b], like, cache)
                sid, _ = fingerprints(values, counts, seed)
                same = np.flatnonzero(as_long(sid) == wanted[a:b])
                packed = [x.tobytes() for x in np.split(values, np.cumsum(counts)[:-1])]
                part = batch.slice(a, b - a).take(pa.array(same))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array([packed[i] for i in same.tolist()], pa.binary())], [*names, "set"])

    return run


def matches(sets: list[np.ndarray], like: Likeness) -> np.ndarray:
    """Matrix of the pairs of different sorted sets that match."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros((len(sets), len(sets)), bool)
    live = np.arange(len(sets))
    value, owner = np.concatenate(sets), np.repeat(live, n)
    _, value = np.unique(value, return_inverse=True)
    while True:  # what matches a set shares enough of its elements
        held = np.bincount(value, minlength=value.max(initial=0) + 1)
        shared = held[value] > 1
        value, owner = value[shared], owner[shared]
        enough = like.den * np.bincount(owner, minlength=len(sets)) >= like.num * n
        stay = live[enough[live]]
        if len(stay) == len(live):
            break
        keep = enough[owner]
        value, owner, live = value[keep], owner[keep], stay
    if len(live) < 2:
        return out
    place = np.zeros(len(sets), np.int64)
    place[live] = np.arange(len(live))
    _, column = np.unique(value, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, row = column[order], place[owner[order]]
    common = np.zeros((len(live), len(live)), np.float32)
    for first in range(0, int(column[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(live), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    size = n[live]
    linked = (like.den + like.num) * common.astype(np.int64) >= like.num * (size[:, None] + size)
    np.fill_diagonal(linked, False)
    out[np.ix_(live, live)] = linked
    return out


def sketch(values: np.ndarray) -> bytes:
    """Parities of the elements at each of the sketch's bits, a power of two by the set's size."""
    bits = 1 << max(6, math.ceil(math.log2(max(1, SKETCH_BITS * len(values)))))
    return np.packbits((np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def _signs(sketches: list[bytes], size: int) -> np.ndarray:
    """Rows of +1 and -1, folded to ``size`` bytes: the halves of a sketch are one of half the size by exclusive or."""
    x = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)
    while x.shape[1] > size:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return 1 - 2 * np.unpackbits(x, axis=1).astype(np.float32)


def possible(sketches: list[bytes], n: np.ndarray, comp: np.ndarray, block: np.ndarray, like: Likeness) -> np.ndarray:
    """Which sets have a partner of another component and block whose sketch, and size, allow a match."""
    size = np.fromiter(map(len, sketches), np.int64, len(sketches))
    out = np.zeros(len(sketches), bool)
    for level in np.unique(size):
        own, other = np.flatnonzero(size == level), np.flatnonzero((size >= level) & (size * like.num <= 2 * level * like.den))
        y = np.concatenate([_signs([sketches[i] for i in other[size[other] == s]], level) for s in np.unique(size[other])])
        other = np.concatenate([other[size[other] == s] for s in np.unique(size[other])])
        for first in range(0, len(own), 512):
            rows = own[first : first + 512]
            differ = (8 * level - _signs([sketches[i] for i in rows], level) @ y.T) / 2
            ok = differ <= (n[rows][:, None] + n[other]) * (like.den - like.num) // (like.den + like.num)
            ok &= (comp[rows][:, None] != comp[other]) & (block[rows][:, None] != block[other])
            i, j = np.nonzero(ok)
            out[rows[i]] = True
            out[other[j]] = True
    return out


def _block_kernel(like: Likeness):
    """Rows (sid, head, sketch): a link of each set to the first of its component in the block, and its sketch where it is at home."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sid, home = (np.asarray(group.column(c).combine_chunks()) for c in ("sid", "home"))
        sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
        head = sid[forest(matches(sets, like))]
        sketches = [sketch(s) if h == key[1].as_py() else None for s, h in zip(sets, home.tolist())]
        return pa.table({"sid": pa.array(sid), "head": pa.array(head), "sketch": pa.array(sketches, pa.binary())})

    return run


def _sift_kernel(like: Likeness):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        sid, n, comp, root, home = (np.asarray(group.column(c).combine_chunks()) for c in ("sid", "n", "comp", "root", "home"))
        block = np.unique(np.stack([root, home]), axis=1, return_inverse=True)[1].reshape(-1)
        left = possible(group.column("sketch").to_pylist(), n, comp, block, like)
        return pa.table({"leader": pa.array(np.full(left.sum(), key[0].as_py()), pa.int64()), "sid": pa.array(sid[left])})

    return run


def _star_kernel(like: Likeness):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        sid = np.asarray(group.column("sid").combine_chunks())
        sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
        head = sid[forest(matches(sets, like))]
        some = head != sid
        return pa.table({"a": pa.array(sid[some]), "b": pa.array(head[some])})

    return run


def _parts(members: str | Column, elements: Column, most: int) -> Column:
    return F.greatest(F.ceil(F.col(members) / STAR_ROWS), F.ceil(elements / most), F.lit(1)).cast("int")


def _home(parts: Column) -> Column:
    return F.pmod(F.xxhash64("sid"), parts).cast("int")


def _members(groups: DataFrame) -> DataFrame:
    """The entries (gid, sid) that different sets share; all entries are shuffled once."""
    placed = groups.repartition("gid")
    shared = placed.groupBy("gid").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("gid")
    return materialise(placed.join(shared.hint("shuffle_hash"), "gid").select("gid", "sid").distinct(), "groups")


def _trees(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (gid, leader), and rows (sid, root): the tree of followers that a set belongs to.

    The leader of an entry is the member that is in most groups; sets follow only leaders that are in more.
    """
    weight = materialise(members.groupBy("sid").agg(F.count("*").alias("weight")), "weights")
    leaders = materialise(members.join(weight, "sid").groupBy("gid").agg(F.max_by("sid", F.struct("weight", "sid")).alias("leader")), "leaders")
    shared = members.join(leaders, "gid").where("leader <> sid").groupBy("leader", "sid").agg(F.count("*").alias("shared"))
    strong = shared.join(weight, "sid").where(F.col("shared") >= FOLLOW_SHARE * F.col("weight")).select("leader", "sid", "shared")
    heavy = weight.select(F.col("sid").alias("leader"), F.col("weight").alias("of_leader"))
    parents = strong.join(heavy, "leader").groupBy("sid").agg(F.max_by("leader", F.struct("shared", "of_leader", "leader")).alias("parent"))
    now = materialise(weight.select("sid").join(parents, "sid", "left").select("sid", F.coalesce("parent", "sid").alias("root")), "trees")
    while True:  # each step doubles the way up
        up = now.select(F.col("sid").alias("root"), F.col("root").alias("top"))
        now = materialise(now.join(up, "root").select("sid", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "trees")
        if not now.where("moved").limit(1).count():
            return leaders, now.select("sid", "root")


def _by_pairs(stars: DataFrame, most: int) -> DataFrame:
    """Rows (leader, sid, n, ...) dealt to pairs (i, j) of a star's parts; a small star is one part."""
    extent = stars.groupBy("leader").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    dealt = stars.join(extent.select("leader", _parts("members", F.col("elements"), most).alias("parts")), "leader").withColumn("part", _home(F.col("parts")))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")))
    return dealt.withColumn("other", F.explode(others)).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("parts", "part", "other")


def similar_classes(docs: DataFrame, like: Likeness, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Sets (_id, _key, n, sid) of all rows, _key a hash of the text, where equal sets have equal sid, and (node, component) of the sets that match others."""
    small_batches(docs.sparkSession, 500)
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    seed = 0
    while True:
        keyed = rows.select("_id", "_text", F.xxhash64("_text").alias("_key"))
        sets = materialise(keyed.mapInArrow(_set_kernel(like, seed), f"_id {id_type}, _key long, n long, sid long, check long"), "sets")
        least = F.min(F.struct("_id", "_key")).alias("row")
        classes = sets.where("n > 0").groupBy("sid").agg(F.min("n").alias("n"), least, F.min("check").alias("low"), F.max("check").alias("high"))
        classes = materialise(classes.select("sid", "n", "row._id", "row._key", "low", "high"), "classes")
        # one 64-bit hash names a set from here on; were two sets to share it, another seed would part them
        if classes.where("low <> high").limit(1).count() == 0:
            break
        seed += 1
    largest = classes.agg(F.max("n")).first()[0] or 0
    edges = band_edges(largest, like)
    spans = F.array(*[F.lit(e) for e in edges])
    number = (F.size(F.filter(spans, lambda e: e <= F.col("n"))) - 1).alias("band")
    filled = {r["band"]: r["count"] for r in classes.select(number).groupBy("band").count().collect()}  # a row for each band: tens
    bands = [allocate(edges[i], edges[i + 1], filled.get(i, 0) + filled.get(i + 1, 0), like) for i in range(len(edges) - 1)]
    members = _members(rows.select("_text").mapInArrow(_entry_kernel(like, bands, edges, seed), "gid long, sid long"))
    leaders, trees = _trees(members)

    sized = trees.join(classes.select("sid", "n", "_id", "_key"), "sid")
    extent = sized.groupBy("root").agg(F.count("*").alias("members"), F.sum("n").alias("elements"))
    parts = extent.select("root", _parts("members", F.col("elements"), STAR_ELEMENTS).alias("parts"))
    placed = materialise(sized.join(parts, "root").withColumn("home", _home(F.col("parts"))), "blocks")
    spread = F.when(F.col("sid") == F.col("root"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))

    def packed(wanted: DataFrame, extra: str) -> DataFrame:
        """The sets of ``wanted`` (_id, _key, sid, ...), made again from their texts; rows that repeat an id and a text give several."""
        wanted = wanted.withColumnsRenamed({"_id": "_wanted", "_key": "_text_key"})
        if wanted.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = rows.withColumn("_key", F.xxhash64("_text"))
        texts = texts.join(wanted, (texts["_key"] == wanted["_text_key"]) & texts["_id"].eqNullSafe(wanted["_wanted"]))
        names = [c for c in wanted.columns if c not in ("_wanted", "_text_key")]
        return texts.select("_text", *names).mapInArrow(_pack_kernel(like, seed), f"{extra}, set binary")

    home = packed(placed.select("_id", "_key", "sid", "root", "home", spread.alias("spread")), "sid long, root long, home int, spread array<int>")
    blocks = home.select("sid", "root", "home", F.explode("spread").alias("part"), "set").repartition("root", "part").dropDuplicates(["root", "part", "sid"])
    judged = materialise(blocks.groupBy("root", "part").applyInArrow(_block_kernel(like), "sid long, head long, sketch binary"), "judged")
    links = judged.where("sid <> head").select(F.col("sid").alias("a"), F.col("head").alias("b"))
    found = connected_components(links)

    state = placed.join(found, F.col("sid") == F.col("node"), "left").select("sid", "n", "_id", "_key", F.coalesce("component", "sid").alias("comp"), "root", "home")
    state = materialise(state, "state")
    at = F.struct("root", "home")
    apart = members.join(state.select("sid", "comp", "root", "home"), "sid").groupBy("gid").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min(at).alias("e"), F.max(at).alias("f"))
    stars = members.join(apart.where("c < d and e < f").select("gid"), "gid").join(leaders, "gid").select("leader", "sid").distinct()
    stars = stars.join(state.drop("_id", "_key"), "sid").join(judged.where("sketch is not null").select("sid", "sketch"), "sid")
    sifted = _by_pairs(stars, 16 * STAR_ELEMENTS).groupBy("leader", "i", "j").applyInArrow(_sift_kernel(like), "leader long, sid long")
    left = materialise(sifted.distinct(), "left")
    if left.limit(1).count():
        again = left.join(state.select("sid", "n"), "sid")
        sets_of = packed(left.select("sid").distinct().join(state, "sid").select("_id", "_key", "sid"), "sid long").dropDuplicates(["sid"])
        more = _by_pairs(again, STAR_ELEMENTS).join(sets_of, "sid").groupBy("leader", "i", "j").applyInArrow(_star_kernel(like), "a long, b long")
        found = connected_components(materialise(links.unionByName(more), "links"))
    return sets.select("_id", "_key", "n", "sid"), found


def join_documents(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id (least id that links reach) of each row.

    Null, empty and blank texts have no n-grams and are components of their
    own; a text of fewer words than an n-gram is one n-gram as a whole. Equal
    sets are linked. Rows that repeat an id or a whole row stay and fall
    together where they are equal; null ids are ids like others, and the
    component of null ids only is null. Other columns play no part; an empty
    table gives an empty one. n-grams are told apart by 64-bit hashes.
    """
    rows, member = _judged(docs, like, id_col, text_col)
    found = join_hot(rows, member, "sid", "copies", "_id")
    return found.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))


def _judged(docs: DataFrame, like: Likeness, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (_id, _key, n, sid), sid null for empty sets, and rows (sid, copies, component, component_id, head): the least row (id, key) of a component is its head."""
    sets, found = similar_classes(docs, like, id_col, text_col)
    classes = sets.where("n > 0").groupBy("sid").agg(F.min("_id").alias("least"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_key")).alias("row"), F.count("*").alias("copies"))
    joined = classes.join(found, classes["sid"] == found["node"], "left").select("sid", "least", "row", "copies", F.coalesce("component", "sid").alias("component"))
    heads = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.min("row").alias("head"))
    member = materialise(joined.select("sid", "copies", "component").join(heads, "component"), "members")
    return sets.withColumn("sid", F.when(F.col("n") > 0, F.col("sid"))), member


def first_documents(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of similar documents the one of the least id, with all columns; no row is without its group.

    Null ids come last; of rows that share an id and are similar, that of the
    least text hash stays, and of rows that repeat an id and a text, one.
    Rows that share an id but not their group are judged alone. Null, empty
    and blank texts have no n-grams and stay, all of them. An empty table gives
    an empty one.
    """
    _, member = _judged(docs, like, id_col, text_col)
    heads = member.select("component", "head").distinct().select(F.col("head._id").alias("id"), F.col("head._key").alias("key"))
    names = docs.columns
    text = quoted(text_col)
    rows = docs.select(F.struct(*[quoted(c) for c in names]).alias("row"), quoted(id_col).alias("doc"), text.alias("text"), F.xxhash64(text).alias("hash"))
    blank = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", "")) == 0
    out = rows.where(blank)
    kept = rows.where(~blank).join(heads, (F.col("hash") == F.col("key")) & F.col("doc").eqNullSafe(F.col("id")), "left_semi")
    whole = kept.groupBy("doc", "hash").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if whole:  # rows that repeat an id and a text
        kept = kept.groupBy("doc", "hash").agg(F.first("row").alias("row"))
    return out.select("row").unionByName(kept.select("row")).select(*[F.col("row")[c].alias(c) for c in names])
