"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Equal vectors form a class and count once. Each unit vector x is held as s q + e
with int8 numbers q, a scale s and the norm |e|, so that
``|x.y - s_x s_y q_x.q_y| <= |e_x| + |e_y| + |e_x| |e_y|``. Blocks of int8
vectors are shipped, and tiles of exact integer products tell pairs that are
surely above the threshold, surely below it, or neither; only vectors of pairs
that are neither meet again in double precision. Blocks of vectors near the
same pivot are compared only if the angle between their centres, less their
radii, allows a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import join_hot, materialise, quoted
from tellura.llm.components import connected_components, forest

#: Vectors of a block, about.
BLOCK_ROWS = 4096
#: Rows of a strip of a tile.
STRIP = 512
#: Vectors, by least hash, whose directions part the table into cells.
PIVOTS = 32
#: Dimensions whose int8 products add up exactly in single precision: 1,024 * 127^2 < 2^24.
EXACT = 1024


def slack(dim: int) -> float:
    """Above what the rounding of double precision adds to a bound: sums of ``dim`` products of numbers whose squares add up to 1 or so."""
    return 16 * (dim + 16) * 2.0**-53


def sound(v: Column) -> Column:
    """Whether a vector has a direction: no null or non-finite component, not zero."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one dimension as unit vectors in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 numbers, scales and the norms of what they leave out."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    left = x - q * scale[:, None]
    return q, scale, np.sqrt((left * left).sum(axis=1))


def products(qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows: single-precision ones of up to EXACT dimensions at a time, added in double precision."""
    out = np.zeros((len(qx), len(qy)))
    for a in range(0, qx.shape[1], EXACT):
        out += qx[:, a : a + EXACT].astype(np.float32) @ qy[:, a : a + EXACT].astype(np.float32).T
    return out


@dataclass(frozen=True)
class Tile:
    """A block of vectors as int8 numbers, scales and error norms, with their classes' ids and sizes."""

    q: np.ndarray
    s: np.ndarray
    e: np.ndarray
    cid: np.ndarray
    n: np.ndarray


def sift(x: Tile, y: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs surely have a cosine of at least ``threshold``, and which may or may not."""
    sure, may = np.zeros((len(x.q), len(y.q)), bool), np.zeros((len(x.q), len(y.q)), bool)
    for a in range(0, len(x.q), STRIP):
        rows = slice(a, a + STRIP)
        about = products(x.q[rows], y.q) * x.s[rows, None] * y.s
        error = x.e[rows, None] + y.e * (1 + x.e[rows, None]) + slack(x.q.shape[1])
        sure[rows] = about - error >= threshold
        may[rows] = (about + error >= threshold) & ~sure[rows]
    return sure, may


LINKS = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("head", pa.int64()), ("i", pa.int64()), ("j", pa.int64())])


def _link_rows(linked: np.ndarray, x: Tile, y: Tile, same: bool) -> list[np.ndarray]:
    """cid, links and head of the classes of a tile that are linked in it."""
    if same:
        counts, ids, links = linked @ x.n, x.cid, linked
    else:
        counts, ids = np.concatenate([linked @ y.n, linked.T @ x.n]), np.concatenate([x.cid, y.cid])
        rows = np.flatnonzero(counts)
        a, b = rows[rows < len(x.n)], rows[rows >= len(x.n)] - len(x.n)
        links = np.zeros((len(rows), len(rows)), bool)
        links[: len(a), len(a) :] = linked[np.ix_(a, b)]
        links |= links.T
        counts, ids = counts[rows], ids[rows]
    head = ids[forest(links)] if len(ids) else ids
    some = counts > 0
    return [ids[some], counts[some].astype(np.int64), head[some]]


def _tile(packed: dict) -> Tile:
    cid = np.frombuffer(packed["cid"], np.int64)
    return Tile(np.frombuffer(packed["q"], np.int8).reshape(len(cid), -1), *(np.frombuffer(packed[c], np.float64) for c in ("s", "e")), cid, np.frombuffer(packed["n"], np.int64))


def _pair_kernel(threshold: float):
    """For a pair of blocks its sure links (cid, links, head, null, null), and (cid, null, null, i, j) of vectors with a pair that is not sure."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in key)
        tiles = {r["block"]: _tile(r["tile"]) for r in group.to_pylist()}
        x, y = tiles[first], tiles[second]
        sure, may = sift(x, y, threshold)
        if first == second:
            np.fill_diagonal(sure, False)
            np.fill_diagonal(may, False)
        cid, links, head = _link_rows(sure, x, y, first == second)
        open_ = np.concatenate([x.cid[may.any(axis=1)], y.cid[may.any(axis=0)]])
        open_ = np.unique(open_)
        none, more = [None] * len(cid), [None] * len(open_)
        columns = [np.concatenate([cid, open_]), links.tolist() + more, head.tolist() + more, none + [first] * len(open_), none + [second] * len(open_)]
        return pa.table([pa.array(c, t) for c, t in zip(columns, LINKS.types)], schema=LINKS)

    return run


def _exact_kernel(threshold: float):
    """Links in double precision of the pairs that were not sure."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in key)
        block = np.asarray(group.column("block").combine_chunks())
        held = [group.filter(pa.array(block == b)) for b in ((first,) if first == second else (first, second))]
        tiles = [Tile(np.frombuffer(b"".join(p.column("q").to_pylist()), np.int8).reshape(p.num_rows, -1), *(np.asarray(p.column(c).combine_chunks()) for c in ("s", "e", "cid", "n"))) for p in held]
        vectors = [units(p.column("v")) for p in held]
        x, y, xv, yv = tiles[0], tiles[-1], vectors[0], vectors[-1]
        _, may = sift(x, y, threshold)
        if first == second:
            np.fill_diagonal(may, False)
        i, j = np.nonzero(may)
        for c in range(0, len(i), 200_000):
            p, q = i[c : c + 200_000], j[c : c + 200_000]
            may[p, q] = np.einsum("ij,ij->i", xv[p], yv[q]) >= threshold
        cid, links, head = _link_rows(may, x, y, first == second)
        return pa.table({"cid": pa.array(cid, pa.int64()), "links": pa.array(links, pa.int64()), "head": pa.array(head, pa.int64())})

    return run


def _quantise_kernel(pivots: dict[int, np.ndarray]):
    """``batches`` of (cid, n, dim, v) with the int8 numbers, scale and error norm, and the nearest pivot as cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = units(part.column("v"))
                q, s, e = quantise(x)
                cell = np.argmax(x @ pivots[int(d)].T, axis=1)
                columns = [pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s), pa.array(e), pa.array(cell, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, "q", "s", "e", "cell"])

    return run


TILE = "struct<q: binary, s: binary, e: binary, cid: binary, n: binary>"


def _tile_kernel(key: tuple, group: pa.Table) -> pa.Table:
    """A block as one row: its tile, a centre, and a radius that no angle of a vector to the centre exceeds."""
    q = np.frombuffer(b"".join(group.column("q").to_pylist()), np.int8).reshape(group.num_rows, -1)
    s, e, cid, n = (np.asarray(group.column(c).combine_chunks()) for c in ("s", "e", "cid", "n"))
    x = q * s[:, None]
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))  # within an angle of asin(e) <= 1.6 e of the vector
    mean = x.mean(axis=0)
    size = math.sqrt(float(mean @ mean))
    centre = mean / size if size > 1e-9 else x[0]
    radius = float(np.max(np.arccos(np.clip(x @ centre, -1, 1)) + 1.6 * e)) + 1e-6
    tile = {"q": q.tobytes(), "s": s.tobytes(), "e": e.tobytes(), "cid": cid.tobytes(), "n": n.tobytes()}
    kinds = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("tile", pa.struct([(c, pa.binary()) for c in tile]))])
    return pa.table({"block": [key[0].as_py()], "dim": [q.shape[1]], "centre": [centre.tolist()], "radius": [radius], "tile": [tile]}, schema=kinds)


def _partner_kernel(bounds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], angle: float):
    """Pairs (i, j), i <= j, of blocks that may hold a pair of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in np.asarray(batch.column("id")):
                for ids, centres, radius in bounds.values():
                    for at in np.flatnonzero(ids == block):
                        near = ids[(np.arccos(np.clip(centres @ centres[at], -1, 1)) <= radius + radius[at] + angle) & (ids >= block)]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), block)), pa.array(near)], ["i", "j"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col``, n_links, component_id and kept (id equals component_id) of each row.

    Vectors of different lengths are not compared. Vectors that are null,
    zero, empty or hold null or non-finite components have no links and are
    components of their own. Copies are linked with each other and have the
    same links. Rows that repeat an id stay; null ids are ids like others.
    Other columns play no part; an empty table gives an empty one.
    """
    v = quoted(vector_col).cast("array<double>")
    rows = vectors.select(quoted(id_col).alias("_id"), F.when(sound(v), v).alias("v"))
    classes = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("n"), F.min("_id").alias("least"))
    classes = materialise(classes.select("v", "n", "least", F.size("v").alias("dim")).withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row for each length of vectors
    if sizes:
        links = _links(classes, sizes, threshold, block_rows)
        counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
        parts = connected_components(links.select(F.col("cid").alias("a"), F.col("head").alias("b")))
        known = classes.join(counts, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
        heads = known.groupBy("component").agg(F.min("least").alias("component_id"))
        known = known.join(heads, "component").select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    else:
        known = classes.select("v", "n", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    found = join_hot(rows, materialise(known, "vector-links"), "v", "n", "_id").withColumn("component_id", F.when(F.col("v").isNull(), F.col("_id")).otherwise(F.col("component_id")))
    return found.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, sizes: dict[int, int], threshold: float, block_rows: int) -> DataFrame:
    """Rows (cid, links, head) for each pair of blocks: links of a class into it, and a class that it reaches there."""
    pivots = {}
    for dim, count in sizes.items():
        want = min(PIVOTS, max(1, count // block_rows))
        drawn = classes.where(F.col("dim") == dim).orderBy(F.xxhash64("v")).limit(want).select("v").collect()  # PIVOTS rows at most
        pivots[dim] = units(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())))
    shape = "cid long, n long, dim int, v array<double>, q binary, s double, e double, cell long"
    celled = materialise(classes.select("cid", "n", "dim", "v").mapInArrow(_quantise_kernel(pivots), shape), "cells")
    block, first = F.lit(None).cast("long"), 0
    for r in sorted(celled.groupBy("dim", "cell").count().collect(), key=lambda r: (r["dim"], r["cell"])):  # PIVOTS rows for a length
        parts = math.ceil(r["count"] / block_rows)
        here = (F.col("dim") == r["dim"]) & (F.col("cell") == r["cell"])
        block = F.when(here, first + F.pmod(F.xxhash64("cid"), F.lit(parts))).otherwise(block)
        first += parts
    blocks = celled.withColumn("block", block)
    tiles = blocks.select("block", "q", "s", "e", "cid", "n").groupBy("block").applyInArrow(_tile_kernel, f"block long, dim int, centre array<double>, radius double, tile {TILE}")
    tiles = materialise(tiles, "tiles")
    meta = tiles.select("block", "dim", "centre", "radius").collect()  # a row for each block
    angle = math.acos(min(1.0, max(-1.0, threshold))) + 1e-6
    bounds = {}
    for dim in sizes:
        own = [m for m in meta if m["dim"] == dim]
        bounds[dim] = np.array([m["block"] for m in own]), np.array([m["centre"] for m in own]), np.array([m["radius"] for m in own])
    pairs = classes.sparkSession.range(first).mapInArrow(_partner_kernel(bounds, angle), "i long, j long")
    ends = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    met = ends.join(tiles.select("block", "tile"), "block")
    sifted = materialise(met.groupBy("i", "j").applyInArrow(_pair_kernel(threshold), "cid long, links long, head long, i long, j long"), "block-links")
    again = sifted.where("i is not null").select("cid", "i", "j").join(blocks.select("cid", "block", "q", "s", "e", "n", "v"), "cid")
    exact = again.groupBy("i", "j").applyInArrow(_exact_kernel(threshold), "cid long, links long, head long")
    return materialise(sifted.where("i is null").select("cid", "links", "head").unionByName(exact), "all-links")
