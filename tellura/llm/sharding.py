"""Sharding by a hierarchical weighted hash tree.

A document descends the tree region, rack, shard. On each level every child
draws ``-ln(u) / weight`` with its own ``u`` from the key and the child's path,
and the least draw wins, so a child gets its share by weight. A change of one
child's weight moves keys only into it or out of it: movement stays in the
subtrees whose weights change, and there it follows the same law.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tellura.llm.common import uniform

#: Shards of the fleet as built: regions of racks of shards, all of weight 1.
FLEET = (4, 2, 5)
#: Parts in which the rows of a shard are numbered, each by its own task.
SLOT_BINS = 1024


@dataclass(frozen=True)
class Node:
    """A shard (``shard`` set, no children) or an inner node; an inner node weighs what its shards weigh."""

    path: str
    children: tuple["Node", ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def layout(n_shards: int, fleet: tuple[int, int, int] = FLEET) -> Node:
    """The tree of ``n_shards`` shards.

    The shards of the built fleet fill its regions and racks in order. Each
    shard beyond them opens a region of its own, so that it takes keys only
    into itself, from everywhere in proportion. A tree of fewer shards than
    the fleet has is refused: one more shard would open a rack or a region
    beside others and draw keys into these too. Give a smaller ``fleet``.
    """
    regions, racks, per_rack = fleet
    built = regions * racks * per_rack
    if n_shards < max(1, built):
        raise ValueError(f"{n_shards} shards are fewer than the {built} of the fleet {fleet}")
    tree: list[Node] = []
    for r in range(regions):
        rows = []
        for k in range(racks):
            first = (r * racks + k) * per_rack
            rows.append(Node(f"r{r}/k{k}", tuple(Node(f"r{r}/k{k}/s{s}", shard=s) for s in range(first, first + per_rack))))
        tree.append(Node(f"r{r}", tuple(rows)))
    for s in range(built, n_shards):
        r = regions + s - built
        tree.append(Node(f"r{r}", (Node(f"r{r}/k0", (Node(f"r{r}/k0/s{s}", shard=s),)),)))
    return Node("", tuple(tree))


def place(key: Column, tree: Node, seed: int = 0) -> Column:
    """The shard of ``key`` in ``tree``; a null key is a key of its own."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    if len(tree.children) == 1:
        return place(key, tree.children[0], seed)
    draws = [F.struct((-F.log(uniform(key, seed, c.path)) / c.weight).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(tree.children)]
    won = F.array_min(F.array(*draws))["i"]
    if all(c.shard is not None for c in tree.children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in tree.children]), won + 1)
    out = None
    for i, c in enumerate(tree.children):
        out = F.when(won == i, place(key, c, seed)) if out is None else out.when(won == i, place(key, c, seed))
    return out


def assign_shards(
    docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", extra: Sequence[str] = (), seed: int = 0, bins: int = SLOT_BINS, fleet: tuple[int, int, int] = FLEET
) -> DataFrame:
    """Shard and slot of each row, with its size and what a fleet of one more shard would hold.

    Columns: ``id_col``, ``extra``, size, text_crc32, shard, slot, grown_shard.
    The id and the number of shards, at least those of ``fleet``, decide the
    shard; one more shard takes rows only into itself. Slots number the rows of
    a shard without gaps, in order of (bin, id, checksum, size), where the bin
    is a hash of the id: the rows of a shard are counted by bin and numbered
    bin by bin, so no task holds a shard. Null texts have size 16 and the
    checksum of the empty text; rows with equal ids (null too) share a shard
    and have slots of their own; an empty table gives an empty one; other
    columns of ``docs`` play no part, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col(id_col)
    placed = docs.select(
        F.struct(key.alias("id"), *[F.col(c) for c in extra]).alias("keep"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        place(key, layout(n_shards, fleet), seed).alias("shard"),
        place(key, layout(n_shards + 1, fleet), seed).alias("grown_shard"),
        F.floor(uniform(key, seed, "slot") * bins).cast("int").alias("bin"),
    )
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "bin").count()
    offsets = counts.select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    if n_shards * bins <= 200_000:  # rows at most, whatever the table's size
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "bin").orderBy("keep.id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(offsets, ["shard", "bin"])
        .select(
            F.col("keep.id").alias(id_col), *[F.col(f"keep.{c}").alias(c) for c in extra], "size", "text_crc32", "shard",
            (F.col("first") + F.col("at")).alias("slot"), "grown_shard",
        )
    )
