"""Connected components of a graph that may not fit on one machine."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tellura.llm.common import fresh_path, materialise, remove


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for the nodes of ``edges`` (longs): the least node that each reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each
    links the neighbours of a node to the least of them, on the side above or
    below the node, until nothing changes; the number of steps grows with the
    logarithm of the longest path. Each step writes its edges to the shared
    folder, so lineage stays short. Self-links and nulls are ignored.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    now = materialise(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    seen = None
    paths: list[str] = []
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        path = fresh_path(spark, "edges")
        now = materialise(small.select("e.u", "e.v").where("u <> v").distinct(), "edges", path)
        paths.append(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        for old in paths[:-1]:
            remove(spark, old)
        paths = paths[-1:]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def forest(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the first node of its component."""
    head = np.arange(len(links))
    seen = ~links.any(axis=1)
    for start in np.flatnonzero(~seen):
        if seen[start]:
            continue
        front = np.array([start])
        seen[start] = True
        while len(front):
            near = links[front].any(axis=0) & ~seen
            head[near] = start
            seen |= near
            front = np.flatnonzero(near)
    return head
