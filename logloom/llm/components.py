"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is two grouped minima and two joins, so a vertex with very many links is pre-aggregated before its shuffle
and its rows can be split in the joins; no component is ever gathered. The links of each round are written to the
shared folder, which cuts the lineage. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, saved, tidy


class Forest:
    """Union-find over dense indices; the smaller index becomes the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the links with the smallest vertex that these links join it to, roots left out."""
    ids, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(ids))
    for x, y in zip(inverse[: len(a)].tolist(), inverse[len(a) :].tolist(), strict=True):
        forest.union(x, y)
    root = np.array([forest.find(i) for i in range(len(ids))], np.int64)
    other = root != np.arange(len(ids))
    return ids[other], ids[root[other]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each record batch as stars."""
    for batch in batches:
        if batch.num_rows:
            u, v = stars(*(np.asarray(c) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every vertex that has a smaller one in its component; others are their own component.

    ``links`` has long ids that are not null, in any order, repeated or not; a link of a vertex to itself counts for
    nothing. An empty table gives no rows.
    """
    pair = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = saved(pair.mapInArrow(tidy(contracted), "u long, v long").distinct(), "links")
    state = None
    while True:
        sums = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not sums["n"] or state == (sums["n"], sums["x"]):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = sums["n"], sums["x"]
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        large = saved(large.where("u > v"), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small, "links")
        discard(edges)
        discard(large)
        edges = after
