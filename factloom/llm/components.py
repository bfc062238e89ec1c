"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a join with a minimum by node, and its result is written to the shared
folder, so lineage stays short and nothing is collected. A node of very many edges
meets one row of minima, which adaptive execution splits. Ends when a round changes
nothing; the rounds grow with the logarithm of the longest chain.

Before that, each task turns what edges it reads, up to FEW at a time, into stars around
their smallest nodes. A table of FEW edges in all is done with this: the rounds, each of
some eight jobs with all shuffle partitions, would cost the driver far more than its rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

#: Edges whose stars are found in one go, whatever the number of all.
FEW = 1 << 16


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that it is linked with."""
    plain = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    few = _state(plain)[0] <= FEW
    stars = (plain.coalesce(1) if few else plain).mapInArrow(_stars, "a long, b long")
    now = written(stars if few else stars.distinct(), "edges")
    dropped(plain)
    state = None if few else _state(now)
    while not few:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        dropped(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select("b", "b").distinct())


def _stars(batches):
    """Of edges (a, b), FEW at a time: an edge from each node to the smallest that it is linked with by these."""
    held, rows = [], 0

    def done():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
            forest.join(x, y)
        top = np.array([forest.find(k) for k in range(len(nodes))])
        below = top != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[top[below]])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and rows + batch.num_rows > FEW:
            yield done()
            held, rows = [], 0
        held.append([batch.column(k).to_numpy() for k in range(2)])
        rows += batch.num_rows
    if held:
        yield done()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


class Forest:
    """Union-find over 0..n-1 that counts its trees."""

    def __init__(self, n: int):
        self.up, self.trees = list(range(n)), n

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.trees -= 1
        return x != y
