"""Connected components of an edge table: union-find in each task, then alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm._shared import Scratch

EDGES = "src long, dst long"


class Forest:
    """Union-find with the smallest id as the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def contracted(edges: DataFrame) -> DataFrame:
    """The same components with one edge per node and task: (src, root of src in that task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.join(a, b)
        nodes = list(forest.parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["src", "dst"])

    return edges.select("src", "dst").mapInArrow(run, EDGES)


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """node, component: the smallest node that each node of the edges (src, dst) can reach.

    Each round links the larger neighbours of a node to its smallest one, then the smaller ones,
    until all edges lead to the smallest node of their component; a round halves long paths.
    Every table of a round is written, so a lost executor costs one round.
    """
    now = scratch.write(contracted(edges), f"{name}0")
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        small = large.groupBy("src").agg(F.min("dst").alias("m"))
        joined = large.join(small, "src")
        star = joined.filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(small.select("src", F.col("m").alias("dst")))
        k += 1
        now = scratch.write(star.distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        fresh = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("dst").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("src", "dst"))).first())
        if fresh == state:
            break
        state = fresh
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
