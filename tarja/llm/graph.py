"""Connected components by alternating large and small stars, on DataFrames, a written table each round.

Each round leaves fewer edges between nodes that are not yet known to be one; once `few` edges are left, a bound that no input
moves, one task joins them with a union-find. The tests hold both ways against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarja.llm.common import written

FEW = 400_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and the smallest node each reaches: minima over edges, then pointers to pointers, until nothing changes."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            nodes, root = smallest_reachable(*(np.concatenate(x) for x in zip(*got)))
            for i in range(0, len(nodes), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(root[i : i + (1 << 16)])], names=["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b), both long.

    A written table. Rounds grow with the logarithm of the longest path. Minima are pre-aggregated; the joins on a star's centre are plain
    equi-joins, whose hot keys adaptive execution splits.
    """
    first = now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().persist()
    try:
        return written(_joined(now, rounds, few), "components")
    finally:
        first.unpersist()


def _joined(now: DataFrame, rounds: int, few: int) -> DataFrame:
    mark = None
    for _ in range(rounds):
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new[0] <= few:
            return _in_one_task(now)
        if tuple(new) == mark:
            break
        mark = tuple(new)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("shuffle_merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    else:
        raise RuntimeError(f"the components are not found after {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
