"""Connected components of a link table, by alternating large-star and small-star.

Links never leave the cluster.  A hub's minimum is found by an aggregate with a
partial step and brought back by an equi-join that adaptive execution can split,
so a hub with many links is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node link to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    linked = both.where(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("w"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours link to the least of these.  Here u > v in every row."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    linked = edges.join(least, F.col("u") == F.col("w"))
    rows = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select(F.col("w").alias("u"), F.col("m").alias("v"))
    )
    return rows.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """Columns node, component: the least node reachable, for every node with a link.

    Self links and null ends are ignored; repeated and reversed links count once.
    """
    least, most = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    now = edges.where(F.col(a) != F.col(b)).select(most.alias("u"), least.alias("v")).distinct()
    now, path = written_at(now, "links")
    state = None
    for _ in range(rounds):
        before = path
        now, path = written_at(_small_star(_large_star(now)), "links")
        delete(now.sparkSession, before)
        seen = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("u") < F.col("v"))
        ).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = seen
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def spanning_rows(n: int, pairs):
    """Labels 0..n-1 by component, from an iterable of (left, right) index arrays.

    Only a label array is kept, so the pairs may be many times the nodes.
    """
    import numpy as np

    label = np.arange(n, dtype=np.int64)
    for left, right in pairs:
        if not len(left):
            continue
        while True:
            a, b = label[left], label[right]
            differ = a != b
            if not differ.any():
                break
            a, b = a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
    return label
