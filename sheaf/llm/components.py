"""Connected components of a link table of any size, by alternating stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import materialise


def local_forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes by the links ``left[i] - right[i]``.

    Sending ``(i, root[i])`` on instead of all links keeps a task's output linear in its rows.
    """
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if np.array_equal(before, root):
            break
    return root


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the smallest node reachable.

    Each round hangs every neighbour under the smallest one it can see, first the larger
    neighbours of a node and then the smaller ones, until only stars are left: a logarithmic
    number of rounds. The links of a busy node are never gathered; its minimum has a partial
    aggregate and the join that hands it out is an ordinary equi-join, which adaptive execution
    splits. Rounds are written tables, so a lost executor costs no earlier round.

    Links that hold a null or join a node with itself count for nothing; an empty table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "links")
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every row now points down, so the smaller neighbours of u are all of its rows
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = materialise(small, "links")
        facts = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.countDistinct("u")).first()
        if tuple(facts) == state and facts[0] == facts[2]:
            break
        state = tuple(facts)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
