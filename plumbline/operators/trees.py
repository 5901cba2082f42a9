"""Questions about what encloses what in trees, by interval labels instead of pairs of nodes and ancestors.

``labels`` numbers the nodes of all trees: ``pre`` is a node's place when all trees are walked from their roots, ``end`` the
place of the last node below it.  So a node lies below another if its ``pre`` is in the other's interval, and intervals never
cross.  A sweep in the order of ``pre`` then answers for all nodes whether something marked encloses them or lies below them.
Sweeps go over ranges of the order (see ``ranges``), so a tree may be larger than a task.

Most trees are small, though.  ``in_rows`` brings each of them into one row, with one shuffle and no labels; ``Forest`` then answers
the same questions for all the trees of a batch at once.  ``large_trees`` tells which ones are left to the sweeps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .ranges import running


def labels(nodes: DataFrame, tree: Sequence[str], node: str = "node", parent: str = "parent", ordinal: str = "ordinal") -> DataFrame:
    """``nodes`` with ``pre`` and ``end``.

    ``ordinal`` (0 or more) tells the children of a node apart and orders them; a root has a null ``parent``, and several roots
    of a tree are ordered the same way.  A node whose parent isn't there, or that is its own ancestor, has null labels.  Nodes
    get a path level by level, each level from the one above alone, so there are as many rounds as levels.
    """
    tree = list(tree)
    key = F.lpad(F.hex(F.col(ordinal).cast("long")), 8, "0")
    base = written(nodes.select(*tree, F.col(node).alias("_node"), F.col(parent).alias("_parent"), key.alias("_key")))
    level = written(base.filter("_parent IS NULL").select(*tree, "_node", F.col("_key").alias("_path")))
    placed = level
    while not level.isEmpty():
        above = level.select(*tree, F.col("_node").alias("_parent"), F.col("_path").alias("_above"))
        level = written(base.join(above, [*tree, "_parent"]).select(*tree, "_node", F.concat("_above", "_key").alias("_path")))
        placed = placed.unionByName(level)
    # A node opens at its path and closes after all paths that go on from it.
    opens = placed.select(*tree, "_node", F.col("_path").alias("_at"), F.lit(1).alias("_open"))
    closes = placed.select(*tree, "_node", F.concat("_path", F.lit("~")).alias("_at"), F.lit(0).alias("_open"))
    walked = running(opens.unionByName(closes), [*tree, "_at"], F.col("_open"), "sum", "_place")
    found = walked.groupBy(*tree, "_node").agg(F.max(F.when(F.col("_open") == 1, F.col("_place"))).alias("pre"), F.max("_place").alias("end"))
    return nodes.join(found.withColumnRenamed("_node", node), [*tree, node], "left")


def enclosed(labelled: DataFrame, mark: Column, name: str = "enclosed") -> DataFrame:
    """``labelled`` with ``name``: whether a node of which ``mark`` holds lies above this one.  Nodes without labels get null."""
    known = labelled.filter("pre IS NOT NULL")
    reach = running(known, ["pre"], F.when(mark, F.col("end")), "max", "_reach", exclusive=True)
    swept = reach.withColumn(name, F.coalesce(F.col("_reach") >= F.col("pre"), F.lit(False))).drop("_reach")
    return swept.unionByName(labelled.filter("pre IS NULL").withColumn(name, F.lit(None).cast("boolean")))


def encloses(labelled: DataFrame, mark: Column, name: str = "encloses") -> DataFrame:
    """``labelled`` with ``name``: whether a node of which ``mark`` holds lies below this one.  Nodes without labels get null."""
    known = labelled.filter("pre IS NOT NULL").withColumn("_back", -F.col("pre"))
    first = running(known, ["_back"], F.when(mark, F.col("pre")), "min", "_first", exclusive=True)
    swept = first.withColumn(name, F.coalesce(F.col("_first") <= F.col("end"), F.lit(False))).drop("_first", "_back")
    return swept.unionByName(labelled.filter("pre IS NULL").withColumn(name, F.lit(None).cast("boolean")))


#: Trees of more nodes than this aren't held by one task.
TREE_NODES = 1 << 17


def large_trees(nodes: DataFrame, tree: Sequence[str]) -> DataFrame:
    """The trees that have too many nodes for one row."""
    return nodes.groupBy(*tree).agg(F.count("*").alias("_nodes")).filter(F.col("_nodes") > TREE_NODES).select(*tree)


def in_rows(nodes: DataFrame, tree: Sequence[str], *columns: Column | str) -> DataFrame:
    """A row per tree: its nodes' ``columns`` as an array ``nodes`` of structs."""
    return nodes.groupBy(*tree).agg(F.collect_list(F.struct(*columns)).alias("nodes"))


class Forest:
    """Trees of a batch: of all their nodes the tree's number, the node and its parent (null for a root), as flat arrays.

    ``parent`` is the place of each node's parent: ``n`` (their number) for a root, ``n + 1`` if it isn't there.  ``placed`` holds
    of nodes that a root leads to; the others have no place in the tree, as in ``labels``.  Steps up are doubled, so there are as
    many as the logarithm of the depth.
    """

    def __init__(self, tree: np.ndarray, node: pa.Array, parent: pa.Array) -> None:
        n = self.n = len(tree)
        names = pa.concat_arrays([node, parent]).dictionary_encode()
        codes = names.indices.fill_null(-1).to_numpy().astype(np.int64)
        own, up = (tree * (len(names.dictionary) + 1) + c for c in (codes[:n], codes[n:]))
        order = np.argsort(own, kind="stable")
        at = np.minimum(np.searchsorted(own[order], up), max(n - 1, 0))
        there = order[at] if n else at
        self.parent = np.append(np.where(codes[n:] < 0, n, np.where(own[there] == up, there, n + 1)), [n, n + 1])
        self._ups, bound = [self.parent], int(np.bincount(tree).max()).bit_length() if n else 0
        while (self._ups[-1] < n).any() and len(self._ups) <= bound:
            self._ups.append(self._ups[-1][self._ups[-1]])
        self.placed = self._ups[-1][:n] == n

    def enclosed(self, mark: np.ndarray) -> np.ndarray:
        """Whether a node of which ``mark`` holds lies above."""
        above = np.append(mark, [False, False])[self.parent]
        for up in self._ups:
            above = above | above[up]
        return above[: self.n]

    def encloses(self, mark: np.ndarray) -> np.ndarray:
        """Whether a node of which ``mark`` holds lies below."""
        below = np.zeros(self.n + 2, dtype=bool)
        below[self.parent[: self.n][mark]] = True
        below[self.n :] = False
        for up in self._ups:
            below[up[below.nonzero()[0]]] = True
            below[self.n :] = False
        return below[: self.n]
