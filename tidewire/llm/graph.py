"""Connected components of a link graph whose nodes are 64-bit integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import drop_table, join_classes, materialise

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the edges (a, b): (node, smallest node), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a partition says about connectivity needs one edge a node at most."""
    a = b = np.empty(0, np.int64)
    for x in batches:
        a, b = forest(np.concatenate([a, x["a"].to_numpy()]), np.concatenate([b, x["b"].to_numpy()]))
    yield pd.DataFrame({"a": a, "b": b})


def _low(e: DataFrame) -> DataFrame:
    """a, m, times: the least neighbour of each node and its number of edges."""
    return e.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times"))


def _large_star(e: DataFrame, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = join_classes(both.where("b > a"), _low(both), "a", total).withColumn("m", F.least("a", "m"))
    return met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    low = _low(e)
    moved = join_classes(e, low, "a", total).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that an edge touches; component is its smallest reachable node.

    Alternating large and small stars (Kiveris et al., 2014).  Each star is written to
    the shared folder; it needs a few shuffles of at most one row an edge, and the
    minima are combined before the shuffle.  A hub, a node of more than one edge in HOT,
    meets its minimum where its edges are; there are fewer than HOT hubs.  Edges with a
    null end and loops say nothing and are left out.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = materialise(e.where("a is not null and b is not null and a <> b").mapInPandas(_contract, EDGES), "stars")
    said, now = None, _said(e)
    while now != said and now[0]:
        large = materialise(_large_star(e, 2 * now[0]), "large-stars")
        small = materialise(_small_star(large, now[0]), "stars")
        drop_table(e)
        drop_table(large)
        e, said, now = small, now, _said(small)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _said(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
