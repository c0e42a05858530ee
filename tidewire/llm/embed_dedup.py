"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors have a cosine of at least c exactly if their squared distance is at most
2 - 2c.  A rotation keeps distances.  If the rotated dimensions are split into blocks,
each with a share of that budget in proportion to its dimensions, then two vectors within
the budget are within the share of at least one block.  So the candidates are the union
of one range join a block, and each candidate is then verified on the original vectors.

The range joins run over pages: vectors are cut, by medians along the rotated
dimensions, into cells, and cells into pages of a bounded number of vectors.  A page has
its bounds in every block.  Pages meet where, in some block, their bounds are within its
share: pages are filed under the grid cells of the block's leading dimensions that they
touch, joined on those, and filtered by the distance of their bounds.  Every pair of
pages that remains is a unit of work of bounded size, however many copies of a vector
there are; equal vectors were merged before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import join_classes, materialise
from tidewire.llm.graph import connected_components, forest

THRESHOLD = 0.95
BLOCK_DIMS = 8
#: Vectors in a page at most (about); of a pair of pages compared at a time; in the sample that places the cuts.
PAGE, TILE, SAMPLE = 4096, 1024, 20_000
#: Bytes of a page's vectors at most (about): pages of long vectors hold fewer.
PAGE_BYTES = 32 << 20
#: Leading dimensions of a block that make its grid, and the width of its cells in radii.
GRID_DIMS, GRID_WIDTH = 2, 4.0
SEED = 7
FOUND = "node long, n long, to long"


def valid(v: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def rotation(dims: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def blocks(dims: int) -> list[slice]:
    n = max(1, round(dims / BLOCK_DIMS))
    edges = [dims * k // n for k in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def page_rows(most: int, dims: int) -> int:
    """Vectors in a page: ``most``, or as many as PAGE_BYTES hold."""
    return max(1, min(most, PAGE_BYTES // (8 * max(dims, 1))))


class Cuts:
    """A binary tree of median cuts along the widest rotated dimension, from a bounded sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim = np.zeros(1 << depth, np.int64)
        self.at = np.full(1 << depth, np.inf)
        self._grow(1, sample, depth)

    def _grow(self, node: int, x: np.ndarray, depth: int) -> None:
        if depth == 0 or len(x) < 2:
            return
        self.dim[node] = d = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
        self.at[node] = c = np.median(x[:, d])
        self._grow(2 * node, x[x[:, d] < c], depth - 1)
        self._grow(2 * node + 1, x[x[:, d] >= c], depth - 1)

    def cell(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (x[np.arange(len(x)), self.dim[node]] >= self.at[node])
        return node


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in v])


def _pages(classes: DataFrame, dims: int, budget: float) -> DataFrame:
    """page, ids, times, vectors, and the page's grid cells: (block, cell) and bounds."""
    turn = rotation(dims)
    parts = blocks(dims)
    n, size = classes.count(), page_rows(PAGE, dims)
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / size))))
    some = classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("v").toPandas()["v"]  # bounded by SAMPLE
    cuts = Cuts(_unit(_matrix(some)) @ turn if len(some) else np.zeros((0, dims)), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            m = _matrix(x["v"]) if len(x) else np.zeros((0, dims))
            yield pd.DataFrame({"rep": x["rep"], "times": x["times"], "cell": cuts.cell(_unit(m) @ turn) if len(x) else [], "v": [r.tobytes() for r in m]})

    placed = materialise(classes.mapInPandas(place, "rep long, times long, cell long, v binary"), "placed")
    # A cell of many vectors is dealt out to several pages.
    many = placed.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("shares"))
    paged = placed.join(many, "cell").withColumn("share", F.pmod(F.xxhash64("rep"), F.col("shares")))
    own = paged.groupBy("cell", "share").agg(F.collect_list(F.struct("rep", "times", "v")).alias("rows"))
    own = own.select((F.col("cell") * (1 << 32) + F.col("share")).alias("page"), F.col("rows.rep").alias("ids"), F.col("rows.times").alias("times"), F.col("rows.v").alias("vectors"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for page, ids, times, vectors in zip(x["page"], x["ids"], x["times"], x["vectors"]):
                raw = b"".join(vectors)
                y = _unit(np.frombuffer(raw).reshape(-1, dims)) @ turn
                low, high = y.min(axis=0), y.max(axis=0)
                cells = []
                for b, part in enumerate(parts):
                    r = np.sqrt(budget * (part.stop - part.start) / dims)
                    lead = slice(part.start, min(part.start + GRID_DIMS, part.stop))
                    first, last = (np.floor(e / (GRID_WIDTH * r)).astype(int) for e in (low[lead] - r, high[lead] + r))
                    grid = np.stack(np.meshgrid(*(np.arange(s, e + 1) for s, e in zip(first, last))), -1).reshape(-1, len(first))
                    cells += [":".join(map(str, (b, *g))) for g in grid]
                yield pd.DataFrame({"page": [page], "ids": [np.asarray(ids, "<i8").tobytes()], "times": [np.asarray(times, "<i8").tobytes()], "vectors": [raw], "low": [low], "high": [high], "cells": [cells]})

    return materialise(own.mapInPandas(bound, "page long, ids binary, times binary, vectors binary, low array<double>, high array<double>, cells array<string>"), "pages")


def _compare(dims: int, threshold: float):
    turn, parts, budget = rotation(dims), blocks(dims), 2 - 2 * threshold
    slack = 1e-5  # rounding in single precision must not lose a pair; verification is exact

    def sides(u) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block two matrices, (u, |u|^2, 1) and (-2u, 1, |u|^2): products of rows are squared distances."""
        out = []
        for part in parts:
            p = u[:, part]
            norm, one = (p * p).sum(axis=1), np.ones(len(p))
            out.append((np.column_stack([p, norm, one]).astype(np.float32), np.column_stack([-2 * p, one, norm]).astype(np.float32)))
        return out

    def cut(u, at: slice):
        return [(p[at], q[at]) for p, q in u]

    def tile(x, y, u, v, same: bool) -> np.ndarray:
        """Which pairs of two runs of vectors link.  x, y: original; u, v: sides of the rotated units."""
        near = np.zeros((len(x), len(y)), bool)
        for part, p, q in zip(parts, u, v):
            near |= p[0] @ q[1].T <= np.float32(budget * (part.stop - part.start) / dims + slack)
        if same:
            near &= np.triu(np.ones(near.shape, bool), 1)
        i, j = np.nonzero(near)
        for s in range(0, len(i), 200_000):
            a, b = x[i[s : s + 200_000]], y[j[s : s + 200_000]]
            cosine = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
            near[i[s : s + 200_000], j[s : s + 200_000]] = cosine >= threshold
        return near

    def read(ids: bytes, times: bytes, vectors: bytes):
        x = np.frombuffer(vectors).reshape(-1, dims)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return np.frombuffer(ids, "<i8"), np.frombuffer(times, "<i8"), x, sides(_unit(x) @ turn)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, times, x, u = read(row.ids, row.times, row.vectors)
                same = row.page == row.page2
                ids2, times2, y, v = (ids, times, x, u) if same else read(row.ids2, row.times2, row.vectors2)
                n, n2 = np.zeros(len(ids), np.int64), np.zeros(len(ids2), np.int64)
                a = b = ids[:0]
                for s in range(0, len(ids), TILE):
                    for t in range(s if same else 0, len(ids2), TILE):
                        p, q = slice(s, s + TILE), slice(t, t + TILE)
                        near = tile(x[p], y[q], cut(u, p), cut(v, q), same and s == t)
                        n[p] += near @ times2[q]
                        n2[q] += times[p] @ near
                        i, j = np.nonzero(near)
                        if len(i):
                            a, b = forest(np.concatenate([a, ids[p][i]]), np.concatenate([b, ids2[q][j]]))
                if same:
                    n, n2 = n + n2, n2[:0]
                    ids2 = ids2[:0]
                node, count = np.concatenate([ids, ids2]), np.concatenate([n, n2])
                some = count > 0
                yield pd.DataFrame({"node": np.concatenate([node[some], a]), "n": np.concatenate([count[some], np.full(len(a), -1)]), "to": np.concatenate([node[some], b])})

    return run


def _found(classes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """node, n, to: counts of links and links of classes whose vectors all have ``dims`` components."""
    page = _pages(classes, dims, 2 - 2 * threshold)
    key = page.select("page", "low", "high", F.explode("cells").alias("cell"))
    other = key.toDF("page2", "low2", "high2", "cell")
    # Pages whose bounds are too far apart in every block have no candidates.
    gap = F.transform(F.arrays_zip("low", "high", "low2", "high2"), lambda e: F.pow(F.greatest(F.lit(0.0), e["low"] - e["high2"], e["low2"] - e["high"]), 2))
    tight = [F.aggregate(F.slice("gap", p.start + 1, p.stop - p.start), F.lit(0.0), lambda s, e: s + e) <= (2 - 2 * threshold) * (p.stop - p.start) / dims + 1e-9 for p in blocks(dims)]
    some = tight[0]
    for t in tight[1:]:
        some = some | t
    pairs = key.join(other, "cell").where("page <= page2").withColumn("gap", gap).where(some).select("page", "page2").distinct()
    body = page.select("page", "ids", "times", "vectors")
    units = pairs.join(body, "page").join(body.toDF("page2", "ids2", "times2", "vectors2"), "page2")
    return units.mapInPandas(_compare(dims, threshold), FOUND)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", dims: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``rows``.

    Two rows link if the cosine of their vectors, in double precision, is at least
    ``threshold``.  n_links counts the other rows that a row links with, copies
    included; component_id is the smallest id reachable over links, itself included.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, as do those that don't have ``dims`` components where that is given; by
    default, vectors of each size link among themselves.  Repeated ids are rows of their
    own that share what their vectors link with.
    """
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = valid(F.col("v")) & F.col("vec_id").isNotNull()
    if dims is not None:
        ok = ok & (F.size("v") == dims)
    own = own.select("vec_id", F.when(ok, F.col("v")).alias("v"))
    classes = materialise(own.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times")), "classes")
    # Vectors of different sizes have no cosine, and a vector alone in its size no links.
    sizes = [r[0] for r in classes.groupBy(F.size("v").alias("size")).count().where("count > 1").orderBy("size").collect()]
    all_ = [materialise(_found(classes.where(F.size("v") == d), d, threshold), "found") for d in sizes]
    found = reduce(DataFrame.unionByName, all_) if all_ else rows.sparkSession.createDataFrame([], FOUND)
    parts = connected_components(found.where("n < 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    info = classes.join(counts, classes["rep"] == counts["node"], "left").drop("node").join(parts, F.col("rep") == parts["node"], "left")
    info = materialise(info.select("v", "times", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "links")
    linked = join_classes(own.where("v is not null"), info, "v").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    out = linked.unionByName(own.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
