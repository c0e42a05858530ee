"""Approximate nearest neighbours by largest inner product: an adaptive dimension scan over probed lists.

Vectors are filed by norm, in shells of nearly equal norms, and in a shell in the list of their
nearest centre.  From a list's size, centre and spread, along the centre and across, follows
how large the inner products of a query with its vectors are, and, where norms are nearly
equal, that holds also if they vary over the whole set.  A query first visits the lists that
promise the largest products.  The k-th product found there is a bound, and each list tells how
many of its vectors are expected beyond it; the query then visits the lists with most of
them, until they hold ``EXPECTED`` of all that is expected.  So structured vectors are found
in few lists; where vectors have no structure, neighbours are everywhere and most lists are
visited.

In a list a vector x becomes (x, sqrt(M^2 - |x|^2)), where M is the list's largest norm, and a
query q becomes (q, 0): the largest products are then the smallest distances.

A list is scanned in blocks of dimensions: after each, the distance so far estimates the
whole one, since after a random rotation every dimension tells as much as another, and
candidates whose estimate exceeds the bound by more than chance allows are given up.
Survivors are measured exactly, on the original vectors.

Lists are cut into pages and queries into batches, so every unit of work is bounded,
also where one list holds a third of all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import materialise
from tidewire.llm.embed_dedup import _matrix, page_rows, rotation, valid

#: Rows of which the centres are learnt at most; lists at most; vectors in a page (fewer, if they are long: see PAGE_BYTES); queries in a batch.
SAMPLE, LISTS, PAGE, BATCH = 20_000, 4096, 4096, 256
#: Lists are so many times the root of the number of vectors.
MORE = 3
#: Part of the lists that a query visits first, and the fewest; times k the vectors that these hold at least; part of the expected neighbours that its lists must hold.
HOME, FEWEST, FIRST, EXPECTED = 0.1, 3, 4, 0.93
#: Norms of a shell are within this ratio; the last of so many shells has all that is smaller.
RATIO, SHELLS = 1.2, 64
#: Dimensions in a block, and how many standard errors an estimate may err.
STEP, DOUBT = 16, 2.8
#: Part of the pairs of a unit under which they are followed one by one and no longer as a matrix.
FEW = 0.05


def centres(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """k-means on a bounded sample."""
    rng = np.random.default_rng(seed)
    own = sample[rng.permutation(len(sample))[:n]].copy()
    for _ in range(rounds):
        at = np.argmin((own * own).sum(axis=1)[None, :] - 2 * sample @ own.T, axis=1)
        n_of = np.bincount(at, minlength=len(own))
        total = np.zeros_like(own)
        np.add.at(total, at, sample)
        own[n_of > 0] = total[n_of > 0] / n_of[n_of > 0, None]
    return own


def _above(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """P(a normal variable > x), by the logistic function that is nearest to it; 1 where x is minus infinity."""
    z = np.clip((mean - np.maximum(x, -1e300)) / np.sqrt(var + 1e-12), -20, 20)
    return 1 / (1 + np.exp(-(1.5976 * z + 0.07056 * z**3)))


def _best(query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of each query the k places with the largest scores, ties to smaller ids."""
    by = np.lexsort((ids[row], -score, query))
    q = query[by]
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    return by[rank < k]


def _scan(k: int, turned):
    """Scan a page for a batch of queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids, q_ids = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.q_ids, "<i8")
                x, q = (np.frombuffer(v, "<f4" if small else "<f8").reshape(len(i), -1).astype(float) for v, i, small in ((r.vectors, ids, r.small), (r.q_vectors, q_ids, r.q_small)))
                y, p = turned(x, r.list).astype(np.float32), turned(q, None).astype(np.float32)
                dims = y.shape[1]
                bound = np.frombuffer(r.bounds)
                apart = np.zeros((len(q_ids), len(ids)), np.float32)
                rows = cols = part = None  # the pairs that are left, once they are few
                for s in range(0, dims, STEP):
                    e = min(s + STEP, dims)
                    a, b = y[:, s:e], p[:, s:e]
                    least = bound if e == dims else bound * (e / dims) * (1 + DOUBT / np.sqrt(e)) ** 2
                    least = (least * (1 + 1e-5) + 1e-6).astype(np.float32)
                    if rows is None:
                        apart += (b * b).sum(axis=1)[:, None] + (a * a).sum(axis=1)[None, :] - 2 * (b @ a.T)
                        stay = apart <= least[:, None]
                        if e == dims or stay.mean() < FEW:
                            rows, cols = np.nonzero(stay)
                            part = apart[rows, cols]
                    else:
                        part = part + ((b[rows] - a[cols]) ** 2).sum(axis=1)
                        stay = part <= least[rows]
                        rows, cols, part = rows[stay], cols[stay], part[stay]
                other = ids[cols] != q_ids[rows]
                rows, cols = rows[other], cols[other]
                score = np.concatenate([(q[rows[s : s + 200_000]] * x[cols[s : s + 200_000]]).sum(axis=1) for s in range(0, len(rows), 200_000)] or [np.zeros(0)])
                top = _best(rows, cols, score, ids, k)
                yield pd.DataFrame({"query_id": q_ids[rows[top]], "vec_id": ids[cols[top]], "score": score[top]})

    return run


FOUND = "query_id long, vec_id long, score double"
PLACED = "list int, id long, v binary, small boolean, bound double"


def _packed(m: np.ndarray) -> tuple[list[bytes], list[bool]]:
    """Vectors as bytes, in single precision where that says the same, and which those are."""
    with np.errstate(over="ignore"):
        small = m.astype("<f4")
    exact = (small == m).all(axis=1)
    return [(s if e else r).tobytes() for s, r, e in zip(small, m, exact)], exact.tolist()


def _pages(placed: DataFrame, size: int) -> DataFrame:
    """Rows of (list, id, v, small, bound) as bounded pages: the rows of a list and format, dealt out by a hash of their id."""
    placed = materialise(placed, "placed")
    many = F.broadcast(placed.groupBy("list", "small").agg(F.ceil(F.count("*") / size).alias("shares")))  # at most two rows a list
    dealt = placed.join(many, ["list", "small"]).withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
    rows = dealt.groupBy("list", "small", "share").agg(F.collect_list(F.struct("id", "v", "bound")).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({
                "list": b["list"], "small": b["small"], "share": b["share"], "ids": [np.asarray(i, "<i8").tobytes() for i in b["id"]],
                "vectors": [b"".join(v) for v in b["v"]], "bounds": [np.asarray(x, float).tobytes() for x in b["bound"]],
            })

    flat = rows.select("list", "small", "share", F.col("rows.id").alias("id"), F.col("rows.v").alias("v"), F.col("rows.bound").alias("bound"))
    return flat.mapInPandas(run, "list int, small boolean, share long, ids binary, vectors binary, bounds binary")


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", expected: float = EXPECTED) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the k rows with the largest inner product that were found.

    A query is not its own neighbour (rows with its id are left out).  Scores are inner
    products of the original vectors in double precision; ties go to the smaller id.
    Rows and queries whose vector is null, zero or holds null or non-finite components,
    or whose id is null, take no part.  Inner products exist within a size of vectors only,
    so each size is a search of its own.  Rows that share an id are candidates each, so an id
    may be found more than once; such queries are one, with the first of their vectors in
    array order.  Products that overflow are infinite, and tie.  With ``expected``
    1, all lists are visited in which a neighbour can be expected.
    """

    def clean(df: DataFrame) -> DataFrame:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        return own.where(valid(F.col("v")) & F.col("id").isNotNull())

    own = materialise(clean(rows), "vectors")
    asked = materialise(clean(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    size = F.size("v").alias("size")
    sizes = own.select(size).distinct().join(asked.select(size).distinct(), "size").orderBy("size").collect()
    found = [_search(own.where(F.size("v") == d), asked.where(F.size("v") == d), d, k, expected) for (d,) in sizes]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(own: DataFrame, asked: DataFrame, dims: int, k: int, expected: float) -> DataFrame:
    """As ``search``, of (id, v) whose vectors all have ``dims`` components."""
    peak = F.max(F.array_max(F.transform("v", F.abs)))
    scale = max(own.agg(peak).first()[0], asked.agg(peak).first()[0])  # so that squares neither overflow nor vanish
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, e: s + (e / scale) * (e / scale))
    n, largest = own.agg(F.count("*"), F.max(norm2)).first()
    turn = rotation(dims + 1)
    some = _matrix(own.orderBy(F.xxhash64("id")).limit(SAMPLE).select("v").toPandas()["v"]) / scale  # bounded by SAMPLE
    top = np.sqrt(largest)

    def shell(m: np.ndarray) -> np.ndarray:
        norm = np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)
        return np.clip(np.log(top / norm) / np.log(RATIO), 0, SHELLS - 1).astype(int)

    of = shell(some)
    there, each = np.unique(of, return_counts=True)
    lists = max(1, min(LISTS, int(MORE * np.sqrt(n))))
    parts = [centres(some[of == s], max(1, round(lists * c / len(some)))) for s, c in zip(there, each)]
    plain, shell_of = np.concatenate(parts), np.repeat(there, [len(x) for x in parts])
    nearest = there[np.argmin(np.abs(np.arange(SHELLS)[:, None] - there[None, :]), axis=1)]  # a shell that the sample has not goes to one that it has
    ray = plain / np.maximum(np.sqrt((plain * plain).sum(axis=1, keepdims=True)), 1e-300)  # along which norms spread
    homes = min(len(plain), max(FEWEST, int(np.ceil(HOME * len(plain)))))

    def filed(m: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        at, s = np.zeros(len(m), int), nearest[shell(m)]
        for one in np.unique(s):
            mine = np.flatnonzero(shell_of == one)
            c = plain[mine]
            at[s == one] = mine[np.argmin((c * c).sum(axis=1)[None, :] - 2 * m[s == one] @ c.T, axis=1)]
        return at

    def apart(m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector how far it is from its centre along the centre's ray, and what is left across."""
        off = m - plain[at]
        along_ = (off * ray[at]).sum(axis=1)
        return along_, off - along_[:, None] * ray[at]

    # Directions in which vectors spread across rays: their share of the whole spread, in all lists alike.
    rest = apart(some, filed(some))[1]
    spread_of = rest.T @ rest
    spread_of = spread_of / max(np.trace(spread_of), 1e-300)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                raw = _matrix(b["v"])
                m = raw / scale
                at = filed(m)
                v, small = _packed(raw)
                along_, across_ = apart(m, at)
                yield pd.DataFrame({"list": at, "id": b["id"], "v": v, "small": small, "bound": 0.0, "across": (across_ * across_).sum(axis=1), "along": along_**2, "norm2": (m * m).sum(axis=1)})

    placed = materialise(own.mapInPandas(file, f"{PLACED}, across double, along double, norm2 double"), "filed")
    spread = placed.groupBy("list").agg(F.count("*").alias("n"), F.avg("across").alias("across"), F.avg("along").alias("along"), F.max("norm2").alias("high")).collect()  # at most LISTS + SHELLS rows
    size, along, across, high = np.zeros((4, len(plain)))
    for r in spread:
        size[r["list"]], along[r["list"]], across[r["list"]], high[r["list"]] = r["n"], r["along"], r["across"], r["high"]
    pages = materialise(_pages(placed.drop("across", "along", "norm2"), page_rows(PAGE, dims)).drop("bounds"), "lists")
    each_page = pages.select("list", "small", "share")  # a row a page of some thousand vectors

    def turned(m: np.ndarray, of_list: int | None) -> np.ndarray:
        m = m / scale
        more = np.zeros(len(m)) if of_list is None else np.sqrt(np.maximum(0, high[of_list] - (m * m).sum(axis=1)))
        return np.column_stack([m, more]) @ turn

    def visits(q: np.ndarray, least: np.ndarray, home: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of the visits of queries whose k-th product so far is ``least``."""
        mean = q @ plain.T
        var = (q @ ray.T) ** 2 * along + ((q @ spread_of) * q).sum(axis=1)[:, None] * across
        order = np.argsort(-np.where(size > 0, mean + 2 * np.sqrt(var), -np.inf), axis=1, kind="stable")
        held = np.cumsum(size[order], axis=1)
        first = (np.arange(len(plain)) < homes) | (held - size[order] < FIRST * k)
        first &= size[order] > 0
        if home:
            row, at = np.nonzero(first)
            return row, order[row, at]
        wanted = size[None, :] * _above(least[:, None], mean, var)
        np.put_along_axis(wanted, order, np.where(first, 0, np.take_along_axis(wanted, order, axis=1)), axis=1)
        best = np.argsort(-wanted, axis=1, kind="stable")
        most = np.take_along_axis(wanted, best, axis=1)
        upto = np.cumsum(most, axis=1)
        share = np.where(np.isinf(least), 1.0, expected)[:, None]  # whoever has no k yet visits all
        more = (upto - most < share * upto[:, -1:]) | (np.arange(len(plain)) < homes)  # as many again at least, whose vectors a normal spread may not tell
        row, at = np.nonzero((most > 0) & more)
        return row, best[row, at]

    def visit(home: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for s in range(0, len(whole), BATCH):
                    b = whole.iloc[s : s + BATCH]
                    m, least = _matrix(b["v"]), b["bound"].to_numpy()
                    q = m / scale
                    row, col = visits(q, least, home)
                    v, small = _packed(m)
                    bound = (q * q).sum(axis=1)[row] + high[col] - 2 * least[row]
                    yield pd.DataFrame({"list": col, "id": b["id"].to_numpy()[row], "v": [v[i] for i in row], "small": [small[i] for i in row], "bound": bound})

        return run

    def scanned(asked: DataFrame, home: bool) -> DataFrame:
        visits = asked.mapInPandas(visit(home), PLACED)
        batch = _pages(visits, BATCH).toDF("list", "q_small", "q_share", "q_ids", "q_vectors", "bounds").drop("q_share")
        # A query's vector is in as many batches as it has visits, of which files of visits, where it is written once, tell nothing: batches are never broadcast.
        # They are dealt to the pages of their list, so a list of many pages is many tasks.
        dealt = batch.join(F.broadcast(each_page), "list").hint("merge")
        return dealt.join(pages, ["list", "small", "share"]).mapInPandas(_scan(k, turned), FOUND)

    home = materialise(_best_of(scanned(asked.withColumn("bound", F.lit(float("-inf"))), True), k), "home")
    kth = home.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("score"))
    least = F.coalesce(F.col("score") / scale / scale, F.lit(float("-inf")))
    second = asked.join(kth, F.col("id") == F.col("query_id"), "left").select("id", "v", least.alias("bound"))
    found = home.select("query_id", "vec_id", "score").unionByName(scanned(second, False))
    return _best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
